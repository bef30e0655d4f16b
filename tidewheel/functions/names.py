"""Dotted tag names and the encoded keys of lift and bucket."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def part(tag: Column, i: int) -> Column:
    """The i-th part (from 0) of a dotted name, null if there is none."""
    return F.get(F.split(tag, r"\."), i)


def last_part(tag: Column) -> Column:
    return F.element_at(F.split(tag, r"\."), -1)


def strip_prefix(tag: Column, prefixes: Iterable[str]) -> Column:
    """tag without the first of prefixes that it begins with."""
    out = tag
    for p in reversed(list(prefixes)):
        out = F.when(tag.startswith(p), F.substring(tag, len(p) + 1, F.length(tag))).otherwise(out)
    return out


def safe(tag: Column) -> Column:
    """A name usable as a column: '.', ' ', '-' and '/' become '_'."""
    return F.translate(tag, ". -/", "____")


def labelled(source: Column, name: Column, default: str) -> Column:
    """name, with its source before it unless that is the default."""
    return F.when(source == default, name).otherwise(F.concat_ws("/", source, name))


def lift_bucket_key(lift: Column, bucket: Column) -> Column:
    return F.concat_ws("_", lift.cast("string"), bucket.cast("string"))


def key_lift(key: Column) -> Column:
    """The lift of an encoded key: all before the last '_'."""
    return F.regexp_extract(key, "^(.*)_([^_]*)$", 1)


def key_bucket(key: Column) -> Column:
    return F.regexp_extract(key, "^(.*)_([^_]*)$", 2).cast("long")
