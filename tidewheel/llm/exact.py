"""Exact deduplication: skew-safe combining of equal texts, in DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from .common import cut, fresh, quoted


def sha256_digest(text: Column) -> Column:
    return F.sha2(text, 256)


def content_winners(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    salts: int = 16,
) -> DataFrame:
    """digest, text, keep_id (largest id), group_size: one row per distinct text.

    Three stages, each of which groups by the full text besides the digest, so that texts are
    compared whole: (1) Spark's partial aggregation combines equal texts within a map task, as the
    salt is constant there; (2) salted digest groups are merged; (3) the salts' winners are
    combined. However large a group of copies is, no task reads more than one row of it from each
    map task, and the last stage one from each salt.

    Nulls: a null text counts as empty; a null id loses against any other and stays only if its
    whole group has none. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), text.alias("text"))
    rows = rows.select("id", "text", digest(F.col("text")).alias("digest"))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max("id").alias("best"), F.count(F.lit(1)).alias("n"))
    )
    return salted.groupBy("digest", "text").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256_digest,
    salts: int = 16,
) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, digest.

    Of equal texts the row with the largest id stays. Members learn of their group through the
    digest where the comparison of contents has found one text under it, and through digest and
    full text where it has found several (a collision).

    Nulls, ties: see content_winners. Rows that repeat an id and its text each count in group_size
    and share the verdict; unique_rows() keeps one of them. Other columns are not read.
    """
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    rows = docs.select(F.col(quoted(id_col)).alias("doc_id"), text.alias("text"))
    rows = rows.select("doc_id", "text", digest(F.col("text")).alias("digest"))
    winners = content_winners(docs, id_col, text_col, digest, salts)
    groups = cut(
        winners.groupBy("digest").agg(
            F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size")
        )
    )
    collided = groups.filter("contents > 1").select("digest")
    if collided.isEmpty():
        members = rows.select("doc_id", "digest").join(groups, "digest")
    else:
        single = rows.join(groups.filter("contents = 1"), "digest").select("doc_id", "digest", "keep_id", "group_size")
        several = rows.join(collided, "digest", "left_semi").join(winners, ["digest", "text"])
        members = single.unionByName(several.select("doc_id", "digest", "keep_id", "group_size"))
    return members.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def unique_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 16) -> DataFrame:
    """docs with one row per distinct text, that of the largest id; all its columns as they were.

    Rows that repeat id and text leave one: that with the largest hash of all columns. A null text
    equals an empty one; of a group with both, the row with the largest id stays as it is. Columns
    may have any type and name.
    """
    names = docs.columns
    no_text, at = fresh(names, "no_text"), fresh(names, "at")
    text = F.coalesce(F.col(quoted(text_col)), F.lit(""))
    row = F.struct(*[F.col(quoted(c)) for c in names if c != text_col], F.col(quoted(text_col)).isNull().alias(no_text))
    # only the id and a hash are ordered, so that the row may hold what has no order or hash, such as maps
    hashed = [F.to_json(F.struct(F.col(quoted(c)))) if _holds_map(docs.schema[c].dataType) else F.col(quoted(c)) for c in names]
    order = F.struct(F.col(quoted(id_col)).alias("id"), F.xxhash64(*hashed).alias("hash"))
    rows = docs.select(text.alias("text"), F.sha2(text, 256).alias("digest"), order.alias(at), row.alias("row"))
    salted = (
        rows.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
        .groupBy("digest", "salt", "text")
        .agg(F.max_by("row", at).alias("row"), F.max(at).alias(at))
    )
    kept = salted.groupBy("digest", "text").agg(F.max_by("row", at).alias("row"))
    inside = F.col("row")
    out = [F.when(~inside[no_text], F.col("text")).alias(c) if c == text_col else inside[c].alias(c) for c in names]
    return kept.select(*out)


def _holds_map(kind: DataType) -> bool:
    return "map<" in kind.simpleString() or "variant" in kind.simpleString()
