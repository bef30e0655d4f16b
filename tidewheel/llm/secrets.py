"""Secret scans: fixed patterns, and character Markov models of random strings and identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from ..functions.sampling import hash_sample
from .common import beside, lean_batches, quoted
from .repetition import chunks

#: Kinds in the order that breaks ties between spans with the same start: pattern, least length, group measured.
BASE_KINDS: dict[str, tuple[re.Pattern, int, int]] = {
    "assign": (
        re.compile(
            r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
        ),
        12,
        2,
    ),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 18, 0),
    "hex": (re.compile(r"[0-9a-f]+"), 16, 0),
}
ORDER = (*BASE_KINDS, "random")
#: Characters the models know; all others count as one more symbol.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=_-"
SYMBOLS = len(ALPHABET) + 1
_INDEX = np.full(128, SYMBOLS - 1, np.int64)
_INDEX[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}")
#: hex as pattern and least length in one: a run of 16 or more is a run of any length that doesn't fail.
_HEX_RUN = re.compile(r"[0-9a-f]{16,}")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind), leftmost without overlaps for each kind, in code points."""
    found = []
    pattern, least, group = BASE_KINDS["assign"]
    found += [(*m.span(), "assign") for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    if "AKIA" in text:
        pattern, least, _ = BASE_KINDS["access"]
        found += [(*m.span(), "access") for m in pattern.finditer(text) if m.end() - m.start() >= least]
    found += [(*m.span(), "hex") for m in _HEX_RUN.finditer(text)]
    return found


@dataclass(frozen=True)
class MarkovModel:
    """Log-likelihood ratios, random against identifier, of a first character and of each next one.

    A string is random if the ratio's sum is at least min_total and its mean at least min_mean.
    """

    first: np.ndarray
    following: np.ndarray
    min_total: float = 12.0
    min_mean: float = 0.5

    def ratio(self, text: str) -> float:
        at = _INDEX[np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 127)]
        at = at if len(at) else np.zeros(0, np.int64)
        return float(self.first[at[:1]].sum() + self.following[at[:-1], at[1:]].sum())

    def is_random(self, text: str) -> bool:
        ratio = self.ratio(text)
        return ratio >= self.min_total and ratio >= self.min_mean * len(text)


def fit_markov(samples: DataFrame, text_col: str = "text", label_col: str = "random", smoothing: float = 0.5) -> MarkovModel:
    """Train both models from labelled strings (label true or 1: random).

    The counts are summed in Spark over all samples; what comes to the driver is a table of at
    most 2 * SYMBOLS * (SYMBOLS + 1) rows. Null or empty strings and null labels are left out.
    """
    rows = samples.select(F.col(quoted(text_col)).alias("s"), F.col(quoted(label_col)).cast("boolean").alias("y"))
    def pair(i: Column) -> Column:
        before = F.when(i > 1, F.substring(F.col("s"), i - 1, F.lit(1))).otherwise(F.lit(""))
        return F.struct(before.alias("a"), F.substring(F.col("s"), i, F.lit(1)).alias("b"))

    rows = rows.filter("length(s) > 0 AND y IS NOT NULL")
    pairs = rows.select("y", F.inline(F.transform(F.sequence(F.lit(1), F.length("s")), pair)))
    counts = pairs.groupBy("y", "a", "b").agg(F.count(F.lit(1)).alias("n"))
    known = lambda x: F.when(F.length(x) == 0, F.lit(-1)).otherwise(
        F.coalesce(F.nullif(F.instr(F.lit(ALPHABET), F.col(x)), F.lit(0)), F.lit(SYMBOLS)) - 1
    )
    small = counts.groupBy("y", known("a").alias("a"), known("b").alias("b")).agg(F.sum("n").alias("n")).collect()
    first, following = np.zeros((2, SYMBOLS)), np.zeros((2, SYMBOLS, SYMBOLS))
    for y, a, b, n in small:
        if a < 0:
            first[int(y), b] += n
        else:
            following[int(y), a, b] += n
    # what follows a character that was rarely seen is taken from what follows any
    alone = following.sum(1) + first + smoothing
    alone /= alone.sum(-1, keepdims=True)
    weight = smoothing * SYMBOLS / 4
    first = np.log((first + weight * alone) / (first.sum(-1, keepdims=True) + weight))
    following = np.log((following + weight * alone[:, None, :]) / (following.sum(-1, keepdims=True) + weight))
    return MarkovModel(first[1] - first[0], following[1] - following[0])


def random_samples(n: int = 3000, seed: int = 7) -> list[tuple[str, bool]]:
    """Labelled random strings over the alphabets that keys come in."""
    draw = random.Random(seed)
    upper, lower, digits = ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62]
    kinds = [upper + lower + digits, upper + lower + digits + "+/", upper + lower + digits + "-_", upper + digits, lower + digits]
    return [("".join(draw.choices(draw.choice(kinds), k=draw.randint(20, 64))), True) for _ in range(n)]


def identifier_samples(docs: DataFrame, text_col: str = "text", most_docs: int = 500, most: int = 20_000, seed: int = 7) -> DataFrame:
    """Labelled ordinary identifiers (text, random = false) from the words of a bounded sample.

    At most most_docs documents, those with the smallest seeded hash of their text, and at most
    most distinct words of letters from them. Each comes alone, joined with the word behind it in
    the order of hashes (the last with itself) in the ways identifiers are (snake, kebab, camel case,
    paths), and so with a number, as in names of versions and items.
    """
    sample = docs.select(F.coalesce(F.col(quoted(text_col)), F.lit("")).alias("s"))
    sample = hash_sample(sample, most_docs, "s", seed=seed)
    pattern = F.lit("(?<![A-Za-z0-9_-])([A-Za-z]{3,15})(?![A-Za-z0-9_-])")
    words = sample.select(F.explode(F.regexp_extract_all("s", pattern, F.lit(1))).alias("w"))
    words = words.distinct().orderBy(F.xxhash64("w"), "w").limit(most)
    # one window over at most `most` rows
    words = words.select("w", F.coalesce(F.lead("w").over(Window.orderBy(F.xxhash64("w"), "w")), F.col("w")).alias("v"))
    low, next_, cap, next_cap = F.lower("w"), F.lower("v"), F.initcap("w"), F.initcap("v")
    number = F.pmod(F.xxhash64(F.lit(seed), "w"), F.lit(1000)).cast("string")
    snake = F.concat_ws("_", low, next_)
    forms = F.array(
        F.col("w"), snake, F.upper(snake), F.concat_ws("-", low, next_), F.concat_ws("/", low, next_), F.concat(low, next_cap), F.concat(cap, next_cap),
        F.concat(low, next_, number), F.concat_ws("_", low, number, next_), F.concat_ws("-", next_, low, number),
    )
    return words.select(F.explode(forms).alias("text"), F.lit(False).alias("random"))


def apart(matches: Iterable[re.Match], found: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """Spans of matches that touch none of found, both in order of start: one pass over the two."""
    i, reach = 0, 0
    for m in matches:
        start, end = m.span()
        while i < len(found) and found[i][0] < end:
            reach = max(reach, found[i][1])
            i += 1
        if reach <= start:
            yield start, end


SPANS = ArrayType(
    StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
)


def scan_secrets(
    docs: DataFrame, model: MarkovModel, text_col: str = "text", keep: tuple[str, ...] | None = None, chunk_chars: int = 4_000_000
) -> DataFrame:
    """The columns keep of docs with base_spans and spans, array<struct<kind, start, end>>.

    base_spans holds what the fixed patterns find; spans also the strings of 20 or more key
    characters that the models call random and that touch no base span (kind 'random'). Both are
    in order of start, then kind as in ORDER; offsets are code points, ends exclusive.

    Null texts count as empty; an empty text has no spans; repeated rows are scanned alike. A column
    of docs named like an added one gives way. No shuffle: memory follows the longest text.
    """
    lean_batches(docs.sparkSession)
    source, keep, at = beside(docs, text_col, keep, ["base_spans", "spans"])
    schema = StructType([*source.schema.fields[: len(keep)], StructField("base_spans", SPANS), StructField("spans", SPANS)])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rank = {k: i for i, k in enumerate(ORDER)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at, chunk_chars):
                base, every = [], []
                for text in part.column(at).to_pylist():
                    text = text or ""
                    found = sorted(base_spans(text), key=lambda x: (x[0], rank[x[2]]))
                    more = [(a, b, "random") for a, b in apart(CANDIDATE.finditer(text), found) if model.is_random(text[a:b])]
                    base.append([{"kind": k, "start": a, "end": b} for a, b, k in found])
                    both = sorted(found + more, key=lambda x: (x[0], rank[x[2]]))
                    every.append([{"kind": k, "start": a, "end": b} for a, b, k in both])
                arrays = [*(part.column(i) for i in range(len(keep))), pa.array(base, kind), pa.array(every, kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return source.mapInArrow(run, schema)


def joined(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )

