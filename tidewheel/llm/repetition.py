"""Quality rules on repetition: suffix arrays over words, maximal repeats, limits on what they cover."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from .common import beside, lean_batches, make_room, release

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class RepetitionLimits:
    """A text is kept if it passes the base rules and both limits on maximal repeats.

    Repeats of min_repeat words or more count. Together they may cover at most max_covered of the
    words, and the longest may be at most max_longest of the words long. Both are to bite below the
    base rule, which rejects what repeats of three words or more cover by over a half: max_covered
    on disjoint copies, max_longest on runs that repeat in themselves.
    """

    min_words: int = 50
    max_repeat_words_percent: int = 50
    min_repeat: int = 10
    max_covered: float = 0.45
    max_longest: float = 0.25


def longest_repeats(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each word of the texts that lie end to end in words (sizes: words of each text), how
    many words from there on are found at another place of the same text: the depth of the
    innermost LCP interval that holds the suffix which begins there.

    The suffix array is made by prefix doubling on all texts at once; ranks never compare beyond a
    text, and suffixes whose rank is already unique take no further part. What two neighbours that
    part share beyond what the doubling tells is the least common prefix between the ranks of what
    follows in them, which have parted before. Memory: a few arrays of the length of words.
    """
    n = len(words)
    kind = np.int32 if n < 1 << 31 else np.int64
    if n == 0:
        return np.zeros(0, kind)
    end = np.repeat(np.cumsum(sizes), sizes).astype(kind)
    key = np.repeat(np.arange(len(sizes)), sizes) * (int(words.max()) + 1) + words
    order = np.argsort(key, kind="stable")
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(key[order[1:]], key[order[:-1]], out=new[1:])
    del key
    order = order.astype(kind)
    rank = np.empty(n, kind)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=kind), 0))
    unknown = np.iinfo(kind).max
    lcp = np.append(np.where(new, 0, unknown), 0).astype(kind)  # lcp[k]: of the suffixes of ranks k - 1 and k
    active = order[~(new & np.append(new[1:], True))]  # suffixes of not yet unique rank, in the order of their ranks
    del order, new
    h = 1
    while len(active):
        ahead = active.astype(np.int64) + h
        second = np.where(ahead < end[active], rank[np.minimum(ahead, n - 1)].astype(np.int64) + 1, 0)
        by = np.argsort(rank[active].astype(np.int64) * (n + 1) + second, kind="stable")
        active, second = active[by], second[by]
        old = rank[active]
        group = np.empty(len(active), bool)
        group[0] = True
        np.not_equal(old[1:], old[:-1], out=group[1:])
        split = group.copy()
        split[1:] |= second[1:] != second[:-1]
        index = np.arange(len(active), dtype=kind)
        offset = index - np.maximum.accumulate(np.where(group, index, 0))
        fresh = old + np.maximum.accumulate(np.where(split, index, 0)) - (index - offset)
        apart = np.flatnonzero(split & ~group)  # neighbours that part here share h words, but not 2 h
        low, high = second[apart - 1], second[apart] - 1  # ranks of what follows: one before the first that counts, the last
        common = np.full(len(apart), h, kind)
        both = np.flatnonzero(low > 0)  # the left one ends after h words, else
        common[both] += least_between(lcp, low[both], high[both] + 1)
        lcp[fresh[apart]] = common
        rank[active] = fresh
        active = active[~(split & np.append(split[1:], True))]
        h *= 2
    return np.maximum(lcp[rank], lcp[rank + 1])


def least_between(values: np.ndarray, begins: np.ndarray, ends: np.ndarray, block: int = 64) -> np.ndarray:
    """The least of values[begin:end] for each begin < end: by whole blocks, and one by one at both sides."""
    if not len(begins):
        return np.zeros(0, values.dtype)
    table = [np.minimum.reduceat(values, np.arange(0, len(values), block))]  # of 1, 2, 4, ... blocks
    while len(table[-1]) > 1 << (len(table) - 1):
        step = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-step], table[-1][step:]))
    first, last = -(-begins // block), ends // block  # whole blocks
    some = first < last
    out = np.full(len(begins), np.iinfo(values.dtype).max, values.dtype)
    level = np.frexp(np.maximum(last - first, 1).astype(np.float64))[1] - 1
    for k in np.unique(level[some]).tolist():
        own = np.flatnonzero(some & (level == k))
        out[own] = np.minimum(table[k][first[own]], table[k][last[own] - (1 << k)])
    for x, y in ((begins, np.where(some, first * block, ends)), (np.where(some, last * block, ends), ends)):
        own = np.flatnonzero(x < y)
        if len(own):
            # reduceat takes pairs of bounds: every other result is of a range. In order, the gaps
            # between ranges, which it reads as well, add up to one pass; an end needs one value more
            own = own[np.argsort(x[own], kind="stable")]
            padded = np.append(values, values[-1])
            bounds = np.stack([x[own], y[own]], 1).reshape(-1)
            out[own] = np.minimum(out[own], np.minimum.reduceat(padded, bounds)[::2])
    return out


def covered(longest: np.ndarray, sizes: np.ndarray, least: int) -> np.ndarray:
    """Words of each text that lie in a repeat of at least so many words, each counted once."""
    n = len(longest)
    begins = np.flatnonzero(longest >= least)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + longest[begins], -1)
    inside = np.concatenate([[0], np.cumsum(np.cumsum(change[:n]) > 0)])
    ends = np.cumsum(sizes)
    return inside[ends] - inside[ends - sizes]


def maximal_repeats(words: list, least: int) -> list[tuple[int, int]]:
    """(start, length) of the repeats in one text that no repeat at the word before contains."""
    ids: dict = defaultdict(count().__next__)
    longest = longest_repeats(np.array([ids[w] for w in words], np.int64), np.array([len(words)]))
    return [
        (i, int(m)) for i, m in enumerate(longest) if m >= least and not (i and longest[i - 1] == m + 1)
    ]


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_covered_words long, longest_repeat long, base_failed boolean, kept boolean"
)


def measure(texts: Iterable[str | None], limits: RepetitionLimits) -> dict[str, list]:
    """The columns of SCHEMA for these texts."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    words, sizes, chars, symbols, lines = [], [], [], [], []
    for text in texts:
        raw = (text or "").encode()
        own = raw.split()
        sizes.append(len(own))
        words.extend(map(ids.__getitem__, own))
        chars.append(len(raw.translate(None, WHITE).decode()))
        symbols.append(len(raw) - len(raw.translate(None, SYMBOLS)))
        full = [x for x in raw.split(b"\n") if x.strip(WHITE)]
        lines.append(len(full) - len(set(full)))
    n = np.array(sizes, np.int64)
    longest = longest_repeats(np.array(words, np.int64), n)
    repeat_words = covered(longest, n, 3)
    spans = covered(longest, n, limits.min_repeat)
    top = np.zeros(len(n), np.int64)
    np.maximum.at(top, np.repeat(np.arange(len(n)), n), longest)
    top[top < limits.min_repeat] = 0
    failed = (n < limits.min_words) | (100 * repeat_words > limits.max_repeat_words_percent * n)
    kept = ~failed & (spans <= limits.max_covered * n) & (top <= limits.max_longest * n)
    return {
        "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": lines, "n_repeat_words": repeat_words,
        "n_covered_words": spans, "longest_repeat": top, "base_failed": failed, "kept": kept,
    }


def quality_rules(
    docs: DataFrame,
    text_col: str = "text",
    keep: tuple[str, ...] | None = None,
    limits: RepetitionLimits | None = None,
    prefix: str = "",
    chunk_chars: int = 2_000_000,
) -> DataFrame:
    """The columns keep of docs (default: all) with those of SCHEMA, prefix before their names.

    Words are runs of other than ASCII white space. A row is one text: no shuffle, and texts are
    measured in chunks of about chunk_chars, so that memory follows the longest text only.

    Null and empty texts have no words and fail the base rules. Repeated rows are judged alike. A
    column of docs with the name of an added one gives way to it. An empty table gives no rows.
    """
    limits = limits or RepetitionLimits()
    lean_batches(docs.sparkSession)
    fields = [StructField(prefix + f.name, f.dataType) for f in _parse_datatype_string(SCHEMA).fields]
    source, keep, at = beside(docs, text_col, keep, [f.name for f in fields])
    schema = StructType([*source.schema.fields[: len(keep)], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make_room("repetition")
        for batch in batches:
            for part in chunks(batch, at, chunk_chars):
                got = measure(part.column(at).to_pylist(), limits)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(v, pa.bool_() if k in ("base_failed", "kept") else pa.int64()) for k, v in got.items()]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        release()

    return source.mapInArrow(run, schema)


def chunks(batch: pa.RecordBatch, column: int, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of batch whose texts have about so many bytes, one row at least."""
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(lengths):
        if total and total + size > most:
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    if begin < batch.num_rows:
        yield batch.slice(begin)
