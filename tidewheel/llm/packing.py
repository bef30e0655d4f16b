"""Mixture-controlled packing: deficit round-robin over source queues fills every window."""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, keep_between_tasks, lean_batches, quoted, release, shared_path
from .repetition import chunks
from .warc import delete_folder


_TAIL = ".,!?;:"
_MARK = "\x01"
#: Fixed values, as tokenizer files state them: what lower-cases, splits at white space and drops it,
#: and splits between a letter or digit and the punctuation after it.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


class TokenCache:
    """Token ids of texts, with the ids of each run of other than ASCII white space kept.

    That is exact for tokenizers whose own description is the one above; with any other, whole texts
    are encoded, and so are texts in which lower-casing would make one of the tokenizer's added
    tokens. At most `most` runs are kept; those that come when it is full are encoded anew each
    time, unless they get to be half of a batch.
    """

    def __init__(self, path: str, most: int = 500_000) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the task has one core
        from tokenizers import Tokenizer, normalizers

        self.tokenizer = Tokenizer.from_file(path)
        parts = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        self.by_run = [x and json.loads(x.__getstate__()) for x in parts] == [_NORMALIZER, _PRE_TOKENIZER]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        # what is printable ASCII in lower case is as the normalizer would leave it
        self.ready = Tokenizer.from_file(path)
        self.ready.normalizer = normalizers.Sequence([])
        mark = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.slots: dict[str, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.flat, self.used, self.n = np.zeros(1 << 18, self.dtype), 0, 0

    def _add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        total, n = len(ids), len(sizes)
        while self.n + n > len(self.starts):
            self.starts, self.sizes = np.concatenate([self.starts, self.starts]), np.concatenate([self.sizes, self.sizes])
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, self.flat])
        self.flat[self.used : self.used + total] = ids
        self.starts[self.n : self.n + n] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + n] = sizes
        self.used, self.n = self.used + total, self.n + n

    def _encode(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has. They are encoded as one text with a mark between
        them, the ids of which are told by the mark's; one by one if that isn't sure."""
        if self.mark is not None and not any(_MARK in w for w in words):
            ids = np.array(tokenizer.encode_batch_fast([f" {_MARK} ".join(words)], add_special_tokens=False)[0].ids, np.int64)
            between = np.flatnonzero(ids == self.mark)
            if len(between) == len(words) - 1:
                return np.delete(ids, between), np.diff(np.concatenate([[-1], between, [len(ids)]])) - 1
        lists = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes

    def _slots_of(self, words: list[str]) -> np.ndarray:
        """A slot for each word; those beyond self.most are valid until the next call."""
        self.n, self.used = len(self.slots), int(self.starts[len(self.slots) - 1] + self.sizes[len(self.slots) - 1]) if self.slots else 0
        known = self.slots
        out = list(map(known.get, words))
        at = [i for i, slot in enumerate(out) if slot is None]
        if len(known) >= self.most and 2 * len(at) > len(words):
            self.clear()
            known, at = self.slots, list(range(len(words)))
        new = [words[i] for i in at]
        # a stem and its punctuation are encoded apart; the stem is often known
        parts = {w: (stem, w[len(stem) :]) for w in new if (stem := w.rstrip(_TAIL)) != w and stem and stem[-1].isascii() and stem[-1].isalnum()}
        whole = dict.fromkeys(x for w in new for x in parts.get(w, (w,)) if x not in known)
        place = {}
        for tokenizer, some in ((self.ready, [w for w in whole if w.isascii() and w.isprintable()]), (self.tokenizer, [w for w in whole if not (w.isascii() and w.isprintable())])):
            place.update(zip(some, range(self.n, self.n + len(some)), strict=True))
            for i in range(0, len(some), 20_000):
                self._add(*self._encode(some[i : i + 20_000], tokenizer))
        slot = lambda w: place[w] if w in place else known[w]
        halves = np.fromiter((slot(x) for pair in parts.values() for x in pair), np.int64, 2 * len(parts))
        sizes = self.sizes[halves]
        at_ids = np.repeat(self.starts[halves] - np.cumsum(sizes) + sizes, sizes) + np.arange(int(sizes.sum()))
        place.update(zip(parts, range(self.n, self.n + len(parts)), strict=True))
        self._add(self.flat[at_ids], sizes[::2] + sizes[1::2])
        for i, w in zip(at, new, strict=True):
            out[i] = place[w]
        if len(known) < self.most:
            known.update(place)
        return np.array(out, np.int64)

    def encode(self, texts: pa.Array, end_id: int) -> pa.Array:
        """The ids of each text (null: empty) and then end_id, as little-endian integers of self.dtype."""
        texts = pc.fill_null(texts, "").cast(pa.string())
        whole = np.ones(len(texts), bool)
        if self.by_run:
            plain = pc.ascii_lower(texts)
            whole[:] = False
            runs, seen = self._by_run(plain, end_id)
            for token in self.added:
                if token in seen:
                    whole |= pc.not_equal(pc.count_substring(plain, token), pc.count_substring(texts, token)).to_numpy(zero_copy_only=False)
            if not whole.any():
                return runs
        lists = iter(self.tokenizer.encode_batch_fast(texts.filter(pa.array(whole)).to_pylist(), add_special_tokens=False))
        own = [np.array([*next(lists).ids, end_id], self.dtype).tobytes() if w else runs[i].as_py() for i, w in enumerate(whole)]
        return pa.array(own, pa.binary())

    def _by_run(self, plain: pa.Array, end_id: int) -> tuple[pa.Array, str]:
        """The ids of each text, and the different runs, with spaces between them."""
        lists = pc.ascii_split_whitespace(plain)
        words = lists.flatten().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        every = words.dictionary
        seen = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(every)], pa.int32()), every), " ")[0].as_py()
        slots = self._slots_of(seen.split(" ") if len(every) else [])
        end_slot = self.n
        self._add(np.array([end_id]), np.array([1]))
        behind = np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
        at = np.full(int(behind[-1]) if len(behind) else 0, end_slot, np.int64)
        of_word = np.ones(len(at), bool)
        of_word[behind - 1] = False
        if len(slots):
            at[of_word] = slots[words.indices.to_numpy(zero_copy_only=False)]
        # slots lie end to end: an array of byte strings, of which Arrow takes those wanted
        width = self.dtype.itemsize
        offsets = np.append(self.starts[: self.n], self.used) * width
        every = pa.Array.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(offsets), pa.py_buffer(self.flat)])
        taken = every.take(pa.array(at))
        bounds = np.frombuffer(taken.buffers()[1], np.int64)[np.insert(behind, 0, 0)] if len(behind) else np.zeros(1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(behind), [None, pa.py_buffer(bounds), taken.buffers()[2]]).cast(pa.binary()), seen


_CACHES: dict[str, TokenCache] = {}


def token_cache(path: str) -> TokenCache:
    """One cache per tokenizer for each worker process."""
    if path not in _CACHES:
        _CACHES[path] = TokenCache(path)
        keep_between_tasks("packing", _CACHES.clear)
    return _CACHES[path]


def tokenized(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str, source_col: str, chunk_chars: int = 8_000_000) -> DataFrame:
    """doc_id, source, n_tokens, ids, row (a number of its own): one row for each row of docs."""
    lean_batches(docs.sparkSession, 4_000)
    source = docs.select(
        F.col(quoted(id_col)).alias("doc_id"), F.col(quoted(source_col)).cast("string").alias("source"), F.col(quoted(text_col)).alias("text")
    )
    schema = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        cache = token_cache(path)
        width, row = cache.dtype.itemsize, TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in chunks(batch, 2, chunk_chars):
                ids = cache.encode(part.column(2), end_id)
                n = pc.divide(pc.binary_length(ids).cast(pa.int64()), width)
                rows = pa.array(np.arange(row, row + part.num_rows))
                row += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), n, ids, rows], names=["doc_id", "source", "n_tokens", "ids", "row"])
        release()

    return source.mapInArrow(run, f"doc_id {schema}, source string, n_tokens long, ids binary, row long")


@dataclass(frozen=True)
class Piece:
    source: str | None
    document: int
    start: int
    length: int
    window: int
    offset: int


def deficit_round_robin(
    queues: Mapping[str | None, Sequence[int]],
    shares: Mapping[str | None, float],
    window: int = 2048,
    quantum: int = 256,
    deficits: Mapping[str | None, float] | None = None,
) -> Iterator[Piece]:
    """Deal the documents of the queues (their lengths, in order) to windows.

    Each window credits its tokens to the sources that still have documents, by share. Then the
    source with the largest deficit gives a piece of its first document: as much as its deficit, a
    quantum at least, up to the document's and the window's end. What a source gave is taken off
    its deficit; what it is owed, or owes, goes on to the next window. deficits are those to start
    with, left by the lanes before. All windows but the last are full. Ties go by source, null last.
    """
    order = sorted((s for s in queues if len(queues[s])), key=lambda s: (s is None, s or ""))
    debt = {s: float((deficits or {}).get(s, 0.0)) for s in order}
    share = {s: max(float(shares.get(s, 0.0)), 1e-12) for s in order}
    place = {s: i for i, s in enumerate(order)}
    at = {s: [0, 0] for s in order}
    number = 0
    while order:
        total = sum(share[s] for s in order)
        for s in order:
            debt[s] += window * share[s] / total
        heap = [(-debt[s], place[s], s) for s in order]
        heapq.heapify(heap)
        filled = 0
        while filled < window and heap:
            owed, _, s = heap[0]
            document, start = at[s]
            length = min(queues[s][document] - start, window - filled, max(quantum, int(-owed)))
            yield Piece(s, document, start, length, number, filled)
            filled += length
            if start + length == queues[s][document]:
                at[s] = [document + 1, 0]
            else:
                at[s][1] = start + length
            debt[s] -= length
            if at[s][0] == len(queues[s]):
                heapq.heappop(heap)
                order.remove(s)
            else:
                heapq.heapreplace(heap, (-debt[s], place[s], s))
        number += 1


PIECE = "source string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    window: int = 2048,
    quantum: int = 256,
    lane_tokens: int = 4_000_000,
    shares: Mapping[str | None, float] | None = None,
    digests: bool = False,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> tuple[DataFrame, str]:
    """Pieces doc_id, PIECE of all documents, and the folder that holds the tokens until deleted.

    With digests, ids_crc32 (of ids as unsigned 32-bit little-endian integers) is in the place of ids.

    Rows are dealt to lanes of about lane_tokens tokens by a hash of a number that each has got with
    its tokens, whatever their source and however often they repeat; a lane is what one task holds. In a lane, deficit_round_robin() fills the windows. shares are the
    target proportions; without them, those of the sources among the lane's tokens, so that no
    queue runs dry before the others. A lane begins with what the lanes before it leave: for each
    source, its target among all their tokens less its own tokens there, a window's tokens at most.
    Sequences are windows; only the last one of a lane can be short. ids are little-endian, two
    bytes each for vocabularies up to 65,536.

    Null texts are empty: their only token is end_id. A null source is a source. Null ids and
    repeated rows are documents of their own. An empty table gives no pieces.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "tokens")
    tokenized(docs, tokenizer, end_id, id_col, text_col, source_col).write.option("compression", "zstd").parquet(folder)
    tokens = spark.read.parquet(folder)
    total = tokens.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    lanes = max(1, -(-total // lane_tokens))
    lane = F.pmod(F.xxhash64("row"), F.lit(lanes))
    sums = cut(tokens.groupBy(lane.alias("lane"), "source").agg(F.sum("n_tokens").alias("n")))
    deficits = _deficits(sums, shares)
    given = None if shares is None else dict(shares)
    doc_id = tokens.schema["doc_id"].dataType.simpleString()
    fields = pa.schema(
        [("source", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
         ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids_crc32", pa.int64()) if digests else ("ids", pa.binary())]
    )

    def fill(key: tuple, rows: pa.Table, owed: pa.Table) -> pa.Table:
        number = key[0].as_py()
        columns = {c: rows.column(c).to_pylist() for c in ("source", "n_tokens", "ids", "doc_id")}
        queues: dict[str | None, list[int]] = {}
        width = len(columns["ids"][0]) // columns["n_tokens"][0] if rows.num_rows else 2
        by_row = sorted(range(rows.num_rows), key=lambda i: (zlib.crc32(columns["ids"][i]), columns["ids"][i], str(columns["doc_id"][i])))
        for i in by_row:
            queues.setdefault(columns["source"][i], []).append(i)
        sizes = {s: [columns["n_tokens"][i] for i in q] for s, q in queues.items()}
        start = {s: max(-window, min(window, d)) for s, d in zip(owed.column("source").to_pylist(), owed.column("deficit").to_pylist(), strict=True)}
        share = given or {s: float(sum(n)) for s, n in sizes.items()}
        # four bytes for each id, for the checksums; a document at a time, as its pieces follow one another in a queue
        wide: dict[str | None, tuple[int, memoryview]] = {}
        out: list[list] = [[] for _ in range(8)]
        for p in deficit_round_robin(sizes, share, window, quantum, start):
            i = queues[p.source][p.document]
            if not digests:
                last = columns["ids"][i][p.start * width : (p.start + p.length) * width]
            else:
                if wide.get(p.source, (-1,))[0] != i:
                    wide[p.source] = i, memoryview(np.frombuffer(columns["ids"][i], f"<u{width}").astype("<u4")).cast("B")
                last = zlib.crc32(wide[p.source][1][4 * p.start : 4 * (p.start + p.length)])
            row = (i, p.source, p.start, p.length, columns["n_tokens"][i], number << 32 | p.window, p.offset, last)
            for column, value in zip(out, row, strict=True):
                column.append(value)
        arrays = [pa.array(c, f.type) for c, f in zip(out[1:], fields, strict=True)]
        return pa.Table.from_arrays([rows.column("doc_id").take(pa.array(out[0], pa.int64())), *arrays], names=["doc_id", *fields.names])

    laned = tokens.withColumn("lane", lane).drop("row")
    pieces = laned.groupBy("lane").cogroup(deficits.groupBy("lane")).applyInArrow(fill, f"doc_id {doc_id}, {PIECE.replace('ids binary', 'ids_crc32 long') if digests else PIECE}")
    return pieces, folder


def _deficits(sums: DataFrame, shares: Mapping[str | None, float] | None) -> DataFrame:
    """lane, source, deficit: what the source is owed by the lanes before, from sums(lane, source, n)."""
    whole = Window.partitionBy()
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    of_source = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = sums.groupBy("lane").agg(F.sum("n").alias("lane_n"))
    lanes = lanes.withColumn("all_before", F.coalesce(F.sum("lane_n").over(before), F.lit(0)))
    if shares is None:
        targets = sums.groupBy("source").agg(F.sum("n").alias("share"))
    else:
        rows = [(s, float(v)) for s, v in shares.items()]
        targets = sums.sparkSession.createDataFrame(rows, "source string, share double")
    targets = targets.withColumn("share", F.col("share") / F.sum("share").over(whole)).withColumnRenamed("source", "target_source")
    own = sums.withColumn("own_before", F.coalesce(F.sum("n").over(of_source), F.lit(0)))
    own = own.join(lanes, "lane").join(targets, F.col("source").eqNullSafe(F.col("target_source")), "left")
    deficit = F.coalesce(F.col("share"), F.lit(0.0)) * F.col("all_before") - F.col("own_before")
    return own.select("lane", "source", deficit.alias("deficit"))


def packed_digests(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """pack() with checksums in the place of ids, materialised; the tokens are deleted."""
    pieces, folder = pack(docs, tokenizer, digests=True, **options)
    try:
        return cut(pieces.drop("source"))
    finally:
        delete_folder(folder)


def sequences(pieces: DataFrame, window: int = 2048, pad_id: int = 0) -> DataFrame:
    """sequence_id, n_tokens, ids array<int>: the windows themselves, padded with pad_id to window,
    or not at all if their length is a power of two. Two-byte ids."""

    def join(key: tuple, rows: pa.Table) -> pa.Table:
        own = sorted(zip(rows.column("offset").to_pylist(), rows.column("ids").to_pylist(), strict=True))
        ids = np.frombuffer(b"".join(x for _, x in own), "<u2").astype(np.int32)
        n = len(ids)
        size = n if n & (n - 1) == 0 else window
        ids = np.concatenate([ids, np.full(size - n, pad_id, np.int32)])
        return pa.table({"sequence_id": [key[0].as_py()], "n_tokens": [n], "ids": pa.array([ids], pa.list_(pa.int32()))})

    return pieces.groupBy("sequence_id").applyInArrow(join, "sequence_id long, n_tokens long, ids array<int>")
