"""Language-model scoring with an n-gram trie in Elias-Fano form.

Levels: words (hashes; a word's id is its rank), word pairs, word triples. A level holds, for each
node of the level above, where its successors begin (a monotone sequence), the successors (made
monotone by adding what came before), and a byte each for the smoothed probability and, for nodes
with successors, the weight of backing off. In the third level a word isn't stored by id, but by its
rank among the successors of the word before it, which the second level finds first.

Each level is cut into files of about the same number of tokens, anywhere in the order of its keys:
the successors of a frequent word or pair are spread over as many files as they need. Files are
mapped, not loaded.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import beside, lean_batches, quoted, release, shared_path
from .elias_fano import U64, EliasFano, groups, map_arrays, write_arrays
from .repetition import chunks
from .warc import delete_folder

#: Codes: a byte is log10 in steps of 1 / SCALE, from 0 down.
SCALE = 25.0
#: Bits of the second half of a level's keys: a word's id, a rank among successors.
BITS = {"pairs": 32, "triples": 26}
#: Odd 64-bit constants that mix the bytes of a word.
_MIX = [U64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]
_LONG = 1024


def hash_words(words: pa.Array) -> np.ndarray:
    """64-bit hashes of an array of strings without nulls: eight bytes of all words at a time. Words
    of over _LONG bytes are digested one by one."""
    n = len(words)
    _, offsets, data = words.buffers()
    bounds = np.frombuffer(offsets, np.int32)[words.offset : words.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    size = np.diff(bounds)
    raw = np.zeros(int(bounds[-1] - bounds[0]) + 8, np.uint8)
    if n and len(raw) > 8:
        raw[:-8] = np.frombuffer(data, np.uint8, len(raw) - 8, int(bounds[0]))
    at_byte = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    by = np.argsort(-size, kind="stable")
    begin, left = (bounds[:-1] - bounds[0])[by], size[by]
    state = left.astype(U64) * _MIX[0] + U64(1)
    first, last, done = int(np.searchsorted(-left, -_LONG, "left")), n, 0
    with np.errstate(over="ignore"):
        while (last := int(np.searchsorted(-left[:last], -done, "left"))) > first:
            some = slice(first, last)
            block, rest = at_byte[begin[some] + done], left[some] - done
            short = rest < 8
            block = np.where(short, block & ((U64(1) << np.where(short, 8 * rest, 0).astype(U64)) - U64(1)), block)
            x = (state[some] ^ block) * _MIX[1]
            x ^= x >> U64(32)
            state[some] = x * _MIX[2] ^ (x >> U64(29))
            done += 8
        state[:first] = [xxhash.xxh3_64_intdigest(raw[x : x + k].data) for x, k in zip(begin[:first].tolist(), left[:first].tolist(), strict=True)]
        state ^= state >> U64(31)
        state *= _MIX[3]
        state ^= state >> U64(32)
    out = np.empty(n, U64)
    out[by] = state
    return out


#: A word can't hold a space, so this hash is the end's alone.
END = int(hash_words(pa.array([" "]))[0])


def code(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-SCALE * log10), 0, 255).astype(np.uint8)


@dataclass(frozen=True)
class Settings:
    """discount is taken off each pair's and triple's count; those seen less often than min_count
    (1: none) are left to the level below, and their share with them. A file of a level holds what
    about shard_bytes of text have; a worker maps, or holds, at most most_mapped or most_held bytes."""

    discount: float = 0.75
    min_count: int = 1
    part_bytes: int = 16 << 20
    shard_bytes: int = 24 << 20
    chunk_chars: int = 8 << 20
    most_mapped: int = 64 << 30
    most_held: int = 256 << 20


@dataclass(frozen=True)
class LanguageModel:
    """Where a model's files are, and its figures. What grows with the model is in its directory, a
    file: a new one (stage) as each level gets ready."""

    folder: str
    shards: int
    stage: int
    words: int
    train_tokens: int
    settings: Settings

    def delete(self) -> None:
        delete_folder(self.folder)


def _range_of(values: np.ndarray, ranges: int) -> np.ndarray:
    """Which of equal ranges of the 64-bit numbers."""
    return (((values >> U64(32)) * U64(ranges)) >> U64(32)).astype(np.int64)


def _mixed(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = values * _MIX[0]
        return (x ^ (x >> U64(29))) * _MIX[1]


def _tally(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sum of counts (1 each) of each."""
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    by = np.argsort(keys, kind="stable") if counts is not None else None
    keys = np.sort(keys) if by is None else keys[by]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    if by is None:
        return keys[first], np.diff(np.append(first, len(keys)))
    return keys[first], np.add.reduceat(counts[by], first)


class Text:
    """Texts as one array of local word numbers, which ascend with the words' hashes (and so with their
    ids), each text closed by the end."""

    def __init__(self, texts: pa.Array) -> None:
        plain = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts, "").cast(pa.string())))
        lists = pc.ascii_split_whitespace(plain)
        words = lists.flatten().dictionary_encode()
        hashes = np.append(U64(END), hash_words(words.dictionary))
        by = np.argsort(hashes)
        self.hashes, number = hashes[by], np.empty(len(by), np.int64)
        number[by] = np.arange(len(by))
        local = number[1:][words.indices.to_numpy(zero_copy_only=False)]
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        none = pc.equal(pc.binary_length(plain), 0).to_numpy(zero_copy_only=False)
        if none.any():  # such a text is split into one empty word
            local = np.delete(local, (np.cumsum(sizes) - sizes)[none])
            sizes[none] = 0
        self.sizes = sizes + 1
        self.tokens = np.full(len(local) + len(sizes), number[0])
        real = np.ones(len(self.tokens), bool)
        real[np.cumsum(self.sizes) - 1] = False
        self.tokens[real] = local
        self.text = np.repeat(np.arange(len(sizes)), self.sizes)


def _split(of: np.ndarray) -> Iterator[tuple[int, slice | np.ndarray]]:
    """Each different number of an array, and where it stands: a slice if the array is in order."""
    if not len(of):
        return
    by = None
    if (of[1:] < of[:-1]).any():
        by = np.argsort(_narrow(of), kind="stable")
        of = of[by]
    first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist()
    for a, b in zip(first, [*first[1:], len(of)], strict=True):
        yield int(of[a]), slice(a, b) if by is None else by[a:b]


def _distinct(first: np.ndarray, second: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ones, in order, of pairs of numbers below limit, and which of them each pair is."""
    n, bits = len(first), U64(limit.bit_length())
    keys, places = first.astype(U64) << bits | second.astype(U64), U64(n.bit_length())
    if 2 * bits + places <= 64:  # a sort of numbers is faster than one of their places
        keys = np.sort(keys << places | np.arange(n, dtype=U64))
        by = (keys & ((U64(1) << places) - U64(1))).astype(np.int64)
        keys >>= places
    else:
        by = np.argsort(keys, kind="stable")
        keys = keys[by]
    own, group = groups(keys)
    which = np.empty(n, np.int64)
    which[by] = group
    return (own >> bits).astype(np.int64), (own & ((U64(1) << bits) - U64(1))).astype(np.int64), which


class Reader:
    """A model's files as this worker process has mapped them, the least recently used ones closed."""

    _open: dict[tuple, Reader] = {}

    def __init__(self, model: LanguageModel) -> None:
        self.model = model
        self.files: OrderedDict[str, tuple[dict[str, np.ndarray], int, bool]] = OrderedDict()
        self.sequences: dict[str, dict[str, EliasFano]] = {}
        self.held = {True: 0, False: 0}
        self.most = {True: model.settings.most_mapped, False: model.settings.most_held}
        self.directory = map_arrays(f"{model.folder}/directory-{model.stage}")[0]

    @classmethod
    def of(cls, model: LanguageModel) -> Reader:
        """One reader for each worker; another model's is closed."""
        key = (model.folder, model.stage)
        if key not in cls._open:
            cls._open.clear()
            cls._open[key] = cls(model)
        return cls._open[key]

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        if name in self.files:
            self.files.move_to_end(name)
            return self.files[name][0]
        arrays, size, mapped = map_arrays(f"{self.model.folder}/{name}")
        self.held[mapped] += size
        while self.held[mapped] > self.most[mapped] and (old := next((k for k, v in self.files.items() if v[2] == mapped), None)):
            self.held[mapped] -= self.files.pop(old)[1]
            self.sequences.pop(old, None)
        self.files[name] = arrays, size, mapped
        return arrays

    def sequence(self, name: str, part: str) -> EliasFano:
        arrays, known = self.arrays(name), self.sequences.setdefault(name, {})
        if part not in known:
            known[part] = EliasFano.read(arrays, part)
        return known[part]

    # words

    def _by_part(self, name: str, ids: np.ndarray) -> np.ndarray:
        out, base = np.zeros(len(ids), np.int64), self.directory["words.base"]
        known = np.flatnonzero(ids >= 0)
        ids = ids[known]
        for p, own in _split(np.searchsorted(base, ids, "right") - 1):
            out[known[own]] = self.arrays(f"words-{p:05d}")[name][ids[own] - base[p]]
        return out

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words by hash, -1 for unknown ones."""
        out = np.full(len(hashes), -1, np.int64)
        for p, own in _split(_range_of(hashes, self.model.shards)):
            at = self.sequence(f"words-{p:05d}", "hash").find(hashes[own])
            out[own] = np.where(at >= 0, at + self.directory["words.base"][p], -1)
        return out

    def word_counts(self, ids: np.ndarray) -> np.ndarray:
        return self._by_part("count", ids)

    def word_log10(self, ids: np.ndarray) -> np.ndarray:
        n = self.model.train_tokens + 0.5 * (self.model.words + 1)
        return np.log10((self.word_counts(ids) + 0.5) / n)

    def word_at(self, token: int) -> tuple[int, int, int]:
        """With the training tokens in the order of their words: the word of this one, the number of
        tokens before that word, and its own."""
        base = self.directory["words.tokens"]
        p = int(np.searchsorted(base, token, "right")) - 1
        before = self.arrays(f"words-{p:05d}")["before"]
        k = int(np.searchsorted(before, token - base[p], "right")) - 1
        return k + int(self.directory["words.base"][p]), int(before[k]) + int(base[p]), int(self.arrays(f"words-{p:05d}")["count"][k])

    # pairs and triples: keys are parent << BITS | value

    def shard_of(self, level: str, keys: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.directory[f"{level}.cuts"], keys.astype(U64), "right")

    def parents(self, level: str, shard: int) -> tuple[int, int]:
        """The first parent and one behind the last whose successors can be in this file."""
        cuts, bits = self.directory[f"{level}.cuts"], U64(BITS[level])
        every = self.model.words if level == "pairs" else int(self.directory["pairs.base"][-1])
        last = int(cuts[shard] >> bits) + 1 if shard < len(cuts) else every
        return int(cuts[shard - 1] >> bits) if shard else 0, last

    def find(self, level: str, parents: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Nodes of these keys (parents in order), -1 where there are none."""
        out = np.full(len(parents), -1, np.int64)
        some = np.flatnonzero((parents >= 0) & (values >= 0))
        parents, values = parents[some], values[some]
        for s, own in _split(self.shard_of(level, parents.astype(U64) << U64(BITS[level]) | values.astype(U64))):
            at = self._children(f"{level}-{s:05d}", parents[own] - self.parents(level, s)[0], values[own])
            out[some[own]] = np.where(at >= 0, at + self.directory[f"{level}.base"][s], -1)
        return out

    def _children(self, name: str, parents: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Where in the file the successor values of these parents stand, or -1. Parents in order."""
        own, inverse = groups(parents)
        pointers, successors = self.sequence(name, "pointer"), self.sequence(name, "successor")
        begin, end = pointers[own].astype(np.int64), pointers[own + 1].astype(np.int64)
        base = np.zeros(len(own), np.int64)
        later = (begin > 0) & (end > begin)
        base[later] = successors[begin[later] - 1].astype(np.int64) + 1
        at = np.full(len(values), -1, np.int64)
        some = np.flatnonzero((end > begin)[inverse])
        place = successors.find((base[inverse[some]] + values[some]).astype(U64))
        ok = (place >= begin[inverse[some]]) & (place < end[inverse[some]])
        at[some] = np.where(ok, place, -1)
        return at

    def _of_parents(self, level: str, name: str, parents: np.ndarray, inside: Callable) -> np.ndarray:
        """A figure of parents: those at a cut have theirs in the directory, the others inside(file,
        its first parent, its first node, parents) of their only file."""
        out = np.zeros(len(parents), np.int64)
        edge = self.directory[f"{level}.edge"]
        at = np.searchsorted(edge, parents)
        cut_here = at < len(edge)
        cut_here[cut_here] = edge[at[cut_here]] == parents[cut_here]
        out[cut_here] = self.directory[f"{level}.edge_{name}"][at[cut_here]]
        rest = np.flatnonzero(~cut_here)
        parents = parents[rest]
        for s, own in _split(self.shard_of(level, parents.astype(U64) << U64(BITS[level]))):
            out[rest[own]] = inside(f"{level}-{s:05d}", self.parents(level, s)[0], int(self.directory[f"{level}.base"][s]), parents[own])
        return out

    def begin(self, level: str, parents: np.ndarray) -> np.ndarray:
        """The node of each parent's first successor."""
        return self._of_parents(level, "begin", parents, lambda f, p, n, own: self.sequence(f, "pointer")[own - p].astype(np.int64) + n)

    def degree(self, level: str, parents: np.ndarray) -> np.ndarray:
        """How many successors each parent has."""
        inside = lambda f, p, n, own: (self.sequence(f, "pointer")[own - p + 1] - self.sequence(f, "pointer")[own - p]).astype(np.int64)
        return self._of_parents(level, "degree", parents, inside)

    def weight(self, level: str, parents: np.ndarray) -> np.ndarray:
        """Codes of the parents' weights of backing off."""
        return self._of_parents(level, "weight", parents, lambda f, p, n, own: self.arrays(f"codes-{f}")["weight"][own - p])

    def by_node(self, level: str, file: str, name: str, nodes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(nodes), np.int64)
        base = self.directory[f"{level}.base"]
        for s, own in _split(np.searchsorted(base, nodes, "right") - 1):
            out[own] = self.arrays(f"{file}-{level}-{s:05d}")[name][nodes[own] - base[s]]
        return out

    def values(self, level: str, nodes: np.ndarray) -> np.ndarray:
        """The second halves of the nodes' keys."""
        out = np.zeros(len(nodes), np.int64)
        base = self.directory[f"{level}.base"]
        for s, own in _split(np.searchsorted(base, nodes, "right") - 1):
            local = nodes[own] - base[s]
            successors = self.sequence(f"{level}-{s:05d}", "successor")
            if 4 * len(local) > successors.n:
                successors = successors.decode()
            begin = self.arrays(f"counts-{level}-{s:05d}")["begin"][local].astype(np.int64)
            before = np.where(begin > 0, successors[np.maximum(begin - 1, 0)].astype(np.int64) + 1, 0)
            out[own] = successors[local].astype(np.int64) - before
        return out

    def pairs(self, text: Text, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The different pairs of neighbours in text.tokens (as two arrays of local word numbers), which
        of them ends at each token but the first, and their nodes, in order. An end and the next text's
        first token are a pair, too, which is no node, as nothing follows an end in a text."""
        first, second, which = _distinct(text.tokens[:-1], text.tokens[1:], len(ids))
        return first, second, which, self.find("pairs", ids[first], ids[second])

    def ranks(self, nodes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Ranks of pair nodes among the successors of their first words; -1 for none."""
        out = np.full(len(nodes), -1, np.int64)
        hit = np.flatnonzero(nodes >= 0)
        words, inverse = groups(first[hit])
        out[hit] = nodes[hit] - self.begin("pairs", words)[inverse]
        return out

    def score(self, text: Text) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: tokens known, base score, score (log10)."""
        ids = self.word_ids(text.hashes)
        known = (self.word_counts(ids) > 0).astype(np.int64)
        alone = self.word_log10(ids)
        local, n = text.tokens, len(text.sizes)
        base = alone[local]
        log = base.copy()
        if self.model.words:
            first, second, which, node = self.pairs(text, ids)
            hit = node >= 0
            back = np.zeros(len(ids))
            back[ids >= 0] = self.weight("pairs", ids[ids >= 0]) / -SCALE
            value = back[first] + alone[second]
            value[hit] = self.by_node("pairs", "codes", "probability", node[hit]) / -SCALE
            log[1:] = value[which]
            # a third word: where two tokens come before, and they are a node
            weight = np.zeros(len(node))
            weight[hit] = self.weight("triples", node[hit]) / -SCALE
            log[2:] += weight[which[:-1]]
            third = np.flatnonzero(hit[which[:-1]] & hit[which[1:]]) + 2
            before, last, inverse = _distinct(which[third - 2], which[third - 1], len(node))
            found = self.find("triples", node[before], self.ranks(node, ids[first])[last])
            hit = found >= 0
            value = np.zeros(len(found))
            value[hit] = self.by_node("triples", "codes", "probability", found[hit]) / -SCALE
            seen = np.flatnonzero(hit[inverse])
            log[third[seen]] = value[inverse[seen]]
            begin = np.cumsum(text.sizes) - text.sizes
            log[begin] = base[begin]
        add = lambda x: np.bincount(text.text, x, n)
        return add(known[local]).astype(np.int64), add(base), add(log)


# --- training --------------------------------------------------------------------------------

BLOCK = "part long, keys binary, counts binary"
_BLOCK = pa.schema([("part", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def pack_ascending(keys: np.ndarray) -> bytes:
    """Keys in order as their differences, the highest bytes of all first: most of those are zeros,
    which compression takes away."""
    return np.diff(keys, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T[::-1].tobytes()


def unpack_ascending(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(raw, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes[::-1].T).view("<u8").reshape(-1), dtype=U64)


def _blocks(keys: np.ndarray, counts: np.ndarray, part: np.ndarray) -> pa.RecordBatch | None:
    """Rows of BLOCK: keys in order and counts (bytes; a key comes again for what is over 255) by part."""
    if not len(keys):
        return None
    again = (counts + 254) // 255
    if (again > 1).any():
        last = np.cumsum(again) - 1
        at = np.repeat(np.arange(len(keys)), again)
        rest = np.full(len(at), 255, np.int64)
        rest[last] = counts - 255 * (again - 1)
        keys, part, counts = keys[at], part[at], rest
    by = np.argsort(part, kind="stable")
    found, start = np.unique(part[by], return_index=True)
    ends = [*start[1:], len(by)]
    small = counts.astype(np.uint8)
    columns = [found.tolist(), [pack_ascending(keys[by[a:b]]) for a, b in zip(start, ends, strict=True)], [small[by[a:b]].tobytes() for a, b in zip(start, ends, strict=True)]]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOCK, strict=True)], schema=_BLOCK)


def _sum_blocks(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys = np.concatenate([np.zeros(0, U64), *map(unpack_ascending, table.column("keys").to_pylist())])
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint8).astype(np.int64)
    return _tally(keys, counts)


def _narrow(values: np.ndarray) -> np.ndarray:
    """Whole numbers in as few bytes as the greatest needs."""
    return values.astype(np.min_scalar_type(int(values.max())) if len(values) else np.uint8)


def _mark() -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.stageId()}-{context.taskAttemptId()}"


def _counted(texts: DataFrame, settings: Settings, keys_of, part_of, most_keys: int = 1 << 21) -> DataFrame:
    """BLOCKs of what keys_of(texts) gives, summed up within a task as far as memory should go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for part in chunks(batch, 0, settings.chunk_chars):
                held.append(_tally(keys_of(part.column(0))))
                size += len(held[-1][0])
                if size >= most_keys:
                    if (out := flush(held)) is not None:
                        yield out
                    held, size = [], 0
        if held and (out := flush(held)) is not None:
            yield out
        release()

    def flush(held: list) -> pa.RecordBatch | None:
        keys, counts = held[0] if len(held) == 1 else _tally(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))
        return _blocks(keys, counts, part_of(keys))

    return texts.mapInArrow(run, BLOCK)


def fit(train: DataFrame, text_col: str = "text", settings: Settings | None = None) -> LanguageModel:
    """Train on all of train's texts (null: empty). The files are in the shared folder, see delete().

    Three passes: words, pairs, triples. Each task counts what its texts hold and sends the counts
    to the file they belong to, where they are added up (with min_count over 1, to parts by hash
    before, which drop what is too rare). The cuts between files are made as if a word were followed
    by each other one in proportion to that one's share, so that files get about the same number of
    tokens whatever words are frequent. Pairs and triples are smoothed by interpolated absolute
    discounting over the level below, down to words, smoothed by adding one half. The driver sees
    one row of figures for each file. Word ids have 32 bits, ranks of successors 26: beyond 2**32
    different words, or 2**26 different ones after one word, a ValueError. An empty table gives a
    model without words.
    """
    settings = settings or Settings()
    spark = train.sparkSession
    lean_batches(spark)
    texts = train.select(F.col(quoted(text_col)).alias("text"))
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // settings.part_bytes))
    shards = max(1, -(-size // settings.shard_bytes))
    folder = shared_path(spark, "ngrams")

    def words_of(some: pa.Array) -> np.ndarray:
        text = Text(some)
        return text.hashes[text.tokens]

    def write_words(key: tuple, table: pa.Table) -> pa.Table:
        keys, counts = _sum_blocks(table)
        part = key[0].as_py()
        arrays = EliasFano.of(keys).arrays("hash") | {"count": _narrow(counts), "before": _narrow(np.cumsum(counts) - counts)}
        write_arrays(f"{folder}/words-{part:05d}", arrays, _mark())
        return pa.table({"file": [part], "n": [len(keys)], "tokens": [int(counts.sum())]})

    words = _by_file(_counted(texts, settings, words_of, lambda k: _range_of(k, shards)), spark, shards)
    rows = sorted(words.applyInArrow(write_words, "file long, n long, tokens long").collect())
    directory = {"words.base": _sums([r["n"] for r in rows]), "words.tokens": _sums([r["tokens"] for r in rows])}
    model = LanguageModel(folder, shards, 0, int(directory["words.base"][-1]), int(directory["words.tokens"][-1]), settings)
    model = _next(model, directory, {})
    if model.words >= 1 << BITS["pairs"]:
        raise ValueError("more words than ids can tell apart")
    if not model.words:
        return model

    def pairs_of(some: pa.Array, model: LanguageModel = model) -> np.ndarray:
        text = Text(some)
        ids = Reader.of(model).word_ids(text.hashes)[text.tokens].astype(U64)
        same = text.text[1:] == text.text[:-1]
        return (ids[:-1][same] << U64(BITS["pairs"])) | ids[1:][same]

    def pair_cut(reader: Reader, token: int) -> int:
        word, before, own = reader.word_at(token)
        return word << BITS["pairs"] | reader.word_at((token - before) * reader.model.train_tokens // own)[0]

    def pair_totals(reader: Reader, parents: np.ndarray) -> np.ndarray:
        return reader.word_counts(parents)

    def pair_below(reader: Reader, parents: np.ndarray, values: np.ndarray) -> np.ndarray:
        own, inverse = np.unique(values, return_inverse=True)
        return (10 ** reader.word_log10(own))[inverse]

    model = _level(texts, model, directory, "pairs", parts, pairs_of, pair_cut, model.train_tokens, pair_totals, pair_below)

    def triples_of(some: pa.Array, model: LanguageModel = model) -> np.ndarray:
        text, reader = Text(some), Reader.of(model)
        ids = reader.word_ids(text.hashes)
        first, _, which, node = reader.pairs(text, ids)
        rank = reader.ranks(node, ids[first])
        before, last = which[:-1], which[1:]
        both = (node >= 0)[before] & (node >= 0)[last]
        before, last = node[before[both]], rank[last[both]]
        if len(last) and last.max() >= 1 << BITS["triples"]:
            raise ValueError("more successors than ranks can tell apart")
        return (before << BITS["triples"] | last).astype(U64)

    def triple_cut(reader: Reader, token: int) -> int:
        base = reader.directory["pairs.tokens"]
        s = int(np.searchsorted(base, token, "right")) - 1
        behind = np.cumsum(reader.arrays(f"counts-pairs-{s:05d}")["count"], dtype=np.int64)
        k = int(np.searchsorted(behind, token - base[s], "right"))
        own = int(reader.arrays(f"counts-pairs-{s:05d}")["count"][k])
        node = k + int(reader.directory["pairs.base"][s])
        after = int(reader.degree("pairs", reader.values("pairs", np.array([node])))[0])
        return node << BITS["triples"] | (token - int(base[s] + behind[k]) + own) * after // own

    def triple_totals(reader: Reader, parents: np.ndarray) -> np.ndarray:
        return reader.by_node("pairs", "counts", "count", parents)

    def triple_below(reader: Reader, parents: np.ndarray, values: np.ndarray) -> np.ndarray:
        own, inverse = groups(parents)
        middle = reader.values("pairs", own)
        words, of_word = np.unique(middle, return_inverse=True)
        lower = reader.begin("pairs", words)[of_word][inverse] + values
        return 10 ** (reader.by_node("pairs", "codes", "probability", lower) / -SCALE)

    return _level(texts, model, directory, "triples", parts, triples_of, triple_cut, int(directory["pairs.tokens"][-1]), triple_totals, triple_below)


def _sums(numbers: list[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.array(numbers, np.int64))])


def _next(model: LanguageModel, directory: dict[str, np.ndarray], more: dict[str, np.ndarray]) -> LanguageModel:
    """The model with more in its directory."""
    directory |= more
    model = replace(model, stage=model.stage + 1)
    write_arrays(f"{model.folder}/directory-{model.stage}", directory, "driver")
    return model


def _for_each_file(spark: SparkSession, files: int, act: Callable[[int], int]) -> list[int]:
    """act(file) of each file, in tasks of a file each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([act(file)], pa.int64())], names=["file", "out"])

    return [r["out"] for r in sorted(spark.range(0, files, 1, files).mapInArrow(run, "file long, out long").collect())]


def _level(
    texts: DataFrame, model: LanguageModel, directory: dict[str, np.ndarray], level: str, parts: int,
    keys_of: Callable, cut_at: Callable, tokens: int, totals_of: Callable, below_of: Callable,
) -> LanguageModel:
    """The model with one level more: cuts, counts in files, then probabilities, for which the
    weights of parents whose successors lie in several files are put together on the driver."""
    spark, settings, shards, bits = texts.sparkSession, model.settings, model.shards, U64(BITS[level])
    cuts = _for_each_file(spark, shards - 1, lambda s, m=model: cut_at(Reader.of(m), (s + 1) * tokens // m.shards)) if shards > 1 and tokens else []
    cuts = np.array([*cuts, *[(1 << 63) - 1] * (shards - 1 - len(cuts))], U64)
    placed = _next(model, directory, {f"{level}.cuts": cuts})

    def build(key: tuple, table: pa.Table) -> pa.Table:
        shard, reader = key[0].as_py(), Reader.of(placed)
        keys, counts = _sum_blocks(table)
        parents, values = (keys >> bits).astype(np.int64), (keys & ((U64(1) << bits) - U64(1))).astype(np.int64)
        first, last = reader.parents(level, shard)
        arrays, begin = _structure(parents - first, values, last - first)
        write_arrays(f"{model.folder}/{level}-{shard:05d}", arrays, _mark())
        write_arrays(f"{model.folder}/counts-{level}-{shard:05d}", {"count": _narrow(counts), "begin": _narrow(begin)}, _mark())
        edges = reader.directory[f"{level}.cuts"]
        edges = np.unique((edges[max(0, shard - 1) : shard + 1] >> bits).astype(np.int64))
        edges = edges[(edges >= first) & (edges < last)]
        low, high = np.searchsorted(parents, edges), np.searchsorted(parents, edges, "right")
        sums = np.concatenate([[0], np.cumsum(counts)])
        return pa.table(
            {
                "file": [shard], "n": [len(keys)], "tokens": [int(counts.sum())],
                "edges": pa.array([[{"parent": int(p), "at": int(x), "degree": int(y - x), "count": int(sums[y] - sums[x])} for p, x, y in zip(edges, low, high, strict=True)]], _EDGES),
            }
        )

    rows = _by_file(_filed(texts, placed, level, keys_of, parts), spark, shards)
    rows = sorted(rows.applyInArrow(build, "file long, n long, tokens long, edges array<struct<parent: long, at: long, degree: long, count: long>>").collect(), key=lambda r: r["file"])
    base = _sums([r["n"] for r in rows])
    edges: dict[int, list[int]] = {}  # parent: first node, successors, their counts
    for r in rows:
        for e in r["edges"]:
            now = edges.setdefault(e["parent"], [int(base[r["file"]]) + e["at"], 0, 0])
            if not now[1]:
                now[0] = int(base[r["file"]]) + e["at"]
            now[1] += e["degree"]
            now[2] += e["count"]
    table = np.array([(p, *edges[p]) for p in sorted(edges)], np.int64).reshape(-1, 4)
    built = _next(
        placed, directory,
        {f"{level}.base": base, f"{level}.tokens": _sums([r["tokens"] for r in rows]), f"{level}.edge": table[:, 0].copy(), f"{level}.edge_begin": table[:, 1].copy(),
         f"{level}.edge_degree": table[:, 2].copy(), f"{level}.edge_count": table[:, 3].copy()},
    )

    def finish(shard: int) -> int:
        reader, d = Reader.of(built), settings.discount
        first, last = reader.parents(level, shard)
        every = np.arange(first, last)
        pointer = reader.sequence(f"{level}-{shard:05d}", "pointer").decode().astype(np.int64)
        counts = reader.arrays(f"counts-{level}-{shard:05d}")["count"]
        behind = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        total = totals_of(reader, every)
        kept, distinct = behind[pointer[1:]] - behind[pointer[:-1]], np.diff(pointer)
        edge = reader.directory[f"{level}.edge"]
        own = np.flatnonzero((edge >= first) & (edge < last))
        kept[edge[own] - first], distinct[edge[own] - first] = reader.directory[f"{level}.edge_count"][own], reader.directory[f"{level}.edge_degree"][own]
        weight = np.clip(1 - (kept - d * distinct) / np.maximum(total, 1), 1e-10, 1)
        local = np.repeat(np.arange(last - first), np.diff(pointer))
        nodes = np.arange(reader.directory[f"{level}.base"][shard], reader.directory[f"{level}.base"][shard + 1])
        below = below_of(reader, every[local], reader.values(level, nodes))
        probability = code(np.log10((counts - d) / total[local] + weight[local] * below))
        write_arrays(f"{model.folder}/codes-{level}-{shard:05d}", {"probability": probability, "weight": code(np.log10(weight))}, _mark())
        return 0

    _for_each_file(spark, shards, finish)
    total = totals_of(Reader(built), table[:, 0])
    weight = np.clip(1 - (table[:, 3] - settings.discount * table[:, 2]) / np.maximum(total, 1), 1e-10, 1)
    return _next(built, directory, {f"{level}.edge_weight": code(np.log10(weight)).astype(np.int64)})


_EDGES = pa.list_(pa.struct([(x, pa.int64()) for x in ("parent", "at", "degree", "count")]))


def _filed(texts: DataFrame, model: LanguageModel, level: str, keys_of: Callable, parts: int) -> DataFrame:
    """BLOCKs by file. Where nothing is too rare, they go there straight, and are added up there."""
    settings, shard_of = model.settings, lambda keys: Reader.of(model).shard_of(level, keys)
    if settings.min_count <= 1:
        return _counted(texts, settings, keys_of, shard_of)

    def frequent(table: pa.Table) -> pa.Table:
        keys, counts = _sum_blocks(table)
        keep = counts >= settings.min_count
        out = _blocks(keys[keep], counts[keep], shard_of(keys[keep]))
        return pa.Table.from_batches([] if out is None else [out], _BLOCK)

    return _counted(texts, settings, keys_of, lambda k: _range_of(_mixed(k), parts)).groupBy("part").applyInArrow(frequent, BLOCK)


def _by_file(rows: DataFrame, spark: SparkSession, files: int):
    """rows grouped by file, with an empty row for each so that every file is written."""
    empty = spark.range(files).select(F.col("id").alias("part"), F.lit(b"").alias("keys"), F.lit(b"").alias("counts"))
    return rows.unionByName(empty).groupBy("part")


def _structure(parents: np.ndarray, values: np.ndarray, n_parents: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Pointers and successors of a file, rows in order; and where each row's parent begins."""
    pointer = np.concatenate([[0], np.cumsum(np.bincount(parents, minlength=n_parents))])
    begin = pointer[parents]
    own, group = groups(parents)
    ends = pointer[own + 1] - 1  # of each parent with successors: its greatest value
    grown = np.cumsum(values[ends] + 1)
    base = np.concatenate([[0], grown[:-1]]) if len(ends) else grown
    return EliasFano.of(pointer).arrays("pointer") | EliasFano.of(base[group] + values).arrays("successor"), begin


def score(docs: DataFrame, model: LanguageModel, text_col: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The columns keep of docs with n_tokens, n_known, base_score, score; a row for each row.

    Scores are sums of log10 over a text's words and its end: of the words' smoothed shares alone
    (base_score), and of the model's probabilities (score). No shuffle: tasks map the model's files.
    Null and empty texts are their end; repeated rows score alike. A column of docs named like an
    added one gives way to it. An empty table gives no rows.
    """
    added = {"n_tokens": pa.int64(), "n_known": pa.int64(), "base_score": pa.float64(), "score": pa.float64()}
    lean_batches(docs.sparkSession)
    source, keep, at = beside(docs, text_col, keep, list(added))
    fields = StructType(source.schema.fields[: len(keep)])
    for name, kind in added.items():
        fields = fields.add(name, "long" if kind == pa.int64() else "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, at, model.settings.chunk_chars):
                text = Text(part.column(at))
                known, base, full = Reader.of(model).score(text)
                arrays = [part.column(i) for i in range(len(keep))]
                arrays += [pa.array(v, t) for v, t in zip((text.sizes, known, base, full), added.values(), strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=fields.names)

    return source.mapInArrow(run, fields)
