import math
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewheel.llm import lm, queries
from tidewheel.llm.elias_fano import EliasFano, map_arrays, write_arrays


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=200), st.integers(0, 63))
def test_elias_fano(values, shift):
    v = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    e = EliasFano.of(v)
    assert e[np.arange(len(v))].tolist() == v.tolist()
    first = {}
    for i, x in enumerate(v.tolist()):
        first.setdefault(x, i)
    asked = [*v.tolist(), 0, 1, 2**64 - 1, *(max(0, x - 1) for x in v.tolist())]
    assert e.find(np.array(asked, np.uint64)).tolist() == [first.get(x, -1) for x in asked]


def test_long_runs_and_files(tmp_path):
    v = np.sort(np.concatenate([np.arange(50_000), np.full(1000, 60_000), 10**12 + np.arange(0, 10**9, 10**6)])).astype(np.uint64)
    write_arrays(f"file://{tmp_path}/x/a", EliasFano.of(v).arrays("v") | {"none": np.zeros(0, np.int64), "n": np.arange(5)}, "m")
    arrays, size, mapped = map_arrays(f"file://{tmp_path}/x/a")
    assert mapped and size > 0
    e = EliasFano.read(arrays, "v")
    assert (e[np.arange(len(v))] == v).all() and arrays["n"].tolist() == [0, 1, 2, 3, 4] and len(arrays["none"]) == 0
    assert e.find(v[::977]).tolist() == np.searchsorted(v, v[::977]).tolist()


def test_searches_in_long_runs_take_few_steps(monkeypatch):
    """Numbers whose high parts are all alike: a search must not halve the whole run step by step."""
    e = EliasFano.of(np.append(np.arange(0, 100_000, 2), 1 << 40).astype(np.uint64))
    steps, lows = [], EliasFano._lows
    monkeypatch.setattr(EliasFano, "_lows", lambda self, i: steps.append(len(i)) or lows(self, i))
    assert e.find(np.arange(99_999, dtype=np.uint64)).tolist() == [-1 if x % 2 else x // 2 for x in range(99_999)]
    assert len(steps) <= 6


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=100), st.integers(0, 63))
def test_decoding(values, shift):
    v = np.sort(np.array(values, np.uint64) >> np.uint64(shift))
    assert EliasFano.of(v).decode().tolist() == v.tolist()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), max_size=60), st.sampled_from([10, 1 << 20, 1 << 31]))
def test_distinct_pairs(pairs, limit):
    """In one sort where number and place fit into 64 bits together, else by places."""
    first, second = (np.array([p[k] for p in pairs], np.int64) for k in (0, 1))
    a, b, which = lm._distinct(limit - 10 + first, limit - 10 + second, limit)
    found = list(zip((a - limit + 10).tolist(), (b - limit + 10).tolist(), strict=True))
    assert found == sorted(set(pairs)) and [found[k] for k in which] == pairs


def test_splitting_by_file():
    for numbers in ([], [3], [0, 0, 2, 2, 2, 7], [5, 1, 5, 0, 1]):
        array, got = np.array(numbers, np.int64), {}
        for s, own in lm._split(array):
            assert isinstance(own, slice) == (numbers == sorted(numbers))
            got[s] = np.arange(len(array))[own].tolist()
        assert got == {s: [i for i, x in enumerate(numbers) if x == s] for s in set(numbers)}


def test_words_of_texts():
    draw = random.Random(3)
    for _ in range(200):
        texts = [None if draw.random() < 0.1 else "".join(draw.choice("aAbéÉ \n\t\x0b,") for _ in range(draw.randint(0, 12))) for _ in range(draw.randint(1, 6))]
        got, words = lm.Text(pa.array(texts, pa.string())), [(t or "").encode().lower().split() for t in texts]
        assert got.sizes.tolist() == [len(w) + 1 for w in words]
        code = lambda w: int(lm.hash_words(pa.array([w.decode()]))[0])
        assert got.hashes[got.tokens].tolist() == [h for w in words for h in [*map(code, w), lm.END]]


class Brute:
    def __init__(self, texts, discount=0.75, least=2):
        tokens = [(t or "").encode().lower().split() + [None] for t in texts]
        self.one, self.two, self.three = Counter(), Counter(), Counter()
        for t in tokens:
            self.one.update(t)
            self.two.update(zip(t, t[1:], strict=False))
            self.three.update(zip(t, t[1:], t[2:], strict=False))
        self.n, self.v, self.d, self.least = sum(self.one.values()), len(self.one), discount, least
        self.kept2, self.kept3 = defaultdict(float), defaultdict(float)
        for (u, _), c in self.two.items():
            self.kept2[u] += (c - discount) / self.one[u] if c >= least else 0
        for (u, v, _), c in self.three.items():
            self.kept3[u, v] += (c - discount) / self.two[u, v] if c >= least else 0

    def p1(self, w):
        return (self.one[w] + 0.5) / (self.n + 0.5 * (self.v + 1))

    def p2(self, u, v):
        if not self.one[u]:
            return self.p1(v)
        c = self.two[u, v]
        return ((c - self.d) / self.one[u] if c >= self.least else 0) + (1 - self.kept2[u]) * self.p1(v)

    def p3(self, u, v, w):
        if self.two[u, v] < self.least:
            return self.p2(v, w)
        c = self.three[u, v, w]
        return ((c - self.d) / self.two[u, v] if c >= self.least else 0) + (1 - self.kept3[u, v]) * self.p2(v, w)

    def score(self, text):
        t = (text or "").encode().lower().split() + [None]
        p = [self.p1(w) if k == 0 else self.p2(t[0], w) if k == 1 else self.p3(t[k - 2], t[k - 1], w) for k, w in enumerate(t)]
        return len(t), sum(self.one[w] > 0 for w in t), sum(math.log10(self.p1(w)) for w in t), sum(map(math.log10, p))


def test_hashes_tell_words_apart():
    words = list({"x" * k + str(j) * m for k in range(60) for j in range(10) for m in (0, 1, 2)} | {"é" * k for k in range(1100)} | {"y" * 5000 + c for c in "ab"})
    hashes = lm.hash_words(pa.array(["skipped", *words]).slice(1))
    assert len(set(hashes.tolist())) == len(words)
    assert hashes.tolist() == [int(lm.hash_words(pa.array([w]))[0]) for w in words]
    assert len(lm.hash_words(pa.array([], pa.string()))) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), max_size=100))
def test_packed_keys(values):
    v = np.sort(np.array(values, np.uint64))
    assert lm.unpack_ascending(lm.pack_ascending(v)).tolist() == v.tolist()


SMALL = {"part_bytes": 3_000, "shard_bytes": 400, "chunk_chars": 1_500}


@pytest.mark.parametrize(("least", "small"), [(1, {}), (1, SMALL), (2, SMALL), (1, SMALL | {"most_mapped": 1})])
def test_scores_match_brute_force(spark, least, small):
    small = lm.Settings(min_count=least, **small)
    draw = random.Random(5)
    vocab = [f"w{i}" for i in range(60)]
    sentence = [draw.choices(vocab, k=8) for _ in range(12)]
    texts = [" ".join(w if draw.random() < 0.8 else w.upper() for s in draw.choices(sentence, k=draw.randint(0, 6)) for w in s + draw.choices(vocab, k=draw.randint(0, 2))) for _ in range(220)]
    texts = [t.replace("w1", "the the") + " the" * (i % 3) for i, t in enumerate(texts)]  # a word and a pair over several files
    train, asked = texts[:180], [*texts[180:], None, "", "unseen words only", "w1 unseen w2 w3", texts[0]]
    df = lambda rows: spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    model, brute = lm.fit(df(train), settings=small), Brute(train, least=least)
    assert (model.train_tokens, model.words) == (brute.n, brute.v)
    rows = lm.score(df(asked).withColumn("score", F.lit("mine")), model).collect()
    model.delete()
    for r in rows:
        n, known, base, full = brute.score(asked[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-12)
        assert abs(r.score - full) <= 0.03 * n + 1e-9, asked[r.doc_id]
    held = [r for r in rows if r.doc_id < 40]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_registered_scores_hold_what_is_seen_once(spark, tmp_path):
    draw = random.Random(6)
    vocab = [f"w{i}" for i in range(80)]
    texts = [" ".join(draw.choices(vocab, k=draw.randint(0, 25))) for _ in range(200)]
    texts += [texts[0] or "w1 w2 w3", "w1 " * 400] * 4
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op5_lm_scoring(spark, str(tmp_path)).collect()
    brute = Brute([texts[r.doc_id] for r in rows if not r.held_out], least=1)
    assert len(rows) == len(texts) and any(c == 1 for c in brute.three.values()) and max(brute.two.values()) > 255
    for r in rows:
        n, known, base, full = brute.score(texts[r.doc_id])
        assert (r.n_tokens, r.n_known) == (n, known) and math.isclose(r.base_score, base, rel_tol=1e-9, abs_tol=1e-12)
        assert abs(r.score - full) <= 0.03 * n + 1e-9, texts[r.doc_id]


def test_edges(spark, edges, empty):
    model = lm.fit(edges)
    rows = lm.score(edges, model, keep=("doc_id",)).collect()
    assert len(rows) == edges.count() and all(math.isfinite(r.score) for r in rows) and lm.score(empty, model).count() == 0
    model.delete()
    nothing = lm.fit(empty)
    rows = lm.score(edges, nothing, keep=("doc_id",)).collect()
    nothing.delete()
    assert nothing.train_tokens == 0 and all(r.n_known == 0 for r in rows)
