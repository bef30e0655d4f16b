import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import repetition

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def depth(words):
    out = []
    for i in range(len(words)):
        best = 0
        for j in range(len(words)):
            k = 0
            while i != j and max(i, j) + k < len(words) and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


@pytest.mark.parametrize("seed", range(30))
def test_longest_repeats_match_all_pairs(seed):
    draw = random.Random(seed)
    docs = [draw.choices("abcd"[: draw.randint(1, 4)], k=draw.randint(0, 40)) for _ in range(draw.randint(1, 5))]
    words, sizes = np.array([ord(w) for d in docs for w in d], np.int64), np.array([len(d) for d in docs])
    expect = [x for d in docs for x in depth(d)]
    assert repetition.longest_repeats(words, sizes).tolist() == expect
    for least in (1, 3, 5):
        marks = []
        for d in docs:
            inside = set()
            for i, m in enumerate(depth(d)):
                inside |= set(range(i, i + m)) if m >= least else set()
            marks.append(len(inside))
        assert repetition.covered(np.array(expect), sizes, least).tolist() == marks


def test_maximal_repeats():
    assert repetition.maximal_repeats("a b c x a b c y".split(), 2) == [(0, 3), (4, 3)]
    assert repetition.maximal_repeats("a a a a".split(), 2) == [(0, 3), (1, 3)] or repetition.maximal_repeats("a a a a".split(), 2)[0] == (0, 3)


def base(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_base_measures(spark):
    draw = random.Random(4)
    bits = ["a", "b", "éü", "𝄞", "#", "<|", " ", "\n", "\t", "\x0b", "\x1f", " ", "x y z\n"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 150))) for _ in range(150)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in repetition.quality_rules(df, chunk_chars=500).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(texts[r.doc_id]), texts[r.doc_id]


def test_verdicts(spark):
    draw = random.Random(8)
    word = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    clean, block = word(300), word(45)
    half = word(120) + block + word(30) + block + word(2)
    long = word(10) + (b := word(70)) + word(60) + b
    texts = {1: clean, 2: half, 3: long, 4: clean + clean, 5: word(20), 6: clean + word(12) * 2}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    limits = repetition.RepetitionLimits(max_repeat_words_percent=99, max_covered=0.5, max_longest=0.3)
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string"), limits=limits).collect()}
    assert got[1].kept and got[6].kept and got[2].n_covered_words == 90 and got[2].kept and got[2].longest_repeat == 45
    assert not got[3].kept and got[3].longest_repeat == 70 and not got[4].kept and not got[5].kept and got[5].base_failed


def test_registered_limits_bite_below_the_base_rule(spark):
    draw = random.Random(9)
    word = lambda n: [f"w{draw.randrange(10**9)}" for _ in range(n)]
    copies = lambda n: word(50) + (b := word(n)) + word(100) + b + word(150 - 2 * n)
    run = lambda n: word(100) + word(1) * n + word(200 - n)
    texts = {1: copies(70), 2: copies(60), 3: run(90), 4: run(60), 5: word(300)}
    rows = [(i, " ".join(t)) for i, t in texts.items()]
    got = {r.doc_id: r for r in repetition.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values()) and [i for i in got if got[i].kept] == [2, 4, 5]
    assert (got[1].n_covered_words, got[1].longest_repeat, got[3].n_covered_words, got[3].longest_repeat) == (140, 70, 90, 89)


def test_edges(edges, empty):
    wide = edges.withColumns({"n_words": F.lit("mine"), "KEPT": F.lit(1)})
    out = repetition.quality_rules(wide)
    assert out.count() == edges.count() and dict(out.dtypes)["n_words"] == "bigint" and "KEPT" not in out.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[9].n_words == 40_000 and rows[9].base_failed and rows[5].n_words == 0 and rows[5].base_failed
    assert repetition.quality_rules(empty).count() == 0
    kept = repetition.quality_rules(wide, prefix="q_")
    assert [c for c in kept.columns if not c.startswith("q_")] == wide.columns


def test_least_between():
    draw = np.random.default_rng(3)
    for n in (1, 5, 63, 64, 65, 400, 3000):
        values = draw.integers(0, 1000, n).astype(np.int32)
        x = draw.integers(0, n, 300)
        y = np.minimum(n, x + 1 + draw.integers(0, n, 300))
        got = repetition.least_between(values, x, y)
        assert got.tolist() == [int(values[a:b].min()) for a, b in zip(x, y, strict=True)]
