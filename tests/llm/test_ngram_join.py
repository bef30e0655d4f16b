import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingle_set(text, n=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*[w[k:] for k in range(n)], strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute(texts, percent=75):
    """Class of each text, by index, comparing all pairs."""
    sets = [shingle_set(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def corpus(seed, families, size, edits):
    draw = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    passage = draw.choices(vocab, k=60)
    out = []
    for _ in range(families):
        base = draw.choices(vocab, k=draw.randint(3, 120))
        for _ in range(draw.randint(1, size)):
            words = list(base)
            for _ in range(draw.randint(0, edits)):
                words[draw.randrange(len(words))] = draw.choice(vocab)
            if draw.random() < 0.2:
                words = words + passage
            if draw.random() < 0.1:
                words = [w.upper() for w in words]
            out.append(draw.choice([" ", "  ", "\n"]).join(words))
    draw.shuffle(out)
    return out


@pytest.mark.parametrize(("seed", "families", "size", "edits"), [(1, 12, 12, 4), (2, 3, 60, 6), (3, 60, 2, 2)])
def test_classes_match_all_pairs(spark, seed, families, size, edits):
    texts = corpus(seed, families, size, edits)
    label, sizes = brute(texts)
    ids = [1000 - 7 * i for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(4)
    least = {}
    for i, x in zip(ids, label, strict=True):
        least[x] = min(least.get(x, i), i)
    got = {r.doc_id: (r.size, r.component_id) for r in ngram_join.ngram_classes(df, range_bytes=2_000, chunk_chars=3_000).collect()}
    assert got == {i: (s, least[x]) for i, s, x in zip(ids, sizes, label, strict=True)}


def test_edges(edges, empty):
    rows = ngram_join.ngram_classes(edges.withColumns({"tokens": F.lit(1), "size": F.lit("x"), "uid": F.lit(0)})).collect()
    assert len(rows) == edges.count()
    by = {r.doc_id: r for r in rows}
    assert by[1].component_id == by[2].component_id == by[3].component_id == by[12].component_id == 1
    assert by[7].component_id == by[8].component_id == 7 and by[7].size == 1
    assert by[4].size == by[5].size == by[6].size == 0 and by[4].component_id == 4 and by[6].component_id == 6
    nulls = [r for r in rows if r.doc_id is None]
    assert sorted((r.size, r.component_id or 0) for r in nulls) == [(0, 0), (by[1].size, 1)]
    assert ngram_join.ngram_classes(empty).count() == 0


def test_one_row_of_each_class(edges, empty):
    wide = edges.withColumns({"row": F.lit(1), "kept_id": F.lit(2)})
    out = ngram_join.one_of_each_class(wide)
    rows = out.collect()
    assert out.columns == wide.columns
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 1, 4, 5, 6, 7, 9, 10, 11]
    assert ngram_join.one_of_each_class(empty).count() == 0


@pytest.mark.parametrize("spread", [True, False])
def test_components_of_paths_and_stars(spark, spread):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(139, 200), (7, 7), (3, 2)]
    got = {r.node: r.label for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long"), spread).collect()}
    assert got == {i: 0 for i in range(41)} | {x: 100 for x in (*range(100, 140), 200)}
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shingles_tell_short_texts_apart():
    assert len(ngram_join.shingles("a b c d e")) == 1 and len(ngram_join.shingles(None)) == 0
    assert ngram_join.shingles("a b")[0] != ngram_join.shingles("ab")[0] != ngram_join.shingles("b a")[0]
    assert np.array_equal(ngram_join.shingles("A b\tC d e f"), ngram_join.shingles("a B c D\u000be  F"))


def test_a_shingle_in_all_documents(spark):
    draw = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(12))
    texts = [f"{passage} " + " ".join(f"d{draw.randrange(30)}" for _ in range(draw.randint(0, 14))) for _ in range(300)] + [passage] * 40
    label, sizes = brute(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.size, r.component_id) for r in ngram_join.ngram_classes(df, range_bytes=2_000, chunk_chars=2_000).collect()}
    assert got == {i: (s, x) for i, (s, x) in enumerate(zip(sizes, label, strict=True))}
