import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes, most=3, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = {}, sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        level = (total - sum(full.values())) / sum(weight[s] for s in rest) if rest else 0
        over = [s for s in rest if level * weight[s] > most * sizes[s] + 1e-9]
        if not over:
            return {s: full.get(s, level * weight[s]) for s in names}
        full |= {s: most * sizes[s] for s in over}


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(300):
        source = [None, "a", "b", "é", "Z", "tiny"][i % 5 if i != 7 else 5]
        rows.append((i, " ".join(["w"] * (i * 37 % 50)) if i % 11 else None, "en", source, 1))
    rows += [rows[20]] * 3 + [(None, "n u l l", "en", "a", 1)] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def test_targets_and_taken(docs):
    mixture = mixing.mix(docs, block_words=16, shard_words=500)
    rows = mixture.taken().collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    by_id = {r.doc_id: r for r in docs.collect()}
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.collect())
    for r in rows:
        source, n = by_id[r.doc_id].source, len(WORD.findall(by_id[r.doc_id].text or ""))
        assert r.size == n and r.taken <= 3 * n
        sizes[source] += n
        taken[source] += r.taken
    expect = targets(sizes)
    for r in rows:
        assert abs(r.target - expect[by_id[r.doc_id].source]) < 1e-6 and r.source_size == sizes[by_id[r.doc_id].source]
    assert all(abs(taken[s] - expect[s]) <= 1 for s in sizes) and expect["tiny"] == 3 * sizes["tiny"]
    again = mixing.mix(docs, block_words=16, shard_words=500).taken()
    key = lambda r: (r.doc_id or -1, r.start, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again.collect()))


def test_shards_draw_disjoint_pieces(docs):
    mixture = mixing.mix(docs, block_words=16, shard_words=500)
    pieces = mixture.pieces.collect()
    assert len({(p.skey, p.start, p.copy) for p in pieces}) == len(pieces) and len({p.shard for p in pieces}) > 4


def test_tree_deals_exact_quotas_with_the_right_mean(spark):
    counts = {"a": 40, "b": 25, "c": 0, "d": 3}
    df = spark.createDataFrame(list(counts.items()), "skey string, n_blocks long")
    seen = defaultdict(float)
    for seed in range(30):
        rows = mixing.split_tree(df, 2, seed).collect()
        totals = Counter()
        for r in rows:
            totals[r.shard] += r.quota
            seen[r.skey, r.shard] += r.quota / 30
        assert sorted(totals.values()) == [17, 17, 17, 17]
        assert {s: sum(r.quota for r in rows if r.skey == s) for s in counts} == counts
    assert all(abs(seen["a", s] - 10) < 2 and abs(seen["b", s] - 6.25) < 2 for s in range(4))


def test_rows_of_the_mix(docs, empty):
    wide = docs.withColumns({"shard": F.lit("x"), "words": F.col("doc_id"), "hash": F.lit(1)})
    out = mixing.mixed_rows(wide, shard_words=500, block_words=16)
    assert out.columns == wide.columns and dict(out.dtypes) == dict(wide.dtypes)
    rows, sizes = out.collect(), defaultdict(int)
    for r in docs.collect():
        sizes[r.source] += len(WORD.findall(r.text or ""))
    got = defaultdict(int)
    for r in rows:
        got[r.source] += len(WORD.findall(r.text or ""))
    assert all(abs(got[s] - t) <= 1 for s, t in targets(sizes).items())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(texts[r.doc_id].startswith(r.text) and (r.n_chars == 1 or r.n_chars == len(r.text)) for r in rows)
    assert mixing.mixed_rows(empty).count() == 0 and mixing.mix(empty).taken().count() == 0


def test_edges(edges):
    rows = mixing.mix(edges).taken().collect()
    assert len(rows) == edges.count() and all(0 <= r.taken <= 3 * r.size for r in rows)
