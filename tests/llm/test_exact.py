import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidewheel.llm import exact


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r.text or ""].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        best = max((i for i in ids if i is not None), default=None)
        out += [(i, best, len(ids), i == best, text) for i in ids]
    return sorted(out, key=repr)


def test_matches_brute_force(edges):
    rows = edges.collect()
    got = exact.exact_dedup(edges).collect()
    full = expected(rows)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=repr) == sorted((x[:4] for x in full), key=repr)
    assert {r.digest for r in got} == {hashlib.sha256(x[4].encode()).hexdigest() for x in full}


def test_contents_are_compared_whole(edges):
    """A digest that collides all the time doesn't change the result."""
    weak = exact.exact_dedup(edges, digest=lambda text: F.substring(F.sha2(text, 256), 1, 0))
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in weak.collect()), key=repr)
    assert got == sorted((x[:4] for x in expected(edges.collect())), key=repr)


def test_salts_and_partitions_don_t_matter(spark):
    rows = [(i, "hot" if i % 3 else f"t{i % 40}") for i in range(900)]
    results = set()
    for parts, salts in ((1, 1), (7, 3), (20, 16)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        results.add(tuple(sorted((r.doc_id, r.keep_id, r.group_size) for r in exact.exact_dedup(df, salts=salts).collect())))
    assert len(results) == 1


def test_unique_rows(edges, empty):
    wide = edges.withColumns({"salt": F.lit("s"), "digest": F.col("doc_id"), "best": F.lit(1), "group_size": F.lit(2)})
    out = exact.unique_rows(wide)
    assert out.columns == wide.columns and out.schema["doc_id"].dataType == wide.schema["doc_id"].dataType
    rows = out.collect()
    texts = [r.text or "" for r in rows]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in edges.collect()})
    kept = {r.text or "": r.doc_id for r in rows}
    assert all(kept[t] == best for _, best, _, _, t in expected(edges.collect()))
    assert next(r for r in rows if r.doc_id == 5).text is None
    assert exact.unique_rows(empty).count() == 0 == exact.exact_dedup(empty).count()


def test_unique_rows_with_clashing_names_and_maps(spark):
    rows = [(1, "x", {"a": 1}, True, 5), (2, "x", {"b": 2}, False, 6), (None, None, None, None, None), (3, "", {"c": 3}, True, 7), (2, "x", {"b": 2}, False, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags map<string,int>, __null_text boolean, `no_text` long").withColumnsRenamed({"__null_text": "at"})
    out = exact.unique_rows(df)
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text, r.tags, r.at, r.no_text) for r in out.collect()), key=repr) == sorted([(2, "x", {"b": 2}, False, 6), (3, "", {"c": 3}, True, 7)], key=repr)
    odd = spark.createDataFrame([(1, "x", 1, 2), (2, "x", 3, 4)], "doc_id long, text string, `a.b` long, __null_text long")
    assert [tuple(r) for r in exact.unique_rows(odd).collect()] == [(2, "x", 3, 4)]
