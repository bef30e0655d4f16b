import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewheel.llm import repetition

from .test_ngram_join import brute, corpus

WORD = re.compile(r"[^\x20\x09-\x0D]+")
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    texts = corpus(7, 40, 6, 3)
    texts += texts[:30] + ["the same words again and again " * 30, None, ""]
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).cache()


def run(spark, docs, *names):
    for n in names:
        docs = STAGE[n](spark, docs, "")
    return docs


def test_stages_match_brute_force(spark, docs):
    rows = {r.doc_id: r.text for r in docs.collect()}
    judged = {i: repetition.measure([t], repetition.RepetitionLimits())["kept"][0] for i, t in rows.items()}
    kept = {i for i in rows if judged[i]}
    one = run(spark, docs, "quality_rules")
    assert one.columns == docs.columns and {r.doc_id for r in one.collect()} == kept and 0 < len(kept) < len(rows)
    last = {}
    for i in sorted(kept):
        last[rows[i]] = i
    two = run(spark, one, "exact_dedup")
    assert {r.doc_id for r in two.collect()} == set(last.values()) and two.columns == docs.columns
    order = sorted(last.values())
    label, _ = brute([rows[i] for i in order])
    first = {}
    for i, x in zip(order, label, strict=True):
        first[x] = min(first.get(x, i), i)
    three = run(spark, two, "ngram_join").cache()
    assert {r.doc_id for r in three.collect()} == set(first.values()) and three.columns == docs.columns
    four = run(spark, three, "source_mixing")
    assert four.columns == docs.columns
    words = lambda df: sum(len(WORD.findall(r.text or "")) for r in df.collect())
    assert abs(words(four) - words(three)) <= 5
    five = run(spark, four, "mixture_packing").collect()
    assert {r.doc_id for r in five} <= set(first.values()) and all(r.length > 0 for r in five)


def test_edges_go_through_all_stages(spark, edges, empty):
    wide = edges.withColumns({"kept": F.lit("mine"), "uid": F.lit(1), "shard": F.lit(2), "quality_kept": F.lit(3), "tokens": F.array(F.lit(1))})
    out = wide
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == wide.columns
    assert corpus_pipeline.STAGES[-1][1](spark, out, "").count() > 0
    none = empty
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, "")
    assert none.count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(repr, run(spark, docs, *STAGE).collect()))
