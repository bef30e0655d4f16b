"""Registered queries: SQL where there is some, and brute force over whole tables where there is none."""

import hashlib
import os
import re

import duckdb
import pytest

from tidewheel.llm import queries

from .test_ngram_join import brute
from .test_repetition import base
from .test_secrets import simple

DATA = os.environ.get("TIDEWHEEL_TEST_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    rows = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in rows.description]
    df = queries.queries()[name](spark, DATA).select(*names)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(rows.fetchall(), key=repr)


def test_ngram_join(spark, documents):
    ids = sorted(documents)
    label, sizes = brute([documents[i] for i in ids])
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op2_ngram_join(spark, DATA).collect()}
    assert got == {i: (s, ids[x]) for i, s, x in zip(ids, sizes, label, strict=True)}


def test_secret_scan(spark, documents):
    for r in queries.op3_secret_scan(spark, DATA).collect():
        spans = simple(documents[r.doc_id] or "")
        count = lambda k: sum(s[0] == k for s in spans)  # noqa: B023, E731
        assert (r.n_assign, r.n_access, r.n_hex) == (count("assign"), count("access"), count("hex"))
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def test_quality_rules(spark, documents):
    for r in queries.op10_quality_rules(spark, DATA).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(documents[r.doc_id])
        assert not (r.base_failed and r.kept)


def test_mixing_and_packing_cover_every_document(spark, documents):
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in documents.items()}
    rows = queries.op7_source_mixing(spark, DATA).collect()
    assert {r.doc_id: r.size for r in rows} == words and abs(sum(r.taken for r in rows) - sum(words.values())) <= 20
    pieces = queries.op4_mixture_packing(spark, DATA).collect()
    assert {r.doc_id for r in pieces} == set(documents)


def test_license_scan_names_what_is_there(spark, documents):
    for r in queries.op9_license_scan(spark, DATA).collect():
        text = documents[r.doc_id] or ""
        assert ("Apache-2.0" in r.licences) == ("Licensed under the Apache License, Version 2.0." in text)
        assert ("MIT" in r.licences) == ("Released under the MIT License." in text)
