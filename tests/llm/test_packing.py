import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import packing
from tidewheel.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def direct():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def ids(direct, text):
    return direct.encode(text or "", add_special_tokens=False).ids + [1]


def test_cache_encodes_as_the_tokenizer_does(direct):
    draw = random.Random(1)
    bits = ["foo", "BAR", "é", "Σας", "'s", "I'll", "don't", ",", ".", "!!", "...", "12", "3.4", "…", "\x01", " ", "  ", "\n", "\t", " ", "​", "<|endoftext|>", "<|EndOfText|>", "\x1c", "\x85", "x́", "ﬁ", "𝄞", "_", "²"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 12))) for _ in range(1500)] + [None, ""]
    for most in (100_000, 50):
        cache = packing.TokenCache(tokenizer_path(), most)
        out = []
        for i in range(0, len(texts), 100):
            out += cache.encode(pa.array(texts[i : i + 100], pa.string()), 1).to_pylist()
        wrong = [t for t, o in zip(texts, out, strict=True) if np.frombuffer(o, cache.dtype).tolist() != ids(direct, t)]
        assert not wrong, wrong[:5]


def test_round_robin_covers_and_keeps_to_shares():
    draw = random.Random(2)
    queues = {s: [draw.randint(1, 3000) for _ in range(n)] for s, n in (("a", 300), ("b", 100), (None, 50))}
    total = {s: sum(q) for s, q in queues.items()}
    pieces = list(packing.deficit_round_robin(queues, {s: float(n) for s, n in total.items()}, 2048, 256, {"a": 500.0, "b": -500.0}))
    seen = {}
    for p in pieces:
        at = seen.get((p.source, p.document), 0)
        assert p.start == at and p.length > 0
        seen[p.source, p.document] = at + p.length
    assert seen == {(s, i): n for s, q in queues.items() for i, n in enumerate(q)}
    windows = {}
    for p in pieces:
        assert p.offset == sum(x.length for x in windows.get(p.window, []))
        windows.setdefault(p.window, []).append(p)
    fill = [sum(x.length for x in w) for w in windows.values()]
    assert all(n == 2048 for n in fill[:-1]) and sum(fill) == sum(total.values())
    given = dict.fromkeys(queues, 0)
    for number in range(len(fill) * 9 // 10):
        for p in windows[number]:
            given[p.source] += p.length
        for s, n in given.items():
            assert abs(n - 2048 * (number + 1) * total[s] / sum(total.values())) <= 256 * 3 + 500


def test_pieces_of_all_documents(spark, edges, empty, direct):
    wide = edges.withColumns({"ids": F.lit("mine"), "lane": F.lit(1), "n_tokens": F.lit(2)})
    rows = packing.packed_digests(wide, tokenizer_path(), lane_tokens=20_000).collect()
    docs = [(r.doc_id, np.array(ids(direct, r.text), "<u4")) for r in edges.collect()]
    expect = sorted(((i, len(a), zlib.crc32(a.tobytes())) for i, a in docs), key=repr)
    pieces, folder = packing.pack(wide, tokenizer_path(), lane_tokens=20_000)
    real = pieces.collect()
    packing.delete_folder(folder)
    for r in real:
        assert len(r.ids) == 2 * r.length
    texts = {}
    for r in sorted(real, key=lambda r: r.start):
        texts.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert sum(r.length for r in rows) == sum(len(a) for _, a in docs) == sum(r.length for r in real)
    whole = [((i, n), rs) for (i, n), rs in texts.items() if sum(r.length for r in rs) == n]
    for (i, n), rs in whole:
        joined = np.frombuffer(b"".join(bytes(r.ids) for r in rs), "<u2").astype("<u4")
        assert (i, n, zlib.crc32(joined.tobytes())) in expect
    assert len(whole) >= 10
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for own in by.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))] and sum(r.length for r in own) <= 2048
    assert packing.packed_digests(empty, tokenizer_path()).count() == 0


def test_reruns_agree_and_shares_are_taken(spark, edges):
    run = lambda **k: sorted(map(repr, packing.packed_digests(edges, tokenizer_path(), lane_tokens=30_000, **k).collect()))
    assert run() == run() and len(run(shares={"a": 0.5, "b": 0.3, "c": 0.1, None: 0.1})) > 10


def test_sequences_are_padded(spark, edges):
    pieces, folder = packing.pack(edges.filter("doc_id = 9 OR doc_id = 7"), tokenizer_path())
    rows = packing.sequences(pieces, pad_id=5).collect()
    packing.delete_folder(folder)
    assert all(len(r.ids) == 2048 or (n := len(r.ids)) & (n - 1) == 0 for r in rows) and sum(r.n_tokens for r in rows) > 40_000


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_whole_texts_where_runs_are_not_apart(name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    direct, cache = tokenizers.Tokenizer.from_file(path), packing.TokenCache(path)
    assert cache.by_run == (name == "word_bpe_49k.json")
    texts = ["Two  words.\n Indented line", "", None, "CASE matters", "a <|ENDOFTEXT|> b", "x <|endoftext|>"]
    got = [np.frombuffer(x, cache.dtype).tolist() for x in cache.encode(pa.array(texts, pa.string()), 1).to_pylist()]
    assert got == [ids(direct, t) for t in texts]


def test_repeated_rows_are_spread_over_lanes(spark):
    df = spark.createDataFrame([(1, "same text here " * 16, "a")] * 1200, "doc_id long, text string, source string")
    rows = packing.packed_digests(df, tokenizer_path(), lane_tokens=6_000).collect()
    lanes = {r.sequence_id >> 32 for r in rows}
    tokens = sum(r.length for r in rows)
    assert len(lanes) == -(-tokens // 6_000) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


def test_registered_pieces_match_the_plain_tokenizer(spark, direct):
    """Every piece of every document of a whole table, against the tokenizer run on whole texts."""
    import duckdb
    import os

    from tidewheel.llm import queries

    data = os.environ.get("TIDEWHEEL_TEST_DATA", "/root/testdata/sf0.001")
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet'").fetchall())
    want = {i: ids(direct, t) for i, t in texts.items()}
    at, windows = dict.fromkeys(texts, 0), {}
    for r in sorted(queries.op4_mixture_packing(spark, data).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at[r.doc_id] and r.doc_tokens == len(want[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(want[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert at == {i: len(x) for i, x in want.items()}
    for pieces in windows.values():
        assert [o for o, _ in sorted(pieces)] == [sum(n for _, n in sorted(pieces)[:k]) for k in range(len(pieces))]
        assert sum(n for _, n in pieces) <= 2048
