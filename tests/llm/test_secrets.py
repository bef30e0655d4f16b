import random
import re
import string

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import secrets

SIMPLE = {
    "assign": (r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A, 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 0, 18),
    "hex": (r"[0-9a-f]+", 0, 0, 16),
}


def simple(text):
    out = []
    for rank, (kind, (pattern, flags, group, least)) in enumerate(SIMPLE.items()):
        out += [(m.start(), rank, m.end(), kind) for m in re.finditer(pattern, text, flags) if len(m[group]) >= least]
    return [(k, a, b) for a, _, b, k in sorted(out)]


@pytest.fixture(scope="module")
def model(spark, edges):
    samples = spark.createDataFrame(secrets.random_samples(1500), "text string, random boolean")
    words = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate([["connection", "handler", "buffer", "password", "request", "value", "index", "response", "parser", "stream"]] * 3)], "doc_id long, text string")
    return secrets.fit_markov(samples.unionByName(secrets.identifier_samples(words)).union(spark.createDataFrame([(None, True), ("", False), ("x", None)], "text string, random boolean")))


def test_base_spans_match_the_plain_patterns(spark, model):
    draw = random.Random(2)
    bits = ["password", "API_KEY", "apikey=", "Token: ", "secret'", "ſecret=", "toKen=", "= ", ":", '"', "AKIA", "ABCDEFGH1234567890", "deadbeef", "0123456789abcdef", " ", "\n", "é", "𝄞", "x.y-z_/+=", "abcdefabcdef99"]
    texts = ["".join(draw.choices(bits, k=draw.randint(0, 14))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secrets.scan_secrets(df, model).collect():
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == simple(texts[r.doc_id])
        base = {(s.kind, s.start, s.end) for s in r.base_spans}
        assert base <= {(s.kind, s.start, s.end) for s in r.spans}
        more = [s for s in r.spans if s.kind == "random"]
        assert not any(a < s.end and s.start < b for s in more for _, a, b in base)


def test_models_tell_random_from_identifiers(model):
    draw = random.Random(99)
    keys = ["".join(draw.choices(string.ascii_letters + string.digits, k=draw.randint(20, 60))) for _ in range(500)]
    names = ["_".join(draw.choices(["handler", "request", "parser", "buffer", "index", "value", "stream", "connection"], k=4)) for _ in range(500)]
    assert sum(map(model.is_random, keys)) >= 490 and sum(map(model.is_random, names)) <= 5


def test_edges(edges, empty, model):
    rows = secrets.scan_secrets(edges.withColumn("spans", F.lit("mine")), model).collect()
    assert len(rows) == edges.count() and all(r.spans == [] for r in rows)
    assert secrets.scan_secrets(empty, model).count() == 0


def test_found_in_a_whole_long_text(spark, model):
    key = "Zk3v9QpLx7WmT2bRnY8sHdF4"
    df = spark.createDataFrame([(1, "word " * 50_000 + key + " " + "end " * 10)], "doc_id long, text string")
    row = secrets.scan_secrets(df, model, keep=("doc_id",)).first()
    assert [(s.kind, s.start, s.end) for s in row.spans] == [("random", 250_000, 250_024)]


def quadratic(matches, found):
    return [m.span() for m in matches if not any(a < m.end() and m.start() < b for a, b, _ in found)]


def test_apart_matches_all_pairs():
    draw = random.Random(4)
    for _ in range(300):
        text = "".join(draw.choice("ab .") for _ in range(80))
        found = sorted((a, a + draw.randint(1, 9), "x") for a in draw.choices(range(75), k=draw.randint(0, 8)))
        assert list(secrets.apart(re.finditer(r"[ab]{2,}", text), found)) == quadratic(re.finditer(r"[ab]{2,}", text), found)


def test_many_spans_in_one_text():
    import time

    text = ("deadbeefdeadbeef0 " + "Zk3v9QpLx7WmT2bRnY8sHdF4 ") * 40_000
    begin = time.process_time()
    found = sorted((a, b, k) for a, b, k in secrets.base_spans(text))
    assert len(found) == 40_000 and sum(1 for _ in secrets.apart(secrets.CANDIDATE.finditer(text), found)) == 40_000
    assert time.process_time() - begin < 10


@pytest.mark.parametrize("seed", [1, 2])
def test_held_out_strings(spark, seed):
    """Trained on one half of the words, measured on names made of the other, in forms, lengths and
    alphabets that training doesn't have; and on keys in forms of their own."""
    draw = random.Random(seed)
    syllables = ["con", "nec", "tion", "hand", "ler", "buf", "fer", "re", "quest", "val", "ue", "in", "dex", "pars", "er", "stream", "log", "ger", "con", "fig", "up", "date", "user", "name", "tab", "le", "col", "umn", "ser", "vice", "time", "out"]
    words = sorted({"".join(draw.choices(syllables, k=draw.randint(2, 4)))[:15] for _ in range(1200)})
    draw.shuffle(words)
    seen, unseen = words[:500], words[500:]
    docs = spark.createDataFrame([(i, " ".join(seen[i::10])) for i in range(10)], "doc_id long, text string")
    model = secrets.fit_markov(spark.createDataFrame(secrets.random_samples(3000), "text string, random boolean").unionByName(secrets.identifier_samples(docs)))
    name = lambda: draw.choice([
        lambda w: "_".join(w), lambda w: "-".join(w), lambda w: "/".join(w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]),
        lambda w: "_".join(w).upper(), lambda w: "_".join(w) + f"_{draw.randrange(10_000)}", lambda w: "/".join(w) + f"-v{draw.randrange(9)}",
    ])(draw.choices(unseen, k=draw.randint(3, 6)))
    key = lambda: draw.choice([
        lambda n: "".join(draw.choices(string.ascii_letters + string.digits, k=n)), lambda n: "sk-" + "".join(draw.choices(string.ascii_letters + string.digits, k=n)),
        lambda n: "".join(draw.choices(string.ascii_uppercase + string.digits, k=n)), lambda n: "".join(draw.choices(string.ascii_lowercase + string.digits, k=n)),
        lambda n: "ghp_" + "".join(draw.choices(string.ascii_letters + string.digits + "_-", k=n)),
    ])(draw.randint(24, 48))
    names, keys = [x for x in (name() for _ in range(2000)) if len(x) >= 20], [key() for _ in range(2000)]
    caught, wrong = sum(map(model.is_random, keys)), sum(map(model.is_random, names))
    assert caught / len(keys) >= 0.9 and caught / (caught + wrong) >= 0.9, (caught / len(keys), wrong / len(names))
