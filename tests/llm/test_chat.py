import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewheel.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def test_round_trip_of_control_strings(spark):
    draw = random.Random(1)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "assistant", "<", "|", "\\", "<\\|", "<\\\\|nl|>", "$1", "é𝄞", "", " ", "<|nl|>"]
    turns = [(c, t, draw.choice(["user", "assistant", "system", "a\nb", "<|x|>", "\\", ""]), "".join(draw.choices(bits, k=draw.randint(0, 8)))) for c in range(150) for t in range(draw.randint(1, 4))]
    out = chat.format_chat(spark.createDataFrame(turns, SCHEMA)).select("*", chat.parse(F.col("formatted")).alias("read"), chat.loss_text(F.col("segments")).alias("loss"))
    for r in out.collect():
        own = [(role, text) for c, _, role, text in turns if c == r.conv_id]
        assert [(x.role, x.text) for x in r.read] == own and r.n_turns == len(own)
        assert r.formatted.count("<|im_start|>") == len(own) == r.formatted.count("<|im_end|>")
        assert r.loss == "".join(t for role, t in own if role == "assistant")
        assert "".join(s.text for s in r.segments) == r.formatted


@pytest.mark.parametrize(
    ("roles", "valid", "complete"),
    [("ua", 1, 1), ("sua", 1, 1), ("u", 1, 0), ("us", 0, 0), ("au", 0, 0), ("uu", 0, 0), ("uatta", 1, 1), ("uat", 1, 0), ("ss", 0, 0), ("ux", 0, 0), ("s", 1, 0)],
)
def test_turn_order(spark, roles, valid, complete):
    names = {"s": "system", "u": "user", "a": "assistant", "t": "tool", "x": "robot"}
    df = spark.createDataFrame([(1, i, names[r], "t") for i, r in enumerate(roles)], SCHEMA)
    row = chat.format_chat(df).first()
    assert (row.valid, row.complete) == (bool(valid), bool(complete))


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, None, None), (None, None, "user", "x"), (1, None, "user", ""), (2, 5, "assistant", "z" * 200_000), (2, 5, "assistant", "a")]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"segments": F.lit(1), "formatted": F.lit("x"), "n_turns": F.lit(2)})
    got = {r.conv_id: r for r in chat.format_chat(df).select("*", chat.parse(F.col("formatted")).alias("read")).collect()}
    assert [x.role for x in got[1].read] == ["user", "", ""] and got[None].n_turns == 1
    assert [x.text[:2] for x in got[2].read] == ["a", "zz"] and len(got[2].formatted) > 200_000
    assert chat.format_chat(df.limit(0)).count() == 0
    assert chat.parse(F.lit("")) is not None


def test_template_is_checked():
    with pytest.raises(ValueError):
        chat.ChatTemplate(turn_start="[INST]")


def test_digest_of_a_known_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], SCHEMA)
    row = chat.format_chat(df).first()
    assert row.formatted == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyo<|im_end|>\n"
    assert hashlib.sha256(row.formatted.encode()).hexdigest() and [s.loss for s in row.segments] == [False, False, False, False, True, False]
