"""Formatted conversations read back to what went in."""

import random

import pytest
from pyspark.sql import functions as F

from stationmine.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).withColumn("formatted", F.lit(1)).withColumn("turns", F.lit(2))
    out = chat.format_chats(df)
    return {
        r["conv_id"]: r
        for r in out.select(
            "*", chat.read_turns(F.col("formatted")).alias("back"), chat.masked_text(F.col("segments")).alias("loss")
        ).collect()
    }


def test_form(spark):
    got = formatted(spark, [(1, 2, "assistant", "hi"), (1, 1, "user", "b"), (1, 0, "user", "a"), (1, 3, "tool", "42")])
    assert got[1]["formatted"] == "<s>[INST]a[TURN]b[/INST][ASST]hi</s>[ROLE]tool[SEP]42[/ROLE]"
    assert got[1]["loss"] == "hi"


def test_null_empty_tied_and_repeated_rows(spark):
    rows = [(1, 0, "user", None), (1, None, None, "x"), (1, 0, "user", None), (None, 5, "assistant", ""), (1, 0, "assistant", "z")]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["back"]] == [("", "x"), ("assistant", "z"), ("user", ""), ("user", "")]
    assert [(t["role"], t["text"]) for t in got[None]["back"]] == [("assistant", "")]
    assert got[None]["loss"] == ""


def test_no_rows(spark):
    assert formatted(spark, []) == {}


@pytest.mark.parametrize("seed", range(3))
def test_round_trip_of_control_strings(spark, seed):
    rng = random.Random(seed)
    bits = ["<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ASST]", "[TURN]", "[ROLE]", "[SEP]", "[/ROLE]", "\\", "[", "<", "[\\",
            "<\\", "$1", "\n", "a", " ", "é", "INST]", "s>", "👩"]
    rows = []
    for conv in range(20):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "system", "tool", "[SEP]x", "a\\[/ROLE]", ""])
            rows.append((conv, turn, role, "".join(rng.choice(bits) for _ in range(rng.randrange(12)))))
    got = formatted(spark, rows)
    for conv in range(20):
        mine = [(r, t) for c, _, r, t in rows if c == conv]
        assert [(t["role"], t["text"]) for t in got[conv]["back"]] == mine
        assert got[conv]["loss"] == "".join(t for r, t in mine if r == "assistant")
        assert "".join(s["text"] for s in got[conv]["segments"]) == got[conv]["formatted"][3:]


def test_long_conversation(spark):
    rows = [(1, i, ["user", "assistant"][i % 2], "x" * 2000) for i in range(600)]
    got = formatted(spark, rows)[1]
    assert len(got["back"]) == 600 and len(got["loss"]) == 600_000


def test_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, 0, "user", "a")], SCHEMA)
    plan = chat.format_chats(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
