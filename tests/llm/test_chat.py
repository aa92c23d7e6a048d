import random

import oracle
from flowloom.llm import chat, queries
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, turns string, formatted long"


def back(spark, rows):
    told = chat.format_chat(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    return {r.conv_id: r for r in told.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                                              chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_round_trip_of_control_strings(spark):
    rng = random.Random(5)
    signs = ["<|", "<", "|", "\\", "[INST]", "[/INST]", "</s>", "<s>", "s>", "INST]", "[", "/", "\n", "é😀", *(chat.START, chat.SEP, chat.TURN, chat.END), "$1"]
    rows = [(c, t, rng.choice(["user", "assistant", "<|x", "", None]), "".join(rng.choice(signs) for _ in range(rng.randrange(9))) if rng.random() < 0.9 else None)
            for c in range(200) for t in range(rng.randrange(1, 6))]
    found = back(spark, rows)
    for c in range(200):
        want = [(r or "", t or "") for k, _, r, t in rows if k == c]
        assert [tuple(x) for x in found[c].turns] == want
        assert found[c].loss == [t for r, t in want if r == "assistant"]


def test_adjacent_turns_are_merged(spark):
    found = back(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, None, "system", "s"), (None, 1, "user", None), (2, 1, "user", "q"), (2, 1, "user", "q")])
    assert found[1].formatted == "<|start|>system<|sep|>s<|end|><|start|>user<|sep|>a<|turn|>b<|end|><|start|>assistant<|sep|>c<|end|>"
    assert [tuple(x) for x in found[None].turns] == [("user", "")]
    assert len(found[2].turns) == 2


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text {i}") for i in range(1500)]
    assert [tuple(x) for x in back(spark, rows)[1].turns] == [(r, t) for _, _, r, t in rows]


def test_empty(spark):
    assert back(spark, []) == {}


def test_equals_sql(spark, sf_small):
    name = "op2_chat_formatting"
    assert oracle.compare(queries.QUERIES[name](spark, sf_small), oracle.connect(sf_small), queries.SQL[name]) == ""
