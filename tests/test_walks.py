"""Runs over machines in chunks against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom.operators import machine as M, symbolic as Y, walks
from flowloom.operators.traces import TRACE

EDGES = [("m", "0", "a", "1"), ("m", "1", "a", "2"), ("m", "1", "b", "0"), ("m", "2", "a", "0"), ("m", "2", "b", "2"), ("m", "0", "b", "0"),
         ("m", "2", "c", "3"), ("n", "0", "a", "0"), ("n", "0", "b", "5")]


def plain(model, symbols):
    table = {(s, x): d for m, s, x, d in EDGES if m == model}
    state, path = "0", []
    for x in symbols:
        state = table.get((state, x)) if state is not None else None
        path.append(state)
    return path


@pytest.fixture
def small_chunks(monkeypatch):
    monkeypatch.setattr(walks, "CHUNK", 7)
    monkeypatch.setattr(walks, "FAN", 3)
    monkeypatch.setattr(walks, "BUCKET_ROWS", 100)


def test_symbols_in_chunks(spark, small_chunks):
    rng = random.Random(1)
    traces = [(m, "e", i, [rng.choice("aaaabbb" if i % 3 else "aaabbbbbbbbc") for _ in range(rng.choice([0, 1, 6, 7, 8, 50, 300]))])
              for i in range(40) for m in ("m", "n", "gone")]
    traces.append(("m", "e", 99, [None, "a"]))
    edges = spark.createDataFrame([(*e, 1) for e in EDGES], "model_id string, src string, symbol string, dst string, cnt long")
    packed = spark.createDataFrame(traces, "model_id string, entity string, trace_id long, symbols array<string>")
    got = {}
    for r in Y.walk(packed, edges).orderBy("pos").collect():
        got.setdefault((r.model_id, r.trace_id), []).append(r.state)
    assert got == {(m, i): plain(m, s) for m, _, i, s in traces if s and m != "gone"}
    shares = {r.model_id: (r.n_traces, r.accepted) for r in Y.acceptance(packed, edges).collect()}
    for m in ("m", "n"):
        own = [None not in plain(m, s) for x, _, _, s in traces if x == m]
        assert shares[m] == (len(own), pytest.approx(sum(own) / len(own)))
    assert set(shares) == {"m", "n"}
    assert Y.walk(packed.where("false"), edges).collect() == [] and Y.walk(packed, edges.where("false")).collect() == []


def test_guards_in_chunks(spark, small_chunks):
    """Threshold guards over two attributes; a record that opens no edge or two ends the run."""
    cond = lambda attr, op, bound: {"attr": attr, "op": op, "bound": float(bound)}
    edges = [("g", "root", "0", []), ("g", "0", "1", [[cond(0, "<", 5)], [cond(1, ">=", 9)]]), ("g", "0", "0", [[cond(0, ">=", 5), cond(1, "<", 9)]]),
             ("g", "1", "0", [[cond(0, ">", 2)]]), ("g", "1", "1", [[cond(0, "<=", 2)]]), ("h", "root", "0", [])]
    machines = spark.createDataFrame(edges, f"model_id string, src string, dst string, clauses {M.CLAUSES}")
    rng = random.Random(2)
    traces = {i: [[float(rng.randrange(10)), float(rng.randrange(9 + (i % 10 == 0)))] for _ in range(rng.choice([1, 7, 30, 200]))] for i in range(30)}
    rows = [(m, "e", i, p, a, "kept") for i, t in traces.items() for p, a in enumerate(t) for m in ("g", "h")]
    records = spark.createDataFrame(rows, "model_id string, entity string, trace_id long, pos long, attrs array<double>, note string")

    def state_after(state, a):
        if state == "0":
            one, zero = a[0] < 5 or a[1] >= 9, a[0] >= 5 and a[1] < 9
        else:
            one, zero = a[0] <= 2, a[0] > 2
        return None if one == zero else "1" if one else "0"

    found = M.replay_machines(records, machines)
    assert found.columns == [*records.columns, "state"]
    got = {}
    for r in found.orderBy("pos").collect():
        assert r.note == "kept"
        got.setdefault((r.model_id, r.trace_id), []).append(r.state)
    for i, t in traces.items():
        state, want = "0", []
        for a in t:
            want.append(state)
            state = None if state is None else state_after(state, a)
        assert got["g", i] == want and got["h", i] == ["0"] * len(t)


def test_one_very_long_trace(spark):
    n = 300_000
    edges = spark.createDataFrame([(*e, 1) for e in EDGES[:6]], "model_id string, src string, symbol string, dst string, cnt long")
    symbol = F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "b").otherwise("a")
    trace = spark.range(n).select(F.lit("m").alias("model_id"), F.lit("e").alias("entity"), F.lit(0).cast("long").alias("trace_id"),
                                  F.col("id").alias("pos"), symbol.alias("symbol"))
    want = plain("m", [r.symbol for r in trace.orderBy("pos").collect()])
    found = Y.walk(trace, edges)
    assert [r.state for r in found.orderBy("pos").collect()] == want
    dealt, _ = walks._in_buckets(trace, edges)
    assert dealt.groupBy("model_id", "_bucket").count().count() >= 3 and TRACE == ["entity", "trace_id"]


def test_small_machines_share_a_group(spark):
    rows = [(f"m{i % 30}", "e", 0, i // 30, "ab"[i % 2]) for i in range(300)]
    records = spark.createDataFrame(rows, "model_id string, entity string, trace_id long, pos long, symbol string")
    edges = spark.createDataFrame([(f"m{i}", "0", s, "0") for i in range(29) for s in "ab"], "model_id string, src string, symbol string, dst string")
    dealt, machines = walks._in_buckets(records, edges)
    assert {r._group for r in dealt.collect()} == {0} == {r._group for r in machines.collect()}
    walked = walks.run(records, edges, Y._by_symbol, True).collect()
    assert len(walked) == 290 and {r.state for r in walked} == {"0"}  # the last model has no machine
