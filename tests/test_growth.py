"""Work that must not be done again for each reader, pass or file."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

import workload
from flowloom.operators import evaluate as K
from flowloom.operators.detectors import kde
from flowloom.sources import traces as X


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Folder with an ``events`` table of 12 hosts with 60 flows each."""
    folder = str(tmp_path_factory.mktemp("events"))
    kinds = ["click", "view", "purchase", "signup", "error"]
    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, begin + datetime.timedelta(minutes=55 * i), i % 12, kinds[i * 7 % 11 % 5], float(i * 37 % 101) / 4, '{"k": %d}' % (i * 13 % 97))
            for i in range(720)]
    table = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string")
    table.coalesce(1).write.parquet(f"{folder}/events.parquet")
    return folder


@pytest.mark.parametrize("name", ["entity_lof", "baseline_verdicts"])
def test_hosts_are_summed_up_once(spark, events, name):
    found = workload.all_queries()[name](spark, events)
    assert found.count() == 12
    assert not [f for f in found.inputFiles() if "events.parquet" in f]  # reads the stored view, not the flows


def test_trace_files_follow_data_not_entities(spark, tmp_path):
    names = [f"10.0.0.{i}" for i in range(40)] + ["a b%/\tc", "007", "", None]
    rows = [(name, t, p, p + t) for name in names for t in range(2) for p in range(3)]
    traced = spark.createDataFrame(rows, "entity string, trace_id long, pos long, a long").coalesce(1)
    lines = X.trace_lines(traced, ["a"])
    X.write_traces(lines, X.trace_headers(lines, 1), str(tmp_path / "t"))
    assert len(list((tmp_path / "t" / "traces").rglob("part-*"))) <= 8  # not one for each of 44 entities
    read = X.read_traces(spark, str(tmp_path / "t")).collect()
    assert sorted((r.entity or repr(r.entity), r.pos, *r.attrs) for r in read) == sorted((e or repr(e), p, float(a)) for e, _, p, a in rows)


def test_counted_visits_weigh_like_repeated_ones(spark):
    rows = [("m", "e", i // 3, "s" if i % 3 else "sink", i % 2, 1 + i % 4) for i in range(30)]
    table = spark.createDataFrame(rows, "model_id string, entity string, row_idx long, state string, pred int, times int")
    weights = spark.createDataFrame([("m", "s", 0.75, 7)], "model_id string, state string, weight double, visits long")
    repeated = table.withColumn("_", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_")
    once, want = (sorted((r.row_idx, r.pred) for r in K.merge_predictions(*x).collect()) for x in ((table, weights, "times"), (repeated, weights)))
    assert len(once) == 10 and all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-12 for a, b in zip(once, want))


def test_kernels_of_many_states_equal_those_of_each():
    rng = np.random.default_rng(5)
    covs = [(m @ m.T + np.eye(2) * 1e-8).ravel() for m in rng.normal(size=(20, 2, 2))]
    for c in (covs, [*covs, np.array([4e12, 4e12, 4e12, 4e12])]):  # the last has no inverse
        n = rng.integers(3, 90, len(c)).astype(float)
        for (a, b), (x, y) in zip(kde.kernels(n, np.concatenate(c), 2), (kde.kernel(k, v, 2) for k, v in zip(n, c))):
            assert np.array_equal(a, x) and np.isclose(b, y, rtol=1e-15)
