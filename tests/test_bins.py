"""Exact clustering costs against dynamic programming over all splits."""

import numpy as np
import pytest

from flowloom.operators import discretise as D


def brute(values, kmax):
    v = np.sort(np.asarray(values, float))
    n = len(v)
    run = np.array([[((v[i:j + 1] - v[i:j + 1].mean()) ** 2).sum() if i <= j else 0.0 for j in range(n)] for i in range(n)])
    best, out = run[0], [run[0, -1]]
    for _ in range(2, kmax + 1):
        best = np.array([min(best[j], *(best[i - 1] + run[i, j] for i in range(1, j + 1))) if j else 0.0 for j in range(n)])
        out.append(best[-1])
    return out


def costs_of(spark, values, kmax):
    df = spark.createDataFrame([(x,) for x in values], "v double")
    return [r.cost for r in D.elbow(df, "v", kmax).orderBy("k").collect()]


@pytest.mark.parametrize("fan, block", [(256, 1024), (3, 4)])
def test_costs_equal_all_splits(spark, monkeypatch, fan, block):
    monkeypatch.setattr(D, "FAN", fan)
    monkeypatch.setattr(D, "BLOCK", block)
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(c, 2, 12) for c in (0, 30, 90)]).round(1)
    values = np.concatenate([values, values[:9], np.arange(8)])  # repeats, and even distances with equal splits
    assert np.allclose(costs_of(spark, values.tolist(), 4), brute(values, 4), rtol=1e-9)


def test_large_values_do_not_cancel(spark):
    base = 1e9
    values = [base + x for x in (0, 1, 2, 10, 11, 12, 20, 21, 22)]
    assert np.allclose(costs_of(spark, values, 3), [x for x in brute(np.array(values) - base, 3)], rtol=1e-6)


def test_few_values_nulls_and_none(spark):
    assert costs_of(spark, [], 3) == [0.0, 0.0, 0.0]
    assert costs_of(spark, [None, float("nan")], 2) == [0.0, 0.0]
    assert costs_of(spark, [5.0, 5.0, None], 2) == [0.0, 0.0]
    assert np.allclose(costs_of(spark, [0.0, -0.0, 4.0, 4.0, None], 4), [16.0, 0.0, 0.0, 0.0])


def test_rounds_meet_few_pairs():
    """Each round solves fewer than FAN values between two solved ones."""
    for n in (2, 255, 256, 257, 70_000, 10_000_000):
        steps = D._steps(n)
        assert steps[-1] == 1 and n / steps[0] <= D.FAN
        assert all(a / b <= D.FAN and a % b == 0 for a, b in zip(steps, steps[1:]))


def test_knee_and_limits(spark):
    rows = [(float(c + d),) for c in (0, 100, 200) for d in range(10)]
    df = spark.createDataFrame(rows, "v double")
    assert D.knee(D.elbow(df, "v", 6)) == 3
    assert np.allclose(D.elbow_limits(df, "v", 6).first().limits, np.percentile([r[0] for r in rows], [100 / 3, 200 / 3]))
    assert D.elbow_limits(df.filter("v < 1"), "v", 6).first().limits == []
