"""Detectors against direct computation on a small fixture."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import evaluate as K, machine as M
from flowloom.operators.detectors import forest, kde, lof, stats
from flowloom.operators.similarity import trace_dissimilarity, warping_distance

POINTS = [(1, 1), (1.2, 0.9), (0.8, 1.1), (1.1, 1.3), (0.9, 0.7), (1.3, 1.2), (0.7, 0.9), (1.05, 0.95), (1.4, 0.8), (0.6, 1.2), (1.15, 1.05), (9, 9)]
SCHEMA = "model_id string, state string, attrs array<double>, id long"


@pytest.fixture(scope="module")
def data(spark):
    train = spark.createDataFrame([("m", "s", list(map(float, p)), i) for i, p in enumerate(POINTS)], SCHEMA)
    test = spark.createDataFrame([("m", "s", [1.0, 1.05], 0), ("m", "s", [5.0, 5.0], 1), ("m", "thin", [1.0, 1.0], 2)], SCHEMA)
    return train, test


def plain_lof(train, query, k):
    x, q = np.array(train, float), np.array(query, float)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1)[:, :k]
    kd = np.take_along_axis(d, near, 1)[:, -1]
    lrd = 1 / (np.maximum(kd[near], np.take_along_axis(d, near, 1)).mean(1) + 1e-10)
    dq = np.sqrt(((q[:, None] - x[None]) ** 2).sum(2))
    nq = np.argsort(dq, axis=1)[:, :k]
    own = 1 / (np.maximum(kd[nq], np.take_along_axis(dq, nq, 1)).mean(1) + 1e-10)
    return lrd[nq].mean(1) / own


@pytest.mark.parametrize("share, k", [(0.3, None), (None, 3), (None, 20)])
def test_lof(data, share, k):
    train, test = data
    fit = lof.fit_lof(train, share=share, k=k)
    rows = {r.id: r for r in lof.score_lof(test, fit, share=share, k=k).collect()}
    used = lof.neighbours(len(POINTS), share, k)
    want = plain_lof(POINTS, [[1.0, 1.05], [5.0, 5.0]], used)
    assert np.allclose([rows[0].score, rows[1].score], want)
    assert rows[0].pred == int(want[0] > 1.5) and rows[1].pred == int(want[1] > 1.5)
    assert rows[2].pred == 1 and rows[2].score is None


def test_copies_of_a_point_fill_the_neighbourhood():
    x, w = np.array([[0.0], [1.0], [5.0]]), np.array([3.0, 2.0, 1.0])
    kd, lrd = lof.fit_points(x, w, 2)
    flat = np.repeat(x, w.astype(int), axis=0)
    d = np.abs(flat - flat.T)
    np.fill_diagonal(d, np.inf)
    near = np.argsort(d, axis=1, kind="stable")[:, :2]
    k_flat = np.sort(d, axis=1)[:, 1]
    lrd_flat = 1 / (np.maximum(k_flat[near], np.take_along_axis(d, near, 1)).mean(1) + 1e-10)
    assert np.allclose(kd, k_flat[[0, 3, 5]]) and np.allclose(lrd, lrd_flat[[0, 3, 5]])


def test_kde(data):
    train, test = data
    fit = kde.fit_kde(train, 2)
    rows = {r.id: r for r in kde.score_kde(test, train, fit).collect()}
    x = np.array(POINTS, float)
    h = (np.cov(x.T) + np.eye(2) * 1e-8) * len(x) ** (-2 / 6)
    inv, norm = np.linalg.inv(h), len(x) * math.sqrt(np.linalg.det(2 * np.pi * h))
    density = lambda q: np.exp(-0.5 * np.einsum("ij,jk,ik->i", q - x, inv, q - x)).sum() / norm
    assert abs(rows[0].score - density(np.array([1.0, 1.05]))) < 1e-9
    own = [density(p) for p in x]
    limit = min(own) + (max(own) - min(own)) / 10
    assert rows[1].pred == int(density(np.array([5.0, 5.0])) < limit) and rows[2].pred == 1


def test_forest_is_repeatable_and_finds_the_outlier(spark, data):
    train, test = data
    run = lambda: forest.fit_forest(train, 2, ["id"], share=0.9)
    nodes = run()
    assert sorted(map(tuple, nodes.collect()), key=str) == sorted(map(tuple, run().collect()), key=str)
    per_tree = nodes.filter("attr is null").groupBy("tree").agg(F.sum("size").alias("n")).collect()
    assert len(per_tree) == 100 and {r.n for r in per_tree} == {11}  # every sample has ceil(0.9 * 12) visits
    assert nodes.agg(F.max("node")).first()[0] < 2 ** 5  # depth at most ceil(log2(11)) = 4
    far = spark.createDataFrame([("m", "s", [9.5, 9.5], 0), ("m", "s", [1.0, 1.0], 1), ("m", "thin", [1.0, 1.0], 2)], SCHEMA)
    rows = {r.id: r for r in forest.score_forest(far, nodes).collect()}
    assert rows[0].score > 0.6 > rows[1].score and rows[0].pred == 1 and rows[2].pred == 1


@pytest.mark.parametrize("whole", [1 << 17, 20])
def test_forest_in_buckets_scores_like_levels(spark, whole):
    rng = np.random.default_rng(5)
    value = lambda: None if rng.random() < 0.05 else float("nan") if rng.random() < 0.05 else float(rng.integers(0, 9))
    rows = [("m", "ab"[i % 2] if i < 60 else "cde"[i % 3] if i < 75 else None, [value(), value()], i) for i in range(78)]
    train = spark.createDataFrame(rows, SCHEMA)
    test = spark.createDataFrame([("m", "abcdx"[i % 5], [value(), value()] if i % 20 else None, i) for i in range(150)], SCHEMA)
    want = forest.score_forest(test, forest.fit_forest(train, 2, ["id"], trees=9), trees=9)
    got = forest.detect_forest(test, train, 2, ["id"], trees=9, whole=whole)
    given = lambda df: [(r.id, r.score and round(r.score, 9), r.pred) for r in df.orderBy("id").collect()]
    assert given(got) == given(want) and any(r[1] for r in given(got))


def test_forest_moves_a_visit_not_its_trees(spark):
    train = spark.createDataFrame([("m", str(i % 40), [float(i % 17), float(i % 5)], i) for i in range(4000)], SCHEMA)
    plan = forest.detect_forest(train, train, 2, ["id"], trees=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "tree" not in plan


def test_forest_paths(spark):
    """One split on two values: every path has length 1."""
    train = spark.createDataFrame([("m", "s", [float(i)], i) for i in (0, 1, 2, 3)], SCHEMA)
    nodes = forest.fit_forest(train, 1, ["id"], trees=10, share=0.5)
    scores = forest.score_forest(train, nodes, trees=10).collect()
    assert all(abs(r.score - 0.5) < 1e-12 for r in scores)  # depth 1, expected depth 1


def test_majority_and_manual_band(data):
    train, _ = data
    fit = stats.fit_stats(train.filter("id < 11"), 2)
    probe = train.sparkSession.createDataFrame([("m", "s", [9.0, 1.0], 0), ("m", "s", [9.0, 9.0], 1)], SCHEMA)
    pred = lambda **o: [r.pred for r in stats.score_stats(probe, fit, **o).orderBy("id").collect()]
    assert pred() == [1, 1] and pred(rule="all") == [0, 1] and pred(rule="majority") == [0, 1]
    assert pred(factor=1000.0) == [0, 0]


def test_weights_and_share_bounds(spark):
    states = spark.createDataFrame([("m", "a", 9), ("m", "b", 0), ("n", "a", 1)], "model_id string, state string, visits long")
    got = {(r.model_id, r.state): r.weight for r in M.state_weights(states).collect()}
    assert got == {("m", "a"): 1.0, ("m", "b"): 0.1, ("n", "a"): 1.0}


def test_warping():
    a, b = np.array([[0.0], [1.0], [2.0]]), np.array([[0.0], [0.0], [1.0], [2.0]])
    assert warping_distance(a, b) == 0.0
    assert abs(warping_distance(a, b + 1) - math.sqrt(2)) < 1e-12


def test_dissimilarity_modes(spark):
    pairs = spark.createDataFrame([([[0.0, 5.0], [2.0, 5.0]], [[0.0, 5.0], [4.0, 5.0]])], "left array<array<double>>, right array<array<double>>")
    score = lambda **o: trace_dissimilarity(pairs, **o).first().dissimilarity
    assert abs(score() - 0.5) < 1e-12 and abs(score(normalise=False) - 2.0) < 1e-12
    assert abs(score(multivariate=False) - 0.25) < 1e-12


def test_outcomes_add_up_and_undefined_metrics(spark):
    rows = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 1), (0, 0)], "truth int, verdict int")
    counts = K.with_metrics(K.verdict_confusion(rows, [])).first()
    assert (counts.tp, counts.tn, counts.fp, counts.fn) == (1, 2, 1, 1) and counts.accuracy == 0.6
    none = K.with_metrics(spark.createDataFrame([(0, 3, 0, 0)], "tp long, tn long, fp long, fn long")).first()
    assert (none.precision, none.recall) == (-1.0, -1.0)


def test_kernel_of_attributes_that_determine_each_other():
    """A covariance without inverse still gives a density that falls with the distance."""
    cov = np.array([[1e18, 1e18], [1e18, 1e18]])
    whiten, norm = kde.kernel(50.0, cov.ravel(), 2)
    assert np.isfinite(whiten).all() and np.isfinite(norm) and norm > 0
    length = lambda *x: float(np.linalg.norm(whiten @ np.array(x)))
    assert length(1e9, 1e9) < length(2e9, 2e9) < length(1e9, -1e9)


@pytest.mark.parametrize("rule, want", [("any", [0, 1, 1, 1]), ("majority", [0, 0, 0, 1]), ("all", [0, 0, 0, 0])])
def test_tied_majority_is_no_hit(spark, rule, want):
    fit = spark.createDataFrame([("m", "s", 9, [0.0] * 4, [1.0] * 4)], "model_id string, state string, n long, mean array<double>, std array<double>")
    rows = [("m", "s", i, [9.0 if j < k else 0.0 for j in range(4)]) for i, k in enumerate((0, 1, 2, 3))]
    visits = spark.createDataFrame(rows, "model_id string, state string, pos int, attrs array<double>")
    assert [r.pred for r in stats.score_stats(visits, fit, rule=rule).orderBy("pos").collect()] == want
