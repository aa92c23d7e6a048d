"""Warping by diagonals against the plain recursion, and the bound that prunes pairs."""

import numpy as np
import pytest

from flowloom.operators import similarity as S

ARRAY = "array<array<double>>"


def plain(a, b):
    best = np.full((len(a) + 1, len(b) + 1), np.inf)
    best[0, 0] = 0.0
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1, j + 1] = ((x - y) ** 2).sum() + min(best[i, j], best[i, j + 1], best[i + 1, j])
    return np.sqrt(best[-1, -1])


@pytest.mark.parametrize("n, m", [(1, 1), (1, 6), (6, 1), (2, 2), (5, 9), (9, 5), (7, 7)])
def test_diagonals_equal_the_recursion(n, m):
    rng = np.random.default_rng(n * 10 + m)
    a, b = rng.normal(size=(20, n, 3)), rng.normal(size=(20, m, 3)) + rng.normal(size=(20, 1, 3)) * 3
    want = [plain(x, y) for x, y in zip(a, b)]
    got = S.warping_distances(a, b)
    assert np.allclose(got, want, rtol=1e-12)
    bound = S.lower_bounds(a, b)
    assert (bound <= got * (1 + 1e-12)).all() and (bound > 0).all()


def test_long_traces_need_no_table():
    """A table of 20,000 x 20,000 distances would take 3.2 GB."""
    a = np.arange(20_000, dtype=float)[None, :, None]
    assert S.warping_distances(a, a)[0] == 0.0


def pairs_of(spark, rows):
    return spark.createDataFrame(rows, f"id int, left {ARRAY}, right {ARRAY}")


def test_mixed_lengths_nulls_and_empty(spark, monkeypatch):
    monkeypatch.setattr(S, "CELLS", 8)
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=(1 + i % 4, 2)).tolist(), rng.normal(size=(1 + i % 3, 2)).tolist()) for i in range(40)]
    got = {r.id: r.dissimilarity for r in S.trace_dissimilarity(
        pairs_of(spark, [*rows, (90, None, [[1.0, 2.0]]), (91, [], [[1.0, 2.0]])]), normalise=False).collect()}
    assert got.pop(90) is None and got.pop(91) is None
    assert all(np.isclose(got[i], plain(np.array(a), np.array(b))) for i, a, b in rows)
    assert S.trace_dissimilarity(pairs_of(spark, [])).count() == 0


@pytest.mark.parametrize("multivariate", [True, False])
@pytest.mark.parametrize("normalise", [True, False])
def test_pruned_search_equals_filter(spark, multivariate, normalise):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=(6, 2)).tolist(), (rng.normal(size=(5, 2)) + (i % 5)).tolist()) for i in range(60)]
    how = {"multivariate": multivariate, "normalise": normalise}
    pairs = pairs_of(spark, rows)
    scored = S.trace_dissimilarity(pairs, **how).select("id", "dissimilarity").collect()
    limit = float(np.median([r.dissimilarity for r in scored]))
    got = {r.id for r in S.similar_traces(pairs, limit, **how).collect()}
    assert got == {r.id for r in scored if r.dissimilarity <= limit} and 0 < len(got) < 60


def test_bound_prunes_far_pairs():
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(100, 30, 2)), rng.normal(size=(100, 30, 2)) + np.repeat([0, 20], 50)[:, None, None]
    limit = S.warping_distances(a[:50], b[:50]).max()
    assert (S.lower_bounds(a, b) > limit).sum() == 50


def test_traces_are_read_from_the_batch_without_objects(spark):
    """Thousands of pairs in one batch: the traced memory stays near the size of their values."""
    import tracemalloc

    import pyarrow as pa

    from flowloom.operators import similarity

    traces = pa.array([[[float(i + j), 1.0, 2.0] for j in range(20)] for i in range(4000)] + [None, []], pa.list_(pa.list_(pa.float64())))
    tracemalloc.start()
    rows = sum(len(some) for some, a, b in similarity._by_lengths(traces, traces))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 4000 and peak < 12 << 20
    sliced = list(similarity._by_lengths(traces.slice(7, 3), traces.slice(9, 3)))
    assert sliced[0][1][0][0][0] == 7.0 and sliced[0][2][0][0][0] == 9.0
