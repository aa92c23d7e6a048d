"""Dissimilarity of two traces by dynamic time warping.

The smallest costs are filled in by diagonals: all cells of a diagonal depend on
the two diagonals before it only, so a diagonal is one array operation, for all
pairs of equal lengths at once. Distances are taken when their diagonal is
reached; memory grows with the sum of two lengths and not with their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import ship

CELLS = 1 << 20  # values held at once for pairs of equal lengths


def warping_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of the smallest sums of squared distances along warping paths, for traces ``a[p]`` and ``b[p]``.

    The arrays are (pairs, records, attributes); lengths of a and b may differ, none is 0.
    """
    pairs, n, m = len(a), a.shape[1], b.shape[1]
    older = np.full((pairs, n + 1), np.inf)  # by records of a, shifted by one
    newer = np.full((pairs, n + 1), np.inf)
    for diagonal in range(n + m - 1):
        low, high = max(0, diagonal - m + 1), min(diagonal, n - 1)
        cost = ((a[:, low:high + 1] - b[:, diagonal - high:diagonal - low + 1][:, ::-1]) ** 2).sum(axis=2)
        here = np.full((pairs, n + 1), np.inf)
        if diagonal == 0:
            here[:, 1] = cost[:, 0]
        else:
            left, up, both = newer[:, low + 1:high + 2], newer[:, low:high + 1], older[:, low:high + 1]
            here[:, low + 1:high + 2] = cost + np.minimum(np.minimum(left, up), both)
        older, newer = newer, here
    return np.sqrt(newer[:, n])


def warping_distance(a: np.ndarray, b: np.ndarray) -> float:
    return float(warping_distances(a[None], b[None])[0])


def lower_bounds(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Never above the warping distance: each record meets some record of the other trace, so it stays at least as far
    away as the box around that trace; the first records meet, and so do the last."""

    def outside(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = y.min(axis=1, keepdims=True), y.max(axis=1, keepdims=True)
        away = (np.maximum(np.maximum(low - x, x - high), 0.0) ** 2).sum(axis=2)
        ends = ((x[:, [0, -1]] - y[:, [0, -1]]) ** 2).sum(axis=2)
        if x.shape[1] == 1:
            return np.maximum(away[:, 0], ends.max(axis=1))
        return ends.sum(axis=1) + away[:, 1:-1].sum(axis=1) if y.shape[1] > 1 else away.sum(axis=1)

    return np.sqrt(np.maximum(outside(a, b), outside(b, a)))


def _scaled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each attribute of a pair between 0 and 1 over both traces."""
    low = np.minimum(a.min(axis=1), b.min(axis=1))[:, None]
    span = np.maximum(a.max(axis=1), b.max(axis=1))[:, None] - low
    span = np.where(span == 0, 1.0, span)
    return (a - low) / span, (b - low) / span


def _flat(traces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Records of each trace (0 for a null one), its first record, the first value of each record (and the total), and the values."""
    records = traces.values
    edge, inner = traces.offsets.to_numpy(), records.offsets.to_numpy()
    values = records.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    return np.where(traces.is_null().to_numpy(zero_copy_only=False), 0, np.diff(edge)), edge[:-1], inner, values


def _by_lengths(x: pa.Array, y: pa.Array):
    """Rows, left and right traces of pairs with equal lengths, a bounded number of values at a time.

    Values are taken from the batch's own buffers, so no record becomes an object.
    """
    sides = [_flat(x), _flat(y)]
    rows = np.flatnonzero((sides[0][0] > 0) & (sides[1][0] > 0))
    if not len(rows):
        return
    n, first, inner, _ = sides[0]
    shape = np.column_stack([n[rows], sides[1][0][rows], np.diff(inner)[first[rows]]])
    shapes, kind = np.unique(shape, axis=0, return_inverse=True)
    for number, (n, m, width) in enumerate(shapes.tolist()):
        own = rows[kind.ravel() == number]
        step = max(1, CELLS // ((n + m) * max(width, 1)))
        for at in range(0, len(own), step):
            some = own[at:at + step]
            found = []
            for (_, first, inner, values), long in zip(sides, (n, m)):
                record = first[some][:, None] + np.arange(long)
                if (inner[record + 1] - inner[record] != width).any():
                    raise ValueError("records of a pair of traces differ in their number of attributes")
                found.append(values[inner[record][:, :, None] + np.arange(width)])
            yield some, *found


def _dissimilarity(left: str, right: str, multivariate: bool, normalise: bool, limit: float | None) -> Column:
    @F.arrow_udf("double")
    def compare(x: pa.Array, y: pa.Array) -> pa.Array:
        out = np.full(len(x), np.nan)
        for rows, a, b in _by_lengths(x, y):
            if normalise:
                a, b = _scaled(a, b)
            parts = [(a, b)] if multivariate else [(a[:, :, [j]], b[:, :, [j]]) for j in range(a.shape[2])]
            if limit is not None:
                bound = np.mean([lower_bounds(*p) for p in parts], axis=0)
                near = bound <= limit * (1 + 1e-9)
                rows, parts = rows[near], [(p[near], q[near]) for p, q in parts]
            if len(rows):
                out[rows] = np.mean([warping_distances(*p) for p in parts], axis=0)
        return pa.array(out, mask=np.isnan(out))

    return compare(left, right)


def trace_dissimilarity(
    pairs: DataFrame, left: str = "left", right: str = "right", multivariate: bool = True, normalise: bool = True
) -> DataFrame:
    """Adds ``dissimilarity`` to rows that hold two traces as ``array<array<double>>``.

    The pairs are given; they are not made here. NULL where a trace is NULL or without records.
    """
    ship(pairs.sparkSession)
    return pairs.withColumn("dissimilarity", _dissimilarity(left, right, multivariate, normalise, None))


def similar_traces(
    pairs: DataFrame, limit: float, left: str = "left", right: str = "right", multivariate: bool = True,
    normalise: bool = True,
) -> DataFrame:
    """The pairs with ``dissimilarity`` up to ``limit``; only those whose lower bound allows it are warped."""
    ship(pairs.sparkSession)
    scored = pairs.withColumn("dissimilarity", _dissimilarity(left, right, multivariate, normalise, limit))
    return scored.filter(F.col("dissimilarity") <= limit)
