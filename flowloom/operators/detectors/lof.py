"""Local outlier factor in novelty mode: fitted on training visits, applied to others."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil
from typing import Any, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ...session import freeze, group_sizes
from .blocks import BLOCK_ROWS, distances, distinct_points, kth_distance, matrix, mean_of_k, nearest_sum, pack_blocks, spread
from .boxes import near_pairs, pack_cut, reach, tree
from .stats import MIN_VISITS, STATE, thin_state

THRESHOLD = 1.5
_TINY = 1e-10
FEW = 256  # neighbours that a task keeps for each query instead of counting bytes


def neighbours(n: int, share: float | None, k: int | None) -> int:
    """Number of neighbours for a group of ``n`` points: a share of it or a fixed number."""
    wanted = ceil(share * n) if share is not None else k
    return max(1, min(wanted, n - 1))


def _without_self(w: np.ndarray, same_block: bool) -> np.ndarray:
    if same_block:
        w = w.copy()
        np.fill_diagonal(w, w.diagonal() - 1)
    return w


def fit_lof(
    visits: DataFrame, keys: list[str] = STATE, share: float | None = 0.1, k: int | None = None,
    min_visits: int = MIN_VISITS, rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Reference blocks with the k-distance ``kd`` and local density ``lrd`` of each point.

    Groups of more than ``rows`` distinct points are cut into blocks of near points; a block meets only blocks that its
    points' k-distances can reach.
    """
    points = distinct_points(visits, keys)
    small, large = _by_size(points, keys, rows)
    blocks = pack_blocks(small, keys, rows).drop("points").filter(F.col("n") > min_visits)
    fitted = blocks.withColumn("_fit", _fit_one(share, k)("xs", "ws", "n")).select(*blocks.columns, "_fit.kd", "_fit.lrd")
    empty = F.array().cast("array<double>")
    fitted = fitted.withColumns({"lo": empty, "hi": empty})
    if large is None:
        return fitted
    cut = freeze(pack_cut(large, keys, rows).drop("points"))  # read by every pass
    with_kd, pairs = _pruned_kd(cut, cut, keys, share, k, True)
    with_lrd = _stream(with_kd, with_kd, pairs, keys, ["lrd"], _lrd_pass(share, k), ["kd"])
    return fitted.unionByName(freeze(with_lrd.withColumn("n_blocks", F.lit(2)).select(*fitted.columns)))


def _by_size(points: DataFrame, keys: list[str], rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Points of groups of at most ``rows`` points, and those of the others if there are any."""
    over = freeze(group_sizes(points, keys).filter(F.col("_rows") > rows).select(*keys))
    if over.isEmpty():
        return points, None
    return points.join(over, keys, "left_anti"), points.join(over, keys, "left_semi")


def score_lof(
    visits: DataFrame, fit: DataFrame, keys: list[str] = STATE, share: float | None = 0.1, k: int | None = None,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Adds ``score`` (the factor) and ``pred`` (factor above 1.5, or a state without a fit)."""
    asked = distinct_points(visits, keys)
    queries = pack_blocks(asked, keys, rows)
    queries = queries.select(*keys, F.col("block").alias("q_block"), F.col("xs").alias("q_xs"), "points",
                             F.size("ws").alias("q_rows"))
    single = spread(queries.join(fit.filter(F.col("n_blocks") == 1), keys), *keys, "q_block")
    scored = single.withColumn("lof", _score_one(share, k)("q_xs", "q_rows", "xs", "ws", "kd", "lrd", "n"))
    scored = scored.select(*keys, "points", "lof")
    large = fit.filter(F.col("n_blocks") > 1)
    if not large.isEmpty():
        large = freeze(large)
        sizes = large.groupBy(*keys).agg(F.max("n").alias("n"))
        ask = pack_cut(asked.join(sizes.select(*keys), keys, "left_semi"), keys, rows).drop("n").join(sizes, keys)
        ask = freeze(ask.withColumn("ws", F.transform("ws", lambda w: F.lit(1.0))))
        with_kd, pairs = _pruned_kd(ask, large, keys, share, k, False)
        with_lof = _stream(with_kd, large, pairs, keys, ["lof"], _lof_pass(share, k), ["kd", "lrd"])
        scored = scored.unionByName(with_lof.select(*keys, "points", "lof"))
    flat = scored.select(*keys, F.explode(F.arrays_zip("points", "lof")).alias("_s"))
    flat = flat.select(*keys, F.col("_s.points").alias("attrs"), F.col("_s.lof").alias("score"))
    joined = visits.join(flat, [*keys, "attrs"], "left")
    return joined.select(*visits.columns, "score", thin_state(F.col("score") > THRESHOLD).alias("pred"))


# ---- groups whose references fit one block ----

def _fit_one(share, k):
    @F.pandas_udf("struct<kd:array<double>,lrd:array<double>>")
    def fit(xs: pd.Series, ws: pd.Series, n: pd.Series) -> pd.DataFrame:
        kds, lrds = [], []
        for x, w, size in zip(xs, ws, n):
            kd, lrd = fit_points(matrix(x, len(w)), np.asarray(w), neighbours(int(size), share, k))
            kds.append(kd)
            lrds.append(lrd)
        return pd.DataFrame({"kd": kds, "lrd": lrds})

    return fit


def fit_points(x: np.ndarray, w: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, x)
    weights = _without_self(np.broadcast_to(w, d.shape), True)
    kd = kth_distance(d, weights, k)
    reach = np.maximum(kd[None, :], d)
    return kd, 1.0 / (mean_of_k(*nearest_sum(d, weights, kd, reach), k) + _TINY)


def score_points(q, x, w, kd, lrd, k: int) -> np.ndarray:
    d = distances(q, x)
    weights = np.broadcast_to(w, d.shape)
    limit = kth_distance(d, weights, k)
    reach = mean_of_k(*nearest_sum(d, weights, limit, np.maximum(kd[None, :], d)), k)
    density = mean_of_k(*nearest_sum(d, weights, limit, np.broadcast_to(lrd, d.shape)), k)
    return density * (reach + _TINY)


def _score_one(share, k):
    @F.pandas_udf("array<double>")
    def score(q: pd.Series, q_rows: pd.Series, xs: pd.Series, ws: pd.Series, kd: pd.Series, lrd: pd.Series,
              n: pd.Series) -> pd.Series:
        return pd.Series([
            score_points(matrix(a, r), matrix(x, len(w)), np.asarray(w), np.asarray(c), np.asarray(l),
                         neighbours(int(size), share, k))
            for a, r, x, w, c, l, size in zip(q, q_rows, xs, ws, kd, lrd, n)
        ])

    return score


# ---- larger groups: the reference blocks in reach stream past one query block ----

def _stream(
    queries: DataFrame, refs: DataFrame, pairs: DataFrame, keys: list[str], out: list[str], start, ref_columns: list[str],
) -> DataFrame:
    """One pass over ``pairs(keys, block, r_block)``. ``start(query row)`` gives an object with ``take(block)`` and
    ``finish()``; the arrays of ``finish`` replace or extend the columns ``out``."""
    right = refs.select(
        *keys, F.col("block").alias("r_block"), F.col("xs").alias("r_xs"), F.col("ws").alias("r_ws"),
        *[F.col(c).alias(f"r_{c}") for c in ref_columns],
    )
    kept = queries.columns
    schema = queries.withColumns({c: F.lit(None).cast("array<double>") for c in out}).schema
    paired = queries.join(pairs.join(right, [*keys, "r_block"]), [*keys, "block"])

    def run(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, row = None, None
        for batch in batches:
            for record in batch.to_dict("records"):
                if state is None:
                    row = {c: record[c] for c in kept}
                    state = start(record)
                state.take(record)
        row.update(zip(out, state.finish()))
        yield pd.DataFrame({c: [v] for c, v in row.items()})

    return paired.groupBy(*keys, "block").applyInPandas(run, schema)


def _need(share, k) -> Column:
    """``neighbours`` as an expression over ``n``."""
    wanted = F.ceil(F.lit(float(share)) * F.col("n")) if share is not None else F.lit(k)
    return F.greatest(F.lit(1), F.least(wanted, F.col("n") - 1)).cast("double")


def _pruned_kd(queries, refs, keys, share, k, fitting) -> tuple[DataFrame, DataFrame]:
    """Queries with their k-distance ``kd``, and the pairs of blocks within it.

    A bound on the k-distances of a block comes from the boxes alone and drops most pairs before any distance is taken; the
    exact k-distances then drop the pairs that the sums do not need.
    """
    nodes = tree(refs, keys)
    asked = queries.withColumn("_need", _need(share, k) + (1.0 if fitting else 0.0))  # a reference is no neighbour of itself
    bound = queries.join(reach(asked, nodes, keys, "_need"), [*keys, "block"])
    pairs = near_pairs(bound, nodes, keys)
    found = _few_kd(queries, refs, pairs, keys, k, fitting) if share is None and k <= FEW else _select_kd(queries, refs, pairs, keys, share, k, fitting)
    exact = found.withColumn("reach2", F.pow(F.array_max("kd"), 2))
    return found, near_pairs(exact, nodes, keys)


def _few_kd(queries, refs, pairs, keys, k, fitting) -> DataFrame:
    """k-distance of each query for a small fixed ``k``: one pass that keeps the nearest ``k`` + 1 references."""
    return freeze(_stream(queries, refs, pairs, keys, ["kd"], _nearest_pass(k, fitting), []))


def _select_kd(queries, refs, pairs, keys, share, k, fitting) -> DataFrame:
    """k-distance of each query among references of any number.

    Non-negative doubles sort like their bit patterns, so the k-th smallest
    distance is found one byte at a time from counts: eight passes, each of
    which keeps 256 counts per query, whatever ``k`` is.
    """
    found = queries.withColumns({c: F.transform("ws", lambda w: F.lit(0.0)) for c in ("kd", "left")})
    for shift in range(56, -1, -8):
        found = freeze(_stream(found, refs, pairs, keys, ["kd", "left"], _digit_pass(share, k, shift, fitting), []))
    return found.drop("left")


class _Nearest:
    """The nearest references of each query so far, with their weights."""

    def __init__(self, q, k, own_block):
        self.q, self.k, self.own = q, k, own_block
        self.d, self.w = np.zeros((len(q), 0)), np.zeros((len(q), 0))

    def take(self, r) -> None:
        d = distances(self.q, matrix(r["r_xs"], len(r["r_ws"])))
        w = _without_self(np.broadcast_to(np.asarray(r["r_ws"]), d.shape), r["r_block"] == self.own)
        d, w = np.concatenate([self.d, d], axis=1), np.concatenate([self.w, w], axis=1)
        if d.shape[1] > self.k + 1:  # weights are 1 or more, but for the point itself
            nearest = np.argpartition(d, self.k, axis=1)[:, :self.k + 1]
            d, w = np.take_along_axis(d, nearest, axis=1), np.take_along_axis(w, nearest, axis=1)
        self.d, self.w = d, w

    def finish(self):
        return [kth_distance(self.d, self.w, self.k)]


class _Digit:
    """Counts references by the next byte of their distance, inside the bytes already known."""

    def __init__(self, q, at, left, shift, own_block):
        self.q, self.bits, self.left, self.shift, self.own = q, at.view(np.int64).copy(), left, shift, own_block
        self.counts = np.zeros((len(q), 256))

    def take(self, r) -> None:
        d = distances(self.q, matrix(r["r_xs"], len(r["r_ws"])))
        w = _without_self(np.broadcast_to(np.asarray(r["r_ws"]), d.shape), r["r_block"] == self.own)
        bits = d.view(np.int64) >> self.shift
        known = (bits >> 8) == (self.bits >> self.shift >> 8)[:, None]
        place = np.arange(len(d))[:, None] * 256 + (bits & 255)
        self.counts += np.bincount(place[known], weights=w[known], minlength=self.counts.size).reshape(-1, 256)

    def finish(self):
        reached = np.cumsum(self.counts, axis=1)
        byte = np.argmax(reached >= self.left[:, None], axis=1)
        before = np.where(byte > 0, np.take_along_axis(reached, np.maximum(byte - 1, 0)[:, None], axis=1)[:, 0], 0.0)
        return (self.bits | (byte << self.shift)).view(np.float64), self.left - before


class _Sums:
    """Sums over the k nearest references of one or two values."""

    def __init__(self, q, kd, k, own_block, with_density):
        self.q, self.kd, self.k, self.own = q, kd, k, own_block
        self.reach = [np.zeros(len(q)) for _ in range(4)]
        self.density = [np.zeros(len(q)) for _ in range(4)] if with_density else None

    def take(self, r) -> None:
        d = distances(self.q, matrix(r["r_xs"], len(r["r_ws"])))
        w = _without_self(np.broadcast_to(np.asarray(r["r_ws"]), d.shape), r["r_block"] == self.own)
        reach = np.maximum(np.asarray(r["r_kd"])[None, :], d)
        self.reach = [a + b for a, b in zip(self.reach, nearest_sum(d, w, self.kd, reach))]
        if self.density is not None:
            lrd = np.broadcast_to(np.asarray(r["r_lrd"]), d.shape)
            self.density = [a + b for a, b in zip(self.density, nearest_sum(d, w, self.kd, lrd))]

    def finish(self):
        reach = mean_of_k(*self.reach, self.k) + _TINY
        return [1.0 / reach if self.density is None else mean_of_k(*self.density, self.k) * reach]


def _digit_pass(share, k, shift, fitting):
    def start(r):
        q = matrix(r["xs"], len(r["ws"]))
        first = np.full(len(q), float(neighbours(int(r["n"]), share, k)))
        left = first if shift == 56 else np.array(r["left"], dtype=float)
        return _Digit(q, np.array(r["kd"], dtype=float), left, shift, r["block"] if fitting else None)

    return start


def _nearest_pass(k, fitting):
    def start(r):
        size = neighbours(int(r["n"]), None, k)
        return _Nearest(matrix(r["xs"], len(r["ws"])), size, r["block"] if fitting else None)

    return start


def _lrd_pass(share, k):
    def start(r):
        size = neighbours(int(r["n"]), share, k)
        return _Sums(matrix(r["xs"], len(r["ws"])), np.asarray(r["kd"]), size, r["block"], False)

    return start


def _lof_pass(share, k):
    def start(r):
        size = neighbours(int(r["n"]), share, k)
        return _Sums(matrix(r["xs"], len(r["ws"])), np.asarray(r["kd"]), size, None, True)

    return start
