"""Gaussian kernel density per state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any, Tuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ...session import freeze
from .blocks import BLOCK_ROWS, distinct_points, matrix, pack_blocks, spread
from .boxes import descend, most_square, near_pairs, pack_cut, tree
from .lof import _by_size
from .stats import MIN_VISITS, STATE, spread_attrs, thin_state

RIDGE = 1e-8  # variance of the 1e-4 noise the method adds to its training points

FLOOR = 1e-12  # least eigenvalue of a covariance without inverse, as a share of the largest


def fit_covariance(visits: DataFrame, width: int) -> DataFrame:
    """``(model_id, state, n, cov)``: row-major sample covariance with the ridge on its diagonal."""
    cols = [f"a{i}" for i in range(width)]
    cells = [
        F.covar_samp(a, b) + (F.lit(RIDGE) if a == b else F.lit(0.0)) for a in cols for b in cols
    ]
    fitted = spread_attrs(visits, width).groupBy(*STATE).agg(
        F.count(F.lit(1)).alias("n"), F.array(*cells).alias("cov")
    )
    return fitted.filter(F.col("n") > MIN_VISITS)


def kernel(n: float, cov: np.ndarray, width: int) -> tuple[np.ndarray, float]:
    """Whitening matrix and normalisation of the kernel; bandwidth ``n ** (-1 / (width + 4))``.

    Attributes that determine each other leave a covariance without inverse, beside whose variances the ridge is lost:
    its smallest eigenvalues are raised to ``FLOOR`` of the largest.
    """
    bandwidth = matrix(cov, width) * n ** (-2.0 / (width + 4))
    try:
        root = np.linalg.cholesky(bandwidth)
    except np.linalg.LinAlgError:
        values, axes = np.linalg.eigh(bandwidth)
        deviation = np.sqrt(np.maximum(values, FLOOR * values[-1]))
        norm = (2 * np.pi) ** (width / 2) * np.prod(deviation) * n
        return axes.T / deviation[:, None], norm
    norm = (2 * np.pi) ** (width / 2) * np.prod(np.diag(root)) * n
    return np.linalg.inv(root), norm


def kernels(n: np.ndarray, cov: np.ndarray, width: int) -> list[tuple[np.ndarray, float]]:
    """``kernel`` of many states at once; those without inverse make all go one by one."""
    scale = np.array([float(a) ** (-2.0 / (width + 4)) for a in n])  # powers of arrays may differ from those of numbers in the last bit
    bandwidth = matrix(cov, len(n) * width).reshape(len(n), width, width) * scale[:, None, None]
    try:
        root = np.linalg.cholesky(bandwidth)
    except np.linalg.LinAlgError:
        return [kernel(float(a), c, width) for a, c in zip(n, matrix(cov, len(n)))]
    norm = (2 * np.pi) ** (width / 2) * np.prod(np.diagonal(root, axis1=1, axis2=2), axis=1) * n
    return list(zip(np.linalg.inv(root), norm))


def _kernels(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the kernels of whitened references at each whitened query."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return (np.exp(-0.5 * total) * w).sum(1)


def densities(queries: DataFrame, refs: DataFrame, cov: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """``(model_id, state, attrs, density)`` of the distinct query points."""
    asked = distinct_points(queries, STATE)
    small, large = _by_size(distinct_points(refs, STATE), STATE, rows)
    ask = pack_blocks(asked, STATE, rows)
    ask = ask.select(*STATE, "block", F.col("xs").alias("q_xs"), F.size("ws").alias("q_rows"), "points")
    known = pack_blocks(small, STATE, rows).select(*STATE, "xs", "ws").join(cov, STATE)

    @F.pandas_udf("array<double>")
    def one(q: pd.Series, r: pd.Series, x: pd.Series, w: pd.Series, n: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        if not len(n):
            return pd.Series(out)
        width = len(x.iloc[0]) // len(w.iloc[0])
        own = kernels(n.to_numpy(float), np.concatenate(c.tolist()), width)
        for q_, r_, x_, w_, (whiten, norm) in zip(q, r, x, w, own):
            points = matrix(x_, len(w_))
            out.append(_kernels(matrix(q_, r_) @ whiten.T, points @ whiten.T, np.asarray(w_)) / norm)
        return pd.Series(out)

    single = spread(ask.join(known, STATE), *STATE, "block")
    found = single.select(*STATE, "points", one("q_xs", "q_rows", "xs", "ws", "n", "cov").alias("density"))
    if large is not None:
        found = found.unionByName(_streamed(asked.join(large.select(*STATE).distinct(), STATE, "left_semi"), large, cov, rows))
    flat = found.select(*STATE, F.explode(F.arrays_zip("points", "density")).alias("_s"))
    return flat.select(*STATE, F.col("_s.points").alias("attrs"), F.col("_s.density").alias("density"))


def _whitened(points: DataFrame, cov: DataFrame) -> DataFrame:
    """Adds ``at``: the point in units of the kernel's deviations."""
    @F.pandas_udf("array<double>")
    def at(x: pd.Series, n: pd.Series, c: pd.Series) -> pd.Series:
        out, known = [], {}
        for x_, n_, c_ in zip(x, n, c):
            name = (n_, bytes(memoryview(np.asarray(c_, float))))
            if name not in known:
                known[name] = kernel(float(n_), c_, len(x_))[0]
            out.append(known[name] @ np.asarray(x_, float))
        return pd.Series(out)

    return points.join(cov, STATE).withColumn("at", at("attrs", "n", "cov")).drop("n", "cov")


LOST = 54 * float(np.log(2))  # a sum's last bit, as a logarithm


def _streamed(asked: DataFrame, refs: DataFrame, cov: DataFrame, rows: int) -> DataFrame:
    """Densities of groups of many references, over pairs of blocks that count.

    The nearest boxes give a lower bound of a query block's sums. Blocks so far away that all references together, each with
    the largest kernel their distance allows, stay below the last bit of that bound are left out.
    """
    known = freeze(pack_cut(_whitened(refs, cov), STATE, rows, "at").drop("points"))
    queries = freeze(pack_cut(_whitened(asked, cov), STATE, rows, "at").drop("n"))
    nodes = tree(known, STATE)
    value = F.log("weight") - most_square() / 2
    most = known.groupBy(*STATE).agg(F.max("n").alias("n"))
    bound = descend(queries.select(*STATE, "block", "lo", "hi"), nodes, STATE, value, F.lit(True))
    reached = queries.join(bound, [*STATE, "block"]).join(most, STATE).withColumn("reach2", 2 * (LOST + F.log("n") - F.col("best")))
    pairs = near_pairs(reached, nodes, STATE)
    right = known.select(*STATE, F.col("block").alias("r_block"), "xs", "ws")
    left = queries.select(*STATE, "block", F.col("xs").alias("q_xs"), F.size("ws").alias("q_rows"), "points").join(cov, STATE)

    def run(key: Tuple[Any, ...], batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, head = 0.0, None
        for batch in batches:
            for r in batch.to_dict("records"):
                if head is None:
                    head, q = r, matrix(r["q_xs"], int(r["q_rows"]))
                total = total + _kernels(q, matrix(r["xs"], len(r["ws"])), np.asarray(r["ws"]))
        norm = kernel(float(head["n"]), head["cov"], q.shape[1])[1]
        yield pd.DataFrame({"model_id": [head["model_id"]], "state": [head["state"]], "points": [head["points"]],
                            "density": [total / norm]})

    schema = "model_id string, state string, points array<array<double>>, density array<double>"
    paired = left.join(pairs.join(right, [*STATE, "r_block"]), [*STATE, "block"])
    return paired.groupBy(*STATE, "block").applyInPandas(run, schema)


def fit_kde(visits: DataFrame, width: int, rows: int = BLOCK_ROWS) -> DataFrame:
    """Covariance and alarm limit per state: ``min + (max - min) / 10`` of the training densities."""
    cov = fit_covariance(visits, width)
    own = densities(visits, visits, cov, rows)
    limit = F.min("density") + (F.max("density") - F.min("density")) / 10
    return cov.join(own.groupBy(*STATE).agg(limit.alias("limit")), STATE)


def score_kde(visits: DataFrame, train: DataFrame, fit: DataFrame, rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds ``score`` (the density) and ``pred`` (density below the limit)."""
    dens = densities(visits, train, fit.select(*STATE, "n", "cov"), rows)
    dens = dens.join(fit.select(*STATE, "limit"), STATE)
    joined = visits.join(dens, [*STATE, "attrs"], "left")
    return joined.select(
        *visits.columns, F.col("density").alias("score"), thin_state(F.col("density") < F.col("limit")).alias("pred")
    )
