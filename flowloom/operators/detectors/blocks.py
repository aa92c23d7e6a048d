"""Distance work in blocks.

Local outlier factors and kernel densities compare query points with reference
points of their group. Points are first counted by distinct value, then packed
into blocks of bounded size; a group that needs more than one block is cut by
``boxes``. What leaves a pair of blocks is one number per query, never a pair of
points, and a task holds one query block while reference blocks stream past it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

BLOCK_ROWS = 2048


def distinct_points(visits: DataFrame, keys: list[str]) -> DataFrame:
    return visits.groupBy(*keys, "attrs").agg(F.count(F.lit(1)).alias("w"))


def pack_blocks(points: DataFrame, keys: list[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """``(keys, block, n_blocks, n, xs, ws)``; ``n`` is the weighted size of the group."""
    sizes = points.groupBy(*keys).agg(
        F.ceil(F.count(F.lit(1)) / rows).cast("int").alias("n_blocks"), F.sum("w").alias("n")
    )
    blocks = points.join(sizes, keys).withColumn("block", F.pmod(F.xxhash64("attrs"), F.col("n_blocks")).cast("int"))
    # the work per byte is high: keep all partitions instead of letting small ones be merged
    packed = spread(blocks, *keys, "block").groupBy(*keys, "block", "n_blocks", "n").agg(
        F.sort_array(F.collect_list(F.struct("attrs", "w"))).alias("_p")
    )
    return packed.select(
        *keys, "block", "n_blocks", "n",
        F.flatten(F.col("_p.attrs")).alias("xs"),
        F.transform("_p.w", lambda w: w.cast("double")).alias("ws"),
        F.col("_p.attrs").alias("points"),
    )


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash partitioned over the session's number of shuffle partitions."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def matrix(flat: np.ndarray, rows: int) -> np.ndarray:
    return np.asarray(flat, dtype=float).reshape(rows, -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed attribute by attribute so that every block gives the same bits."""
    total = np.zeros((len(a), len(b)))
    for j in range(a.shape[1]):
        total += (a[:, j, None] - b[None, :, j]) ** 2
    return np.sqrt(total)


def kth_distance(d: np.ndarray, w: np.ndarray, k: float) -> np.ndarray:
    """Smallest distance within which each row has ``k`` weighted neighbours."""
    order = np.argsort(d, axis=1, kind="stable")
    reached = np.cumsum(np.take_along_axis(w, order, axis=1), axis=1) >= k
    at = np.argmax(reached, axis=1)
    return np.take_along_axis(d, np.take_along_axis(order, at[:, None], axis=1), axis=1)[:, 0]


def nearest_sum(d, w, limit, value) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Weight and weighted value sum of the points nearer than ``limit`` and exactly at it."""
    inside = np.where(d < limit[:, None], w, 0.0)
    edge = np.where(d == limit[:, None], w, 0.0)
    return inside.sum(1), (inside * value).sum(1), edge.sum(1), (edge * value).sum(1)


def mean_of_k(w_in, s_in, w_edge, s_edge, k: float) -> np.ndarray:
    """Mean over exactly ``k`` neighbours; points tied at the edge share the places left."""
    return (s_in + (k - w_in) * s_edge / w_edge) / k
