"""Exact quantiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..session import largest_group, max_group_rows
from .scan import OrderedScan


def exact_quantiles(
    df: DataFrame, keys: list[str], columns: list[str], probs: list[float], also: Sequence[Column] = ()
) -> DataFrame:
    """One row per key; ``q_<column>`` holds the quantiles in the order of ``probs``.

    ``also`` are further aggregates of the same groups.

    ``percentile`` keeps all values of a group in one task. Once a group is over
    the row limit the values are counted first and the wanted ranks are read
    from the running count of the sorted distinct values.
    """
    if largest_group(df, keys) <= max_group_rows(df.sparkSession):
        levels = F.array(*[F.lit(float(p)) for p in probs])
        return df.groupBy(*keys).agg(*also, *[F.percentile(c, levels).alias(f"q_{c}") for c in columns])
    rest = [df.groupBy(*keys).agg(*also)] if also else []
    parts = rest + [_from_counts(df, keys, c, probs) for c in columns]
    if not keys:
        single = [p.select(F.struct("*").alias("_row")).scalar().alias(f"_row{i}") for i, p in enumerate(parts[1:])]
        return parts[0].select("*", *single).select(*parts[0].columns, *[f"_row{i}.*" for i in range(len(single))])
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), parts)


def _from_counts(df: DataFrame, keys: list[str], column: str, probs: list[float]) -> DataFrame:
    counts = (
        df.filter(F.col(column).isNotNull()).groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    )
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    running = OrderedScan(counts, keys, [column]).running_sum("_upto", F.col("_n")).result()
    joined = running.join(totals, keys) if keys else running.withColumn("_total", totals.scalar())
    value = F.col(column).cast("double")
    picks = []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("_total") - 1)
        picks += [
            F.min(F.when(F.col("_upto") > F.floor(rank), value)).alias(f"_lo{i}"),
            F.min(F.when(F.col("_upto") > F.ceil(rank), value)).alias(f"_hi{i}"),
            F.max(rank - F.floor(rank)).alias(f"_w{i}"), F.max(F.ceil(rank) - rank).alias(f"_v{i}"),
        ]
    picked = joined.groupBy(*keys).agg(*picks)
    # the order of operations of ``percentile``, so that both ways agree to the last bit
    levels = [F.when(F.col(f"_lo{i}") == F.col(f"_hi{i}"), F.col(f"_lo{i}"))
              .otherwise(F.col(f"_v{i}") * F.col(f"_lo{i}") + F.col(f"_w{i}") * F.col(f"_hi{i}")) for i in range(len(probs))]
    return picked.select(*keys, F.array(*levels).alias(f"q_{column}"))
