"""Choice of the number of bins per feature: exact clustering costs, their knee, percentile limits.

Clusters of one feature are runs of its sorted distinct values, so the smallest
cost of k clusters up to a value follows from the costs of k - 1 clusters up to
each earlier value. The place where the last cluster starts never moves back as
the value grows. Every s-th value is solved first; the values between two solved
ones search only between the starts of these two. A round is one equi join of
values and blocks of candidate starts, and all rounds of one k together meet a
small multiple of the distinct values, whatever the number of flows.
"""

from __future__ import annotations

from math import ceil, log

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scan import OrderedScan
from ..session import freeze

FAN = 256  # values solved between two solved ones in one round
BLOCK = 1024  # candidate starts joined as one key
_SUMS = ["weight", "linear", "square"]


def value_sums(flows: DataFrame, feature: str) -> tuple[DataFrame, int]:
    """Running sums ``(at, weight, linear, square)`` over the sorted distinct values, and their number.

    Values are taken from their mean, so that squares of large values don't cancel. NULL and NaN are left out.
    """
    value = F.col(feature).cast("double")
    counted = flows.filter(value.isNotNull() & ~F.isnan(value)).groupBy((value + 0.0).alias("value"))
    counted = freeze(counted.agg(F.count(F.lit(1)).cast("double").alias("copies")))
    n, mean = counted.agg(F.count(F.lit(1)), F.sum(F.col("value") * F.col("copies")) / F.sum("copies")).first()
    away = counted.withColumn("value", F.col("value") - F.lit(mean or 0.0))
    scan = OrderedScan(away, [], ["value"]).index("at")
    for power, name in enumerate(_SUMS):
        scan = scan.running_sum(name, F.col("copies") * F.pow("value", F.lit(power)))
    return freeze(scan.result().select("at", *_SUMS)), n


def _run_cost(after: str, upto: str) -> Column:
    """Squared distances from the mean of the values behind ``after`` up to ``upto``."""
    weight, linear, square = (F.col(f"{upto}.{c}") - F.col(f"{after}.{c}") for c in _SUMS)
    return F.greatest(square - linear * linear / weight, F.lit(0.0))


def _solve(asked: DataFrame, before: DataFrame) -> DataFrame:
    """``asked(at, sums, low, high)``: the best end of the clusters before the last one, between ``low`` and ``high``."""
    blocks = F.sequence(F.floor(F.col("low") / BLOCK), F.floor(F.col("high") / BLOCK))
    ask = asked.withColumn("block", F.explode(blocks)).alias("a")
    ends = before.withColumn("block", F.floor(F.col("at") / BLOCK)).alias("b")
    met = ask.join(ends, "block").filter(F.col("b.at").between(F.col("a.low"), F.col("a.high")))
    met = met.select(*[F.col(f"a.{c}") for c in ("at", *_SUMS)], F.col("b.at").alias("end"),
                     (F.col("b.cost") + _run_cost("b", "a")).alias("cost"))
    return met.groupBy("at", *_SUMS).agg(F.min_by("end", "cost").alias("end"), F.min("cost").alias("cost"))


def _steps(n: int) -> list[int]:
    """Distances of solved values, from wide to 1."""
    rounds = max(1, ceil(log(max(n, 2), FAN)))
    fan = ceil(n ** (1 / rounds))
    return [fan ** r for r in range(rounds - 1, -1, -1)]


def _one_more(sums: DataFrame, before: DataFrame, n: int) -> DataFrame:
    """Costs ``(at, sums, cost)`` up to each value with one cluster more than in ``before``."""
    last = n - 1
    solved, wide = None, None
    for step in _steps(n):
        here = sums.filter((F.col("at") > 0) & ((F.col("at") % step == 0) | (F.col("at") == last)))
        if solved is None:
            asked = here.withColumns({"low": F.lit(0).cast("long"), "high": F.col("at") - 1})
        else:
            here = here.filter((F.col("at") % wide != 0) & (F.col("at") != last))
            left = F.col("at") - F.col("at") % wide
            here = here.withColumns({"left": left, "right": F.least(left + wide, F.lit(last))})
            ends = solved.select(F.col("at").alias("left"), F.col("end").alias("end_left"))
            begins = solved.select(F.col("at").alias("right"), F.col("end").alias("end_right"))
            found = here.join(ends, "left", "left").join(begins, "right")
            near, far = F.coalesce("end_left", F.lit(0)), F.least("end_right", F.col("at") - 1)
            # of equally good ends any may have been taken
            asked = found.withColumns({"low": F.least(near, far), "high": F.least(F.greatest(near, far), F.col("at") - 1)})
        now = freeze(_solve(asked.select("at", *_SUMS, "low", "high"), before))
        solved, wide = now if solved is None else solved.unionByName(now), step
    first = sums.filter("at = 0").withColumn("cost", F.lit(0.0))
    return solved.select("at", *_SUMS, "cost").unionByName(first)


def elbow(flows: DataFrame, feature: str, kmax: int = 10) -> DataFrame:
    """Smallest clustering cost ``(k, cost)`` for k = 1..kmax clusters of one numeric feature, exactly.

    A feature without values, or with at most k distinct ones, costs 0.
    """
    sums, n = value_sums(flows, feature)
    ks = sums.sparkSession.range(1, kmax + 1).select(F.col("id").cast("int").alias("k"))
    if n < 2:
        return ks.withColumn("cost", F.lit(0.0))
    one = F.greatest(F.col("square") - F.col("linear") * F.col("linear") / F.col("weight"), F.lit(0.0))
    layer = sums.withColumn("cost", one)
    whole = layer.filter(F.col("at") == n - 1).select(F.lit(1).alias("k"), "cost")
    for k in range(2, min(kmax, n - 1) + 1):
        if k == min(kmax, n - 1):  # only the cost of all values is asked
            end = sums.filter(F.col("at") == n - 1)
            layer = _solve(end.withColumns({"low": F.lit(0).cast("long"), "high": F.col("at") - 1}), layer)
        else:
            layer = _one_more(sums, layer, n)
        whole = whole.unionByName(layer.filter(F.col("at") == n - 1).select(F.lit(k).alias("k"), "cost"))
    return ks.join(freeze(whole), "k", "left").select("k", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def knee(costs: DataFrame) -> int:
    """k with the largest distance to the line from the first to the last cost (kmax rows), the smallest of equal ones."""
    rows = sorted((r.k, r.cost) for r in costs.collect())
    (k0, c0), (k1, c1) = rows[0], rows[-1]
    gaps = {k: c0 + (c1 - c0) * (k - k0) / max(k1 - k0, 1) - c for k, c in rows}
    return max(gaps, key=lambda k: (gaps[k], -k))


def percentile_limits(flows: DataFrame, feature: str, bins: int) -> DataFrame:
    """Limits at i/bins, one row ``(feature, limits)``; no limits for a single bin."""
    if bins < 2:
        none = flows.sparkSession.range(1)
        return none.select(F.lit(feature).alias("feature"), F.array().cast("array<double>").alias("limits"))
    limits = exact_quantiles(flows, [], [feature], [i / bins for i in range(1, bins)])
    return limits.select(F.lit(feature).alias("feature"), F.col(f"q_{feature}").alias("limits"))


def elbow_limits(flows: DataFrame, feature: str, kmax: int = 10) -> DataFrame:
    """Percentile limits with as many bins as the knee of the costs says."""
    return percentile_limits(flows, feature, knee(elbow(flows, feature, kmax)))
