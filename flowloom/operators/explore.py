"""Entity views and the numbers behind the exploration plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles


def entity_view(flows: DataFrame, features: list[str], grouping: str = "host") -> DataFrame:
    """Per host or connection: mean of numbers, smallest mode of codes, largest label."""
    keys = ["src_ip"] if grouping == "host" else ["src_ip", "dst_ip"]

    def summary(f: str) -> Column:
        return F.mode(f, True) if "num" in f else F.avg(f)

    return flows.groupBy(*keys).agg(*[summary(f).alias(f) for f in features], F.max("label").alias("label"))


def named_parts(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of capture parts; the host carries the part it comes from."""
    joined = None
    for name, part in parts.items():
        part = part.withColumn("src_ip", F.concat_ws("_", "src_ip", F.lit(name)))
        joined = part if joined is None else joined.unionByName(part)
    return joined


def label_names(df: DataFrame, column: str = "label") -> DataFrame:
    return df.withColumn(column, F.when(F.col(column) == 0, "Benign").otherwise("Malicious"))


def distinct_entities(flows: DataFrame) -> DataFrame:
    """Number of hosts and of connections."""
    pairs = flows.groupBy("src_ip", "dst_ip").agg(F.count(F.lit(1)).alias("n"))
    return pairs.agg(F.count_distinct("src_ip").alias("n_hosts"), F.count(F.lit(1)).alias("n_connections"))


def flows_per(flows: DataFrame, keys: list[str]) -> DataFrame:
    return flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("num_flows"))


def flow_rate(flows: DataFrame, unit_us: int = 1_000_000, parts: int | None = None) -> DataFrame:
    """Flows per time unit between first and last flow, with 0 for empty units.

    The time line is made in two steps, so that no task holds all of it.
    """
    unit = F.expr(f"div(date_us, {unit_us}L)")
    counted = flows.groupBy(unit.alias("unit")).agg(F.count(F.lit(1)).alias("num_flows"))
    ends = counted.agg(F.min("unit").alias("_a"), F.max("unit").alias("_b"))
    coarse = ends.select(
        "_a", "_b", F.explode(F.sequence(F.expr("div(_a, 4096L)"), F.expr("div(_b, 4096L)"))).alias("_c")
    ).repartition(F.col("_c"))
    low, high = F.greatest("_a", F.col("_c") * 4096), F.least("_b", F.col("_c") * 4096 + 4095)
    line = coarse.select(F.explode(F.sequence(low, high)).alias("unit"))
    filled = line.join(counted, "unit", "left")
    return filled.select((F.col("unit") * unit_us).alias("start_us"), F.coalesce("num_flows", F.lit(0).cast("long")).alias("num_flows"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal-width bins between smallest and largest value; the last one is closed."""
    values = df.select(F.col(column).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    ends = values.agg(F.struct(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).alias("_ends"))
    width = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col("_v") - F.col("_lo")) / width), F.lit(bins - 1)))
    placed = values.withColumn("_ends", ends.scalar()).select("_v", "_ends.*").groupBy(at.cast("int").alias("bin"))
    placed = placed.agg(F.count(F.lit(1)).alias("n"))
    line = ends.select("_ends.*", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    filled = line.join(placed, "bin", "left")
    return filled.select(
        "bin", (F.col("_lo") + F.col("bin") * width).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("high"),
        F.coalesce("n", F.lit(0).cast("long")).alias("n"),
    )


def boxplot(df: DataFrame, columns: list[str]) -> DataFrame:
    """Quartiles and whiskers of each column; a whisker is the last value within 1.5 ranges."""
    quartiles = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75])
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(f"q_{c}").alias("_q")) for c in columns]
    boxes = quartiles.select(F.inline(F.array(*pairs)))  # one row per column
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    reach = 1.5 * (F.col("_q")[2] - F.col("_q")[0])
    inside = F.col("value").between(F.col("_q")[0] - reach, F.col("_q")[2] + reach)
    joined = long.join(F.broadcast(boxes), "variable").filter(inside)
    return joined.groupBy("variable").agg(
        F.first("_q")[0].alias("q1"), F.first("_q")[1].alias("median"), F.first("_q")[2].alias("q3"),
        F.min("value").alias("whisker_low"), F.max("value").alias("whisker_high"),
    )


def summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, mean, deviation, extremes and exact quartiles, one row per column."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "variable", "value")
    basic = long.groupBy("variable").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(df, [], columns, [0.25, 0.5, 0.75])
    pairs = [F.struct(F.lit(c).alias("variable"), F.col(f"q_{c}").alias("_q")) for c in columns]
    boxes = quartiles.select(F.inline(F.array(*pairs)))
    joined = basic.join(boxes, "variable")
    return joined.select(
        "variable", "count", "mean", "std", "min",
        F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max",
    )


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns in one pass over the rows."""
    cells = [
        F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.corr(a, b).alias("corr"))
        for a in columns for b in columns
    ]
    return df.agg(F.array(*cells).alias("_c")).select(F.inline("_c"))


def min_max_scaled(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns scaled to [0, 1]; a constant column becomes 0."""
    ends = df.agg(F.struct(*[F.min(c).alias(f"_lo_{c}") for c in columns], *[F.max(c).alias(f"_hi_{c}") for c in columns]))
    joined = df.withColumn("_ends", ends.scalar()).select("*", "_ends.*")
    scaled = {}
    for c in columns:
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        scaled[c] = F.when(span == 0, 0.0).otherwise((F.col(c) - F.col(f"_lo_{c}")) / F.nullif(span, F.lit(0)))
    return joined.withColumns(scaled).select(*df.columns)
