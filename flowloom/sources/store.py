"""Small tables and results kept as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.errors import AnalysisException

from ..operators.normalise import category_dictionary


def write_limits(limits: DataFrame, path: str) -> None:
    """Discretisation limits ``(place, feature, kind, limits)``."""
    limits.write.mode("overwrite").parquet(path)


def load_limits(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def load_dictionary(spark: SparkSession, path: str, flows: DataFrame, column: str) -> DataFrame:
    """Stored category dictionary; the first run makes it from its flows."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        category_dictionary(flows, column).write.parquet(path)
        return spark.read.parquet(path)


def write_results(conf: DataFrame, path: str) -> None:
    """Confusion table, one partition per test set; other test sets stay untouched."""
    conf.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("test_set").parquet(path)


def load_results(spark: SparkSession, path: str, test_sets: list[str] | None = None) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored if test_sets is None else stored.filter(F.col("test_set").isin(*test_sets))


def write_trace_flows(trace_flows: DataFrame, path: str) -> None:
    """Trace rows as Parquet; the index lists of traces are its ``row_idx``."""
    trace_flows.write.mode("overwrite").parquet(path)
