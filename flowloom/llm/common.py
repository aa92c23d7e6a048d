"""Tables between jobs, and connected components."""

from __future__ import annotations

import ctypes
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from flowloom.session import ship, scratch_folder


def scratch(spark: SparkSession) -> str:
    """A new folder name below the folder that ``spark.checkpoint.dir`` names."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return f"{folder.rstrip('/')}/llm-{uuid4().hex}" if folder else scratch_folder(spark)


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, survives lost executors."""
    path = scratch(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_name(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, whatever its case."""
    mark = "_own"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``stored`` wrote; all their readers must have written their own results."""
    for df in tables:
        context = df.sparkSession.sparkContext
        for folder in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def _tidy(fn):
    """A task that hands free memory back at its end: the worker process goes on to other tasks, whose needs are other ones."""
    def run(batches):
        yield from fn(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (OSError, AttributeError):  # the system's library has no such call
            pass
    return run


def mapped(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(_tidy(fn), schema)


def stars(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges(a, b)`` that has a smaller one.

    Large-star and small-star rounds: both halves of a round take one shuffle, sort the neighbours of a node and pass
    through them, so a node with very many links is spilled and not held. Ends when a round moves no edge.
    """
    star = stored(edges.where("a is not null and b is not null and a <> b")
                  .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), F.lit(True).alias("moved")))
    order = Window.partitionBy("u").orderBy("v", F.desc("moved"))

    def nearest(links: DataFrame) -> DataFrame:
        """Each link once, with the smallest neighbour."""
        least = F.first("v").over(order.rowsBetween(Window.unboundedPreceding, 0))
        return links.select("*", least.alias("m"), F.lag("v").over(order).alias("p")).where("p is null or p <> v")

    def closer(links: DataFrame) -> DataFrame:
        """One round; an edge has moved if its smaller end or the smallest one beside it was no root."""
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("moved", F.lit(False))
        large = nearest(both).where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"), (F.col("m") < F.col("u")).alias("moved"))
        return nearest(large).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"),
                                     (F.col("moved") | (F.col("v") != F.col("m"))).alias("moved"))

    for _ in range(max_rounds // 2):
        rounds = stored(closer(closer(star)))  # two rounds are written at once
        discard(star)
        star = rounds
        if not star.agg(F.max("moved")).first()[0]:
            return star.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError("components did not settle")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of ``edges(a, b)``."""
    found = stars(edges, max_rounds)
    return found.union(found.select(F.col("component").alias("node"), "component").distinct())
