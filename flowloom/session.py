"""Session settings the package relies on."""

from __future__ import annotations

import os
import tempfile
import zipfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

MAX_GROUP_ROWS = "spark.flowloom.maxGroupRows"
_DEFAULT_GROUP_ROWS = 4_000_000


def max_group_rows(spark: SparkSession) -> int:
    """Largest number of rows one task may hold for one key."""
    return int(spark.conf.get(MAX_GROUP_ROWS, str(_DEFAULT_GROUP_ROWS)))


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared checkpoint folder of the session; choose one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="flowloom-checkpoint-")
    context.setCheckpointDir(folder)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers of the session's executors, once for each application.

    The zip is written beside the driver and handed out by Spark; executors need no copy of the repository.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="flowloom-ship-"), "flowloom_package.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def scratch_folder(spark: SparkSession) -> str:
    """New folder name below the shared checkpoint folder, for tables between jobs."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/table-{uuid4().hex}"


def freeze(df: DataFrame) -> DataFrame:
    """Cut lineage through the reliable checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def group_sizes(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"))


def largest_group(df: DataFrame, keys: list[str]) -> int:
    """Rows of the biggest key group: one pre-aggregated pass, one number back."""
    return group_sizes(df, keys).agg(F.max("_rows")).first()[0] or 0
