"""Ordered scans per key: row index, previous value, running sum.

A window over (key, order) puts a whole key in one task. Keys that are larger
than ``spark.flowloom.maxGroupRows`` are therefore cut into consecutive ranges
of the sort order. The ranges come from a range shuffle over (key, order), so
bursts and ties in time are balanced as well, and are checkpointed because the
range number must not change when a task is run again. Each range is scanned on
its own; one summary row per range carries index offset, last values and
partial sums to the next range. Both ways give the same rows.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import freeze, group_sizes, max_group_rows

_RANGE = "_range"


class OrderedScan:
    """Builder over ``df`` split by ``keys`` and ordered by the unique ``order``."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], limit: int | None = None):
        self.keys, self.order = list(keys), list(order)
        limit = limit or max_group_rows(df.sparkSession)
        hot = group_sizes(df, self.keys).filter(F.col("_rows") > limit)
        n_hot, hot_rows = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
        if n_hot == 0:
            self._plain, self._cut = df, None
            return
        self._stitched = False
        ranges = max(2, ceil(2 * hot_rows / limit))
        if self.keys:
            hot = hot.select(*self.keys)
            self._plain = df.join(hot, self.keys, "left_anti")
            cut = df.join(hot, self.keys, "left_semi")
        else:
            self._plain, cut = None, df
        self._cut = freeze(
            cut.repartitionByRange(ranges, *self.keys, *self.order).withColumn(_RANGE, F.spark_partition_id())
        )

    def _ready(self) -> DataFrame:
        """Ranges to summarise; results of an earlier step are stored first, not computed twice."""
        if self._stitched:
            self._cut = freeze(self._cut)
        self._stitched = True
        return self._cut

    def _whole(self):
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    def _piece(self):
        return Window.partitionBy(*self.keys, _RANGE).orderBy(*self.order)

    def _joined(self, summary: DataFrame) -> DataFrame:
        return self._cut.join(summary, [*self.keys, _RANGE])

    def _before(self):
        return Window.partitionBy(*self.keys).orderBy(_RANGE)

    def index(self, out: str) -> "OrderedScan":
        """0-based position of the row within its key."""
        if self._plain is not None:
            self._plain = self._plain.withColumn(out, F.row_number().over(self._whole()).cast("long") - 1)
        if self._cut is not None:
            sizes = group_sizes(self._ready(), [*self.keys, _RANGE])
            offset = F.sum("_rows").over(self._before().rowsBetween(Window.unboundedPreceding, -1))
            summary = sizes.select(*self.keys, _RANGE, F.coalesce(offset, F.lit(0)).alias("_offset"))
            local = F.row_number().over(self._piece()).cast("long") - 1
            self._cut = self._joined(summary).withColumn(out, local + F.col("_offset")).drop("_offset")
        return self

    def previous(self, columns: dict[str, str]) -> "OrderedScan":
        """Value of the row before, as ``{output: input}``; NULL on the first row of a key."""
        for out, source in columns.items():
            if self._plain is not None:
                self._plain = self._plain.withColumn(out, F.lag(source).over(self._whole()))
        if self._cut is not None:
            last = F.max_by(F.struct(*sorted(set(columns.values()))), F.struct(*self.order))
            ends = self._ready().groupBy(*self.keys, _RANGE).agg(last.alias("_last"))
            summary = ends.select(*self.keys, _RANGE, F.lag("_last").over(self._before()).alias("_carried"))
            joined = self._joined(summary)
            first = F.row_number().over(self._piece()) == 1
            joined = joined.select(
                "*",
                *[
                    F.when(first, F.col(f"_carried.{source}"))
                    .otherwise(F.lag(source).over(self._piece()))
                    .alias(out)
                    for out, source in columns.items()
                ],
            )
            self._cut = joined.drop("_carried")
        return self

    def running_sum(self, out: str, value: Column) -> "OrderedScan":
        """Sum of ``value`` from the first row of the key up to this row."""
        upto = (Window.unboundedPreceding, Window.currentRow)
        if self._plain is not None:
            self._plain = self._plain.withColumn(out, F.sum(value).over(self._whole().rowsBetween(*upto)))
        if self._cut is not None:
            totals = self._ready().groupBy(*self.keys, _RANGE).agg(F.sum(value).alias("_part"))
            offset = F.sum("_part").over(self._before().rowsBetween(Window.unboundedPreceding, -1))
            summary = totals.select(*self.keys, _RANGE, F.coalesce(offset, F.lit(0)).alias("_offset"))
            local = F.sum(value).over(self._piece().rowsBetween(*upto))
            self._cut = self._joined(summary).withColumn(out, local + F.col("_offset")).drop("_offset")
        return self

    def with_column(self, out: str, value: Column) -> "OrderedScan":
        """Row-local column, to be used by the next step."""
        if self._plain is not None:
            self._plain = self._plain.withColumn(out, value)
        if self._cut is not None:
            self._cut = self._cut.withColumn(out, value)
        return self

    def result(self) -> DataFrame:
        if self._cut is None:
            return self._plain
        cut = self._cut.drop(_RANGE)
        return cut if self._plain is None else self._plain.unionByName(cut)
