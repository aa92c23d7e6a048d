"""Sessions, windows and traces.

A trace is a contiguous range of an entity's ordered flows. One output row is
one flow inside one trace; all input columns are kept, so nothing has to be
joined back. ``trace_id`` is ``session_id * 2**32 + window number``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scan import OrderedScan

SESSION_GAP_US = 1_800_000_000
SESSION_FACTOR = 1 << 32
TRACE = ["entity", "trace_id"]


def sessionize(flows: DataFrame, gap_us: int = SESSION_GAP_US, previous: dict[str, str] | None = None) -> DataFrame:
    """Adds ``row_idx``, ``gap_us``, ``inner_gap_us`` and ``session_id``.

    A gap above the limit opens a session; ``inner_gap_us`` is NULL there.
    ``previous`` adds values of the flow before, as in :func:`~.entities.index_flows`.
    """
    scan = OrderedScan(flows, ["entity"], ["date_us", "flow_id"])
    scan = scan.index("row_idx")
    for out, column in {"_before": "date_us", **(previous or {})}.items():
        scan = scan.previous({out: column})
    scan = scan.with_column("gap_us", F.col("date_us") - F.col("_before"))
    opens = F.when(F.col("gap_us") > gap_us, 1).otherwise(0).cast("long")
    scan = scan.with_column("inner_gap_us", F.when(F.col("gap_us") <= gap_us, F.col("gap_us")))
    return scan.running_sum("session_id", opens).result().drop("_before")


def session_params(sessions: DataFrame) -> DataFrame:
    """Window, stride and trace length limits per session.

    Window and stride are 25 and 5 median gaps in nanoseconds, so that halves of
    a microsecond stay whole numbers; a zero median gives 25 ms and 5 ms.
    """
    keys = ["entity", "session_id"]
    bounds = [
        F.count(F.lit(1)).alias("n_flows"), F.min("date_us").alias("first_us"), F.max("date_us").alias("last_us"),
        F.min("row_idx").alias("first_idx"),
    ]
    found = exact_quantiles(sessions, keys, ["inner_gap_us"], [0.5], bounds)
    half_steps = (F.coalesce(F.col("q_inner_gap_us")[0], F.lit(0.0)) * 2).cast("long")
    window = F.when(half_steps > 0, half_steps * 12_500).otherwise(25_000_000)
    stride = F.when(half_steps > 0, half_steps * 2_500).otherwise(5_000_000)
    limits = trace_limits(F.col("n_flows"))
    return found.select(
        *keys,
        "n_flows",
        "first_us",
        "last_us",
        "first_idx",
        window.cast("long").alias("window_ns"),
        stride.cast("long").alias("stride_ns"),
        limits[0].alias("min_len"),
        limits[1].alias("max_len"),
    )


def trace_limits(n_flows: Column) -> tuple[Column, Column]:
    """Shortest and longest trace of a session with ``n_flows`` flows."""
    shortest = F.least(F.greatest(F.floor(n_flows / 10_000), F.lit(10)), n_flows)
    return shortest.cast("long"), F.lit(1500).cast("long")


def count_windows(indexed: DataFrame, size: int = 100, stride: int = 20) -> DataFrame:
    """Windows of ``size`` flows that start every ``stride`` flows; the last ones are short."""
    first = F.expr(f"if(row_idx < {size}, 0L, div(row_idx - {size}, {stride}) + 1)")
    last = F.expr(f"div(row_idx, {stride})")
    return indexed.withColumn("trace_id", F.explode(F.sequence(first, last))).withColumn(
        "pos", F.col("row_idx") - F.col("trace_id") * stride
    )


def time_windows(sessions: DataFrame, params: DataFrame, tail: str = "rest") -> DataFrame:
    """Static windows over the closed interval ``[k * stride, k * stride + window]``.

    Windows are cut while they end before the last flow; the flows after the
    last one form a tail. ``tail='whole'`` lets the tail hold the whole session.
    """
    keys = ["entity", "session_id"]
    joined = sessions.join(params.select(*keys, "first_us", "last_us", "window_ns", "stride_ns"), keys)
    at = (F.col("date_us") - F.col("first_us")) * 1000
    room = (F.col("last_us") - F.col("first_us")) * 1000 - F.col("window_ns")
    tail_no = F.when(room > 0, F.expr("div((last_us - first_us) * 1000 - window_ns - 1, stride_ns)") + 1).otherwise(0)
    numbered = joined.withColumns({"_at": at, "_tail": tail_no.cast("long")})
    low = F.when(F.col("_at") > F.col("window_ns"), F.expr("div(_at - window_ns + stride_ns - 1, stride_ns)")).otherwise(0)
    high = F.least(F.expr("div(_at, stride_ns)"), F.col("_tail"))
    numbers = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))
    if tail == "whole":
        before = F.least(high, F.col("_tail") - 1)
        numbers = F.when(low <= before, F.sequence(low.cast("long"), before.cast("long")))
        numbers = F.concat(F.coalesce(numbers, F.array().cast("array<bigint>")), F.array(F.col("_tail")))
    exploded = numbered.withColumn("_k", F.explode(numbers))
    exploded = exploded.withColumn("trace_id", F.col("session_id") * F.lit(SESSION_FACTOR) + F.col("_k"))
    return with_positions(exploded.drop("_k", "_at", "_tail", "first_us", "last_us", "window_ns", "stride_ns"))


def with_positions(trace_flows: DataFrame) -> DataFrame:
    """Position in the trace. A trace is a range of ``row_idx``, so no sort is needed."""
    starts = trace_flows.groupBy(*TRACE).agg(F.min("row_idx").alias("_first"))
    return trace_flows.join(starts, TRACE).withColumn("pos", F.col("row_idx") - F.col("_first")).drop("_first")


def expand_ranges(indexed: DataFrame, ranges: DataFrame, step: int = 1024) -> DataFrame:
    """Flows of index ranges ``(entity, trace_id, lo, hi)``.

    Both sides meet on blocks of ``step`` row numbers, which keeps it an equi
    join and spreads one large entity over many keys.
    """
    blocks = ranges.withColumn(
        "_block", F.explode(F.sequence(F.expr(f"div(lo, {step}L)"), F.expr(f"div(hi, {step}L)")))
    )
    flows = indexed.withColumn("_block", F.expr(f"div(row_idx, {step}L)"))
    inside = F.col("row_idx").between(F.col("lo"), F.col("hi"))
    return (
        flows.join(blocks, ["entity", "_block"])
        .filter(inside)
        .withColumn("pos", F.col("row_idx") - F.col("lo"))
        .drop("_block", "lo", "hi")
    )


def uncovered_flows(indexed: DataFrame, trace_flows: DataFrame) -> DataFrame:
    """Flows that are in no trace; empty when the extraction is right."""
    return indexed.join(trace_flows.select("entity", "row_idx"), ["entity", "row_idx"], "left_anti")


def pack_traces(trace_flows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per trace with its records in order; used for export and replay only."""
    record = F.struct("pos", *columns)
    return trace_flows.groupBy(*TRACE).agg(F.sort_array(F.collect_list(record)).alias("records"))
