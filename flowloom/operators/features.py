"""Aggregated records inside traces: rolling, block and resampled features."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .traces import TRACE


def feature_rules(features: list[str], new_features: bool = True) -> list[tuple[str, str, str]]:
    """Output columns as ``(name, source, statistic)`` for the chosen flow features."""
    rules = []
    for f in features:
        if "port" in f:
            pair = [(f"unique_{f}s", f, "unique"), (f"std_{f}s", f, "std")]
            rules += pair if new_features else [(f"median_{f}", f, "median")]
        if f in ("protocol_num", "encoding"):
            rules.append((f"argmax_{f}", f, "mode"))
        if "duration" in f or "bytes" in f:
            rules.append((f"median_{f}", f, "median"))
        if new_features and (f in ("protocol_num", "encoding") or "duration" in f or "bytes" in f):
            rules.append((f"std_{f}", f, "std"))
        if f == "dst_ip" and new_features:
            rules.append(("unique_dst_ips", f, "unique"))
    return rules


def _statistic(kind: str, source: str, frame=None) -> Column:
    values = {
        "unique": F.collect_set(source),
        "std": F.stddev_samp(source),
        "median": F.percentile(source, F.lit(0.5)),
        "mode": F.mode(source, True),
    }[kind]
    values = values if frame is None else values.over(frame)
    return F.size(values).cast("long") if kind == "unique" else values


def rolling_features(
    trace_flows: DataFrame, features: list[str], length: int = 10, new_features: bool = True, piece: int = 4096
) -> DataFrame:
    """Statistics over the last ``length`` flows of the trace, one row per flow.

    The first standard deviation of a trace is undefined and takes the next
    value. Long traces are cut into pieces that repeat the ``length - 1`` flows
    before them, so no window holds more than one piece.
    """
    rules = feature_rules(features, new_features)
    at = F.expr(f"div(pos, {piece}L)")
    reach = F.expr(f"div(pos + {length - 1}, {piece}L)")
    cut = trace_flows.withColumn("_piece", F.explode(F.sequence(at, reach)))
    rows = Window.partitionBy(*TRACE, "_piece").orderBy("pos")
    frame = rows.rowsBetween(-(length - 1), Window.currentRow)
    rolled = cut.select(
        *TRACE, "pos", "row_idx", "flow_id", "_piece",
        *[_statistic(kind, source, frame).alias(name) for name, source, kind in rules],
    )
    later = rows.rowsBetween(Window.currentRow, 1)
    filled = rolled.select(
        *TRACE, "pos", "row_idx", "flow_id", "_piece",
        *[
            (F.first(name, True).over(later) if kind == "std" else F.col(name)).alias(name)
            for name, _, kind in rules
        ],
    )
    return filled.filter(F.col("_piece") == at).drop("_piece")


def block_features(
    trace_flows: DataFrame, features: list[str], length: int = 5, new_features: bool = True
) -> DataFrame:
    """Statistics per block of ``length`` flows, blocks counted by the entity's row number."""
    keyed = trace_flows.withColumn("block", F.expr(f"div(row_idx, {length}L)"))
    return _grouped(keyed, "block", features, new_features)


def resample_features(
    trace_flows: DataFrame, features: list[str], bin_us: int = 5_000_000, new_features: bool = True
) -> DataFrame:
    """Statistics per time bin of the trace; ``bin_us`` is aligned to midnight UTC."""
    keyed = trace_flows.withColumn("bin", F.expr(f"div(date_us, {bin_us}L)"))
    return _grouped(keyed, "bin", features, new_features)


def _grouped(keyed: DataFrame, key: str, features: list[str], new_features: bool) -> DataFrame:
    """One row per bin without undefined values. :func:`bin_flows` leads from bins to flows."""
    rules = feature_rules(features, new_features)
    grouped = keyed.groupBy(*TRACE, key).agg(
        F.count(F.lit(1)).alias("n_flows"),
        *[_statistic(kind, source).alias(name) for name, source, kind in rules],
    )
    return grouped.dropna(subset=[name for name, _, _ in rules])


def bin_flows(trace_flows: DataFrame, bins: DataFrame, key: str, length: int) -> DataFrame:
    """Flows behind each kept bin, so that a prediction for a bin reaches its flows."""
    source = "row_idx" if key == "block" else "date_us"
    keyed = trace_flows.withColumn(key, F.expr(f"div({source}, {length}L)"))
    return keyed.join(bins, [*TRACE, key])
