"""Entities: selection, orientation and per-entity order of flows."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.scalar import connection_key
from ..functions.scan import OrderedScan

PART_ROWS = 500_000
LEVEL_KEYS = {"host": ["src_ip"], "connection": ["src_ip", "dst_ip"]}


def select_hosts(flows: DataFrame, threshold: int = 50) -> DataFrame:
    """Source hosts with more than ``threshold`` flows, with their counts."""
    return _counted(flows, ["src_ip"]).filter(F.col("size") > threshold)


def select_connections(flows: DataFrame, threshold: int = 50) -> DataFrame:
    return _counted(flows, ["src_ip", "dst_ip"]).filter(F.col("size") > threshold)


def _counted(flows: DataFrame, keys: list[str]) -> DataFrame:
    return flows.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"))


def orient_bidirectional(flows: DataFrame, level: str = "host") -> DataFrame:
    """Swap both ends of a flow when the reverse key has strictly more flows.

    The counts have one row per host or connection, so Spark broadcasts them
    only while they are small; skewed keys of the other case are split by AQE.
    """
    if level == "host":
        forward = _counted(flows, ["src_ip"]).withColumnRenamed("size", "_own")
        backward = forward.select(F.col("src_ip").alias("dst_ip"), F.col("_own").alias("_other"))
        counted = flows.join(forward, "src_ip").join(backward, "dst_ip", "left")
    else:
        # both directions of a pair in one row: one aggregation and one join
        pair = {"_low": F.least("src_ip", "dst_ip"), "_high": F.greatest("src_ip", "dst_ip")}
        keyed = flows.withColumns(pair)
        onward = F.col("src_ip") == F.col("_low")
        counts = keyed.groupBy("_low", "_high").agg(F.count_if(onward).alias("_there"), F.count_if(~onward).alias("_back"))
        counted = keyed.join(counts, ["_low", "_high"]).withColumns({
            "_own": F.when(onward, F.col("_there")).otherwise(F.col("_back")),
            "_other": F.when(onward, F.col("_back")).otherwise(F.col("_there")),
        })
    swap = F.coalesce(F.col("_other") > F.col("_own"), F.lit(False))
    pairs = [("src_ip", "dst_ip"), ("src_port", "dst_port"), ("src_bytes", "dst_bytes")]
    swapped = {}
    for a, b in pairs:
        swapped[a] = F.when(swap, F.col(b)).otherwise(F.col(a))
        swapped[b] = F.when(swap, F.col(a)).otherwise(F.col(b))
    return counted.select(*[swapped.get(c, F.col(c)).alias(c) for c in flows.columns])


def major_connection(flows: DataFrame) -> DataFrame:
    """Flows of each host to its most frequent destination; ties go to the smallest."""
    counts = _counted(flows, ["src_ip", "dst_ip"])
    first = F.min_by("dst_ip", F.struct(-F.col("size"), F.col("dst_ip")))
    winners = counts.groupBy("src_ip").agg(first.alias("dst_ip"))
    return flows.join(winners, ["src_ip", "dst_ip"], "left_semi")


def keep_entities(flows: DataFrame, selected: DataFrame, keys: list[str]) -> DataFrame:
    """Flows of the selected hosts or connections."""
    return flows.join(selected.select(*keys).distinct(), keys, "left_semi")


def keep_network_hosts(flows: DataFrame, prefix: str, min_flows: int = 150) -> DataFrame:
    """Flows of sources inside a network that have more than ``min_flows`` flows."""
    inside = flows.filter(F.col("src_ip").startswith(prefix))
    return keep_entities(inside, select_hosts(inside, min_flows), ["src_ip"])


def keep_addresses(flows: DataFrame, addresses: list[str]) -> DataFrame:
    return flows.filter(F.col("src_ip").isin(*addresses))


def entity_flows(flows: DataFrame, level: str = "host", both_directions: bool = False) -> DataFrame:
    """Adds ``entity``. With ``both_directions`` a flow also belongs to its other end."""
    if level == "host":
        own, other = F.col("src_ip"), F.col("dst_ip")
    else:
        own, other = connection_key(), connection_key("dst_ip", "src_ip")
    keyed = flows.withColumn("entity", own)
    if not both_directions:
        return keyed
    return keyed.unionByName(flows.filter(F.col("src_ip") != F.col("dst_ip")).withColumn("entity", other))


def index_flows(
    flows: DataFrame, level: str = "host", both_directions: bool = False, previous: dict[str, str] | None = None
) -> DataFrame:
    """Flows of each entity numbered from 0 by time, ties by ``flow_id``.

    ``previous`` adds values of the flow before, as ``{output: column}``; later
    entries may refer to earlier ones.
    """
    keyed = entity_flows(flows, level, both_directions)
    scan = OrderedScan(keyed, ["entity"], ["date_us", "flow_id"]).index("row_idx")
    for out, column in (previous or {}).items():
        scan = scan.previous({out: column})
    return scan.result()


def first_flows(indexed: DataFrame, max_flows: int = 20_000) -> DataFrame:
    """Training limit: the first flows of every entity."""
    return indexed.filter(F.col("row_idx") < max_flows)


def first_n_per_class(flows: DataFrame, n: int, class_column: str = "label", part_rows: int = PART_ROWS) -> DataFrame:
    """First ``n`` flows of each class by time.

    The first of a class are among the first of each of its parts, so no task reads a whole class.
    """
    order = ["date_us", "flow_id"]
    parts = max(1, ceil(flows.count() / part_rows))

    def first(rows: DataFrame, keys: list[str]) -> DataFrame:
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_place", place).filter(F.col("_place") <= n).drop("_place")

    spread = flows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    return first(first(spread, [class_column, "_part"]), [class_column]).drop("_part")
