"""From the source layouts to the canonical flow table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import BIDIRECTIONAL_PROTOCOLS, code_from_list, malicious, port_number
from ..functions.scan import OrderedScan

FLOW_COLUMNS = [
    "flow_id", "date", "date_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "protocol_num",
    "duration", "src_bytes", "dst_bytes", "label", "detailed_label",
]

# IP protocol numbers and the names the platform gives them.
PROTOCOL_NAMES = {
    0: "IP", 1: "ICMP", 2: "IGMP", 4: "IPIP", 6: "TCP", 8: "EGP", 12: "PUP", 17: "UDP", 22: "IDP", 29: "TP",
    41: "IPV6", 43: "ROUTING", 44: "FRAGMENT", 46: "RSVP", 47: "GRE", 50: "ESP", 51: "AH", 58: "ICMPV6",
    59: "NONE", 60: "DSTOPTS", 103: "PIM", 132: "SCTP", 255: "RAW",
}


def protocol_name(number):
    """Name of a protocol number; ``proto_<n>`` when it has none."""
    names = F.create_map(*[F.lit(x) for pair in PROTOCOL_NAMES.items() for x in pair])
    return F.coalesce(F.try_element_at(names, number), F.concat(F.lit("proto_"), number.cast("string")))


def typed(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """``try_cast`` of the named columns; what cannot be read becomes NULL."""
    return df.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()})


def rejected_casts(df: DataFrame, casts: dict[str, str]) -> DataFrame:
    """Number of values per column that are present but cannot be read."""
    bad = [
        F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in casts.items()
    ]
    return df.agg(*bad)


def fill_missing(df: DataFrame, ports: list[str] = ("src_port", "dst_port"), texts: list[str] = ()) -> DataFrame:
    """Ports become -1 and texts ``missing``."""
    filled = {c: port_number(c) for c in ports}
    filled.update({c: F.coalesce(F.col(c), F.lit("missing")) for c in texts})
    return df.withColumns(filled)


def category_dictionary(df: DataFrame, column: str, order: str = "flow_id") -> DataFrame:
    """``(value, code)`` by first appearance. One row per category."""
    firsts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.min(order).alias("_at"))
    ranked = OrderedScan(firsts, [], ["_at", "value"]).index("code").result()
    return ranked.select("value", F.col("code").cast("int").alias("code"))


def category_codes(df: DataFrame, column: str, dictionary: DataFrame, out: str) -> DataFrame:
    """Adds the code of a stored dictionary, -1 for values it does not hold."""
    named = dictionary.select(F.col("value").alias(column), F.col("code").alias("_code"))
    return df.join(named, column, "left").withColumn(out, F.coalesce("_code", F.lit(-1))).drop("_code")


def unseen_categories(df: DataFrame, column: str, dictionary: DataFrame) -> DataFrame:
    """Values that the dictionary does not hold; empty when the data is a subset of it."""
    values = df.select(F.col(column).alias("value")).distinct()
    return values.join(dictionary, "value", "left_anti")


def drop_background(df: DataFrame, column: str = "label") -> DataFrame:
    return df.filter(~F.col(column).contains("Background"))


def canonical_flows(raw: DataFrame, layout: str, flow_id: str = "flow_id", dictionary: DataFrame | None = None) -> DataFrame:
    """Canonical flows of one layout. ``dictionary`` codes the protocol of the UNSW and
    unidirectional layouts; without it the codes follow first appearance."""
    if layout == "cicids":
        raw = raw.dropna()
    df = fill_missing(raw)
    if layout == "ctu_bi":
        df = typed(df, {"bytes": "long", "src_bytes": "long", "packets": "long"})
        df = df.withColumn("dst_bytes", F.col("bytes") - F.col("src_bytes"))
        df = df.withColumn("protocol_num", code_from_list("protocol", BIDIRECTIONAL_PROTOCOLS))
        df = df.withColumn("state", F.coalesce("state", F.lit("missing")))
    elif layout == "ctu_uni":
        df = typed(df, {"bytes": "long", "packets": "long"})
        df = df.withColumns({"src_bytes": F.col("bytes"), "dst_bytes": F.lit(0).cast("long")})
    elif layout == "unsw":
        df = typed(df, {"src_bytes": "long", "dst_bytes": "long"})
        df = df.withColumns({c: F.coalesce(c, F.lit("missing")) for c in ("detailed_label", "service")})
    else:
        df = typed(df, {"src_bytes": "long", "dst_bytes": "long", "protocol": "int"})
        df = df.withColumn("protocol_num", F.col("protocol")).withColumn("protocol", protocol_name(F.col("protocol")))
    if layout in ("ctu_uni", "unsw"):
        dictionary = category_dictionary(df, "protocol", flow_id) if dictionary is None else dictionary
        df = category_codes(df, "protocol", dictionary, "protocol_num")
    detailed = F.col("detailed_label") if layout == "unsw" else F.col("label").cast("string")
    df = df.withColumns({"detailed_label": detailed, "label": malicious(layout)})
    df = df.withColumns({"flow_id": F.col(flow_id), "date_us": F.unix_micros("date"), "duration": F.col("duration").cast("double")})
    return df.select(*FLOW_COLUMNS)
