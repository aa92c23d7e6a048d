"""Registry of queries, and the ``flows`` view on both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
SQL: dict[str, str] = {}

CUT_US = 1_705_363_200_000_000  # 2024-01-16, training before and testing from it
DAY_US = 86_400_000_000

_VIEW = """
with e as (select *, cast(regexp_extract(props, '[0-9]+', 0) as int) as k, {us} as date_us from {events})
select event_id as flow_id, ts as date, date_us,
 concat('u', cast(user_id as {str})) as src_ip, concat('u', cast(k % 10 as {str})) as dst_ip,
 cast((event_id * 7919) % 65536 as int) as src_port, k as dst_port, event_type as protocol,
 case event_type when 'click' then 0 when 'view' then 1 when 'purchase' then 2 when 'signup' then 3 else -1 end as protocol_num,
 value / 10.0E0 as duration, cast(round(value * 100) as bigint) as src_bytes, cast(round(value * 37) as bigint) as dst_bytes,
 case when user_id % 5 = 0 and event_type = 'error' then 1 else 0 end as label,
 case when user_id % 5 = 0 and event_type = 'error' then concat('attack_', cast(k % 3 as {str})) else 'BENIGN' end as detailed_label
from e
"""

FLOWS_SQL = _VIEW.format(us="epoch_us(ts)", str="varchar", events="events")


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may use the ``flows`` view."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_flows(sql)
        return fn

    return add


def with_flows(sql: str) -> str:
    body = sql.strip()
    if "flows" not in body:
        return body
    head = f"flows as materialized ({FLOWS_SQL})"
    if body.lower().startswith("with "):
        return f"with {head},\n{body[5:]}"
    return f"with {head}\n{body}"


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as network flows."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(
        _VIEW.format(us="unix_micros(cast(ts as timestamp))", str="string", events="{events}"), events=events
    )


def lineitem_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as flows of their supplier; a whole row is unique, its key is not."""
    return spark.sql(
        """select concat('s', cast(l_suppkey as string)) as entity, unix_micros(cast(l_shipdate as timestamp)) as date_us,
                  l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice from {items}""",
        items=spark.read.parquet(f"{sf_dir}/lineitem.parquet"),
    )


LINEITEM_ORDER = ["date_us", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
