"""Entities, order, selection, unions."""

from pyspark.sql import functions as F

from flowloom.functions.scalar import within
from flowloom.operators import entities as E
from flowloom.operators import normalise as N

from .catalog import CUT_US, flows, query


@query("select_hosts", "select src_ip, count(*) as size from flows group by 1 having count(*) > 50")
def select_hosts(spark, sf):
    return E.select_hosts(flows(spark, sf), 50)


@query("select_connections", "select src_ip, dst_ip, count(*) as size from flows group by 1, 2 having count(*) > 5")
def select_connections(spark, sf):
    return E.select_connections(flows(spark, sf), 5)


_SWAPPED = """
 select flow_id,
  case when o.size > s.size then f.dst_ip else f.src_ip end as src_ip,
  case when o.size > s.size then f.src_ip else f.dst_ip end as dst_ip,
  case when o.size > s.size then f.dst_port else f.src_port end as src_port,
  case when o.size > s.size then f.src_port else f.dst_port end as dst_port,
  case when o.size > s.size then f.dst_bytes else f.src_bytes end as src_bytes,
  case when o.size > s.size then f.src_bytes else f.dst_bytes end as dst_bytes
"""
_BY_HOST = "with c as (select src_ip, count(*) as size from flows group by 1)" + _SWAPPED + """
 from flows f join c s on s.src_ip = f.src_ip left join c o on o.src_ip = f.dst_ip"""
_BY_CONN = "with c as (select src_ip, dst_ip, count(*) as size from flows group by 1, 2)" + _SWAPPED + """
 from flows f join c s on s.src_ip = f.src_ip and s.dst_ip = f.dst_ip
 left join c o on o.src_ip = f.dst_ip and o.dst_ip = f.src_ip"""
_ENDS = ["flow_id", "src_ip", "dst_ip", "src_port", "dst_port", "src_bytes", "dst_bytes"]


@query("orient_hosts", _BY_HOST)
def orient_hosts(spark, sf):
    return E.orient_bidirectional(flows(spark, sf), "host").select(*_ENDS)


@query("orient_connections", _BY_CONN)
def orient_connections(spark, sf):
    return E.orient_bidirectional(flows(spark, sf), "connection").select(*_ENDS)


@query("select_hosts_bidirectional",
       _BY_HOST.replace("with c as", "with c as").replace("\n select flow_id", ", w as (\n select flow_id")
       + ") select src_ip, count(*) as size from w group by 1 having count(*) > 50")
def select_hosts_bidirectional(spark, sf):
    return E.select_hosts(E.orient_bidirectional(flows(spark, sf), "host"), 50)


@query("select_connections_bidirectional",
       _BY_CONN.replace("\n select flow_id", ", w as (\n select flow_id")
       + ") select src_ip, dst_ip, count(*) as size from w group by 1, 2 having count(*) > 5")
def select_connections_bidirectional(spark, sf):
    return E.select_connections(E.orient_bidirectional(flows(spark, sf), "connection"), 5)


@query("major_connection", """
with r as (select src_ip, dst_ip, row_number() over (partition by src_ip order by count(*) desc, dst_ip) as rn
           from flows group by 1, 2)
select f.flow_id, f.src_ip, f.dst_ip from flows f join r using (src_ip, dst_ip) where rn = 1""")
def major_connection(spark, sf):
    return E.major_connection(flows(spark, sf)).select("flow_id", "src_ip", "dst_ip")


@query("index_flows", """
select src_ip as entity, row_number() over (partition by src_ip order by date_us, flow_id) - 1 as row_idx, flow_id
from flows""")
def index_flows(spark, sf):
    return E.index_flows(flows(spark, sf)).select("entity", "row_idx", "flow_id")


@query("index_connections", """
select src_ip || '-' || dst_ip as entity,
 row_number() over (partition by src_ip, dst_ip order by date_us, flow_id) - 1 as row_idx, flow_id from flows""")
def index_connections(spark, sf):
    return E.index_flows(flows(spark, sf), "connection").select("entity", "row_idx", "flow_id")


@query("index_both_directions", """
with u as (select src_ip as entity, date_us, flow_id from flows
           union all select dst_ip, date_us, flow_id from flows where src_ip <> dst_ip)
select entity, row_number() over (partition by entity order by date_us, flow_id) - 1 as row_idx, flow_id from u""")
def index_both_directions(spark, sf):
    return E.index_flows(flows(spark, sf), both_directions=True).select("entity", "row_idx", "flow_id")


@query("first_flows", """
with i as (select src_ip as entity, flow_id, row_number() over (partition by src_ip order by date_us, flow_id) - 1 as row_idx
           from flows)
select entity, row_idx, flow_id from i where row_idx < 40""")
def first_flows(spark, sf):
    return E.first_flows(E.index_flows(flows(spark, sf)), 40).select("entity", "row_idx", "flow_id")


@query("first_n_per_class", """
with r as (select flow_id, label, row_number() over (partition by label order by date_us, flow_id) as rn from flows)
select flow_id, label from r where rn <= 300""")
def first_n_per_class(spark, sf):
    return E.first_n_per_class(flows(spark, sf), 300).select("flow_id", "label")


@query("keep_selected_hosts", """
with h as (select src_ip from flows group by 1 having count(*) > 50)
select flow_id, src_ip from flows where src_ip in (select src_ip from h)""")
def keep_selected_hosts(spark, sf):
    f = flows(spark, sf)
    return E.keep_entities(f, E.select_hosts(f, 50), ["src_ip"]).select("flow_id", "src_ip")


@query("keep_network_hosts", """
with n as (select * from flows where starts_with(src_ip, 'u1')),
 h as (select src_ip from n group by 1 having count(*) > 60)
select flow_id, src_ip from n where src_ip in (select src_ip from h)""")
def keep_network_hosts(spark, sf):
    return E.keep_network_hosts(flows(spark, sf), "u1", 60).select("flow_id", "src_ip")


@query("keep_addresses", "select flow_id, src_ip from flows where src_ip in ('u1', 'u3', 'u5', 'u11')")
def keep_addresses(spark, sf):
    return E.keep_addresses(flows(spark, sf), ["u1", "u3", "u5", "u11"]).select("flow_id", "src_ip")


@query("time_interval", f"select flow_id, date_us from flows where date_us between {CUT_US} and {CUT_US + 86400000000 * 3}")
def time_interval(spark, sf):
    return flows(spark, sf).filter(within(CUT_US, CUT_US + 86_400_000_000 * 3)).select("flow_id", "date_us")


@query("entity_labels", "select src_ip as entity, max(label) as label from flows group by 1")
def entity_labels(spark, sf):
    from flowloom.operators.evaluate import entity_labels as labels

    return labels(E.entity_flows(flows(spark, sf)))


@query("union_classes", """
select flow_id, 'benign' as label_class from flows where label = 0
union all select flow_id, 'anomalous' from flows where label = 1""")
def union_classes(spark, sf):
    f = flows(spark, sf)
    benign = f.filter("label = 0").select("flow_id", F.lit("benign").alias("label_class"))
    return benign.unionByName(f.filter("label = 1").select("flow_id", F.lit("anomalous").alias("label_class")))


@query("drop_background", "select flow_id, detailed_label from flows where detailed_label not like '%attack_1%'")
def drop_background(spark, sf):
    named = flows(spark, sf).withColumn("named", F.regexp_replace("detailed_label", "attack_1", "Background"))
    return N.drop_background(named, "named").select("flow_id", "detailed_label")


@query("drop_null_rows", """
select flow_id, duration from (select flow_id, case when protocol_num >= 0 then duration end as duration from flows)
where duration is not null""")
def drop_null_rows(spark, sf):
    f = flows(spark, sf).select("flow_id", F.when(F.col("protocol_num") >= 0, F.col("duration")).alias("duration"))
    return f.dropna()
