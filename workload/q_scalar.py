"""Casts, codes, bins, text forms."""

from pyspark.sql import functions as F

from flowloom.functions import scalar as S
from flowloom.operators import normalise as N
from flowloom.operators.machine import add_symbol, fit_limits, read_limits

from .catalog import flows, query

# training limits: quartiles of the bytes, sorted protocol codes
LIMITS_CTE = """
 lim as (select quantile_cont(src_bytes, [0.25, 0.5, 0.75]) as ls, quantile_cont(dst_bytes, [0.25, 0.5, 0.75]) as ld,
   (select list_sort(list(distinct cast(protocol_num as double))) from {src}) as lp from {src})
"""
FEATURES = ["protocol_num", "src_bytes", "dst_bytes"]
BIN = "(case when {v} > {l}[1] then 1 else 0 end + case when {v} > {l}[2] then 1 else 0 end + case when {v} > {l}[3] then 1 else 0 end)"
SYMBOL = (
    "cast((case when list_position(lp, cast(protocol_num as double)) > 0"
    " then list_position(lp, cast(protocol_num as double)) - 1 else len(lp) end) * 16"
    f" + {BIN.format(l='ls', v='src_bytes')} * 4 + {BIN.format(l='ld', v='dst_bytes')} as bigint)"
)


def limits_of(df):
    return read_limits(fit_limits(df, ["src_bytes", "dst_bytes"], ["protocol_num"]))


@query("typed_columns", """
select flow_id, try_cast(cast(duration as varchar) as bigint) as as_long, cast(src_port as varchar) as port_text,
 cast(dst_bytes as double) as as_double from flows""")
def typed_columns(spark, sf):
    f = flows(spark, sf)
    return N.typed(
        f.select("flow_id", F.round("duration").cast("bigint").cast("string").alias("as_long"),
                 F.col("src_port").cast("string").alias("port_text"), F.col("dst_bytes").cast("string").alias("as_double")),
        {"as_long": "bigint", "as_double": "double"})


@query("rejected_casts", """
select cast(count(*) as bigint) as protocol, cast(0 as bigint) as src_port from flows""")
def rejected_casts(spark, sf):
    f = flows(spark, sf).select("protocol", F.col("src_port").cast("string").alias("src_port"))
    return N.rejected_casts(f, {"protocol": "int", "src_port": "int"})


@query("fill_missing", """
select flow_id, coalesce(case when protocol_num >= 0 then src_port end, -1) as src_port,
 coalesce(case when protocol_num <> 1 then protocol end, 'missing') as protocol from flows""")
def fill_missing(spark, sf):
    f = flows(spark, sf).select(
        "flow_id", F.when(F.col("protocol_num") >= 0, F.col("src_port").cast("string")).alias("src_port"),
        F.when(F.col("protocol_num") != 1, F.col("protocol")).alias("protocol"))
    return N.fill_missing(f, ["src_port"], ["protocol"])


@query("hex_ports", "select flow_id, src_port as port from flows")
def hex_ports(spark, sf):
    text = F.when(F.col("src_port") % 2 == 0, F.concat(F.lit("0x"), F.lower(F.hex("src_port"))))
    f = flows(spark, sf).select("flow_id", text.otherwise(F.col("src_port").cast("string")).alias("port"))
    return f.select("flow_id", S.port_number("port").alias("port"))


@query("missing_bytes", "select flow_id, cast(src_bytes + dst_bytes - src_bytes as bigint) as dst_bytes from flows")
def missing_bytes(spark, sf):
    f = flows(spark, sf).withColumn("bytes", F.col("src_bytes") + F.col("dst_bytes"))
    return f.select("flow_id", (F.col("bytes") - F.col("src_bytes")).alias("dst_bytes"))


@query("category_dictionary", """
select protocol as value, cast(row_number() over (order by min(flow_id)) - 1 as int) as code from flows group by 1""")
def category_dictionary(spark, sf):
    return N.category_dictionary(flows(spark, sf), "protocol")


@query("category_codes", """
with d as (select protocol, cast(row_number() over (order by min(flow_id)) - 1 as int) as code from flows
           where label = 1 or protocol in ('click', 'view') group by 1)
select flow_id, protocol, coalesce(code, -1) as protocol_code from flows left join d using (protocol)""")
def category_codes(spark, sf):
    f = flows(spark, sf)
    stored = N.category_dictionary(f.filter("label = 1 or protocol in ('click', 'view')"), "protocol")
    return N.category_codes(f, "protocol", stored, "protocol_code").select("flow_id", "protocol", "protocol_code")


@query("unseen_categories", "select distinct protocol as value from flows where protocol not in ('click', 'view', 'error')")
def unseen_categories(spark, sf):
    f = flows(spark, sf)
    stored = N.category_dictionary(f.filter("protocol in ('click', 'view', 'error')"), "protocol")
    return N.unseen_categories(f, "protocol", stored)


@query("code_from_list", """
select flow_id, coalesce(list_position(['view', 'signup', 'error'], protocol), 0) - 1 as code from flows""")
def code_from_list(spark, sf):
    return flows(spark, sf).select("flow_id", S.code_from_list("protocol", ["view", "signup", "error"]).alias("code"))


@query("protocol_names", """
select flow_id, case dst_port % 64 when 0 then 'IP' when 1 then 'ICMP' when 2 then 'IGMP' when 4 then 'IPIP' when 6 then 'TCP'
 when 8 then 'EGP' when 12 then 'PUP' when 17 then 'UDP' when 22 then 'IDP' when 29 then 'TP' when 41 then 'IPV6'
 when 43 then 'ROUTING' when 44 then 'FRAGMENT' when 46 then 'RSVP' when 47 then 'GRE' when 50 then 'ESP' when 51 then 'AH'
 when 58 then 'ICMPV6' when 59 then 'NONE' when 60 then 'DSTOPTS' else 'proto_' || (dst_port % 64) end as protocol
from flows""")
def protocol_names(spark, sf):
    return flows(spark, sf).select("flow_id", N.protocol_name(F.col("dst_port") % 64).alias("protocol"))


@query("binary_labels", """
select flow_id, case when detailed_label like '%Botnet%' then 1 else 0 end as ctu, label as unsw,
 case when detailed_label <> 'BENIGN' then 1 else 0 end as cicids from flows""")
def binary_labels(spark, sf):
    return flows(spark, sf).select(
        "flow_id", S.malicious("ctu_bi", "detailed_label").alias("ctu"), S.malicious("unsw").alias("unsw"),
        S.malicious("cicids", "detailed_label").alias("cicids"))


_NAMED = """(select flow_id, case when label = 1 then 'flow=From-Botnet-V1' when protocol_num = 0 then 'flow=From-Normal'
 when protocol_num = -1 then 'flow=To-Botnet' else 'flow=Background' end as named from flows)"""


@query("label_classes", f"""
select flow_id, case when named like '%From-Botnet%' then 'anomalous' when named like '%From-Normal%' then 'benign'
  when named like '%Background%' then 'background' end as strict,
 case when named like '%From-Botnet%' then 'anomalous' when named not like '%Botnet%' then 'benign' end as with_background
from {_NAMED}""")
def label_classes(spark, sf):
    named = (F.when(F.col("label") == 1, "flow=From-Botnet-V1").when(F.col("protocol_num") == 0, "flow=From-Normal")
             .when(F.col("protocol_num") == -1, "flow=To-Botnet").otherwise("flow=Background"))
    f = flows(spark, sf).select("flow_id", named.alias("named"))
    return f.select("flow_id", S.label_class("ctu_bi", "named").alias("strict"),
                    S.label_class("ctu_bi", "named", True).alias("with_background"))


@query("percentile_bin", "with " + LIMITS_CTE.format(src="flows") + f"""
select flow_id, cast({BIN.format(l='ls', v='src_bytes')} as int) as src_bin, cast({BIN.format(l='ld', v='dst_bytes')} as int) as dst_bin
from flows, lim""")
def percentile_bin(spark, sf):
    f = flows(spark, sf)
    limits = limits_of(f)
    return f.select("flow_id", S.percentile_bin(F.col("src_bytes"), limits["src_bytes"][1]).alias("src_bin"),
                    S.percentile_bin(F.col("dst_bytes"), limits["dst_bytes"][1]).alias("dst_bin"))


@query("list_index", """
select flow_id, cast(case when list_position([1, 2, 0], protocol_num) > 0 then list_position([1, 2, 0], protocol_num) - 1
 else 3 end as int) as code from flows""")
def list_index(spark, sf):
    return flows(spark, sf).select("flow_id", S.list_index(F.col("protocol_num"), [1, 2, 0]).alias("code"))


@query("bin_limits", "with " + LIMITS_CTE.format(src="flows") + """
select 'protocol_num' as feature, i as place, round(v, 6) as bound from lim, unnest(lp) with ordinality t(v, i)
union all select 'src_bytes', i, round(v, 6) from lim, unnest(ls) with ordinality t(v, i)
union all select 'dst_bytes', i, round(v, 6) from lim, unnest(ld) with ordinality t(v, i)""")
def bin_limits(spark, sf):
    limits = fit_limits(flows(spark, sf), ["src_bytes", "dst_bytes"], ["protocol_num"])
    rows = limits.select("feature", F.posexplode("limits").alias("at", "v"))
    return rows.select("feature", (F.col("at") + 1).cast("long").alias("place"), F.round("v", 6).alias("bound"))


@query("alphabet_size", "with " + LIMITS_CTE.format(src="flows") + """
select cast((len(lp) + 1) * (len(ls) + 1) * (len(ld) + 1) as bigint) as alphabet from lim""")
def alphabet_size(spark, sf):
    limits = fit_limits(flows(spark, sf), ["src_bytes", "dst_bytes"], ["protocol_num"])
    sizes = limits.agg(F.collect_list(F.size("limits") + 1).alias("s"))
    return sizes.select(F.aggregate("s", F.lit(1).cast("long"), lambda a, n: a * n).alias("alphabet"))


@query("mixed_radix_code", "with " + LIMITS_CTE.format(src="flows") + f"select flow_id, {SYMBOL} as symbol from flows, lim")
def mixed_radix_code(spark, sf):
    f = flows(spark, sf)
    return add_symbol(f, limits_of(f)).select("flow_id", "symbol")


@query("record_text", """
select flow_id, concat_ws(',', cast(protocol_num as bigint), cast(trunc(duration) as bigint), src_bytes) as record from flows""")
def record_text(spark, sf):
    cols = [F.col(c) for c in ("protocol_num", "duration", "src_bytes")]
    return flows(spark, sf).select("flow_id", S.record_text(cols).alias("record"))


@query("record_values", """
select flow_id, cast(protocol_num as double) as a, cast(src_bytes as double) as b, cast(dst_bytes as double) as c from flows""")
def record_values(spark, sf):
    text = S.record_text([F.col(c) for c in FEATURES], ints=False)
    f = flows(spark, sf).select("flow_id", S.record_values(text).alias("v"))
    return f.select("flow_id", F.col("v")[0].alias("a"), F.col("v")[1].alias("b"), F.col("v")[2].alias("c"))


@query("connection_key", "select flow_id, src_ip || '-' || dst_ip as entity from flows")
def connection_key(spark, sf):
    return flows(spark, sf).select("flow_id", S.connection_key().alias("entity"))


@query("method_name", """
select flow_id, case when protocol_num = 0 then 'clustering-LOF' when protocol_num = 1 then 'multivariate gaussian'
 else 'baseline multivariate' end as method from flows""")
def method_name(spark, sf):
    name = (F.when(F.col("protocol_num") == 0, "dfa_clustering-LOF").when(F.col("protocol_num") == 1, "dfa_multivariate gaussian-")
            .otherwise("dfa_baseline multivariate-"))
    f = flows(spark, sf).select("flow_id", F.concat_ws("_", "src_ip", name).alias("model"))
    return f.select("flow_id", S.method_name("model").alias("method"))
