"""Readers on files that Spark writes from the given tables in the layouts of the sources."""

from pyspark.sql import functions as F

from flowloom.functions.scalar import label_class
from flowloom.operators import machine as M, normalise as N, symbolic as Y
from flowloom.operators.traces import count_windows
from flowloom.operators.entities import index_flows
from flowloom.session import scratch_folder
from flowloom.sources import flows as S, machines as D, store, traces as X

from .catalog import flows, query
from .profile import BASE, trained
from .q_symbolic import EDGES
from .q_traces import CW, IDX

_OUT = ["date_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "protocol_num", "duration", "src_bytes", "dst_bytes", "label"]
# event types under protocol names of the layouts
_NAMES = {"click": "udp", "view": "tcp", "purchase": "icmp", "signup": "arp", "error": "other"}
_NAME_SQL = "case protocol " + " ".join(f"when '{a}' then '{b}'" for a, b in _NAMES.items()) + " end"


def _name():
    return F.element_at(F.create_map(*[F.lit(x) for pair in _NAMES.items() for x in pair]), F.col("protocol"))


def _text(c):
    return F.col(c).cast("string")


def _time(pattern):
    return F.date_format(F.timestamp_micros("date_us"), pattern)


def _written(df, fields, separator=","):
    """Folder of text files with one line per flow."""
    folder = scratch_folder(df.sparkSession)
    df.select(F.concat_ws(separator, *fields).alias("value")).write.text(folder)
    return folder


def _canonical(df, layout):
    return N.canonical_flows(df.withColumn("flow_id", F.monotonically_increasing_id()), layout)


@query("read_bidirectional", f"""
select date_us, src_ip, dst_ip, src_port, case when protocol_num = 1 then -1 else dst_port end as dst_port, {_NAME_SQL} as protocol,
 cast(case when protocol_num >= 0 then protocol_num else -1 end as int) as protocol_num, duration, src_bytes, dst_bytes,
 label, case when label = 1 then 'flow=From-Botnet' else 'flow=From-Normal' end as detailed_label from flows""")
def read_bidirectional(spark, sf):
    f = flows(spark, sf)
    hexed = F.when(F.col("src_port") % 3 == 0, F.concat(F.lit("0x"), F.hex("src_port"))).otherwise(_text("src_port"))
    port = F.when(F.col("protocol_num") == 1, "").otherwise(_text("dst_port"))
    label = F.when(F.col("label") == 1, "flow=From-Botnet").otherwise("flow=From-Normal")
    zero = F.lit("0")
    folder = _written(f, [_time("yyyy/MM/dd HH:mm:ss.SSSSSS"), _text("duration"), _name(), "src_ip", hexed, F.lit("->"), "dst_ip", port,
                          F.lit("CON"), zero, zero, zero, (F.col("src_bytes") + F.col("dst_bytes")).cast("string"), _text("src_bytes"), label])
    kept, _ = S.read_flows(spark, folder, "ctu_bi", header=False)
    return _canonical(kept, "ctu_bi").select(*_OUT, "detailed_label")


@query("read_rejects", "select count(*) filter (src_port % 5 = 0) as rejected, count(*) filter (src_port % 5 <> 0) as kept from flows")
def read_rejects(spark, sf):
    """Every fifth port makes a line with too many fields, every seventh one with too few."""
    f = flows(spark, sf)
    fields = [F.lit("2011/08/10 09:46:53.047277"), *[F.lit("1")] * 12]
    tail = F.when(F.col("src_port") % 5 == 0, "1,Normal,extra").when(F.col("src_port") % 7 == 0, "1").otherwise("1,Normal")
    kept, rejects = S.read_flows(spark, _written(f, [*fields, tail]), "ctu_bi", header=False)
    return rejects.agg(F.count(F.lit(1)).alias("rejected")).withColumn("kept", kept.agg(F.count(F.lit(1))).scalar())


_UNI_SQL = """select date_us // 1000 * 1000 as date_us, src_ip, dst_ip, src_port, case when protocol_num = 1 then {null} else dst_port end as dst_port,
 protocol, duration, src_bytes as bytes, case when label = 1 then 'Botnet' else 'LEGITIMATE' end as label from flows"""


@query("read_netflow_text", _UNI_SQL.format(null="null"))
def read_netflow_text(spark, sf):
    f = flows(spark, sf)
    port = F.when(F.col("protocol_num") == 1, F.col("dst_ip")).otherwise(F.concat_ws(":", "dst_ip", _text("dst_port")))
    label = F.when(F.col("label") == 1, "Botnet").otherwise("LEGITIMATE")
    one = F.lit("1")
    folder = _written(f, [_time("yyyy-MM-dd HH:mm:ss.SSS"), _text("duration"), "protocol", F.concat_ws(":", "src_ip", _text("src_port")),
                          F.lit("->"), port, F.lit("FRPA_"), one, one, _text("src_bytes"), one, label], " ")
    read = S.read_netflow_text(spark, folder)
    return read.select(F.unix_micros("date").alias("date_us"), "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration",
                       F.col("bytes").cast("long").alias("bytes"), "label")


@query("read_unidirectional", _UNI_SQL.format(null="-1"))
def read_unidirectional(spark, sf):
    f = flows(spark, sf)
    port = F.when(F.col("protocol_num") == 1, "").otherwise(_text("dst_port"))
    label = F.when(F.col("label") == 1, "Botnet").otherwise("LEGITIMATE")
    one = F.lit("1")
    folder = _written(f, [_time("yyyy-MM-dd HH:mm:ss.SSS"), _text("duration"), "protocol", "src_ip", _text("src_port"), "dst_ip", port,
                          F.lit("FR"), one, one, _text("src_bytes"), one, label])
    kept, _ = S.read_flows(spark, folder, "ctu_uni", header=False)
    return _canonical(kept, "ctu_uni").select("date_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "duration",
                                              F.col("src_bytes").alias("bytes"), F.col("detailed_label").alias("label"))


@query("read_unsw", """
with d as (select protocol, cast(row_number() over (order by min(flow_id)) - 1 as int) as code from flows group by 1)
select date_us // 1000000 * 1000000 as date_us, src_ip, dst_ip, src_port, case when protocol_num = 1 then -1 else dst_port end as dst_port,
 protocol, code as protocol_num, duration, src_bytes, dst_bytes, label, case when label = 1 then detailed_label else 'missing' end as detailed_label
from flows join d using (protocol)""")
def read_unsw(spark, sf):
    f = flows(spark, sf)
    port = F.when(F.col("protocol_num") == 1, "-").otherwise(_text("dst_port"))
    at = {0: "src_ip", 1: _text("src_port"), 2: "dst_ip", 3: port, 4: "protocol", 5: F.lit("CON"), 6: _text("duration"), 7: _text("src_bytes"),
          8: _text("dst_bytes"), 13: F.lit("-"), 28: (F.floor(F.col("date_us") / 1_000_000)).cast("string"), 29: F.lit("1421927415"),
          47: F.when(F.col("label") == 1, F.col("detailed_label")).otherwise("-"), 48: _text("label")}
    folder = _written(f, [at.get(i, F.lit("0")) for i in range(49)])
    kept, _ = S.read_flows(spark, folder, "unsw")
    return N.canonical_flows(kept.withColumn("flow_id", F.monotonically_increasing_id()), "unsw",
                             dictionary=N.category_dictionary(f, "protocol")).select(*_OUT, "detailed_label")


@query("read_cicids", """
select date_us // 1000000 * 1000000 as date_us, src_ip, dst_ip, src_port, dst_port, case protocol_num when 0 then 'IP' when 1 then 'ICMP'
 when 2 then 'IGMP' else 'proto_3' end as protocol, protocol_num, duration, src_bytes, dst_bytes, label, detailed_label
from flows where protocol_num >= 0""")
def read_cicids(spark, sf):
    f = flows(spark, sf)
    code = F.when(F.col("protocol_num") >= 0, _text("protocol_num")).otherwise("")  # rows with a gap are dropped
    at = {1: "src_ip", 2: _text("src_port"), 3: "dst_ip", 4: _text("dst_port"), 5: code, 6: _time("d/M/yyyy H:mm:ss"), 7: _text("duration"),
          10: _text("src_bytes"), 11: _text("dst_bytes"), 84: "detailed_label"}
    folder = _written(f, [at.get(i, F.lit("1")) for i in range(85)])
    kept, _ = S.read_flows(spark, folder, "cicids", header=False)
    return _canonical(kept, "cicids").select(*_OUT, "detailed_label")


@query("label_store", """
select flow_id, case when label = 1 then 'anomalous' else 'benign' end as label_class from flows where label = 1 or protocol_num = 0""")
def label_store(spark, sf):
    """Flows stored by class and read back without the background."""
    named = (F.when(F.col("label") == 1, "flow=From-Botnet").when(F.col("protocol_num") == 0, "flow=From-Normal").otherwise("flow=Background"))
    folder = scratch_folder(spark)
    S.write_label_store(flows(spark, sf).withColumn("named", named).withColumn("label_class", label_class("ctu_bi", "named")), folder)
    return S.read_label_store(spark, folder).select("flow_id", F.col("label_class").cast("string").alias("label_class"))


@query("trace_files", f"""with {IDX},{CW}
select entity, pos, cast(protocol_num as double) as a, cast(src_bytes as double) as b from cw""")
def trace_files(spark, sf):
    """Trace text written per entity and read back."""
    lines = X.trace_lines(count_windows(index_flows(flows(spark, sf))), ["protocol_num", "src_bytes"])
    folder = scratch_folder(spark)
    X.write_traces(lines, X.trace_headers(lines, 2), folder)
    read = X.read_traces(spark, folder)
    return read.select(F.col("entity").cast("string").alias("entity"), "pos", F.col("attrs")[0].alias("a"), F.col("attrs")[1].alias("b"))


@query("results_store", "select src_ip as entity, 'all' as test_set, count(*) as tp from flows group by 1")
def results_store(spark, sf):
    folder = scratch_folder(spark)
    counts = flows(spark, sf).groupBy(F.col("src_ip").alias("entity")).agg(F.count(F.lit(1)).alias("tp"))
    store.write_results(counts.withColumn("test_set", F.lit("all")), folder)
    return store.load_results(spark, folder, ["all"]).select("entity", F.col("test_set").cast("string").alias("test_set"), "tp")


def _machine_text(transitions, edge):
    """Text of each learned machine."""
    body = F.concat_ws("\n\t", F.sort_array(F.collect_list(edge)))
    return transitions.groupBy("model_id").agg(F.concat(F.lit("digraph {\n\t"), body, F.lit("\n}\n")).alias("value"))


@query("parsed_symbolic_machines", BASE + "," + EDGES + " select model_id, replace(replace(src, 's', '1'), 'start', '0') as src, symbol, replace(dst, 's', '1') as dst, cnt from ed")
def parsed_symbolic_machines(spark, sf):
    """Learned machines written as text and parsed."""
    limits, v = trained(spark, sf)
    edges = Y.edges_from_context(M.learn_state_model(v, limits).transitions)
    plain = edges.withColumns({c: F.regexp_replace(c, "s", "1") for c in ("src", "dst")})
    edge = F.format_string('%s -> %s [label="%s:%d"  ];', "src", "dst", "symbol", "cnt")
    return D.parse_symbolic_models(_machine_text(plain, edge)).select("model_id", "src", "symbol", "dst", "cnt")


@query("parsed_state_machines", BASE + """, c as (select model_id, case when state = 'start' then '0' else '1' || state end as src, '1' || next_state as dst,
  count(*) as cnt from train_v group by 1, 2, 3)
select model_id, src, dst, cast(0 as int) as attr, '<=' as op, cast(cnt as double) as bound from c
union all select model_id, src, dst, 1, '>', cnt / 4 from c""")
def parsed_state_machines(spark, sf):
    limits, v = trained(spark, sf)
    edges = M.learn_state_model(v, limits).transitions.withColumns({
        "src": F.when(F.col("src") == "start", "0").otherwise(F.concat(F.lit("1"), "src")), "dst": F.concat(F.lit("1"), "dst")})
    quarter = (F.col("cnt") / 4).cast("string")
    edge = F.concat(F.format_string('%s -> %s [label="0 <= %d 1 > ', "src", "dst", "cnt"), quarter, F.lit('" ];'))
    _, _, transitions = D.parse_state_models(_machine_text(edges, edge))
    rows = transitions.select("model_id", "src", "dst", F.explode("clauses").alias("_c"))
    return rows.select("model_id", "src", "dst", F.inline("_c"))
