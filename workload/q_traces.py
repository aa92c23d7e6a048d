"""Sessions, windows, aggregated records, trace text."""

from pyspark.sql import functions as F

from flowloom.functions.scan import OrderedScan
from flowloom.operators import dynamic, features as R, traces as T
from flowloom.operators.entities import entity_flows, index_flows
from flowloom.session import freeze
from flowloom.operators.similarity import similar_traces, trace_dissimilarity
from flowloom.sources import traces as text

from .catalog import DAY_US, LINEITEM_ORDER, flows, lineitem_flows, query

IDX = """ idx as (select src_ip as entity, *, row_number() over (partition by src_ip order by date_us, flow_id) - 1 as row_idx
 from flows)"""


def windows_sql(source="idx", size=100, stride=20, columns="*"):
    return f"""(select {columns}, unnest(generate_series(
  cast(case when row_idx < {size} then 0 else (row_idx - {size}) // {stride} + 1 end as bigint), cast(row_idx // {stride} as bigint)))
  as trace_id from {source})"""


CW = f" cw as (select *, row_idx - trace_id * 20 as pos from {windows_sql()})"

SES = f""" g as (select src_ip as entity, *, date_us - lag(date_us) over w as gap_us, row_number() over w - 1 as row_idx
  from flows window w as (partition by src_ip order by date_us, flow_id)),
 ses as (select *, cast(sum(case when gap_us > {DAY_US} then 1 else 0 end)
   over (partition by entity order by date_us, flow_id rows unbounded preceding) as bigint) as session_id,
   case when gap_us <= {DAY_US} then gap_us end as inner_gap_us from g)"""

PAR = """ par as (select entity, session_id, count(*) as n_flows, min(date_us) as first_us, max(date_us) as last_us,
  cast(coalesce(quantile_cont(inner_gap_us, 0.5), 0) * 2 as bigint) as half from ses group by 1, 2),
 prm as (select entity, session_id, n_flows, first_us, last_us,
  cast(case when half > 0 then half * 12500 else 25000000 end as bigint) as window_ns,
  cast(case when half > 0 then half * 2500 else 5000000 end as bigint) as stride_ns,
  cast(least(greatest(n_flows // 10000, 10), n_flows) as bigint) as min_len, cast(1500 as bigint) as max_len from par)"""

_AT = """ tat as (select s.*, (s.date_us - p.first_us) * 1000 as r, window_ns as w, stride_ns as st,
   (p.last_us - p.first_us) * 1000 as span from ses s join prm p using (entity, session_id)),
 tl as (select *, case when span > w then (span - w - 1) // st + 1 else 0 end as tail,
   case when r > w then (r - w + st - 1) // st else 0 end as low from tat)"""

TW = "with" + SES + "," + PAR + "," + _AT + """,
 k as (select entity, session_id, row_idx, flow_id, unnest(generate_series(low, least(r // st, tail))) as k from tl
       where low <= least(r // st, tail)),
 t as (select *, session_id * 4294967296 + k as trace_id from k)
select entity, trace_id, row_idx - min(row_idx) over (partition by entity, trace_id) as pos, row_idx, flow_id from t"""

_TW_WHOLE = "with" + SES + "," + PAR + "," + _AT + """,
 k as (select entity, session_id, row_idx, flow_id, unnest(generate_series(low, least(r // st, tail - 1))) as k from tl
       where low <= least(r // st, tail - 1)
       union all select entity, session_id, row_idx, flow_id, tail from tl),
 t as (select *, session_id * 4294967296 + k as trace_id from k)
select entity, trace_id, row_idx - min(row_idx) over (partition by entity, trace_id) as pos, row_idx, flow_id from t"""

TRACE_COLUMNS = ["entity", "trace_id", "pos", "row_idx", "flow_id"]


def sessions(spark, sf):
    # read by the parameters and by the windows: computed once
    return freeze(T.sessionize(entity_flows(flows(spark, sf)), DAY_US))


def count_traces(spark, sf):
    return T.count_windows(index_flows(flows(spark, sf)))


@query("time_gaps", """
select src_ip as entity, flow_id, date_us - lag(date_us) over (partition by src_ip order by date_us, flow_id) as gap_us from flows""")
def time_gaps(spark, sf):
    return T.sessionize(entity_flows(flows(spark, sf))).select("entity", "flow_id", "gap_us")


@query("sessionize", "with" + SES + " select entity, row_idx, flow_id, session_id from ses")
def sessionize(spark, sf):
    return T.sessionize(entity_flows(flows(spark, sf)), DAY_US).select("entity", "row_idx", "flow_id", "session_id")


@query("sessionize_default", "with" + SES.replace(str(DAY_US), "1800000000") + " select entity, row_idx, flow_id, session_id from ses")
def sessionize_default(spark, sf):
    return T.sessionize(entity_flows(flows(spark, sf))).select("entity", "row_idx", "flow_id", "session_id")


@query("window_params", "with" + SES + "," + PAR + " select entity, session_id, n_flows, window_ns, stride_ns from prm")
def window_params(spark, sf):
    return T.session_params(sessions(spark, sf)).select("entity", "session_id", "n_flows", "window_ns", "stride_ns")


@query("trace_limits", "with" + SES + "," + PAR + " select entity, session_id, min_len, max_len from prm")
def trace_limits(spark, sf):
    return T.session_params(sessions(spark, sf)).select("entity", "session_id", "min_len", "max_len")


@query("count_windows", f"with {IDX},{CW} select entity, trace_id, pos, row_idx, flow_id from cw")
def count_windows(spark, sf):
    return count_traces(spark, sf).select(*TRACE_COLUMNS)


_LINE_IDX = """ idx as (select concat('s', l_suppkey) as entity, l_quantity, l_extendedprice,
 row_number() over (partition by l_suppkey order by l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as row_idx
 from lineitem)"""


@query("count_windows_lineitem", "with" + _LINE_IDX + f""",
 cw as (select *, row_idx - trace_id * 20 as pos from {windows_sql()})
select entity, trace_id, count(*) as n, round(sum(l_quantity), 6) as quantity, round(avg(l_extendedprice), 6) as price
from cw group by 1, 2""")
def count_windows_lineitem(spark, sf):
    indexed = OrderedScan(lineitem_flows(spark, sf), ["entity"], LINEITEM_ORDER).index("row_idx").result()
    return T.count_windows(indexed).groupBy("entity", "trace_id").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 6).alias("quantity"),
        F.round(F.avg("l_extendedprice"), 6).alias("price"))


@query("time_windows", TW)
def time_windows(spark, sf):
    s = sessions(spark, sf)
    return T.time_windows(s, T.session_params(s)).select(*TRACE_COLUMNS)


@query("time_windows_whole_tail", _TW_WHOLE)
def time_windows_whole_tail(spark, sf):
    s = sessions(spark, sf)
    return T.time_windows(s, T.session_params(s), "whole").select(*TRACE_COLUMNS)


@query("dynamic_windows")
def dynamic_windows(spark, sf):
    s = sessions(spark, sf)
    return dynamic.dynamic_windows(s, T.session_params(s)).select(*TRACE_COLUMNS)


@query("trace_coverage", TW.replace("select entity, trace_id, row_idx - min", """, z as (select entity, trace_id, row_idx - min""")
       + """) select cast(count(*) as bigint) as uncovered from ses where (entity, row_idx) not in (select (entity, row_idx) from z)""")
def trace_coverage(spark, sf):
    s = sessions(spark, sf)
    missing = T.uncovered_flows(s, T.time_windows(s, T.session_params(s)))
    return missing.agg(F.count(F.lit(1)).alias("uncovered"))


_FEATURES = ["dst_port", "protocol_num", "src_bytes", "duration", "dst_ip"]
_ROUND = {"std_dst_ports", "std_protocol_num", "median_src_bytes", "std_src_bytes", "median_duration", "std_duration",
          "median_dst_port"}


def _rounded(df):
    return df.select(*[F.round(c, 6).alias(c) if c in _ROUND else F.col(c) for c in df.columns])


def _stat_sql(over):
    o = f" over {over}" if over else ""
    return f"""count(distinct dst_port){o} as unique_dst_ports, stddev_samp(dst_port){o} as std_dst_ports,
 stddev_samp(protocol_num){o} as std_protocol_num, median(src_bytes){o} as median_src_bytes,
 stddev_samp(src_bytes){o} as std_src_bytes, median(duration){o} as median_duration, stddev_samp(duration){o} as std_duration,
 count(distinct dst_ip){o} as unique_dst_ips"""


_OUT = """round({0}std_dst_ports, 6) as std_dst_ports, round({0}std_protocol_num, 6) as std_protocol_num,
 round(median_src_bytes, 6) as median_src_bytes, round({0}std_src_bytes, 6) as std_src_bytes,
 round(median_duration, 6) as median_duration, round({0}std_duration, 6) as std_duration, unique_dst_ips, unique_dst_ports"""

# the mode of a frame: counts per value inside the frame, ties to the smallest
_MODE_ROLL = """ m as (select entity, trace_id, pos, protocol_num as argmax_protocol_num from (
  select a.entity, a.trace_id, a.pos, b.protocol_num,
   row_number() over (partition by a.entity, a.trace_id, a.pos order by count(*) desc, b.protocol_num) as rn
  from cw a join cw b on a.entity = b.entity and a.trace_id = b.trace_id and b.pos between a.pos - 9 and a.pos
  group by 1, 2, 3, 4) where rn = 1)"""
_FILL = "".join(
    f", coalesce({c}, lead({c}) over (partition by entity, trace_id order by pos)) as f_{c}"
    for c in ("std_dst_ports", "std_protocol_num", "std_src_bytes", "std_duration"))


@query("rolling_features", f"with {IDX},{CW},{_MODE_ROLL}," + f"""
 r as (select entity, trace_id, pos, row_idx, flow_id, {_stat_sql('w')} from cw
  window w as (partition by entity, trace_id order by pos rows between 9 preceding and current row)),
 f as (select *{_FILL} from r)
select entity, trace_id, pos, row_idx, flow_id, argmax_protocol_num, {_OUT.format('f_')} from f join m using (entity, trace_id, pos)""")
def rolling_features(spark, sf):
    return _rounded(R.rolling_features(count_traces(spark, sf), _FEATURES))


def _bin_sql(key):
    return f"""
 kb as (select *, {key} as bin from tr),
 s as (select entity, trace_id, bin, count(*) as n_flows, {_stat_sql('')} from kb group by 1, 2, 3),
 m as (select entity, trace_id, bin, protocol_num as argmax_protocol_num from (select entity, trace_id, bin, protocol_num,
   row_number() over (partition by entity, trace_id, bin order by count(*) desc, protocol_num) as rn from kb group by 1, 2, 3, 4)
  where rn = 1)
select entity, trace_id, bin as KEY, n_flows, argmax_protocol_num, {_OUT.format('')}
from s join m using (entity, trace_id, bin) where n_flows > 1"""


@query("block_features", f"with {IDX},{CW}, tr as (select * from cw)," + _bin_sql("row_idx // 5").replace("KEY", "block"))
def block_features(spark, sf):
    return _rounded(R.block_features(count_traces(spark, sf), _FEATURES))


@query("block_features_reduced", f"""with {IDX},{CW}
select entity, trace_id, row_idx // 5 as block, count(*) as n_flows, round(median(dst_port), 6) as median_dst_port,
 round(median(src_bytes), 6) as median_src_bytes from cw group by 1, 2, 3""")
def block_features_reduced(spark, sf):
    return _rounded(R.block_features(count_traces(spark, sf), ["dst_port", "src_bytes"], new_features=False))


@query("resample_features", TW.replace("select entity, trace_id, row_idx - min", ", tr as (select f.*, t.entity, t.trace_id, t.row_idx - min")
       .replace("as pos, row_idx, flow_id from t", "as pos from t join flows f using (flow_id)),")
       + _bin_sql("date_us // 21600000000").replace("KEY", "bin"))
def resample_features(spark, sf):
    s = sessions(spark, sf)
    return _rounded(R.resample_features(T.time_windows(s, T.session_params(s)), _FEATURES, 21_600_000_000))


@query("bin_flows", f"""with {IDX},{CW}, b as (select entity, trace_id, row_idx // 5 as block from cw group by 1, 2, 3 having count(*) > 1)
select entity, trace_id, block, flow_id from cw join b on cw.entity = b.entity and cw.trace_id = b.trace_id and row_idx // 5 = block""".replace(
    "select entity, trace_id, block, flow_id from cw", "select cw.entity, cw.trace_id, block, flow_id from cw"))
def bin_flows(spark, sf):
    t = count_traces(spark, sf)
    bins = R.block_features(t, ["src_bytes"])
    return R.bin_flows(t, bins, "block", 5).select("entity", "trace_id", "block", "flow_id")


_RECORD = "concat_ws(',', cast(protocol_num as bigint), src_bytes, dst_bytes)"
_COLUMNS = ["protocol_num", "src_bytes", "dst_bytes"]


@query("trace_lines", f"""with {IDX},{CW}
select entity, trace_id, '1 ' || count(*) || ' 0:' || string_agg({_RECORD}, ' 0:' order by pos) as line from cw group by 1, 2""")
def trace_lines(spark, sf):
    return text.trace_lines(count_traces(spark, sf), _COLUMNS)


@query("symbolic_trace_lines", f"""with {IDX},{CW}
select entity, trace_id, '1 ' || count(*) || ' ' || string_agg(cast(dst_port as varchar), ' ' order by pos) as line from cw group by 1, 2""")
def symbolic_trace_lines(spark, sf):
    return text.trace_lines(count_traces(spark, sf), ["dst_port"], symbolic=True)


@query("trace_headers", f"""with {IDX},{CW}
select entity, count(distinct trace_id) || ' 100:3' as header from cw group by 1""")
def trace_headers(spark, sf):
    return text.trace_headers(text.trace_lines(count_traces(spark, sf), _COLUMNS), 3)


@query("trace_round_trip", f"""with {IDX},{CW}
select entity, trace_id, pos, cast(protocol_num as double) as a, cast(src_bytes as double) as b, cast(dst_bytes as double) as c from cw""")
def trace_round_trip(spark, sf):
    rows = text.parse_lines(text.trace_lines(count_traces(spark, sf), _COLUMNS))
    return rows.select("entity", "trace_id", "pos", *[F.col("attrs")[i].alias(n) for i, n in enumerate("abc")])


@query("symbolic_round_trip", f"""with {IDX},{CW} select entity, trace_id, pos, cast(dst_port as varchar) as symbol from cw""")
def symbolic_round_trip(spark, sf):
    return text.parse_lines(text.trace_lines(count_traces(spark, sf), ["dst_port"], symbolic=True), symbolic=True)


_SPAN = "case when hi[{k}] = lo[{k}] then 1 else hi[{k}] - lo[{k}] end"
_APART = " + ".join(f"power((u[{k}] - v[{k}]) / sp[{k}], 2)" for k in (1, 2, 3))
WARPED = f"""with {IDX},{CW},
 tr as materialized (select entity, trace_id, list([{", ".join(f"cast({c} as double)" for c in _COLUMNS)}] order by pos) as r from cw group by 1, 2),
 pr as (select a.entity, a.trace_id, a.r as x, b.r as y, list_concat(a.r, b.r) as xy from tr a join tr b on b.entity = a.entity and b.trace_id = a.trace_id - 1),
 lh as (select *, [{", ".join(f"list_min(list_transform(xy, lambda v: v[{k}]))" for k in (1, 2, 3))}] as lo,
   [{", ".join(f"list_max(list_transform(xy, lambda v: v[{k}]))" for k in (1, 2, 3))}] as hi from pr),
 sc as (select entity, trace_id, x, y, [{", ".join(_SPAN.format(k=k) for k in (1, 2, 3))}] as sp from lh),
 wp as materialized (select entity, trace_id, sqrt(list_reduce(list_transform(x, lambda u: list_transform(y, lambda v: {_APART})),
   lambda best, c: list_reduce(list_transform(range(1, len(c) + 1), lambda j: [c[j], least(best[j], best[j + 1])]),
     lambda acc, z: list_append(acc, z[1] + least(z[2], acc[len(acc)])), [cast('inf' as double)]),
   list_concat([cast(0 as double)], list_transform(y, lambda v: cast('inf' as double))))[len(y) + 1]) as d from sc)"""


def neighbour_pairs(spark, sf):
    """Each trace beside the one before it of the same host."""
    attrs = F.array(*[F.col(c).cast("double") for c in _COLUMNS])
    packed = T.pack_traces(count_traces(spark, sf).withColumn("attrs", attrs), ["attrs"])
    now = packed.select("entity", "trace_id", F.col("records.attrs").alias("left"))
    before = packed.select("entity", (F.col("trace_id") + 1).alias("trace_id"), F.col("records.attrs").alias("right"))
    return now.join(before, ["entity", "trace_id"])


@query("trace_dissimilarity", WARPED + " select entity, trace_id, round(d, 6) as dissimilarity from wp")
def dissimilarity(spark, sf):
    scored = trace_dissimilarity(neighbour_pairs(spark, sf))
    return scored.select("entity", "trace_id", F.round("dissimilarity", 6).alias("dissimilarity"))


@query("similar_traces", WARPED + " select entity, trace_id, round(d, 6) as dissimilarity from wp where d <= 2.0")
def near_traces(spark, sf):
    scored = similar_traces(neighbour_pairs(spark, sf), 2.0)
    return scored.select("entity", "trace_id", F.round("dissimilarity", 6).alias("dissimilarity"))
