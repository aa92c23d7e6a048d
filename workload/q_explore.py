"""Entity views and exploration numbers."""

from pyspark.sql import functions as F

from flowloom.operators import explore as X

from .catalog import flows, query

_NUM = ["src_port", "dst_port", "src_bytes", "duration"]


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _view(keys):
    on = ", ".join(keys)
    return f"""with a as (select {on}, avg(src_port) as src_port, avg(duration) as duration, max(label) as label from flows group by {on}),
 m as (select {on}, protocol_num from (select {on}, protocol_num, row_number() over (partition by {on} order by count(*) desc, protocol_num) as rn
   from flows group by {on}, protocol_num) where rn = 1)
"""


@query("entity_view", _view(["src_ip"]) + "select src_ip, round(src_port, 6) as src_port, protocol_num, round(duration, 6) as duration, label from a join m using (src_ip)")
def entity_view(spark, sf):
    return _round(X.entity_view(flows(spark, sf), ["src_port", "protocol_num", "duration"]), "src_port", "duration")


@query("connection_view", _view(["src_ip", "dst_ip"]) + """
select src_ip, dst_ip, round(src_port, 6) as src_port, protocol_num, round(duration, 6) as duration, label from a join m using (src_ip, dst_ip)""")
def connection_view(spark, sf):
    view = X.entity_view(flows(spark, sf), ["src_port", "protocol_num", "duration"], "connection")
    return _round(view, "src_port", "duration")


@query("distinct_entities", """
select (select count(distinct src_ip) from flows) as n_hosts, (select count(*) from (select distinct src_ip, dst_ip from flows)) as n_connections""")
def distinct_entities(spark, sf):
    return X.distinct_entities(flows(spark, sf))


@query("flows_per_host", "select src_ip, count(*) as num_flows from flows group by 1")
def flows_per_host(spark, sf):
    return X.flows_per(flows(spark, sf), ["src_ip"])


@query("flows_per_connection", "select src_ip, dst_ip, count(*) as num_flows from flows group by 1, 2")
def flows_per_connection(spark, sf):
    return X.flows_per(flows(spark, sf), ["src_ip", "dst_ip"])


@query("flows_per_minute", """
with c as (select date_us // 60000000 as unit, count(*) as n from flows group by 1),
 l as (select unnest(generate_series((select min(unit) from c), (select max(unit) from c))) as unit)
select unit * 60000000 as start_us, coalesce(n, 0) as num_flows from l left join c using (unit)""")
def flows_per_minute(spark, sf):
    return X.flow_rate(flows(spark, sf), 60_000_000)


@query("flow_rate_profile", """
with c as (select date_us // 1000000 as unit, count(*) as n from flows group by 1),
 l as (select unnest(generate_series((select min(unit) from c), (select max(unit) from c))) as unit),
 r as (select unit, coalesce(n, 0) as num_flows from l left join c using (unit))
select num_flows, count(*) as seconds, min(unit) * 1000000 as first_us, max(unit) * 1000000 as last_us from r group by 1""")
def flow_rate_profile(spark, sf):
    """The per-second series, as seconds by number of flows."""
    rate = X.flow_rate(flows(spark, sf))
    return rate.groupBy("num_flows").agg(
        F.count(F.lit(1)).alias("seconds"), F.min("start_us").alias("first_us"), F.max("start_us").alias("last_us"))


def _histogram(column, bins, source="flows"):
    return f"""with e as (select cast(min({column}) as double) as lo, cast(max({column}) as double) as hi from {source}),
 p as (select cast(least(floor(({column} - lo) / ((hi - lo) / {bins})), {bins - 1}) as int) as bin, count(*) as n from {source}, e group by 1),
 l as (select cast(unnest(generate_series(0, {bins - 1})) as int) as bin)
select bin, round(lo + bin * ((hi - lo) / {bins}), 6) as low, round(lo + (bin + 1) * ((hi - lo) / {bins}), 6) as high, coalesce(n, 0) as n
from l left join p using (bin), e"""


def _register(name, column, bins, keys=None):
    source = f"(select count(*) as num_flows from flows group by {', '.join(keys)})" if keys else "flows"

    @query(name, _histogram(column, bins, source))
    def run(spark, sf):
        df = flows(spark, sf)
        return _round(X.histogram(X.flows_per(df, keys) if keys else df, column, bins), "low", "high")


_register("histogram_src_port", "src_port", 25)
_register("histogram_dst_port", "dst_port", 25)
_register("histogram_duration", "duration", 25)
_register("histogram_flows_per_host", "num_flows", 50, ["src_ip"])
_register("histogram_flows_per_connection", "num_flows", 50, ["src_ip", "dst_ip"])

_LONG = "u as (" + " union all ".join(f"select '{c}' as variable, cast({c} as double) as value from flows" for c in _NUM) + ")"
_QUART = "q as (select variable, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from u group by 1)"


@query("boxplot", f"""with {_LONG}, {_QUART}
select variable, round(q1, 6) as q1, round(median, 6) as median, round(q3, 6) as q3,
 round(min(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_low,
 round(max(value) filter (value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1)), 6) as whisker_high
from u join q using (variable) group by all""")
def boxplot(spark, sf):
    return _round(X.boxplot(flows(spark, sf), _NUM), "q1", "median", "q3", "whisker_low", "whisker_high")


@query("protocol_counts", "select protocol, count(*) as num_flows from flows group by 1")
def protocol_counts(spark, sf):
    return X.flows_per(flows(spark, sf), ["protocol"])


@query("summary", f"""with {_LONG}
select variable, count(value) as count, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, round(min(value), 6) as min,
 round(quantile_cont(value, 0.25), 6) as q1, round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q3,
 round(max(value), 6) as max from u group by 1""")
def summary(spark, sf):
    return _round(X.summary(flows(spark, sf), _NUM), "mean", "std", "min", "q1", "median", "q3", "max")


@query("exact_percentiles", """
select src_ip, round(quantile_cont(src_bytes, 0.1), 6) as p10, round(quantile_cont(src_bytes, 0.5), 6) as p50,
 round(quantile_cont(src_bytes, 0.99), 6) as p99 from flows group by 1""")
def exact_percentiles(spark, sf):
    from flowloom.functions.quantiles import exact_quantiles

    q = exact_quantiles(flows(spark, sf), ["src_ip"], ["src_bytes"], [0.1, 0.5, 0.99])
    return q.select("src_ip", *[F.round(F.col("q_src_bytes")[i], 6).alias(n) for i, n in enumerate(("p10", "p50", "p99"))])


_CORR = ["src_port", "protocol_num", "duration", "label"]
_V = _view(["src_ip"]).rstrip() + ", v as (select * from a join m using (src_ip))\n"


@query("correlations", _V + " union all ".join(
    f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from v" for a in _CORR for b in _CORR))
def correlations(spark, sf):
    view = X.entity_view(flows(spark, sf), ["src_port", "protocol_num", "duration"])
    return _round(X.correlations(view, _CORR), "corr")


@query("min_max_scaled", _V + "select src_ip, " + ", ".join(
    f"round(case when (select max({c}) - min({c}) from v) = 0 then 0 else ({c} - (select min({c}) from v)) / (select max({c}) - min({c}) from v) end, 6) as {c}"
    for c in _CORR) + " from v")
def min_max_scaled(spark, sf):
    view = X.entity_view(flows(spark, sf), ["src_port", "protocol_num", "duration"])
    return _round(X.min_max_scaled(view, _CORR), *_CORR).select("src_ip", *_CORR)


@query("named_parts", """
select flow_id, src_ip || (case when label = 1 then '_2' else '_1' end) as src_ip, case when label = 0 then 'Benign' else 'Malicious' end as label
from flows""")
def named_parts(spark, sf):
    f = flows(spark, sf).select("flow_id", "src_ip", "label")
    joined = X.named_parts({"1": f.filter("label = 0"), "2": f.filter("label = 1")})
    return X.label_names(joined)
