"""Detectors on the models of each host's test set."""

from pyspark.sql import Window, functions as F

from flowloom.operators import discretise, machine as M
from flowloom.operators.detectors import forest, kde, lof, stats

from .catalog import flows, query
from .profile import ATTRS, BASE, ON_MODELS, STATES, assigned_models, tested, trained

KEYS = ["model_id", "entity", "trace_id", "pos", "state"]


def visits_on_models(spark, sf, attrs=ATTRS):
    """Training visits, and the test visits of every host on all models of its test set."""
    limits, v = trained(spark, sf, attrs)
    test = tested(spark, sf, limits, attrs)
    return limits, v, M.replay_context(test, M.learn_state_model(v, limits).states, assigned_models(v, test))


RUN = BASE + "," + STATES + "," + ON_MODELS
FIT = """ ft as (select model_id, state, count(*) as n, avg(src_bytes) as m0, avg(dst_port) as m1, stddev_pop(src_bytes) as s0,
  stddev_pop(dst_port) as s1, avg(dst_bytes) as m2, stddev_pop(dst_bytes) as s2 from train_v group by 1, 2 having count(*) > 2)"""
HIT = {
    "any": "abs(src_bytes - m0) - 2 * s0 > 1e-9 or abs(dst_port - m1) - 2 * s1 > 1e-9",
    "all": "abs(src_bytes - m0) - 2 * s0 > 1e-9 and abs(dst_port - m1) - 2 * s1 > 1e-9",
    "majority": " + ".join(f"case when abs({c} - m{i}) - 2 * s{i} > 1e-9 then 1 else 0 end" for i, c in enumerate(("src_bytes", "dst_port", "dst_bytes"))) + " > 1",
}


def scored_sql(rule="any"):
    return f""" sc as (select r.*, case when n is null then 1 when {HIT[rule]} then 1 else 0 end as pred
   from rv r left join ft using (model_id, state))"""


@query("fit_stats", BASE + "," + FIT + """
select model_id, state, n, round(m0, 6) as mean_0, round(m1, 6) as mean_1, round(s0, 6) as std_0, round(s1, 6) as std_1 from ft""")
def fit_stats(spark, sf):
    _, v = trained(spark, sf)
    fit = stats.fit_stats(v, 2)
    return fit.select("model_id", "state", "n", *[
        F.round(F.col(c)[i], 6).alias(f"{c}_{i}") for c in ("mean", "std") for i in range(2)])


def _baseline(rule):
    @query(f"baseline_{rule}", RUN + "," + FIT + "," + scored_sql(rule) + " select model_id, entity, trace_id, pos, state, pred from sc")
    def run(spark, sf):
        # two attributes can't tell a majority from all
        attrs = [*ATTRS, "dst_bytes"] if rule == "majority" else ATTRS
        _, v, test = visits_on_models(spark, sf, attrs)
        return stats.score_stats(test, stats.fit_stats(v, len(attrs)), rule=rule).select(*KEYS, "pred")

    return run


for _rule in HIT:
    _baseline(_rule)


QFIT = """ qf as (select model_id, state, count(*) as n, quantile_cont(src_bytes, [0.25, 0.5, 0.75]) as q0,
  quantile_cont(dst_port, [0.25, 0.5, 0.75]) as q1 from train_v group by 1, 2 having count(*) > 2)"""


@query("state_quantiles", BASE + "," + QFIT + """
select model_id, state, n, round(q0[1], 6) as a1, round(q0[2], 6) as a2, round(q0[3], 6) as a3, round(q1[1], 6) as b1,
 round(q1[2], 6) as b2, round(q1[3], 6) as b3 from qf""")
def state_quantiles(spark, sf):
    _, v = trained(spark, sf)
    fit = stats.fit_state_quantiles(v, 2)
    return fit.select("model_id", "state", "n", *[
        F.round(F.col("limits")[i][j], 6).alias(f"{n}{j + 1}") for i, n in enumerate("ab") for j in range(3)])


def _place(q, v):
    return f"(1 + case when {v} > {q}[1] then 1 else 0 end + case when {v} > {q}[2] then 1 else 0 end + case when {v} > {q}[3] then 1 else 0 end)"


_PRIOR = "".join(
    f""", {name} as (select model_id, state, [(b0 + 1) / (n + 4), (b1 + 1) / (n + 4), (b2 + 1) / (n + 4), (b3 + 1) / (n + 4)] as p from (
  select model_id, state, count(*) as n, """ + ", ".join(
        f"count(*) filter ({_place(l, v)} - 1 = {b}) as b{b}" for b in range(4)) + " from train_v, lim group by 1, 2))"
    for name, l, v in (("pa", "ls", "src_bytes"), ("pb", "ld", "dst_bytes")))


@query("quantile_detector", (RUN + "," + QFIT + _PRIOR).replace("select t.entity, t.trace_id, t.pos, t.row_idx, t.flow_id, t.src_bytes, t.dst_port",
       "select t.entity, t.trace_id, t.pos, t.row_idx, t.flow_id, t.src_bytes, t.dst_bytes").replace("quantile_cont(dst_port", "quantile_cont(dst_bytes") + f""",
 z as (select r.*, case when qf.n is not null then pa.p[{_place('q0', 'src_bytes')}] * pb.p[{_place('q1', 'dst_bytes')}] end as score,
   list_min(pa.p) * list_min(pb.p) as low, list_max(pa.p) * list_max(pb.p) as high
  from rv r left join qf using (model_id, state) left join pa using (model_id, state) left join pb using (model_id, state))
select model_id, entity, trace_id, pos, state, round(score, 9) as score,
 case when score is null then 1 when score < low + (high - low) / 1000000 then 1 else 0 end as pred from z""")
def quantile_detector(spark, sf):
    attrs = ["src_bytes", "dst_bytes"]
    limits, v, test = visits_on_models(spark, sf, attrs)
    priors = stats.pack_priors(M.bin_priors(M.state_bins(v, limits)), attrs)
    scored = stats.score_quantiles(test, stats.fit_state_quantiles(v, 2), priors)
    return scored.select(*KEYS, F.round("score", 9).alias("score"), "pred")


@query("robust_scaling", RUN + "," + QFIT + """
select model_id, entity, trace_id, pos, r.state,
 round(case when n is null then src_bytes else (src_bytes - q0[2]) / (case when q0[3] = q0[1] then 1 else q0[3] - q0[1] end) end, 6) as x0,
 round(case when n is null then dst_port else (dst_port - q1[2]) / (case when q1[3] = q1[1] then 1 else q1[3] - q1[1] end) end, 6) as x1
from rv r left join qf using (model_id, state)""")
def robust_scaling(spark, sf):
    _, v, test = visits_on_models(spark, sf)
    scaled = stats.robust_scale(test, stats.fit_scaler(v, 2))
    return scaled.select(*KEYS, *[F.round(F.col("attrs")[i], 6).alias(f"x{i}") for i in range(2)])


# ---- density ----

_POINTS = """ pt as (select model_id, state, src_bytes as x, dst_port as y, count(*) as w from train_v group by 1, 2, 3, 4),
 sz as (select model_id, state, sum(w) as n from pt group by 1, 2 having sum(w) > 2),
 kk as (select *, greatest(1, least(cast(ceil({share} * n) as bigint), n - 1)) as k from sz)"""
_DIST = "sqrt(cast((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) as double))"


def _nearest(name, source, self_weight):
    """Distances with the weight reached so far, and the k-distance of each query point."""
    return f""" {name}d as (select a.model_id, a.state, a.x, a.y, b.x as bx, b.y as bY, k, {_DIST} as d, {self_weight} as w
   from {source} a join pt b using (model_id, state) join kk using (model_id, state)),
 {name}c as (select *, sum(w) over (partition by model_id, state, x, y order by d range unbounded preceding) as reached from {name}d),
 {name}k as (select model_id, state, x, y, min(k) as k, min(d) filter (reached >= k) as kd from {name}c group by 1, 2, 3, 4)"""


def _mean_k(value, d, kd):
    """Mean over exactly k neighbours; those tied at the edge share the places left."""
    return f"""(coalesce(sum(w * {value}) filter ({d} < {kd}), 0) + (max(k) - coalesce(sum(w) filter ({d} < {kd}), 0))
  * (sum(w * {value}) filter ({d} = {kd})) / (sum(w) filter ({d} = {kd}))) / max(k)"""


LOF = (_POINTS.format(share="0.1") + "," + _nearest("f", "pt", "case when a.x = b.x and a.y = b.y then b.w - 1 else b.w end") + f""",
 fr as (select c.model_id, c.state, c.x, c.y, c.d, c.w, q.k, q.kd, greatest(o.kd, c.d) as reach
   from fc c join fk q using (model_id, state, x, y) join fk o on o.model_id = c.model_id and o.state = c.state and o.x = c.bx and o.y = c.bY),
 fl as (select model_id, state, x, y, 1 / ({_mean_k('reach', 'd', 'kd')} + 1e-10) as lrd from fr group by 1, 2, 3, 4),
 qp as (select distinct model_id, state, src_bytes as x, dst_port as y from rv),""" + _nearest("t", "qp", "b.w") + f""",
 tr as (select c.model_id, c.state, c.x, c.y, c.d, c.w, q.k, q.kd, greatest(o.kd, c.d) as reach, l.lrd
   from tc c join tk q using (model_id, state, x, y)
   join fk o on o.model_id = c.model_id and o.state = c.state and o.x = c.bx and o.y = c.bY
   join fl l on l.model_id = c.model_id and l.state = c.state and l.x = c.bx and l.y = c.bY),
 lf as (select model_id, state, x as src_bytes, y as dst_port, {_mean_k('lrd', 'd', 'kd')} * ({_mean_k('reach', 'd', 'kd')} + 1e-10) as lof
   from tr group by 1, 2, 3, 4)""")


@query("state_lof", RUN + "," + LOF + """
select model_id, entity, trace_id, pos, r.state, case when lof is null then 1 when lof > 1.5 then 1 else 0 end as pred,
 case when lof > 1e6 then 1e6 else round(lof, 6) end as score
from rv r left join lf using (model_id, state, src_bytes, dst_port)""")
def state_lof(spark, sf):
    _, v, test = visits_on_models(spark, sf)
    scored = lof.score_lof(test, lof.fit_lof(v))
    # duplicates make densities of 1e10, whose last digits differ by summation order
    score = F.when(F.col("score") > 1e6, 1e6).otherwise(F.round("score", 6))
    return scored.select(*KEYS, "pred", score.alias("score"))


KDE = """ cv as (select model_id, state, count(*) as n, covar_samp(src_bytes, src_bytes) + 1e-8 as c00, covar_samp(src_bytes, dst_port) as c01,
  covar_samp(dst_port, dst_port) + 1e-8 as c11 from train_v group by 1, 2 having count(*) > 2),
 bw as (select *, power(n, -2.0 / 6) as f, c00 * c11 - c01 * c01 as det from cv),
 pt as (select model_id, state, src_bytes as x, dst_port as y, count(*) as w from train_v group by 1, 2, 3, 4),
 qp as (select distinct model_id, state, src_bytes as x, dst_port as y from rv),
 kt as (select a.model_id, a.state, a.x, a.y, sum(b.w * exp(-0.5 * (c11 * (a.x - b.x) * (a.x - b.x) - 2 * c01 * (a.x - b.x) * (a.y - b.y)
     + c00 * (a.y - b.y) * (a.y - b.y)) / (det * f))) / (max(n) * 2 * pi() * max(f) * sqrt(max(det))) as dens
   from pt a join pt b using (model_id, state) join bw using (model_id, state) group by 1, 2, 3, 4),
 kl as (select model_id, state, min(dens) + (max(dens) - min(dens)) / 10 as lim from kt group by 1, 2),
 kq as (select a.model_id, a.state, a.x as src_bytes, a.y as dst_port, sum(b.w * exp(-0.5 * (c11 * (a.x - b.x) * (a.x - b.x) - 2 * c01 * (a.x - b.x) * (a.y - b.y)
     + c00 * (a.y - b.y) * (a.y - b.y)) / (det * f))) / (max(n) * 2 * pi() * max(f) * sqrt(max(det))) as dens
   from qp a join pt b using (model_id, state) join bw using (model_id, state) group by 1, 2, 3, 4)"""


@query("state_kde", RUN + "," + KDE + """
select model_id, entity, trace_id, pos, r.state, round(dens, 9) as score,
 case when dens is null then 1 when dens < lim then 1 else 0 end as pred
from rv r left join kq using (model_id, state, src_bytes, dst_port) left join kl using (model_id, state)""")
def state_kde(spark, sf):
    _, v, test = visits_on_models(spark, sf)
    scored = kde.score_kde(test, v, kde.fit_kde(v, 2))
    return scored.select(*KEYS, F.round("score", 9).alias("score"), "pred")


@query("state_forest")
def state_forest(spark, sf):
    _, v, test = visits_on_models(spark, sf)
    return forest.detect_forest(test, v, 2, ["entity", "trace_id", "pos"]).select(*KEYS, F.round("score", 6).alias("score"), "pred")


# ---- bins ----

_NEXT = """d{k} as materialized (select p.j, p.w, p.l, p.q,
  min(d.c + greatest(p.q - d.q - (p.l - d.l) * (p.l - d.l) / (p.w - d.w), 0)) as c
  from p join d{j} d on d.j < p.j group by p.j, p.w, p.l, p.q union all select j, w, l, q, 0 from p where j = 0)"""
_ELBOW = """with h as materialized (select cast(src_bytes as double) as v, count(*) as n from flows group by 1),
 m as materialized (select sum(v * n) / sum(n) as mean from h),
 p as materialized (select row_number() over (order by v) - 1 as j, sum(n) over (order by v) as w, sum(n * (v - mean)) over (order by v) as l,
  sum(n * (v - mean) * (v - mean)) over (order by v) as q from h, m),
 d1 as materialized (select *, q - l * l / w as c from p), """ + ", ".join(_NEXT.format(k=k, j=k - 1) for k in range(2, 11)) + """,
 ec as materialized (""" + " union all ".join(f"select {k} as k, c from d{k} where j = (select max(j) from p)" for k in range(1, 11)) + """),
 es as materialized (select k, c / (select c from ec where k = 1) as share from ec)"""


@query("elbow_costs", _ELBOW + " select k, round(share, 9) as cost_share from es")
def elbow_costs(spark, sf):
    """Costs as shares of the cost of one cluster."""
    costs = discretise.elbow(flows(spark, sf), "src_bytes")
    one = F.max("cost").over(Window.partitionBy(F.lit(0)))  # ten rows; a single cluster costs most
    return costs.select("k", F.round(F.col("cost") / one, 9).alias("cost_share"))


@query("elbow_limits", _ELBOW + """,
 kn as materialized (select arg_max(k, gap) as k from (select k, 1 + ((select share from es where k = 10) - 1) * (k - 1) / 9 - share as gap from es)),
 ranked as materialized (select src_bytes as v, row_number() over (order by src_bytes) - 1 as j, count(*) over () as n from flows),
 asked as (select unnest(range(1, k)) as i, k from kn),
 spot as (select i, (n - 1) * (i / k) as x from asked, (select max(n) as n from ranked))
select 'src_bytes' as feature, i as place, round(lo.v + (hi.v - lo.v) * (x - floor(x)), 6) as bound
from spot join ranked lo on lo.j = cast(floor(x) as bigint) join ranked hi on hi.j = cast(ceil(x) as bigint)""")
def elbow_limits(spark, sf):
    """As many bins as the knee of the costs says."""
    rows = discretise.elbow_limits(flows(spark, sf), "src_bytes").select("feature", F.posexplode("limits").alias("at", "v"))
    return rows.select("feature", (F.col("at") + 1).cast("long").alias("place"), F.round("v", 6).alias("bound"))


@query("percentile_limits", """
select 'src_bytes' as feature, i as place, round(v, 6) as bound from (select quantile_cont(src_bytes, [1 / 7, 2 / 7, 3 / 7, 4 / 7, 5 / 7, 6 / 7]) as q
 from flows), unnest(q) with ordinality t(v, i)""")
def percentile_limits(spark, sf):
    limits = discretise.percentile_limits(flows(spark, sf), "src_bytes", 7)
    rows = limits.select("feature", F.posexplode("limits").alias("at", "v"))
    return rows.select("feature", (F.col("at") + 1).cast("long").alias("place"), F.round("v", 6).alias("bound"))
