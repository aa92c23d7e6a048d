"""Merged predictions, confusion tables, thresholds, verdicts, the baseline."""

from pyspark.sql import DataFrame, functions as F

from flowloom.functions.scan import OrderedScan
from flowloom.operators import entities as E, evaluate as K, explore as X, machine as M
from flowloom.operators.detectors import lof, stats
from flowloom.session import freeze

from .catalog import query
from .profile import ASSIGNED, ATTRS, assigned_models, test_flows, tested, trained, visits
from .q_detect import FIT, RUN, scored_sql

TEST_SET, METHOD = "january", "baseline multivariate"
PRED = RUN + "," + FIT + "," + scored_sql() + """,
 le as (select model_id, 1 / (max(visits) + 1) as least from st group by 1),
 mp as (select model_id, entity, row_idx, sum(coalesce(weight, least) * pred) / sum(coalesce(weight, least)) as pred
  from sc left join wt using (model_id, state) join le using (model_id) group by 1, 2, 3)"""
CONF = """,
 ti as (select src_ip as entity, label, detailed_label, dst_ip, row_number() over (partition by src_ip order by date_us, flow_id) - 1 as row_idx
  from test),
 lp_ as (select model_id, entity, row_idx, label, detailed_label, dst_ip, cast(round_even(pred, 0) as int) as p from mp join ti using (entity, row_idx)),
 cf as (select entity, model_id, case when grouping(detailed_label) = 0 then 'label' when grouping(dst_ip) = 0 then 'dst_ip' else 'total' end as level,
   coalesce(detailed_label, dst_ip, '') as key, count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label <> 1 and p <> 1) as tn,
   count(*) filter (label <> 1 and p = 1) as fp, count(*) filter (label = 1 and p <> 1) as fn
  from lp_ group by grouping sets ((entity, model_id), (entity, model_id, detailed_label), (entity, model_id, dst_ip)))"""
def scored_visits(spark, sf):
    """Scored visits of all hosts on the models of their test sets, with the model states."""
    limits, v = trained(spark, sf)
    states = M.learn_state_model(v, limits).states
    test = tested(spark, sf, limits)
    replayed = M.replay_context(test, states, assigned_models(v, test))
    return stats.score_stats(replayed, stats.fit_stats(v, len(ATTRS))), states, v


def merged(spark, sf):
    """Windows meet a flow in two states at most (a trace's start, and its context): visits are counted before models multiply them."""
    limits, v = trained(spark, sf)
    states = freeze(M.state_weights(M.learn_state_model(v, limits).states))
    seen = visits(test_flows(spark, sf), limits).groupBy("entity", "row_idx", "state")
    test = freeze(seen.agg(F.first("attrs").alias("attrs"), F.count(F.lit(1)).alias("times")))
    replayed = M.replay_context(test, states, assigned_models(v, test))
    return K.merge_predictions(stats.score_stats(replayed, stats.fit_stats(v, len(ATTRS))), states, "times")


def many_confusion(spark, sf) -> DataFrame:
    """Every host, benign or malicious, on the models of its test set."""
    labelled = K.label_predictions(merged(spark, sf), E.index_flows(test_flows(spark, sf)))
    return K.confusion(labelled, TEST_SET, METHOD)


@query("merge_predictions", PRED + " select model_id, entity, row_idx, round(pred, 6) as pred from mp")
def merge_predictions(spark, sf):
    return merged(spark, sf).withColumn("pred", F.round("pred", 6))


@query("merge_predictions_median", RUN + "," + FIT + "," + scored_sql() + """
select model_id, entity, row_idx, cast(median(pred) as double) as pred from sc group by 1, 2, 3""")
def merge_predictions_median(spark, sf):
    return K.merge_predictions(scored_visits(spark, sf)[0])


@query("label_predictions", PRED + CONF.split(" cf as")[0].rstrip().rstrip(",") + """
select model_id, entity, row_idx, label, detailed_label, dst_ip, p as pred from lp_""")
def label_predictions(spark, sf):
    joined = K.label_predictions(merged(spark, sf), E.index_flows(test_flows(spark, sf)))
    return joined.select("model_id", "entity", "row_idx", "label", "detailed_label", "dst_ip", F.bround("pred").cast("int").alias("pred"))


@query("confusion", PRED + CONF + f"""
select '{TEST_SET}' as test_set, entity, model_id, '{METHOD}' as method, level, key, tp, tn, fp, fn from cf""")
def confusion(spark, sf):
    return many_confusion(spark, sf)


_METRICS = """round((tp + tn) / (tp + tn + fp + fn), 6) as accuracy, round(case when tp + fp = 0 then -1 else tp / (tp + fp) end, 6) as "precision",
 round(case when tp + fn = 0 then -1 else tp / (tp + fn) end, 6) as recall"""


def rounded_metrics(df):
    return df.withColumns({c: F.round(c, 6) for c in ("accuracy", "precision", "recall")})


@query("metrics", PRED + CONF + f" select entity, model_id, level, key, tp, tn, fp, fn, {_METRICS} from cf")
def metrics(spark, sf):
    return rounded_metrics(K.with_metrics(many_confusion(spark, sf))).drop("test_set", "method")


@query("model_totals", PRED + CONF + f"""
select '{TEST_SET}' as test_set, model_id, '{METHOD}' as method, cast(sum(tp) as bigint) as tp, cast(sum(tn) as bigint) as tn,
 cast(sum(fp) as bigint) as fp, cast(sum(fn) as bigint) as fn from cf where level = 'total' group by model_id""")
def model_totals(spark, sf):
    return K.model_totals(many_confusion(spark, sf))


_ORDER = """, o as (select model_id, row_number() over (order by model_id) as model_ord from (select distinct model_id from st)),
 stop as (select entity, min(model_ord) as stop from cf join o using (model_id) where level = 'total' and (tn + fn) / (tp + tn + fp + fn) > 0.15 group by 1)"""


# what several parts read is computed once
_ONCE = (PRED + CONF).replace(" st as (", " st as materialized (").replace(" cf as (", " cf as materialized (").replace(" mp as (", " mp as materialized (")


@query("first_match", _ONCE + _ORDER + """
select entity, model_id, level, key, tp, tn, fp, fn, model_ord from cf join o using (model_id) left join stop using (entity)
where stop is null or model_ord <= stop""")
def first_match(spark, sf):
    """Hosts leave as soon as a model of their test set matches; the models behind it aren't replayed."""
    limits, v = trained(spark, sf)
    states = freeze(M.state_weights(M.learn_state_model(v, limits).states))
    fit = freeze(stats.fit_stats(v, len(ATTRS)))
    test = tested(spark, sf, limits)
    truth = freeze(E.index_flows(test_flows(spark, sf)))

    def judge(batch):
        scored = stats.score_stats(M.replay_context(test, states, batch), fit)
        return K.confusion(K.label_predictions(K.merge_predictions(scored, states), truth), TEST_SET, METHOD)

    models = v.select("model_id").distinct()
    order = OrderedScan(models, [], ["model_id"]).index("model_ord").result().withColumn("model_ord", F.col("model_ord") + 1)
    return K.match_in_batches(assigned_models(v, test), freeze(order), judge).drop("test_set", "method")


_SCORES = """, ph as (select entity, model_id, tp, tn, fp, fn from cf where level = 'total' and tp + tn + fp + fn >= 10 and tp + fn < tn + fp),
 vs as (select 'host' as level, entity, '' as key, 1 - min((tp + fp) / (tp + tn + fp + fn)) as threshold from ph group by 2
  union all select 'connection', c.entity, c.key, 1 - min((c.tp + c.fp) / (c.tp + c.tn + c.fp + c.fn)) from cf c join ph using (entity, model_id)
  where c.level = 'dst_ip' and c.tp + c.tn + c.fp + c.fn >= 2 group by 2, 3)"""


@query("validation_scores", PRED + CONF + _SCORES + f" select level, '{METHOD}' as method, entity, key, round(threshold, 6) as threshold from vs")
def validation_scores(spark, sf):
    return K.validation_scores(many_confusion(spark, sf), 10, 2).withColumn("threshold", F.round("threshold", 6))


@query("validation_thresholds", PRED + CONF + _SCORES + f"""
select level, '{METHOD}' as method, round(quantile_cont(threshold, 0.1), 6) as threshold from vs group by 1""")
def validation_thresholds(spark, sf):
    picked = K.pick_thresholds(K.validation_scores(many_confusion(spark, sf), 10, 2))
    return picked.withColumn("threshold", F.round("threshold", 6))


THRESHOLDS = {"host": 0.43, "connection": 0.37}
_VERDICTS = """, jd as (select 'host' as level, entity, '' as key, max(case when tp + fn > 0 then 1 else 0 end) as truth,
   min(case when (tn + fn) / (tp + tn + fp + fn) > 0.43 then 0 else 1 end) as verdict from cf where level = 'total' group by 2
  union all select 'connection', entity, key, max(case when tp + fn >= tn + fp then 1 else 0 end),
   min(case when (tn + fn) / (tp + tn + fp + fn) > 0.37 then 0 else 1 end) from cf where level = 'dst_ip' group by 2, 3)"""


def judged(spark, sf):
    fixed = spark.createDataFrame([(l, METHOD, t) for l, t in THRESHOLDS.items()], "level string, method string, threshold double")
    return K.verdicts(many_confusion(spark, sf), fixed)


@query("verdicts", PRED + CONF + _VERDICTS + f" select '{TEST_SET}' as test_set, level, '{METHOD}' as method, entity, key, truth, verdict from jd")
def verdicts(spark, sf):
    return judged(spark, sf)


_JUDGED = """, jc as (select level, count(*) filter (truth = 1 and verdict = 1) as tp, count(*) filter (truth <> 1 and verdict <> 1) as tn,
  count(*) filter (truth <> 1 and verdict = 1) as fp, count(*) filter (truth = 1 and verdict <> 1) as fn from jd group by 1)"""


@query("verdict_confusion", PRED + CONF + _VERDICTS + _JUDGED + f" select '{TEST_SET}' as test_set, level, '{METHOD}' as method, tp, tn, fp, fn from jc")
def verdict_confusion(spark, sf):
    return K.verdict_confusion(judged(spark, sf), ["test_set", "level", "method"])


# scenarios: one per destination of the connection
@query("dataset_totals", PRED + CONF + f""", s as (select key as scenario, sum(tp) as tp, sum(tn) as tn, sum(fp) as fp, sum(fn) as fn
  from cf where level = 'dst_ip' group by 1),
 t as (select * from s union all select 'total', sum(tp), sum(tn), sum(fp), sum(fn) from s)
select scenario, '{METHOD}' as method, cast(tp as bigint) as tp, cast(tn as bigint) as tn, cast(fp as bigint) as fp, cast(fn as bigint) as fn, {_METRICS} from t""")
def dataset_totals(spark, sf):
    conf = many_confusion(spark, sf).filter("level = 'dst_ip'").select(F.col("key").alias("test_set"), "method", *K.COUNTS)
    return rounded_metrics(K.dataset_totals(conf, ["method"]))


# ---- baseline: local outlier factor over entity views ----

FEATURES = ["dst_port", "protocol_num", "duration", "src_bytes"]
_MODE = """(select src_ip as entity, protocol_num from (select src_ip, protocol_num, row_number() over (partition by src_ip order by count(*) desc, protocol_num) as rn
  from {t} group by 1, 2) where rn = 1)"""
VIEW = """(select entity, dst_port, protocol_num, duration, src_bytes, label from
  (select src_ip as entity, avg(dst_port) as dst_port, avg(duration) as duration, avg(src_bytes) as src_bytes, max(label) as label from {t} group by 1)
  join """ + _MODE + """ using (entity))"""
_D = "sqrt(" + " + ".join(f"(a.{c} - b.{c}) * (a.{c} - b.{c})" for c in FEATURES) + ")"


def _top_k(name, source, condition):
    return f""" {name}d as (select a.entity, b.entity as other, {_D} as d from {source} a join tv b on {condition}),
 {name}r as (select *, row_number() over (partition by entity order by d, other) as rn from {name}d)"""


BASELINE = f"""with bad as (select distinct src_ip from flows where label = 1),
 h as (select * from flows where src_ip in (select src_ip from flows group by 1 having count(*) > 50)),
 tr as (select * from h where src_ip not in (select src_ip from bad)),
 tv as {VIEW.format(t='tr')}, ev as {VIEW.format(t='h')},
 kn as (select least(20, count(*) - 1) as k from tv),
{_top_k('a', 'tv', 'a.entity <> b.entity')}, ak as (select entity, max(d) as kd from ar, kn where rn <= k group by 1),
 al as (select r.entity, 1 / (avg(greatest(o.kd, d)) + 1e-10) as lrd from ar r join ak o on o.entity = r.other, kn where rn <= k group by 1),
{_top_k('q', 'ev', 'true')},
 ql as (select r.entity, avg(l.lrd) * (avg(greatest(o.kd, d)) + 1e-10) as lof from qr r join ak o on o.entity = r.other
   join al l on l.entity = r.other, kn where rn <= k group by 1)"""


def entity_predictions(spark, sf):
    """All hosts scored against the hosts without malicious flows."""
    from .catalog import flows

    f = flows(spark, sf)
    f = E.keep_entities(f, E.select_hosts(f, 50), ["src_ip"])
    packed = F.array(*[F.col(c).cast("double") for c in FEATURES]).alias("attrs")
    view = X.entity_view(f, FEATURES).select(F.col("src_ip").alias("entity"), "label", packed, F.lit("hosts").alias("group"))
    view = freeze(view)  # read by the fit and the scores: the flows are summed up once
    fit = lof.fit_lof(view.filter("label <> 1"), ["group"], share=None, k=20)
    return lof.score_lof(view, fit, ["group"], share=None, k=20)


@query("entity_lof", BASELINE + """
select entity, label, round(lof, 6) as score, case when lof > 1.5 then 1 else 0 end as pred from ql join ev using (entity)""")
def entity_lof(spark, sf):
    return entity_predictions(spark, sf).select("entity", "label", F.round("score", 6).alias("score"), "pred")


@query("baseline_verdicts", BASELINE + """
select entity, label as truth, case when lof > 1.5 then 1 else 0 end as verdict from ql join ev using (entity)""")
def baseline_verdicts(spark, sf):
    return K.majority_verdicts(entity_predictions(spark, sf))


@query("baseline_confusion", BASELINE + """, v as (select label, case when lof > 1.5 then 1 else 0 end as p from ql join ev using (entity))
select count(*) filter (label = 1 and p = 1) as tp, count(*) filter (label <> 1 and p <> 1) as tn,
 count(*) filter (label <> 1 and p = 1) as fp, count(*) filter (label = 1 and p <> 1) as fn from v""")
def baseline_confusion(spark, sf):
    return K.verdict_confusion(K.majority_verdicts(entity_predictions(spark, sf)), [])
