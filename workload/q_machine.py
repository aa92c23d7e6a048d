"""State machines: learning, guards, replay, weights."""

from pyspark.sql import functions as F

from flowloom.operators import machine as M

from .catalog import query
from .profile import ASSIGNED, BASE, ON_MODELS, STATES, assigned_models, base_sql, tested, train_flows, trained, visits
from .q_scalar import limits_of


@query("state_transitions", BASE + """
select model_id, state as src, next_state as dst, symbol, count(*) as cnt from train_v group by 1, 2, 3, 4""")
def state_transitions(spark, sf):
    limits, v = trained(spark, sf)
    return M.learn_state_model(v, limits).transitions


_FIN = """, e as (select model_id, entity, trace_id, arg_max(next_state, pos) as state from train_v group by 1, 2, 3),
 fin as (select model_id, state, count(*) as fin from e group by 1, 2), st as (select model_id, state, count(*) as visits
  from train_v group by 1, 2)
select model_id, state, coalesce(fin, 0) as fin, coalesce(fin, 0) + coalesce(visits, 0) as total, coalesce(visits, 0) as visits
from st full join fin using (model_id, state)"""


@query("state_counts", BASE + _FIN)
def state_counts(spark, sf):
    limits, v = trained(spark, sf)
    return M.learn_state_model(v, limits).states


@query("state_counts_order2", base_sql(2) + _FIN)
def state_counts_order2(spark, sf):
    df = train_flows(spark, sf)
    limits = limits_of(df)
    v = visits(df, limits, order=2, keep=("protocol_num", "src_bytes", "dst_bytes"))
    return M.learn_state_model(v, limits).states


def _bin(l, v, b):
    return f"count(*) filter ((case when {v} > {l}[1] then 1 else 0 end + case when {v} > {l}[2] then 1 else 0 end + case when {v} > {l}[3] then 1 else 0 end) = {b})"


_BINS = "select model_id, state, attr, b0, b1, b2, b3 from (" + " union all ".join(
    f"select model_id, state, '{v}' as attr, " + ", ".join(f"{_bin(l, v, b)} as b{b}" for b in range(4))
    + " from train_v, lim group by 1, 2" for l, v in (("ls", "src_bytes"), ("ld", "dst_bytes"))) + ")"


@query("state_bins", BASE + _BINS)
def state_bins(spark, sf):
    limits, v = trained(spark, sf)
    bins = M.state_bins(v, limits)
    return bins.select("model_id", "state", "attr", *[F.col("counts")[b].alias(f"b{b}") for b in range(4)])


@query("bin_priors", BASE + ", c as (" + _BINS + """)
select model_id, state, attr, """ + ", ".join(f"round((b{b} + 1) / (b0 + b1 + b2 + b3 + 4), 6) as p{b}" for b in range(4)) + " from c")
def bin_priors(spark, sf):
    limits, v = trained(spark, sf)
    priors = M.bin_priors(M.state_bins(v, limits))
    return priors.select("model_id", "state", "attr", *[F.round(F.col("probs")[b], 6).alias(f"p{b}") for b in range(4)])


@query("state_weights", BASE + "," + STATES + " select model_id, state, visits, round(weight, 6) as weight from wt")
def state_weights(spark, sf):
    limits, v = trained(spark, sf)
    states = M.learn_state_model(v, limits).states
    weights = M.state_weights(states).filter("visits > 0")
    return weights.select("model_id", "state", "visits", F.round("weight", 6).alias("weight"))


@query("replay_visits", BASE + "," + STATES + "," + ON_MODELS + " select model_id, entity, trace_id, pos, row_idx, flow_id, state from rv")
def replay_visits(spark, sf):
    limits, v = trained(spark, sf)
    test = tested(spark, sf, limits)
    return M.replay_context(test, M.learn_state_model(v, limits).states, assigned_models(v, test)).select(
        "model_id", "entity", "trace_id", "pos", "row_idx", "flow_id", "state")


@query("replay_assigned", BASE + "," + STATES + "," + ASSIGNED + """
select a.model_id, t.entity, t.trace_id, t.pos, t.row_idx, coalesce(s.state, 'sink') as state
from test_v t join asg a using (entity) left join st s on s.model_id = a.model_id and s.state = t.state""")
def replay_assigned(spark, sf):
    limits, v = trained(spark, sf)
    test = tested(spark, sf, limits)
    replayed = M.replay_context(test, M.learn_state_model(v, limits).states, assigned_models(v, test))
    return replayed.select("model_id", "entity", "trace_id", "pos", "row_idx", "state")


@query("guard_holds", BASE + """
select model_id, entity, trace_id, pos, next_state, true as holds, cast(1 as bigint) as n_open from train_v""")
def guard_holds(spark, sf):
    """Of all edges that leave a state exactly the one taken has a guard that holds."""
    limits, v = trained(spark, sf, ["protocol_num", "src_bytes", "dst_bytes"])
    edges = M.with_guards(M.learn_state_model(v, limits).transitions, limits).select("model_id", "src", "dst", "clauses")
    tried = v.join(edges.withColumnRenamed("src", "state"), ["model_id", "state"])
    tried = tried.withColumn("_holds", M.guard_holds(F.col("clauses"), F.col("attrs")))
    return tried.groupBy("model_id", "entity", "trace_id", "pos", "next_state").agg(
        F.max((F.col("dst") == F.col("next_state")) & F.col("_holds")).alias("holds"), F.count_if("_holds").alias("n_open"))


@query("replay_machines", BASE + """
select model_id, entity, trace_id, pos, row_idx, state from train_v""")
def replay_machines(spark, sf):
    """Training traces run over the learned machine in its guarded form."""
    limits, v = trained(spark, sf, ["protocol_num", "src_bytes", "dst_bytes"])
    edges = M.with_guards(M.learn_state_model(v, limits).transitions, limits).select("model_id", "src", "dst", "clauses")
    root = v.select("model_id").distinct().select(
        "model_id", F.lit("root").alias("src"), F.lit("start").alias("dst"), F.array().cast(M.CLAUSES).alias("clauses"))
    records = v.select("model_id", "entity", "trace_id", "pos", "row_idx", "attrs")
    replayed = M.replay_machines(records, edges.unionByName(root))
    return replayed.select("model_id", "entity", "trace_id", "pos", "row_idx", "state")
