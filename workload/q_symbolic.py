"""Symbolic machines: probabilities, acceptance, pattern error."""

from pyspark.sql import functions as F

from flowloom.operators import machine as M, symbolic as Y
from flowloom.operators.evaluate import entity_labels, symbolic_verdicts
from flowloom.operators.entities import entity_flows

from .catalog import query
from .profile import ASSIGNED, BASE, STATES, assigned_models, test_flows, tested, trained

EDGES = """ ed as (select model_id, case when state = 'start' then '0' else 's' || state end as src, cast(symbol as varchar) as symbol,
  's' || next_state as dst, count(*) as cnt from train_v group by 1, 2, 3, 4)"""
# test records on the machines of their test set up to the first symbol a machine does not know
STEPS = STATES + "," + ASSIGNED + """, q as (select a.model_id, t.entity, t.trace_id, t.pos, cast(t.symbol as varchar) as symbol, 's' || t.next_state as after, e.cnt
   from test_v t join asg a on a.entity = t.entity left join ed e on e.model_id = a.model_id
   and e.src = (case when t.state = 'start' then '0' else 's' || t.state end) and e.symbol = cast(t.symbol as varchar)),
 stop as (select model_id, entity, trace_id, coalesce(min(pos) filter (cnt is null), 1000000) as stop from q group by 1, 2, 3)"""


def machines(spark, sf):
    limits, v = trained(spark, sf)
    edges = Y.edges_from_context(M.learn_state_model(v, limits).transitions)
    test = tested(spark, sf, limits)
    return edges, v, test.join(assigned_models(v, test).select("entity", "model_id"), "entity")


@query("laplace_probs", BASE + "," + EDGES + """
select model_id, src, symbol, dst, cnt, round((cnt + 1) / sum(cnt + 1) over (partition by model_id, src), 6) as prob from ed
union all select model_id, src, 'unseen', src, 0, round(1 / sum(cnt + 1), 6) from ed group by model_id, src""")
def laplace_probs(spark, sf):
    edges, _, _ = machines(spark, sf)
    return Y.laplace_edges(edges).withColumn("prob", F.round("prob", 6))


@query("acceptance", BASE + "," + EDGES + "," + STEPS + """
select model_id, entity, count(*) as n_traces, round(avg(case when stop = 1000000 then 1 else 0 end), 6) as accepted
from stop group by model_id, entity""")
def acceptance(spark, sf):
    edges, _, test = machines(spark, sf)
    return Y.acceptance(test, edges).withColumn("accepted", F.round("accepted", 6))


_ERROR = BASE + "," + EDGES + "," + STEPS + """,
 p0 as (select model_id, 's' || next_state as state, cast(symbol as varchar) as symbol, count(*) as n from train_v group by 1, 2, 3),
 p1 as (select model_id, state, symbol, n / sum(n) over (partition by model_id) as p from p0),
 p as (select distinct p1.*, s.entity from p1 join (select distinct model_id, entity from stop) s using (model_id)),
 q0 as (select q.model_id, q.entity, after as state, symbol, count(*) as n from q join stop using (model_id, entity, trace_id) where pos < stop group by 1, 2, 3, 4),
 q1 as (select model_id, entity, state, symbol, n / sum(n) over (partition by model_id, entity) as q from q0),
 er as (select model_id, entity, avg(abs(coalesce(p, 0) - coalesce(q, 0))) as error from p full join q1
   using (model_id, entity, state, symbol) group by 1, 2)"""


@query("pattern_error", _ERROR + " select model_id, entity, round(error, 6) as error from er")
def pattern_error(spark, sf):
    edges, train, test = machines(spark, sf)
    return Y.pattern_error(train, test, edges).withColumn("error", F.round("error", 6))


@query("symbolic_verdicts", _ERROR + """, j as (select entity, case when min(error) < 0.03 then 0 else 1 end as verdict from er group by 1),
 l as (select src_ip as entity, max(label) as label from test group by 1)
select 'symbolic' as method, entity, label as truth, verdict from j join l using (entity)""")
def symbolic(spark, sf):
    edges, train, test = machines(spark, sf)
    errors = Y.pattern_error(train, test, edges).withColumn("method", F.lit("symbolic"))
    return symbolic_verdicts(errors, entity_labels(entity_flows(test_flows(spark, sf))), 0.03)
