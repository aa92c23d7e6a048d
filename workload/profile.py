"""Training and test visits shared by the machine, detector and verdict queries.

Training: hosts without any malicious flow, before the cut. Testing: all hosts
from the cut on. Both sides of a query use the same bin limits of the training
flows.
"""

from pyspark.sql import functions as F

from flowloom.operators import machine as M, traces as T
from flowloom.operators.entities import index_flows
from flowloom.session import freeze

from .catalog import CUT_US, flows
from .q_scalar import LIMITS_CTE, SYMBOL, limits_of
from .q_traces import windows_sql

ATTRS = ["src_bytes", "dst_port"]


def train_flows(spark, sf):
    f = flows(spark, sf)
    bad = f.filter("label = 1").select("src_ip").distinct()
    return f.filter(F.col("date_us") < CUT_US).join(bad, "src_ip", "left_anti")


def test_flows(spark, sf):
    return flows(spark, sf).filter(F.col("date_us") >= CUT_US)


def visits(df, limits, attrs=ATTRS, order=1, keep=()):
    """Indexed flows with symbols, cut into count windows, with their states."""
    indexed = index_flows(M.add_symbol(df, limits), previous=M.context_columns(order))
    traced = M.add_states(T.count_windows(indexed), order)
    packed = F.array(*[F.col(c).cast("double") for c in attrs]).alias("attrs")
    columns = ["entity", "trace_id", "pos", "row_idx", "flow_id", "symbol", "state", "next_state", *keep]
    return traced.select(*columns, packed)


def trained(spark, sf, attrs=ATTRS):
    df = train_flows(spark, sf)
    limits = limits_of(df)
    v = visits(df, limits, attrs, keep=("protocol_num", "src_bytes", "dst_bytes"))
    # read by states, fits and weights: computed once
    return limits, freeze(v.withColumn("model_id", F.col("entity")))


def tested(spark, sf, limits, attrs=ATTRS):
    return freeze(visits(test_flows(spark, sf), limits, attrs))


def visits_sql(name, order=1):
    before = ", ".join(f"lag(symbol, {s}) over w as before_{s}" for s in range(1, order + 1))
    here = ", ".join(f"case when pos >= {s} then before_{s} end" for s in range(order, 0, -1))
    ahead = ", ".join([*[f"case when pos >= {s} then before_{s} end" for s in range(order - 1, 0, -1)], "symbol"])
    return f""" {name}_s as (select t.src_ip as entity, t.*, {SYMBOL} as symbol from {name} t, lim),
 {name}_i as (select *, row_number() over w - 1 as row_idx, {before} from {name}_s
   window w as (partition by entity order by date_us, flow_id)),
 {name}_w as (select *, row_idx - trace_id * 20 as pos from {windows_sql(name + '_i')}),
 {name}_v as (select *, entity as model_id, case when pos = 0 then 'start' else concat_ws('-', {here}) end as state,
   concat_ws('-', {ahead}) as next_state from {name}_w)"""


def base_sql(order=1):
    return f"""with bad as (select distinct src_ip from flows where label = 1),
 train as (select * from flows where date_us < {CUT_US} and src_ip not in (select src_ip from bad)),
 test as (select * from flows where date_us >= {CUT_US}),
 {LIMITS_CTE.format(src='train')},
 {visits_sql('train', order)}, {visits_sql('test', order)}"""


BASE = base_sql()
# learned states with their training visits
STATES = """ st as (select model_id, state, count(*) as visits from train_v group by 1, 2),
 wt as (select *, (visits + 1) / (max(visits) over (partition by model_id) + 1) as weight from st)"""
# every host of the test period, benign or malicious, meets all models of its test set
ASSIGNED = """ asg as (select e.entity, m.model_id from (select distinct entity from test_v) e join (select distinct model_id from st) m
   on cast(substr(e.entity, 2) as bigint) // 5 = cast(substr(m.model_id, 2) as bigint) // 5)"""
# test visits on these models, unknown states become the sink
ON_MODELS = ASSIGNED + """,
 rv as (select t.entity, t.trace_id, t.pos, t.row_idx, t.flow_id, t.src_bytes, t.dst_port, t.dst_bytes, a.model_id,
   coalesce(s.state, 'sink') as state from test_v t join asg a using (entity)
   left join st s on s.model_id = a.model_id and s.state = t.state)"""


def test_set(entity):
    """Hosts of five neighbouring numbers are one test set: benign and malicious ones together."""
    return F.floor(F.substring(entity, 2, 20).cast("long") / 5)


def set_models(v):
    """The models of each test set: those learned from its own benign hosts."""
    return v.select("model_id").distinct().select(test_set("model_id").alias("test_set"), "model_id")


def assigned_models(v, test):
    """Every host of the test period, with or without a model of its own, meets all models of its test set."""
    entities = test.select("entity").distinct().select("entity", test_set("entity").alias("test_set"))
    return M.assign_models(entities, set_models(v))
