"""State machines: learning, guards and replay.

A learned machine is a context model: the state of a record is made of the
symbols of the records before it in the trace. Because traces are ranges of one
ordered flow table, the previous symbols are looked up once per flow, before
windows multiply the rows, and replay is an equi join on the state.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import exact_quantiles
from ..functions.scalar import mixed_radix_code
from . import walks
from .traces import TRACE

START, SINK = "start", "sink"


# ---- discretisation ----

def fit_limits(flows: DataFrame, numeric: list[str], categorical: list[str], bins: int = 4) -> DataFrame:
    """``(feature, kind, limits)``: sorted categories, and percentiles at i/bins."""
    probs = [i / bins for i in range(1, bins)]
    sets = [F.sort_array(F.collect_set(F.col(c).cast("double"))).alias(c) for c in categorical]
    found = exact_quantiles(flows, [], numeric, probs)  # one row
    if categorical:
        found = found.withColumn("_sets", flows.agg(F.struct(*sets)).scalar())
    rows = []
    for place, c in enumerate([*categorical, *numeric]):
        limits = F.col(f"_sets.{c}") if c in categorical else F.col(f"q_{c}")
        kind = "category" if c in categorical else "numeric"
        rows.append(F.struct(F.lit(place).alias("place"), F.lit(c).alias("feature"), F.lit(kind).alias("kind"),
                             limits.alias("limits")))
    return found.select(F.inline(F.array(*rows)))


def read_limits(limits: DataFrame) -> dict[str, tuple[str, list[float]]]:
    """The few limit rows as a dictionary, categorical features first."""
    return {r.feature: (r.kind, list(r.limits)) for r in sorted(limits.collect(), key=lambda r: r.place)}


def bin_sql(feature: str, limits: dict) -> str:
    """Bin index of a feature as an expression text; one parse instead of many nested calls."""
    kind, values = limits[feature]
    listed = "array(" + ", ".join(f"{v!r}D" for v in values) + ")"
    value = f"cast(`{feature}` as double)"
    if kind == "category":
        at = f"array_position({listed}, {value})"
        return f"cast(if({at} > 0, {at} - 1, {len(values)}) as int)"
    return f"size(filter({listed}, p -> p < {value}))"


def bin_column(feature: str, limits: dict) -> Column:
    return F.expr(bin_sql(feature, limits))


def add_symbol(flows: DataFrame, limits: dict, out: str = "symbol") -> DataFrame:
    """One integer per flow from its bins."""
    digits = [bin_column(f, limits) for f in limits]
    return flows.withColumn(out, mixed_radix_code(digits, [len(v) + 1 for _, v in limits.values()]))


# ---- context model ----

def context_columns(order: int = 1) -> dict[str, str]:
    """Columns ``before_1 .. before_<order>`` for :func:`~.entities.index_flows`: the symbols
    of the flows before."""
    return {f"before_{s}": "symbol" if s == 1 else f"before_{s - 1}" for s in range(1, order + 1)}


def add_states(trace_flows: DataFrame, order: int = 1) -> DataFrame:
    """Adds ``state`` (where the record arrives) and ``next_state`` (where it leads)."""
    here = [F.when(F.col("pos") >= s, F.col(f"before_{s}").cast("string")) for s in range(order, 0, -1)]
    state = F.when(F.col("pos") == 0, F.lit(START)).otherwise(F.concat_ws("-", *here))
    following = F.concat_ws("-", *here[1:], F.col("symbol").cast("string"))
    return trace_flows.withColumns({"state": state, "next_state": following})


@dataclass
class StateModel:
    """``states(model_id, state, fin, total, visits)``, ``transitions(model_id, src, dst,
    symbol, cnt)`` and ``bins(model_id, state, attr, counts)``."""

    states: DataFrame
    transitions: DataFrame
    bins: DataFrame


def learn_state_model(visits: DataFrame, limits: dict) -> StateModel:
    """Context model per entity from trace records that carry ``state`` and ``next_state``."""
    visits = visits.withColumn("model_id", F.col("entity"))
    transitions = visits.groupBy("model_id", F.col("state").alias("src"), F.col("next_state").alias("dst"), "symbol").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    ends = visits.groupBy("model_id", *TRACE).agg(F.max_by("next_state", "pos").alias("state"))
    fin = ends.groupBy("model_id", "state").agg(F.count(F.lit(1)).alias("fin"))
    seen = transitions.groupBy("model_id", F.col("src").alias("state")).agg(F.sum("cnt").alias("visits"))
    zero = F.lit(0).cast("long")
    states = seen.join(fin, ["model_id", "state"], "full_outer").select(
        "model_id",
        "state",
        F.coalesce("fin", zero).alias("fin"),
        (F.coalesce("fin", zero) + F.coalesce("visits", zero)).alias("total"),
        F.coalesce("visits", zero).alias("visits"),
    )
    return StateModel(states, transitions, state_bins(visits, limits))


def state_bins(visits: DataFrame, limits: dict) -> DataFrame:
    """Observations per bin of every numeric feature, one row per state and feature."""
    rows = []
    for feature, (kind, values) in limits.items():
        if kind == "numeric":
            counts = ", ".join(f"count_if({bin_sql(feature, limits)} = {b})" for b in range(len(values) + 1))
            rows.append(f"struct('{feature}' as attr, array({counts}) as counts)")
    counted = visits.groupBy("model_id", "state").agg(F.expr(f"array({', '.join(rows)})").alias("_bins"))
    return counted.select("model_id", "state", F.inline("_bins"))


def symbol_guard(symbol: Column, limits: dict) -> Column:
    """Guard of a symbol: an OR of ANDs of ``(attr, op, bound)`` that exactly its records meet."""
    features = list(limits)
    alternatives, rest = None, symbol
    place = 1
    for f in features:
        place *= len(limits[f][1]) + 1
    for index, f in enumerate(features):
        kind, values = limits[f]
        place //= len(values) + 1
        digit = F.floor(rest / place).cast("int")
        rest = rest - digit * place
        options = [_boxes(index, kind, values, b) for b in range(len(values) + 1)]
        choice = F.element_at(F.array(*[_literal(o) for o in options]), digit + 1)
        if alternatives is None:
            alternatives = choice
        else:
            alternatives = F.flatten(
                F.transform(alternatives, _extend(choice))
            )
    return alternatives


def _extend(choice: Column):
    return lambda left: F.transform(choice, lambda right: F.concat(left, right))


def _boxes(attr: int, kind: str, values: list[float], b: int) -> list[list[tuple[int, str, float]]]:
    if kind == "numeric":
        low = [(attr, ">", values[b - 1])] if b > 0 else []
        high = [(attr, "<=", values[b])] if b < len(values) else []
        return [low + high]
    if b < len(values):
        return [[(attr, "==", values[b])]]
    gaps = [[(attr, "<", values[0])], [(attr, ">", values[-1])]]
    return gaps + [[(attr, ">", a), (attr, "<", c)] for a, c in zip(values, values[1:])]


CLAUSES = "array<array<struct<attr:int,op:string,bound:double>>>"


def _literal(clauses: list[list[tuple[int, str, float]]]) -> Column:
    arrays = [
        F.array(*[F.struct(F.lit(a).alias("attr"), F.lit(o).alias("op"), F.lit(float(v)).alias("bound")) for a, o, v in c])
        for c in clauses
    ]
    return F.array(*arrays).cast(CLAUSES)


def with_guards(transitions: DataFrame, limits: dict) -> DataFrame:
    """Adds ``clauses``. The first record of a trace is taken without a test."""
    return transitions.withColumn("clauses", symbol_guard(F.col("symbol"), limits))


def guard_holds(clauses: Column, attrs: Column) -> Column:
    """True if one clause has all its conditions met by the record."""

    def met(c):
        v = F.get(attrs, c["attr"])
        return (
            F.when(c["op"] == "<", v < c["bound"])
            .when(c["op"] == "<=", v <= c["bound"])
            .when(c["op"] == ">", v > c["bound"])
            .when(c["op"] == ">=", v >= c["bound"])
            .otherwise(v == c["bound"])
        )

    return F.exists(clauses, lambda clause: F.forall(clause, met))


def state_weights(states: DataFrame) -> DataFrame:
    """``(visits + 1) / (largest visits of the model + 1)``."""
    most = F.max("visits").over(Window.partitionBy("model_id"))
    return states.withColumn("weight", (F.col("visits") + 1) / (most + 1))


def bin_priors(bins: DataFrame) -> DataFrame:
    """Probability of each bin, ``(count + 1) / (sum + 4)``."""
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, c: a + c)
    return bins.withColumn("probs", F.transform("counts", lambda c: (c + 1) / (total + 4)))


# ---- replay ----

def assign_models(entities: DataFrame, model_sets: DataFrame) -> DataFrame:
    """``(entity, model_id)`` pairs to test: every entity of a test set meets the models
    listed for that set."""
    return entities.join(model_sets, "test_set")


def replay_context(trace_visits: DataFrame, states: DataFrame, assignments: DataFrame | None = None) -> DataFrame:
    """Visits of test records on learned machines. A context the model has not seen is
    the state ``sink`` for that record only."""
    if assignments is None:
        pairs = trace_visits.withColumn("model_id", F.col("entity"))
    else:
        pairs = trace_visits.join(assignments.select("entity", "model_id"), "entity")
    known = states.filter(F.col("visits") > 0).select("model_id", "state", F.lit(True).alias("_known"))
    joined = pairs.join(known, ["model_id", "state"], "left")
    return joined.withColumn("state", F.when(F.col("_known"), F.col("state")).otherwise(F.lit(SINK))).drop("_known")


ROOT = "root"


def _guarded(edges: pd.DataFrame, records: pd.DataFrame):
    """Next states of a machine with guards: the only successor without a test, the state itself in a sink, else the one
    edge whose guard holds; none if no or several guards hold. The start is the root's first successor."""
    names = np.array(sorted({*edges["src"], *edges["dst"]}))
    number = {name: i for i, name in enumerate(names.tolist())}
    edges = edges.sort_values(["src", "dst"], kind="stable")
    following = np.tile(np.arange(len(names)), (len(records), 1))
    attrs = np.stack([np.asarray(a, dtype=float) for a in records["attrs"]])
    for src, own in edges.groupby("src", sort=False):
        if len(own) == 1:
            following[:, number[src]] = number[own["dst"].iloc[0]]
            continue
        held = np.zeros(len(records), np.int64)
        after = np.full(len(records), walks.NONE)
        for dst, clauses in zip(own["dst"], own["clauses"]):
            holds = np.zeros(len(records), bool)
            for clause in json.loads(clauses or "[]"):
                met = np.ones(len(records), bool)
                for c in clause:
                    met &= _COMPARE[c["op"]](attrs[:, c["attr"]], c["bound"]) if 0 <= c["attr"] < attrs.shape[1] else False
                holds |= met
            after[holds] = number[dst]
            held += holds
        following[:, number[src]] = np.where(held == 1, after, walks.NONE)
    starts = edges.loc[edges["src"] == ROOT, "dst"]
    return names, number[starts.iloc[0]] if len(starts) else walks.NONE, following


_COMPARE = {"<": np.less, "<=": np.less_equal, ">": np.greater, ">=": np.greater_equal, "==": np.equal, "=": np.equal}


def replay_machines(records: DataFrame, transitions: DataFrame) -> DataFrame:
    """Visits of ``records(model_id, entity, trace_id, pos, attrs, ...)`` on imported machines, in chunks of any trace.

    A record is credited to the state in which it is read. ``state`` is NULL from
    the record on at which no single transition was possible; those rows are the
    replay errors. Traces packed into arrays ``records`` are taken apart first.
    """
    if "records" in records.columns:
        records = records.select("model_id", *TRACE, F.explode("records").alias("_r")).select("model_id", *TRACE, "_r.*")
    # nested arrays of different lengths travel as text
    return walks.run(records, transitions.select("model_id", "src", "dst", F.to_json("clauses").alias("clauses")), _guarded, False)


def replay_errors(visits: DataFrame) -> DataFrame:
    """First record of each trace that could not be placed."""
    failed = visits.filter(F.col("state").isNull())
    return failed.groupBy("model_id", *TRACE).agg(F.min("pos").alias("pos"))
