"""Runs of traces over machines in chunks.

A record maps every state of a machine to the state after it. A chunk of ``CHUNK`` records is therefore a map from entry to exit
states, and maps of neighbouring chunks compose. Traces of one chunk start at the machine's start. For longer ones the maps of all
chunks are made first, composed ``FAN`` at a time into maps of longer pieces until a trace is one piece, and entry
states are handed down again; then each chunk is run from its own entry. So no task holds more than a bucket of chunks, whatever
the length of a trace, and a machine goes to each bucket once instead of to each trace.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import freeze, ship
from .traces import TRACE

CHUNK = 1024
FAN = 256
BUCKET_ROWS = 100_000
NONE = -1  # no state: the run has failed
KEYS = ["model_id", *TRACE]
#: (edges of a model, records) -> (names of states, number of the start, next state of each record and state)
Machine = Callable[[pd.DataFrame, pd.DataFrame], tuple[np.ndarray, int, np.ndarray]]


def _in_buckets(records: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with chunk and bucket, and each machine once for every bucket of its records. Buckets are dealt to groups
    of about ``BUCKET_ROWS`` records, so small machines share a group."""
    size = records.groupBy("model_id").agg(F.count(F.lit(1)).alias("_n")).withColumn("_buckets", F.ceil(F.col("_n") / BUCKET_ROWS).cast("int"))
    size = freeze(size.join(edges.select("model_id").distinct(), "model_id", "left_semi"))
    groups = max(1, ceil((size.agg(F.sum("_n")).first()[0] or 0) / BUCKET_ROWS))
    size = size.drop("_n")
    group = F.pmod(F.xxhash64("model_id", "_bucket"), F.lit(groups)).cast("int")
    chunk = F.floor(F.col("pos") / CHUNK).cast("long")
    dealt = records.join(size, "model_id").withColumn("_chunk", chunk).withColumn(
        "_bucket", F.pmod(F.xxhash64(*TRACE, "_chunk"), F.col("_buckets")).cast("int")).drop("_buckets")
    machines = edges.join(size, "model_id").withColumn("_bucket", F.explode(F.sequence(F.lit(0), F.col("_buckets") - 1))).drop("_buckets")
    return dealt.withColumn("_group", group), machines.withColumn("_group", group)


def _by_bucket(rows: pd.DataFrame, own: pd.DataFrame):
    """Records and machine of each bucket of a group."""
    if not len(rows) or not len(own):
        return
    by = ["model_id", "_bucket"]
    machines = own.groupby(by, sort=False).indices
    for key, places in rows.groupby(by, sort=False).indices.items():
        if key in machines:
            yield rows.iloc[places], own.iloc[machines[key]]


def _chunks(rows: pd.DataFrame, *first: np.ndarray):
    """Places of the rows of each chunk, in order, by the numbers ``first`` before the chunk's own keys."""
    keys = (rows["_chunk"].to_numpy(), rows["trace_id"].to_numpy(), pd.factorize(rows["entity"])[0], *first)
    order = np.lexsort((rows["pos"].to_numpy(), *keys))
    new = np.zeros(len(rows), bool)
    new[:1] = True
    for key in keys:
        key = key[order]
        new[1:] |= key[1:] != key[:-1]
    edge = np.append(np.flatnonzero(new), len(rows))
    return [order[a:z] for a, z in zip(edge[:-1], edge[1:])]


def _stepped(table: np.ndarray, state: np.ndarray) -> np.ndarray:
    return np.where(state == NONE, NONE, table[np.maximum(state, 0)])


def run(records: DataFrame, edges: DataFrame, machine: Machine, after: bool) -> DataFrame:
    """``records(model_id, entity, trace_id, pos, ...)`` with ``state``: the one a record is read in or, with ``after``, the one
    behind it; null from the first record on that no transition takes. Models without edges give no rows."""
    ship(records.sparkSession)
    records = records.filter("pos is not null")
    dealt, machines = _in_buckets(records, edges)
    entry = _entries(dealt, machines, machine)
    if entry is None:
        dealt = dealt.withColumn("_entry", F.lit(None).cast("int"))
    else:
        dealt = dealt.join(entry, [*KEYS, "_chunk"], "left")
    given_columns = records.columns
    out = [*given_columns, "state"]
    schema = records.withColumn("state", F.lit(None).cast("string")).schema

    def walk(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(own):
            return pd.DataFrame({c: [] for c in out})
        by = ["model_id", "_bucket"]
        machines, code = own.groupby(by, sort=False).indices, rows.groupby(by, sort=False).ngroup().to_numpy()
        given = rows["_entry"].to_numpy(dtype=float, na_value=np.nan)
        state_names, placed, within = np.full(len(rows), None, object), np.zeros(len(rows), bool), np.zeros(len(rows), np.int64)
        chunks: dict[int, list[np.ndarray]] = {}
        for places in _chunks(rows, code):
            chunks.setdefault(int(code[places[0]]), []).append(places)
        for key, held in rows.groupby(by, sort=False).indices.items():
            if key not in machines:
                continue
            names, start, following = machine(own.iloc[machines[key]], rows.iloc[held])
            placed[held], within[held] = True, np.arange(len(held))
            for places in chunks[int(code[held[0]])]:
                state = start if np.isnan(given[places[0]]) else int(given[places[0]])
                for i, at in zip(places.tolist(), within[places].tolist()):
                    behind = NONE if state == NONE else int(following[at, state])
                    here = behind if after else state
                    state_names[i] = None if here == NONE else names[here]
                    state = behind
        rows = rows.loc[placed, given_columns].copy()
        rows["state"] = state_names[placed]
        return rows

    return dealt.groupBy("_group").cogroup(machines.groupBy("_group")).applyInPandas(walk, schema)


def _entries(dealt: DataFrame, machines: DataFrame, machine: Machine) -> DataFrame | None:
    """``(KEYS, _chunk, _entry)`` of the chunks of traces longer than one."""
    long = dealt.filter("_chunk > 0").select(*KEYS).distinct()
    long = freeze(long)
    if long.isEmpty():
        return None
    schema = "model_id string, entity string, trace_id long, _chunk long, start int, exits array<int>"
    names = schema.replace(",", "").split()[::2]

    def maps(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        found = []
        for rows, own in _by_bucket(rows, own):
            states, start, following = machine(own, rows)
            for places in _chunks(rows):
                state = np.arange(len(states))
                for i in places:
                    state = _stepped(following[i], state)
                first = rows.iloc[places[0]]
                found.append((first["model_id"], first["entity"], first["trace_id"], first["_chunk"], start, state.tolist()))
        return pd.DataFrame(found, columns=names)

    chunks = dealt.join(long, KEYS, "left_semi").groupBy("_group").cogroup(machines.groupBy("_group")).applyInPandas(maps, schema)
    levels = [freeze(chunks)]
    while levels[-1].filter("_chunk > 0").limit(1).count():
        levels.append(freeze(levels[-1].withColumn("_part", F.floor(F.col("_chunk") / FAN)).groupBy(*KEYS, "_part").applyInPandas(_composed, schema)))
    entry = levels[-1].select(*KEYS, "_chunk", F.col("start").alias("_entry"))
    down = "model_id string, entity string, trace_id long, _chunk long, _entry int"
    for level in reversed(levels[:-1]):
        parts = level.withColumn("_part", F.floor(F.col("_chunk") / FAN)).join(entry.withColumnRenamed("_chunk", "_part"), [*KEYS, "_part"])
        entry = freeze(parts.groupBy(*KEYS, "_part").applyInPandas(_handed_down, down))
    return entry


def _composed(rows: pd.DataFrame) -> pd.DataFrame:
    """One map for at most ``FAN`` neighbouring maps of a trace."""
    rows = rows.sort_values("_chunk")
    state = np.arange(len(rows["exits"].iloc[0]))
    for exits in rows["exits"]:
        state = _stepped(np.asarray(exits), state)
    first = rows.iloc[[0]].copy()
    first["_chunk"] = first["_part"]
    first["exits"] = [state.tolist()]
    return first.drop(columns="_part")


def _handed_down(rows: pd.DataFrame) -> pd.DataFrame:
    """Entry state of each of a part's maps, from the part's own."""
    rows = rows.sort_values("_chunk").copy()
    state, entries = int(rows["_entry"].iloc[0]), []
    for exits in rows["exits"]:
        entries.append(state)
        state = NONE if state == NONE else int(exits[state])
    rows["_entry"] = entries
    return rows[[*KEYS, "_chunk", "_entry"]]
