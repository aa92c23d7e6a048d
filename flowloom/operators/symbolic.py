"""Symbolic machines: ``edges(model_id, src, symbol, dst, cnt)`` and symbol traces."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from . import walks
from .traces import TRACE

START = "0"


def laplace_edges(edges: DataFrame) -> DataFrame:
    """Smoothed edge probabilities and one ``unseen`` edge per state that leads back to it."""
    per_state = Window.partitionBy("model_id", "src")
    total = F.sum(F.col("cnt") + 1).over(per_state)
    known = edges.select("model_id", "src", "symbol", "dst", "cnt", ((F.col("cnt") + 1) / total).alias("prob"))
    sums = edges.groupBy("model_id", "src").agg(F.sum(F.col("cnt") + 1).alias("_total"))
    unseen = sums.select(
        "model_id", "src", F.lit("unseen").alias("symbol"), F.col("src").alias("dst"),
        F.lit(0).cast("long").alias("cnt"), (1 / F.col("_total")).alias("prob"),
    )
    return known.unionByName(unseen)


def edges_from_context(transitions: DataFrame) -> DataFrame:
    """Learned context model as a symbolic machine; the start state is ``0``."""
    src = F.when(F.col("src") == "start", F.lit(START)).otherwise(F.concat(F.lit("s"), F.col("src")))
    return transitions.select(
        "model_id", src.alias("src"), F.col("symbol").cast("string").alias("symbol"),
        F.concat(F.lit("s"), F.col("dst")).alias("dst"), "cnt",
    )


def symbol_records(traces: DataFrame) -> DataFrame:
    """``(model_id, entity, trace_id, pos, symbol)``; arrays ``symbols`` are taken apart, an empty trace is one row without ``pos``."""
    if "symbols" in traces.columns:
        return traces.select("model_id", *TRACE, F.posexplode_outer("symbols").alias("pos", "symbol")).withColumn("pos", F.col("pos").cast("long"))
    return traces.select("model_id", *TRACE, F.col("pos").cast("long").alias("pos"), F.col("symbol").cast("string").alias("symbol"))


def _by_symbol(edges: pd.DataFrame, records: pd.DataFrame):
    """Next states of a machine whose edges are symbols."""
    names = np.array(sorted({START, *edges["src"], *edges["dst"]}))
    symbols = np.array(sorted({*edges["symbol"]}))
    table = np.full((len(symbols) + 1, len(names)), walks.NONE)
    at = [np.searchsorted(list_, edges[c].to_numpy(dtype=str)) for list_, c in ((symbols, "symbol"), (names, "src"), (names, "dst"))]
    table[at[0], at[1]] = at[2]
    given = records["symbol"].fillna("").to_numpy(dtype=str)
    place = np.minimum(np.searchsorted(symbols, given), len(symbols) - 1)
    known = (symbols[place] == given) & records["symbol"].notna().to_numpy()
    return names, int(np.searchsorted(names, START)), table[np.where(known, place, len(symbols))]


def walk(traces: DataFrame, edges: DataFrame) -> DataFrame:
    """The records of ``traces`` with ``state``: the one behind each symbol, null from the first missing symbol on.

    A state without edges rejects. Traces run in chunks, so they may have any length.
    """
    return walks.run(symbol_records(traces), edges.select("model_id", "src", "symbol", "dst"), _by_symbol, True)


def acceptance(traces: DataFrame, edges: DataFrame) -> DataFrame:
    """Share of accepted traces per entity and model."""
    walked = walk(traces, edges).groupBy("model_id", *TRACE).agg(F.count_if(F.col("state").isNull()).alias("_missed"))
    every = symbol_records(traces).select("model_id", *TRACE).distinct().join(edges.select("model_id").distinct(), "model_id", "left_semi")
    accepted = F.coalesce("_missed", F.lit(0)) == 0
    return every.join(walked, ["model_id", *TRACE], "left").groupBy("model_id", "entity").agg(
        F.count(F.lit(1)).alias("n_traces"), F.avg(accepted.cast("int")).alias("accepted")
    )


def pattern_counts(traces: DataFrame, edges: DataFrame) -> DataFrame:
    """Occurrences of each (state after the step, symbol), up to the first missing symbol."""
    return walk(traces, edges).filter(F.col("state").isNotNull()).groupBy("model_id", "entity", "state", "symbol").agg(
        F.count(F.lit(1)).alias("n")
    )


def pattern_error(train: DataFrame, test: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean absolute difference of pattern frequencies, per tested entity and model.

    ``train`` are the traces that made the models, ``test`` those to be judged.
    Every pattern of either side counts; a pattern one side lacks counts as 0.
    """
    own = pattern_counts(train, edges).groupBy("model_id", "state", "symbol").agg(F.sum("n").alias("n"))
    own = _shares(own, ["model_id"], "p")
    seen = _shares(pattern_counts(test, edges), ["model_id", "entity"], "q")
    # patterns of both sides: matched ones as they are, the rest adds its own share
    matched = seen.join(own, ["model_id", "state", "symbol"], "left")
    per_pair = matched.groupBy("model_id", "entity").agg(
        F.sum(F.abs(F.col("q") - F.coalesce("p", F.lit(0.0)))).alias("_diff"),
        F.sum(F.coalesce("p", F.lit(0.0))).alias("_covered"),
        F.count(F.lit(1)).alias("_keys"),
        F.count("p").alias("_shared"),
    )
    sizes = own.groupBy("model_id").agg(F.count(F.lit(1)).alias("_own_keys"), F.sum("p").alias("_own_share"))
    pairs = test.select("model_id", "entity").distinct()
    zero = F.lit(0)
    joined = pairs.join(sizes, "model_id").join(per_pair, ["model_id", "entity"], "left")
    diff = F.coalesce("_diff", zero) + F.col("_own_share") - F.coalesce("_covered", zero)
    keys = F.coalesce("_keys", zero) + F.col("_own_keys") - F.coalesce("_shared", zero)
    return joined.select("model_id", "entity", (diff / keys).alias("error"))


def _shares(counts: DataFrame, keys: list[str], out: str) -> DataFrame:
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("_total"))
    return counts.join(totals, keys).withColumn(out, F.col("n") / F.col("_total")).drop("n", "_total")
