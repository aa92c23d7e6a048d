"""Merging of predictions, confusion tables, thresholds and verdicts.

The long table ``confusion(test_set, entity, model_id, method, level, key, tp,
tn, fp, fn)`` is the one result format; ``level`` is ``total``, ``label`` or
``dst_ip``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.quantiles import exact_quantiles
from ..session import freeze

PAIR = ["test_set", "entity", "model_id", "method"]
COUNTS = ["tp", "tn", "fp", "fn"]


def merge_predictions(scored: DataFrame, weights: DataFrame | None = None, times: str | None = None) -> DataFrame:
    """One prediction per flow and model: weighted mean over its visits, or their median.

    With weights, a row may stand for as many equal visits as its column ``times`` says.

    A state without a weight (the sink) has no training visits and takes the
    smallest possible weight of its model.
    """
    keys = ["model_id", "entity", "row_idx"]
    if weights is None:
        return scored.groupBy(*keys).agg(F.percentile("pred", F.lit(0.5)).alias("pred"))
    least = weights.groupBy("model_id").agg((1 / (F.max("visits") + 1)).alias("_least"))
    joined = scored.join(weights.select("model_id", "state", "weight"), ["model_id", "state"], "left")
    joined = joined.join(least, "model_id").withColumn("_w", F.coalesce("weight", "_least"))
    if times is not None:
        joined = joined.withColumn("_w", F.col("_w") * F.col(times))
    return joined.groupBy(*keys).agg((F.sum(F.col("_w") * F.col("pred")) / F.sum("_w")).alias("pred"))


def label_predictions(merged: DataFrame, indexed: DataFrame) -> DataFrame:
    """Predictions next to the true label, detailed label and destination of the flow."""
    truth = indexed.select("entity", "row_idx", "label", "detailed_label", "dst_ip")
    return merged.join(truth, ["entity", "row_idx"])


def outcome_counts(truth: Column, predicted: Column) -> list[Column]:
    return [
        F.count_if((truth == 1) & (predicted == 1)).alias("tp"),
        F.count_if((truth != 1) & (predicted != 1)).alias("tn"),
        F.count_if((truth != 1) & (predicted == 1)).alias("fp"),
        F.count_if((truth == 1) & (predicted != 1)).alias("fn"),
    ]


def confusion(labelled: DataFrame, test_set: str, method: str, by_destination: bool = True) -> DataFrame:
    """Counts per model and entity: in total, per detailed label and per destination.

    Flows are counted once at the finest grain; the three levels are made from
    those counts.
    """
    rounded = F.bround("pred").cast("int")
    fine = labelled.groupBy("entity", "model_id", "detailed_label", "dst_ip").agg(
        *outcome_counts(F.col("label"), rounded)
    )
    levels = [
        F.struct(F.lit("total").alias("level"), F.lit("").alias("key")),
        F.struct(F.lit("label").alias("level"), F.col("detailed_label").alias("key")),
    ]
    if by_destination:
        levels.append(F.struct(F.lit("dst_ip").alias("level"), F.col("dst_ip").alias("key")))
    keyed = fine.select("entity", "model_id", *COUNTS, F.inline(F.array(*levels)))
    counted = keyed.groupBy("entity", "model_id", "level", "key").agg(*[F.sum(c).alias(c) for c in COUNTS])
    return counted.select(
        F.lit(test_set).alias("test_set"), "entity", "model_id", F.lit(method).alias("method"), "level", "key", *COUNTS
    )


def with_metrics(counts: DataFrame) -> DataFrame:
    """Accuracy, precision and recall; -1 where undefined."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    return counts.withColumns({
        "accuracy": (tp + tn) / F.nullif(tp + tn + fp + fn, F.lit(0)),
        "precision": F.when(tp + fp == 0, -1.0).otherwise(tp / F.nullif(tp + fp, F.lit(0))),
        "recall": F.when(tp + fn == 0, -1.0).otherwise(tp / F.nullif(tp + fn, F.lit(0))),
    })


def _totals(counts: DataFrame, keys: list[str]) -> DataFrame:
    return counts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in COUNTS])


def model_totals(conf: DataFrame) -> DataFrame:
    """Counts per test set and model over all its entities."""
    return _totals(conf.filter(F.col("level") == "total"), ["test_set", "model_id", "method"])


def benign_share() -> Column:
    return (F.col("tn") + F.col("fn")) / _flows()


def _flows() -> Column:
    return F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")


def first_match(conf: DataFrame, model_order: DataFrame, share: float = 0.15) -> DataFrame:
    """Rows of the models tried until the first one whose benign share exceeds ``share``.

    ``model_order`` is ``(model_id, model_ord)``. The matching model is kept.
    """
    ordered = conf.join(model_order, "model_id")
    matched = ordered.filter((F.col("level") == "total") & (benign_share() > share))
    stops = matched.groupBy("test_set", "entity", "method").agg(F.min("model_ord").alias("_stop"))
    joined = ordered.join(stops, ["test_set", "entity", "method"], "left")
    return joined.filter(F.col("_stop").isNull() | (F.col("model_ord") <= F.col("_stop"))).drop("_stop")


def match_in_batches(
    assignments: DataFrame, model_order: DataFrame, judge: Callable[[DataFrame], DataFrame], share: float = 0.15,
    first: int = 1,
) -> DataFrame:
    """The rows of ``first_match``, without replaying and scoring the models behind a match.

    ``assignments`` is ``(entity, model_id)``; ``judge`` gives the confusion table of some of its rows. Each entity's
    models are tried in ``model_order``, ``first`` of them at first and twice as many in each next round; entities that
    have matched leave the next rounds. An entity that matches at place r is judged on fewer than ``first + 2 * r`` models,
    and n models take about log2(n) rounds. Without assignments the result is the empty table of ``judge``.
    """
    place = F.row_number().over(Window.partitionBy("entity").orderBy("model_ord", "model_id"))
    ranked = assignments.select("entity", "model_id").distinct().join(model_order, "model_id")
    waiting = freeze(ranked.select("entity", "model_id", place.alias("_place")))
    last = waiting.agg(F.max("_place")).first()[0] or 0
    done, width, found = 0, first, None
    while found is None or done < last:
        batch = waiting.filter(F.col("_place") <= done + width).select("entity", "model_id")
        judged = freeze(judge(batch))  # read by the result and by the next rounds
        found = judged if found is None else found.unionByName(judged)
        matched = judged.filter((F.col("level") == "total") & (benign_share() > share)).select("entity").distinct()
        done, width = done + width, 2 * width
        waiting = freeze(waiting.filter(F.col("_place") > done).join(matched, "entity", "left_anti"))
        if waiting.isEmpty():
            break
    return first_match(found, model_order, share)


def _big_enough(conf: DataFrame, level: str, min_flows: int | None) -> DataFrame:
    rows = conf.filter(F.col("level") == level)
    return rows if min_flows is None else rows.filter(_flows() >= min_flows)


def validation_scores(conf: DataFrame, min_host_flows: int | None = None, min_conn_flows: int | None = None) -> DataFrame:
    """Smallest threshold at which each benign host or connection is still recognised.

    ``1 - min`` over the models of the share of flows called anomalous; hosts
    with at least as many malicious as benign flows are left out.
    """
    anomalous = (F.col("tp") + F.col("fp")) / _flows()
    benign_host = F.col("tp") + F.col("fn") < F.col("tn") + F.col("fp")
    hosts = _big_enough(conf, "total", min_host_flows).filter(benign_host)
    conns = _big_enough(conf, "dst_ip", min_conn_flows).join(hosts.select(*PAIR), PAIR, "left_semi")
    per_host = hosts.groupBy("entity", "method").agg((1 - F.min(anomalous)).alias("threshold"))
    per_conn = conns.groupBy("entity", "method", "key").agg((1 - F.min(anomalous)).alias("threshold"))
    return per_host.select(F.lit("host").alias("level"), "method", "entity", F.lit("").alias("key"), "threshold").unionByName(
        per_conn.select(F.lit("connection").alias("level"), "method", "entity", "key", "threshold")
    )


def pick_thresholds(scores: DataFrame, percentile: float = 0.1) -> DataFrame:
    """One threshold per level and method, at a percentile of the validation scores."""
    picked = exact_quantiles(scores, ["level", "method"], ["threshold"], [percentile])
    return picked.select("level", "method", F.col("q_threshold")[0].alias("threshold"))


def verdicts(
    conf: DataFrame, thresholds: DataFrame, min_host_flows: int | None = None, min_conn_flows: int | None = None
) -> DataFrame:
    """Host and connection verdicts ``(test_set, level, method, entity, key, truth, verdict)``.

    0 is benign: some model finds a benign share above the threshold. A host is
    malicious with one malicious flow, a connection when at least half are.
    """
    hosts = _big_enough(conf, "total", min_host_flows)
    host_rows = hosts.select(*PAIR, F.lit("host").alias("level"), "key", *COUNTS)
    conns = _big_enough(conf, "dst_ip", min_conn_flows).join(hosts.select(*PAIR), PAIR, "left_semi")
    rows = host_rows.unionByName(conns.select(*PAIR, F.lit("connection").alias("level"), "key", *COUNTS))
    bad, good = F.col("tp") + F.col("fn"), F.col("tn") + F.col("fp")
    truth = F.when(F.col("level") == "host", bad > 0).otherwise(bad >= good).cast("int")
    judged = rows.join(thresholds, ["level", "method"]).groupBy("test_set", "level", "method", "entity", "key")
    return judged.agg(
        F.max(truth).alias("truth"),
        F.min(F.when(benign_share() > F.col("threshold"), 0).otherwise(1)).alias("verdict"),
    )


def symbolic_verdicts(errors: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """``errors(entity, model_id, method, error)``: benign if any model's error is below the threshold."""
    judged = errors.groupBy("method", "entity").agg(
        F.min(F.when(F.col("error") < threshold, 0).otherwise(1)).alias("verdict")
    )
    return judged.join(labels, "entity").select("method", "entity", F.col("label").alias("truth"), "verdict")


def entity_labels(indexed: DataFrame) -> DataFrame:
    """1 for entities with at least one malicious flow."""
    return indexed.groupBy("entity").agg(F.max("label").alias("label"))


def verdict_confusion(judged: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of verdicts against truth."""
    return judged.groupBy(*keys).agg(*outcome_counts(F.col("truth"), F.col("verdict")))


def dataset_totals(counts: DataFrame, keys: list[str] = ("level", "method"), scenario: str = "test_set") -> DataFrame:
    """Per scenario and in total (``scenario`` is ``total``), with metrics."""
    detail = counts.select(F.col(scenario).alias("scenario"), *keys, *COUNTS)
    rolled = detail.rollup(*keys, "scenario").agg(
        *[F.sum(c).alias(c) for c in COUNTS], F.grouping_id().alias("_depth")
    )
    rolled = rolled.filter(F.col("_depth") <= 1)
    named = rolled.withColumn("scenario", F.when(F.col("_depth") == 1, "total").otherwise(F.col("scenario")))
    return with_metrics(named.drop("_depth"))


def majority_verdicts(predictions: DataFrame) -> DataFrame:
    """Entity verdicts from rows ``(entity, label, pred)``: anomalous when most rows are."""
    counted = predictions.groupBy("entity").agg(*outcome_counts(F.col("label"), F.col("pred")))
    return counted.select(
        "entity",
        (F.col("tp") + F.col("fn") > 0).cast("int").alias("truth"),
        (F.col("tp") + F.col("fp") > F.col("tn") + F.col("fn")).cast("int").alias("verdict"),
    )
