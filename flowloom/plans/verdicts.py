"""From stored confusion tables to verdicts and totals; and the clustering baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import entities as E, evaluate as K, explore as X
from ..operators.detectors import lof


def judge(
    validation: DataFrame, results: DataFrame, percentile: float = 0.1, min_host_flows: int | None = 50,
    min_conn_flows: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(verdicts, totals)`` of ``results`` with thresholds picked from ``validation``."""
    thresholds = K.pick_thresholds(K.validation_scores(validation), percentile)
    judged = K.verdicts(results, thresholds, min_host_flows, min_conn_flows)
    counts = K.verdict_confusion(judged, ["test_set", "level", "method"])
    return judged, K.dataset_totals(counts)


def baseline(train: DataFrame, test: DataFrame, features: list[str], min_flows: int = 50, grouping: str = "host") -> DataFrame:
    """Verdict per host from a local outlier factor over entity views."""

    def view(flows: DataFrame) -> DataFrame:
        kept = E.keep_entities(flows, E.select_hosts(flows, min_flows), ["src_ip"])
        packed = F.array(*[F.col(f).cast("double") for f in features]).alias("attrs")
        seen = X.entity_view(kept, features, grouping)
        entity = F.col("src_ip") if grouping == "host" else F.concat_ws("-", "src_ip", "dst_ip")
        return seen.select(entity.alias("entity"), "label", packed, F.lit("all").alias("group"))

    fit = lof.fit_lof(view(train), ["group"], share=None, k=20)
    return K.majority_verdicts(lof.score_lof(view(test), fit, ["group"], share=None, k=20))
