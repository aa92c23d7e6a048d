"""Training and testing: from flows to state machines, detectors and confusion tables.

Each step that several later steps read is written to Parquet under ``path``, so
a lost executor costs one step and not the whole job.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scan import OrderedScan
from ..operators import dynamic, evaluate as K, machine as M, traces as T
from ..operators.detectors import forest, kde, lof, stats
from ..operators.entities import LEVEL_KEYS, index_flows, keep_entities, select_connections, select_hosts
from ..operators.entities import entity_flows, first_flows
from ..session import freeze


@dataclass
class Settings:
    """Choices of a run. ``windows`` is ``count``, ``static`` or ``dynamic``; ``method`` is
    ``baseline``, ``probabilistic``, ``lof``, ``forest`` or ``gaussian``."""

    numeric: list[str] = field(default_factory=lambda: ["src_bytes", "dst_bytes"])
    categorical: list[str] = field(default_factory=lambda: ["protocol_num"])
    level: str = "host"
    both_directions: bool = False
    min_flows: int = 50
    max_flows: int | None = None
    windows: str = "count"
    gap_us: int = T.SESSION_GAP_US
    bins: int = 4
    order: int = 1
    method: str = "baseline"
    scale: bool = False

    @property
    def features(self) -> list[str]:
        return [*self.categorical, *self.numeric]


def _kept(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def selected_flows(flows: DataFrame, settings: Settings) -> DataFrame:
    pick = select_hosts if settings.level == "host" else select_connections
    return keep_entities(flows, pick(flows, settings.min_flows), LEVEL_KEYS[settings.level])


def trace_records(flows: DataFrame, limits: dict, settings: Settings) -> DataFrame:
    """Records of all traces with their states, ``attrs`` and detector features."""
    coded = M.add_symbol(flows, limits)
    context = M.context_columns(settings.order)
    if settings.windows == "count":
        indexed = index_flows(coded, settings.level, settings.both_directions, context)
        if settings.max_flows:
            indexed = first_flows(indexed, settings.max_flows)
        traced = T.count_windows(indexed)
    else:
        sessions = T.sessionize(entity_flows(coded, settings.level, settings.both_directions), settings.gap_us, context)
        if settings.max_flows:
            sessions = first_flows(sessions, settings.max_flows)
        sessions = freeze(sessions)  # read by the parameters and by the windows
        params = T.session_params(sessions)
        cut = T.time_windows if settings.windows == "static" else dynamic.dynamic_windows
        traced = cut(sessions, params)
    attrs = F.array(*[F.col(c).cast("double") for c in settings.features])
    return M.add_states(traced, settings.order).select(
        "entity", "trace_id", "pos", "row_idx", "flow_id", "symbol", "state", "next_state", *settings.features,
        attrs.alias("attrs"),
    )


@dataclass
class Profiles:
    """A trained set of machines with the tables its detector needs."""

    settings: Settings
    limits: DataFrame
    visits: DataFrame
    states: DataFrame
    transitions: DataFrame
    bins: DataFrame
    scaler: DataFrame | None
    fits: dict[str, DataFrame]


def train(spark: SparkSession, flows: DataFrame, path: str, settings: Settings) -> Profiles:
    """Profiles of the benign ``flows``, one machine per selected entity."""
    chosen = selected_flows(flows, settings)
    limits = _kept(spark, M.fit_limits(chosen, settings.numeric, settings.categorical, settings.bins), f"{path}/limits")
    known = M.read_limits(limits)
    records = trace_records(chosen, known, settings)
    visits = _kept(spark, records.withColumn("model_id", F.col("entity")), f"{path}/visits")
    model = M.learn_state_model(visits, known)
    states = _kept(spark, M.state_weights(model.states), f"{path}/states")
    transitions = _kept(spark, model.transitions, f"{path}/transitions")
    bins = _kept(spark, model.bins, f"{path}/bins")
    width = len(settings.features)
    scaler = _kept(spark, stats.fit_scaler(visits, width), f"{path}/scaler") if settings.scale else None
    training = stats.robust_scale(visits, scaler) if scaler is not None else visits
    fits = {n: _kept(spark, df, f"{path}/fit_{n}") for n, df in _fit(training, bins, settings).items()}
    return Profiles(settings, limits, training, states, transitions, bins, scaler, fits)


def _fit(visits: DataFrame, bins: DataFrame, settings: Settings) -> dict[str, DataFrame]:
    width = len(settings.features)
    if settings.method == "baseline":
        return {"stats": stats.fit_stats(visits, width)}
    if settings.method == "probabilistic":
        numeric = visits.withColumn("attrs", F.slice("attrs", len(settings.categorical) + 1, len(settings.numeric)))
        return {
            "quantiles": stats.fit_state_quantiles(numeric, len(settings.numeric)),
            "priors": stats.pack_priors(M.bin_priors(bins), settings.numeric),
        }
    if settings.method == "lof":
        return {"lof": lof.fit_lof(visits)}
    if settings.method == "forest":
        return {"nodes": forest.fit_forest(visits, width, ["entity", "trace_id", "pos"])}
    return {"kde": kde.fit_kde(visits, width)}


def score(profiles: Profiles, replayed: DataFrame) -> DataFrame:
    """Predictions of the fitted detector for replayed visits."""
    settings, fits = profiles.settings, profiles.fits
    if profiles.scaler is not None:
        replayed = stats.robust_scale(replayed, profiles.scaler)
    if settings.method == "baseline":
        return stats.score_stats(replayed, fits["stats"])
    if settings.method == "probabilistic":
        numeric = replayed.withColumn("attrs", F.slice("attrs", len(settings.categorical) + 1, len(settings.numeric)))
        return stats.score_quantiles(numeric, fits["quantiles"], fits["priors"])
    if settings.method == "lof":
        return lof.score_lof(replayed, fits["lof"])
    if settings.method == "forest":
        return forest.score_forest(replayed, fits["nodes"])
    return kde.score_kde(replayed, profiles.visits, fits["kde"])


def test(
    spark: SparkSession, profiles: Profiles, flows: DataFrame, assignments: DataFrame, path: str, test_set: str,
    stop_share: float | None = None,
) -> DataFrame:
    """Confusion table of the ``flows`` on the models of ``assignments(entity, model_id)``.

    With ``stop_share`` the models of an entity are tried in order of their ids, until one finds a larger benign share;
    those behind it are neither replayed nor scored, and ``model_ord`` tells the order.
    """
    settings = profiles.settings
    records = trace_records(flows, M.read_limits(profiles.limits), settings)
    records = _kept(spark, records, f"{path}/records")
    truth = index_flows(flows, settings.level, settings.both_directions)

    def judge(tried: DataFrame) -> DataFrame:
        replayed = M.replay_context(records, profiles.states, tried)
        merged = K.merge_predictions(score(profiles, replayed), profiles.states)
        return K.confusion(K.label_predictions(merged, truth), test_set, settings.method, settings.level == "host")

    if stop_share is None:
        return judge(assignments)
    truth = _kept(spark, truth.select("entity", "row_idx", "label", "detailed_label", "dst_ip"), f"{path}/truth")
    models = OrderedScan(assignments.select("model_id").distinct(), [], ["model_id"]).index("model_ord").result()
    models = models.withColumn("model_ord", F.col("model_ord") + 1)
    return K.match_in_batches(assignments, freeze(models), judge, stop_share)
