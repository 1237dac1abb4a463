"""Public calls: DataFrame in, DataFrame out."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from plantwatch import constants as K
from plantwatch.functions.expressions import (
    at_least, classification, explain_fusion, fuse, machine_status, risk_level, severity,
)
from plantwatch.operators import explain as X, validation as VA
from plantwatch.operators.errors import class_breakdown as build_breakdown, family_summary as summarise, mode_recall
from plantwatch.operators.splits import balanced_group_folds, balanced_groups, pick_samples, select_best_group_fold
from plantwatch.operators.timeline import build_timeline
from plantwatch.operators.training import Detector, load_detector, run_study
from plantwatch.sources.artifacts import model_path

AI4I_PRIMARY_THRESHOLD = K.PRIMARY_THRESHOLD
AI4I_EARLY_WARNING_THRESHOLD = K.EARLY_WARNING_THRESHOLD

__all__ = [
    "AI4I_EARLY_WARNING_THRESHOLD", "AI4I_PRIMARY_THRESHOLD", "balanced_group_folds", "balanced_groups", "build_breakdown",
    "build_timeline", "explain_ai4i_batch", "explain_fusion", "explain_rt_iot2022_batch", "fuse", "get_expected_features", "load_models", "mode_recall",
    "pick_samples", "predict_ai4i_batch", "predict_rt_iot2022_batch", "run_study", "scored_timeline", "select_best_group_fold",
    "severity", "summarise",
]


def load_models(spark: SparkSession, machine: str | None = None, network: str | None = None) -> tuple[Detector, Detector]:
    """Machine and network detector; each path is loaded once per process."""
    return (load_detector(machine or model_path(spark, "machine")),
            load_detector(network or model_path(spark, "network")))


def get_expected_features(machine: Detector, network: Detector) -> dict[str, list[str]]:
    return {"ai4i": machine.expected_features, "rt_iot2022": network.expected_features}


def _strict(df: DataFrame, detector: Detector, row_id: str, system: str, rules: list, keep: list[str],
            work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Schema and types from the plan, values while the rows are read once; a bad row refuses the batch."""
    features = [c for c in df.columns if c != row_id and c not in keep]
    VA.check_columns(df.select(*[F.col(f"`{c}`") for c in features]), detector.expected_features, system)
    VA.check_numeric(df, detector.prep.numeric, system)
    return VA.strict(df, rules, row_id, system, work)


def _machine(df: DataFrame, detector: Detector, row_id: str, keep: list[str], work) -> DataFrame:
    return _strict(df, detector, row_id, "AI4I", VA.machine_rules(row_id), keep, work)


def _network(df: DataFrame, detector: Detector, row_id: str, keep: list[str], work) -> DataFrame:
    return _strict(df, detector, row_id, "RT-IoT2022", VA.flow_rules(detector.prep.numeric, row_id), keep, work)


def predict_ai4i_batch(df: DataFrame, detector: Detector, row_id: str = "row_id", primary: float = K.PRIMARY_THRESHOLD,
                       early: float = K.EARLY_WARNING_THRESHOLD, keep: Sequence[str] = ()) -> DataFrame:
    """Failure probability, both decisions and the status of every reading; a bad row refuses the batch.

    ``keep``: columns beside the features that go through unchanged.
    """
    p = "failure_probability"
    return _machine(df, detector, row_id, list(keep), lambda ok: detector.score(ok, p).select(
        row_id, *keep, p, at_least(p, primary).alias("primary_failure"), at_least(p, early).alias("early_warning"),
        machine_status(p, primary, early).alias("status")))


def predict_rt_iot2022_batch(df: DataFrame, detector: Detector, row_id: str = "row_id", keep: Sequence[str] = ()) -> DataFrame:
    """Attack probability, decision and risk tier of every flow; a bad row refuses the batch."""
    p = "attack_probability"
    return _network(df, detector, row_id, list(keep), lambda ok: detector.score(ok, p).select(
        row_id, *keep, p, at_least(p, K.ATTACK_THRESHOLD).alias("attack"), classification(p).alias("classification"),
        risk_level(p).alias("risk_level")))


def _contributions(df: DataFrame, detector: Detector, row_id: str, top_k: int) -> DataFrame:
    if detector.kind == "linear":
        out = X.linear_contributions(df, row_id, detector.model.weights, detector.model.means)
    else:
        out = X.tree_contributions(detector, df, row_id)
    return X.top_contributions(out, top_k)


def _explained(detector: Detector, row_id: str, top_k: int) -> Callable[[DataFrame], DataFrame]:
    space = "probability" if detector.kind == "forest" else "log-odds"
    return lambda ok: _contributions(ok, detector, row_id, top_k).withColumn("output_space", F.lit(space))


def explain_ai4i_batch(df: DataFrame, detector: Detector, row_id: str = "row_id", top_k: int = 3) -> DataFrame:
    """The top_k contributions of every reading, largest first; a bad row refuses the batch."""
    return _machine(df, detector, row_id, [], _explained(detector, row_id, top_k))


def explain_rt_iot2022_batch(df: DataFrame, detector: Detector, row_id: str = "row_id", top_k: int = 3) -> DataFrame:
    return _network(df, detector, row_id, [], _explained(detector, row_id, top_k))


def scored_timeline(readings: DataFrame, machine: Detector, flows: DataFrame | None = None, network: Detector | None = None,
                    row_id: str = "row_id", flow_id: str = "row_id", primary: float = K.PRIMARY_THRESHOLD,
                    early: float = K.EARLY_WARNING_THRESHOLD, top_k: int = 3, **debounce) -> DataFrame:
    """Alert timeline from raw readings and flows: both are validated and scored, then fused per machine and tick.

    readings: row_id, machine, tick and the machine detector's features; flows likewise, with true_class and
    true_attack. Every reading carries its ``drivers``, which name the top driver in the events of
    ``level_events``. Only readings that can raise an alarm (at least ``primary`` or ``early``) are explained.
    """
    place = ["machine", "tick"]
    p = "failure_probability"
    risky = at_least(p, min(primary, early))
    numbers = detector_columns(machine)

    def work(ok: DataFrame) -> DataFrame:
        return machine.score(ok, p).select(row_id, *place, p, *[F.col(f"`{c}`") for c in numbers])

    scored = _machine(readings, machine, row_id, place, work)
    drivers = _contributions(scored.filter(risky), machine, row_id, top_k).select(row_id, F.col("contributions").alias("drivers"))
    telemetry = scored.select(row_id, *place, F.col(p).alias("p")).join(drivers, row_id, "left").drop(row_id)
    line = None
    if flows is not None:
        truth = [c for c in ("true_class", "true_attack") if c in flows.columns]
        line = predict_rt_iot2022_batch(flows, network, flow_id, [*place, *truth]).select(
            *place, *truth, F.col("attack").alias("flagged"), F.col("attack_probability").alias("attack_p"))
    return build_timeline(telemetry, line, primary=primary, early=early, **debounce)


def detector_columns(detector: Detector) -> list[str]:
    """Input columns that an explanation of the detector reads."""
    return list(detector.model.weights) if detector.kind == "linear" else detector.expected_features
