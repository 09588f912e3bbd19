"""Cleaning plans: up to five named steps applied as one lazy query."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import anomalies, bins, encode, features, missing, outliers, reduce, scaling
from ..operators.profile import degradation_report
from .catalog import ACTIONS

MOST_STEPS = 5


def _incremental_pca(df: DataFrame, features, k: int, prefix: str = "pc") -> DataFrame:
    loadings, _, means = reduce.incremental_pca([df], features, k)
    return reduce.project(df, features, loadings, means, prefix)


def _local_outlier_factor(df: DataFrame, axes, key: str, k: int = 5, block=None) -> DataFrame:
    return df.join(anomalies.local_outlier_factor(df, axes, key, k, block), key, "left")


OPERATORS: dict[str, Callable[..., DataFrame]] = {
    **{
        label: getattr(module, label)
        for module, labels in (
            (missing, ACTIONS["missing-values-handling"]),
            (encode, ACTIONS["encoding"]),
            (scaling, ACTIONS["scaling-normalization"]),
            (bins, ACTIONS["binning-discretization"]),
            (features, ACTIONS["feature-construction"]),
        )
        for label in labels
    },
    "iqr_clipping": outliers.iqr_clipping,
    "zscore_clipping": outliers.zscore_clipping,
    "winsorization": outliers.winsorization,
    "isolation_forest_detection": anomalies.isolation_forest_detection,
    "local_outlier_factor": _local_outlier_factor,
    "dbscan_outlier_removal": anomalies.dbscan_outlier_removal,
    "pca": reduce.pca,
    "incremental_pca": _incremental_pca,
    "kernel_pca": reduce.kernel_pca,
    "truncated_svd": reduce.truncated_svd,
    "autoencoder_projection": reduce.autoencoder_projection,
    "variance_threshold": reduce.variance_threshold,
    "correlation_filtering": reduce.correlation_filtering,
}


@dataclass(frozen=True)
class Step:
    """One action of a stage with its parameters."""

    stage: str
    action: str
    params: Mapping = field(default_factory=dict)


def resolve(step: Step) -> Callable[..., DataFrame]:
    """The operator behind a catalogue label; unknown stages and labels are errors."""
    if step.stage not in ACTIONS:
        raise KeyError(f"Unknown transformation stage '{step.stage}'")
    if step.action not in ACTIONS[step.stage]:
        raise KeyError(f"stage '{step.stage}' has no action '{step.action}'")
    return OPERATORS[step.action]


def apply_plan(df: DataFrame, steps: Sequence[Step], most_steps: int | None = MOST_STEPS) -> DataFrame:
    """Apply the steps in order. All of them are resolved before the first one runs.

    A plan of more than ``most_steps`` is an error; None allows any number.
    """
    if most_steps is not None and len(steps) > most_steps:
        raise ValueError(f"a plan has at most {most_steps} steps, not {len(steps)}")
    for step, operator in [(s, resolve(s)) for s in steps]:
        df = operator(df, **step.params)
    return df


def evaluate_plan(df: DataFrame, steps: Sequence[Step], most_steps: int | None = MOST_STEPS) -> tuple[DataFrame, DataFrame]:
    """The cleaned table, and the before/after report on it."""
    cleaned = apply_plan(df, steps, most_steps)
    return cleaned, degradation_report(df, cleaned)
