"""Outlier bounds and what to do with values outside them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, join_on, present, q, with_stats
from ..functions.ordered import row_frame
from ..functions.quantiles import quantile_table
from ..functions.scale import checkpointed


def bounds(
    df: DataFrame,
    cols: Sequence[str],
    method: str = "iqr",
    by: Sequence[str] | str | None = None,
    k: float | None = None,
    low: float = 0.05,
    high: float = 0.95,
) -> DataFrame:
    """``lo_<c>`` and ``hi_<c>`` per column, one row or one per group.

    ``iqr``: quartiles -/+ k (1.5) quartile distances. ``zscore``: mean -/+ k (3) sample
    deviations. ``mad``: median -/+ k (3.5) median deviations / 0.6745. ``percentile``: the
    ``low`` and ``high`` quantiles.
    """
    keys = as_list(by)
    if method == "zscore":
        k = 3.0 if k is None else k
        aggs = []
        for c in cols:
            x = present(df, c).cast("double")
            aggs += [F.avg(x).alias(f"_m_{c}"), F.stddev_samp(x).alias(f"_s_{c}")]
        stats = df.groupBy(*keys).agg(*aggs)
        ends = {c: (q(f"_m_{c}") - k * q(f"_s_{c}"), q(f"_m_{c}") + k * q(f"_s_{c}")) for c in cols}
    elif method == "mad":
        k = 3.5 if k is None else k
        med = quantile_table(df, {c: [0.5] for c in cols}, keys)
        # a few rows, kept: what follows reads them more than once
        med = checkpointed(med.select(*keys, *[q(c)[0].alias(f"_m_{c}") for c in cols]))
        off = join_on(df, med, keys) if keys else with_stats(df, med, "_med").select("*", "_med.*")
        off = off.select(*keys, *[F.abs(present(df, c) - q(f"_m_{c}")).cast("double").alias(c) for c in cols])
        mad = quantile_table(off, {c: [0.5] for c in cols}, keys)
        mad = mad.select(*keys, *[q(c)[0].alias(f"_d_{c}") for c in cols])
        stats = join_on(med, mad, keys) if keys else with_stats(med, mad, "_mad").select("*", "_mad.*")
        width = {c: k * q(f"_d_{c}") / 0.6745 for c in cols}
        ends = {c: (q(f"_m_{c}") - width[c], q(f"_m_{c}") + width[c]) for c in cols}
    elif method in ("iqr", "percentile"):
        probs = [0.25, 0.75] if method == "iqr" else [low, high]
        k = (1.5 if k is None else k) if method == "iqr" else 0.0
        stats = quantile_table(df, {c: probs for c in cols}, keys)
        ends = {c: (q(c)[0] - k * (q(c)[1] - q(c)[0]), q(c)[1] + k * (q(c)[1] - q(c)[0])) for c in cols}
    else:
        raise ValueError(f"unknown outlier method {method!r}")
    cols_out = [e.alias(f"{p}_{c}") for c, pair in ends.items() for p, e in zip(("lo", "hi"), pair)]
    return stats.select(*keys, *cols_out)


def apply_bounds(
    df: DataFrame, cols: Sequence[str], limits: DataFrame, action: str = "clip", by: Sequence[str] | str | None = None
) -> DataFrame:
    """Treat values outside the bounds: ``flag`` (``<c>_outlier``), ``clip``, ``null`` or ``drop`` the row."""
    keys = as_list(by)
    if keys:
        joined = join_on(df, limits, keys)
        lo, hi = (lambda c: q(f"lo_{c}")), (lambda c: q(f"hi_{c}"))
    else:
        joined = with_stats(df, limits, "_b")
        lo, hi = (lambda c: F.col("_b").getField(f"lo_{c}")), (lambda c: F.col("_b").getField(f"hi_{c}"))
    drop = [f"{p}_{c}" for c in cols for p in ("lo", "hi")] if keys else ["_b"]
    outside = {c: F.coalesce((present(df, c) < lo(c)) | (present(df, c) > hi(c)), F.lit(False)) for c in cols}
    if action == "flag":
        out = joined.withColumns({f"{c}_outlier": outside[c] for c in cols})
    elif action == "clip":
        clipped = {c: F.least(F.greatest(present(df, c).cast("double"), lo(c)), hi(c)) for c in cols}
        out = joined.withColumns({c: F.when(present(df, c).isNotNull(), clipped[c]) for c in cols})
    elif action == "null":
        out = joined.withColumns({c: F.when(~outside[c], q(c)) for c in cols})
    elif action == "drop":
        keep = None
        for c in cols:
            keep = ~outside[c] if keep is None else keep & ~outside[c]
        out = joined.where(keep)
    else:
        raise ValueError(f"unknown action {action!r}")
    return out.drop(*drop)


def iqr_clipping(df: DataFrame, cols: Sequence[str], k: float = 1.5, action: str = "clip") -> DataFrame:
    return apply_bounds(df, cols, bounds(df, cols, "iqr", k=k), action)


def zscore_clipping(df: DataFrame, cols: Sequence[str], z: float = 3.0, action: str = "clip") -> DataFrame:
    return apply_bounds(df, cols, bounds(df, cols, "zscore", k=z), action)


def winsorization(df: DataFrame, cols: Sequence[str], lo: float = 0.05, hi: float = 0.95, action: str = "clip") -> DataFrame:
    return apply_bounds(df, cols, bounds(df, cols, "percentile", low=lo, high=hi), action)


def mad_outliers(df: DataFrame, cols: Sequence[str], k: float = 3.5, action: str = "flag") -> DataFrame:
    return apply_bounds(df, cols, bounds(df, cols, "mad", k=k), action)


def group_outliers(
    df: DataFrame, cols: Sequence[str], by: Sequence[str] | str, method: str = "iqr", action: str = "flag", k: float | None = None
) -> DataFrame:
    """The same with bounds per group."""
    return apply_bounds(df, cols, bounds(df, cols, method, by, k), action, by)


def temporal_outliers(
    df: DataFrame, col: str, order_by: Sequence[str], by: Sequence[str] | str | None = None, window: int = 20, z: float = 3.0
) -> DataFrame:
    """Add ``<c>_z``, the deviation from the preceding ``window`` rows, and ``<c>_outlier``."""
    x = present(df, col).cast("double")

    def stats(w):
        past = w.rowsBetween(-window, -1)
        return {"_mean": F.avg(x).over(past), "_sd": F.stddev_samp(x).over(past)}

    framed = row_frame(df, by, order_by, window, stats)
    score = F.when(F.col("_sd") > 0, (x - F.col("_mean")) / F.col("_sd"))
    out = framed.withColumn(f"{col}_z", score)
    return out.withColumn(f"{col}_outlier", F.coalesce(F.abs(q(f"{col}_z")) > z, F.lit(False))).drop("_mean", "_sd")


def outlier_report(df: DataFrame, cols: Sequence[str], method: str = "iqr", k: float | None = None) -> DataFrame:
    """Per column: method, bounds, and the percentage of values outside them."""
    limits = bounds(df, cols, method, k=k)
    flagged = with_stats(df, limits, "_b")
    aggs, structs = [], []
    for i, c in enumerate(cols):
        lo, hi = F.col("_b").getField(f"lo_{c}"), F.col("_b").getField(f"hi_{c}")
        x = present(df, c)
        aggs += [
            F.avg(((x < lo) | (x > hi)).cast("double")).alias(f"share{i}"),
            F.first(lo).alias(f"lo{i}"),
            F.first(hi).alias(f"hi{i}"),
        ]
        structs.append(
            F.struct(
                F.lit(c).alias("data_field_name"),
                (F.col(f"share{i}") * 100).alias("outlier_percentage"),
                F.lit(method).alias("detection_method"),
                F.col(f"lo{i}").alias("lower"),
                F.col(f"hi{i}").alias("upper"),
            )
        )
    return flagged.agg(*aggs).select(F.explode(F.array(*structs)).alias("r")).select("r.*")
