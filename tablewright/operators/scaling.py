"""Rescaling numbers. A column without spread becomes 0."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import present, q, with_stats
from ..functions.quantiles import quantile_struct, quantile_table


def _x(df: DataFrame, c: str) -> Column:
    return present(df, c).cast("double")


def _ratio(top: Column, bottom: Column) -> Column:
    return F.when(top.isNull(), None).otherwise(F.coalesce(F.try_divide(top, F.nullif(bottom, F.lit(0.0))), F.lit(0.0)))


def min_max_scaling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(*[f(_x(df, c)).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    s = F.col("_s")
    new = {c: _ratio(_x(df, c) - s[f"lo_{c}"], s[f"hi_{c}"] - s[f"lo_{c}"]) for c in cols}
    return with_stats(df, stats, "_s").withColumns(new).drop("_s")


def standard_scaling(df: DataFrame, cols: Sequence[str], ddof: int = 0) -> DataFrame:
    spread = F.stddev_pop if ddof == 0 else F.stddev_samp
    stats = df.agg(*[f(_x(df, c)).alias(f"{n}_{c}") for c in cols for n, f in (("m", F.avg), ("sd", spread))])
    s = F.col("_s")
    new = {c: _ratio(_x(df, c) - s[f"m_{c}"], s[f"sd_{c}"]) for c in cols}
    return with_stats(df, stats, "_s").withColumns(new).drop("_s")


def robust_scaling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(x - median) / interquartile range."""
    stats = quantile_struct(df, {c: [0.25, 0.5, 0.75] for c in cols})
    s = F.col("_s")
    new = {c: _ratio(_x(df, c) - s[f"{c}_q1"], s[f"{c}_q2"] - s[f"{c}_q0"]) for c in cols}
    return with_stats(df, stats, "_s").withColumns(new).drop("_s")


def max_abs_scaling(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    stats = df.agg(*[F.max(F.abs(_x(df, c))).alias(c) for c in cols])
    new = {c: _ratio(_x(df, c), F.col("_s").getField(c)) for c in cols}
    return with_stats(df, stats, "_s").withColumns(new).drop("_s")


def log_transform(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """sign(x) * log(1 + |x|)."""
    return df.withColumns({c: F.signum(_x(df, c)) * F.log1p(F.abs(_x(df, c))) for c in cols})


def yeo_johnson(x: Column, lam: Column) -> Column:
    """The Yeo-Johnson transform (2000) of x at lambda."""
    up = F.when(F.abs(lam) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, lam) - 1) / lam)
    two = 2 - lam
    down = F.when(F.abs(two) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, two) - 1) / two)
    return F.when(x >= 0, up).otherwise(down)


def yeo_johnson_fit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """One row with the most likely lambda per column, on the grid -2, -1.9 ... 2. One scan.

    Each value meets every lambda in the same task, and only 41 partial variances per column
    and task are shuffled.
    """
    grid = F.array(*[F.lit(round(-2 + 0.1 * i, 1)) for i in range(41)])
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _x(df, c).alias("x")) for i, c in enumerate(cols)])
    long = df.select(F.explode(cells).alias("v")).select("v.c", "v.x", F.explode(grid).alias("lam"))
    x, lam = F.col("x"), F.col("lam")
    stats = long.groupBy("c", "lam").agg(
        F.count(x).cast("double").alias("n"),
        F.var_pop(yeo_johnson(x, lam)).alias("v"),
        F.sum(F.signum(x) * F.log1p(F.abs(x))).alias("j"),
    )
    fit = -F.col("n") / 2 * F.log(F.nullif(F.col("v"), F.lit(0.0))) + (lam - 1) * F.col("j")
    score = F.when(fit.isNotNull(), F.struct(fit.alias("fit"), (-lam).alias("first")))
    best = [F.coalesce(F.max_by("lam", F.when(F.col("c") == i, score)), F.lit(1.0)).alias(c) for i, c in enumerate(cols)]
    return stats.agg(*best)


def power_transform_yeo_johnson(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Transform each column at its most likely lambda."""
    fit = yeo_johnson_fit(df, cols)
    new = {c: yeo_johnson(_x(df, c), F.col("_s").getField(c)) for c in cols}
    return with_stats(df, fit, "_s").withColumns(new).drop("_s")


# Coefficients of Acklam's rational approximation of the normal quantile.
_A = [-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00]
_B = [-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01]
_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00]
_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00]


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """Inverse of the standard normal distribution function, to about nine digits."""
    edge = 0.02425
    q0 = p - 0.5
    r = q0 * q0
    mid = np.polyval(_A, r) * q0 / np.polyval([*_B, 1.0], r)

    def tail(share: np.ndarray) -> np.ndarray:
        t = np.sqrt(-2 * np.log(share))
        return np.polyval(_C, t) / np.polyval([*_D, 1.0], t)

    return np.where(p < edge, tail(p), np.where(p > 1 - edge, -tail(1 - p), mid))


def quantile_transform(df: DataFrame, cols: Sequence[str], output: str = "uniform", knots: int = 1000) -> DataFrame:
    """Map each column to its quantile, uniform or normal, by lines between ``knots`` + 1 exact quantiles.

    Equal knots share the mean of their probabilities. The fit is at most ``knots`` + 1
    numbers per column; rows find their place among them by binary search in Arrow batches.
    """
    if output not in ("uniform", "normal"):
        raise ValueError(f"unknown output {output!r}")
    probs = [i / knots for i in range(knots + 1)]
    fit = quantile_table(df, {c: probs for c in cols}).first()
    shares = {}
    for c in cols:
        at: dict[float, list[float]] = {}
        for p, v in zip(probs, fit[c] or []):
            at.setdefault(v, []).append(p)
        values = sorted(at)
        share = _between(values, [sum(at[v]) / len(at[v]) for v in values], output == "normal")(_x(df, c))
        shares[c] = F.when(_x(df, c).isNotNull(), share)
    return df.withColumns(shares)


def _between(values: list[float], heights: list[float], normal: bool):
    @F.pandas_udf("double")
    def place(x: pd.Series) -> pd.Series:
        share = np.interp(x, values, heights) if len(values) > 1 else np.full(len(x), 0.5)
        if normal:
            share = normal_quantile(np.clip(share, 1e-7, 1 - 1e-7))
        return pd.Series(share, index=x.index)

    return place
