"""Handling of missing values. NaN in a floating column counts as missing."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, is_missing, join_on, present, q, with_stats
from ..functions.ordered import carry_last, carry_next, ordered_scan
from ..functions.quantiles import quantile_table
from ..functions.scale import checkpointed
from .neighbours import nearest


def drop_rows(df: DataFrame, cols: Sequence[str] | None = None, how: str = "any") -> DataFrame:
    """Drop rows with a missing value in any (or in all) of ``cols``."""
    return df.dropna(how=how, subset=list(cols or df.columns))


def flag_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Add ``<c>_missing``, 1 or 0."""
    return df.withColumns({f"{c}_missing": is_missing(df, c).cast("int") for c in cols})


def constant_imputation(df: DataFrame, values: Mapping[str, object]) -> DataFrame:
    """Missing values to a fixed value per column."""
    return df.withColumns({c: F.when(is_missing(df, c), F.lit(v)).otherwise(q(c)) for c, v in values.items()})


def _fill(df: DataFrame, cols: Sequence[str], stats: DataFrame, by: list[str]) -> DataFrame:
    """Fill each column from the same-named column of a statistics table (one row, or one per group)."""
    if not by:
        filled = with_stats(df, stats, "_fill")
        new = {c: F.when(is_missing(df, c), F.col("_fill").getField(c)).otherwise(q(c)) for c in cols}
        return filled.withColumns(new).drop("_fill")
    named = stats.withColumnsRenamed({c: f"_fill_{c}" for c in cols})
    filled = join_on(df, named, by)
    new = {c: F.when(is_missing(df, c), q(f"_fill_{c}")).otherwise(q(c)) for c in cols}
    return filled.withColumns(new).drop(*[f"_fill_{c}" for c in cols])


def mean_imputation(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = None) -> DataFrame:
    """Missing numbers to the mean, per group if ``by``."""
    keys = as_list(by)
    stats = df.groupBy(*keys).agg(*[F.avg(present(df, c)).alias(c) for c in cols])
    return _fill(df, cols, stats, keys)


def median_imputation(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = None) -> DataFrame:
    """Missing numbers to the exact median."""
    keys = as_list(by)
    medians = quantile_table(df, {c: [0.5] for c in cols}, keys)
    return _fill(df, cols, medians.select(*keys, *[q(c)[0].alias(c) for c in cols]), keys)


def mode_imputation(df: DataFrame, cols: Sequence[str], by: Sequence[str] | str | None = None) -> DataFrame:
    """Missing values to the most frequent one; ties go to the smallest value."""
    keys = as_list(by)
    for c in cols:
        counts = df.where(~is_missing(df, c)).groupBy(*keys, q(c).alias("_v")).agg(F.count("*").alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v")))
        stats = counts.groupBy(*keys).agg(best.alias("_b")).select(*keys, F.col("_b.v").alias(c))
        df = _fill(df, [c], stats, keys)
    return df


def forward_fill(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] | str | None = None
) -> DataFrame:
    """The last valid value so far. ``order_by`` must order rows totally within a partition."""
    return carry_last(df, partition_by, order_by, {c: present(df, c) for c in cols})


def backward_fill(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] | str | None = None
) -> DataFrame:
    """The next valid value."""
    return carry_next(df, partition_by, order_by, {c: present(df, c) for c in cols})


def _interpolate(df: DataFrame, cols: Sequence[str], order: Sequence[str], keys, position: Column | None) -> DataFrame:
    """Lines between the points (position, value) around each gap; by row number without a position."""
    pos = F.col("_row") if position is None else position
    point = {
        c: F.when(~is_missing(df, c), F.struct(present(df, c).cast("double").alias("v"), pos.alias("p"))) for c in cols
    }
    both = ordered_scan(
        df,
        keys,
        order,
        number="_row" if position is None else None,
        last={f"_a_{c}": v for c, v in point.items()},
        following={f"_b_{c}": v for c, v in point.items()},
    )
    new = {}
    for c in cols:
        a, b = q(f"_a_{c}"), q(f"_b_{c}")
        share = F.try_divide(pos - a["p"], b["p"] - a["p"])
        line = a["v"] + (b["v"] - a["v"]) * share
        new[c] = F.when(~is_missing(df, c), q(c).cast("double")).when(b.isNull(), a["v"]).otherwise(line)
    return both.withColumns(new).drop("_row", *[f"_a_{c}" for c in cols], *[f"_b_{c}" for c in cols])


def interpolation_linear(
    df: DataFrame, cols: Sequence[str], order_by: Sequence[str], partition_by: Sequence[str] | str | None = None
) -> DataFrame:
    """Straight lines between neighbours, rows evenly spaced. Leading gaps stay; trailing ones keep the last value."""
    return _interpolate(df, cols, order_by, partition_by, None)


def interpolation_time(
    df: DataFrame, cols: Sequence[str], ts: str, partition_by: Sequence[str] | str | None = None,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Straight lines between neighbours, weighted by the time between them (in microseconds)."""
    micros = F.unix_micros(q(ts).cast("timestamp"))
    return _interpolate(df, cols, [ts, *tiebreak], partition_by, micros)


def knn_imputation(
    df: DataFrame, target: str, features: Sequence[str], key: str, k: int = 5, block: Sequence[str] | str | None = None
) -> DataFrame:
    """Missing numbers to the mean of the k nearest complete rows (standardised features; ties by key)."""
    blocks = as_list(block)
    spread = df.agg(
        *[F.avg(present(df, f)).alias(f"m{i}") for i, f in enumerate(features)],
        *[F.stddev_pop(present(df, f)).alias(f"s{i}") for i, f in enumerate(features)],
    )
    scaled = with_stats(df, spread, "_sp")
    axes = {
        f"_f{i}": F.coalesce(
            F.try_divide(present(df, f).cast("double") - F.col(f"_sp.m{i}"), F.nullif(F.col(f"_sp.s{i}"), F.lit(0.0))), F.lit(0.0)
        )
        for i, f in enumerate(features)
    }
    known_features = None
    for f in features:
        cond = ~is_missing(df, f)
        known_features = cond if known_features is None else known_features & cond
    points = scaled.where(known_features).select(q(key).alias("_key"), *blocks, q(target).alias("_y"), *[v.alias(n) for n, v in axes.items()])
    gaps = points.where(F.col("_y").isNull() | F.isnan(F.col("_y").cast("double"))).drop("_y")
    full = points.where(F.col("_y").isNotNull() & ~F.isnan(F.col("_y").cast("double")))
    found = nearest(gaps, full, list(axes), k, key="_key", carry=["_y"], block=blocks)
    means = found.groupBy("_key").agg(F.avg("_y").alias("_mean"))
    joined = df.join(means, q(key) == F.col("_key"), "left")
    filled = F.when(is_missing(df, target), F.col("_mean")).otherwise(q(target).cast("double"))
    return joined.withColumn(target, filled).drop("_key", "_mean")


def _linear_fit(rows: DataFrame, target: str, features: Sequence[str]):
    """Least squares from one distributed pass; only the coefficients reach the driver."""
    assembled = VectorAssembler(inputCols=list(features), outputCol="_x").transform(rows)
    model = LinearRegression(featuresCol="_x", labelCol=target, solver="normal", regParam=0.0).fit(assembled)
    return model.coefficients.toArray().tolist(), model.intercept


def regression_imputation(df: DataFrame, target: str, features: Sequence[str]) -> DataFrame:
    """Missing numbers to the prediction of a linear model fitted on the complete rows."""
    y = present(df, target).cast("double")
    if len(features) == 1:
        x = present(df, features[0]).cast("double")
        fit = df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("base"))
        out = with_stats(df, fit, "_fit")
        guess = F.col("_fit.base") + F.col("_fit.slope") * x
        return out.withColumn(target, F.when(is_missing(df, target), guess).otherwise(y)).drop("_fit")
    double = [present(df, c).cast("double").alias(c) for c in [target, *features]]
    coefs, base = _linear_fit(df.select(*double).dropna(), target, features)
    guess = F.lit(float(base))
    for f, w in zip(features, coefs):
        guess = guess + present(df, f).cast("double") * F.lit(float(w))
    return df.withColumn(target, F.when(is_missing(df, target), guess).otherwise(y))


def iterative_imputation(df: DataFrame, cols: Sequence[str], rounds: int = 3) -> DataFrame:
    """Each column in turn is a linear model of the others, from mean-filled values, for fixed rounds."""
    cols = list(cols)
    gaps = {c: F.col(f"_gap_{c}") for c in cols}
    work = df.withColumns({f"_gap_{c}": is_missing(df, c) for c in cols})
    work = mean_imputation(work.withColumns({c: present(df, c).cast("double") for c in cols}), cols)
    for _ in range(rounds):
        work = checkpointed(work)
        for c in cols:
            others = [o for o in cols if o != c]
            coefs, base = _linear_fit(work.where(~gaps[c]).select(c, *others), c, others)
            guess = F.lit(float(base))
            for o, w in zip(others, coefs):
                guess = guess + q(o) * F.lit(float(w))
            work = work.withColumn(c, F.when(gaps[c], guess).otherwise(q(c)))
    return work.drop(*[f"_gap_{c}" for c in cols])
