"""Fewer columns: projections and column selection.

Only moment matrices (columns by columns) and fitted coefficients reach the driver.
Feature lists may be numeric columns, or one array column of fixed length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import field_type, present, q


def feature_array(df: DataFrame, features: Sequence[str] | str) -> Column:
    """The features of a row as one array of doubles."""
    if isinstance(features, str) and isinstance(field_type(df, features), T.ArrayType):
        return q(features).cast("array<double>")
    names = [features] if isinstance(features, str) else list(features)
    return F.array(*[present(df, c).cast("double") for c in names])


def _with_features(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """All rows, their features as the array ``_x``; null where a feature is missing."""
    x = feature_array(df, features)
    return df.withColumn("_x", F.when(~F.exists(x, lambda v: v.isNull() | F.isnan(v)), x))


def _complete(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """For fitting: rows without missing features, which become the array ``_x``."""
    return _with_features(df, features).where("_x is not null")


def array_udf(change):
    """A function of stacked feature rows as a column function; null stays null."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        known = x.notna()
        out = pd.Series([None] * len(x), index=x.index, dtype=object)
        if known.any():
            out[known] = pd.Series(list(change(np.stack(x[known].to_numpy()).astype(float))), index=x.index[known])
        return out

    return run


_MOMENTS = "n long, mean array<double>, left array<double>, m2 array<double>"


def moments(df: DataFrame, features: Sequence[str] | str) -> DataFrame:
    """``(n, mean, left, m2)``: per task the row count, means and centred sums of products of its rows.

    The mean is ``mean + left``, in two numbers to keep the digits of large ones. ``m2`` is the square matrix row by row. Only these rows are shuffled. Parts of several tables can be
    put together with ``unionByName``; :func:`merged_moments` adds them up without loss of digits.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for batch in batches:
            if len(batch) == 0:
                continue
            x = np.stack(batch["_x"].to_numpy()).astype(float)
            apart = x - x.mean(axis=0)  # the mean of large numbers is not exact, so what it leaves is centred again
            left = apart.mean(axis=0)
            own = len(x), x.mean(axis=0), left, (apart - left).T @ (apart - left)
            total = own if total is None else _merged(total, own)
        if total is not None:
            yield pd.DataFrame({"n": [total[0]], "mean": [total[1]], "left": [total[2]], "m2": [total[3].ravel()]})

    return _complete(df, features).select("_x").mapInPandas(fold, _MOMENTS)


def _merged(a: tuple, b: tuple) -> tuple:
    """Count, means and centred products of two sets of rows together (Chan, Golub and LeVeque)."""
    n, apart = a[0] + b[0], (b[1] - a[1]) + (b[2] - a[2])
    return n, a[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


def merge_moments(parts: DataFrame) -> DataFrame:
    """One row for all parts, merged pairwise on the executors."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = zip(pdf["n"], pdf["mean"], pdf["left"], pdf["m2"], strict=True)
        rows = [(int(n), np.asarray(m), np.asarray(x), np.asarray(c).reshape(len(m), -1)) for n, m, x, c in parts]
        rows.sort(key=lambda r: (r[0], *r[1]))
        while len(rows) > 1:
            rows = [_merged(*rows[i : i + 2]) if i + 1 < len(rows) else rows[i] for i in range(0, len(rows), 2)]
        n, mean, left, m2 = rows[0]
        return pd.DataFrame({"n": [n], "mean": [mean], "left": [left], "m2": [m2.ravel()]})

    some = parts.withColumn("_g", F.pmod(F.xxhash64("n", "mean"), F.lit(64)))
    few = some.groupBy("_g").applyInPandas(lambda pdf: fold(pdf.drop(columns="_g")), _MOMENTS)
    return few.groupBy().applyInPandas(fold, _MOMENTS)


def moment_sums(merged: DataFrame) -> DataFrame:
    """``(i, j, s)`` sums of products of features i <= j; index -1 is the constant 1."""
    d = F.size("mean")
    cells = merged.withColumn("i", F.explode(F.sequence(F.lit(-1), d - 1))).withColumn("j", F.explode(F.sequence("i", d - 1)))
    mean = lambda i: F.get("mean", F.col(i)) + F.get("left", F.col(i))
    ones = F.when(F.col("j") < 0, F.col("n").cast("double")).otherwise(F.col("n") * mean("j"))
    products = F.get("m2", F.col("i") * d + F.col("j")) + F.col("n") * mean("i") * mean("j")
    return cells.select("i", "j", F.when(F.col("i") < 0, ones).otherwise(products).alias("s"))


def _collected(parts: DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Row count, means and centred sums of products."""
    row = merge_moments(parts).first()
    if row is None:
        raise ValueError("no row has all features")
    mean = np.array(row["mean"]) + np.array(row["left"])
    return row["n"], mean, np.array(row["m2"]).reshape(len(mean), -1)


def _fix_signs(loadings: np.ndarray) -> np.ndarray:
    """Make the largest loading of each component positive."""
    top = np.argmax(np.abs(loadings), axis=0)
    return loadings * np.where(loadings[top, np.arange(loadings.shape[1])] < 0, -1.0, 1.0)


def components_from_moments(table: DataFrame, k: int, centre: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(loadings, variances, means)`` of the k strongest directions."""
    n, means, m2 = _collected(table)
    if centre:
        cov = m2 / (n - 1)
    else:
        cov, means = m2 + n * np.outer(means, means), np.zeros(len(means))
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values)[:k]
    return _fix_signs(vectors[:, order]), values[order], means


def project(df: DataFrame, features: Sequence[str] | str, loadings: np.ndarray, means: np.ndarray, prefix: str) -> DataFrame:
    """Add ``<prefix>1`` ... by multiplying Arrow batches with the loadings; null where a feature is missing."""
    times = array_udf(lambda x: (x - means) @ loadings)
    rows = _with_features(df, features).withColumn("_p", times("_x"))
    return rows.withColumns({f"{prefix}{i + 1}": F.col("_p")[i] for i in range(loadings.shape[1])}).drop("_x", "_p")


def pca(df: DataFrame, features: Sequence[str] | str, k: int, prefix: str = "pc") -> DataFrame:
    """Principal components of the centred features; the largest loading of each is positive.

    Rows with a missing feature stay, with null components.
    """
    loadings, _, means = components_from_moments(moments(df, features), k)
    return project(df, features, loadings, means, prefix)


def incremental_pca(batches: Sequence[DataFrame], features: Sequence[str] | str, k: int):
    """PCA from the moments of batches, summed: the same result as on their union.

    Returns ``(loadings, variances, means)``, ready for :func:`project`. A stream keeps the
    same table of moments (see ``streaming.stream_moments``).
    """
    total = None
    for batch in batches:
        part = moments(batch, features)
        total = part if total is None else total.unionByName(part)
    return components_from_moments(total, k)


def truncated_svd(df: DataFrame, features: Sequence[str] | str, k: int, prefix: str = "sv") -> DataFrame:
    """Projection on the k strongest right singular vectors, without centring."""
    loadings, _, means = components_from_moments(moments(df, features), k, centre=False)
    return project(df, features, loadings, means, prefix)


def fourier_features(df: DataFrame, features: Sequence[str] | str, gamma: float, n_features: int = 64, seed: int = 42) -> DataFrame:
    """Random Fourier features (Rahimi and Recht, 2007) of the kernel exp(-gamma |x-y|^2), as the array ``_z``."""
    rows = _with_features(df, features)
    size = max(rows.select(F.max(F.size("_x")).alias("d")).first()["d"] or 0, 0)
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, math.sqrt(2 * gamma), (size, n_features))
    b = rng.uniform(0.0, 2 * math.pi, n_features)

    lift = array_udf(lambda x: math.sqrt(2.0 / n_features) * np.cos(x @ w + b))
    return rows.withColumn("_z", lift("_x")).drop("_x")


def kernel_pca(
    df: DataFrame, features: Sequence[str] | str, k: int, gamma: float = 1.0, n_features: int = 64, seed: int = 42, prefix: str = "kpc"
) -> DataFrame:
    """Kernel PCA by random Fourier features: linear in the number of rows, where a kernel matrix is not."""
    lifted = fourier_features(df, features, gamma, n_features, seed)
    loadings, _, means = components_from_moments(moments(lifted, "_z"), k)
    return project(lifted, "_z", loadings, means, prefix).drop("_z")


def autoencoder_projection(
    df: DataFrame, features: Sequence[str] | str, k: int, epochs: int = 20, rate: float = 0.1, seed: int = 42, prefix: str = "ae"
) -> DataFrame:
    """The hidden layer of a tanh autoencoder on standardised features.

    Full-batch gradient descent with momentum: each task sums the gradient of its rows, the sums are added up,
    and the weights (features by k) go round. Rows never leave their task.
    """
    n, means, m2 = _collected(moments(df, features))
    spread = np.sqrt(np.diag(m2) / n)
    spread[spread == 0] = 1.0
    d = len(means)
    rng = np.random.default_rng(seed)
    weights = {
        "w": rng.normal(0, 1 / math.sqrt(d), (d, k)),
        "b": np.zeros(k),
        "v": rng.normal(0, 1 / math.sqrt(k), (k, d)),
        "c": np.zeros(d),
    }
    names = list(weights)
    speed = {name: np.zeros_like(value) for name, value in weights.items()}
    rows = _complete(df, features).select("_x").persist()
    for _ in range(epochs):
        current = {name: value.copy() for name, value in weights.items()}

        def gradients(batches: Iterator[pd.DataFrame], current=current) -> Iterator[pd.DataFrame]:
            total = None
            for batch in batches:
                if len(batch) == 0:
                    continue
                x = (np.stack(batch["_x"].to_numpy()).astype(float) - means) / spread
                h = np.tanh(x @ current["w"] + current["b"])
                err = h @ current["v"] + current["c"] - x
                back = (err @ current["v"].T) * (1 - h * h)
                grads = [x.T @ back, back.sum(axis=0), h.T @ err, err.sum(axis=0)]
                flat = np.concatenate([g.ravel() for g in grads])
                total = flat if total is None else total + flat
            if total is not None:
                yield pd.DataFrame({"i": np.arange(len(total)), "g": total})

        parts = rows.mapInPandas(gradients, "i int, g double").groupBy("i").agg(F.sum("g").alias("g"))
        flat = parts.toPandas().sort_values("i")["g"].to_numpy() / (n * d)
        at = 0
        for name in names:
            size = weights[name].size
            step = flat[at : at + size].reshape(weights[name].shape)
            speed[name] = 0.9 * speed[name] - rate * step * d
            weights[name] = weights[name] + speed[name]
            at += size
    rows.unpersist()
    w, b = weights["w"], weights["b"]

    encode = array_udf(lambda x: np.tanh((x - means) / spread @ w + b))
    out = _with_features(df, features).withColumn("_p", encode("_x"))
    return out.withColumns({f"{prefix}{i + 1}": F.col("_p")[i] for i in range(k)}).drop("_x", "_p")


def variance_report(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """``(data_field_name, variance, kept)``: sample variance against the threshold."""
    row = df.agg(*[F.var_samp(present(df, c).cast("double")).alias(f"v{i}") for i, c in enumerate(cols)])
    structs = [
        F.struct(
            F.lit(c).alias("data_field_name"),
            F.col(f"v{i}").alias("variance"),
            F.coalesce(F.col(f"v{i}") > threshold, F.lit(False)).alias("kept"),
        )
        for i, c in enumerate(cols)
    ]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def variance_threshold(df: DataFrame, cols: Sequence[str], threshold: float = 0.0) -> DataFrame:
    """Drop columns whose sample variance is at most the threshold. Runs one aggregate to know which."""
    gone = [r["data_field_name"] for r in variance_report(df, cols, threshold).where(~F.col("kept")).collect()]
    return df.drop(*gone)


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``(a, b, corr)`` for all pairs of columns, from one scan."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    row = df.agg(
        *[F.corr(present(df, a).cast("double"), present(df, b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]
    )
    structs = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr")) for i, (a, b) in enumerate(pairs)]
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def uncorrelated_columns(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> list[str]:
    """Walk the columns in order and keep one unless it correlates too strongly with a kept one."""
    corr = {(r["a"], r["b"]): r["corr"] for r in correlation_pairs(df, list(cols)).collect()}
    kept: list[str] = []
    for c in cols:
        if all(abs(corr[(k, c)] or 0.0) <= threshold for k in kept):
            kept.append(c)
    return kept


def correlation_filtering(df: DataFrame, cols: Sequence[str], threshold: float = 0.95) -> DataFrame:
    """Drop the columns :func:`uncorrelated_columns` does not keep."""
    kept = set(uncorrelated_columns(df, cols, threshold))
    return df.drop(*[c for c in cols if c not in kept])
