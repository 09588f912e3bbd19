"""Numbers to bins, numbered from 0. Bins are closed on the left; the last one on both sides."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, join_on, present, q, with_stats
from ..functions.ordered import row_numbers, running_totals
from ..functions.quantiles import quantile_table
from ..functions.scale import checkpointed


def _x(df: DataFrame, c: str) -> Column:
    return present(df, c).cast("double")


def _count_at_most(edges: Sequence[Column], x: Column) -> Column:
    total = F.lit(0)
    for e in edges:
        total = total + (x >= e).cast("int")
    return F.when(x.isNotNull(), total)


def equal_width_binning(df: DataFrame, col: str, k: int, name: str | None = None) -> DataFrame:
    x = _x(df, col)
    s = with_stats(df, df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")), "_s")
    span = F.col("_s.hi") - F.col("_s.lo")
    pos = F.floor((x - F.col("_s.lo")) / F.nullif(span, F.lit(0.0)) * k)
    bin_ = F.when(x.isNotNull(), F.least(F.lit(k - 1), F.coalesce(pos, F.lit(0)))).cast("int")
    return s.withColumn(name or f"{col}_bin", bin_).drop("_s")


def equal_frequency_binning(
    df: DataFrame, col: str, k: int, key: Sequence[str] | str, partition_by: Sequence[str] | str | None = None,
    name: str | None = None,
) -> DataFrame:
    """Bins of equal row counts in the order of (value, key), as ``ntile`` makes them. Nulls get no bin."""
    keys = as_list(partition_by)
    known = df.where(_x(df, col).isNotNull())
    ranked = row_numbers(known, keys, [col, *as_list(key)], "_rn")
    sizes = known.groupBy(*keys).agg(F.count("*").alias("_n"))
    ranked = join_on(ranked, sizes, keys) if keys else with_stats(ranked, sizes, "_s").withColumn("_n", F.col("_s._n")).drop("_s")
    base, extra = F.floor(F.col("_n") / k), F.col("_n") % k
    rn = F.col("_rn") - 1
    in_big = rn < extra * (base + 1)
    small = F.when(base > 0, F.floor((rn - extra * (base + 1)) / F.nullif(base, F.lit(0))))
    bin_ = F.when(in_big, F.floor(rn / (base + 1))).otherwise(extra + small).cast("int")
    binned = ranked.withColumn(name or f"{col}_bin", bin_).drop("_rn", "_n")
    rest = df.where(_x(df, col).isNull()).withColumn(name or f"{col}_bin", F.lit(None).cast("int"))
    return binned.unionByName(rest)


def quantile_binning(df: DataFrame, col: str, probs: Sequence[float], name: str | None = None) -> DataFrame:
    """Inner edges at the given quantiles; the bin is the number of edges at or below the value."""
    s = with_stats(df, quantile_table(df, {col: list(probs)}), "_s")
    edges = [F.col("_s").getField(col)[i] for i in range(len(probs))]
    return s.withColumn(name or f"{col}_bin", _count_at_most(edges, _x(df, col))).drop("_s")


def kmeans_binning(df: DataFrame, col: str, k: int, iters: int = 10, name: str | None = None) -> DataFrame:
    """Bins around k one-dimensional means: quantile start, fixed rounds, edges midway between means.

    Each round is one scan with map-side combine; k means reach the driver.
    """
    x = _x(df, col)
    centres = quantile_table(df, {col: [(i + 0.5) / k for i in range(k)]}).first()[col]
    if centres is None:
        return df.withColumn(name or f"{col}_bin", F.lit(None).cast("int"))
    for _ in range(iters):
        edges = [F.lit((a + b) / 2) for a, b in zip(centres, centres[1:])]
        rows = df.where(x.isNotNull()).groupBy(_count_at_most(edges, x).alias("b")).agg(F.avg(x).alias("m")).collect()
        new = {r["b"]: r["m"] for r in rows}
        moved = sorted(new.get(i, c) for i, c in enumerate(centres))
        if moved == centres:
            break
        centres = moved
    edges = [F.lit((a + b) / 2) for a, b in zip(centres, centres[1:])]
    return df.withColumn(name or f"{col}_bin", _count_at_most(edges, x))


def tree_thresholds(df: DataFrame, col: str, target: str, depth: int = 2, classify: bool = False, max_bins: int = 256) -> list[float]:
    """Split points of a decision tree on one feature."""
    rows = df.select(_x(df, col).alias("x"), present(df, target).cast("double").alias("y")).dropna()
    ready = VectorAssembler(inputCols=["x"], outputCol="f").transform(rows)
    kind = DecisionTreeClassifier if classify else DecisionTreeRegressor
    model = kind(featuresCol="f", labelCol="y", maxDepth=depth, maxBins=max_bins, seed=42).fit(ready)
    return sorted({float(t) for t in re.findall(r"feature 0 <= ([-+0-9.Ee]+)", model.toDebugString)})


def exact_thresholds(df: DataFrame, col: str, target: str, depth: int = 2) -> list[float]:
    """Split points of a least-squares tree on one feature that tries every distinct value.

    Rows are folded by value first. Running counts and sums along the values give the squared error of every split at
    once, for all nodes of a level together; the largest drop wins, ties go to the smallest split, and a node that no
    split improves stays whole. A split lies midway between two values. For a target of 0 and 1 this is the Gini tree.
    At most ``2 ** depth`` splits reach the driver, by one job a level. Rows where either is missing take no part.
    """
    known = df.select(_x(df, col).alias("x"), present(df, target).cast("double").alias("y")).dropna()
    values = checkpointed(known.groupBy("x").agg(F.count("*").cast("double").alias("n"), F.sum("y").alias("s")))
    cuts: list[float] = []
    for _ in range(depth):
        node = _count_above([F.lit(c) for c in cuts], F.col("x"))
        placed = values.withColumn("node", node)
        walked = running_totals(placed, "node", ["x"], {"nl": F.col("n"), "sl": F.col("s")})
        whole = placed.groupBy("node").agg(F.sum("n").alias("nt"), F.sum("s").alias("st"))
        right_n, right_s = F.col("nt") - F.col("nl"), F.col("st") - F.col("sl")
        drop = F.col("sl") * F.col("sl") / F.col("nl") + right_s * right_s / right_n - F.col("st") * F.col("st") / F.col("nt")
        split = join_on(walked, whole, ["node"]).where(right_n > 0).withColumn("drop", drop).where("drop > 0")
        best = split.groupBy("node").agg(F.min(F.struct((-F.col("drop")).alias("neg"), F.col("x").alias("low"))).alias("b"))
        above = join_on(placed, best, ["node"], "inner").where(F.col("x") > F.col("b.low")).groupBy("node")
        found = above.agg(F.first("b.low").alias("low"), F.min("x").alias("high")).collect()
        if not found:
            break
        cuts = sorted({*cuts, *[r["low"] + (r["high"] - r["low"]) / 2 for r in found]})
    return cuts


def _count_above(edges: Sequence[Column], x: Column) -> Column:
    total = F.lit(0)
    for e in edges:
        total = total + (x > e).cast("int")
    return total


def decision_tree_binning(
    df: DataFrame, col: str, target: str, depth: int = 2, classify: bool = False, name: str | None = None,
    max_bins: int | None = 256,
) -> DataFrame:
    """Bins between the split points of a tree that tries ``max_bins`` candidates, or every value where that is None
    (not for classes other than 0 and 1). As in the tree, a value equal to a split belongs below it."""
    x = _x(df, col)
    if max_bins is None:
        cuts = exact_thresholds(df, col, target, depth)
    else:
        cuts = tree_thresholds(df, col, target, depth, classify, max_bins)
    return df.withColumn(name or f"{col}_bin", F.when(x.isNotNull(), _count_above([F.lit(c) for c in cuts], x)))


def custom_threshold_binning(
    df: DataFrame, col: str, edges: Sequence[float], labels: Sequence[str] | None = None, name: str | None = None
) -> DataFrame:
    """Bins between given cut points; values outside are null."""
    x = _x(df, col)
    bins = len(edges) - 1
    if labels is not None and len(labels) != bins:
        raise ValueError(f"{bins} bins need {bins} labels")
    out = F.lit(None).cast("string" if labels is not None else "int")
    for i in reversed(range(bins)):
        low, high = F.lit(float(edges[i])), F.lit(float(edges[i + 1]))
        inside = (x >= low) & ((x <= high) if i == bins - 1 else (x < high))
        out = F.when(inside, F.lit(labels[i]) if labels is not None else F.lit(i)).otherwise(out)
    return df.withColumn(name or f"{col}_bin", out)
