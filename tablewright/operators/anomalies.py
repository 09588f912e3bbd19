"""Outliers among points: isolation forest, local outlier factor, density noise."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, join_on, q, unit_hash
from ..functions.scale import stored
from .neighbours import nearest, squared_distance
from .reduce import _with_features


def _average_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n points (Liu et al., 2008)."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    deep = 2 * (np.log(safe - 1) + 0.5772156649015329) - 2 * (safe - 1) / safe
    return np.where(n > 2, deep, np.where(n == 2, 1.0, 0.0))


def _grow(x: np.ndarray, limit: int, rng: np.random.Generator) -> list[tuple[int, float, int, int, float]]:
    """One tree as rows (feature, split, left, right, leaf depth); feature -1 marks a leaf."""
    nodes: list[list] = []
    stack = [(np.arange(len(x)), 0, -1, 0)]
    while stack:
        rows, depth, parent, side = stack.pop()
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        part = x[rows]
        low, high = (part.min(axis=0), part.max(axis=0)) if len(rows) else (None, None)
        live = np.flatnonzero(high > low) if len(rows) > 1 else []
        if depth >= limit or len(live) == 0:
            nodes.append([-1, 0.0, -1, -1, depth + float(_average_path(len(rows)))])
            continue
        f = int(rng.choice(live))
        split = float(rng.uniform(low[f], high[f]))
        nodes.append([f, split, -1, -1, 0.0])
        below = part[:, f] < split
        stack.append((rows[below], depth + 1, at, 0))
        stack.append((rows[~below], depth + 1, at, 1))
    return [tuple(n) for n in nodes]


def isolation_forest_detection(
    df: DataFrame, features: Sequence[str] | str, key: Sequence[str] | str, trees: int = 100, sample: int = 256, seed: int = 42
) -> DataFrame:
    """Add ``anomaly_score`` = 2^(-mean depth / c(sample)); null for rows with a missing feature.

    Rows are given to trees by hash, about ``sample`` each, so every tree grows in one small
    group. The forest (trees by at most twice the sample of nodes) goes to all tasks, which
    score Arrow batches.
    """
    every_row = _with_features(df, features)
    rows = every_row.where("_x is not null")
    n = rows.count()
    if n == 0:
        return every_row.drop("_x").withColumn("anomaly_score", F.lit(None).cast("double"))
    sample = min(sample, n)
    per_row = trees * sample / n
    copies = max(1, math.ceil(per_row))
    keys = as_list(key)
    dealt = rows.select(*keys, "_x", F.explode(F.sequence(F.lit(1), F.lit(copies))).alias("_copy"))
    dealt = dealt.where(unit_hash([*keys, "_copy"], "pick", seed) < per_row / copies)
    dealt = dealt.select("_x", F.floor(unit_hash([*keys, "_copy"], "tree", seed) * trees).cast("int").alias("tree"))
    limit = max(1, math.ceil(math.log2(max(sample, 2))))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf["_x"].to_numpy()).astype(float)
        x = x[np.lexsort(x.T)]
        nodes = _grow(x, limit, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=["feature", "split", "left", "right", "depth"])
        return out.assign(tree=tree, node=np.arange(len(out)))

    schema = "feature int, split double, left int, right int, depth double, tree int, node int"
    forest = dealt.groupBy("tree").applyInPandas(build, schema).toPandas().sort_values(["tree", "node"])
    packed = [g[["feature", "split", "left", "right", "depth"]].to_numpy() for _, g in forest.groupby("tree")]
    scale = float(_average_path(sample)) or 1.0

    @F.pandas_udf("double")
    def score(x: pd.Series) -> pd.Series:
        known = x.notna()
        if not known.all():
            out = pd.Series(np.nan, index=x.index).astype(object).where(known, None)
            if known.any():
                out[known] = judged(x[known])
            return out
        return judged(x)

    def judged(x: pd.Series) -> pd.Series:
        points = np.stack(x.to_numpy()).astype(float)
        total = np.zeros(len(points))
        every = np.arange(len(points))
        for t in packed:
            at = np.zeros(len(points), dtype=int)
            inner = t[:, 0] >= 0
            moving = every[inner[at]]
            while len(moving):
                node = at[moving]
                below = points[moving, t[node, 0].astype(int)] < t[node, 1]
                at[moving] = np.where(below, t[node, 2], t[node, 3]).astype(int)
                moving = moving[inner[at[moving]]]
            total += t[at, 4]
        return pd.Series(2.0 ** (-total / len(packed) / scale), index=x.index)

    return every_row.withColumn("anomaly_score", score("_x")).drop("_x")


def local_outlier_factor(
    df: DataFrame, axes: Sequence[str], key: str, k: int = 5, block: Sequence[str] | str | None = None
) -> DataFrame:
    """``(key, lof)`` by Breunig et al. (2000), with exactly k neighbours each (ties by key), in blocks if given."""
    blocks = as_list(block)
    points = df.select(q(key).alias("_key"), *blocks, *[q(a).cast("double").alias(a) for a in axes]).dropna()
    near = nearest(points, points, list(axes), k, key="_key", block=blocks, exclude_self=True)
    # The neighbour table is read three times below; finding it is the costly part.
    near = stored(near.select("_key", "neighbour", "distance"))
    radius = near.groupBy("_key").agg(F.max("distance").alias("kdist"))
    reach = near.join(radius.select(F.col("_key").alias("neighbour"), "kdist"), "neighbour").withColumn(
        "reach", F.greatest("distance", "kdist")
    )
    density = reach.groupBy("_key").agg((F.lit(1.0) / F.greatest(F.avg("reach"), F.lit(1e-300))).alias("lrd"))
    others = near.join(density.select(F.col("_key").alias("neighbour"), F.col("lrd").alias("n_lrd")), "neighbour")
    lof = others.groupBy("_key").agg(F.avg("n_lrd").alias("m")).join(density, "_key")
    return lof.select(F.col("_key").alias(key), (F.col("m") / F.col("lrd")).alias("lof"))


def dbscan_noise(df: DataFrame, axes: Sequence[str], key: str, eps: float, min_pts: int) -> DataFrame:
    """Keys of the points DBSCAN calls noise: not core (``min_pts`` points within eps, itself included)
    and not within eps of a core point.

    Cells are so small that points of one cell are always within eps. A cell with ``min_pts``
    points is all core and is never compared with itself; only points of thinner cells
    measure distances, to the few cells around them. A crowded cell is thus met by a bounded
    number of points.
    """
    dims = len(axes)
    side = eps / math.sqrt(dims) * (1 - 1e-12)
    reach = math.ceil(math.sqrt(dims)) + 1
    points = df.select(q(key).alias("_key"), *[q(a).cast("double").alias(a) for a in axes]).dropna()
    points = points.withColumn("_cell", F.array(*[F.floor(q(a) / side).cast("bigint") for a in axes]))
    sizes = points.groupBy("_cell").agg(F.count("*").alias("_n"))
    placed = points.join(sizes, "_cell")
    thin = placed.where(F.col("_n") < min_pts)
    offsets = [o for o in product(range(-reach, reach + 1), repeat=dims)]
    steps = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in o]) for o in offsets])
    around = thin.select(
        "_key", *axes, F.explode(F.transform(steps, lambda o: F.zip_with("_cell", o, lambda a, b: a + b))).alias("_cell")
    )
    within = squared_distance(axes) <= F.lit(eps * eps)
    named = points.select("_cell", *[q(a).alias(f"_n_{a}") for a in axes])
    counts = around.join(named, "_cell").where(within).groupBy("_key").agg(F.count("*").alias("_near"))
    thin_core = counts.where(F.col("_near") >= min_pts).select("_key")
    core = placed.where(F.col("_n") >= min_pts).select("_key", "_cell", *axes).unionByName(
        thin.join(thin_core, "_key", "left_semi").select("_key", "_cell", *axes)
    )
    lonely = thin.join(thin_core, "_key", "left_anti")
    core_named = core.select("_cell", *[q(a).alias(f"_n_{a}") for a in axes])
    near_core = (
        around.join(lonely.select("_key"), "_key", "left_semi").join(core_named, "_cell").where(within).select("_key").distinct()
    )
    return lonely.join(near_core, "_key", "left_anti").select(F.col("_key").alias(key))


def dbscan_outlier_removal(df: DataFrame, axes: Sequence[str], key: str, eps: float, min_pts: int, action: str = "drop") -> DataFrame:
    """Drop the noise, or ``flag`` it in ``is_noise``."""
    noise = dbscan_noise(df, axes, key, eps, min_pts)
    if action == "drop":
        return df.join(noise, key, "left_anti")
    return df.join(noise.withColumn("_noise", F.lit(True)), key, "left").withColumn(
        "is_noise", F.coalesce("_noise", F.lit(False))
    ).drop("_noise")
