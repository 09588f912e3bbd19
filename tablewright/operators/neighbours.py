"""Exact neighbour search on low-dimensional points by halved groups, without all-pairs joins."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import q
from ..functions.scale import stored

# What tasks run is sent with them, so executors need no copy of this module.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Points that a tile is meant to hold, and those of the sample that stand for as many.
TILE, SAMPLED = 1 << 15, 64

#: Rows of the sample by which large blocks are cut into tiles, at most; beyond, tiles grow.
SAMPLE_ROWS = 1 << 19

#: Queries and pairs of a query and a point that a task looks at together.
TOGETHER, PAIRS = 1 << 12, 1 << 20


def squared_distance(axes: Sequence[str], left: str = "", right: str = "_n_") -> Column:
    return reduce(
        lambda a, b: a + b,
        [(q(f"{left}{a}") - q(f"{right}{a}")) * (q(f"{left}{a}") - q(f"{right}{a}")) for a in axes],
    )


class Halves:
    """Trees that halve groups of points at a median of their widest axis, down to ``most`` points a leaf.

    Node ``g`` is the root of group ``g``. A node's points are ``order[start:stop]``; those below its ``cut`` on its
    ``axis`` are in ``left``. No leaf below a root holds fewer than ``least``.
    """

    def __init__(self, x: np.ndarray, groups: np.ndarray, n_groups: int, most: int, least: int) -> None:
        self.order = np.argsort(groups, kind="stable")
        ends = np.searchsorted(groups[self.order], np.arange(n_groups + 1))
        nodes = [[-1, 0.0, -1, -1, -1, int(s), int(e)] for s, e in zip(ends[:-1], ends[1:], strict=True)]
        todo = [i for i, n in enumerate(nodes) if n[6] - n[5] > most]
        while todo:
            node = nodes[at := todo.pop()]
            start, stop = node[5], node[6]
            own = self.order[start:stop]
            spread = x[own].max(0) - x[own].min(0)
            for axis in np.argsort(-spread, kind="stable").tolist():
                values = x[own, axis]
                cut = np.partition(values, len(values) // 2)[len(values) // 2]
                if not (values < cut).any():
                    above = values[values > cut]
                    cut = above.min() if len(above) else cut
                below = values < cut
                middle = start + int(below.sum())
                if min(middle - start, stop - middle) < max(1, least):
                    continue
                self.order[start:stop] = np.r_[own[below], own[~below]]
                node[:4] = axis, float(cut), len(nodes), len(nodes) + 1
                nodes += [[-1, 0.0, -1, -1, at, start, middle], [-1, 0.0, -1, -1, at, middle, stop]]
                todo += [i for i in (len(nodes) - 2, len(nodes) - 1) if nodes[i][6] - nodes[i][5] > most]
                break
        columns = list(zip(*nodes, strict=True)) or [()] * 7
        self.axis, self.left, self.right, self.parent, self.start, self.stop = (np.array(columns[i], np.int64) for i in (0, 2, 3, 4, 5, 6))
        self.cut = np.array(columns[1], float)

    def leaf(self, x: np.ndarray, root: np.ndarray) -> np.ndarray:
        """The leaf in which each point lies below its root."""
        node = root.copy()
        moving = np.flatnonzero(self.axis[node] >= 0)
        while len(moving):
            at = node[moving]
            node[moving] = np.where(x[moving, self.axis[at]] >= self.cut[at], self.right[at], self.left[at])
            moving = moving[self.axis[node[moving]] >= 0]
        return node

    def touched(self, x: np.ndarray, root: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of a point and a leaf below its root that may hold something within the point's radius."""
        who, at, wide = np.arange(len(x)), root, radius * (1 + 1e-9) + 1e-150  # more than rounding can lose
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(who):
            inner = self.axis[at] >= 0
            found.append((who[~inner], at[~inner]))
            who, at = who[inner], at[inner]
            gap = x[who, self.axis[at]] - self.cut[at]
            low, high = ~(gap > wide[who]), ~(-gap > wide[who])
            who, at = np.r_[who[low], who[high]], np.r_[self.left[at][low], self.right[at][high]]
        return np.concatenate([w for w, _ in found] or [who]), np.concatenate([a for _, a in found] or [at])

    def pairs(self, who: np.ndarray, node: np.ndarray):
        """Each of ``who`` with every point of its node, at most about ``PAIRS`` at a time."""
        sizes = self.stop[node] - self.start[node]
        parts = np.cumsum(sizes) // PAIRS
        for part in np.unique(parts):
            own = parts == part
            n, first = sizes[own], self.start[node[own]]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            yield np.repeat(who[own], n), self.order[np.repeat(first, n) + step]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.sqrt(reduce(np.add, [(x[:, i] - y[:, i]) * (x[:, i] - y[:, i]) for i in range(x.shape[1])]))


def _radius(tree: Halves, x: np.ndarray, root: np.ndarray, y: np.ndarray, other: Callable, k: int) -> np.ndarray:
    """For each query the distance of the k-th point among those near it, infinite if its root has fewer."""
    radius, node, unsure = np.full(len(x), np.inf), tree.leaf(x, root), np.arange(len(x))
    while len(unsure):
        for who, point in tree.pairs(unsure, node[unsure]):
            far = _apart(x[who], y[point])
            take = other(who, point) & ~np.isnan(far)
            who, far = who[take], far[take]
            order = np.lexsort((far, who))
            who, far = who[order], far[order]
            kth = np.flatnonzero(np.r_[True, who[1:] != who[:-1]][: len(who)]) + k - 1
            firsts = kth - k + 1
            kth, firsts = kth[kth < len(who)], firsts[kth < len(who)]
            kth = kth[who[kth] == who[firsts]]
            radius[who[kth]] = far[kth]
        unsure = unsure[np.isinf(radius[unsure]) & (tree.parent[node[unsure]] >= 0)]
        node[unsure] = tree.parent[node[unsure]]
    return radius


def _numbers(table: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.column_stack([table.column(n).to_numpy() for n in names])


def _search(dims: int, k: int, exclude_self: bool, carried: int, tiles: Halves | None):
    """For the queries and points of one tile: the pairs within each query's radius, and the other tiles this touches.

    A query that has no radius yet gets that of its k-th point here; one that came with its radius asks no further.
    """
    axes, told = [f"_x{i}" for i in range(dims)], ["_key", "_neighbour", "_distance", *[f"_c{i}" for i in range(carried)]]
    ask = ["_tile", "_root", "_radius", "_a", "_b", "_own", *axes]

    def run(queries: pa.Table, points: pa.Table) -> pa.Table:
        x, y = _numbers(queries, axes), _numbers(points, axes)
        sides = [_numbers(t, ["_a", "_b"]) for t in (queries, points)]
        blocks, of = np.unique(np.concatenate(sides), axis=0, return_inverse=True)
        of = of.ravel()
        tree = Halves(y, of[len(x) :], len(blocks), 4 * (k + 1) + 16, k + 1)
        own_q, own_p = queries.column("_own").to_numpy(), points.column("_own").to_numpy()
        home, told_radius = queries.column("_root").to_numpy(), queries.column("_radius").to_numpy(zero_copy_only=False) if len(x) else np.empty(0)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        asked: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for start in range(0, len(x), TOGETHER):
            rows = np.arange(start, min(start + TOGETHER, len(x)))
            mine, root = x[rows], of[rows]
            other = (lambda w, p: own_q[rows[w]] != own_p[p]) if exclude_self else (lambda w, p: np.ones(len(w), bool))
            radius = told_radius[rows].astype(float)
            fresh = np.flatnonzero(radius < 0)
            radius[fresh] = _radius(tree, mine[fresh], root[fresh], y, lambda w, p: other(fresh[w], p), k)
            for who, point in tree.pairs(*tree.touched(mine, root, radius)):
                far = _apart(mine[who], y[point])
                near = ~(far > radius[who])
                parts.append((rows[who[near]], point[near], far[near]))
            if tiles is not None:
                leaving = fresh[home[rows[fresh]] >= 0]
                who, tile = tiles.touched(mine[leaving], home[rows[leaving]], radius[leaving])
                who = leaving[who]
                out = tile != queries.column("_tile")[0].as_py()
                asked.append((rows[who[out]], tile[out], radius[who[out]]))
        who, point, far = (np.concatenate([p[i] for p in parts] or [np.empty(0, t)]) for i, t in enumerate((int, int, float)))
        ahead, tile, radius = (np.concatenate([p[i] for p in asked] or [np.empty(0, t)]) for i, t in enumerate((int, int, float)))
        here, there = len(who), len(ahead)
        key, name = queries.column("_key"), points.column("_key")
        both = lambda a, n, kind: pa.chunked_array([*a.chunks, pa.nulls(n, kind)], kind)
        after = lambda a, kind: pa.chunked_array([pa.nulls(here, kind), *(a.chunks if isinstance(a, pa.ChunkedArray) else [a])], kind)
        columns = [key.take(pa.array(np.r_[who, ahead])), both(name.take(pa.array(point)), there, name.type), both(pa.chunked_array([pa.array(far)]), there, pa.float64())]
        columns += [both((c := points.column(n)).take(pa.array(point)), there, c.type) for n in told[3:]]
        columns += [after(pa.array(tile), pa.int64()), after(pa.array(home[ahead]), pa.int64()), after(pa.array(radius), pa.float64())]
        columns += [after((c := queries.column(n)).take(pa.array(ahead)), c.type) for n in ask[3:]]
        return pa.table(columns, names=[*told, *ask])

    return run


def _meet(queries: DataFrame, points: DataFrame, search, schema: T.StructType) -> DataFrame:
    """The search in every tile; a tile with many queries is worked on in parts, each with all of the tile's points."""
    counts = queries.groupBy("_tile").agg(F.ceil(F.count("*") / TILE).alias("_parts")).where("_parts > 2").collect()
    queries, points = queries.withColumn("_part", F.lit(0).cast("long")), points.withColumn("_part", F.lit(0).cast("long"))
    if counts:
        parts = F.broadcast(queries.sparkSession.createDataFrame(counts, "_tile long, _parts long"))
        own = F.coalesce(F.pmod(F.xxhash64("_key", *[c for c in queries.columns if c.startswith("_x")]), F.col("_parts")), F.lit(0).cast("long"))
        queries = queries.join(parts, "_tile", "left").withColumn("_part", own).drop("_parts")
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_parts", F.lit(1).cast("long")) - 1))
        points = points.join(parts, "_tile", "left").withColumn("_part", every).drop("_parts")
    return queries.groupBy("_tile", "_part").cogroup(points.groupBy("_tile", "_part")).applyInArrow(search, schema)


def nearest(
    queries: DataFrame,
    points: DataFrame,
    axes: Sequence[str],
    k: int,
    key: str,
    carry: Sequence[str] = (),
    block: Sequence[str] = (),
    exclude_self: bool = False,
) -> DataFrame:
    """The k nearest points of every query, ties by ``key``: ``(key, neighbour, distance, rank, carried)``.

    Blocks of at most ``TILE`` points share tiles by hash; larger ones are halved into tiles at the medians of a sample,
    which decides only where points meet. Every query first meets the points of its own tile; the k-th of them bounds its
    search, so that only a query near a border goes on to the tiles this radius touches. Among points at the
    same spot only the k smallest keys can matter, so others are dropped early; a pile of equal points does no harm.
    So a row moves a fixed number of times, and candidates beyond a query's radius never leave their task.
    Queries whose block has fewer than k points get all of them. Blocks are compared by 128 bits of hash. Axes hold no nulls.
    """
    spark, xs, block = points.sparkSession, [f"_x{i}" for i in range(len(axes))], list(block)
    spread = [*[q(b) for b in block], *[q(b).isNull() for b in block]]
    sides = [F.xxhash64(*spread), F.xxhash64(F.lit(1), *spread)] if block else [F.lit(0).cast("long")] * 2
    placed = [sides[0].alias("_a"), sides[1].alias("_b"), *[q(a).cast("double").alias(x) for a, x in zip(axes, xs, strict=True)], q(key).alias("_key")]
    own = (F.xxhash64("_key") if exclude_self else F.lit(0).cast("long")).alias("_own")
    need = k + 1 if exclude_self else k
    # Only the first k (+1) keys at one spot can be neighbours: limited before the shuffle.
    spot = Window.partitionBy("_a", "_b", *xs).orderBy("_key")
    carried = [f"_c{i}" for i in range(len(carry))]
    points = points.select(*placed, *[q(c).alias(n) for c, n in zip(carry, carried, strict=True)])
    points = stored(points.withColumn("_rn", F.row_number().over(spot)).where(F.col("_rn") <= need).drop("_rn"))
    queries = queries.select(*placed)

    total = points.count()
    large = points.groupBy("_a", "_b").agg(F.count("*").alias("_n")).where(F.col("_n") > TILE).collect()
    buckets = max(1, -(-(total - sum(r["_n"] for r in large)) // TILE))
    shared = -1 - F.pmod(F.xxhash64("_a", "_b"), F.lit(buckets))
    tiles = None
    if large:
        roots = F.broadcast(spark.createDataFrame([(r["_a"], r["_b"], i) for i, r in enumerate(large)], "_a long, _b long, _root long"))
        points, queries = (d.join(roots, ["_a", "_b"], "left").withColumn("_root", F.coalesce("_root", F.lit(-1).cast("long"))) for d in (points, queries))
        sample = points.where("_root >= 0").select("_root", *xs).sample(min(SAMPLED / TILE, SAMPLE_ROWS / total), 42).toPandas()
        tiles = Halves(sample[xs].to_numpy(float), sample["_root"].to_numpy(np.int64), len(large), SAMPLED, SAMPLED // 8)
        tiles.order = np.empty(0, np.int64)

        @F.pandas_udf("long")
        def tile(root, *values):
            import pandas as pd

            at, x = root.to_numpy(np.int64, copy=True), np.column_stack([v.to_numpy(float) for v in values])
            at[at >= 0] = tiles.leaf(x[at >= 0], at[at >= 0])
            return pd.Series(at)

        of = F.when(F.col("_root") < 0, shared).otherwise(tile("_root", *xs))
    else:
        points, queries = (d.withColumn("_root", F.lit(-1).cast("long")) for d in (points, queries))
        of = shared
    points = points.select(of.alias("_tile"), "_a", "_b", own, *xs, "_key", *carried)
    queries = queries.select(of.alias("_tile"), "_root", F.lit(-1.0).alias("_radius"), "_a", "_b", own, *xs, "_key")

    kinds = {f.name: f.dataType for f in points.schema.fields}
    names = {"_key": queries.schema["_key"].dataType, "_neighbour": kinds["_key"], "_distance": T.DoubleType(), **{c: kinds[c] for c in carried}}
    asks = {n: T.LongType() for n in ("_tile", "_root")} | {"_radius": T.DoubleType()} | {n: T.LongType() for n in ("_a", "_b", "_own")} | {x: T.DoubleType() for x in xs}
    schema = T.StructType([T.StructField(n, t) for n, t in (names | asks).items()])
    search = lambda others: _search(len(xs), k, exclude_self, len(carried), others)
    found = _meet(queries, points, search(tiles), schema)
    if tiles is not None:
        found = stored(found)
        more = found.where("_tile is not null").select(*asks, "_key")
        found = found.where("_tile is null").select(*names).union(_meet(more, points, search(None), schema).select(*names))
    pairs = found.select(*names)
    if exclude_self:
        pairs = pairs.where(~(F.col("_key") == F.col("_neighbour")))
    ranked = pairs.withColumn("_rank", F.row_number().over(Window.partitionBy("_key").orderBy("_distance", "_neighbour")))
    out = [F.col("_key").alias(key), F.col("_neighbour").alias("neighbour"), F.col("_distance").alias("distance"), F.col("_rank").alias("rank")]
    return ranked.where(F.col("_rank") <= k).select(*out, *[F.col(n).alias(c) for c, n in zip(carry, carried, strict=True)])
