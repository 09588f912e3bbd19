"""Exact top-k search by inner product with a KD-tree for each shard."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import checkpointed

#: Vectors of a shard, vectors of a leaf, queries that visit a shard together; all are mean or most numbers.
SHARD_ROWS, LEAF_ROWS, QUERY_ROWS = 8192, 256, 16384

_BLOB_DDL = "dim int, part int, parts int, ids binary, matrix binary, bounds binary, nodes binary, boxes binary"
_BLOB = pa.schema([("dim", pa.int32()), ("part", pa.int32()), ("parts", pa.int32()), *((n, pa.binary()) for n in ("ids", "matrix", "bounds", "nodes", "boxes"))])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


@dataclass
class Tree:
    """Rows in leaf order; nodes as (first row, end, left child, right child), children of a leaf -1; tight boxes."""

    ids: np.ndarray
    rows: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray


def build(ids: np.ndarray, rows: np.ndarray, leaf_rows: int = LEAF_ROWS) -> Tree:
    """Split at the median of the widest dimension until a node has at most ``leaf_rows`` rows.

    A node whose rows are all equal is a leaf whatever its size.
    """
    order, nodes, low, high = np.arange(len(ids)), [], [], []
    waiting = [(0, len(ids), -1, 0)]
    while waiting:
        start, end, parent, side = waiting.pop()
        own = rows[order[start:end]]
        at = len(nodes)
        if parent >= 0:
            nodes[parent][2 + side] = at
        nodes.append([start, end, -1, -1])
        low.append(own.min(axis=0))
        high.append(own.max(axis=0))
        width = high[-1] - low[-1]
        if end - start > leaf_rows and width.size and width.max() > 0:
            middle = (end - start) // 2
            order[start:end] = order[start:end][np.argpartition(own[:, int(width.argmax())], middle)]
            waiting += [(start, start + middle, at, 0), (start + middle, end, at, 1)]
    return Tree(ids[order], rows[order], np.array(nodes, np.int64), np.array(low), np.array(high))


def _exact(a: np.ndarray, b: np.ndarray) -> type:
    """The type in which sums of products of rows of ``a`` and ``b``, and of two such sums, are exact."""
    if _floats(a, b):
        return np.float64
    most = [max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) for x in (a, b)]
    return np.int64 if most[0] * most[1] * max(1, a.shape[1]) < 2**62 else object


def _floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether inner products of rows of ``a`` and ``b`` are exact as floating-point numbers."""
    return float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2**53


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` of integers: as floating-point numbers, longs or Python's integers, whichever is exact."""
    kind = _exact(a, b)
    return a.astype(kind) @ b.T.astype(kind)


def search(tree: Tree, query_ids: np.ndarray, queries: np.ndarray, bounds: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query, vector, score) of each query's ``k`` best rows of the tree that can still reach its ``bounds``.

    Best first: the node with the largest possible score is opened next. A node can reach at most the sum,
    over the dimensions, of the larger product of the query with its box's sides. The search ends when that
    is below the k-th score so far, where ``bounds`` is the k-th score found elsewhere.
    """
    positive, negative = np.maximum(queries, 0), np.minimum(queries, 0)
    reach = _product(positive, tree.high) + _product(negative, tree.low)
    children = tree.nodes.tolist()
    rows = tree.rows.astype(_exact(queries, tree.rows))
    wanted = queries.astype(rows.dtype)
    out = []
    for q, own in enumerate(query_ids.tolist()):
        best: list[tuple[int, int]] = []  # (score, -vec_id), the worst first
        kth, mine, limit = int(bounds[q]), wanted[q], reach[q]
        heap = [(-limit[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < kth:
                break
            start, end, left, right = children[node]
            if left >= 0:
                for child in (left, right):
                    if limit[child] >= kth:
                        heapq.heappush(heap, (-limit[child], child))
                continue
            scores = rows[start:end] @ mine
            for i in np.flatnonzero((scores >= kth).astype(bool)):
                vec_id = int(tree.ids[start + i])
                if vec_id == own:
                    continue
                entry = (int(scores[i]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
                if len(best) == k:
                    kth = max(kth, best[0][0])
        out += [(own, -minus, score) for score, minus in best]
    return out


def _matrix(table: pa.Table) -> np.ndarray:
    flat = table.column("vector").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def _blob(dim: int, part: int, parts: int, tree: Tree | None, ids: np.ndarray, rows: np.ndarray, bounds: np.ndarray) -> pa.Table:
    nodes = tree.nodes.tobytes() if tree else b""
    boxes = np.stack([tree.low, tree.high]).tobytes() if tree else b""
    return pa.table([[dim], [part], [parts], [ids.tobytes()], [rows.tobytes()], [bounds.tobytes()], [nodes], [boxes]], schema=_BLOB)


def _shard(leaf_rows: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim, part, parts = (x.as_py() for x in key)
        tree = build(table.column("vec_id").to_numpy(), _matrix(table), leaf_rows)
        return _blob(dim, part, parts, tree, tree.ids, tree.rows, np.empty(0, np.int64))

    return run


def _block(key: tuple, table: pa.Table) -> pa.Table:
    dim, part, parts = (x.as_py() for x in key)
    return _blob(dim, part, parts, None, table.column("vec_id").to_numpy(), _matrix(table), table.column("bound").to_numpy())


def _visit(k: int):
    def run(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        out = []
        for s in shards.to_pylist():
            dim = s["dim"]
            low, high = np.frombuffer(s["boxes"], np.int64).reshape(2, -1, dim)
            tree = Tree(np.frombuffer(s["ids"], np.int64), np.frombuffer(s["matrix"], np.int64).reshape(-1, dim), np.frombuffer(s["nodes"], np.int64).reshape(-1, 4), low, high)
            for b in blocks.to_pylist():
                ids = np.frombuffer(b["ids"], np.int64)
                out += search(tree, ids, np.frombuffer(b["matrix"], np.int64).reshape(-1, dim), np.frombuffer(b["bounds"], np.int64), k)
        columns = zip(*out, strict=True) if out else ((), (), ())
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=_FOUND)

    return run


def _parted(vectors: DataFrame, rows: int, salt: int) -> DataFrame:
    """Rows of each dimension dealt evenly into parts of about ``rows``."""
    parts = vectors.groupBy("dim").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts"))
    return vectors.join(parts, "dim").withColumn("part", F.pmod(F.xxhash64("row", F.lit(salt)), F.col("parts")).cast("int"))


def whole_vector(column: str, scale: float) -> Column:
    """floor(scale * x) of each component x, as long; null if the vector or a component is null, infinite or no number."""
    v = F.transform(column, lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    far = F.exists(v, lambda x: F.abs(x * scale) >= float(1 << 63))
    told = F.when(far, F.raise_error(F.lit("a scaled component does not fit into a long")).cast("array<bigint>"))
    return F.when(good & (F.size(v) > 0), told.otherwise(F.transform(v, lambda x: F.floor(x * scale).cast("long"))))


def top_k(
    df: DataFrame,
    is_query: Column,
    k: int,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: float = 256.0,
    shard_rows: int = SHARD_ROWS,
    leaf_rows: int = LEAF_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """Each query's ``k`` rows of largest inner product with it, of all rows but its own.

    Returns ``query_id, rank, vec_id, score``; of equal scores the smaller ``vec_id`` comes first. Components
    are floor(scale * x), so scores are exact integers. ``is_query`` is a condition on ``vec_id``.

    Vectors are dealt by a hash into shards with a KD-tree each, queries into blocks. A block first visits
    one shard, then takes the k-th scores found there along to the other shards. Only packed shards and
    blocks are joined, by equal keys; a task holds one shard and one block, both of bounded size.

    Rows with a null identifier, or whose vector is null, empty or holds a null, an infinity or a NaN, take
    no part. Vectors meet only vectors of their own length. Rows that repeat an identifier all take part: each is a
    candidate of its own, and as queries they share the ``k`` best pairs. Scores are exact; a scaled component or a
    score among the best that does not fit into a long is an error. Fewer than ``k`` other rows give all of them; an empty table gives no rows.
    """
    named = df.select(F.col(id_col).cast("long").alias("vec_id"), whole_vector(vector_col, scale).alias("vector")).where("vec_id is not null and vector is not null")
    vectors = checkpointed(named.withColumns({"dim": F.size("vector"), "row": F.monotonically_increasing_id()}))
    key = ["dim", "part", "parts"]
    shards = checkpointed(_parted(vectors, shard_rows, 0).groupBy(*key).applyInArrow(_shard(leaf_rows), _BLOB_DDL))
    queries = _parted(vectors.where(is_query), query_rows, 1)
    sizes = shards.groupBy("dim").agg(F.max("parts").alias("shards"))
    counts = queries.groupBy("dim").agg(F.max("parts").alias("blocks"))

    def visits(bounded: DataFrame, home: bool) -> DataFrame:
        blocks = bounded.groupBy(*key).applyInArrow(_block, _BLOB_DDL).withColumnRenamed("part", "block")
        dealt = blocks.join(sizes, "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        at_home = F.col("shard") == F.pmod("block", "shards")
        dealt = dealt.where(at_home if home else ~at_home).drop("shards")
        open_shards = shards.withColumnRenamed("part", "shard").join(counts, "dim").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        open_shards = open_shards.where((F.col("shard") == F.pmod("block", "parts")) if home else (F.col("shard") != F.pmod("block", "parts"))).drop("blocks")
        by = ["dim", "shard", "block"]
        return open_shards.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInArrow(_visit(k), "query_id long, vec_id long, score long")

    lowest = F.lit(-(1 << 63)).cast("long")
    first = checkpointed(visits(queries.withColumn("bound", lowest), True))
    kth = first.groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).where(F.col("n") == k)
    bounded = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left").select(*key, "vec_id", "vector", F.coalesce("kth", lowest).alias("bound"))
    found = first.union(visits(bounded, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
