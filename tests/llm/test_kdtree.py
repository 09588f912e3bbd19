import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm.kdtree import build, search, top_k


def brute(rows, k, scale=256):
    good = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v and not any(x is None or not math.isfinite(x) for x in v)]
    out = []
    for q in {i for i, _ in good if i % 50 == 0}:
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for i, a in good if i == q for c, b in good if c != q and len(a) == len(b))
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_equals_brute_force_over_many_shards(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(600)]
    rows += [(600 + i, rows[i % 7][1]) for i in range(60)]  # ties
    rows += [(900, [float("nan")] * 6), (950, None), (1000, []), (1001, [1.0, None]), (None, [1.0] * 6), (1050, [math.inf] * 6), (1100, [0.5, 0.25]), (1101, [0.5, 0.5]), (1102, [-0.001, 0.5]), (50, [9.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("dim", F.lit("x")).withColumn("part", F.lit(1))
    got = top_k(df, F.col("vec_id") % 50 == 0, 5, shard_rows=100, leaf_rows=8, query_rows=4)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 5)
    assert top_k(df.where("false"), F.col("vec_id") % 50 == 0, 5).count() == 0


def test_large_numbers_stay_exact(spark):
    rows = [(0, [3e9, 1.0]), (1, [2e7, 1.0]), (2, [2e7, 2.0]), (3, [-2e7, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert {tuple(r) for r in top_k(df, F.col("vec_id") == 0, 2, scale=1.0).collect()} == {(0, 1, 2, 60000000000000002), (0, 2, 1, 60000000000000001)}


def test_products_beyond_longs_and_repeated_rows(spark):
    ddl = "vec_id long, embedding array<double>"
    rows = [(0, [1e18, -1.0]), (1, [-1e18, 1.0]), (2, [9.0, 2.0]), (2, [9.0, 2.0]), (3, [-9.0, 1e17]), (50, [1.0, 1.0]), (50, [2.0, -1.0])]
    got = top_k(spark.createDataFrame(rows, ddl), F.col("vec_id") % 50 == 0, 3, scale=1.0, shard_rows=2, leaf_rows=1)
    # scores beyond a long are among the worst here
    assert sorted(map(tuple, got.collect())) == brute(rows, 3, 1)
    with pytest.raises(Exception):
        top_k(spark.createDataFrame([(0, [1e18]), (1, [1e18])], ddl), F.col("vec_id") == 0, 1, scale=1.0).collect()
    with pytest.raises(Exception):
        top_k(spark.createDataFrame([(0, [1e300]), (1, [1.0])], ddl), F.col("vec_id") == 0, 1).collect()


def test_boxes_are_tight_and_the_bound_prunes():
    rng = np.random.default_rng(5)
    rows = rng.integers(-100, 100, (500, 3))
    tree = build(np.arange(500), rows, 16)
    for (start, end, left, _), low, high in zip(tree.nodes, tree.low, tree.high, strict=True):
        assert (tree.rows[start:end].min(axis=0) == low).all() and (tree.rows[start:end].max(axis=0) == high).all()
        assert left >= 0 or end - start <= 16
    q = np.array([[50, -20, 3]])
    best = sorted(rows @ q[0])[-3:]
    assert sorted(s for _, _, s in search(tree, np.array([-1]), q, np.array([-(1 << 62)]), 3)) == best
    assert search(tree, np.array([-1]), q, np.array([best[-1] + 1]), 3) == []
