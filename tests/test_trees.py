"""The exact tree on one feature against a plain search."""

import random

from tablewright.operators.bins import decision_tree_binning, exact_thresholds


def plain(rows, depth):
    if depth == 0:
        return []
    best = None
    n, s = len(rows), sum(y for _, y in rows)
    values = sorted({x for x, _ in rows})
    for low, high in zip(values, values[1:]):
        left = [y for x, y in rows if x <= low]
        drop = sum(left) ** 2 / len(left) + (s - sum(left)) ** 2 / (n - len(left)) - s * s / n
        if drop > 0 and (best is None or drop > best[0]):
            best = (drop, low + (high - low) / 2)
    if best is None:
        return []
    cut = best[1]
    return sorted([cut, *plain([r for r in rows if r[0] <= cut], depth - 1), *plain([r for r in rows if r[0] > cut], depth - 1)])


def test_exact_splits(spark):
    rng = random.Random(2)
    # a third of the rows share one value
    rows = [(7.0 if i % 3 == 0 else float(rng.randint(0, 40)), float(rng.randint(0, 3) + (i % 5 == 0))) for i in range(400)]
    df = spark.createDataFrame([*rows, (None, 1.0), (float("nan"), 2.0), (3.0, None)], "x double, y double")
    for depth in (1, 2):
        assert exact_thresholds(df, "x", "y", depth) == plain(rows, depth)
    flat = spark.createDataFrame([(float(i), 1.0) for i in range(5)], "x double, y double")
    assert exact_thresholds(flat, "x", "y") == [] and exact_thresholds(flat.limit(0), "x", "y") == []
    assert {r.x_bin for r in decision_tree_binning(flat, "x", "y", max_bins=None).collect()} == {0}
