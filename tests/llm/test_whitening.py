import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import queries
from tablewright.llm.whitening import Spectrum, components, feast, intervals, whitened


def brute(rows):
    """{vec_id: [(n, deviation), ...]}, eigenvalues, vectors, centred rows, by a dense eigensolver and Python integers."""
    rows = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    z = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    covariance = z.T @ z / n
    values, vectors = np.linalg.eigh(covariance)
    dev = [(i, sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True))) for i, v in x]
    own = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for _, v in x])
    return n, dev, values[::-1], vectors[:, ::-1], own, np.trace(covariance)


def check(df, rows, k=16, close=1e-6):
    n, dev, values, vectors, own, trace = brute(rows)
    got = df.collect()
    real = int((values > values[0] * 1e-10).sum())
    k = min(k, real)
    assert len(got) == len(dev) * k
    assert {r.n for r in got} == {n}
    assert sorted((r.vec_id is None, r.vec_id or 0, r.deviation) for r in got if r.component == 1) == sorted((i is None, i or 0, d) for i, d in dev)
    assert all(r.identity_error < 1e-4 for r in got) and len({r.identity_error for r in got}) == 1
    for c in range(k):
        mine = [r for r in got if r.component == c + 1]
        assert all(abs(r.explained * trace / values[c] - 1) < 1e-8 for r in mine)
        alone = all(abs(values[c] - v) > 1e-6 * values[0] for i, v in enumerate(values) if i != c)
        if alone:
            want = np.sort(np.abs(own @ vectors[:, c] / math.sqrt(values[c])))
            assert np.allclose(np.sort(np.abs([r.whitened for r in mine])), want, atol=close, rtol=1e-6)
    return got


def test_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = check(queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.01"), rows)
    assert queries.QUERIES["op12_whitening"](spark, "/root/testdata/sf0.01").columns[:7] == list(got[0].__fields__)
    # the same sign of a component for all rows: whitened components are uncorrelated only then
    wide = {}
    for r in got:
        wide.setdefault(r.vec_id, {})[r.component] = r.whitened
    m = np.array([[w[c] for c in range(1, 17)] for w in wide.values()])
    assert np.abs(m.T @ m / len(m) - np.eye(16)).max() < 0.2


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(i % 40, [rng.gauss(0, 5 - j) for j in range(5)]) for i in range(90)]
    rows += rows[:30] + [rows[0]] * 200
    rows += [(None, rows[1][1]), (500, None), (501, []), (502, [1.0, None, 0.0, 0.0, 0.0]), (503, [math.nan, 1.0, 1.0, 1.0, 1.0]), (504, [math.inf] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    near = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    check(whitened(df.withColumns({c: F.lit(7) for c in ("x", "v", "n", "width", "i", "j")})), near)
    # vectors of another length than most take no part
    more = df.union(spark.createDataFrame([(600, [1.0, 2.0])], df.schema))
    check(whitened(more), near)


def test_no_component(spark):
    ddl = "vec_id long, embedding array<double>"
    assert whitened(spark.createDataFrame([], ddl)).count() == 0
    assert whitened(spark.createDataFrame([(1, None), (2, [])], ddl)).count() == 0
    assert whitened(spark.createDataFrame([(1, [1.0, 2.0])] * 9, ddl)).count() == 0


def test_constant_dimensions_have_no_component(spark):
    rng = random.Random(4)
    rows = [(i, [1.5, rng.gauss(0, 3), -7.0, rng.gauss(0, 9)]) for i in range(60)]
    got = check(whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), rows)
    assert {r.component for r in got} == {1, 2}


def test_large_entries_stay_exact(spark):
    rows = [(i, [float((i * 7919) % 101) * 2**20, float(i % 5), 1e15 + 2.0**14 * i]) for i in range(50)]
    got = whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    _, dev, *_ = brute(rows)
    told = {r.vec_id: r.deviation for r in got}
    assert told == {i: d if d < 2**63 else None for i, d in dev}
    huge = spark.createDataFrame([(1, [1e300]), (2, [0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert whitened(huge).count() == 3


@pytest.mark.parametrize(
    "values",
    [
        list(range(1, 40)),
        [5.0] * 12 + [1.0] * 20,
        [10.0] * 3 + [10.0 - 1e-9] * 2 + [3.0, 2.0, 1e-3] + [1e-20] * 8,
        [1.0],
        [2.0, 0.0, 0.0],
        [1e6 / 1.5**i for i in range(60)],
    ],
)
def test_feast_finds_what_the_counts_say(spark, values):
    rng = np.random.default_rng(1)
    turned, _ = np.linalg.qr(rng.standard_normal((len(values), len(values))))
    matrix = (turned * np.array(values, float)) @ turned.T
    matrix = (matrix + matrix.T) / 2
    real = sorted((v for v in values if v > 1e-12 * max(values)), reverse=True)[:16]
    found, vectors = components(spark, matrix, 16)
    assert np.allclose(found, real, rtol=1e-9)
    assert np.abs(vectors.T @ vectors - np.eye(len(real))).max() < 1e-12
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-9 * max(values)


def test_counts_and_borders():
    rng = np.random.default_rng(2)
    a = rng.standard_normal((30, 30))
    matrix = a + a.T
    values = np.linalg.eigvalsh(matrix)
    spectrum = Spectrum(matrix)
    for shift in np.linspace(values[0] - 1, values[-1] + 1, 50):
        assert spectrum.above(shift) == (values > shift).sum()
    cut = intervals(matrix, 10, 3)
    assert sum(n for *_, n in cut) == 10
    assert all(((values > low) & (values <= high)).sum() == n for low, high, n in cut)


def test_missed_eigenvalues_are_an_error():
    with pytest.raises(ArithmeticError):
        feast(np.diag([1.0, 2.0, 3.0]), 1.5, 2.5, 2)
