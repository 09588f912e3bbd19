import random

import pandas as pd
import pytest

from tablewright.functions import quantiles
from tablewright.functions.quantiles import quantile_table

PROBS = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def _rows(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        x = None if i % 11 == 0 else rng.choice([rng.gauss(0, 1), 7.5, rng.expovariate(0.001), -rng.random() * 1e-6])
        rows.append((i % 3 if i % 17 else None, x, float(rng.randint(0, 5))))
    return rows


@pytest.mark.parametrize("n", [1, 2, 500])
def test_narrowing_equals_sorting(spark, n):
    rows = _rows(n)
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = quantile_table(df, {"x": PROBS, "y": [0.5]}).first()
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    want = pdf["x"].quantile(PROBS).tolist()
    if n == 1:
        assert got["x"] is None and got["y"] == [pdf["y"].quantile(0.5)]
        return
    assert got["x"] == pytest.approx(want, rel=1e-12)
    assert got["y"] == [pdf["y"].quantile(0.5)]


def test_groups_equal_sorting(spark):
    rows = _rows(600)
    df = spark.createDataFrame(rows, "g int, x double, y double")
    got = {r["g"]: r for r in quantile_table(df, {"x": PROBS, "y": PROBS}, "g").collect()}
    pdf = pd.DataFrame(rows, columns=["g", "x", "y"])
    for g, own in pdf.groupby("g", dropna=False):
        r = got[None if pd.isna(g) else int(g)]
        assert r["x"] == pytest.approx(own["x"].quantile(PROBS).tolist(), rel=1e-12)
        assert r["y"] == pytest.approx(own["y"].quantile(PROBS).tolist(), rel=1e-12)


def test_pivots_that_leave_many_values_between_them(spark, monkeypatch):
    """A rough sketch: ranks next to, on and between pivots, repeated values, far values and infinities."""
    monkeypatch.setattr(quantiles, "ACCURACY", 10)
    monkeypatch.setattr(quantiles, "_MARGIN", 0.2)
    rng = random.Random(8)
    values = [1000.0 + i * 1e-9 for i in range(700)] + [1003.0, -1e300, 1e300] + [1000.0] * 100 + [rng.random() for _ in range(300)]
    df = spark.createDataFrame([(v,) for v in values], "x double").repartition(6)
    got = quantile_table(df, {"x": PROBS}).first()["x"]
    assert got == pytest.approx(pd.Series(values).quantile(PROBS).tolist(), rel=1e-14)
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),)], "x double")
    assert quantile_table(ends, {"x": [0.0, 0.5, 1.0]}).first()["x"] == [float("-inf"), 1.0, float("inf")]


@pytest.mark.parametrize("n", list(range(1, 12)) + [37])
def test_small_groups_at_many_ranks(spark, n):
    rng = random.Random(n)
    values = [float(rng.randint(0, 6)) for _ in range(n)]
    probs = [i / 20 for i in range(21)] + [0.333, 0.951, 0.9999]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert quantile_table(df, {"x": probs}).first()["x"] == pytest.approx(pd.Series(values).quantile(probs).tolist(), rel=1e-12)


def test_no_job_runs_while_the_plan_is_built(spark):
    df = spark.createDataFrame(_rows(50), "g int, x double, y double")
    store = spark.sparkContext._jsc.sc().statusStore()
    before = store.jobsList(None).size()
    quantile_table(df, {"x": PROBS, "y": [0.5]}, "g")
    assert store.jobsList(None).size() == before


def test_many_ranks_are_placed_block_by_block(spark):
    """No window orders all cells of a column in one task, and the cells are not compared with all ranks."""
    rng = random.Random(4)
    values = [rng.choice([rng.gauss(0, 1), float(rng.randint(0, 9)), None]) for _ in range(4000)]
    probs = [i / 300 for i in range(301)]
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "x double, g int")
    found = quantile_table(df, {"x": probs}, "g")
    pdf = pd.DataFrame({"x": values, "g": [i % 2 for i in range(len(values))]})
    for r in found.collect():
        assert r["x"] == pytest.approx(pdf["x"][pdf["g"] == r["g"]].quantile(probs).tolist(), rel=1e-12)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.split("\n") if "Window [" in x and "least" in x]
    assert windows and all("block" in x for x in windows)
