import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tablewright.functions import ordered as O


@pytest.fixture(scope="module")
def frame(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.randint(0, 3000) if i % 40 else None, None if rng.random() < 0.6 else rng.random()))
    df = spark.createDataFrame(rows, "id long, k string, t long, v double")
    return df.withColumn("ts", F.timestamp_seconds("t").cast("timestamp_ntz"))


def _same(a, b):
    cols = sorted(a.columns)
    key = lambda r: tuple((x is not None, x) for x in r)
    left = sorted((tuple(r) for r in a.select(cols).collect()), key=key)
    right = sorted((tuple(r) for r in b.select(cols).collect()), key=key)
    assert left == right


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("order", [["t", "id"], ["-ts", "id"]])
def test_row_numbers(frame, keys, order):
    w = Window.partitionBy(*keys).orderBy(*O.sort_columns(order))
    _same(O.row_numbers(frame, keys, order, "n"), frame.withColumn("n", F.row_number().over(w).cast("bigint")))


@pytest.mark.parametrize("keys", [["k"], []])
def test_carry(frame, keys):
    w = Window.partitionBy(*keys).orderBy("t", "id")
    want = frame.withColumn("p", F.last("v", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "x", F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    )
    got = O.carry_last(frame, keys, ["t", "id"], {"p": F.col("v")})
    got = O.carry_next(got, keys, ["t", "id"], {"x": F.col("v")})
    _same(got, want)


def test_row_frame(frame, monkeypatch):
    monkeypatch.setattr(O, "_FRAME_BLOCK", 7)
    cols = lambda w: {"l": F.lag("v", 3).over(w), "m": F.max("id").over(w.rowsBetween(-5, 2)), "f": F.lead("id", 2).over(w)}
    want = frame.withColumns(cols(Window.partitionBy("k").orderBy("t", "id")))
    _same(O.row_frame(frame, "k", ["t", "id"], 5, cols, ahead=2), want)


def test_time_frame(frame):
    cols = lambda w: {"c": F.count("v").over(w), "m": F.max("id").over(w)}
    us = frame.withColumn("u", F.unix_micros(F.col("ts").cast("timestamp")))
    want = us.withColumns(cols(Window.partitionBy("k").orderBy("u").rangeBetween(-30_000_000, 0))).drop("u")
    _same(O.time_frame(frame, "k", "ts", 30, cols), want)


def test_hot_keys_common_prefixes_and_sentinels_are_cut_evenly(spark):
    """Neither long common prefixes nor one far value nor a single key puts all rows into one segment."""
    rows = spark.range(10_000).select(
        F.lit("hot").alias("k"),
        F.format_string("customer-%08d", "id").alias("name"),
        F.when(F.col("id") == 7, F.lit("9999-12-31")).otherwise(F.date_add(F.lit("2024-01-01"), (F.col("id") % 300).cast("int"))).cast("date").alias("day"),
        "id",
    )
    for order in (["name"], ["day", "id"], ["-day", "id"]):
        sizes = [r["count"] for r in O._segmented(rows, order).groupBy("_seg").count().collect()]
        assert len(sizes) > 1 and max(sizes) < 2 * 10_000 / len(sizes)
        w = Window.partitionBy("k").orderBy(*O.sort_columns(order))
        _same(O.row_numbers(rows, "k", order, "n"), rows.withColumn("n", F.row_number().over(w).cast("bigint")))


def test_global_index(frame):
    want = frame.withColumn("i", (F.row_number().over(Window.orderBy("k", "id")) - 1).cast("bigint"))
    _same(O.global_index(frame, ["k", "id"], "i"), want)


def test_ties_are_split_evenly(spark):
    """A third of all rows without an order value, and a third with the same one."""
    df = spark.range(12_000).withColumn("t", F.when(F.col("id") % 3 == 0, F.col("id")).when(F.col("id") % 3 == 1, F.lit(5).cast("long")))
    sizes = [r["count"] for r in O._segmented(df, ["t"]).groupBy("_seg").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * min(sizes)
    numbered = O.row_numbers(df, None, ["t"], "n").collect()
    assert sorted(r.n for r in numbered) == list(range(1, 12_001))
    by_number = [r.t for r in sorted(numbered, key=lambda r: r.n)]
    assert by_number == sorted(by_number, key=lambda t: (t is not None, t or 0))
