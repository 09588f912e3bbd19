"""Exact quantiles with linear interpolation, on any amount of data.

Distributed selection with two pivots around each wanted rank. One pass builds a mergeable rank
sketch of every column and group, whose error is bounded; it yields pivots that the rank must lie
between. A second pass folds the values: those between two pivots by value, all others to one
count for each gap. Running counts over these few rows place the ranks. All columns and ranks go
through the same passes, with map-side combine. Nothing runs while the plan is built.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_list, join_on, present, q, with_stats

#: The sketch misses a rank by at most one part in this many of a group's rows.
ACCURACY = 20_000

#: Distance of the pivots from the wanted share of rows: twice the error on either side.
_MARGIN = 2 / ACCURACY

#: Pivots that are compared one by one.
_FEW = 16


def quantile_table(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    by: Sequence[str] | str | None = None,
) -> DataFrame:
    """One row (per ``by`` group) with an array column of quantiles per input column.

    Nulls and NaN do not count. A group without any value of a column has null there.
    """
    keys, names = as_list(by), list(probs)
    group = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[q(k).alias(g) for k, g in zip(keys, group, strict=True)], *[present(df, c).cast("double").alias(f"_v{i}") for i, c in enumerate(names)])

    # Pass 1: pivots around each rank, by a sketch of bounded error.
    asked = [sorted((float(p), j) for j, p in enumerate(probs[c])) for c in names]
    pivots = rows.groupBy(*group).agg(*[F.percentile_approx(f"_v{i}", _shares(a), ACCURACY).alias(f"_p{i}") for i, a in enumerate(asked)])
    pivots = pivots.select(*group, *[x for i, a in enumerate(asked) for x in _pivots(i, [p for p, _ in a])])
    if keys:
        met = join_on(rows, pivots, group)
    else:
        met = with_stats(rows, pivots, "_s").select("*", "_s.*")

    # Pass 2: a value between two pivots counts for itself, any other for the gap that it lies in.
    events = []
    for i, a in enumerate(asked):
        x, low, high = F.col(f"_v{i}"), F.col(f"_lp{i}"), F.col(f"_hp{i}")
        met = _passed(_passed(met, "l", i, len(a), lambda p, x=x: p <= x), "h", i, len(a), lambda p, x=x: p < x)
        events.append(F.struct(F.lit(i).alias("c"), F.when(low == high, low).alias("gap"), F.when(low > high, x).alias("own"), (low + high).alias("block"), x.alias("x")))
    cells = met.select(*group, F.explode(F.array(*events)).alias("e")).select(*group, "e.*").groupBy(*group, "c", "block", "gap", "own")
    cells = cells.agg(F.count("x").alias("n"), F.min("x").alias("least"), F.max("x").alias("most"))

    # Running counts place the ranks: on a value, or on the first or last one of a gap. Blocks, which are the gaps and
    # what lies between two gaps, ascend with their values. With many ranks only the blocks, a few for each rank, are
    # counted up and compared with all ranks; the cells of a block then meet its own ranks, each block on its own.
    listed = F.from_json(F.lit(json.dumps([{"c": i, "j": j, "p": p} for i, a in enumerate(asked) for p, j in a])), "array<struct<c:int,j:int,p:double>>")
    if max(map(len, asked)) <= _FEW:
        cells = _ranks_here(_counted(cells, [*group, "c"], "least"), listed)
    else:
        block = [*group, "c", "block"]
        blocks = _ranks_here(_counted(cells.groupBy(*block).agg(F.sum("n").alias("n")), [*group, "c"], "block"), listed)
        cells = join_on(cells, blocks.select(*block, "total", "here", F.col("start").alias("before")), block, "inner")
        upto = F.sum("n").over(Window.partitionBy(*block).orderBy("least").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        cells = cells.withColumn("upto", F.col("before") + upto).withColumn("start", F.col("upto") - F.col("n"))
        cells = cells.withColumn("here", F.filter("here", _inside)).where("total = 0 or size(here) > 0")
    placed = cells.select("*", F.explode_outer("here").alias("r"))

    def at(rank: Column) -> Column:
        inside = (rank >= F.col("start")) & (rank < F.col("upto"))
        edge = F.when(rank == F.col("upto") - 1, F.col("most")).when(rank == F.col("start"), F.col("least"))
        return F.when(inside, F.coalesce("own", edge))

    found = placed.groupBy(*group, "c", "r.j", "r.frac").agg(F.max(at(F.col("r.first"))).alias("low"), F.max(at(F.col("r.last"))).alias("high"))
    value = F.when((F.col("low") == F.col("high")) | (F.col("frac") == 0), F.col("low")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * F.col("frac"))
    found = found.withColumn("v", value)
    own = [F.array_sort(F.collect_list(F.when((F.col("c") == i) & F.col("j").isNotNull(), F.struct("j", "v")))).alias(f"_o{i}") for i in range(len(names))]
    wide = found.groupBy(*group).agg(*own)
    held = [F.when(F.size(f"_o{i}") > 0, F.transform(f"_o{i}", lambda s: s["v"])).alias(c) for i, c in enumerate(names)]
    return wide.select(*[F.col(g).alias(k) for g, k in zip(group, keys, strict=True)], *held)


def _shares(asked: list[tuple[float, int]]) -> list[float]:
    return [min(1.0, max(0.0, p + side)) for side in (-_MARGIN, _MARGIN) for p, _ in asked]


def _pivots(i: int, asked: list[float]) -> list[Column]:
    """The lower and the upper pivots of a column as arrays; a rank next to an end has that as pivot."""
    p, m = F.col(f"_p{i}"), len(asked)
    first, last = sum(x <= _MARGIN for x in asked), sum(x >= 1 - _MARGIN for x in asked)
    ends = {"l": [F.array_repeat(F.lit(float("-inf")), first), F.slice(p, first + 1, m - first)], "h": [F.slice(p, m + 1, m - last), F.array_repeat(F.lit(float("inf")), last)]}
    return [F.concat(*parts).alias(f"_{side}{i}") for side, parts in ends.items()]


def _passed(met: DataFrame, side: str, i: int, m: int, below: Callable[[Column], Column]) -> DataFrame:
    """With the number of ``m`` ascending pivots that a value has passed; many are halved, a projection for each half."""
    pivots, out = F.col(f"_{side}{i}"), f"_{side}p{i}"
    if m <= _FEW:
        return met.withColumn(out, reduce(lambda a, b: a + b, [F.when(below(pivots[k]), 1).otherwise(0) for k in range(m)]))
    met, step = met.withColumn(out, F.lit(0)), 1 << (m.bit_length() - 1)
    while step:
        found = below(F.get(pivots, F.col(out) + F.lit(step - 1)))
        met, step = met.withColumn(out, F.col(out) + F.when(found, F.lit(step)).otherwise(F.lit(0))), step >> 1
    return met


def _counted(cells: DataFrame, by: list[str], order: str) -> DataFrame:
    """With the counts before a row and up to it, and of the whole column."""
    column = Window.partitionBy(*by)
    upto = F.sum("n").over(column.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cells.withColumn("upto", upto).withColumn("total", F.sum("n").over(column)).withColumn("start", F.col("upto") - F.col("n"))


def _inside(r: Column) -> Column:
    return ((r.first >= F.col("start")) & (r.first < F.col("upto"))) | ((r.last >= F.col("start")) & (r.last < F.col("upto")))


def _ranks_here(counted: DataFrame, listed: Column) -> DataFrame:
    """The rows that a rank lies in, with those ranks; a column without values keeps its row."""
    target = F.col("total") - 1
    near = F.filter(listed, lambda a: (a.c == F.col("c")) & (a.p * target > F.col("start") - 1) & (a.p * target < F.col("upto")))
    return counted.withColumn("here", F.filter(F.transform(near, _rank), _inside)).where("total = 0 or size(here) > 0")


def _rank(asked: Column) -> Column:
    target = asked.p * (F.col("total") - 1)
    return F.struct(asked.j.alias("j"), F.floor(target).alias("first"), F.ceil(target).alias("last"), (target - F.floor(target)).alias("frac"))


def quantile_struct(
    df: DataFrame, probs: Mapping[str, Sequence[float]], by: Sequence[str] | str | None = None
) -> DataFrame:
    """As :func:`quantile_table` with scalar columns ``<col>_q<i>``."""
    keys = as_list(by)
    wide = quantile_table(df, probs, keys)
    cols = [
        q(c)[i].alias(f"{c}_q{i}") for c, ps in probs.items() for i in range(len(ps))
    ]
    return wide.select(*keys, *cols)
