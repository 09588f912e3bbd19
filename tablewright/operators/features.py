"""New columns from old ones, and relations between tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations, combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, field_type, join_on, q
from ..functions.ordered import row_frame, time_frame
from ..functions.scale import checkpointed


def polynomial_features(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """All products of 2 to ``degree`` of the columns, named ``a_x_b``."""
    out = {}
    for d in range(2, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            out["_x_".join(combo)] = reduce(lambda a, b: a * b, [q(c) for c in combo])
    return df.withColumns(out)


def interaction_terms(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Products of each pair of columns."""
    return df.withColumns({f"{a}_x_{b}": q(a) * q(b) for a, b in combinations(cols, 2)})


def ratio_features(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """``a_per_b``; null where b is 0."""
    return df.withColumns({f"{a}_per_{b}": F.try_divide(q(a).cast("double"), q(b).cast("double")) for a, b in pairs})


def group_statistics(
    df: DataFrame, by: Sequence[str] | str, aggs: Mapping[str, tuple[str, str]], sets: str = "group"
) -> DataFrame:
    """``{name: (function, column)}`` per group; ``sets`` is ``group``, ``rollup`` or ``cube``."""
    keys = as_list(by)
    grouped = {"group": df.groupBy, "rollup": df.rollup, "cube": df.cube}[sets](*keys)
    cols = [getattr(F, fn)(F.lit(1) if c == "*" else q(c)).alias(n) for n, (fn, c) in aggs.items()]
    if sets != "group":
        cols.append(F.grouping_id().alias("grouping_id"))
    return grouped.agg(*cols)


def aggregation_features(
    df: DataFrame, by: Sequence[str] | str, aggs: Mapping[str, tuple[str, str]], source: DataFrame | None = None
) -> DataFrame:
    """Group statistics joined back to every row; ``source`` may be a child table with the same keys.

    Groups are aggregated first and joined, instead of a window, so that a large group never
    sits in one task.
    """
    return join_on(df, group_statistics(source if source is not None else df, by, aggs), as_list(by))


def lag_features(
    df: DataFrame,
    cols: Sequence[str],
    lags: Sequence[int],
    order_by: Sequence[str],
    by: Sequence[str] | str | None = None,
    diffs: bool = False,
) -> DataFrame:
    """``<c>_lag<n>`` (``<c>_lead<n>`` for negative n), and with ``diffs`` the difference to it."""
    back = max([n for n in lags if n > 0], default=0)
    ahead = max([-n for n in lags if n < 0], default=0)

    def columns(w):
        out = {}
        for c in cols:
            for n in lags:
                name = f"{c}_lag{n}" if n > 0 else f"{c}_lead{-n}"
                other = F.lag(q(c), n).over(w) if n > 0 else F.lead(q(c), -n).over(w)
                out[name] = other
                if diffs:
                    out[f"{name}_diff"] = q(c) - other
        return out

    return row_frame(df, by, order_by, back, columns, ahead)


# The rolling statistics on offer.
ROLLING = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "count": F.count}


def rolling_window_features(
    df: DataFrame,
    cols: Sequence[str],
    order_by: Sequence[str],
    by: Sequence[str] | str | None = None,
    rows: int | None = None,
    seconds: int | None = None,
    stats: Sequence[str] = ("sum", "avg", "min", "max", "std"),
) -> DataFrame:
    """Rolling statistics over the last ``rows`` rows, or the last ``seconds``, this row included."""
    if (rows is None) == (seconds is None):
        raise ValueError("give rows or seconds")
    span = f"{rows}r" if rows is not None else f"{seconds}s"

    def columns(w):
        frame = w.rowsBetween(-(rows - 1), 0) if rows is not None else w
        return {f"{c}_{s}_{span}": ROLLING[s](q(c)).over(frame) for c in cols for s in stats}

    if rows is not None:
        return row_frame(df, by, order_by, rows - 1, columns)
    return time_frame(df, by, order_by[0], seconds, columns)


def date_part_features(df: DataFrame, ts: str) -> DataFrame:
    """Year, quarter, month, ISO weekday (Monday = 1), hour and weekend flag."""
    weekday = F.weekday(q(ts)) + 1
    return df.withColumns(
        {
            f"{ts}_year": F.year(q(ts)),
            f"{ts}_quarter": F.quarter(q(ts)),
            f"{ts}_month": F.month(q(ts)),
            f"{ts}_weekday": weekday,
            f"{ts}_hour": F.hour(q(ts).cast("timestamp_ntz")),
            f"{ts}_is_weekend": (weekday >= 6).cast("int"),
        }
    )


def foreign_keys(tables: Mapping[str, DataFrame], columns: Mapping[str, Sequence[str]]) -> DataFrame:
    """For every pair of columns of different tables: how much of the child's values the parent holds.

    ``(child, parent, child_values, found, coverage, parent_unique, is_foreign_key)``. All columns
    go through one shuffle by value: each distinct value ends up with one bit per column that
    holds it, and one per column that repeats it. All pairs are counted from the few distinct
    bit patterns, so no two tables are ever joined.
    """
    names = [(table, c) for table, cols in columns.items() for c in cols]
    words = range((len(names) + 61) // 62)
    parts = []
    for i, (table, c) in enumerate(names):
        df = tables[table]
        values = df.where(q(c).isNotNull()).groupBy(q(c).alias("v")).agg(F.count("*").alias("n"))
        bit = lambda w, i=i: F.lit((1 << (i % 62)) if i // 62 == w else 0).cast("bigint")
        parts.append(
            values.select(
                F.col("v").cast("string").alias("value"),
                *[bit(w).alias(f"in{w}") for w in words],
                *[F.when(F.col("n") > 1, bit(w)).otherwise(F.lit(0)).cast("bigint").alias(f"rep{w}") for w in words],
            )
        )
    flags = [f"{kind}{w}" for kind in ("in", "rep") for w in words]
    # A value comes once from each column: dealt out as it is, it takes no second table of all values in the task that counts them.
    per_value = reduce(DataFrame.unionByName, parts).repartition("value").groupBy("value").agg(*[F.bit_or(f).alias(f) for f in flags])
    # From here on the rows are bit patterns, few whatever the data. They are kept, as they are read thrice.
    set_bits = lambda kind: F.expr(
        "concat(" + ", ".join(
            f"transform(filter(sequence(0, 61), i -> shiftright({kind}{w}, i) & 1 = 1), i -> i + {62 * w})" for w in words
        ) + ")"
    )
    patterns = checkpointed(per_value.groupBy(*flags).agg(F.count("*").alias("n"))).select(
        "n", set_bits("in").alias("held"), set_bits("rep").alias("repeated")
    )
    pairs = (
        patterns.select("n", "held", F.explode("held").alias("a"))
        .select("n", "a", F.explode("held").alias("b"))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("found"))
    )
    sizes = pairs.where("a = b").select("a", F.col("found").alias("child_values"))
    repeated = patterns.select(F.explode("repeated").alias("b")).distinct().withColumn("again", F.lit(True))
    labels = F.array(*[F.lit(".".join(name)) for name in names])
    owners = F.array(*[F.lit(table) for table, _ in names])
    out = pairs.where(F.get(owners, F.col("a")) != F.get(owners, F.col("b"))).join(sizes, "a").join(repeated, "b", "left")
    unique = F.col("again").isNull()
    coverage = F.col("found") / F.col("child_values")
    return out.select(
        F.get(labels, F.col("a")).alias("child"),
        F.get(labels, F.col("b")).alias("parent"),
        "child_values",
        "found",
        coverage.alias("coverage"),
        unique.alias("parent_unique"),
        ((coverage == 1) & unique).alias("is_foreign_key"),
    )


def hierarchy(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Does each child value have one parent value, nulls aside? ``(child, parent, child_values, most_parents, is_hierarchy)``."""
    out = []
    for child, parent in pairs:
        links = df.where(q(child).isNotNull()).groupBy(q(child).alias("c"), q(parent).alias("p")).agg(F.lit(1).alias("one"))
        per_child = links.groupBy("c").agg(F.count("p").alias("n"))
        row = per_child.agg(F.count("*").alias("child_values"), F.max("n").alias("most_parents"))
        out.append(
            row.select(
                F.lit(child).alias("child"), F.lit(parent).alias("parent"), "child_values", "most_parents",
                (F.coalesce(F.col("most_parents"), F.lit(0)) <= 1).alias("is_hierarchy"),
            )
        )
    return reduce(DataFrame.unionByName, out)


def network_edges(df: DataFrame, src: str, dst: str) -> DataFrame:
    """``(src, dst, weight)``: how often two entities occur in the same row."""
    known = df.where(q(src).isNotNull() & q(dst).isNotNull())
    return known.groupBy(q(src).alias("src"), q(dst).alias("dst")).agg(F.count("*").alias("weight"))
