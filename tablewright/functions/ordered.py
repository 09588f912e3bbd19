"""Order-based columns (running fills, row numbers, row frames, time frames) without hot tasks.

A window over ``partitionBy(key).orderBy(t)`` puts all rows of one key into one
task, which fails where a key holds a large share of the table or where there is no
key. Every function here first cuts the rows into segments of about equal row counts
along the real order, works inside ``(key, segment)``, and carries what is needed
across segment borders by way of one small row per ``(key, segment)``.

``order`` is a list of column names; a leading ``-`` means descending.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import as_list, join_on, q
from .scale import checkpointed, shuffle_width

#: Rows of a block of ``row_frame``, at least.
_FRAME_BLOCK = 50_000


def sort_columns(order: Sequence[str]) -> list[Column]:
    return [q(c[1:]).desc() if c.startswith("-") else q(c).asc() for c in order]


def _segmented(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Add ``_seg``, which grows along the order and splits rows evenly, whatever the types and values, and ``_tie``.

    Rows that tie in all order columns, nulls too, are told apart by a hash of the whole row, so that they are split
    like others; only rows that are equal in every column stay together. Spark samples these columns for its range
    borders; the rows with their segment are written to the checkpoint folder once, so that the borders stay put
    however often the result is read.
    """
    hashed = [q(f.name) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    tied = df.withColumn("_tie", F.xxhash64(*hashed))
    ranged = tied.repartitionByRange(shuffle_width(df.sparkSession), *sort_columns(order), F.col("_tie"))
    return checkpointed(ranged.withColumn("_seg", F.spark_partition_id()))


def _window(keys: Sequence[str], order: Sequence[str], *extra: str) -> WindowSpec:
    return Window.partitionBy(*[q(k) for k in keys], *extra).orderBy(*sort_columns(order))


def _reversed(order: Sequence[str]) -> list[str]:
    return [c[1:] if c.startswith("-") else "-" + c for c in order]


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str] | str | None,
    order: Sequence[str],
    number: str | None = None,
    last: Mapping[str, Column] | None = None,
    following: Mapping[str, Column] | None = None,
) -> DataFrame:
    """One walk along the order of each key.

    ``number`` names a column that counts the rows from 1. ``last`` gives, per output name,
    the last non-null value of an expression up to the row; ``following`` the first one from
    the row on. The expressions may use the number.
    """
    keys, last, following = as_list(keys), dict(last or {}), dict(following or {})
    upto = (Window.unboundedPreceding, Window.currentRow)
    walk, order = _segmented(df, order), [*order, "_tie"]
    if number:
        local = walk.withColumn(number, F.row_number().over(_window(keys, order, "_seg")).cast("bigint"))
        sizes = walk.groupBy(*keys, "_seg").agg(F.count("*").alias("_n"))
        offsets = sizes.select(*keys, "_seg", F.coalesce(F.sum("_n").over(_earlier(keys)), F.lit(0)).alias("_off"))
        walk = join_on(local, offsets, [*keys, "_seg"]).withColumn(number, q(number) + F.col("_off")).drop("_off")
    if last or following:
        ahead = _window(keys, order, "_seg").rowsBetween(*upto)
        back = _window(keys, _reversed(order), "_seg").rowsBetween(*upto)
        filled = {n: F.last(v, ignorenulls=True).over(ahead) for n, v in last.items()}
        filled |= {n: F.last(v, ignorenulls=True).over(back) for n, v in following.items()}
        local = walk.withColumns(filled | {"_rn": F.row_number().over(_window(keys, order, "_seg"))})
        ends = local.groupBy(*keys, "_seg").agg(
            *[F.max_by(q(n), F.col("_rn")).alias(n) for n in last],
            *[F.min_by(q(n), F.col("_rn")).alias(n) for n in following],
        )
        carried = ends.select(
            *keys,
            "_seg",
            *[F.last(q(n), ignorenulls=True).over(_earlier(keys)).alias(f"_in_{n}") for n in last],
            *[F.first(q(n), ignorenulls=True).over(_later(keys)).alias(f"_in_{n}") for n in following],
        )
        names = [*last, *following]
        joined = join_on(local, carried, [*keys, "_seg"])
        walk = joined.withColumns({n: F.coalesce(q(n), q(f"_in_{n}")) for n in names}).drop(
            "_rn", *[f"_in_{n}" for n in names]
        )
    return walk.drop("_seg", "_tie")


def running_totals(df: DataFrame, keys: Sequence[str] | str | None, order: Sequence[str], totals: Mapping[str, Column]) -> DataFrame:
    """Per output name, the sum of an expression over the rows of the key up to this one."""
    keys = as_list(keys)
    walk = _segmented(df, order)
    upto = _window(keys, [*order, "_tie"], "_seg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = walk.groupBy(*keys, "_seg").agg(*[F.sum(v).alias(f"_s_{n}") for n, v in totals.items()])
    before = sums.select(*keys, "_seg", *[F.coalesce(F.sum(f"_s_{n}").over(_earlier(keys)), F.lit(0)).alias(f"_in_{n}") for n in totals])
    local = walk.withColumns({n: F.sum(v).over(upto) for n, v in totals.items()})
    joined = join_on(local, before, [*keys, "_seg"])
    return joined.withColumns({n: q(n) + F.col(f"_in_{n}") for n in totals}).drop("_seg", "_tie", *[f"_in_{n}" for n in totals])


def _earlier(keys: Sequence[str]) -> WindowSpec:
    # Over one row per (key, segment), so never more rows per key than there are segments.
    return Window.partitionBy(*[q(k) for k in keys]).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)


def _later(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*[q(k) for k in keys]).orderBy("_seg").rowsBetween(1, Window.unboundedFollowing)


def row_numbers(df: DataFrame, keys: Sequence[str] | str | None, order: Sequence[str], name: str) -> DataFrame:
    """Number the rows of each key from 1 in the given order."""
    return ordered_scan(df, keys, order, number=name)


def carry_last(
    df: DataFrame, keys: Sequence[str] | str | None, order: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """For each output name, the last non-null value of the expression up to this row."""
    return ordered_scan(df, keys, order, last=values)


def carry_next(
    df: DataFrame, keys: Sequence[str] | str | None, order: Sequence[str], values: Mapping[str, Column]
) -> DataFrame:
    """For each output name, the first non-null value of the expression from this row on."""
    return ordered_scan(df, keys, order, following=values)


def row_frame(
    df: DataFrame,
    keys: Sequence[str] | str | None,
    order: Sequence[str],
    reach: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
    ahead: int = 0,
) -> DataFrame:
    """Add window columns that look at most ``reach`` rows back and ``ahead`` rows forward.

    ``columns`` gets the ordered window and returns the new columns (``lag``, or
    aggregates over a row frame). Each key is cut into blocks of rows,
    and the rows next to a border are copied into the neighbouring block.
    """
    keys = as_list(keys)
    size = max(_FRAME_BLOCK, reach, ahead)
    numbered = row_numbers(df, keys, order, "_rn")
    home = F.floor((F.col("_rn") - 1) / size).cast("bigint")
    at = F.col("_rn") - 1 - home * size
    copies = F.array_compact(
        F.array(
            home,
            F.when(at >= size - reach, home + 1) if reach else F.lit(None).cast("bigint"),
            F.when((at < ahead) & (home > 0), home - 1) if ahead else F.lit(None).cast("bigint"),
        )
    )
    blocks = numbered.withColumn("_home", home).withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*[q(k) for k in keys], "_block").orderBy("_rn")
    framed = blocks.withColumns(dict(columns(w)))
    return framed.where(F.col("_home") == F.col("_block")).drop("_rn", "_home", "_block")


def time_frame(
    df: DataFrame,
    keys: Sequence[str] | str | None,
    ts: str,
    seconds: int,
    columns: Callable[[WindowSpec], Mapping[str, Column]],
) -> DataFrame:
    """Add window columns over the rows of the last ``seconds`` up to this row's instant.

    ``columns`` gets the window with its time range set. The time axis is cut into blocks
    four ranges wide; a block also gets the last range of the one before it. Rows without
    an instant stay, and see each other.
    """
    keys = as_list(keys)
    micros = F.unix_micros(q(ts).cast("timestamp"))
    reach = seconds * 1_000_000
    timed = df.withColumn("_us", micros)
    width = 4 * reach
    home = F.floor(F.col("_us") / width).cast("bigint")
    tail = F.pmod(F.col("_us"), F.lit(width)) >= width - reach
    copies = F.when(tail, F.array(home, home + 1)).otherwise(F.array(home))
    blocks = timed.withColumn("_home", home).withColumn("_block", F.explode(copies))
    w = Window.partitionBy(*[q(k) for k in keys], "_block").orderBy("_us").rangeBetween(-reach, 0)
    framed = blocks.withColumns(dict(columns(w)))
    kept = F.col("_home").eqNullSafe(F.col("_block"))
    return framed.where(kept).drop("_us", "_home", "_block")


def global_index(df: DataFrame, order: Sequence[str], name: str = "_idx") -> DataFrame:
    """Number all rows from 0 in the given order, which must be total.

    The rows are range-sorted, written once to the checkpoint folder (so that the
    borders stay put), and shifted by the sizes of the partitions before.
    """
    ordered = checkpointed(df.orderBy(*sort_columns(order)).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), 33)
    split = ordered.withColumn("_part", part)
    sizes = split.groupBy("_part").agg(F.count("*").alias("_n"))
    starts = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_off"))
    within = F.col("_mid") - F.shiftleft(F.col("_part"), 33)
    return (
        split.join(F.broadcast(starts), "_part")
        .withColumn(name, F.col("_off") + within)
        .drop("_part", "_mid", "_off")
    )
