"""Categories to numbers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, present, q, with_stats
from .repair import level_table, to_category

_MOST_LEVELS = 1000


def find_levels(df: DataFrame, col: str, most: int = _MOST_LEVELS) -> list:
    """The sorted distinct values of a column; an error if there are too many to make columns of."""
    rows = df.select(q(col)).where(q(col).isNotNull()).distinct().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{col!r} has more than {most} levels; use another encoding")
    return sorted(r[0] for r in rows)


def one_hot_encoding(df: DataFrame, col: str, levels: Sequence | None = None, drop: bool = False, most_levels: int = _MOST_LEVELS) -> DataFrame:
    """One 0/1 column ``<col>_<level>`` per level. Without ``levels`` a query finds them first.

    More than ``most_levels`` of them are an error, as each becomes a column.
    """
    levels = find_levels(df, col, most_levels) if levels is None else list(levels)
    hot = {f"{col}_{v}": F.coalesce(q(col) == F.lit(v), F.lit(False)).cast("int") for v in levels}
    out = df.withColumns(hot)
    return out.drop(col) if drop else out


def label_encoding(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Alphabetical rank from 0."""
    return to_category(df, col, None, name or f"{col}_label")


def ordinal_encoding(df: DataFrame, col: str, order: Sequence, name: str | None = None) -> DataFrame:
    """Position in the given order from 0; other values are null."""
    rank = F.array_position(F.array(*[F.lit(v) for v in order]), q(col))
    return df.withColumn(name or f"{col}_ordinal", F.nullif(rank, F.lit(0)) - 1)


def target_encoding(df: DataFrame, col: str, target: str, smoothing: float = 10.0, name: str | None = None) -> DataFrame:
    """``(n * group mean + m * overall mean) / (n + m)`` with m = ``smoothing``; unseen and null get the overall mean."""
    y = present(df, target).cast("double")
    groups = df.where(q(col).isNotNull()).groupBy(q(col).alias("_g")).agg(F.count(y).alias("_n"), F.sum(y).alias("_s"))
    joined = with_stats(df.join(groups, q(col) == F.col("_g"), "left"), df.agg(F.avg(y).alias("m")), "_all")
    n = F.coalesce(F.col("_n"), F.lit(0))
    code = (F.coalesce(F.col("_s"), F.lit(0.0)) + smoothing * F.col("_all.m")) / (n + smoothing)
    return joined.withColumn(name or f"{col}_target", code).drop("_g", "_n", "_s", "_all")


def frequency_encoding(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    """Share of rows with the same value."""
    counts = df.groupBy(q(col).alias("_g")).agg(F.count("*").alias("_n"))
    joined = with_stats(df.join(counts, q(col).eqNullSafe(F.col("_g")), "left"), df.agg(F.count("*").alias("n")), "_all")
    return joined.withColumn(name or f"{col}_freq", F.col("_n") / F.col("_all.n")).drop("_g", "_n", "_all")


def binary_encoding(df: DataFrame, col: str, bits: int | None = None) -> DataFrame:
    """The bits of the alphabetical code as ``<col>_b0`` (lowest) ... ; without ``bits`` a query counts the levels."""
    levels = level_table(df, col)
    if bits is None:
        bits = max(1, (max(levels.count(), 1) - 1).bit_length())
    out = df.join(levels, q(col) == F.col("level"), "left")
    cols = {f"{col}_b{b}": F.shiftright("code", b).bitwiseAND(F.lit(1)).cast("int") for b in range(bits)}
    return out.withColumns(cols).drop("level", "code")


def hash_bucket(col, n: int):
    """A bucket from the first eight hex digits of the md5, equal in every engine."""
    return F.pmod(F.conv(F.substring(F.md5(col), 1, 8), 16, 10).cast("bigint"), F.lit(n))


def hashing_trick(df: DataFrame, cols: Sequence[str] | str, n: int, prefix: str = "h") -> DataFrame:
    """Count, per row, how many of the ``column=value`` texts fall in each of n buckets."""
    parts = [hash_bucket(F.concat(F.lit(c + "="), q(c).cast("string")), n) for c in as_list(cols)]
    out = {}
    for b in range(n):
        total = F.lit(0)
        for p in parts:
            total = total + F.coalesce((p == b).cast("int"), F.lit(0))
        out[f"{prefix}{b}"] = total
    return df.withColumns(out)
