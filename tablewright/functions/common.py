"""Small column helpers used everywhere."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FLOATING = (T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
NUMERIC = (*INTEGRAL, *FLOATING, T.DecimalType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def numeric_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """The numeric columns of ``df`` (or of ``cols``), in table order."""
    wanted = df.columns if cols is None else cols
    return [c for c in wanted if isinstance(field_type(df, c), NUMERIC)]


def text_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    wanted = df.columns if cols is None else cols
    return [c for c in wanted if isinstance(field_type(df, c), T.StringType)]


def temporal_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    wanted = df.columns if cols is None else cols
    return [c for c in wanted if isinstance(field_type(df, c), TEMPORAL)]


def q(name: str) -> Column:
    """A column by its literal name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating column."""
    if isinstance(field_type(df, name), FLOATING):
        return q(name).isNull() | F.isnan(q(name))
    return q(name).isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value with NaN read as null."""
    if isinstance(field_type(df, name), FLOATING):
        return F.when(~F.isnan(q(name)), q(name))
    return q(name)


def unit_hash(keys: Sequence[str | Column], tag: str, seed: int = 42) -> Column:
    """A uniform number in [0, 1) that depends only on the key, a tag and a seed.

    The same rows are chosen whatever the partitioning, and after any retry.
    """
    return hash32(keys, tag, seed) / F.lit(4294967296.0)


def hash32(keys: Sequence[str | Column], tag: str, seed: int = 42) -> Column:
    parts = [(q(k) if isinstance(k, str) else k).cast("string") for k in keys]
    digest = F.md5(F.concat_ws("|", *parts, F.lit(tag), F.lit(str(seed))))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def with_stats(df: DataFrame, stats: DataFrame, name: str = "_stats") -> DataFrame:
    """Attach a one-row statistics table as one struct column.

    The row is a scalar subquery: it is computed once, and Spark fails the query
    should it ever hold more than one row. ``stats`` must be a global aggregate.
    """
    return df.withColumn(name, stats.select(F.struct("*")).scalar())


def join_on(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on same-named keys in which null matches null, keeping the left keys."""
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    cond = None
    for k in keys:
        here = q(k).eqNullSafe(q(f"_r_{k}"))
        cond = here if cond is None else cond & here
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def as_list(value: str | Iterable[str] | None) -> list[str]:
    if value is None:
        return []
    return [value] if isinstance(value, str) else list(value)
