"""Reshaping, parsing, flattening, splitting, combining and formulas."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import as_list, field_type, q


def pivot(
    df: DataFrame, index: Sequence[str] | str, key: str, value: str, agg: str = "sum", values: Sequence | None = None
) -> DataFrame:
    """Long to wide. ``values`` names the new columns; without it Spark runs a query to find them."""
    grouped = df.groupBy(*as_list(index)).pivot(key, list(values) if values is not None else None)
    return grouped.agg(getattr(F, agg)(q(value)))


def melt(
    df: DataFrame, ids: Sequence[str] | str, values: Sequence[str], name: str = "variable", value: str = "value"
) -> DataFrame:
    """Wide to long."""
    return df.unpivot([q(c) for c in as_list(ids)], [q(c) for c in values], name, value)


def transpose_summary(df: DataFrame, key: str, keys: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """Transpose a small summary table: its columns become rows, the listed key values columns."""
    cols = list(cols or [c for c in df.columns if c != key])
    long = melt(df, key, cols, "statistic", "_v")
    return long.groupBy("statistic").pivot(key, list(keys)).agg(F.first("_v"))


def parse_json(
    df: DataFrame, col: str, schema: T.StructType | str | None = None, paths: Mapping[str, tuple[str, str]] | None = None
) -> DataFrame:
    """JSON text to columns, by a schema or by ``{name: (path, type)}``. Bad JSON gives nulls."""
    if (schema is None) == (paths is None):
        raise ValueError("give either a schema or paths")
    if schema is not None:
        parsed = df.withColumn("_j", F.from_json(q(col), schema, {"mode": "PERMISSIVE"}))
        return parsed.select(*[q(c) for c in df.columns], "_j.*")
    variant = F.try_parse_json(q(col))
    return df.withColumns({n: F.try_variant_get(variant, p, t) for n, (p, t) in paths.items()})


def parse_xml(df: DataFrame, col: str, schema: T.StructType | str) -> DataFrame:
    """XML text to columns. Bad XML gives nulls."""
    ddl = schema if isinstance(schema, str) else ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    parsed = df.withColumn("_x", F.from_xml(q(col), ddl, {"mode": "PERMISSIVE"}))
    return parsed.select(*[q(c) for c in df.columns], "_x.*")


def parse_delimited(df: DataFrame, col: str, sep: str, names: Sequence[str]) -> DataFrame:
    """Delimited text to columns; missing trailing parts are null.

    A part between double quotes may hold the separator, and a quote written twice; it loses its quotes. A quote that
    is not closed before a separator or the end is a character like others.
    """
    mark = "\\Q" + sep + "\\E"
    quoted = f'"[^"]*+(?:""[^"]*+)*+"(?={mark}|\\z)'
    # every part is read with the separator before it, so that none is empty to the matcher
    parts = F.regexp_extract_all(F.concat(F.lit(sep), q(col)), F.lit(f"(?s){mark}({quoted}|.*?(?={mark}|\\z))"), F.lit(1))

    def bare(part: Column) -> Column:
        inside = F.replace(F.substring(part, F.lit(2), F.length(part) - 2), F.lit('""'), F.lit('"'))
        return F.when(F.regexp_like(part, F.lit('(?s)^"[^"]*+(?:""[^"]*+)*+"$')), inside).otherwise(part)

    return df.withColumns({n: bare(F.get(parts, i)) for i, n in enumerate(names)})


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Struct fields, at any depth, to top-level columns."""

    def leaves(schema: T.StructType, column: Column | None, prefix: str) -> list[Column]:
        out = []
        for f in schema.fields:
            here = q(f.name) if column is None else column.getField(f.name)
            if isinstance(f.dataType, T.StructType):
                out += leaves(f.dataType, here, prefix + f.name + sep)
            else:
                out.append(here.alias(prefix + f.name))
        return out

    return df.select(*leaves(df.schema, None, ""))


def unnest(df: DataFrame, col: str, outer: bool = True, with_pos: bool = True) -> DataFrame:
    """Array elements or map entries to rows."""
    rest = [q(c) for c in df.columns if c != col]
    names = ["key", "value"] if isinstance(field_type(df, col), T.MapType) else [col]
    if with_pos:
        gen = (F.posexplode_outer if outer else F.posexplode)(q(col))
        names = ["pos", *names]
    else:
        gen = (F.explode_outer if outer else F.explode)(q(col))
    return df.select(*rest, gen.alias(*names))


def split_column(df: DataFrame, col: str, pattern: str, names: Sequence[str]) -> DataFrame:
    """One column to several: by a regex with one group per name, else by a separator regex."""
    import re

    if re.compile(pattern).groups == len(names):
        found = q(col).rlike(pattern)
        return df.withColumns(
            {n: F.when(found, F.regexp_extract(q(col), pattern, i + 1)) for i, n in enumerate(names)}
        )
    parts = F.split(q(col), pattern)
    return df.withColumns({n: F.get(parts, i) for i, n in enumerate(names)})


def combine_columns(df: DataFrame, cols: Sequence[str], sep: str, name: str) -> DataFrame:
    """Several columns to one text; nulls are left out."""
    return df.withColumn(name, F.concat_ws(sep, *[q(c).cast("string") for c in cols]))


def calculated_fields(df: DataFrame, exprs: Mapping[str, str]) -> DataFrame:
    """Derived columns from SQL formulas over the input columns."""
    return df.withColumns({n: F.expr(e) for n, e in exprs.items()})
