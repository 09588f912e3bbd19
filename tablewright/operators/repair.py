"""Type conversion and value repair."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import field_type, join_on, q, text_columns
from ..functions.ordered import global_index
from ..functions.text import close_pairs

# Texts that stand for a missing value.
NULL_TOKENS = ["N/A", "NULL", "unknown", "#ERROR", "--", "n/a", "UNKNOWN", "na", ""]

# UTF-8 read as Latin-1, and what was meant.
MOJIBAKE = {
    "Ã©": "é",
    "Ã¨": "è",
    "Ãª": "ê",
    "Ã«": "ë",
    "Ã¡": "á",
    "Ã¢": "â",
    "Ã£": "ã",
    "Ã¤": "ä",
    "Ã§": "ç",
    "Ã®": "î",
    "Ã¯": "ï",
    "Ã³": "ó",
    "Ã´": "ô",
    "Ã¶": "ö",
    "Ã¹": "ù",
    "Ã»": "û",
    "Ã¼": "ü",
    "Ã±": "ñ",
    "Â°": "°",
    "â‚¬": "€",
}

# Digits and signs typed for letters.
LOOKALIKES = {"3": "e", "@": "a", "0": "o"}


def null_tokens(df: DataFrame, cols: Sequence[str] | None = None, tokens: Sequence[str] = NULL_TOKENS) -> DataFrame:
    """Sentinel texts (compared without outer blanks) to null."""
    cols = list(cols or text_columns(df))
    return df.withColumns({c: F.when(~F.trim(q(c)).isin(*tokens), q(c)) for c in cols})


def to_number(df: DataFrame, cols: Sequence[str], flag: bool = True) -> DataFrame:
    """Text to double. What does not parse becomes null, marked in ``<c>_bad``."""
    out = {}
    for c in cols:
        value = F.expr(f"try_cast(`{c}` as double)")
        out[c] = value
        if flag:
            out[f"{c}_bad"] = q(c).isNotNull() & value.isNull()
    return df.withColumns(out)


def to_timestamp_multi(df: DataFrame, col: str, formats: Sequence[str], name: str | None = None) -> DataFrame:
    """Text to timestamp by the first format that matches."""
    tries = [F.try_to_timestamp(q(col), F.lit(f)) for f in formats]
    return df.withColumn(name or col, F.coalesce(*tries).cast("timestamp_ntz"))


def to_boolean(
    df: DataFrame,
    cols: Sequence[str],
    true_set: Sequence[str] = ("true", "t", "yes", "y", "1"),
    false_set: Sequence[str] = ("false", "f", "no", "n", "0"),
) -> DataFrame:
    """Text to boolean; anything in neither set is null."""
    out = {}
    for c in cols:
        key = F.lower(F.trim(q(c).cast("string")))
        out[c] = F.when(key.isin(*true_set), True).when(key.isin(*false_set), False)
    return df.withColumns(out)


def level_table(df: DataFrame, col: str, levels: Sequence | None = None) -> DataFrame:
    """``(level, code)``: the given levels in their order, or the distinct values in theirs, from 0."""
    if levels is not None:
        pairs = [F.struct(F.lit(v).alias("level"), F.lit(i).cast("bigint").alias("code")) for i, v in enumerate(levels)]
        return df.sparkSession.range(1).select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
    distinct = df.select(q(col).alias("level")).where(F.col("level").isNotNull()).distinct()
    return global_index(distinct, ["level"], "code")


def to_category(df: DataFrame, col: str, levels: Sequence | None = None, name: str | None = None) -> DataFrame:
    """Text to a dictionary code; values outside ``levels`` are null."""
    table = level_table(df, col, levels)
    return df.join(table, q(col) == F.col("level"), "left").drop("level").withColumnRenamed("code", name or f"{col}_code")


def normalise_whitespace(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Tabs and runs of blanks to one blank, none at the ends."""
    cols = list(cols or text_columns(df))
    return df.withColumns({c: F.trim(F.regexp_replace(q(c), r"\s+", " ")) for c in cols})


def normalise_case(df: DataFrame, cols: Sequence[str] | None = None, how: str = "lower") -> DataFrame:
    change = {"upper": F.upper, "lower": F.lower, "title": F.initcap}[how]
    cols = list(cols or text_columns(df))
    return df.withColumns({c: change(q(c)) for c in cols})


def repair_categories(
    df: DataFrame,
    col: str,
    vocab: Sequence[str] | None = None,
    max_dist: int = 2,
    min_share: float = 0.01,
    name: str | None = None,
) -> DataFrame:
    """Map rare values to the closest vocabulary value within ``max_dist`` edits.

    The vocabulary is given (its words need not occur), or is the values with at least ``min_share`` of the rows. Ties
    go to the more frequent value, then to the alphabetically first. A value that only
    differs by look-alike characters counts as distance 0. The work is done on distinct
    values, and candidates come from an equi-join on whole parts of the values.
    """
    counts = df.where(q(col).isNotNull()).groupBy(q(col).alias("value")).agg(F.count("*").alias("n"))
    if vocab is not None:
        good = F.col("value").isin(*vocab)
    else:
        total = counts.agg(F.sum("n").alias("t")).scalar()
        good = F.col("n") >= F.lit(min_share) * total
    if vocab is not None:
        listed = df.sparkSession.createDataFrame([(v,) for v in dict.fromkeys(vocab)], "target string")
        seen = counts.select(F.col("value").alias("target"), "n")
        frequent = listed.join(seen, "target", "left").select("target", F.coalesce("n", F.lit(0)).alias("target_n"))
    else:
        frequent = counts.where(good).select(F.col("value").alias("target"), F.col("n").alias("target_n"))
    plain = F.col("value")
    for look, letter in LOOKALIKES.items():
        # a look-alike between capitals stands for a capital
        capital = F.regexp_replace(plain, f"(?<=[A-Z]){re.escape(look)}(?![a-z])|{re.escape(look)}(?=[A-Z])", letter.upper())
        plain = F.replace(capital, F.lit(look), F.lit(letter))
    rare = counts.where(~good).select("value", plain.alias("plain"))
    forms = rare.select("value", F.explode(F.array_distinct(F.array("value", "plain"))).alias("form"))
    pairs = close_pairs(forms.select("form").distinct(), "form", frequent.select("target"), "target", max_dist)
    best = F.min(F.struct("distance", (-F.col("target_n")).alias("neg"), "target")).alias("b")
    mapping = (
        forms.join(pairs, "form")
        .join(frequent, "target")
        .groupBy("value")
        .agg(best)
        .select(F.col("value").alias("_value"), F.col("b.target").alias("_fixed"))
    )
    joined = df.join(mapping, q(col) == F.col("_value"), "left")
    fixed = F.coalesce(F.col("_fixed"), q(col))
    return joined.withColumn(name or col, fixed).drop("_value", "_fixed")


def check_ranges(df: DataFrame, ranges: Mapping[str, tuple], action: str = "flag") -> DataFrame:
    """Values outside ``(low, high)``: ``flag`` in ``<c>_out_of_range``, ``null`` or ``clip``."""
    out = {}
    for c, (low, high) in ranges.items():
        outside = F.coalesce(~q(c).between(F.lit(low), F.lit(high)), F.lit(False))
        if action == "flag":
            out[f"{c}_out_of_range"] = outside
        elif action == "null":
            out[c] = F.when(~outside, q(c))
        elif action == "clip":
            out[c] = F.when(q(c).isNotNull(), F.least(F.greatest(q(c), F.lit(low)), F.lit(high)))
        else:
            raise ValueError(f"unknown action {action!r}")
    return df.withColumns(out)


def check_dates(df: DataFrame, col: str, low: str, high: str, fmt: str = "yyyy-MM-dd") -> DataFrame:
    """Add ``<c>_issue``: ``future``, ``very_old``, ``partial`` (digits only), ``unparsed`` or null."""
    day = F.try_to_timestamp(q(col), F.lit(fmt)).cast("date")
    issue = (
        F.when(q(col).isNull(), F.lit(None).cast("string"))
        .when(q(col).rlike(r"^\d{1,4}$"), "partial")
        .when(day.isNull(), "unparsed")
        .when(day > F.to_date(F.lit(high)), "future")
        .when(day < F.to_date(F.lit(low)), "very_old")
    )
    return df.withColumn(f"{col}_issue", issue)


def value_shape(col: Column) -> Column:
    """integer, float, date, boolean, text or empty: what a text value looks like."""
    v = F.trim(col)
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when(v == "", "empty")
        .when(v.rlike(r"^[+-]?[0-9]+$"), "integer")
        .when(v.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]+(\.[0-9]*)?[eE][+-]?[0-9]+)$"), "float")
        .when(v.rlike(r"^([0-9]{4}[-/][0-9]{2}[-/][0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4})"), "date")
        .when(F.lower(v).isin("true", "false"), "boolean")
        .otherwise("text")
    )


def detect_mixed_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """``(data_field_name, shape, n)``: how many values of each text column look like what."""
    cols = list(cols or text_columns(df))
    cells = [F.struct(F.lit(c).alias("data_field_name"), value_shape(q(c)).alias("shape")) for c in cols]
    long = df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").where(F.col("shape").isNotNull())
    return long.groupBy("data_field_name", "shape").agg(F.count("*").alias("n"))


def fix_encoding(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Undo UTF-8 read as Latin-1 by the fixed table; ``<c>_lossy`` flags lost characters (U+FFFD)."""
    out = {}
    for c in cols:
        fixed = reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), MOJIBAKE.items(), q(c))
        out[c] = fixed
        out[f"{c}_lossy"] = F.contains(q(c), F.lit("�"))
    return df.withColumns(out)


def validate_schema(df: DataFrame, expected: Mapping[str, str]) -> DataFrame:
    """Add ``invalid_columns``: names whose value is present but does not cast to the expected type."""
    bad = [
        F.when(q(c).isNotNull() & F.expr(f"try_cast(`{c}` as {t})").isNull(), F.lit(c)) for c, t in expected.items()
    ]
    return df.withColumn("invalid_columns", F.array_compact(F.array(*bad)))
