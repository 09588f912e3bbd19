"""Column profiles: what is in this table?"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import (
    FLOATING,
    INTEGRAL,
    NUMERIC,
    TEMPORAL,
    as_list,
    field_type,
    is_missing,
    join_on,
    numeric_columns,
    present,
    q,
    temporal_columns,
    with_stats,
)
from ..functions.quantiles import quantile_table
from ..functions.scale import checkpointed

# Codes of the physical type families, in fingerprint order.
FAMILY_CODES = {
    "bool": "OBO",
    "datetime": "ODT",
    "timedelta": "ODT",
    "numeric": "NCO",
    "category": "CBI",
    "string": "OTX",
    "object": "OTX",
    "None": "OUK",
}

# Codes of the semantic parents and children, in fingerprint order.
PARENT_CODES = {"numerical": "N", "categorical": "C", "others": "O"}
CHILD_CODES = {
    "continuous": "NC",
    "discrete": "ND",
    "nominal": "NN",
    "ordinal": "NO",
    "binary-label": "CB",
    "multi-label": "CM",
    "datetime": "OD",
    "geospatial": "OG",
    "text": "OT",
    "boolean": "OB",
    "identifier": "OI",
}

SUMMARY_SCHEMA = (
    "data_field_name string, data_type string, null_counts bigint, unique_counts bigint, "
    "mean double, min double, max double"
)
FACT_COLUMNS = ["data_field_name", "data_type", "description", "data_type_category", "data_type_subcategory"]


def _rows_from(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """Turn one wide aggregate row into one row per column of the profiled table."""
    return row.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def _counts_of(df: DataFrame, col: str) -> DataFrame:
    """``(value, n)`` of one column, in its own type. A columnar source reads this column only."""
    return df.select(present(df, col).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count("*").alias("n")
    )


def _per_column(df: DataFrame, cols: Sequence[str], aggs: Sequence[Column]) -> DataFrame:
    """The aggregates over the value counts of each column, one row per column.

    Every column is an independent branch of one query. Together they read each column once,
    and no row is multiplied by the number of columns, as it would be in a long table.
    """
    parts = [_counts_of(df, c).agg(*aggs).withColumn("data_field_name", F.lit(c)) for c in cols]
    return reduce(DataFrame.unionByName, parts)


def null_counts(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or df.columns)
    row = df.agg(*[F.count(F.when(is_missing(df, c), 1)).alias(f"n{i}") for i, c in enumerate(cols)])
    return _rows_from(
        row,
        [F.struct(F.lit(c).alias("data_field_name"), F.col(f"n{i}").alias("null_counts")) for i, c in enumerate(cols)],
    )


def missing_report(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column: is anything missing, how much, and what share."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.when(is_missing(df, c), 1)).alias(f"n{i}") for i, c in enumerate(cols)]
    row = df.agg(F.count("*").alias("rows"), *aggs)
    structs = [
        F.struct(
            F.lit(c).alias("data_field_name"),
            (F.col(f"n{i}") > 0).alias("has_missing"),
            F.col(f"n{i}").alias("missing_count"),
            F.try_divide(F.col(f"n{i}"), F.col("rows")).alias("missing_fraction"),
        )
        for i, c in enumerate(cols)
    ]
    return _rows_from(row, structs)


def unique_counts(df: DataFrame, cols: Sequence[str] | None = None, approx: bool = False) -> DataFrame:
    """Distinct non-missing values per column; ``approx`` uses one HyperLogLog pass."""
    cols = list(cols or df.columns)
    if approx:
        row = df.agg(*[F.approx_count_distinct(present(df, c), 0.02).alias(f"n{i}") for i, c in enumerate(cols)])
        structs = [
            F.struct(F.lit(c).alias("data_field_name"), F.col(f"n{i}").alias("unique_counts"))
            for i, c in enumerate(cols)
        ]
        return _rows_from(row, structs)
    return _per_column(df, cols, [F.count("*").alias("unique_counts")]).select("data_field_name", "unique_counts")


def profile_summary(df: DataFrame, cols: Sequence[str] | None = None, distinct: str = "exact") -> DataFrame:
    """One row per column: type, nulls, distinct values (text, boolean), mean/min/max (numeric).

    Null counts and statistics of all columns come from one scan. Exact distinct counts
    add one shuffle over the values of the non-numeric columns; ``distinct='approx'`` does
    without it.
    """
    cols = list(cols or df.columns)
    numeric = set(numeric_columns(df, cols))
    timed = set(temporal_columns(df, cols))
    # Maps cannot be compared, so they have no distinct count.
    labels = [c for c in cols if c not in numeric and c not in timed and not isinstance(field_type(df, c), T.MapType)]
    aggs: list[Column] = []
    structs: list[Column] = []
    nothing = F.lit(None)
    for i, c in enumerate(cols):
        aggs.append(F.count(F.when(is_missing(df, c), 1)).alias(f"null{i}"))
        if c in numeric:
            x = present(df, c).cast("double")
            aggs += [F.avg(x).alias(f"avg{i}"), F.min(x).alias(f"min{i}"), F.max(x).alias(f"max{i}")]
        elif distinct == "approx" and c in labels:
            aggs.append(F.approx_count_distinct(q(c), 0.02).alias(f"uniq{i}"))
        is_num = c in numeric
        structs.append(
            F.struct(
                F.lit(c).alias("data_field_name"),
                F.lit(field_type(df, c).simpleString()).alias("data_type"),
                F.col(f"null{i}").alias("null_counts"),
                (F.col(f"uniq{i}") if distinct == "approx" and c in labels else nothing)
                .cast("bigint")
                .alias("unique_counts"),
                (F.col(f"avg{i}") if is_num else nothing).cast("double").alias("mean"),
                (F.col(f"min{i}") if is_num else nothing).cast("double").alias("min"),
                (F.col(f"max{i}") if is_num else nothing).cast("double").alias("max"),
            )
        )
    summary = _rows_from(df.agg(*aggs), structs)
    if distinct == "approx" or not labels:
        return summary
    exact = unique_counts(df, labels).withColumnRenamed("unique_counts", "_exact")
    return (
        summary.join(exact, "data_field_name", "left")
        .withColumn("unique_counts", F.coalesce("unique_counts", "_exact"))
        .drop("_exact")
    )


def describe_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Descriptive statistics of every column: numeric moments and quartiles, top value of the rest."""
    cols = list(cols or df.columns)
    numeric = numeric_columns(df, cols)
    labels = [c for c in cols if c not in numeric and not isinstance(field_type(df, c), T.MapType)]
    aggs = [F.count(present(df, c)).alias(f"n{i}") for i, c in enumerate(cols)]
    for i, c in enumerate(cols):
        if c in numeric:
            x = present(df, c).cast("double")
            aggs += [
                F.avg(x).alias(f"avg{i}"),
                F.stddev_samp(x).alias(f"sd{i}"),
                F.min(x).alias(f"min{i}"),
                F.max(x).alias(f"max{i}"),
            ]
    row = df.agg(*aggs)
    if numeric:
        row = with_stats(row, quantile_table(df, {c: [0.25, 0.5, 0.75] for c in numeric}), "_q")
    nothing = F.lit(None).cast("double")
    structs = []
    for i, c in enumerate(cols):
        num = c in numeric
        structs.append(
            F.struct(
                F.lit(c).alias("data_field_name"),
                F.col(f"n{i}").alias("count"),
                (F.col(f"avg{i}") if num else nothing).alias("mean"),
                (F.col(f"sd{i}") if num else nothing).alias("std"),
                (F.col(f"min{i}") if num else nothing).alias("min"),
                *[(F.col("_q")[c][k] if num else nothing).alias(n) for k, n in enumerate(("p25", "p50", "p75"))],
                (F.col(f"max{i}") if num else nothing).alias("max"),
            )
        )
    stats = _rows_from(row, structs)
    if not labels:
        return stats.select(
            "data_field_name", "count", F.lit(None).cast("bigint").alias("unique"),
            F.lit(None).cast("string").alias("top"), F.lit(None).cast("bigint").alias("freq"),
            *stats.columns[2:],
        )
    best = F.min(F.struct((-F.col("n")).alias("neg"), F.col("value").cast("string").alias("value")))
    tops = _per_column(df, labels, [F.count("*").alias("unique"), best.alias("b")])
    tops = tops.select("data_field_name", "unique", F.col("b.value").alias("top"), (-F.col("b.neg")).alias("freq"))
    return stats.join(tops, "data_field_name", "left").select(
        "data_field_name", "count", "unique", "top", "freq", *stats.columns[2:]
    )


def profile_temporal(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Nulls, first, last and mean instant, and span in days of date and timestamp columns."""
    cols = list(cols or temporal_columns(df))
    aggs, structs = [], []
    for i, c in enumerate(cols):
        us = F.unix_micros(q(c).cast("timestamp"))
        aggs += [
            F.count(F.when(q(c).isNull(), 1)).alias(f"null{i}"),
            F.count(q(c)).alias(f"n{i}"),
            F.min(us).alias(f"lo{i}"),
            F.max(us).alias(f"hi{i}"),
            F.sum(us.cast("decimal(38,0)")).alias(f"sum{i}"),
        ]
        mean = F.floor(F.try_divide(F.col(f"sum{i}"), F.col(f"n{i}").cast("decimal(20,0)"))).cast("bigint")
        instant = lambda x: F.timestamp_micros(x).cast("timestamp_ntz")
        structs.append(
            F.struct(
                F.lit(c).alias("data_field_name"),
                F.col(f"null{i}").alias("null_counts"),
                instant(F.col(f"lo{i}")).alias("first"),
                instant(F.col(f"hi{i}")).alias("last"),
                instant(mean).alias("mean"),
                ((F.col(f"hi{i}") - F.col(f"lo{i}")) / F.lit(86_400_000_000.0)).alias("span_days"),
            )
        )
    return _rows_from(df.agg(*aggs), structs)


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, (*TEMPORAL, T.DayTimeIntervalType)):
        return "datetime"
    if isinstance(kind, NUMERIC):
        return "numeric"
    if isinstance(kind, T.StringType):
        return "string"
    return "None"


def _pandas_name(kind: T.DataType) -> str:
    """The dtype label pandas would show for the column."""
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, INTEGRAL):
        return {T.ByteType: "int8", T.ShortType: "int16", T.IntegerType: "int32"}.get(type(kind), "int64")
    if isinstance(kind, FLOATING):
        return "float32" if isinstance(kind, T.FloatType) else "float64"
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return "datetime64[ns]"
    if isinstance(kind, T.DayTimeIntervalType):
        return "timedelta64[ns]"
    return "object"


def pattern_code(schema: T.StructType, mode: str = "canonical") -> str:
    """The type fingerprint of a schema.

    ``canonical`` counts columns per type family. ``reference`` counts exact dtype labels
    in first-seen order and appends the unseen families with 0, so that labels which are
    not family names (``int64``, ``float64`` ...) drop out.
    """
    kinds = [f.dataType for f in schema.fields]
    if mode == "reference":
        counts: dict[str, int] = {}
        for kind in kinds:
            counts[_pandas_name(kind)] = counts.get(_pandas_name(kind), 0) + 1
        for family in FAMILY_CODES:
            counts.setdefault(family, 0)
        return "".join(f"{FAMILY_CODES[k]}{n}" for k, n in counts.items() if k in FAMILY_CODES)
    totals = dict.fromkeys(FAMILY_CODES.values(), 0)
    for kind in kinds:
        totals[FAMILY_CODES[_family(kind)]] += 1
    return "".join(f"{code}{n}" for code, n in totals.items())


def field_pattern(df: DataFrame, mode: str = "canonical") -> DataFrame:
    """The fingerprint of the table's schema with its row count, as one row."""
    return df.agg(F.lit(pattern_code(df.schema, mode)).alias("field_pattern"), F.count("*").alias("n_rows"))


def field_pattern_from_facts(
    facts: DataFrame, group_by: Sequence[str] | str | None = None, order_by: str | None = None
) -> DataFrame:
    """Semantic fingerprint of fact tables: parent counts, then child counts.

    Where a field name occurs twice in a group the row with the largest ``order_by`` wins.
    Codes are counted by conditional sums, so no list is gathered.
    """
    keys = as_list(group_by)
    pair = F.struct("data_type_category", "data_type_subcategory")
    rank = q(order_by) if order_by else pair
    last = facts.groupBy(*keys, "data_field_name").agg(F.max_by(pair, rank).alias("p"))
    aggs = [
        F.count(F.when(F.col("p.data_type_category") == name, 1)).alias(f"p_{code}")
        for name, code in PARENT_CODES.items()
    ] + [
        F.count(F.when(F.col("p.data_type_subcategory") == name, 1)).alias(f"c_{code}")
        for name, code in CHILD_CODES.items()
    ]
    parts = []
    for code in PARENT_CODES.values():
        parts += [F.lit(code), F.col(f"p_{code}").cast("string")]
    for code in CHILD_CODES.values():
        parts += [F.lit(code), F.col(f"c_{code}").cast("string")]
    return last.groupBy(*keys).agg(*aggs).select(*keys, F.concat(*parts).alias("field_pattern"))


def classify_columns(df: DataFrame, dictionary: DataFrame | None = None, cols: Sequence[str] | None = None) -> DataFrame:
    """Semantic class of every column by rules over its statistics.

    ``dictionary`` (``data_field_name, description``) supplies descriptions.
    """
    cols = list(cols or df.columns)
    date = F.try_to_date if hasattr(F, "try_to_date") else F.to_date
    aggs = [F.count("*").alias("rows")]
    for i, c in enumerate(cols):
        kind = field_type(df, c)
        aggs.append(F.count(F.when(is_missing(df, c), 1)).alias(f"null{i}"))
        if isinstance(kind, T.StringType):
            shaped = q(c).rlike(r"^\d{4}-\d{2}-\d{2}([ T].*)?$")
            parsed = date(F.when(shaped, F.substring(q(c), 1, 10)), "yyyy-MM-dd").isNotNull()
            aggs += [F.avg(F.when(~is_missing(df, c), parsed.cast("double"))).alias(f"date{i}"), F.avg(F.length(q(c))).alias(f"len{i}")]
        elif isinstance(kind, NUMERIC):
            x = present(df, c).cast("double")
            aggs.append(F.max(F.abs(x)).alias(f"abs{i}"))
    row = df.agg(*aggs)
    structs = []
    for i, c in enumerate(cols):
        kind = field_type(df, c)
        text, number = isinstance(kind, T.StringType), isinstance(kind, NUMERIC)
        structs.append(
            F.struct(
                F.lit(c).alias("data_field_name"),
                F.lit(kind.simpleString()).alias("data_type"),
                F.col("rows"),
                F.col(f"null{i}").alias("nulls"),
                (F.col(f"date{i}") if text else F.lit(None)).cast("double").alias("date_share"),
                (F.col(f"len{i}") if text else F.lit(None)).cast("double").alias("avg_len"),
                (F.col(f"abs{i}") if number else F.lit(None)).cast("double").alias("max_abs"),
                F.lit(isinstance(kind, T.BooleanType)).alias("is_bool"),
                F.lit(isinstance(kind, TEMPORAL)).alias("is_time"),
                F.lit(text).alias("is_text"),
                F.lit(isinstance(kind, INTEGRAL)).alias("is_int"),
                F.lit(number).alias("is_number"),
            )
        )
    plain = [c for c in cols if isinstance(field_type(df, c), (T.StringType, *NUMERIC, T.BooleanType))]
    stats = _rows_from(row, structs)
    if plain:
        stats = stats.join(unique_counts(df, plain), "data_field_name", "left")
    else:
        stats = stats.withColumn("unique_counts", F.lit(0).cast("bigint"))
    distinct, rows = F.col("unique_counts"), F.col("rows")
    geo = F.lower("data_field_name").rlike(r"(^|_)(lat|lon|lng|geo|latitude|longitude)($|_)")
    rules = [
        (F.col("is_bool"), "others", "boolean"),
        (F.col("is_time"), "others", "datetime"),
        (F.col("is_text") & (F.col("date_share") >= 0.95), "others", "datetime"),
        ((F.col("is_text") | F.col("is_int")) & (F.col("nulls") == 0) & (distinct == rows), "others", "identifier"),
        (F.col("is_number") & geo & (F.col("max_abs") <= 180), "others", "geospatial"),
        ((F.col("is_text") | F.col("is_number")) & (distinct == 2), "categorical", "binary-label"),
        (F.col("is_text") & (distinct <= 20), "categorical", "multi-label"),
        (F.col("is_text") & ((F.col("avg_len") > 50) | (distinct > rows * 0.5)), "others", "text"),
        (F.col("is_text"), "numerical", "nominal"),
        (F.col("is_int") & (distinct <= 10), "numerical", "ordinal"),
        (F.col("is_int"), "numerical", "discrete"),
        (F.col("is_number"), "numerical", "continuous"),
    ]
    verdict = F.lit(None)
    for cond, parent, child in reversed(rules):
        pair = F.struct(F.lit(parent).alias("parent"), F.lit(child).alias("child"))
        verdict = F.when(cond, pair).otherwise(verdict)
    facts = stats.withColumn("_v", verdict).select(
        "data_field_name",
        "data_type",
        F.col("_v.parent").alias("data_type_category"),
        F.col("_v.child").alias("data_type_subcategory"),
    )
    if dictionary is None:
        facts = facts.withColumn("description", F.lit(None).cast("string"))
    else:
        facts = facts.join(dictionary.select("data_field_name", "description"), "data_field_name", "left")
    return facts.select(*FACT_COLUMNS)


def detect_nested(df: DataFrame, cols: Sequence[str] | None = None, share: float = 0.9) -> DataFrame:
    """``(data_field_name, nested)``: nested types, or text that is mostly JSON objects or arrays."""
    cols = list(cols or df.columns)
    aggs, structs = [], []
    for i, c in enumerate(cols):
        kind = field_type(df, c)
        if isinstance(kind, T.StringType):
            shaped = q(c).rlike(r"^\s*[{\[]")
            ok = F.try_parse_json(F.when(shaped, q(c))).isNotNull()
            aggs.append(F.avg(F.when(q(c).isNotNull(), ok.cast("double"))).alias(f"j{i}"))
            nested = F.coalesce(F.col(f"j{i}") >= share, F.lit(False))
        else:
            nested = F.lit(isinstance(kind, (T.StructType, T.ArrayType, T.MapType)))
        structs.append(F.struct(F.lit(c).alias("data_field_name"), nested.alias("nested")))
    return _rows_from(df.agg(F.count("*").alias("_n"), *aggs), structs)


def missingness_patterns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows per null bitmap over ``cols`` (1 = missing), in the order of ``cols``."""
    bits = F.concat(*[F.when(is_missing(df, c), "1").otherwise("0") for c in cols])
    return df.groupBy(bits.alias("pattern")).agg(F.count("*").alias("n_rows"))


def missingness_correlation(df: DataFrame, cols: Sequence[str], against: Sequence[str]) -> DataFrame:
    """Correlation of each null flag with each numeric column: near 0 hints at MCAR, else MAR."""
    pairs = [(a, b) for a in cols for b in against if a != b]
    row = df.agg(
        *[
            F.corr(is_missing(df, a).cast("double"), present(df, b).cast("double")).alias(f"r{i}")
            for i, (a, b) in enumerate(pairs)
        ]
    )
    structs = [
        F.struct(F.lit(a).alias("missing_column"), F.lit(b).alias("against"), F.col(f"r{i}").alias("corr"))
        for i, (a, b) in enumerate(pairs)
    ]
    return _rows_from(row, structs)


def candidate_keys(df: DataFrame, cols: Sequence[str] | None = None, max_arity: int = 2) -> DataFrame:
    """For columns and column pairs: distinct values, rows with a null, and whether they form a key.

    Single columns are counted first. A set that holds a column without repeated values has as many values
    as rows without a null, so all such sets share one scan; only the others are grouped.
    """
    cols = list(cols or df.columns)
    null_of = lambda combo: _any([is_missing(df, c) for c in combo])

    def grouped(combo: Sequence[str]) -> DataFrame:
        null = null_of(combo)
        return df.groupBy(*combo).agg(F.count("*").alias("n")).agg(
            F.count(F.when(~null, 1)).alias("distinct_values"),
            F.coalesce(F.sum(F.when(null, F.col("n"))), F.lit(0)).alias("rows_with_null"),
            F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        ).withColumn("columns", F.lit(",".join(combo)))

    singles = checkpointed(reduce(DataFrame.unionByName, [grouped([c]) for c in cols]))
    unique = {r["columns"] for r in singles.where(F.col("distinct_values") + F.col("rows_with_null") == F.col("n_rows")).collect()}
    more = [c for k in range(2, max_arity + 1) for c in combinations(cols, k)]
    parts = [singles, *(grouped(c) for c in more if not unique & set(c))]
    known = [c for c in more if unique & set(c)]
    if known:
        row = df.agg(F.count("*").alias("n_rows"), *[F.count(F.when(null_of(c), 1)).alias(f"null{i}") for i, c in enumerate(known)])
        structs = [
            F.struct(
                (F.col("n_rows") - F.col(f"null{i}")).alias("distinct_values"),
                F.col(f"null{i}").alias("rows_with_null"),
                "n_rows",
                F.lit(",".join(c)).alias("columns"),
            )
            for i, c in enumerate(known)
        ]
        parts.append(_rows_from(row, structs))
    out = reduce(DataFrame.unionByName, parts)
    is_key = (F.col("rows_with_null") == 0) & (F.col("distinct_values") == F.col("n_rows"))
    return out.withColumn("is_key", is_key)


def _any(conds: Sequence[Column]) -> Column:
    out = conds[0]
    for c in conds[1:]:
        out = out | c
    return out


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each group of identical rows (null equals null)."""
    groups = df.groupBy(*df.columns).agg(F.count("*").alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"))


def degradation_report(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(metric, column, clean, dirty)``: shape, missing values, duplicates and types, side by side.

    Columns are those of ``before``; one that ``after`` lacks has a null on that side.
    """

    def side(df: DataFrame, name: str) -> DataFrame:
        spark = df.sparkSession
        text = lambda c: c.cast("string").alias(name)
        missing = null_counts(df).select(
            F.lit("missing_values").alias("metric"), F.col("data_field_name").alias("column"), text(F.col("null_counts"))
        )
        dups = duplicate_count(df).select(
            F.lit("duplicates").alias("metric"), F.lit("").alias("column"), text(F.col("duplicate_rows"))
        )
        rows = df.agg(F.count("*").alias("n")).select(
            F.lit("rows").alias("metric"), F.lit("").alias("column"), text(F.col("n"))
        )
        static = [F.struct(F.lit("columns").alias("metric"), F.lit("").alias("column"), F.lit(str(len(df.columns))).alias(name))]
        static += [
            F.struct(F.lit("type").alias("metric"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias(name))
            for f in df.schema.fields
        ]
        fixed = spark.range(1).select(F.explode(F.array(*static)).alias("r")).select("r.*")
        return missing.unionByName(dups).unionByName(rows).unionByName(fixed)

    clean, dirty = side(before, "clean"), side(after, "dirty")
    return clean.join(dirty, ["metric", "column"], "left")
