"""Reproducible damage to clean tables, for testing cleaning steps.

Which rows are hit depends only on the key columns, the damaged column and the seed: by
default every row whose hash lies below the rate, with ``exact=True`` exactly
``int(rows * rate)`` rows, those with the smallest hashes.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import (
    FLOATING,
    INTEGRAL,
    as_list,
    field_type,
    hash32,
    numeric_columns,
    present,
    q,
    text_columns,
    unit_hash,
    with_stats,
)
from ..functions.quantiles import quantile_struct

# Texts written over numbers, in this order.
BAD_TOKENS = ["N/A", "NULL", "unknown", "#ERROR", "--", "n/a", "UNKNOWN", "na", ""]

# The order in which kinds of damage are applied.
DEFAULT_ORDER = [
    "missing_values",
    "type_inconsistency",
    "whitespace_issues",
    "categorical_typos",
    "formatting_issues",
    "outliers",
    "range_violations",
    "date_inconsistency",
    "duplicates",
]


class _Chooser:
    """Hash choices for the rows of one table."""

    def __init__(self, df: DataFrame, key: Sequence[str] | str, seed: int):
        self.df, self.keys, self.seed = df, as_list(key), seed

    def unit(self, tag: str) -> Column:
        return unit_hash(self.keys, tag, self.seed)

    def pick(self, tag: str, n: int) -> Column:
        """0 to n-1."""
        return F.pmod(hash32(self.keys, tag, self.seed), F.lit(n)).cast("int")

    def between(self, tag: str, low: float, high: float) -> Column:
        return F.lit(float(low)) + self.unit(tag) * F.lit(float(high) - float(low))

    def hit(self, tag: str, rate: float, among: Column | None = None) -> Column:
        chosen = self.unit(tag) < F.lit(float(rate))
        return chosen if among is None else chosen & F.coalesce(among, F.lit(False))


def _apply(
    df: DataFrame, key, seed: int, rate: float, exact: bool, changes: Mapping[str, tuple[str, Column | None, Column]]
) -> DataFrame:
    """Replace each column by its change where the column's tag hits.

    ``changes``: column -> (tag, candidates or None for all rows, new value).
    """
    choose = _Chooser(df, key, seed)
    if not exact:
        new = {c: F.when(choose.hit(tag, rate, among), value).otherwise(q(c)) for c, (tag, among, value) in changes.items()}
        return df.withColumns(new)
    n = int(df.count() * rate)
    new = {}
    for c, (tag, among, value) in changes.items():
        pool = df if among is None else df.where(F.coalesce(among, F.lit(False)))
        hit = choose.unit(tag) <= F.lit(_nth_smallest(pool, choose.unit(tag), n))
        new[c] = F.when(hit if among is None else hit & F.coalesce(among, F.lit(False)), value).otherwise(q(c))
    return df.withColumns(new)


def _nth_smallest(df: DataFrame, unit: Column, n: int) -> float:
    """The n-th smallest of hashes from 0 to 1; below all of them for n = 0, their largest if there are fewer.

    Counts per slice find the slice, counts of the hashes inside it the value: 32-bit hashes make at most
    2**16 of either. Rows with equal keys have equal hashes and are chosen together.
    """
    if n <= 0:
        return -1.0
    left, at = n, None
    for cell in (F.floor(unit * (1 << 16)), unit):
        part = df if at is None else df.where(F.floor(unit * (1 << 16)) == at)
        for row in part.groupBy(cell.alias("at")).agg(F.count("*").alias("n")).orderBy("at").toLocalIterator():
            at = row["at"]
            if row["n"] >= left:
                break
            left -= row["n"]
        if at is None:
            return -1.0
    return float(at)


def corrupt_missing(
    df: DataFrame,
    key: Sequence[str] | str,
    cols: Sequence[str] | None = None,
    rate: float = 0.10,
    pattern: str = "random",
    reference: str | None = None,
    seed: int = 42,
    exact: bool = False,
) -> DataFrame:
    """Values to null. ``random`` and ``mcar``: anywhere. ``mar``: where ``reference`` exceeds its median
    (no effect if it is not numeric). ``mnar``: where the column itself exceeds its 75th percentile.

    As the rate is a share of all rows and only some are candidates, the hash threshold is
    the rate over the candidates' share, at most 1.
    """
    cols = [c for c in (cols or _float_or_text(df, key)) if c in df.columns]
    gone = F.lit(None)
    if pattern in ("random", "mcar"):
        return _apply(df, key, seed, rate, exact, {c: (f"missing:{c}", None, gone) for c in cols})
    if pattern == "mar":
        if reference is None or reference not in numeric_columns(df):
            return df
        probs, share = {reference: [0.5]}, 0.5
        above = lambda c: present(df, reference) > F.col("_s").getField(f"{reference}_q0")
        hit_cols = cols
    elif pattern == "mnar":
        hit_cols = numeric_columns(df, cols)
        if not hit_cols:
            return df
        probs, share = {c: [0.75] for c in hit_cols}, 0.25
        above = lambda c: present(df, c) > F.col("_s").getField(f"{c}_q0")
    else:
        raise ValueError(f"unknown pattern {pattern!r}")
    scaled = rate if exact else min(1.0, rate / share)
    staged = with_stats(df, quantile_struct(df, probs), "_s")
    changes = {c: (f"missing:{c}", above(c), gone) for c in hit_cols}
    if not exact:
        return _apply(staged, key, seed, scaled, False, changes).drop("_s")
    return _apply(staged, key, seed, rate, True, changes).drop("_s")


def _float_or_text(df: DataFrame, key) -> list[str]:
    keys = as_list(key)
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, (*FLOATING, T.StringType)) and f.name not in keys
    ]


def corrupt_duplicates(
    df: DataFrame, key: Sequence[str] | str, rate: float = 0.05, type_: str = "exact", seed: int = 42, exact: bool = False
) -> DataFrame:
    """Append copies of rows: ``exact``; ``partial`` with noise N(0, 1) on every number but the keys;
    ``delayed`` with the first timestamp 1 to 7 days later (no effect without one)."""
    choose = _Chooser(df, key, seed)
    if exact:
        least = _nth_smallest(df, choose.unit("duplicate"), int(df.count() * rate))
        extra = df.where(choose.unit("duplicate") <= F.lit(least))
    else:
        extra = df.where(choose.hit("duplicate", rate))
    if type_ == "exact":
        return df.unionByName(extra)
    if type_ == "partial":
        noise = {}
        for c in numeric_columns(df):
            if c in choose.keys:
                continue
            # Box-Muller: two uniform hashes to one normal number.
            u, v = F.greatest(choose.unit(f"u:{c}"), F.lit(1e-12)), choose.unit(f"v:{c}")
            bump = F.sqrt(-2 * F.log(u)) * F.cos(2 * F.pi() * v)
            noise[c] = q(c).cast("double") + bump
        wide = df.withColumns({c: q(c).cast("double") for c in noise})
        return wide.unionByName(extra.withColumns(noise))
    if type_ == "delayed":
        stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType))]
        if not stamps:
            return df
        days = 1 + choose.pick("delay", 7)
        later = q(stamps[0]) + F.make_dt_interval(days)
        return df.unionByName(extra.withColumn(stamps[0], later))
    raise ValueError(f"unknown kind of duplicate {type_!r}")


def corrupt_outliers(
    df: DataFrame,
    key: Sequence[str] | str,
    cols: Sequence[str] | None = None,
    rate: float = 0.02,
    method: str = "extreme",
    seed: int = 42,
    exact: bool = False,
) -> DataFrame:
    """Numbers to outliers: ``extreme`` max * U(5, 100); ``iqr`` Q3 + 3 IQR; ``impossible`` by column name:
    price and cost to -|max|, percentages to U(100, 1000), others to -|max| * U(1, 10)."""
    cols = [c for c in numeric_columns(df, [c for c in (cols or df.columns) if c in df.columns]) if c not in as_list(key)]
    choose = _Chooser(df, key, seed)
    wide = df.withColumns({c: q(c).cast("double") for c in cols})
    if method == "iqr":
        staged = with_stats(wide, quantile_struct(wide, {c: [0.25, 0.75] for c in cols}), "_s")
        s = F.col("_s")
        value = {c: s[f"{c}_q1"] + 3 * (s[f"{c}_q1"] - s[f"{c}_q0"]) for c in cols}
    elif method in ("extreme", "impossible"):
        staged = with_stats(wide, wide.agg(*[F.max(present(wide, c)).alias(c) for c in cols]), "_s")
        top = lambda c: F.col("_s").getField(c)
        value = {}
        for c in cols:
            low = c.lower()
            if method == "extreme":
                value[c] = top(c) * choose.between(f"size:{c}", 5, 100)
            elif "price" in low or "cost" in low:
                value[c] = -F.abs(top(c))
            elif "percentage" in low or "pct" in low:
                value[c] = choose.between(f"size:{c}", 100, 1000)
            else:
                value[c] = -F.abs(top(c)) * choose.between(f"size:{c}", 1, 10)
    else:
        raise ValueError(f"unknown method {method!r}")
    changes = {c: (f"outlier:{c}", None, value[c]) for c in cols}
    return _apply(staged, key, seed, rate, exact, changes).drop("_s")


def corrupt_types(
    df: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None, rate: float = 0.05, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Numeric columns become text, and some values one of the bad tokens."""
    cols = [c for c in (cols or numeric_columns(df)) if c in df.columns and c not in as_list(key)]
    choose = _Chooser(df, key, seed)
    tokens = F.array(*[F.lit(t) for t in BAD_TOKENS])
    text = df.withColumns({c: q(c).cast("string") for c in cols})
    changes = {c: (f"type:{c}", None, F.element_at(tokens, choose.pick(f"token:{c}", len(BAD_TOKENS)) + 1)) for c in cols}
    return _apply(text, key, seed, rate, exact, changes)


def _by_mode(mode: Column, options: Sequence[Column]) -> Column:
    out = options[-1]
    for i in reversed(range(len(options) - 1)):
        out = F.when(mode == i, options[i]).otherwise(out)
    return out


def corrupt_formatting(
    df: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None, rate: float = 0.10, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Texts to upper, lower or title case, padded, with doubled blanks, or stripped."""
    cols = [c for c in (cols or text_columns(df)) if c in df.columns and c not in as_list(key)]
    choose = _Chooser(df, key, seed)
    changes = {}
    for c in cols:
        x = q(c)
        options = [
            F.upper(x),
            F.lower(x),
            F.initcap(x),
            F.concat(F.lit(" "), x, F.lit(" ")),
            F.replace(x, F.lit(" "), F.lit("  ")),
            F.trim(x),
        ]
        changes[c] = (f"format:{c}", None, _by_mode(choose.pick(f"format mode:{c}", 6), options))
    return _apply(df, key, seed, rate, exact, changes)


def corrupt_ranges(
    df: DataFrame, key: Sequence[str] | str, ranges: Mapping[str, tuple], rate: float = 0.05, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Numbers to below the minimum or above the maximum by U(1, 100), half each."""
    choose = _Chooser(df, key, seed)
    ranges = {c: r for c, r in ranges.items() if c in df.columns}
    wide = df.withColumns({c: q(c).cast("double") for c in ranges})
    changes = {}
    for c, (low, high) in ranges.items():
        step = choose.between(f"range size:{c}", 1, 100)
        value = F.when(choose.unit(f"range side:{c}") > 0.5, F.lit(float(low)) - step).otherwise(F.lit(float(high)) + step)
        changes[c] = (f"range:{c}", None, value)
    return _apply(wide, key, seed, rate, exact, changes)


def corrupt_whitespace(
    df: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None, rate: float = 0.08, seed: int = 42, exact: bool = False
) -> DataFrame:
    """1 to 5 blanks before or after, a leading tab, blanks to tabs, or blanks doubled."""
    cols = [c for c in (cols or text_columns(df)) if c in df.columns and c not in as_list(key)]
    choose = _Chooser(df, key, seed)
    changes = {}
    for c in cols:
        x, pad = q(c), F.repeat(F.lit(" "), 1 + choose.pick(f"pad:{c}", 5))
        options = [
            F.concat(pad, x),
            F.concat(x, pad),
            F.concat(F.lit("\t"), x),
            F.replace(x, F.lit(" "), F.lit("\t")),
            F.replace(x, F.lit(" "), F.lit("  ")),
        ]
        changes[c] = (f"space:{c}", None, _by_mode(choose.pick(f"space mode:{c}", 5), options))
    return _apply(df, key, seed, rate, exact, changes)


def corrupt_dates(
    df: DataFrame, key: Sequence[str] | str, cols: Sequence[str] | None = None, rate: float = 0.05, seed: int = 42, exact: bool = False
) -> DataFrame:
    """Timestamps become text; some as dd/MM/yyyy, only one part, years ahead, years back, or with slashes."""
    stamps = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType))]
    cols = [c for c in (cols or stamps) if c in df.columns]
    choose = _Chooser(df, key, seed)
    full = "yyyy-MM-dd HH:mm:ss"
    changes, new = {}, {}
    for c in cols:
        at = q(f"_at_{c}")
        part = F.element_at(
            F.array(*[F.date_format(at, f) for f in ("yyyy", "MM", "dd")]), choose.pick(f"date part:{c}", 3) + 1
        )
        ahead = F.make_dt_interval(365 + choose.pick(f"date ahead:{c}", 3286))
        back = F.make_dt_interval(365 + choose.pick(f"date back:{c}", 9636))
        options = [
            F.date_format(at, "dd/MM/yyyy"),
            part,
            F.date_format(at + ahead, full),
            F.date_format(at - back, full),
            F.replace(F.date_format(at, full), F.lit("-"), F.lit("/")),
        ]
        new[f"_at_{c}"] = q(c).cast("timestamp_ntz")
        new[c] = F.date_format(q(c).cast("timestamp_ntz"), full)
        changes[c] = (f"date:{c}", None, _by_mode(choose.pick(f"date mode:{c}", 5), options))
    return _apply(df.withColumns(new), key, seed, rate, exact, changes).drop(*[f"_at_{c}" for c in cols])


def corrupt_categories(
    df: DataFrame,
    key: Sequence[str] | str,
    cols: Sequence[str] | None = None,
    rate: float = 0.05,
    seed: int = 42,
    exact: bool = False,
    scramble: bool = True,
) -> DataFrame:
    """Typos: e to 3, a to @, o to 0, last letter lost, a letter added, letters scrambled."""
    cols = [c for c in (cols or text_columns(df)) if c in df.columns and c not in as_list(key)]
    choose = _Chooser(df, key, seed)
    changes = {}
    for c in cols:
        x = q(c)
        letter = F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), choose.pick(f"letter:{c}", 26) + 1, F.lit(1))
        options = [
            F.replace(x, F.lit("e"), F.lit("3")),
            F.replace(x, F.lit("a"), F.lit("@")),
            F.replace(x, F.lit("o"), F.lit("0")),
            F.when(F.length(x) > 1, F.substring(x, F.lit(1), F.length(x) - 1)).otherwise(x),
            F.concat(x, letter),
        ]
        if scramble:
            salt = choose.unit(f"scramble:{c}").cast("string")
            letters = F.filter(F.split(x, ""), lambda s: s != "")
            tagged = F.transform(letters, lambda s, i: F.struct(F.md5(F.concat(salt, i.cast("string"))).alias("h"), s.alias("s")))
            options.append(F.array_join(F.transform(F.array_sort(tagged), lambda t: t["s"]), ""))
        changes[c] = (f"typo:{c}", None, _by_mode(choose.pick(f"typo mode:{c}", len(options)), options))
    return _apply(df, key, seed, rate, exact, changes)


_KINDS = {
    "missing_values": corrupt_missing,
    "type_inconsistency": corrupt_types,
    "whitespace_issues": corrupt_whitespace,
    "categorical_typos": corrupt_categories,
    "formatting_issues": corrupt_formatting,
    "outliers": corrupt_outliers,
    "range_violations": corrupt_ranges,
    "date_inconsistency": corrupt_dates,
    "duplicates": corrupt_duplicates,
}


def corrupt_table(
    df: DataFrame, key: Sequence[str] | str, specs: Mapping[str, Mapping], order: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Apply several kinds of damage in order, as one lazy plan. Kinds without a spec are skipped."""
    unknown = set(specs) - set(_KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of damage: {sorted(unknown)}")
    for kind in order or DEFAULT_ORDER:
        if kind in specs:
            df = _KINDS[kind](df, key, seed=seed, **specs[kind])
    return df


def corrupt_bundle(df: DataFrame, key: Sequence[str] | str, issues: Sequence[str], seed: int = 42) -> DataFrame:
    """The fixture preset. ``missing_values``: each float or text column with chance 0.3 loses 5 to 20 %;
    ``duplicates`` 5 %; ``outliers`` 2 % at ten times the maximum; ``inconsistent_types`` 5 % of integers
    as text; ``formatting_issues`` 10 % of texts in upper case."""
    import random

    draw = random.Random(seed)
    keys = as_list(key)
    choose = _Chooser(df, key, seed)
    kinds = {f.name: f.dataType for f in df.schema.fields if f.name not in keys}
    if "missing_values" in issues:
        for c in _float_or_text(df, key):
            chance, rate = draw.random(), draw.uniform(0.05, 0.20)
            if chance > 0.7:
                df = corrupt_missing(df, key, [c], rate, seed=seed)
    if "duplicates" in issues:
        df = corrupt_duplicates(df, key, 0.05, seed=seed)
    if "outliers" in issues:
        nums = [c for c in numeric_columns(df) if c in kinds]
        tops = with_stats(df, df.agg(*[F.max(present(df, c)).cast("double").alias(c) for c in nums]), "_s")
        tops = tops.withColumns({c: q(c).cast("double") for c in nums})
        changes = {c: (f"outlier:{c}", None, F.col("_s").getField(c) * 10) for c in nums}
        df = _apply(tops, key, seed, 0.02, False, changes).drop("_s")
    if "inconsistent_types" in issues:
        for c in [c for c, kind in kinds.items() if isinstance(kind, INTEGRAL) and c in df.columns]:
            df = df.withColumn(c, q(c).cast("string"))
    if "formatting_issues" in issues:
        texts = [c for c, kind in kinds.items() if isinstance(kind, T.StringType)]
        changes = {c: (f"format:{c}", None, F.upper(q(c))) for c in texts}
        df = _apply(df, key, seed, 0.10, False, changes)
    return df


def corrupt_schema(
    df: DataFrame, key: Sequence[str] | str, error_rate: float = 0.1, cols: Sequence[str] | None = None, seed: int = 42
) -> DataFrame:
    """Some integer columns (each with chance ``error_rate``, or those in ``cols``) become text in which
    5 % of the values read ``invalid_<1..100>``, one number per column."""
    import random

    draw = random.Random(seed)
    keys = as_list(key)
    ints = [f.name for f in df.schema.fields if isinstance(f.dataType, INTEGRAL) and f.name not in keys]
    hit = list(cols) if cols is not None else [c for c in ints if draw.random() < error_rate]
    numbers = {c: draw.randint(1, 100) for c in hit}
    text = df.withColumns({c: q(c).cast("string") for c in hit})
    changes = {c: (f"schema:{c}", None, F.lit(f"invalid_{numbers[c]}")) for c in hit}
    return _apply(text, key, seed, 0.05, False, changes)
