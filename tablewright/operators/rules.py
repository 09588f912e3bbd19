"""Table checks: named rules, their violation counts, and splitting rows by them."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, is_missing, join_on, q


@dataclass(frozen=True)
class Rule:
    """One check. ``kind``: not_null, unique, range, accepted, foreign_key or expression."""

    name: str
    kind: str
    columns: str | Sequence[str] | None = None
    low: Any = None
    high: Any = None
    values: Sequence[Any] = field(default_factory=tuple)
    expression: str | None = None
    parent: DataFrame | None = None
    parent_column: str | None = None


_ROW_KINDS = ("not_null", "range", "accepted", "expression")


def failed(df: DataFrame, rule: Rule) -> Column:
    """True for rows that break a rule which looks at one row only. Nulls pass all but not_null."""
    if rule.kind == "expression":
        return F.coalesce(~F.expr(rule.expression), F.lit(False))
    (name,) = as_list(rule.columns)
    if rule.kind == "not_null":
        return is_missing(df, name)
    if rule.kind == "range":
        below = (q(name) < F.lit(rule.low)) if rule.low is not None else F.lit(False)
        above = (q(name) > F.lit(rule.high)) if rule.high is not None else F.lit(False)
        return F.coalesce(below | above, F.lit(False))
    if rule.kind == "accepted":
        return F.coalesce(~q(name).isin(*rule.values), F.lit(False))
    raise ValueError(f"rule {rule.name!r} of kind {rule.kind!r} does not look at single rows")


def check_rules(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: rows checked, violations, pass rate.

    All single-row rules share one scan. Uniqueness counts the rows of repeated values;
    foreign keys count rows whose value the parent lacks.
    """
    row_rules = [r for r in rules if r.kind in _ROW_KINDS]
    parts: list[DataFrame] = []
    if row_rules:
        row = df.agg(
            F.count("*").alias("rows"),
            *[F.count(F.when(failed(df, r), 1)).alias(f"v{i}") for i, r in enumerate(row_rules)],
        )
        structs = [
            F.struct(
                F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.col("rows"),
                F.col(f"v{i}").alias("violations"),
            )
            for i, r in enumerate(row_rules)
        ]
        parts.append(row.select(F.explode(F.array(*structs)).alias("r")).select("r.*"))
    for r in rules:
        if r.kind == "unique":
            sizes = df.groupBy(*as_list(r.columns)).agg(F.count("*").alias("n"))
            known = reduce(lambda a, b: a & b, [q(c).isNotNull() for c in as_list(r.columns)])
            broken = F.coalesce(F.sum(F.when(known & (F.col("n") > 1), F.col("n"))), F.lit(0))
            part = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), broken.alias("violations"))
        elif r.kind == "foreign_key":
            (child,) = as_list(r.columns)
            sizes = df.groupBy(q(child).alias("k")).agg(F.count("*").alias("n"))
            known = r.parent.select(q(r.parent_column or child).alias("k")).distinct().withColumn("hit", F.lit(True))
            joined = sizes.join(known, "k", "left")
            lost = F.col("k").isNotNull() & F.col("hit").isNull()
            part = joined.agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
                F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("violations"),
            )
        elif r.kind in _ROW_KINDS:
            continue
        else:
            raise ValueError(f"unknown rule kind {r.kind!r}")
        parts.append(part.select(F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), "rows", "violations"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("pass_rate", 1 - F.try_divide(F.col("violations"), F.col("rows")))


#: A value is hot if it holds more than one in so many rows; fewer values than this can be.
_HOT = 1000


def _marked(df: DataFrame, keys: Sequence[str], verdicts: DataFrame, name: str) -> DataFrame:
    """Add the verdict (``_bad``) on the row's key; false for keys with a null part.

    ``verdicts`` has one row per key, with the count of its rows (``_n``). The fewer than ``_HOT`` hot keys are sent to
    all tasks. Of the others only the bad ones are joined; rows that this join can't mark, those with a hot key or a
    null, get a salt that spreads them over its tasks.
    """
    hot = F.col("_n") * _HOT > verdicts.agg(F.sum("_n")).scalar()
    often = verdicts.where(hot).select(*[q(k).alias(f"_h{i}") for i, k in enumerate(keys)], F.col("_bad").alias("_often"))
    rare = verdicts.where(~hot & F.col("_bad")).select(
        *[q(k).alias(f"_r{i}") for i, k in enumerate(keys)], F.lit(0).alias("_rsalt"), F.lit(True).alias("_rare")
    )
    hashed = [q(f.name) for f in df.schema.fields if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    spread = 1 + F.pmod(F.xxhash64(*hashed), F.lit(_HOT)).cast("int")
    hollow = reduce(lambda a, b: a | b, [q(k).isNull() for k in keys])
    out = df.join(F.broadcast(often), reduce(lambda a, b: a & b, [q(k) == F.col(f"_h{i}") for i, k in enumerate(keys)]), "left")
    out = out.withColumn("_salt", F.when(hollow | F.col("_often").isNotNull(), spread).otherwise(0))
    same = reduce(lambda a, b: a & b, [q(k) == F.col(f"_r{i}") for i, k in enumerate(keys)])
    out = out.join(rare, same & (F.col("_salt") == F.col("_rsalt")), "left")
    return out.select(*[q(c) for c in df.columns], F.coalesce("_often", "_rare", F.lit(False)).alias(name))


def _verdicts(df: DataFrame, rule: Rule) -> DataFrame:
    """Every key without a null part, the count of its rows and whether they break the rule."""
    keys = as_list(rule.columns)
    known = reduce(lambda a, b: a & b, [q(k).isNotNull() for k in keys])
    sizes = df.where(known).groupBy(*[q(k) for k in keys]).agg(F.count("*").alias("_n"))
    if rule.kind == "unique":
        return sizes.withColumn("_bad", F.col("_n") > 1)
    (child,) = keys
    parents = rule.parent.select(q(rule.parent_column or child).alias("_p")).distinct()
    return sizes.join(parents, q(child) == F.col("_p"), "left").withColumn("_bad", F.col("_p").isNull()).drop("_p")


def tag_failures(df: DataFrame, rules: Sequence[Rule], name: str = "failed_rules") -> DataFrame:
    """Add the names of the rules each row breaks, in rule order.

    ``unique`` is broken by every row of a repeated key, ``foreign_key`` by rows whose value the parent lacks; neither
    by rows with a null in the columns.
    """
    out, names = df, []
    for i, r in enumerate(rules):
        if r.kind in ("unique", "foreign_key"):
            out = _marked(out, as_list(r.columns), _verdicts(df, r), f"_broken{i}")
            names.append(F.when(F.col(f"_broken{i}"), F.lit(r.name)))
        else:
            names.append(F.when(failed(df, r), F.lit(r.name)))
    return out.withColumn(name, F.array_compact(F.array(*names))).drop(*[f"_broken{i}" for i in range(len(rules))])


def quarantine(df: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, DataFrame]:
    """``(passed, failed)``; the failed rows carry ``failed_rules``."""
    tagged = tag_failures(df, rules)
    good = F.size("failed_rules") == 0
    return tagged.where(good).drop("failed_rules"), tagged.where(~good)
