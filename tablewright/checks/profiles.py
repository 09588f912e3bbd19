"""Profiles, reports and rules."""

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators.rules import Rule, check_rules, quarantine, tag_failures
from . import check, read

LINEITEM_NUM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_TXT = ["l_returnflag", "l_linestatus"]
TYPES = {"l_orderkey": "bigint", "l_partkey": "bigint", "l_suppkey": "bigint", "l_linenumber": "int"}

# Events with holes: a third of the work here is finding them again.
HOLED = """(select event_id, ts, user_id,
  case when event_id % 11 = 0 then null else event_type end as event_type,
  case when event_id % 7 = 0 then null else value end as value, props from events)"""


def holed(spark, sf):
    return read(spark, sf, "events").withColumns(
        {
            "event_type": F.when(F.col("event_id") % 11 == 0, None).otherwise(F.col("event_type")),
            "value": F.when(F.col("event_id") % 7 == 0, None).otherwise(F.col("value")),
        }
    )


def union(parts):
    return "\nunion all\n".join(parts)


def rounded(df, places, *cols):
    return df.withColumns({c: F.round(c, places) for c in cols})


_summary = [
    f"""select '{c}' as data_field_name, '{TYPES.get(c, "double")}' as data_type, count(*) - count({c}) as null_counts,
 null::bigint as unique_counts, round(avg({c}), 4) as mean, min({c})::double as min, max({c})::double as max from lineitem"""
    for c in LINEITEM_NUM
] + [
    f"""select '{c}', 'string', count(*) - count({c}), count(distinct {c}), null, null, null from lineitem"""
    for c in LINEITEM_TXT
] + ["select 'l_shipdate', 'timestamp_ntz', count(*) - count(l_shipdate), null, null, null, null from lineitem"]


@check("profile_summary", union(_summary))
def _(spark, sf):
    return rounded(P.profile_summary(read(spark, sf, "lineitem")), 4, "mean")


@check(
    "profile_summary_missing",
    f"""select 'event_id' as data_field_name, 'bigint' as data_type, 0::bigint as null_counts, null::bigint as unique_counts,
 round(avg(event_id), 4) as mean, min(event_id)::double as min, max(event_id)::double as max from {HOLED}
union all select 'event_type', 'string', count(*) - count(event_type), count(distinct event_type), null, null, null from {HOLED}
union all select 'value', 'double', count(*) - count(value), null, round(avg(value), 4), min(value), max(value) from {HOLED}""",
)
def _(spark, sf):
    return rounded(P.profile_summary(holed(spark, sf), ["event_id", "event_type", "value"]), 4, "mean")


@check("profile_summary_approx")
def _(spark, sf):
    return P.profile_summary(read(spark, sf, "lineitem"), distinct="approx")


_desc_num = ["o_custkey", "o_totalprice"]
_desc_txt = ["o_orderstatus", "o_orderpriority"]


@check(
    "describe_all",
    union(
        [
            f"""select '{c}' as data_field_name, count({c}) as count, null::bigint as "unique", null as top, null::bigint as freq,
 round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c})::double as min,
 round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75,
 max({c})::double as max from orders"""
            for c in _desc_num
        ]
        + [
            f"""select '{c}', (select count({c}) from orders), (select count(distinct {c}) from orders), v, n, null, null, null, null, null, null, null
 from (select {c} as v, count(*) as n from orders group by 1 order by n desc, v limit 1)"""
            for c in _desc_txt
        ]
    ),
)
def _(spark, sf):
    out = P.describe_all(read(spark, sf, "orders"), _desc_num + _desc_txt)
    return rounded(out, 4, "mean", "std", "p25", "p50", "p75")


@check("null_counts", union([f"select '{c}' as data_field_name, count(*) - count({c}) as null_counts from {HOLED}" for c in ["event_id", "ts", "event_type", "value"]]))
def _(spark, sf):
    return P.null_counts(holed(spark, sf), ["event_id", "ts", "event_type", "value"])


@check("missing_report", union([
    f"""select '{c}' as data_field_name, count({c}) < count(*) as has_missing, count(*) - count({c}) as missing_count,
 round((count(*) - count({c})) / count(*), 6) as missing_fraction from {HOLED}""" for c in ["event_id", "event_type", "value"]]))
def _(spark, sf):
    return rounded(P.missing_report(holed(spark, sf), ["event_id", "event_type", "value"]), 6, "missing_fraction")


@check("unique_counts", union([f"select '{c}' as data_field_name, count(distinct {c}) as unique_counts from lineitem" for c in LINEITEM_NUM + LINEITEM_TXT + ["l_shipdate"]]))
def _(spark, sf):
    return P.unique_counts(read(spark, sf, "lineitem"))


@check("unique_counts_approx")
def _(spark, sf):
    return P.unique_counts(read(spark, sf, "lineitem"), approx=True)


@check("profile_temporal", union([
    f"""select '{c}' as data_field_name, count(*) - count({c}) as null_counts, min({c})::timestamp as first, max({c})::timestamp as last,
 make_timestamp((sum(epoch_us({c})::hugeint) // count({c}))::bigint) as mean,
 round((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0, 6)::double as span_days from {t}"""
    for c, t in [("l_shipdate", "lineitem"), ("ts", "events")]]))
def _(spark, sf):
    a = P.profile_temporal(read(spark, sf, "lineitem"))
    return rounded(a.unionByName(P.profile_temporal(read(spark, sf, "events"))), 6, "span_days")


_patterns = {
    "customer": ("OBO0ODT0NCO3CBI0OTX2OUK0", "OTX2OBO0ODT0ODT0NCO0CBI0OTX0OUK0"),
    "orders": ("OBO0ODT1NCO3CBI0OTX2OUK0", "OTX2OBO0ODT0ODT0NCO0CBI0OTX0OUK0"),
    "events": ("OBO0ODT1NCO3CBI0OTX2OUK0", "OTX2OBO0ODT0ODT0NCO0CBI0OTX0OUK0"),
    "embeddings": ("OBO0ODT0NCO2CBI0OTX0OUK1", "OTX1OBO0ODT0ODT0NCO0CBI0OTX0OUK0"),
}


@check("field_pattern", union([
    f"select '{t}' as tbl, '{a}' as canonical, count(*) as n_rows from {t}" for t, (a, _) in _patterns.items()]))
def _(spark, sf):
    out = None
    for t in _patterns:
        one = P.field_pattern(read(spark, sf, t)).select(
            F.lit(t).alias("tbl"), F.col("field_pattern").alias("canonical"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


@check("field_pattern_reference_mode", union([
    f"select '{t}' as tbl, '{b}' as pattern, count(*) as n_rows from {t}" for t, (_, b) in _patterns.items()]))
def _(spark, sf):
    out = None
    for t in _patterns:
        one = P.field_pattern(read(spark, sf, t), "reference").select(
            F.lit(t).alias("tbl"), F.col("field_pattern").alias("pattern"), "n_rows"
        )
        out = one if out is None else out.unionByName(one)
    return out


def _class_sql(table, c, kind):
    """The class of one column, spelt out as SQL."""
    if kind == "time":
        return f"select '{table}' as tbl, '{c}' as data_field_name, 'timestamp_ntz' as data_type, 'others' as data_type_category, 'datetime' as data_type_subcategory from {table} limit 1"
    stats = f"(select count(*) as n, count({c}) as k, count(distinct {c}) as d"
    if kind == "string":
        stats += f", avg(length({c})) as len, avg((try_strptime(substr({c},1,10),'%Y-%m-%d') is not null)::int) as dt from {table})"
        rules = """case when dt >= 0.95 then 'others/datetime' when k = n and d = n then 'others/identifier'
 when d = 2 then 'categorical/binary-label' when d <= 20 then 'categorical/multi-label'
 when len > 50 or d > n * 0.5 then 'others/text' else 'numerical/nominal' end"""
    elif kind == "double":
        stats += f" from {table})"
        rules = "case when d = 2 then 'categorical/binary-label' else 'numerical/continuous' end"
    else:
        stats += f" from {table})"
        rules = """case when k = n and d = n then 'others/identifier' when d = 2 then 'categorical/binary-label'
 when d <= 10 then 'numerical/ordinal' else 'numerical/discrete' end"""
    return f"""select '{table}' as tbl, '{c}' as data_field_name, '{kind}' as data_type,
 split_part(r, '/', 1) as data_type_category, split_part(r, '/', 2) as data_type_subcategory
 from (select {rules} as r from {stats})"""


_class_cols = [
    ("orders", "o_orderkey", "bigint"), ("orders", "o_custkey", "bigint"), ("orders", "o_orderstatus", "string"),
    ("orders", "o_totalprice", "double"), ("orders", "o_orderdate", "time"), ("orders", "o_orderpriority", "string"),
    ("documents", "doc_id", "bigint"), ("documents", "text", "string"), ("documents", "lang", "string"),
    ("documents", "source", "string"), ("documents", "n_chars", "bigint"),
    ("labels", "doc_id", "bigint"), ("labels", "quality", "int"), ("labels", "toxic", "int"),
]
_CLASSES = union([_class_sql(*c) for c in _class_cols if c[2] != "time"]) + "\nunion all (" + _class_sql("orders", "o_orderdate", "time") + ")"


def _facts(spark, sf):
    out = None
    for t in ("orders", "documents", "labels"):
        one = P.classify_columns(read(spark, sf, t)).withColumn("tbl", F.lit(t))
        out = one if out is None else out.unionByName(one)
    return out


@check("classify_columns", _CLASSES)
def _(spark, sf):
    return _facts(spark, sf).drop("description")


def _pattern_sql():
    parent = " || ".join(f"'{code}' || count(*) filter (data_type_category = '{n}')" for n, code in P.PARENT_CODES.items())
    child = " || ".join(f"'{code}' || count(*) filter (data_type_subcategory = '{n}')" for n, code in P.CHILD_CODES.items())
    return f"select tbl, {parent} || {child} as field_pattern from ({_CLASSES}) group by tbl"


@check("field_pattern_from_facts", _pattern_sql())
def _(spark, sf):
    return P.field_pattern_from_facts(_facts(spark, sf), "tbl")


@check("detect_nested", union(
    [f"""select '{c}' as data_field_name, coalesce(avg(({c} similar to '\\s*[{{\\[][\\s\\S]*' and json_valid({c}))::int) >= 0.9, false) as nested from events where {c} is not null"""
     for c in ("event_type", "props")] + [f"select '{c}', count(*) < 0 from events" for c in ("event_id", "ts", "user_id", "value")]
    + ["select 'embedding', count(*) >= 0 from embeddings"]))
def _(spark, sf):
    nested = P.detect_nested(read(spark, sf, "embeddings"), ["embedding"])
    return P.detect_nested(read(spark, sf, "events")).unionByName(nested)


@check("missingness_patterns", f"""select (case when event_type is null then '1' else '0' end) || (case when value is null then '1' else '0' end) as pattern,
 count(*) as n_rows from {HOLED} group by 1""")
def _(spark, sf):
    return P.missingness_patterns(holed(spark, sf), ["event_type", "value"])


@check("missingness_correlation", union([
    f"""select '{a}' as missing_column, '{b}' as against, round(corr(({a} is null)::int, {b}), 6) as corr from {HOLED}"""
    for a in ("event_type", "value") for b in ("user_id", "value") if a != b]))
def _(spark, sf):
    out = P.missingness_correlation(holed(spark, sf), ["event_type", "value"], ["user_id", "value"])
    return rounded(out, 6, "corr")


_keys = ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"]


def _keys_sql():
    from itertools import combinations

    parts = []
    for combo in [c for k in (1, 2) for c in combinations(_keys, k)]:
        parts.append(
            f"""select '{",".join(combo)}' as columns, count(distinct ({", ".join(combo)},)) as distinct_values,
 0::bigint as rows_with_null, count(*) as n_rows, count(distinct ({", ".join(combo)},)) = count(*) as is_key from orders"""
            if len(combo) > 1
            else f"""select '{combo[0]}' as columns, count(distinct {combo[0]}) as distinct_values,
 count(*) - count({combo[0]}) as rows_with_null, count(*) as n_rows, count(distinct {combo[0]}) = count(*) as is_key from orders"""
        )
    return union(parts).replace(",)) ", ")) ")


@check("candidate_keys", _keys_sql())
def _(spark, sf):
    return P.candidate_keys(read(spark, sf, "orders"), _keys)


@check("duplicate_count", """select (count(*) - (select count(*) from (select distinct text, lang, source from documents)))::bigint as duplicate_rows from documents""")
def _(spark, sf):
    return P.duplicate_count(read(spark, sf, "documents").select("text", "lang", "source"))


def _dirty_orders(spark, sf):
    o = read(spark, sf, "orders")
    holes = F.when(F.col("o_orderkey") % 10 == 0, None).otherwise(F.col("o_totalprice").cast("string"))
    dirty = o.withColumn("o_totalprice", holes)
    return dirty.unionByName(dirty.where("o_orderkey % 20 = 1"))


_DIRTY_ORDERS = "(select * from d union all select * from d where o_orderkey % 20 = 1)"


@check("degradation_report", f"""with d as (select o_orderkey, o_custkey, o_orderstatus,
 case when o_orderkey % 10 = 0 then null else o_totalprice::varchar end as o_totalprice, o_orderdate, o_orderpriority from orders)
select 'rows' as metric, '' as "column", (select count(*) from orders)::varchar as clean, (select count(*) from {_DIRTY_ORDERS})::varchar as dirty
union all select 'columns', '', '6', '6'
union all select 'duplicates', '', '0', (select count(*) from d where o_orderkey % 20 = 1)::varchar
""" + "".join(
    f"""union all select 'missing_values', '{c}', (select count(*) - count({c}) from orders)::varchar, (select count(*) - count({c}) from {_DIRTY_ORDERS})::varchar
union all select 'type', '{c}', '{a}', '{b}'
""" for c, a, b in [("o_orderkey", "bigint", "bigint"), ("o_custkey", "bigint", "bigint"), ("o_orderstatus", "string", "string"),
                    ("o_totalprice", "double", "string"), ("o_orderdate", "timestamp_ntz", "timestamp_ntz"), ("o_orderpriority", "string", "string")]))
def _(spark, sf):
    return P.degradation_report(read(spark, sf, "orders"), _dirty_orders(spark, sf))


@check("check_rules", """with s as (select count(*) as n from orders)
select rule, kind, n as rows, v::bigint as violations, round(1 - v / n, 6) as pass_rate from s, (
 select 'status known' as rule, 'accepted' as kind, count(*) filter (o_orderstatus not in ('F', 'O')) as v from orders
 union all select 'price in range', 'range', count(*) filter (o_totalprice < 1000 or o_totalprice > 400000) from orders
 union all select 'has customer', 'not_null', count(*) - count(o_custkey) from orders
 union all select 'recent', 'expression', count(*) filter (not (year(o_orderdate) >= 1995)) from orders
 union all select 'one order per customer', 'unique', (select sum(c) from (select count(*) as c from orders group by o_custkey having count(*) > 1))
 union all select 'rich customer', 'foreign_key', count(*) filter (o_custkey not in (select c_custkey from customer where c_acctbal > 0)) from orders)""")
def _(spark, sf):
    rich = read(spark, sf, "customer").where("c_acctbal > 0")
    rules = [
        Rule("status known", "accepted", "o_orderstatus", values=["F", "O"]),
        Rule("price in range", "range", "o_totalprice", low=1000.0, high=400000.0),
        Rule("has customer", "not_null", "o_custkey"),
        Rule("recent", "expression", expression="year(o_orderdate) >= 1995"),
        Rule("one order per customer", "unique", "o_custkey"),
        Rule("rich customer", "foreign_key", "o_custkey", parent=rich, parent_column="c_custkey"),
    ]
    return rounded(check_rules(read(spark, sf, "orders"), rules), 6, "pass_rate")


_Q = [Rule("cheap", "range", "o_totalprice", low=50000.0), Rule("pending", "accepted", "o_orderstatus", values=["F", "O"])]


@check("quarantine_failed", """select o_orderkey, concat_ws(',', case when o_totalprice < 50000 then 'cheap' end,
 case when o_orderstatus not in ('F', 'O') then 'pending' end) as failed_rules from orders
 where o_totalprice < 50000 or o_orderstatus not in ('F', 'O')""")
def _(spark, sf):
    bad = quarantine(read(spark, sf, "orders"), _Q)[1]
    return bad.select("o_orderkey", F.concat_ws(",", "failed_rules").alias("failed_rules"))


@check("quarantine_passed", "select o_orderkey, o_totalprice from orders where not (o_totalprice < 50000 or o_orderstatus not in ('F', 'O'))")
def _(spark, sf):
    return quarantine(read(spark, sf, "orders"), _Q)[0].select("o_orderkey", "o_totalprice")


@check("quarantine_keys", """select l_orderkey, l_linenumber, concat_ws(',', case when l_quantity < 3 then 'few' end,
 case when count(*) over (partition by l_suppkey, l_shipdate, l_returnflag) > 1 then 'twice' end,
 case when l_partkey not in (select p_partkey from part where p_size <= 40) then 'orphan' end) as failed_rules from lineitem
 qualify failed_rules <> ''""")
def _(spark, sf):
    small = read(spark, sf, "part").where("p_size <= 40")
    rules = [
        Rule("few", "range", "l_quantity", low=3.0),
        Rule("twice", "unique", ["l_suppkey", "l_shipdate", "l_returnflag"]),
        Rule("orphan", "foreign_key", "l_partkey", parent=small, parent_column="p_partkey"),
    ]
    bad = quarantine(read(spark, sf, "lineitem"), rules)[1]
    return bad.select("l_orderkey", "l_linenumber", F.concat_ws(",", "failed_rules").alias("failed_rules"))
