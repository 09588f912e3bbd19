"""Sources, structuring, repair, missing values, duplicates and outliers."""

import uuid

from pyspark.sql import functions as F

from ..functions.scale import shared_folder
from ..operators import dedup as E
from ..operators import missing as D
from ..operators import outliers as O
from ..operators import repair as R
from ..operators import structure as C
from ..sources import tables as A
from . import check, read
from .profiles import HOLED, holed, rounded, union


def scratch(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


# --- Sources and sinks -------------------------------------------------------------


@check("csv_round_trip", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate::timestamp as o_orderdate, o_orderpriority from orders")
def _(spark, sf):
    orders = read(spark, sf, "orders")
    path = scratch(spark, "orders-csv")
    A.write_csv(orders, path)
    back = A.read_table(spark, path, "csv", orders.schema)
    return back


@check("csv_inferred", "select c_custkey::int as c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def _(spark, sf):
    path = scratch(spark, "customer-csv")
    A.write_csv(read(spark, sf, "customer"), path)
    return A.read_table(spark, path, "csv")


@check("json_round_trip", "select event_id, user_id, event_type, value, props from events")
def _(spark, sf):
    events = read(spark, sf, "events").drop("ts")
    path = scratch(spark, "events-json")
    events.write.json(path)
    return A.read_table(spark, path, "json", events.schema)


@check("preview", "select event_id, user_id, value from events order by value desc, event_id limit 5")
def _(spark, sf):
    return A.preview(read(spark, sf, "events").select("event_id", "user_id", "value"), ["-value", "event_id"], 5)


@check("html_links", """select page_id, (generate_subscripts(h, 1) - 1)::int as pos, unnest(h) as href
 from (select page_id, list_transform(regexp_extract_all(html, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g')) as h from pages)""")
def _(spark, sf):
    return A.html_links(read(spark, sf, "pages"), "html", "page_id")


_EVENT_HTML = """('<table><tr><th>kind</th><th>value</th></tr><tr><td>' || event_type || '</td><td>' || user_id || '</td></tr></table>')"""


@check("html_tables", """select event_id, 0::int as table_idx, i::int as row_idx,
 case when i = 0 then 'kind,value' else event_type || ',' || user_id end as cells from events, (select unnest([0, 1]) as i)""")
def _(spark, sf):
    html = read(spark, sf, "events").withColumn("html", F.expr(_EVENT_HTML))
    return A.html_tables(html, "html", "event_id").withColumn("cells", F.array_join("cells", ","))


def _state_rows(spark, sf):
    return read(spark, sf, "events").selectExpr(
        "event_id as eventId",
        "user_id as sessionId",
        "event_type as stage",
        "event_id % 3 != 0 as success",
        "case when event_id % 5 = 0 then 404 else 200 end as statusCode",
        "case when event_id % 4 = 0 then 'x' when event_id % 4 = 1 then '' end as errorMessage",
        "ts as timestamp",
    )


_STATUS = """select event_id::varchar as "eventId", user_id::varchar as "sessionId", event_type as stage, event_id % 3 <> 0 as success,
 case when event_id % 5 = 0 then 404 when event_id % 3 = 0 then 500 else 200 end as "statusCode",
 case when event_id % 3 = 0 and event_id % 4 <> 0 then 'StateMessage failed without specific error message.'
  when event_id % 4 = 0 then 'x' when event_id % 4 = 1 then '' end as "errorMessage", ts::timestamp as "timestamp" from events"""


@check("normalise_status", _STATUS)
def _(spark, sf):
    return A.normalise_status(_state_rows(spark, sf))


@check("append_state_log", _STATUS)
def _(spark, sf):
    path = scratch(spark, "state-log")
    rows = _state_rows(spark, sf)
    A.append_state_log(rows.where("eventId % 2 = 0"), path)
    A.append_state_log(rows.where("eventId % 2 = 1"), path)
    return spark.read.parquet(path)


@check("policy_round_trip", """select event_type as field_pattern, 'drop_rows' as action, round(avg(value), 4) as proba, count(*)::double as rows_seen from events group by 1""")
def _(spark, sf):
    policy = read(spark, sf, "events").groupBy(F.col("event_type").alias("field_pattern")).agg(
        F.lit("drop_rows").alias("action"),
        F.round(F.avg("value"), 4).alias("proba"),
        F.create_map(F.lit("drop_rows"), F.count("*").cast("double")).alias("space"),
    )
    path = scratch(spark, "policy")
    A.save_policy(policy, path)
    return A.load_policy(spark, path).select("field_pattern", "action", "proba", F.col("space")["drop_rows"].alias("rows_seen"))


# --- Structuring ---------------------------------------------------------------------


@check("pivot", """select o_custkey, round(sum(o_totalprice) filter (o_orderstatus = 'F'), 2) as "F", round(sum(o_totalprice) filter (o_orderstatus = 'O'), 2) as "O",
 round(sum(o_totalprice) filter (o_orderstatus = 'P'), 2) as "P" from orders group by 1""")
def _(spark, sf):
    out = C.pivot(read(spark, sf, "orders"), "o_custkey", "o_orderstatus", "o_totalprice", "sum", ["F", "O", "P"])
    return rounded(out, 2, "F", "O", "P")


@check("melt", union([f"select l_orderkey, l_partkey, '{c}' as variable, {c} as value from lineitem" for c in ("l_quantity", "l_discount", "l_tax")]))
def _(spark, sf):
    return C.melt(read(spark, sf, "lineitem"), ["l_orderkey", "l_partkey"], ["l_quantity", "l_discount", "l_tax"])


@check("transpose_summary", """with s as (select o_orderstatus, count(*)::double as n, min(o_totalprice) as low, max(o_totalprice) as high from orders group by 1)
""" + union([f"""select '{c}' as statistic, max({c}) filter (o_orderstatus = 'F') as "F", max({c}) filter (o_orderstatus = 'O') as "O", max({c}) filter (o_orderstatus = 'P') as "P" from s""" for c in ("n", "low", "high")]))
def _(spark, sf):
    s = read(spark, sf, "orders").groupBy("o_orderstatus").agg(
        F.count("*").cast("double").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high")
    )
    return C.transpose_summary(s, "o_orderstatus", ["F", "O", "P"])


@check("parse_json", "select event_id, (props->>'$.k')::int as k from events")
def _(spark, sf):
    return C.parse_json(read(spark, sf, "events"), "props", "k int").select("event_id", "k")


@check("parse_json_paths", "select event_id, (props->>'$.k')::bigint as k, null::varchar as missing from events")
def _(spark, sf):
    out = C.parse_json(read(spark, sf, "events"), "props", paths={"k": ("$.k", "bigint"), "missing": ("$.none", "string")})
    return out.select("event_id", "k", "missing")


@check("parse_xml", "select event_id, event_type as kind, user_id as who from events")
def _(spark, sf):
    xml = read(spark, sf, "events").withColumn("x", F.expr("concat('<e><kind>', event_type, '</kind><who>', user_id, '</who></e>')"))
    return C.parse_xml(xml, "x", "kind string, who bigint").select("event_id", "kind", "who")


@check("parse_delimited", "select event_id, event_type as a, user_id::varchar as b, null::varchar as c from events")
def _(spark, sf):
    line = read(spark, sf, "events").withColumn("line", F.concat_ws("|", "event_type", "user_id"))
    return C.parse_delimited(line, "line", "|", ["a", "b", "c"]).select("event_id", "a", "b", "c")


@check("parse_delimited_quoted", """select o_orderkey, o_orderpriority || ',' || o_orderstatus as a, 'say "' || o_orderstatus || '"' as b, '' as c, o_orderstatus as d from orders""")
def _(spark, sf):
    line = F.concat(F.lit('"'), "o_orderpriority", F.lit(","), "o_orderstatus", F.lit('","say ""'), "o_orderstatus", F.lit('""",,'), "o_orderstatus")
    out = C.parse_delimited(read(spark, sf, "orders").withColumn("line", line), "line", ",", ["a", "b", "c", "d"])
    return out.select("o_orderkey", "a", "b", "c", "d")


@check("flatten", "select event_id, event_type as e_kind, user_id as e_who_id, value as e_who_value from events")
def _(spark, sf):
    nested = read(spark, sf, "events").selectExpr(
        "event_id", "named_struct('kind', event_type, 'who', named_struct('id', user_id, 'value', value)) as e"
    )
    return C.flatten(nested)


@check("unnest", """select vec_id, (generate_subscripts(embedding, 1) - 1)::int as pos, round(unnest(embedding)::double, 6) as embedding from embeddings""")
def _(spark, sf):
    out = C.unnest(read(spark, sf, "embeddings").select("vec_id", "embedding"), "embedding")
    return out.withColumn("embedding", F.round(F.col("embedding").cast("double"), 6))


@check("split_column", "select o_orderkey, split_part(o_orderpriority, '-', 1) as level, split_part(o_orderpriority, '-', 2) as label from orders")
def _(spark, sf):
    return C.split_column(read(spark, sf, "orders"), "o_orderpriority", r"^(\d)-(.*)$", ["level", "label"]).select("o_orderkey", "level", "label")


@check("combine_columns", "select o_orderkey, concat_ws(':', o_orderstatus, o_custkey) as tag from orders")
def _(spark, sf):
    return C.combine_columns(read(spark, sf, "orders"), ["o_orderstatus", "o_custkey"], ":", "tag").select("o_orderkey", "tag")


@check("calculated_fields", """select l_orderkey, l_partkey, round(l_quantity * l_extendedprice, 4) as gross,
 round(l_extendedprice * l_quantity * (1 - l_discount) + l_tax, 4) as total from lineitem""")
def _(spark, sf):
    out = C.calculated_fields(
        read(spark, sf, "lineitem"),
        {"gross": "l_quantity * l_extendedprice", "total": "l_extendedprice * l_quantity * (1 - l_discount) + l_tax"},
    )
    return rounded(out, 4, "gross", "total").select("l_orderkey", "l_partkey", "gross", "total")


# --- Repair ----------------------------------------------------------------------------

_TOKENS = ", ".join(f"'{t}'" for t in R.NULL_TOKENS)
# Every eleventh kind is one of the sentinel texts, every thirteenth number is padded.
_DIRTY_SPARK = {
    "kind": "case when event_id % 11 = 0 then element_at(array('N/A', 'NULL', '--', ' na ', ''), cast(event_id % 5 as int) + 1) else event_type end",
    "amount": "case when event_id % 11 = 0 then 'N/A' when event_id % 13 = 0 then concat(' ', user_id, ' ') else cast(user_id as string) end",
    "day": "case event_id % 4 when 0 then date_format(ts, 'yyyy-MM-dd HH:mm:ss') when 1 then date_format(ts, 'dd/MM/yyyy') when 2 then date_format(ts, 'yyyy/MM/dd') else date_format(ts, 'yyyy') end",
}
_DIRTY = """(select event_id, user_id, ts, event_type,
 case when event_id % 11 = 0 then (['N/A', 'NULL', '--', ' na ', ''])[event_id % 5 + 1] else event_type end as kind,
 case when event_id % 11 = 0 then 'N/A' when event_id % 13 = 0 then ' ' || user_id || ' ' else user_id::varchar end as amount,
 case event_id % 4 when 0 then strftime(ts, '%Y-%m-%d %H:%M:%S') when 1 then strftime(ts, '%d/%m/%Y') when 2 then strftime(ts, '%Y/%m/%d') else strftime(ts, '%Y') end as day
 from events)"""


def dirty(spark, sf):
    return read(spark, sf, "events").withColumns({n: F.expr(e) for n, e in _DIRTY_SPARK.items()})


@check("null_tokens", f"select event_id, case when trim(kind) not in ({_TOKENS}) then kind end as kind from {_DIRTY}")
def _(spark, sf):
    return R.null_tokens(dirty(spark, sf).select("event_id", "kind"), ["kind"])


@check("to_number", f"select event_id, try_cast(amount as double) as amount, amount is not null and try_cast(amount as double) is null as amount_bad from {_DIRTY}")
def _(spark, sf):
    return R.to_number(dirty(spark, sf).select("event_id", "amount"), ["amount"])


@check("to_timestamp_multi", f"""select event_id, coalesce(try_strptime(day, '%Y-%m-%d %H:%M:%S'), try_strptime(day, '%d/%m/%Y'), try_strptime(day, '%Y/%m/%d')) as day from {_DIRTY}""")
def _(spark, sf):
    formats = ["yyyy-MM-dd HH:mm:ss", "dd/MM/yyyy", "yyyy/MM/dd"]
    return R.to_timestamp_multi(dirty(spark, sf).select("event_id", "day"), "day", formats)


@check("to_boolean", "select event_id, case when event_type in ('click', 'view') then true when event_type = 'error' then false end as event_type from events")
def _(spark, sf):
    return R.to_boolean(read(spark, sf, "events").select("event_id", "event_type"), ["event_type"], ["click", "view"], ["error"])


@check("to_category", """with l as (select event_type as v, row_number() over (order by event_type) - 1 as code from (select distinct event_type from events))
select event_id, event_type, code::bigint as event_type_code from events join l on event_type = v""")
def _(spark, sf):
    return R.to_category(read(spark, sf, "events").select("event_id", "event_type"), "event_type")


@check("normalise_whitespace", "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) as text from documents")
def _(spark, sf):
    return R.normalise_whitespace(read(spark, sf, "documents").select("doc_id", "text"))


@check("normalise_case", "select c_custkey, upper(c_name) as c_name, upper(c_mktsegment) as c_mktsegment from customer")
def _(spark, sf):
    return R.normalise_case(read(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), how="upper")


_TYPO = """(select p_partkey, p_type, case when p_partkey % 50 = 0 then replace(p_type, 'E', '3') when p_partkey % 50 = 7 then left(p_type, length(p_type) - 1)
  when p_partkey % 50 = 11 then p_type || 'x' else p_type end as typed from part)"""


@check("repair_categories", f"""with t as (select * from {_TYPO}), c as (select typed as v, count(*) as n from t group by 1), s as (select sum(n) as t from c),
 good as (select v, n from c, s where n >= 0.01 * t), rare as (select v, replace(replace(replace(v, '3', 'e'), '@', 'a'), '0', 'o') as p from c, s where n < 0.01 * t),
 m as (select r.v, g.v as fixed, row_number() over (partition by r.v order by least(levenshtein(r.v, g.v), levenshtein(r.p, g.v)), g.n desc, g.v) as k
  from rare r join good g on least(levenshtein(r.v, g.v), levenshtein(r.p, g.v)) <= 2)
select p_partkey, coalesce(fixed, typed) as typed from t left join (select * from m where k = 1) x on typed = x.v""")
def _(spark, sf):
    typed = read(spark, sf, "part").selectExpr(
        "p_partkey",
        """case when p_partkey % 50 = 0 then replace(p_type, 'E', '3') when p_partkey % 50 = 7 then left(p_type, length(p_type) - 1)
           when p_partkey % 50 = 11 then p_type || 'x' else p_type end as typed""",
    )
    return R.repair_categories(typed, "typed")


@check("check_ranges", """select o_orderkey, not (o_totalprice between 1000 and 400000) as o_totalprice_out_of_range from orders""")
def _(spark, sf):
    return R.check_ranges(read(spark, sf, "orders"), {"o_totalprice": (1000.0, 400000.0)}).select("o_orderkey", "o_totalprice_out_of_range")


@check("clip_ranges", """select o_orderkey, least(greatest(o_totalprice, 1000.0::double), 400000.0::double) as o_totalprice from orders""")
def _(spark, sf):
    return R.check_ranges(read(spark, sf, "orders"), {"o_totalprice": (1000.0, 400000.0)}, "clip").select("o_orderkey", "o_totalprice")


_DAYS = """(select o_orderkey, case when o_orderkey % 10 = 0 then strftime(o_orderdate, '%Y') when o_orderkey % 10 = 1 then 'x'
 else strftime(o_orderdate, '%Y-%m-%d') end as day from orders)"""


@check("check_dates", f"""select o_orderkey, case when regexp_full_match(day, '\\d{{1,4}}') then 'partial' when try_strptime(day, '%Y-%m-%d') is null then 'unparsed'
 when try_strptime(day, '%Y-%m-%d') > date '1998-06-30' then 'future' when try_strptime(day, '%Y-%m-%d') < date '1994-01-01' then 'very_old' end as day_issue from {_DAYS}""")
def _(spark, sf):
    days = read(spark, sf, "orders").selectExpr(
        "o_orderkey",
        "case when o_orderkey % 10 = 0 then date_format(o_orderdate, 'yyyy') when o_orderkey % 10 = 1 then 'x' else date_format(o_orderdate, 'yyyy-MM-dd') end as day",
    )
    return R.check_dates(days, "day", "1994-01-01", "1998-06-30").select("o_orderkey", "day_issue")


@check("detect_mixed_types", f"""select data_field_name, shape, count(*) as n from (
 select 'kind' as data_field_name, case when trim(kind) = '' then 'empty' else 'text' end as shape from {_DIRTY}
 union all select 'amount', case when amount = 'N/A' then 'text' else 'integer' end from {_DIRTY}
 union all select 'day', case when length(day) = 4 then 'integer' else 'date' end from {_DIRTY}) group by 1, 2""")
def _(spark, sf):
    return R.detect_mixed_types(dirty(spark, sf), ["kind", "amount", "day"])


@check("fix_encoding", """select doc_id, text, false as text_lossy from documents where not contains(text, '�')
 union all select doc_id, text, true from documents where contains(text, '�')""")
def _(spark, sf):
    broken = read(spark, sf, "documents").select("doc_id", "text")
    for wrong, right in (("Ã©", "é"), ("Ã¨", "è"), ("Ã§", "ç")):
        broken = broken.withColumn("text", F.replace("text", F.lit(right), F.lit(wrong)))
    return R.fix_encoding(broken, ["text"])


@check("validate_schema", f"select event_id, case when try_cast(amount as bigint) is null and amount is not null then 'amount' else '' end as invalid_columns from {_DIRTY}")
def _(spark, sf):
    out = R.validate_schema(dirty(spark, sf), {"amount": "bigint", "kind": "string"})
    return out.select("event_id", F.array_join("invalid_columns", ",").alias("invalid_columns"))


# --- Missing values ------------------------------------------------------------------------


@check("drop_rows", f"select event_id from {HOLED} where event_type is not null and value is not null")
def _(spark, sf):
    return D.drop_rows(holed(spark, sf), ["event_type", "value"]).select("event_id")


@check("mean_imputation", f"select event_id, round(coalesce(value, (select avg(value) from {HOLED})), 6) as value from {HOLED}")
def _(spark, sf):
    return rounded(D.mean_imputation(holed(spark, sf).select("event_id", "value"), ["value"]), 6, "value")


@check("mean_imputation_by_group", f"select event_id, round(coalesce(value, avg(value) over (partition by event_type)), 6) as value from {HOLED}")
def _(spark, sf):
    return rounded(D.mean_imputation(holed(spark, sf), ["value"], "event_type"), 6, "value").select("event_id", "value")


@check("median_imputation", f"select event_id, round(coalesce(value, (select quantile_cont(value, 0.5) from {HOLED})), 6) as value from {HOLED}")
def _(spark, sf):
    return rounded(D.median_imputation(holed(spark, sf).select("event_id", "value"), ["value"]), 6, "value")


@check("median_imputation_by_group", f"select event_id, round(coalesce(h.value, m), 6) as value from {HOLED} h join (select user_id, quantile_cont(value, 0.5) as m from {HOLED} group by 1) g on g.user_id = h.user_id")
def _(spark, sf):
    return rounded(D.median_imputation(holed(spark, sf), ["value"], "user_id"), 6, "value").select("event_id", "value")


@check("mode_imputation", f"""select event_id, coalesce(event_type, (select event_type from {HOLED} where event_type is not null group by 1 order by count(*) desc, 1 limit 1)) as event_type from {HOLED}""")
def _(spark, sf):
    return D.mode_imputation(holed(spark, sf).select("event_id", "event_type"), ["event_type"])


@check("constant_imputation", f"select event_id, coalesce(event_type, 'none') as event_type, coalesce(value, -1.0::double) as value from {HOLED}")
def _(spark, sf):
    return D.constant_imputation(holed(spark, sf), {"event_type": "none", "value": -1.0}).select("event_id", "event_type", "value")


@check("forward_fill", f"""select event_id, last_value(value ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as value,
 last_value(event_type ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as event_type from {HOLED}""")
def _(spark, sf):
    return D.forward_fill(holed(spark, sf), ["value", "event_type"], ["ts", "event_id"], "user_id").select("event_id", "value", "event_type")


@check("forward_fill_global", f"""select event_id, last_value(value ignore nulls) over (order by ts, event_id rows between unbounded preceding and current row) as value from {HOLED}""")
def _(spark, sf):
    return D.forward_fill(holed(spark, sf), ["value"], ["ts", "event_id"]).select("event_id", "value")


@check("backward_fill", f"""select event_id, first_value(value ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as value from {HOLED}""")
def _(spark, sf):
    return D.backward_fill(holed(spark, sf), ["value"], ["ts", "event_id"], "user_id").select("event_id", "value")


def _line(pos):
    return f"""with p as (select *, {pos}::double as pos from {HOLED}), w as (select *,
 last_value(value ignore nulls) over a as av, last_value(case when value is not null then pos end ignore nulls) over a as ap,
 first_value(value ignore nulls) over b as bv, first_value(case when value is not null then pos end ignore nulls) over b as bp from p
 window a as (partition by user_id order by ts, event_id rows between unbounded preceding and current row),
 b as (partition by user_id order by ts, event_id rows between current row and unbounded following))
select event_id, round(case when value is not null then value when bv is null then av else av + (bv - av) * (pos - ap) / (bp - ap) end, 6) as value from w"""


@check("interpolation_linear", _line("row_number() over (partition by user_id order by ts, event_id)"))
def _(spark, sf):
    return rounded(D.interpolation_linear(holed(spark, sf), ["value"], ["ts", "event_id"], "user_id"), 6, "value").select("event_id", "value")


@check("interpolation_time", _line("epoch_us(ts)"))
def _(spark, sf):
    return rounded(D.interpolation_time(holed(spark, sf), ["value"], "ts", "user_id", ["event_id"]), 6, "value").select("event_id", "value")


@check("knn_imputation", f"""with s as (select stddev_pop(user_id) as su, avg(user_id) as mu, stddev_pop(epoch_us(ts) / 1e6) as st, avg(epoch_us(ts) / 1e6) as mt from {HOLED}),
 p as (select event_id, value, (user_id - mu) / su as x, (epoch_us(ts) / 1e6 - mt) / st as y from {HOLED}, s),
 r as (select a.event_id, b.value, row_number() over (partition by a.event_id order by sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)), b.event_id) as k
  from p a join p b on a.value is null and b.value is not null)
select event_id, round(value, 6) as value from p where value is not null union all select event_id, round(avg(value), 6) from r where k <= 5 group by 1""")
def _(spark, sf):
    timed = holed(spark, sf).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6))
    return rounded(D.knn_imputation(timed, "value", ["user_id", "at"], "event_id", 5), 6, "value").select("event_id", "value")


@check("regression_imputation", f"""select event_id, round(coalesce(value, (select regr_intercept(value, user_id) from {HOLED}) + (select regr_slope(value, user_id) from {HOLED}) * user_id), 6) as value from {HOLED}""")
def _(spark, sf):
    return rounded(D.regression_imputation(holed(spark, sf), "value", ["user_id"]), 6, "value").select("event_id", "value")


def _holed_lines(spark, sf):
    return read(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey",
        F.when(F.col("l_partkey") % 7 == 0, None).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
        F.when(F.col("l_orderkey") % 5 == 0, None).otherwise(F.col("l_quantity")).alias("l_quantity"),
        "l_tax",
    )


@check("regression_imputation_many")
def _(spark, sf):
    return D.regression_imputation(_holed_lines(spark, sf), "l_extendedprice", ["l_partkey", "l_tax"])


@check("iterative_imputation")
def _(spark, sf):
    return D.iterative_imputation(_holed_lines(spark, sf), ["l_extendedprice", "l_quantity", "l_tax"], 2)


@check("flag_missing", f"select event_id, (value is null)::int as value_missing, (event_type is null)::int as event_type_missing from {HOLED}")
def _(spark, sf):
    return D.flag_missing(holed(spark, sf), ["value", "event_type"]).select("event_id", "value_missing", "event_type_missing")


# --- Duplicates -----------------------------------------------------------------------------


@check("dedup_exact", "select distinct text, lang, source from documents")
def _(spark, sf):
    return E.dedup_exact(read(spark, sf, "documents").select("text", "lang", "source"))


@check("dedup_exact_on_columns", "select min(doc_id) as doc_id, text from documents group by text")
def _(spark, sf):
    return E.dedup_exact(read(spark, sf, "documents").select("doc_id", "text"), ["text"], ["doc_id"])


@check("dedup_keep_recent", "select event_id, user_id, event_type from events qualify row_number() over (partition by user_id, event_type order by ts desc, event_id desc) = 1")
def _(spark, sf):
    return E.dedup_keep_recent(read(spark, sf, "events"), ["user_id", "event_type"], "ts", ["event_id"]).select("event_id", "user_id", "event_type")


@check("dedup_keep_complete", f"""select event_id, user_id from {HOLED} qualify row_number() over (partition by user_id order by (event_type is null)::int + (value is null)::int, event_id) = 1""")
def _(spark, sf):
    return E.dedup_keep_complete(holed(spark, sf), ["user_id"], ["event_id"]).select("event_id", "user_id")


@check("survivorship", f"""with m as (select user_id, event_type, count(*) as n from {HOLED} where event_type is not null group by 1, 2)
select h.user_id, arg_max(value, ts) filter (value is not null) as value, max(event_id) as event_id,
 (select event_type from m where m.user_id = h.user_id order by n desc, event_type limit 1) as event_type, min(ts)::timestamp as ts, count(*) as n_versions from {HOLED} h group by h.user_id""")
def _(spark, sf):
    return E.survivorship(holed(spark, sf), ["user_id"], {"value": "latest", "event_id": "max", "event_type": "mode", "ts": "min"}, "ts", ["event_id"])


@check("fuzzy_matches", """with v as (select p_brand, p_name as value, min(p_partkey) as id, count(*) as n from part group by 1, 2)
select a.p_brand, a.id as id_a, b.id as id_b, a.value as value_a, b.value as value_b, a.n as n_a, b.n as n_b, levenshtein(a.value, b.value)::int as distance
 from v a join v b on a.p_brand = b.p_brand and a.value < b.value and levenshtein(a.value, b.value) <= 2""")
def _(spark, sf):
    return E.fuzzy_matches(read(spark, sf, "part"), "p_partkey", "p_name", "p_brand", 2)


_CITIES = """(select c_custkey as id, c_mktsegment, right(c_name, 4) as code from customer)"""


@check("duplicate_clusters", """with recursive v as (select text, min(doc_id) as lo from documents group by text),
 e as (select doc_id as a, lo as b from documents join v using (text) where doc_id <> lo union select lo, doc_id from documents join v using (text) where doc_id <> lo),
 r as (select a as id, a as reach from e union select r.id, e.b from r join e on r.reach = e.a)
select id, min(reach) as cluster from r group by id""")
def _(spark, sf):
    docs = read(spark, sf, "documents").select("doc_id", "text")
    firsts = docs.groupBy("text").agg(F.min("doc_id").alias("id_a"))
    pairs = docs.join(firsts, "text").where("doc_id <> id_a").select("id_a", F.col("doc_id").alias("id_b"))
    return E.duplicate_clusters(pairs)


@check("partial_duplicates", """with t as (select l_orderkey, l_partkey, l_quantity, l_extendedprice, row_number() over () as r from lineitem)
select l_orderkey, l_partkey, l_quantity, l_extendedprice from t a where exists (select 1 from t b where a.l_orderkey = b.l_orderkey and a.r <> b.r
 and abs(a.l_quantity - b.l_quantity) <= 5 and abs(a.l_extendedprice - b.l_extendedprice) <= 5000)""")
def _(spark, sf):
    return E.partial_duplicates(read(spark, sf, "lineitem"), ["l_orderkey"], {"l_quantity": 5.0, "l_extendedprice": 5000.0}).select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice"
    )


@check("delayed_duplicates", """select event_id, p::timestamp as previous_ts from (select event_id, ts, lag(ts) over (partition by user_id, event_type order by ts, event_id) as p from events)
 where epoch_us(ts) - epoch_us(p) between 86400000000 and 7 * 86400000000""")
def _(spark, sf):
    return E.delayed_duplicates(read(spark, sf, "events"), ["user_id", "event_type"], "ts", 7, ["event_id"]).select("event_id", "previous_ts")


@check("near_duplicates", r"""with recursive w as (select doc_id, string_split_regex(trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')), ' ') as w from documents where doc_id is not null),
 s as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: hash(array_to_string(w[i:i + 4], ' '))))) as s from w where w <> ['']),
 n as (select doc_id, count(*) as n from s group by 1),
 o as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.s = b.s and a.doc_id <> b.doc_id group by all),
 e as (select a, b from o join n x on x.doc_id = a join n y on y.doc_id = b where o >= 0.75 * (x.n + y.n - o)),
 r as (select a as node, a as seen from e union select r.node, e.b from r join e on e.a = r.seen)
 select node as id, min(seen) as cluster from r group by node""")
def _(spark, sf):
    return E.near_duplicates(read(spark, sf, "documents"), "doc_id", "text")


@check("dedup_audit", """with k as (select *, first_value(event_id) over w as survivor_id, first_value(ts) over w as sts from events
 window w as (partition by user_id, event_type order by ts desc, event_id desc))
select user_id, event_type, event_id as dropped_id, survivor_id, case when ts < sts then 'older version' else 'same instant, smaller id' end as reason
 from k where event_id <> survivor_id""")
def _(spark, sf):
    return E.dedup_audit(read(spark, sf, "events"), ["user_id", "event_type"], "event_id", "ts")


# --- Outliers ---------------------------------------------------------------------------------

_IQR = "(select quantile_cont({c}, 0.25) as a, quantile_cont({c}, 0.75) as b from {t})"


@check("iqr_clipping", f"""select event_id, round(least(greatest(value, a - 1.5 * (b - a)), b + 1.5 * (b - a)), 6) as value from events, {_IQR.format(c='value', t='events')}""")
def _(spark, sf):
    return rounded(O.iqr_clipping(read(spark, sf, "events"), ["value"]), 6, "value").select("event_id", "value")


@check("zscore_clipping", """select event_id, abs(value - m) > 2 * s as value_outlier from events, (select avg(value) as m, stddev_samp(value) as s from events)""")
def _(spark, sf):
    return O.zscore_clipping(read(spark, sf, "events"), ["value"], 2.0, "flag").select("event_id", "value_outlier")


@check("winsorization", """select o_orderkey, round(least(greatest(o_totalprice, a), b), 4) as o_totalprice from orders,
 (select quantile_cont(o_totalprice, 0.05) as a, quantile_cont(o_totalprice, 0.95) as b from orders)""")
def _(spark, sf):
    return rounded(O.winsorization(read(spark, sf, "orders"), ["o_totalprice"]), 4, "o_totalprice").select("o_orderkey", "o_totalprice")


_MAD = """(select m, quantile_cont(abs({c} - m), 0.5) as d from {t}, (select quantile_cont({c}, 0.5) as m from {t}) group by m)"""


@check("mad_outliers", f"""select event_id, 0.6745 * abs(value - m) / d > 3.5 as value_outlier from events, {_MAD.format(c='value', t='events')}""")
def _(spark, sf):
    return O.mad_outliers(read(spark, sf, "events"), ["value"]).select("event_id", "value_outlier")


@check("group_outliers", """with b as (select event_type, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events group by 1)
select event_id, value < a - 1.5 * (b - a) or value > b + 1.5 * (b - a) as value_outlier from events join b using (event_type)""")
def _(spark, sf):
    return O.group_outliers(read(spark, sf, "events"), ["value"], "event_type").select("event_id", "value_outlier")


@check("temporal_outliers", """with w as (select event_id, value, avg(value) over w as m, stddev_samp(value) over w as s from events
 window w as (partition by user_id order by ts, event_id rows between 20 preceding and 1 preceding))
select event_id, round(case when s > 0 then (value - m) / s end, 4) as value_z, coalesce(abs((value - m) / s) > 3 and s > 0, false) as value_outlier from w""")
def _(spark, sf):
    out = O.temporal_outliers(read(spark, sf, "events"), "value", ["ts", "event_id"], "user_id")
    return rounded(out, 4, "value_z").select("event_id", "value_z", "value_outlier")


@check("outlier_report", union([
    f"""select '{c}' as data_field_name, round(avg(({c} < a - 1.5 * (b - a) or {c} > b + 1.5 * (b - a))::int) * 100, 6) as outlier_percentage, 'iqr' as detection_method,
 round(any_value(a - 1.5 * (b - a)), 4) as lower, round(any_value(b + 1.5 * (b - a)), 4) as upper from lineitem, {_IQR.format(c=c, t='lineitem')}"""
    for c in ("l_quantity", "l_extendedprice", "l_tax")]))
def _(spark, sf):
    out = O.outlier_report(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"])
    return rounded(rounded(out, 6, "outlier_percentage"), 4, "lower", "upper")


@check("outlier_report_mad", union([
    f"""select '{c}' as data_field_name, round(avg((0.6745 * abs({c} - m) / d > 1)::int) * 100, 6) as outlier_percentage, 'mad' as detection_method,
 round(any_value(m - d / 0.6745), 4) as lower, round(any_value(m + d / 0.6745), 4) as upper from lineitem, {_MAD.format(c=c, t='lineitem')}"""
    for c in ("l_extendedprice",)]))
def _(spark, sf):
    out = O.outlier_report(read(spark, sf, "lineitem"), ["l_extendedprice"], "mad", 1.0)
    return rounded(rounded(out, 6, "outlier_percentage"), 4, "lower", "upper")
