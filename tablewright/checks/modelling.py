"""Column reduction, anomalies and table corruption."""

import random

from pyspark.sql import functions as F

from ..operators import anomalies as N
from ..operators import corrupt as M
from ..operators import reduce as K
from . import check, read
from .profiles import HOLED, holed, rounded, union

NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]

# --- Column reduction -------------------------------------------------------------------


@check("variance_report", union([f"select '{c}' as data_field_name, round(var_samp({c}), 4) as variance, var_samp({c}) > 0.001 as kept from lineitem" for c in ("l_quantity", "l_discount", "l_tax")]))
def _(spark, sf):
    return rounded(K.variance_report(read(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], 0.001), 4, "variance")


@check("variance_threshold", "select l_orderkey, l_quantity, l_extendedprice from lineitem")
def _(spark, sf):
    lines = read(spark, sf, "lineitem").select("l_orderkey", *NUM)
    return K.variance_threshold(lines, NUM, 0.01)


@check("correlation_pairs", union([f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as corr from lineitem" for i, a in enumerate(NUM) for b in NUM[i + 1:]]))
def _(spark, sf):
    return rounded(K.correlation_pairs(read(spark, sf, "lineitem"), NUM), 6, "corr")


@check("correlation_filtering", "select l_orderkey, l_quantity, l_tax from lineitem")
def _(spark, sf):
    lines = read(spark, sf, "lineitem").selectExpr("l_orderkey", "l_quantity", "l_quantity * 2 + l_tax as doubled", "l_tax")
    return K.correlation_filtering(lines, ["l_quantity", "doubled", "l_tax"], 0.95)


_COLS = ["1"] + NUM
_MOMENTS = union([f"select {i - 1} as i, {j - 1} as j, round(avg({a} * {b})::double, 3) as s from lineitem" for i, a in enumerate(_COLS) for j, b in enumerate(_COLS) if i <= j])


@check("gram_moments", _MOMENTS)
def _(spark, sf):
    lines = read(spark, sf, "lineitem")
    table = K.moment_sums(K.merge_moments(K.moments(lines, NUM)))
    n = lines.agg(F.count("*").alias("n")).scalar()
    return table.withColumn("s", F.round(F.col("s") / n, 3))


@check("batch_moments", _MOMENTS)
def _(spark, sf):
    lines = read(spark, sf, "lineitem")
    parts = [K.moments(lines.where(f"l_returnflag = '{flag}'"), NUM) for flag in ("A", "N", "R")]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2])
    n = lines.agg(F.count("*").alias("n")).scalar()
    return K.moment_sums(K.merge_moments(total)).withColumn("s", F.round(F.col("s") / n, 3))


@check("pca")
def _(spark, sf):
    return K.pca(read(spark, sf, "embeddings"), "embedding", 4).select("vec_id", "pc1", "pc2", "pc3", "pc4")


@check("pca_keeps_rows", f"select count(*) as n_rows, count(value) as n_known from {HOLED}")
def _(spark, sf):
    out = K.pca(holed(spark, sf), ["value", "user_id"], 1)
    return out.agg(F.count("*").alias("n_rows"), F.count("pc1").alias("n_known"))


@check("incremental_pca")
def _(spark, sf):
    vectors = read(spark, sf, "embeddings")
    loadings, _, means = K.incremental_pca([vectors.where(f"label {op} 5") for op in ("<", ">=")], "embedding", 4)
    return K.project(vectors, "embedding", loadings, means, "pc").select("vec_id", "pc1", "pc2", "pc3", "pc4")


@check("kernel_pca")
def _(spark, sf):
    return K.kernel_pca(read(spark, sf, "embeddings"), "embedding", 3, gamma=0.5).select("vec_id", "kpc1", "kpc2", "kpc3")


@check("truncated_svd")
def _(spark, sf):
    return K.truncated_svd(read(spark, sf, "lineitem"), NUM, 2).select("l_orderkey", "sv1", "sv2")


@check("autoencoder_projection")
def _(spark, sf):
    return K.autoencoder_projection(read(spark, sf, "embeddings"), "embedding", 4, epochs=5).select("vec_id", "ae1", "ae2", "ae3", "ae4")


# --- Anomalies ------------------------------------------------------------------------------


@check("isolation_forest_detection")
def _(spark, sf):
    lines = read(spark, sf, "orders").withColumn("day", F.unix_date(F.to_date("o_orderdate")))
    return N.isolation_forest_detection(lines, ["o_totalprice", "day"], "o_orderkey", trees=50).select("o_orderkey", "anomaly_score")


@check("local_outlier_factor", """with p as materialized (select event_id, user_id, epoch_us(ts) / 86400000000.0 as x, value / 10 as y from events),
 d as (select a.event_id, b.event_id as o, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) as dist from p a join p b on a.user_id = b.user_id and a.event_id <> b.event_id),
 n as materialized (select * from d qualify row_number() over (partition by event_id order by dist, o) <= 5),
 k as (select event_id, max(dist) as kd from n group by 1),
 l as materialized (select n.event_id, 1.0 / avg(greatest(dist, kd)) as lrd from n join k on k.event_id = o group by 1)
select n.event_id, round(avg(b.lrd) / any_value(a.lrd), 6) as lof from n join l a on a.event_id = n.event_id join l b on b.event_id = o group by 1""")
def _(spark, sf):
    points = read(spark, sf, "events").selectExpr("event_id", "user_id", "unix_micros(cast(ts as timestamp)) / 86400000000.0D as x", "value / 10 as y")
    return rounded(N.local_outlier_factor(points, ["x", "y"], "event_id", 5, "user_id"), 6, "lof")


@check("dbscan_outlier_removal", """with p as materialized (select c_custkey, c_acctbal / 100.0 as x, c_nationkey::double as y from customer),
 d as materialized (select a.c_custkey, b.c_custkey as o from p a join p b on (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 2.25),
 core as materialized (select c_custkey from d group by 1 having count(*) >= 5)
select c_custkey, c_custkey not in (select c_custkey from core) and c_custkey not in (select d.c_custkey from d join core on o = core.c_custkey) as is_noise from p""")
def _(spark, sf):
    points = read(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal / 100.0D as x", "cast(c_nationkey as double) as y")
    return N.dbscan_outlier_removal(points, ["x", "y"], "c_custkey", 1.5, 5, "flag").select("c_custkey", "is_noise")


# --- Corruption --------------------------------------------------------------------------------


def _h(key, tag):
    return f"('0x' || substr(md5(concat_ws('|', {key}::varchar, '{tag}', '42')), 1, 8))::bigint"


def _u(key, tag):
    return f"({_h(key, tag)} / 4294967296.0)"


E, O = "event_id", "o_orderkey"


@check("corrupt_missing", f"""select event_id, case when {_u(E, 'missing:event_type')} < 0.1 then null else event_type end as event_type,
 case when {_u(E, 'missing:value')} < 0.1 then null else value end as value from events""")
def _(spark, sf):
    return M.corrupt_missing(read(spark, sf, "events"), E, ["event_type", "value"]).select(E, "event_type", "value")


@check("corrupt_missing_exact", f"""select event_id, case when row_number() over (order by {_u(E, 'missing:value')}, event_id) <= (select (count(*) * 0.1)::int from events) then null else value end as value from events""")
def _(spark, sf):
    return M.corrupt_missing(read(spark, sf, "events"), E, ["value"], exact=True).select(E, "value")


@check("corrupt_missing_exact_shared_keys", f"""with u as (select l_orderkey, l_linenumber, l_tax, {_u('l_orderkey', 'missing:l_tax')} as u from lineitem)
select l_orderkey, l_linenumber, case when u <= (select max(u) from (select u from u order by u limit (select floor(count(*) * 0.1)::int from lineitem))) then null else l_tax end as l_tax from u""")
def _(spark, sf):
    return M.corrupt_missing(read(spark, sf, "lineitem"), "l_orderkey", ["l_tax"], exact=True).select("l_orderkey", "l_linenumber", "l_tax")


@check("corrupt_missing_mar", f"""select event_id, case when {_u(E, 'missing:value')} < 0.2 and user_id > (select quantile_cont(user_id, 0.5) from events) then null else value end as value from events""")
def _(spark, sf):
    return M.corrupt_missing(read(spark, sf, "events"), E, ["value"], pattern="mar", reference="user_id").select(E, "value")


@check("corrupt_missing_mnar", f"""select event_id, case when {_u(E, 'missing:value')} < 0.4 and value > (select quantile_cont(value, 0.75) from events) then null else value end as value from events""")
def _(spark, sf):
    return M.corrupt_missing(read(spark, sf, "events"), E, ["value"], pattern="mnar").select(E, "value")


@check("corrupt_duplicates", f"select event_id, user_id, value from events union all select event_id, user_id, value from events where {_u(E, 'duplicate')} < 0.05")
def _(spark, sf):
    return M.corrupt_duplicates(read(spark, sf, "events"), E).select(E, "user_id", "value")


@check("corrupt_duplicates_partial", f"""select event_id, value from events union all
 select event_id, round(value + sqrt(-2 * ln(greatest({_u(E, 'u:value')}, 1e-12))) * cos(2 * pi() * {_u(E, 'v:value')}), 6) from events where {_u(E, 'duplicate')} < 0.05""")
def _(spark, sf):
    return rounded(M.corrupt_duplicates(read(spark, sf, "events"), E, type_="partial"), 6, "value").select(E, "value")


@check("corrupt_duplicates_delayed", f"""select event_id, ts::timestamp as ts from events union all
 select event_id, (ts + to_days((1 + {_h(E, 'delay')} % 7)::int))::timestamp from events where {_u(E, 'duplicate')} < 0.05""")
def _(spark, sf):
    return M.corrupt_duplicates(read(spark, sf, "events"), E, type_="delayed").select(E, "ts")


@check("corrupt_outliers", f"""select o_orderkey, case when {_u(O, 'outlier:o_totalprice')} < 0.02 then round(m * (5 + {_u(O, 'size:o_totalprice')} * 95), 4) else o_totalprice end as o_totalprice
 from orders, (select max(o_totalprice) as m from orders)""")
def _(spark, sf):
    return rounded(M.corrupt_outliers(read(spark, sf, "orders"), O, ["o_totalprice"]), 4, "o_totalprice").select(O, "o_totalprice")


@check("corrupt_outliers_iqr", f"""select event_id, case when {_u(E, 'outlier:value')} < 0.02 then round(b + 3 * (b - a), 4) else value end as value
 from events, (select quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b from events)""")
def _(spark, sf):
    return rounded(M.corrupt_outliers(read(spark, sf, "events"), E, ["value"], method="iqr"), 4, "value").select(E, "value")


@check("corrupt_outliers_impossible", f"""select o_orderkey, case when {_u(O, 'outlier:o_totalprice')} < 0.02 then -abs(m) else o_totalprice end as o_totalprice,
 case when {_u(O, 'outlier:disc_pct')} < 0.02 then round(100 + {_u(O, 'size:disc_pct')} * 900, 4) else disc_pct end as disc_pct,
 case when {_u(O, 'outlier:size')} < 0.02 then round(-abs(s) * (1 + {_u(O, 'size:size')} * 9), 4) else size end as size
 from (select o_orderkey, o_totalprice, (o_custkey % 50)::double as disc_pct, o_custkey::double as size from orders), (select max(o_totalprice) as m, max(o_custkey)::double as s from orders)""")
def _(spark, sf):
    orders = read(spark, sf, "orders").selectExpr(O, "o_totalprice", "cast(o_custkey % 50 as double) as disc_pct", "cast(o_custkey as double) as size")
    return rounded(M.corrupt_outliers(orders, O, method="impossible"), 4, "disc_pct", "size")


_TOKENS = "[" + ", ".join(f"'{t}'" for t in M.BAD_TOKENS) + "]"


@check("corrupt_types", f"""select o_orderkey, case when {_u(O, 'type:o_custkey')} < 0.05 then ({_TOKENS})[({_h(O, 'token:o_custkey')} % 9)::int + 1] else o_custkey::varchar end as o_custkey from orders""")
def _(spark, sf):
    return M.corrupt_types(read(spark, sf, "orders"), O, ["o_custkey"]).select(O, "o_custkey")


@check("corrupt_formatting", f"""select event_id, case when {_u(E, 'format:label')} < 0.1 then case {_h(E, 'format mode:label')} % 6 when 0 then upper(label) when 1 then lower(label)
 when 2 then upper(left(event_type, 1)) || substr(event_type, 2) || ' ' || user_id when 3 then ' ' || label || ' ' when 4 then replace(label, ' ', '  ') else trim(label) end else label end as label
 from (select event_id, event_type, user_id, event_type || ' ' || user_id as label from events)""")
def _(spark, sf):
    labelled = read(spark, sf, "events").selectExpr(E, "concat(event_type, ' ', user_id) as label")
    return M.corrupt_formatting(labelled, E)


@check("corrupt_ranges", f"""select event_id, case when {_u(E, 'range:value')} < 0.05 then round(case when {_u(E, 'range side:value')} > 0.5 then 0 - (1 + {_u(E, 'range size:value')} * 99)
 else 500 + (1 + {_u(E, 'range size:value')} * 99) end, 6) else value end as value from events""")
def _(spark, sf):
    return rounded(M.corrupt_ranges(read(spark, sf, "events"), E, {"value": (0, 500)}), 6, "value").select(E, "value")


@check("corrupt_whitespace", f"""select event_id, case when {_u(E, 'space:label')} < 0.08 then case {_h(E, 'space mode:label')} % 5 when 0 then repeat(' ', (1 + {_h(E, 'pad:label')} % 5)::int) || label
 when 1 then label || repeat(' ', (1 + {_h(E, 'pad:label')} % 5)::int) when 2 then chr(9) || label when 3 then replace(label, ' ', chr(9)) else replace(label, ' ', '  ') end else label end as label
 from (select event_id, event_type || ' ' || user_id as label from events)""")
def _(spark, sf):
    labelled = read(spark, sf, "events").selectExpr(E, "concat(event_type, ' ', user_id) as label")
    return M.corrupt_whitespace(labelled, E)


@check("corrupt_dates", f"""select o_orderkey, case when {_u(O, 'date:o_orderdate')} < 0.05 then case {_h(O, 'date mode:o_orderdate')} % 5 when 0 then strftime(o_orderdate, '%d/%m/%Y')
 when 1 then case {_h(O, 'date part:o_orderdate')} % 3 when 0 then strftime(o_orderdate, '%Y') when 1 then strftime(o_orderdate, '%m') else strftime(o_orderdate, '%d') end
 when 2 then strftime(o_orderdate + to_days((365 + {_h(O, 'date ahead:o_orderdate')} % 3286)::int), '%Y-%m-%d %H:%M:%S')
 when 3 then strftime(o_orderdate - to_days((365 + {_h(O, 'date back:o_orderdate')} % 9636)::int), '%Y-%m-%d %H:%M:%S')
 else strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') end else strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') end as o_orderdate from orders""")
def _(spark, sf):
    return M.corrupt_dates(read(spark, sf, "orders"), O).select(O, "o_orderdate")


@check("corrupt_categories", f"""select event_id, case when {_u(E, 'typo:event_type')} < 0.05 then case {_h(E, 'typo mode:event_type')} % 5 when 0 then replace(event_type, 'e', '3') when 1 then replace(event_type, 'a', '@')
 when 2 then replace(event_type, 'o', '0') when 3 then left(event_type, length(event_type) - 1) else event_type || substr('abcdefghijklmnopqrstuvwxyz', ({_h(E, 'letter:event_type')} % 26)::int + 1, 1) end
 else event_type end as event_type from events""")
def _(spark, sf):
    return M.corrupt_categories(read(spark, sf, "events").select(E, "event_type"), E, scramble=False)


@check("corrupt_categories_scrambled")
def _(spark, sf):
    return M.corrupt_categories(read(spark, sf, "events").select(E, "event_type"), E)


@check("corrupt_schema", f"""select event_id, case when {_u(E, 'schema:user_id')} < 0.05 then 'invalid_{random.Random(42).randint(1, 100)}' else user_id::varchar end as user_id from events""")
def _(spark, sf):
    return M.corrupt_schema(read(spark, sf, "events").select(E, "user_id"), E, cols=["user_id"])


@check("corrupt_table")
def _(spark, sf):
    # The rates of the demonstration run.
    specs = {
        "missing_values": {"rate": 0.10, "pattern": "random"},
        "duplicates": {"rate": 0.05, "type_": "exact"},
        "outliers": {"rate": 0.02, "method": "extreme", "cols": ["o_totalprice"]},
        "type_inconsistency": {"rate": 0.05, "cols": ["o_custkey"]},
        "formatting_issues": {"rate": 0.08},
        "categorical_typos": {"rate": 0.05},
        "whitespace_issues": {"rate": 0.08},
    }
    return M.corrupt_table(read(spark, sf, "orders"), O, specs)


@check("corrupt_bundle")
def _(spark, sf):
    issues = ["missing_values", "duplicates", "outliers", "inconsistent_types", "formatting_issues"]
    return M.corrupt_bundle(read(spark, sf, "orders"), O, issues)
