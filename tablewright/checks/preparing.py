"""Encoding, scaling, binning and feature construction."""

from pyspark.sql import functions as F

from ..operators import bins as B
from ..operators import encode as G
from ..operators import features as J
from ..operators import scaling as H
from . import check, read
from .profiles import HOLED, holed, rounded, union

# --- Encoding --------------------------------------------------------------------------

_KINDS = ["cart", "click", "error", "purchase", "view"]


@check("one_hot_encoding", """select o_orderkey, (o_orderstatus = 'F')::int as "o_orderstatus_F", (o_orderstatus = 'O')::int as "o_orderstatus_O", (o_orderstatus = 'P')::int as "o_orderstatus_P" from orders""")
def _(spark, sf):
    return G.one_hot_encoding(read(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], drop=True)


@check("label_encoding", """select p_partkey, p_name, (dense_rank() over (order by p_name) - 1)::bigint as p_name_label from part""")
def _(spark, sf):
    return G.label_encoding(read(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@check("ordinal_encoding", """select o_orderkey, case o_orderstatus when 'O' then 0 when 'P' then 1 when 'F' then 2 end::bigint as o_orderstatus_ordinal from orders""")
def _(spark, sf):
    return G.ordinal_encoding(read(spark, sf, "orders"), "o_orderstatus", ["O", "P", "F"]).select("o_orderkey", "o_orderstatus_ordinal")


@check("target_encoding", """with g as (select c_mktsegment, count(*) as n, sum(c_acctbal) as s from customer group by 1)
select c_custkey, round((s + 10 * m) / (n + 10), 4) as c_mktsegment_target from customer join g using (c_mktsegment), (select avg(c_acctbal) as m from customer)""")
def _(spark, sf):
    return rounded(G.target_encoding(read(spark, sf, "customer"), "c_mktsegment", "c_acctbal"), 4, "c_mktsegment_target").select("c_custkey", "c_mktsegment_target")


@check("frequency_encoding", """select event_id, round(n / t, 6) as event_type_freq from events join (select event_type, count(*) as n from events group by 1) using (event_type), (select count(*) as t from events)""")
def _(spark, sf):
    return rounded(G.frequency_encoding(read(spark, sf, "events"), "event_type"), 6, "event_type_freq").select("event_id", "event_type_freq")


@check("binary_encoding", "with c as (select p_partkey, dense_rank() over (order by p_brand) - 1 as code from part) select p_partkey, "
       + ", ".join(f"((code >> {b}) & 1)::int as p_brand_b{b}" for b in range(5)) + " from c")
def _(spark, sf):
    return G.binary_encoding(read(spark, sf, "part").select("p_partkey", "p_brand"), "p_brand", 5).drop("p_brand")


def _bucket(c):
    return f"('0x' || substr(md5('{c}=' || {c}), 1, 8))::bigint % 8"


@check("hashing_trick", "select p_partkey, " + ", ".join(f"({_bucket('p_name')} = {b})::int + ({_bucket('p_brand')} = {b})::int as h{b}" for b in range(8)) + " from part")
def _(spark, sf):
    return G.hashing_trick(read(spark, sf, "part").select("p_partkey", "p_name", "p_brand"), ["p_name", "p_brand"], 8).drop("p_name", "p_brand")


# --- Scaling -----------------------------------------------------------------------------


@check("min_max_scaling", """select o_orderkey, round((o_totalprice - lo) / (hi - lo), 6) as o_totalprice from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)""")
def _(spark, sf):
    return rounded(H.min_max_scaling(read(spark, sf, "orders"), ["o_totalprice"]), 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@check("standard_scaling", """select o_orderkey, round((o_totalprice - m) / s, 6) as o_totalprice from orders, (select avg(o_totalprice) as m, stddev_pop(o_totalprice) as s from orders)""")
def _(spark, sf):
    return rounded(H.standard_scaling(read(spark, sf, "orders"), ["o_totalprice"]), 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@check("robust_scaling", """select o_orderkey, round((o_totalprice - b) / (c - a), 6) as o_totalprice from orders,
 (select quantile_cont(o_totalprice, 0.25) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.75) as c from orders)""")
def _(spark, sf):
    return rounded(H.robust_scaling(read(spark, sf, "orders"), ["o_totalprice"]), 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@check("max_abs_scaling", """select c_custkey, round(c_acctbal / m, 6) as c_acctbal from customer, (select max(abs(c_acctbal)) as m from customer)""")
def _(spark, sf):
    return rounded(H.max_abs_scaling(read(spark, sf, "customer"), ["c_acctbal"]), 6, "c_acctbal").select("c_custkey", "c_acctbal")


@check("log_transform", """select c_custkey, round(sign(c_acctbal) * ln(1 + abs(c_acctbal)), 6) as c_acctbal from customer""")
def _(spark, sf):
    return rounded(H.log_transform(read(spark, sf, "customer"), ["c_acctbal"]), 6, "c_acctbal").select("c_custkey", "c_acctbal")


_YJ = """case when x >= 0 then case when abs(l) < 1e-9 then ln(1 + x) else (pow(x + 1, l) - 1) / l end
 else case when abs(2 - l) < 1e-9 then -ln(1 - x) else -(pow(1 - x, 2 - l) - 1) / (2 - l) end end"""


@check("power_transform_yeo_johnson", f"""with g as (select round(-2 + 0.1 * i, 1)::double as l from range(41) t(i)), d as (select event_id, value - 20 as x from events),
 s as (select l, -count(*) / 2.0 * ln(var_pop({_YJ})) + (l - 1) * sum(sign(x) * ln(1 + abs(x))) as ll from d, g group by l),
 b as (select l from s order by ll desc, l limit 1)
select event_id, round({_YJ}, 4) as value from d, b""")
def _(spark, sf):
    events = read(spark, sf, "events").selectExpr("event_id", "value - 20 as value")
    return rounded(H.power_transform_yeo_johnson(events, ["value"]), 4, "value")


def _knots(c, t, n):
    qs = ", ".join(f"quantile_cont({c}, {i / n})" for i in range(n + 1))
    return f"(select v, p as h, lead(v) over (order by p) as v1, lead(p) over (order by p) as h1 from (select unnest([{qs}]) as v, unnest([{', '.join(str(i / n) for i in range(n + 1))}])::double as p from {t}))"


@check("quantile_transform", f"""select o_orderkey, round(case when x = hi then 1 else h + (h1 - h) * (x - v) / (v1 - v) end, 6) as o_totalprice
 from (select o_orderkey, o_totalprice as x from orders) o, (select max(o_totalprice) as hi from orders), {_knots('o_totalprice', 'orders', 10)} k
 where x >= v and (x < v1 or (x = hi and v1 = hi))""")
def _(spark, sf):
    return rounded(H.quantile_transform(read(spark, sf, "orders"), ["o_totalprice"], knots=10), 6, "o_totalprice").select("o_orderkey", "o_totalprice")


@check("quantile_transform_normal")
def _(spark, sf):
    return H.quantile_transform(read(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice"), ["l_extendedprice"], "normal", 1000)


# --- Binning -------------------------------------------------------------------------------


@check("equal_width_binning", """select o_orderkey, least(9, floor((o_totalprice - lo) / (hi - lo) * 10))::int as o_totalprice_bin from orders, (select min(o_totalprice) as lo, max(o_totalprice) as hi from orders)""")
def _(spark, sf):
    return B.equal_width_binning(read(spark, sf, "orders"), "o_totalprice", 10).select("o_orderkey", "o_totalprice_bin")


@check("equal_frequency_binning", f"""select event_id, (ntile(4) over (partition by user_id order by value, event_id) - 1)::double as value_bin from {HOLED} where value is not null
 union all select event_id, null from {HOLED} where value is null""")
def _(spark, sf):
    out = B.equal_frequency_binning(holed(spark, sf), "value", 4, "event_id", "user_id")
    return out.select("event_id", F.col("value_bin").cast("double").alias("value_bin"))


@check("equal_frequency_binning_global", "select o_orderkey, (ntile(7) over (order by o_totalprice, o_orderkey) - 1)::int as o_totalprice_bin from orders")
def _(spark, sf):
    return B.equal_frequency_binning(read(spark, sf, "orders"), "o_totalprice", 7, "o_orderkey").select("o_orderkey", "o_totalprice_bin")


@check("quantile_binning", """select o_orderkey, (o_totalprice >= a)::int + (o_totalprice >= b)::int + (o_totalprice >= c)::int as o_totalprice_bin from orders,
 (select quantile_cont(o_totalprice, 0.1) as a, quantile_cont(o_totalprice, 0.5) as b, quantile_cont(o_totalprice, 0.9) as c from orders)""")
def _(spark, sf):
    return B.quantile_binning(read(spark, sf, "orders"), "o_totalprice", [0.1, 0.5, 0.9]).select("o_orderkey", "o_totalprice_bin")


def _lloyd(c, t, key, k, iters):
    qs = ", ".join(f"quantile_cont({c}, {(i + 0.5) / k})" for i in range(k))
    mid = lambda a: " + ".join(f"({a}.x >= (c[{i}] + c[{i + 1}]) / 2)::int" for i in range(1, k))
    sql = f"with d as (select {key}, {c} as x from {t}), c0 as (select [{qs}] as c from {t})"
    for n in range(iters):
        sql += f",\n c{n + 1} as (select list(m order by b) as c from (select {mid('d')} as b, avg(x) as m from d, c{n} group by 1))"
    return sql + f"\nselect {key}, {mid('d')} as {c}_bin from d, c{iters}"


@check("kmeans_binning", _lloyd("value", "events", "event_id", 4, 5))
def _(spark, sf):
    return B.kmeans_binning(read(spark, sf, "events"), "value", 4, 5).select("event_id", "value_bin")


@check("decision_tree_binning")
def _(spark, sf):
    events = read(spark, sf, "events").withColumn("bad", (F.col("event_type") == "error").cast("double"))
    return B.decision_tree_binning(events, "value", "bad", 2).select("event_id", "value_bin")


@check("decision_tree_binning_exact", """with v as (select value::double as x, count(*)::double as n, sum(case when event_type = 'error' then 1.0::double else 0.0::double end) as s from events where value is not null group by 1),
 r as (select x, sum(n) over w as nl, sum(s) over w as sl, sum(n) over () as nt, sum(s) over () as st, lead(x) over (order by x) as nx from v window w as (order by x)),
 b as (select x + (nx - x) / 2 as cut from r where nt > nl order by sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) - st * st / nt desc, x limit 1)
select event_id, case when value is not null then (value > cut)::int end as value_bin from events, b""")
def _(spark, sf):
    events = read(spark, sf, "events").withColumn("bad", (F.col("event_type") == "error").cast("double"))
    return B.decision_tree_binning(events, "value", "bad", 1, max_bins=None).select("event_id", "value_bin")


@check("custom_threshold_binning", """select event_id, case when value >= 0 and value < 5 then 'low' when value >= 5 and value < 20 then 'mid' when value >= 20 and value <= 100 then 'high' end as value_bin from events""")
def _(spark, sf):
    return B.custom_threshold_binning(read(spark, sf, "events"), "value", [0, 5, 20, 100], ["low", "mid", "high"]).select("event_id", "value_bin")


# --- Features ---------------------------------------------------------------------------------


@check("polynomial_features", """select l_orderkey, l_partkey, round(l_quantity * l_quantity, 4) as l_quantity_x_l_quantity, round(l_quantity * l_tax, 4) as l_quantity_x_l_tax,
 round(l_tax * l_tax, 6) as l_tax_x_l_tax from lineitem""")
def _(spark, sf):
    out = J.polynomial_features(read(spark, sf, "lineitem"), ["l_quantity", "l_tax"], 2)
    out = rounded(rounded(out, 4, "l_quantity_x_l_quantity", "l_quantity_x_l_tax"), 6, "l_tax_x_l_tax")
    return out.select("l_orderkey", "l_partkey", "l_quantity_x_l_quantity", "l_quantity_x_l_tax", "l_tax_x_l_tax")


@check("interaction_terms", """select l_orderkey, l_partkey, round(l_quantity * l_discount, 4) as l_quantity_x_l_discount, round(l_quantity * l_tax, 4) as l_quantity_x_l_tax,
 round(l_discount * l_tax, 6) as l_discount_x_l_tax from lineitem""")
def _(spark, sf):
    out = J.interaction_terms(read(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"])
    out = rounded(rounded(out, 4, "l_quantity_x_l_discount", "l_quantity_x_l_tax"), 6, "l_discount_x_l_tax")
    return out.select("l_orderkey", "l_partkey", "l_quantity_x_l_discount", "l_quantity_x_l_tax", "l_discount_x_l_tax")


@check("ratio_features", """select l_orderkey, l_partkey, round(case when l_tax <> 0 then l_discount / l_tax end, 6) as l_discount_per_l_tax from lineitem""")
def _(spark, sf):
    out = J.ratio_features(read(spark, sf, "lineitem"), [("l_discount", "l_tax")])
    return rounded(out, 6, "l_discount_per_l_tax").select("l_orderkey", "l_partkey", "l_discount_per_l_tax")


@check("aggregation_features", """select c_custkey, n_orders, round(spent::double, 2) as spent from customer left join (select o_custkey as c_custkey, count(*)::double as n_orders, sum(o_totalprice) as spent from orders group by 1) using (c_custkey)""")
def _(spark, sf):
    orders = read(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    out = J.aggregation_features(read(spark, sf, "customer"), "c_custkey", {"n_orders": ("count", "*"), "spent": ("sum", "o_totalprice")}, orders)
    return out.select("c_custkey", F.col("n_orders").cast("double").alias("n_orders"), F.round("spent", 2).alias("spent"))


@check("aggregation_rollup", """select l_returnflag, l_linestatus, count(*) as n, round(avg(l_quantity), 6) as mean_qty, grouping(l_returnflag, l_linestatus)::bigint as grouping_id from lineitem group by rollup (l_returnflag, l_linestatus)""")
def _(spark, sf):
    return rounded(J.group_statistics(read(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"n": ("count", "*"), "mean_qty": ("avg", "l_quantity")}, "rollup"), 6, "mean_qty")


@check("aggregation_cube", """select o_orderstatus, o_orderpriority, count(*) as n, min(o_totalprice) as low, grouping(o_orderstatus, o_orderpriority)::bigint as grouping_id from orders group by cube (o_orderstatus, o_orderpriority)""")
def _(spark, sf):
    return J.group_statistics(read(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], {"n": ("count", "*"), "low": ("min", "o_totalprice")}, "cube")


@check("lag_features", """select event_id, lag(value, 1) over w as value_lag1, round(value - lag(value, 1) over w, 6) as value_lag1_diff, lead(value, 2) over w as value_lead2,
 round(value - lead(value, 2) over w, 6) as value_lead2_diff from events window w as (partition by user_id order by ts, event_id)""")
def _(spark, sf):
    out = J.lag_features(read(spark, sf, "events"), ["value"], [1, -2], ["ts", "event_id"], "user_id", diffs=True)
    return rounded(out, 6, "value_lag1_diff", "value_lead2_diff").select("event_id", "value_lag1", "value_lag1_diff", "value_lead2", "value_lead2_diff")


def _rolling(span, frame):
    return f"""select event_id, round(sum(value) over w, 4) as value_sum_{span}, round(avg(value) over w, 6) as value_avg_{span}, min(value) over w as value_min_{span},
 max(value) over w as value_max_{span}, round(stddev_samp(value) over w, 4) as value_std_{span} from events window w as (partition by user_id order by {frame})"""


@check("rolling_window_rows", _rolling("10r", "ts, event_id rows between 9 preceding and current row"))
def _(spark, sf):
    out = J.rolling_window_features(read(spark, sf, "events"), ["value"], ["ts", "event_id"], "user_id", rows=10)
    out = rounded(out, 6, "value_avg_10r")
    return rounded(out, 4, "value_sum_10r", "value_std_10r").drop("ts", "user_id", "event_type", "value", "props")


@check("rolling_window_time", _rolling("86400s", "ts range between interval 1 day preceding and current row"))
def _(spark, sf):
    out = J.rolling_window_features(read(spark, sf, "events"), ["value"], ["ts"], "user_id", seconds=86400)
    out = rounded(out, 6, "value_avg_86400s")
    return rounded(out, 4, "value_sum_86400s", "value_std_86400s").drop("ts", "user_id", "event_type", "value", "props")


@check("date_part_features", """select event_id, year(ts)::int as ts_year, quarter(ts)::int as ts_quarter, month(ts)::int as ts_month, isodow(ts)::int as ts_weekday, hour(ts)::int as ts_hour,
 (isodow(ts) >= 6)::int as ts_is_weekend from events""")
def _(spark, sf):
    return J.date_part_features(read(spark, sf, "events"), "ts").drop("ts", "user_id", "event_type", "value", "props")


_FK = {
    "region": ["r_regionkey"], "nation": ["n_nationkey", "n_regionkey"], "customer": ["c_custkey", "c_nationkey"],
    "supplier": ["s_suppkey", "s_nationkey"], "part": ["p_partkey"], "orders": ["o_orderkey", "o_custkey"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey"],
}


def _fk_sql():
    values = union([f"select '{t}.{c}' as col, '{t}' as tbl, {c}::varchar as v, count(*) as n from {t} group by {c}" for t, cs in _FK.items() for c in cs])
    return f"""with a as materialized ({values}), s as (select col, count(*) as c, max(n) = 1 as u from a group by 1),
 p as (select x.col as child, y.col as parent, count(*) as found from a x join a y on x.v = y.v and x.tbl <> y.tbl group by 1, 2)
select child, parent, s1.c as child_values, found, round(found / s1.c, 6) as coverage, s2.u as parent_unique, found = s1.c and s2.u as is_foreign_key
 from p join s s1 on s1.col = child join s s2 on s2.col = parent"""


@check("foreign_keys", _fk_sql())
def _(spark, sf):
    return rounded(J.foreign_keys({t: read(spark, sf, t) for t in _FK}, _FK), 6, "coverage")


@check("hierarchy", union([f"""select '{a}' as child, '{b}' as parent, count(*) as child_values, max(n) as most_parents, max(n) <= 1 as is_hierarchy
 from (select {a}, count(distinct {b}) as n from {t} group by 1)""" for a, b, t in [
    ("n_nationkey", "n_regionkey", "nation"), ("p_brand", "p_type", "part"), ("p_name", "p_brand", "part")]]))
def _(spark, sf):
    part = J.hierarchy(read(spark, sf, "part"), [("p_brand", "p_type"), ("p_name", "p_brand")])
    return J.hierarchy(read(spark, sf, "nation"), [("n_nationkey", "n_regionkey")]).unionByName(part)


@check("network_edges", "select l_partkey as src, l_suppkey as dst, count(*) as weight from lineitem group by 1, 2")
def _(spark, sf):
    return J.network_edges(read(spark, sf, "lineitem"), "l_partkey", "l_suppkey")
