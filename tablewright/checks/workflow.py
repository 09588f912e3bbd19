"""Graph ranking, action policy, response parsing, plans and streams."""

from pyspark.sql import functions as F

from ..operators import graph as N
from ..operators import parse as P
from ..operators import policy as O
from ..operators.reduce import moment_sums
from ..plans.apply import Step, apply_plan, evaluate_plan
from ..plans.catalog import ACTIONS, action_catalog, action_labels
from ..sources.tables import html_links
from ..streaming import events as Q
from ..streaming import run as S
from . import check, read
from .cleaning import scratch
from .profiles import HOLED, holed, rounded, union

# --- Graphs ----------------------------------------------------------------------------

_NEXT = "(select event_type as src, lead(event_type) over (partition by user_id order by ts, event_id) as dst from events)"
_EDGES = f"(select src, dst, count(*)::double as cnt from {_NEXT} where dst is not null group by 1, 2)"
_SUPPLY = "(select 'p' || l_partkey as src, 's' || l_suppkey as dst, count(*)::double as cnt from lineitem group by 1, 2)"


def event_edges(spark, sf):
    return N.edges_from_sequence(read(spark, sf, "events"), "event_type", ["ts", "event_id"], "user_id")


def supply_edges(spark, sf):
    pairs = read(spark, sf, "lineitem").selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst")
    return pairs.groupBy("src", "dst").agg(F.count("*").cast("double").alias("cnt"))


def _trans(edges):
    return f"""e as materialized (select * from {edges}), nd as materialized (select distinct n from (select src as n from e union all select dst from e)),
 t as (select src, sum(cnt) as s from e group by 1 having sum(cnt) <> 0),
 m as materialized (select e.src, dst, cnt / s as p from e join t using (src) union all select n, n, 1.0 from nd where n not in (select src from t))"""


@check("edges_from_lists", """select page_id::varchar as src, h as dst, count(*)::double as cnt from (select page_id, unnest(list_transform(regexp_extract_all(html, '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*("[^"]*"|''[^'']*''|[^\\s>"'']+)', 1), lambda x: regexp_replace(x, '^["'']|["'']$', '', 'g'))) as h from pages) group by 1, 2""")
def _(spark, sf):
    links = html_links(read(spark, sf, "pages"), "html", "page_id")
    lists = links.groupBy(F.col("page_id").cast("string").alias("page")).agg(F.collect_list("href").alias("links"))
    return N.edges_from_lists(lists, "page", "links")


@check("edges_from_sequence", f"select * from {_EDGES}")
def _(spark, sf):
    return event_edges(spark, sf)


@check("merge_edges", f"select src, dst, sum(cnt) as cnt from (select * from {_EDGES} union all select event_type, event_type, count(*) from events group by 1) group by 1, 2")
def _(spark, sf):
    own = read(spark, sf, "events").groupBy(F.col("event_type").alias("src"), F.col("event_type").alias("dst")).agg(F.count("*").cast("double").alias("cnt"))
    return N.merge_edges(event_edges(spark, sf), own)


@check("transition_matrix", f"with {_trans(_SUPPLY)} select src, dst, round(p, 6) as p from m")
def _(spark, sf):
    return rounded(N.transition_matrix(supply_edges(spark, sf)), 6, "p")


def _rank_sql(edges, steps, places, start="1.0 / c"):
    sql = f"with {_trans(edges)}, c as (select count(*)::double as c from nd), r0 as materialized (select n, {start} as w from nd, c)"
    for i in range(steps):
        sql += f""",
 r{i + 1} as materialized (select n, 0.15 / any_value(c) + 0.85 * coalesce(sum(p * w), 0) as w from c, nd left join (select dst, p, w from m join r{i} on r{i}.n = m.src) x on x.dst = nd.n group by n)"""
    return sql + f"\nselect n as node, round(w, {places}) as rank from r{steps}"


@check("pagerank", _rank_sql(_SUPPLY, 6, 9))
def _(spark, sf):
    return rounded(N.pagerank(supply_edges(spark, sf), eps=None, max_iter=5), 9, "rank")


@check("pagerank_converged", _rank_sql(_EDGES, 120, 8))
def _(spark, sf):
    return rounded(N.pagerank(event_edges(spark, sf)), 8, "rank")


@check("pagerank_seeded", _rank_sql(_EDGES, 4, 8, "(1.0 / c + (n = 'error')::int) / 2.0"))
def _(spark, sf):
    edges = event_edges(spark, sf)
    seeds = read(spark, sf, "events").where("event_type = 'error'").select(F.col("event_type").alias("node"))
    return rounded(N.pagerank_seeded(edges, seeds, eps=None, max_iter=3), 8, "rank")


@check("next_step", f"with {_trans(_EDGES)} select n as node, round(coalesce(p, 0), 6) as p from nd left join m on dst = n and src = 'click'")
def _(spark, sf):
    return rounded(N.next_step(event_edges(spark, sf), "click"), 6, "p")


@check("online_transition_update", f"""with {_trans(_SUPPLY)}, c as (select count(*)::double as c from nd),
 l as (select 'p' || l_partkey as src, 's' || l_suppkey as dst, count(*) as k from lineitem where l_returnflag = 'R' group by 1, 2),
 u as (select src, dst, k, pow(0.85, coalesce(k, 0)) * coalesce(p, 0) + (1 - pow(0.85, coalesce(k, 0))) / c as a from m full join l using (src, dst), c),
 s as (select src, sum(a) as t, count(k) as fresh from u group by 1)
select src, dst, round(case when fresh > 0 then a / t else a end, 6) as p from u join s using (src)""")
def _(spark, sf):
    edges = supply_edges(spark, sf)
    links = read(spark, sf, "lineitem").where("l_returnflag = 'R'").selectExpr("concat('p', l_partkey) as src", "concat('s', l_suppkey) as dst")
    return rounded(N.online_transition_update(N.transition_matrix(edges), links, N.nodes_of(edges)), 6, "p")


@check("unseen_sources", "select distinct o_custkey::varchar as src from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
def _(spark, sf):
    links = read(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("src"))
    nodes = read(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("node"))
    return N.unseen_sources(links, nodes)


# --- Policy -------------------------------------------------------------------------------

_STAGE = "scaling-normalization"
_LABELS = action_labels(_STAGE)
_N = len(_LABELS)
_LABEL_SQL = "[" + ", ".join(f"'{a}'" for a in _LABELS) + "]"
_WEIGHT = lambda i: f"((event_id + {i}) % 10 + 1)"
_TOTAL = " + ".join(_WEIGHT(i * i) for i in range(_N))
_LOG = union([
    f"select event_id, user_id, ts, 'P' || user_id % 20 as field_pattern, '{a}' as act, {_WEIGHT(i * i)}::double / ({_TOTAL}) as p from events"
    for i, a in enumerate(_LABELS)])


def log_rows(spark, sf):
    """A policy log: every event is one past decision."""
    space = ", ".join(f"'{a}', cast({_WEIGHT(i * i)} as double)" for i, a in enumerate(_LABELS))
    labels = "array(" + ", ".join(f"'{a}'" for a in _LABELS) + ")"
    return read(spark, sf, "events").selectExpr(
        "concat('P', user_id % 20) as field_pattern",
        f"element_at({labels}, cast(event_id % {_N} as int) + 1) as action",
        f"map({space}) as space",
        f"'{_STAGE}' as stage",
        "event_type != 'error' as success",
        "cast(event_id as string) as eventId",
        "cast(user_id as string) as sessionId",
        "event_id",
        "ts as timestamp",
        "value",
    )


_CATALOG = union([f"select '{s}' as stage, {i} as stage_pos, '{a}' as action, {j} as action_pos" for i, (s, acts) in enumerate(ACTIONS.items()) for j, a in enumerate(acts)])


@check("action_catalog", f"""select stage, stage_pos, action, action_pos, (select count(*) from events where ({_LABEL_SQL})[event_id % {_N} + 1] = action and stage = '{_STAGE}') as uses from ({_CATALOG})""")
def _(spark, sf):
    uses = log_rows(spark, sf).groupBy("stage", "action").agg(F.count("*").alias("uses"))
    out = action_catalog(spark).join(uses, ["stage", "action"], "left")
    return out.select("stage", "stage_pos", "action", "action_pos", F.coalesce("uses", F.lit(0)).cast("bigint").alias("uses"))


@check("select_actions", f"""with l as ({_LOG}), b as (select field_pattern, act, avg(p) as p from l group by 1, 2),
 best as (select field_pattern, act, p from b qualify row_number() over (partition by field_pattern order by round(p, 12) desc, list_position({_LABEL_SQL}, act)) = 1),
 s as (select event_id as session_id, 'P' || user_id % 25 as field_pattern, case when event_type = 'error' then 'encoding' else '{_STAGE}' end as stage,
  ('0x' || substr(md5(concat_ws('|', event_id::varchar, 'action', '42')), 1, 8))::bigint % 7 as pick from events)
select session_id, field_pattern, stage, case when act is not null and stage = 'encoding' then null when act is not null then act
 else (case when stage = 'encoding' then {"[" + ", ".join(f"'{a}'" for a in action_labels("encoding")) + "]"} else {_LABEL_SQL} end)[pick + 1] end as action,
 case when act is not null and stage = 'encoding' then null when act is not null then round(p, 6) else round(1.0 / 7, 6) end::double as proba,
 case when act is not null and stage = 'encoding' then 'Action space mismatch with recorded actions.' end as error from s left join best using (field_pattern)""")
def _(spark, sf):
    sessions = read(spark, sf, "events").selectExpr(
        "event_id as session_id", "concat('P', user_id % 25) as field_pattern",
        f"case when event_type = 'error' then 'encoding' else '{_STAGE}' end as stage",
    )
    return rounded(O.select_actions(sessions, log_rows(spark, sf), action_catalog(spark)), 6, "proba")


@check("update_policy", f"""select field_pattern, action, count(*) as n from (select 'P' || user_id % 20 as field_pattern, ({_LABEL_SQL})[event_id % {_N} + 1] as action from events
 union all select event_type, 'pca' from events) group by 1, 2""")
def _(spark, sf):
    new = read(spark, sf, "events").selectExpr("event_type as field_pattern", "'pca' as action")
    return O.update_policy(log_rows(spark, sf), new).groupBy("field_pattern", "action").agg(F.count("*").alias("n"))


@check("discounted_value", f"""with l as (select 'P' || user_id % 20 as field_pattern, ({_LABEL_SQL})[event_id % {_N} + 1] as action, event_type <> 'error' as ok, ts, event_id from events),
 a as (select *, row_number() over (partition by field_pattern, action order by ts desc, event_id desc) - 1 as age from l)
select field_pattern, action, round(sum(pow(0.5, age) * ok::int), 6) as value, count(*) as n from a group by 1, 2""")
def _(spark, sf):
    return rounded(O.discounted_value(log_rows(spark, sf), order_by=("timestamp", "event_id")), 6, "value")


@check("recent_memory", """select user_id::varchar as "sessionId", event_id, row_number() over w as recency from events window w as (partition by user_id order by ts desc, event_id desc) qualify row_number() over w <= 3""")
def _(spark, sf):
    out = O.recent_memory(log_rows(spark, sf), 3, ("timestamp", "event_id"))
    return out.select("sessionId", "event_id", F.col("recency").cast("bigint").alias("recency"))


@check("policy_table", f"with l as ({_LOG}) select field_pattern, " + ", ".join(f"round(avg(p) filter (act = '{a}'), 6) as {a}" for a in _LABELS) + " from l group by 1")
def _(spark, sf):
    return rounded(O.policy_table(log_rows(spark, sf), _LABELS), 6, *_LABELS)


@check("memory_table", """select event_type as stage, props as response, null::varchar as whisper_response, user_id::varchar as inputs, event_id::varchar as response_id, 'm1' as model_version,
 value > 10 as success, 200 as "statusCode", null::varchar as "errorMessage", 'local' as environment, ts::timestamp as "timestamp" from events""")
def _(spark, sf):
    return O.memory_table(
        read(spark, sf, "events").selectExpr(
            "event_id", "event_type as stage", "props as response", "cast(null as string) as whisper_response", "cast(user_id as string) as inputs",
            "cast(event_id as string) as response_id", "'m1' as model_version", "value > 10 as success", "200 as statusCode",
            "cast(null as string) as errorMessage", "'local' as environment", "ts as timestamp",
        )
    )


# --- Parsing ---------------------------------------------------------------------------------

_RESPONSE = """case event_type when 'error' then 'no plan here'
 when 'click' then 'so ```json {"steps":["' || user_id || '" } ``` end'
 when 'view' then 'plan ```json {"other": ' || user_id || '} ```'
 else 'text ```json {"steps":["' || event_type || '","' || user_id || '"]} ``` and ```json {"steps":[]} ```' end"""


def responses(spark, sf):
    return read(spark, sf, "events").select("event_id", F.expr(_RESPONSE).alias("response"))


@check("extract_json", """select event_id, case when event_type not in ('error', 'click', 'view') then event_type || ',' || user_id end as steps,
 case event_type when 'error' then 'No JSON object found in model response.' when 'click' then 'Invalid JSON in model response.' end as error from events""")
def _(spark, sf):
    out = P.extract_json(responses(spark, sf), "response", "steps array<string>")
    return out.select("event_id", F.array_join("parsed.steps", ",").alias("steps"), F.col("parsed_error").alias("error"))


_CODE = """case event_type when 'error' then '  x = ' || user_id || '  ' when 'click' then 'see ```python\nx = ' || user_id || '\n``` done' else 'see ```\ny = 1\n```' end"""


@check("extract_code", """select event_id, case event_type when 'error' then 'x = ' || user_id when 'click' then 'x = ' || user_id else 'y = 1' end as code from events""")
def _(spark, sf):
    text = read(spark, sf, "events").select("event_id", F.expr(_CODE.replace("\n", "\\n")).alias("t"))
    return P.extract_code(text, "t").select("event_id", "code")


@check("plan_steps", """select event_id, null::double as step_pos, null as step, case event_type when 'error' then 'No JSON object found in model response.' when 'click' then 'Invalid JSON in model response.'
 else 'Planner response JSON must contain a ''steps'' key with a list of steps.' end as error from events where event_type in ('error', 'click', 'view')
 union all select event_id, 0, event_type, null from events where event_type not in ('error', 'click', 'view')
 union all select event_id, 1, user_id::varchar, null from events where event_type not in ('error', 'click', 'view')""")
def _(spark, sf):
    out = P.plan_steps(responses(spark, sf), "response")
    return out.select("event_id", F.col("step_pos").cast("double").alias("step_pos"), "step", "error")


# --- Plans --------------------------------------------------------------------------------------

_PLAN = [
    Step("missing-values-handling", "mean_imputation", {"cols": ["value"]}),
    Step("outlier-handling", "iqr_clipping", {"cols": ["value"]}),
    Step("feature-construction", "date_part_features", {"ts": "ts"}),
    Step("scaling-normalization", "min_max_scaling", {"cols": ["value"]}),
]


@check("apply_plan", f"""with a as (select event_id, ts, coalesce(value, (select avg(value) from {HOLED})) as v from {HOLED}),
 b as (select event_id, ts, least(greatest(v, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) as v from a, (select quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from a))
select event_id, month(ts)::int as ts_month, round((v - lo) / (hi - lo), 6) as value from b, (select min(v) as lo, max(v) as hi from b)""")
def _(spark, sf):
    return rounded(apply_plan(holed(spark, sf), _PLAN), 6, "value").select("event_id", "ts_month", "value")


@check("evaluate_plan", f"""select 'missing_values' as metric, 'value' as "column", (select count(*) - count(value) from {HOLED})::varchar as clean, '0' as dirty
 union all select 'rows', '', (select count(*) from events)::varchar, (select count(*) from events)::varchar union all select 'columns', '', '6', '12'""")
def _(spark, sf):
    report = evaluate_plan(holed(spark, sf), _PLAN)[1]
    return report.where("metric in ('rows', 'columns') or (metric = 'missing_values' and column = 'value')")


# --- Streams --------------------------------------------------------------------------------------


def event_stream(spark, sf):
    return S.read_stream(spark, sf, "events.parquet")


def batched_events(spark, sf, n=3):
    """All events as a stream of ``n`` batches, each later than the one before."""
    events = read(spark, sf, "events")
    ends = events.agg(F.percentile_approx(F.unix_micros(F.col("ts").cast("timestamp")), [i / n for i in range(1, n)], 100).alias("e")).first()["e"]
    part = sum((F.unix_micros(F.col("ts").cast("timestamp")) > end).cast("int") for end in ends)
    folder = scratch(spark, "events")
    for i in range(n):
        events.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    return S.read_stream(spark, folder, files_per_batch=1)


_STAGES = Q.DEFAULT_STAGES
_EVENTS = union([f"select 'Processing {i + 1} / 4 stage: {s}' as content, event_id::varchar as \"sessionId\", 200 as \"statusCode\", '{s}' as stage, {i}::int as pos from events" for i, s in enumerate(_STAGES)]
                + ["select '[END]', event_id::varchar, 200, '[END]', 4 from events"])


@check("stage_events", _EVENTS)
def _(spark, sf):
    return Q.stage_events(read(spark, sf, "events"), "event_id").select("content", "sessionId", "statusCode", "stage", "pos")


@check("stage_events_stream", _EVENTS)
def _(spark, sf):
    out = Q.stage_events(event_stream(spark, sf), "event_id").select("content", "sessionId", "statusCode", "stage", "pos")
    path = scratch(spark, "stage-events")
    S.append_to_table(out, path, scratch(spark, "checkpoint"))
    return spark.read.parquet(path)


@check("stage_events_without_stages", "select '[ERROR]' as content, event_id::varchar as \"sessionId\", 500 as \"statusCode\", 'No pipeline stages defined in workspace configuration.' as \"errorMessage\" from events")
def _(spark, sf):
    return Q.stage_events(read(spark, sf, "events"), "event_id", []).select("content", "sessionId", "statusCode", "errorMessage")


_WINDOWS = """select time_bucket(interval 1 day, ts)::timestamp as window_start, event_type, count(*) as n_rows, count(*) - count(value) as value_nulls,
 round(avg(value), 4) as value_mean, min(value) as value_min, max(value) as value_max from events"""


@check("stream_profile", f"{_WINDOWS} group by 1, 2")
def _(spark, sf):
    out = Q.stream_profile(batched_events(spark, sf), "ts", ["value"], "1 hour", "1 day", by="event_type")
    path = scratch(spark, "windows")
    S.update_table(out, path, scratch(spark, "checkpoint"))
    got = S.latest_rows(spark, path, ["window_start", "event_type"])
    return rounded(got.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end"), 4, "value_mean")


@check("batch_profile_windows", f"{_WINDOWS} group by 1, 2")
def _(spark, sf):
    out = Q.stream_profile(read(spark, sf, "events"), "ts", ["value"], "1 hour", "1 day", by="event_type")
    return rounded(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end"), 4, "value_mean")


@check("stream_dedup", "select distinct user_id, event_type from events")
def _(spark, sf):
    out = Q.stream_dedup(event_stream(spark, sf), ["user_id", "event_type"], "ts", "3650 days")
    path = scratch(spark, "dedup")
    S.append_to_table(out, path, scratch(spark, "checkpoint"))
    return spark.read.parquet(path).select("user_id", "event_type")


_SESSIONS = """(with s as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 6 hours then 1 else 0 end as fresh from events window w as (partition by user_id order by ts)),
 n as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as no from s)
select user_id, min(ts)::timestamp as session_start, (max(ts) + interval 6 hours)::timestamp as session_end, count(*) as n_events, arg_max(event_type, (ts, event_type)) as last_stage from n group by user_id, no)"""


@check("session_progress", f"select * from {_SESSIONS}")
def _(spark, sf):
    out = Q.session_progress(batched_events(spark, sf), "user_id", "ts", "event_type", "6 hours", "1 hour")
    path = scratch(spark, "sessions")
    S.append_to_table(out, path, scratch(spark, "checkpoint"))
    closed = spark.read.parquet(path)
    # sessions that are still open: from the rows after each user's last closed one
    ends = closed.groupBy("user_id").agg(F.max("session_end").alias("_end"))
    rest = read(spark, sf, "events").join(ends, "user_id", "left").where(F.col("_end").isNull() | (F.col("ts").cast("timestamp") >= F.col("_end")))
    got = closed.unionByName(Q.session_progress(rest.drop("_end"), "user_id", "ts", "event_type", "6 hours", "1 hour"))
    return got.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@check("batch_session_progress", f"select * from {_SESSIONS}")
def _(spark, sf):
    out = Q.session_progress(read(spark, sf, "events"), "user_id", "ts", "event_type", "6 hours", "1 hour")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@check("stream_policy", """select event_type as field_pattern, user_id::varchar as action, count(*) as n, count(*) filter (value > 20) as successes, round(sum(value), 2) as value from events group by 1, 2""")
def _(spark, sf):
    log = event_stream(spark, sf).selectExpr("event_type as field_pattern", "cast(user_id as string) as action", "value > 20 as success", "value")
    path = scratch(spark, "policy-state")
    S.update_table(Q.stream_policy(log, value="value"), path, scratch(spark, "checkpoint"))
    return rounded(S.latest_rows(spark, path, ["field_pattern", "action"]), 2, "value")


@check("stream_moments", union([f"select {i - 1} as i, {j - 1} as j, round(avg({a} * {b})::double, 4) as s from events" for i, a in enumerate(["1", "value", "user_id"]) for j, b in enumerate(["1", "value", "user_id"]) if i <= j]))
def _(spark, sf):
    path = scratch(spark, "moments")
    S.stream_moments(event_stream(spark, sf), ["value", "user_id"], path, scratch(spark, "checkpoint"))
    n = read(spark, sf, "events").agg(F.count("*").alias("n")).scalar()
    return moment_sums(S.stored_moments(spark, path)).withColumn("s", F.round(F.col("s") / n, 4))
