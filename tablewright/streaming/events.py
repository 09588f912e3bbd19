"""Session events, and profiles, deduplication and policy state on streams.

Every function takes a streaming or a batch DataFrame and stays lazy. Event times are cast
to ``timestamp``, which watermarks need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import as_list, is_missing, numeric_columns, present, q

# The default stages and the markers of a session's last event.
DEFAULT_STAGES = ["data-ingestion", "data-cleaning", "data-analytics", "data-quality-check"]
END_MARK = "[END]"
ERROR_MARK = "[ERROR]"
NO_STAGES = "No pipeline stages defined in workspace configuration."


def stage_events(
    sessions: DataFrame, session_col: str, stages: Sequence[str] = DEFAULT_STAGES, at: Column | None = None
) -> DataFrame:
    """The event rows of each session: one per stage, then ``[END]``; without stages one ``[ERROR]`` row.

    Stateless, so it works on batches and on streams alike. The event id depends on session
    and position only. ``at`` is the event time, by default the current time.
    """
    n = len(stages)
    text = lambda v: F.lit(v).cast("string")
    if n:
        rows = [(f"Processing {i + 1} / {n} stage: {s}", s, 200, None) for i, s in enumerate(stages)]
        rows.append((END_MARK, END_MARK, 200, None))
    else:
        rows = [(ERROR_MARK, ERROR_MARK, 500, NO_STAGES)]
    events = F.array(
        *[
            F.struct(
                text(content).alias("content"),
                text(stage).alias("stage"),
                F.lit(code).alias("statusCode"),
                text(error).alias("errorMessage"),
            )
            for content, stage, code, error in rows
        ]
    )
    session = q(session_col).cast("string")
    when = F.current_timestamp() if at is None else at
    return sessions.select(session.alias("sessionId"), when.alias("eventTimestamp"), F.posexplode(events).alias("pos", "e")).select(
        "e.content",
        "sessionId",
        "e.statusCode",
        "e.errorMessage",
        "e.stage",
        F.md5(F.concat_ws("|", "sessionId", F.col("pos").cast("string"))).alias("eventId"),
        "eventTimestamp",
        "pos",
    )


def with_event_time(df: DataFrame, ts: str, delay: str | None) -> DataFrame:
    timed = df.withColumn(ts, q(ts).cast("timestamp"))
    return timed.withWatermark(ts, delay) if delay is not None and timed.isStreaming else timed


def stream_profile(
    stream: DataFrame, ts: str, cols: Sequence[str], delay: str, window: str, slide: str | None = None, by: Sequence[str] | str | None = None
) -> DataFrame:
    """Rows, and per column nulls, mean, min and max, in tumbling or sliding windows.

    Rows later than the watermark are dropped. State is a few numbers per window and group.
    """
    timed = with_event_time(stream, ts, delay)
    span = F.window(q(ts), window, slide) if slide else F.window(q(ts), window)
    numeric = numeric_columns(timed, cols)
    aggs = [F.count("*").alias("n_rows")]
    for c in cols:
        aggs.append(F.count(F.when(is_missing(timed, c), 1)).alias(f"{c}_nulls"))
        if c in numeric:
            x = present(timed, c).cast("double")
            aggs += [F.avg(x).alias(f"{c}_mean"), F.min(x).alias(f"{c}_min"), F.max(x).alias(f"{c}_max")]
        else:
            aggs.append(F.approx_count_distinct(q(c)).alias(f"{c}_unique_approx"))
    out = timed.groupBy(span.alias("w"), *as_list(by)).agg(*aggs)
    names = [a for a in out.columns if a != "w"]
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *names)


def stream_dedup(stream: DataFrame, keys: Sequence[str], ts: str, delay: str) -> DataFrame:
    """The first row per key; a key is remembered for as long as the watermark delay."""
    timed = with_event_time(stream, ts, delay)
    if timed.isStreaming:
        return timed.dropDuplicatesWithinWatermark(list(keys))
    return timed.dropDuplicates(list(keys))


def session_progress(
    stream: DataFrame, session_col: str, ts: str, stage: str, gap: str, delay: str, status: str | None = None
) -> DataFrame:
    """Per session of activity (closed by a gap): start, end, events, last stage and last status.

    Of rows at the last instant that with the greatest stage, then status, counts as the last.
    """
    timed = with_event_time(stream, ts, delay)
    latest = F.struct(q(ts), q(stage), q(status)) if status else F.struct(q(ts), q(stage))
    last = [F.max_by(q(stage), latest).alias("last_stage")]
    if status:
        last.append(F.max_by(q(status), latest).alias("last_status"))
    grouped = timed.groupBy(F.session_window(q(ts), gap).alias("w"), q(session_col))
    out = grouped.agg(F.count("*").alias("n_events"), *last)
    names = [c for c in out.columns if c not in ("w", session_col)]
    return out.select(session_col, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *names)


def stream_policy(stream: DataFrame, pattern: str = "field_pattern", action: str = "action", success: str = "success", value: str | None = None) -> DataFrame:
    """Running count, successes (and value) per pattern and action: the state of a durable reward store."""
    aggs = [F.count("*").alias("n"), F.sum(q(success).cast("bigint")).alias("successes")]
    if value:
        aggs.append(F.sum(q(value).cast("double")).alias("value"))
    return stream.groupBy(q(pattern).alias("field_pattern"), q(action).alias("action")).agg(*aggs)
