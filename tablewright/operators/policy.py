"""Learning from a log which action suits which kind of table.

A log row holds ``field_pattern``, ``action``, ``space`` (map of action to probability),
and the state fields. Sessions ask for an action with ``session_id``, ``field_pattern``
and ``stage``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import hash32, q
from ..functions.ordered import row_numbers

# The tabular state fields, in order.
MEMORY_FIELDS = [
    "stage",
    "response",
    "whisper_response",
    "inputs",
    "response_id",
    "model_version",
    "success",
    "statusCode",
    "errorMessage",
    "environment",
    "timestamp",
]

MISMATCH = "Action space mismatch with recorded actions."


def select_actions(sessions: DataFrame, log: DataFrame, catalog: DataFrame, seed: int = 42) -> DataFrame:
    """``(session_id, field_pattern, stage, action, proba, error)``, one row per session.

    A pattern in the log gets the action with the highest mean of the logged, normalised
    probabilities; ties go to catalog order. An unseen pattern gets a uniform choice that
    depends only on session and seed. A pattern logged with other actions than the stage
    offers is an error row.
    """
    spaces = catalog.groupBy("stage").agg(
        F.sort_array(F.collect_list("action")).alias("_space"), F.count("*").alias("_n")
    )
    names = F.sort_array(F.map_keys("space"))
    logged = log.groupBy("field_pattern").agg(F.min(names).alias("_low"), F.max(names).alias("_high"))
    total = F.aggregate(F.map_values("space"), F.lit(0.0), lambda a, x: a + x)
    long = log.select("field_pattern", total.alias("_t"), F.explode("space").alias("action", "p"))
    means = long.groupBy("field_pattern", "action").agg(F.avg(F.try_divide("p", "_t")).alias("p"))
    ranked = means.join(F.broadcast(catalog.select("stage", "action", "action_pos")), "action")
    best = F.min(F.struct((-F.col("p")).alias("neg"), "action_pos", "action")).alias("_b")
    seen = ranked.groupBy("field_pattern", "stage").agg(best).select(
        "field_pattern", "stage", F.col("_b.action").alias("_best"), (-F.col("_b.neg")).alias("_p")
    )
    ask = (
        sessions.select("session_id", "field_pattern", "stage")
        .join(F.broadcast(spaces), "stage", "left")
        .join(logged, "field_pattern", "left")
        .join(seen, ["field_pattern", "stage"], "left")
    )
    pick = F.pmod(hash32(["session_id"], "action", seed), F.col("_n")).cast("int")
    offered = spaces.select("stage").join(catalog, "stage").groupBy("stage").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("action_pos", "action"))), lambda a: a["action"]).alias("_order")
    )
    ask = ask.join(F.broadcast(offered), "stage", "left")
    known = F.col("_low").isNotNull()
    same = (F.col("_low") == F.col("_space")) & (F.col("_high") == F.col("_space"))
    error = (
        F.when(F.col("_n").isNull(), F.concat(F.lit("Unknown transformation stage '"), F.col("stage"), F.lit("'")))
        .when(known & ~same, F.lit(MISMATCH))
    )
    action = F.when(known, F.col("_best")).otherwise(F.get("_order", pick))
    proba = F.when(known, F.col("_p")).otherwise(1.0 / F.col("_n"))
    return ask.select(
        "session_id",
        "field_pattern",
        "stage",
        F.when(error.isNull(), action).alias("action"),
        F.when(error.isNull(), proba).alias("proba"),
        error.alias("error"),
    )


def update_policy(log: DataFrame, new_rows: DataFrame) -> DataFrame:
    """The log with new (state, action) rows appended under their patterns."""
    return log.unionByName(new_rows, allowMissingColumns=True)


def discounted_value(log: DataFrame, gamma: float = 0.5, order_by: tuple[str, ...] = ("timestamp", "eventId")) -> DataFrame:
    """Sum of ``gamma^age * success`` per pattern and action; the newest row has age 0."""
    newest_first = ["-" + c for c in order_by]
    aged = row_numbers(log, ["field_pattern", "action"], newest_first, "_age")
    worth = F.pow(F.lit(gamma), (F.col("_age") - 1).cast("double")) * F.col("success").cast("double")
    return aged.groupBy("field_pattern", "action").agg(F.sum(worth).alias("value"), F.count("*").alias("n"))


def recent_memory(log: DataFrame, k: int = 3, order_by: tuple[str, ...] = ("timestamp", "eventId")) -> DataFrame:
    """The last k states per session. The limit is applied before the shuffle as well."""
    w = Window.partitionBy("sessionId").orderBy(*[q(c).desc() for c in order_by])
    return log.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= k)


def policy_table(log: DataFrame, actions: list[str]) -> DataFrame:
    """One row per pattern with the mean normalised probability of each listed action."""
    total = F.aggregate(F.map_values("space"), F.lit(0.0), lambda a, x: a + x)
    long = log.select("field_pattern", total.alias("_t"), F.explode("space").alias("_a", "_p"))
    cells = [F.avg(F.when(F.col("_a") == a, F.try_divide("_p", "_t"))).alias(a) for a in actions]
    return long.groupBy("field_pattern").agg(*cells)


def memory_table(log: DataFrame) -> DataFrame:
    """The tabular state fields, in their order."""
    return log.select(*MEMORY_FIELDS)
