"""Structured content from text responses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import q

# A fenced JSON object, and a fenced or bare Python block.
JSON_FENCE = r"(?is)```json\s*(\{.*?\})\s*```"
CODE_FENCE = r"(?is)```(?:python)?\s*(.*?)```"

NO_JSON = "No JSON object found in model response."
BAD_JSON = "Invalid JSON in model response."
NO_STEPS = "Planner response JSON must contain a 'steps' key with a list of steps."


def extract_json(df: DataFrame, col: str, schema: T.StructType | str, name: str = "parsed") -> DataFrame:
    """The first fenced JSON object as a struct, and ``<name>_error`` where there is none or it is broken."""
    block = F.when(q(col).rlike(JSON_FENCE), F.regexp_extract(q(col), JSON_FENCE, 1))
    error = F.when(block.isNull(), F.lit(NO_JSON)).when(F.try_parse_json(block).isNull(), F.lit(BAD_JSON))
    return df.withColumns(
        {name: F.when(error.isNull(), F.from_json(block, schema)), f"{name}_error": error}
    )


def extract_code(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """The first fenced block, or the whole text, without outer blanks."""
    body = F.when(q(col).rlike(CODE_FENCE), F.regexp_extract(q(col), CODE_FENCE, 1)).otherwise(q(col))
    return df.withColumn(name, F.regexp_replace(body, r"^\s+|\s+$", ""))


def plan_steps(df: DataFrame, col: str) -> DataFrame:
    """One row per plan step with its position; an error row where there is no list of steps."""
    found = extract_json(df, col, "steps array<string>", "_plan")
    block = F.when(q(col).rlike(JSON_FENCE), F.regexp_extract(q(col), JSON_FENCE, 1))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(block), "$.steps", "variant"))
    listed = F.coalesce(F.startswith(kind, F.lit("ARRAY")), F.lit(False))
    error = F.coalesce(F.col("_plan_error"), F.when(~listed, F.lit(NO_STEPS)))
    out = found.withColumn("error", error)
    steps = F.when(F.col("error").isNull(), F.col("_plan.steps"))
    return out.select(*[q(c) for c in df.columns], F.posexplode_outer(steps).alias("step_pos", "step"), "error")
