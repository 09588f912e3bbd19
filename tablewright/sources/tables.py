"""Reading and writing tables, policies and state logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.common import q
from ..functions.ordered import sort_columns

POLICY_SCHEMA = "field_pattern string, action string, proba double, space map<string,double>"

# The message of a failed state that names no error.
DEFAULT_FAILURE = "StateMessage failed without specific error message."


def read_table(
    spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | str | None = None
) -> DataFrame:
    """Load csv, json, parquet or orc. CSV has a header; its types are inferred unless a schema is given.

    Inference is a second scan of the data, so pass a schema for large files.
    """
    if fmt not in ("csv", "json", "parquet", "orc"):
        raise ValueError(f"unsupported table format {fmt!r}")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True).option("inferSchema", schema is None)
    return reader.load(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write with a header row. Timestamps keep their microseconds."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
        .csv(path)
    )


def preview(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """The first ``n`` rows by the given order (a leading ``-`` is descending)."""
    return df.orderBy(*sort_columns(order_by)).limit(n)


def html_tables(df: DataFrame, html_col: str, id_col: str) -> DataFrame:
    """Every ``<table>`` of an HTML text as rows ``(id, table_idx, row_idx, cells)``; row 0 is the header."""
    text = F.regexp_replace(q(html_col), r"```(?:html)?", "")
    tables = F.regexp_extract_all(text, F.lit(r"(?is)<table[^>]*>(.*?)</table>"), F.lit(1))
    rows = F.regexp_extract_all(F.col("t"), F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), F.lit(1))
    cells = F.regexp_extract_all(F.col("r"), F.lit(r"(?is)<t[hd][^>]*>(.*?)</t[hd]>"), F.lit(1))
    return (
        df.select(q(id_col), F.posexplode(tables).alias("table_idx", "t"))
        .select(id_col, "table_idx", F.posexplode(rows).alias("row_idx", "r"))
        .select(id_col, "table_idx", "row_idx", F.transform(cells, _cell_text).alias("cells"))
    )


def _cell_text(cell):
    bare = F.regexp_replace(cell, r"<[^>]+>", "")
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def html_links(df: DataFrame, html_col: str, id_col: str) -> DataFrame:
    """Every link target of an HTML text as rows ``(id, pos, href)``.

    Tags and attributes in any case, other attributes before ``href``, both kinds of quotes or none.
    """
    pattern = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    quoted = F.regexp_extract_all(q(html_col), F.lit(pattern), F.lit(1))
    hrefs = F.transform(quoted, lambda x: F.regexp_replace(x, "^[\"']|[\"']$", ""))
    return df.select(q(id_col), F.posexplode(hrefs).alias("pos", "href"))


def save_policy(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Persist a learned policy table."""
    df.select("field_pattern", "action", "proba", "space").write.mode(mode).parquet(path)


def load_policy(spark: SparkSession, path: str) -> DataFrame:
    """Read a saved policy; fails at once where there is none."""
    return spark.read.schema(POLICY_SCHEMA).parquet(path)


def normalise_status(df: DataFrame) -> DataFrame:
    """State rows with consistent ``success``, ``statusCode`` and ``errorMessage``.

    A failed row without a message gets the fixed one, and a failed row with status 200
    gets 500. Ids become text.
    """
    bad = ~F.coalesce(F.col("success"), F.lit(False))
    blank = F.coalesce(F.col("errorMessage"), F.lit("")) == ""
    out = df.withColumns(
        {
            "errorMessage": F.when(bad & blank, F.lit(DEFAULT_FAILURE)).otherwise(F.col("errorMessage")),
            "statusCode": F.when(bad & (F.col("statusCode") == 200), F.lit(500)).otherwise(F.col("statusCode")),
        }
    )
    ids = [c for c in ("sessionId", "eventId") if c in df.columns]
    return out.withColumns({c: q(c).cast("string") for c in ids})


def append_state_log(df: DataFrame, path: str) -> None:
    """Append normalised state rows to the log table."""
    normalise_status(df).write.mode("append").parquet(path)
