"""Small helpers for functions that run over Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Spark's name for the deleted characters ``[\x20\x09-\x0D]``, as bytes.
SPACE = b" \t\n\x0b\x0c\r"

#: Lower-cases A-Z and leaves every other byte alone.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a text column; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    """The texts of a column; null counts as empty, bytes that are no UTF-8 become U+FFFD."""
    return [x.decode("utf-8", "replace") for x in raw(column)]


def slices(batches: Iterable[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows`` rows, so that only few texts are Python objects at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def task_id() -> int:
    """The number of the partition that this task works on; equal when the task is run again."""
    return TaskContext.get().partitionId()


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, so that other columns never clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fold(id_col: Column | str, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; a null identifier counts as the empty text."""
    column = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def replace_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    """The batch with ``values`` as its last column; a column that had the name before goes."""
    names = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), values], [*names, name])


def schema_with(df: DataFrame, name: str, kind: str) -> str:
    """The DDL of ``df`` with one more last column."""
    from pyspark.sql.types import StructField, StructType, _parse_datatype_string

    fields = [f for f in df.schema.fields if f.name != name]
    return StructType([*fields, StructField(name, _parse_datatype_string(kind))])
