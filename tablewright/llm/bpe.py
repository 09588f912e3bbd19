"""Byte-level BPE encoding and decoding with tiktoken and a local rank file."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

from .batches import replace_column, schema_with, slices, texts

#: Texts above this many characters are cut at safe boundaries before they are encoded.
LONG_TEXT = 1 << 16

#: A space or line feed after a character that is no white space always starts a match of the pattern:
#: no match contains white space after another character, and the look-ahead sees nothing to its left.
_SAFE = re.compile(r"(?<=\S)[ \n]")


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    """The ranks of a tiktoken file: base64 of the token, a space, its rank."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str) -> tiktoken.Encoding:
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks(path), special_tokens={})


def pieces(text: str, long_text: int = LONG_TEXT) -> Iterator[str]:
    """The text in parts that can be encoded one by one with the same result."""
    start = 0
    while len(text) - start > long_text:
        cut = _SAFE.search(text, start + long_text)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def encode_text(text: str, path: str, pattern: str, long_text: int = LONG_TEXT) -> list[int]:
    own = encoding(path, pattern)
    if len(text) <= long_text:
        return own.encode_ordinary(text)
    return [i for part in pieces(text, long_text) for i in own.encode_ordinary(part)]


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids", long_text: int = LONG_TEXT) -> DataFrame:
    """``df`` with the token ids of a text column in ``ids_col``, an array of int.

    ``path`` names a rank file that every executor has, ``pattern`` the expression that splits texts
    before the merges. Special tokens are never made. A null or empty text gives an empty array; a column
    that is already called ``ids_col`` is replaced. One map over the rows, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [np.asarray(encode_text(t, path, pattern, long_text), np.int32) for t in texts(batch.column(text_col))]
            ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
            flat = np.concatenate([*found, np.empty(0, np.int32)])
            yield replace_column(batch, ids_col, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)))

    return df.mapInArrow(run, schema_with(df, ids_col, "array<int>"))


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for in ``bytes_col``.

    Bytes, not text: ids may cut a character in two. Null ids give no bytes, an id outside the rank file
    ends the query. A column that is already called ``bytes_col`` is replaced.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {i: b for b, i in ranks(path).items()}
        for batch in slices(batches, 128):
            rows = [b"".join(map(token.__getitem__, x or ())) for x in batch.column(ids_col).to_pylist()]
            yield replace_column(batch, bytes_col, pa.array(rows, pa.binary()))

    return df.mapInArrow(run, schema_with(df, bytes_col, "binary"))
