"""Exact deduplication by Patricia-trie owners."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import checkpointed
from .batches import SPACE, id_and_text, raw, slices, task_id
from .trie import RadixTrie

#: Bytes of text and nodes that one trie may hold before its heaviest subtrees are spilled.
TRIE_BYTES = 24 << 20

_LOCAL = pa.schema(
    [
        ("owner", pa.bool_()),
        ("task", pa.int32()),
        ("slot", pa.int64()),
        ("position", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_points", pa.int64()),
        ("n_bytes", pa.int64()),
        ("content_hash", pa.int64()),
        ("packed", pa.binary()),
        ("rows", pa.int64()),
    ]
)
_LOCAL_DDL = (
    "owner boolean, task int, slot long, position long, doc_id long, n_points long, "
    "n_bytes long, content_hash long, packed binary, rows long"
)
_OWNED = pa.schema(
    [
        ("task", pa.int32()),
        ("slot", pa.int64()),
        ("keep_id", pa.int64()),
        ("keep_task", pa.int32()),
        ("keep_position", pa.int64()),
        ("group_size", pa.int64()),
        ("text_sha256", pa.string()),
    ]
)
_OWNED_DDL = "task int, slot long, keep_id long, keep_task int, keep_position long, group_size long, text_sha256 string"


def _rank(n_points: int, doc_id: int | None, task: int, position: int) -> tuple:
    """Sorts the row that stays first: most code points, smallest identifier, first read."""
    return (-n_points, doc_id is None, doc_id or 0, task, position)


class _Local:
    """A text as one task has seen it: its best row so far and its number of rows."""

    __slots__ = ("best", "rows", "slot")

    def __init__(self, slot: int) -> None:
        self.slot, self.rows, self.best = slot, 0, None


def _local_owners(budget: int):
    """Per task: one row for each document, and one for each different text since the last spill."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, trie, slots, position = task_id(), RadixTrie(), 0, 0
        pack = zstandard.ZstdCompressor(level=1).compress

        def owners(found) -> Iterator[pa.RecordBatch]:
            rows, held = [], 0
            for key, own in found:
                minus, _, doc_id, _, at = own.best
                doc_id = None if own.best[1] else doc_id
                rows.append((True, task, own.slot, at, doc_id, -minus, len(key), xxhash.xxh3_64_intdigest(key) - (1 << 63), pack(key), own.rows))
                held += len(key)
                if held > 8 << 20:
                    yield _batch(rows, _LOCAL)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, _LOCAL)

        for batch in slices(batches):
            texts = raw(batch.column("text"))
            points = pc.utf8_length(batch.column("text").fill_null("")).to_pylist()
            rows = []
            for doc_id, text, n in zip(batch.column("doc_id").to_pylist(), texts, points, strict=True):
                own = trie.terminal(text.translate(None, SPACE), lambda: _Local(slots))
                slots += own.rows == 0
                own.rows += 1
                rank = _rank(n, doc_id, task, position)
                if own.best is None or rank < own.best:
                    own.best = rank
                rows.append((False, task, own.slot, position, doc_id, None, None, None, None, None))
                position += 1
                if trie.bytes > budget:
                    yield from owners(trie.spill(budget // 2))
            if rows:
                yield _batch(rows, _LOCAL)
        yield from owners(trie.drain())

    return run


class _Owner:
    """A text in its partition: the best row of all tasks, the rows of all tasks, and who asked."""

    __slots__ = ("asked", "best", "rows", "sha")

    def __init__(self) -> None:
        self.asked, self.best, self.rows, self.sha = [], None, 0, ""


def _owners(budget: int):
    """Per partition of lengths and content hashes, in their order: the owner of each text that a task sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = RadixTrie(), None
        unpack = zstandard.ZstdDecompressor().decompress

        def answers() -> Iterator[pa.RecordBatch]:
            rows = []
            for _, own in trie.drain():
                _, no_id, doc_id, task, position = own.best
                known = (None if no_id else doc_id, task, position, own.rows, own.sha)
                rows.extend((*who, *known) for who in own.asked)
                if len(rows) > 50_000:
                    yield _batch(rows, _OWNED)
                    rows = []
            if rows:
                yield _batch(rows, _OWNED)

        for batch in slices(batches):
            for x in batch.to_pylist():
                part = (x["n_bytes"], x["content_hash"])
                if part != last and trie.bytes > budget:  # every text below this length and hash is complete
                    yield from answers()
                last = part
                text = unpack(x["packed"], max_output_size=max(1, x["n_bytes"]))
                own = trie.terminal(text, _Owner)
                if not own.asked:
                    own.sha = hashlib.sha256(text).hexdigest()
                own.asked.append((x["task"], x["slot"]))
                own.rows += x["rows"]
                rank = _rank(x["n_points"], x["doc_id"], x["task"], x["position"])
                if own.best is None or rank < own.best:
                    own.best = rank
        yield from answers()

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """For each row, the row that stays of all rows with the same text.

    Texts are the same if equal after deleting every space and every character from tab to carriage
    return. Returns ``doc_id, keep_id, group_size, kept, text_sha256``, one row for each row of ``df``.

    Each task first inserts its texts into a radix trie of its own, so a text that fills a third of the
    table reaches the shuffle once per task. The tasks' different texts are then dealt by length and
    content hash, in that order; each partition inserts the full byte strings into a trie whose terminals
    hold the smallest identifier of the longest original. A trie over ``trie_bytes`` spills its heaviest
    subtrees: to the shuffle in the first step, as finished answers in the second.

    A null text counts as empty. Of equal texts the row with most code points stays, then the smallest
    identifier (null last), then the row read first, so of repeated rows exactly one stays. An empty table
    gives an empty result; other columns are not looked at.
    """
    local = checkpointed(id_and_text(df, id_col, text_col).mapInArrow(_local_owners(trie_bytes), _LOCAL_DDL))
    texts = local.where("owner").drop("owner")
    dealt = texts.repartition("n_bytes", "content_hash").sortWithinPartitions("n_bytes", "content_hash")
    owned = dealt.mapInArrow(_owners(trie_bytes), _OWNED_DDL)
    members = local.where("not owner").select("task", "slot", "position", "doc_id")
    kept = (F.col("task") == F.col("keep_task")) & (F.col("position") == F.col("keep_position"))
    return members.join(owned, ["task", "slot"]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
