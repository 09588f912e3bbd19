"""Web archives, and their index by an external merge of sorted capture runs."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from urllib.parse import urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import checkpointed, shared_folder, shuffle_width
from .batches import raw, task_id

#: A task starts a new archive when the open one has this many compressed bytes.
ARCHIVE_BYTES = 64 << 20

#: Where captures have no time of their own, that of page 0; each page is one second later than the one before, and
#: starts again after so many seconds.
FIRST_CAPTURE, CAPTURE_SECONDS = datetime(2024, 1, 1, tzinfo=UTC), 10**10

#: Captures that a range of the merge is meant to hold.
RANGE_ROWS = 100_000

#: The table of a folder's archives.
_LISTED = "_archives"

_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PAGE = "urn:page:"

_INDEX_DDL = (
    "run string, position long, url_key string, captured string, page_id long, url string, record_type string, "
    "payload_digest string, payload_bytes long, refers_to long, archive string, offset long"
)
_INDEX = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in _INDEX_DDL.split(", "))])


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def url_key(url: str) -> str:
    """The host from its end, then path and query: ``http://a.example.com/x`` is ``com,example,a)/x``."""
    try:
        parts = urlsplit(url.strip().lower())
        host = parts.hostname or ""
    except ValueError:
        return url.strip().lower()
    path = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return ",".join(reversed(host.removeprefix("www.").split("."))) + ")" + path


def _store(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the folder's path there."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _header(kind: str, page_id: int | None, url: str | None, captured: str, digest: str, refers_to: int | None, block: bytes) -> bytes:
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{_PAGE}{'' if page_id is None else page_id}>"), ("WARC-Date", captured)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)))
    fields.append(("WARC-Payload-Digest", f"sha1:{digest}"))
    if kind == "revisit":
        fields += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", f"<{_PAGE}{refers_to}>")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode()


def record(page_id: int | None, url: str | None, captured: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One capture as a gzip member; a revisit keeps the HTTP header and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    return gzip.compress(_header("revisit" if revisit else "response", page_id, url, captured, digest, refers_to, block) + block + b"\r\n\r\n", 3, mtime=0)


def records(stream) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(number, header fields, block) of each record of an archive that is read from its start."""
    lines = gzip.GzipFile(fileobj=stream)
    number = 0
    while line := lines.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"record {number} starts with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := lines.readline().rstrip(b"\r\n")) != b"":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = lines.read(int(fields["content-length"]))
        yield number, fields, block
        number += 1


def _write(folder: str, archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = _store(folder)
        task, made, out, attempt = task_id(), 0, None, uuid.uuid4().hex
        written = 0

        def close() -> None:
            nonlocal out, made, total
            if out is not None:
                out.close()
                name = f"part-{task:06d}-{attempt}-{made:05d}.warc.gz"
                store.move(f"{top}/.{attempt}", f"{top}/{name}")
                told.append((name, total))
                out, made, total = None, made + 1, 0

        total, told = 0, []
        for batch in batches:
            html = raw(batch.column("html"))
            columns = [batch.column(n).to_pylist() for n in ("page_id", "url", "captured", "refers_to", "revisit")]
            for payload, page_id, url, captured, refers_to, revisit in zip(html, *columns, strict=True):
                if out is None:
                    out, written = store.open_output_stream(f"{top}/.{attempt}", compression=None), 0
                member = record(page_id, url, captured, payload, base32_sha1(payload), refers_to, revisit)
                out.write(member)
                written += len(member)
                total += 1
                if written >= archive_bytes:
                    close()
        close()
        names, numbers = zip(*told, strict=True) if told else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64())], ["name", "records"])

    return run


def write_archives(pages: DataFrame, folder: str, time_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """Write a record for each row of ``page_id, url, html`` to gzip archives in a shared folder; their number.

    Of rows with equal payloads that with the largest ``page_id`` is a response, the others are revisits
    that refer to it; rows that repeat its identifier are responses too. Payloads are dealt by page, so
    no task gets all copies of one; only digests meet. Each attempt of a task writes archives of its own names, and what
    the attempts that succeeded wrote is listed in the folder's ``_archives``; others are never read.
    """
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        (F.col(time_col).cast("timestamp") if time_col else F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id").cast("long"), F.lit(0)), F.lit(CAPTURE_SECONDS)) + int(FIRST_CAPTURE.timestamp()))).alias("time"),
    ).withColumn("captured", F.date_format(F.to_utc_timestamp("time", F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")).drop("time")
    keyed = own.withColumn("same", F.concat_ws("-", F.coalesce(F.octet_length("html"), F.lit(0)), F.sha1(F.coalesce("html", F.lit("")))))
    small = keyed.select("page_id", "same")
    owners = small.groupBy("same").agg(F.max("page_id").alias("owner"))
    revisits = small.join(owners, "same").where(~F.col("page_id").eqNullSafe(F.col("owner"))).select("page_id", "same", F.col("owner").alias("refers_to")).distinct()
    page = F.concat_ws("/", F.coalesce(F.col("page_id").cast("string"), F.lit("-")), "same")
    marked = keyed.withColumn("key", page).drop("same").join(revisits.select(page.alias("key"), "refers_to"), "key", "left").drop("key")
    marked = marked.withColumn("revisit", F.col("refers_to").isNotNull())
    store, top = _store(folder)
    store.create_dir(top, recursive=True)
    marked.mapInArrow(_write(folder, archive_bytes), "name string, records long").write.parquet(f"{folder}/{_LISTED}")
    return pages.sparkSession.read.parquet(f"{folder}/{_LISTED}").agg(F.sum("records")).first()[0] or 0


def _number(value: str | None) -> int | None:
    text = (value or "").strip("<>").removeprefix(_PAGE)
    return int(text) if text else None


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A sorted run of captures for each archive."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            store, own = _store(path)
            found = []
            with store.open_input_stream(own, compression=None) as stream:
                for number, fields, block in records(stream):
                    if fields["warc-type"] not in ("response", "revisit"):
                        continue
                    head, _, payload = block.partition(b"\r\n\r\n")
                    digest = fields["warc-payload-digest"].removeprefix("sha1:")
                    length = int(re.search(rb"(?i)content-length: *(\d+)", head)[1])
                    if fields["warc-type"] == "response" and (len(payload) != length or base32_sha1(payload) != digest):
                        raise ValueError(f"record {number} of {path} is damaged")
                    url = fields.get("warc-target-uri")
                    found.append((url_key(url or ""), fields["warc-date"], _number(fields["warc-record-id"]), url, fields["warc-type"], digest, length, _number(fields.get("warc-refers-to")), path, number))
            found.sort(key=_order)
            if found:
                rows = [(path, i, *x) for i, x in enumerate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _INDEX, strict=True)], schema=_INDEX)


def _order(x: tuple) -> tuple:
    """URL key, time, then page; a null page comes first, of equal captures the one in the first place of the first archive."""
    return x[0], x[1], x[2] is not None, x[2] or 0, x[-2], x[-1]


class LoserTree:
    """Merges sorted runs; each inner node remembers the run that lost there, so a step costs log2(runs) comparisons."""

    def __init__(self, runs: Iterable[Iterable], key) -> None:
        self.key, self.runs = key, [iter(r) for r in runs]
        n = len(self.runs)
        self.heads = [self._next(i) for i in range(n)]
        self.losers = [0] * n
        winners = [0] * n + list(range(n))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        if n:
            self.losers[0] = winners[1]

    def _next(self, i: int):
        row = next(self.runs[i], None)
        return None if row is None else (self.key(row), i, row)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and x[:2] < y[:2])

    def __iter__(self) -> Iterator:
        losers, n = self.losers, len(self.runs)
        while n and (head := self.heads[losers[0]]) is not None:
            yield head[2]
            winner = losers[0]
            self.heads[winner] = self._next(winner)
            node = (winner + n) // 2
            while node:
                if self._before(losers[node], winner):
                    losers[node], winner = winner, losers[node]
                node //= 2
            losers[0] = winner


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of keys: its part of every run, merged."""
    runs: dict[str, list[tuple]] = {}
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in _INDEX.names), strict=True):
            runs.setdefault(row[0], []).append(row)
    rows = []
    part, place = task_id(), 0
    for row in LoserTree(runs.values(), lambda r: _order(r[2:])):
        rows.append((part, place, *row[2:]))
        place += 1
        if len(rows) >= 10_000:
            yield _merged(rows)
            rows = []
    if rows:
        yield _merged(rows)


_MERGED = pa.schema([("part", pa.int64()), ("position", pa.int64()), *((f.name, f.type) for f in list(_INDEX)[2:])])
_MERGED_DDL = "part long, " + _INDEX_DDL.split(", ", 1)[1]


def _merged(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MERGED, strict=True)], schema=_MERGED)


def capture_index(spark: SparkSession, folder: str) -> DataFrame:
    """The captures of all archives of a folder in one order: by URL key, time, page.

    Each archive is read as a stream and gives a run that is sorted where it is read; a response's payload
    is checked against its digest. The runs are written to the shared folder and cut at borders of key,
    time and page, so a URL with very many captures is split; in each range a loser tree merges the parts
    of all runs, of about ``RANGE_ROWS`` captures. ``part, position`` is a capture's place in the whole order. A folder without archives has
    no captures.
    """
    store, top = _store(folder)
    if store.get_file_info(f"{top}/{_LISTED}").type == pafs.FileType.NotFound:
        archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder).select("path")
    else:
        archives = spark.read.parquet(f"{folder}/{_LISTED}").select(F.concat(F.lit(f"{folder}/"), "name").alias("path"))
        archives = archives.repartition(shuffle_width(spark), "path")
    runs = checkpointed(archives.mapInArrow(_index, _INDEX_DDL))
    ranges = max(shuffle_width(spark), -(-runs.count() // RANGE_ROWS))
    cut = runs.repartitionByRange(ranges, F.col("url_key"), F.col("captured"), F.col("page_id"), F.col("archive"), F.col("offset"))
    return cut.sortWithinPartitions("run", "position").mapInArrow(_merge, _MERGED_DDL)


def archived(pages: DataFrame, folder: str | None = None, time_col: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages to archives and read them back: the merged index, one row for each row of ``pages``.

    ``folder`` must be shared and new; it defaults to one in the shared checkpoint folder. A null payload
    counts as empty. A page without identifier is kept, counts as the smallest, and is never referred to
    unless nothing else has its payload. A null URL stays null. An empty table gives no rows.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(pages, folder, time_col, archive_bytes)
    return capture_index(spark, folder)
