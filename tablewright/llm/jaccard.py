"""N-gram Jaccard join by rare-first prefixes with length, positional and suffix filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.components import components
from ..functions.scale import checkpointed, release
from .batches import LOWER, id_and_text, raw, slices, task_id

N = 5

#: Similarity in per cent from which two documents link.
PERCENT = 75

#: Shingles that a task gathers before it sends them off, that a bucket is meant to get, and that are sorted at a time.
BLOCK_SHINGLES, BUCKET_SHINGLES, SORTED_SHINGLES = 1 << 20, 1 << 22, 1 << 19

#: Document rows that a bucket is meant to get, at most.
BUCKET_ROWS = 1 << 17

#: Pairs for each posting of the lists that are still open, above which another round of heads is worth while.
CROWDED = 8

#: Share of these pairs that a round may leave for another one to follow.
WORTH_WHILE = 0.7

#: Classes by which the suffix filter compares two sets.
CLASSES = 16

#: Numbers of 64 bits in which the same filter compares which of many finer classes hold an odd number of shingles.
MARKS = 8

_DOC = [("doc_id", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("rep", pa.int64()), ("text_sha256", pa.binary())]
_BLOCK = pa.schema([("bucket", pa.int32()), ("base", pa.int64()), ("refs", pa.binary()), ("hashes", pa.binary()), ("others", pa.binary()), *_DOC, ("shared", pa.list_(pa.int64()))])
_BLOCK_DDL = "bucket int, base long, refs binary, hashes binary, others binary, doc_id long, n long, same binary, rep long, text_sha256 binary, shared array<long>"
_ROW = pa.schema([("row", pa.int64()), *_DOC, ("shared", pa.list_(pa.int64()))])
_ROW_DDL = "row long, doc_id long, n long, same binary, rep long, text_sha256 binary, shared array<long>"


def shingles(text: bytes, n: int = N) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct ``n``-word shingles; of fewer words, of all as one."""
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64)
    mixed = np.zeros(len(words) - n + 1, np.uint64)
    for i in range(n):
        part = hashes[i : len(words) - n + 1 + i] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)
        mixed = (mixed ^ part) * np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _packed(numbers: np.ndarray) -> bytes:
    """Sorted numbers as their gaps, each in as many bytes as the widest takes; the first byte says how many."""
    gaps = np.diff(numbers, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(gaps.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + gaps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _numbers(packed: bytes) -> np.ndarray:
    gaps = np.frombuffer(packed, np.uint8, offset=1).reshape(-1, packed[0])
    whole = np.zeros((len(gaps), 8), np.uint8)
    whole[:, : packed[0]] = gaps
    return np.cumsum(whole.view("<u8").ravel(), dtype=np.uint64)


def _parts(hashes: np.ndarray, bits: int) -> dict[int, slice]:
    """Where each bucket that occurs lies in sorted hashes."""
    if not len(hashes):
        return {}
    of = hashes >> np.uint64(64 - bits)
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
    return {b: slice(x, y) for b, x, y in zip(of[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True)}


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int64)))


def _spread(row: int, bits: int) -> int:
    """The bucket that a document's own row passes through."""
    return xxhash.xxh32_intdigest(row.to_bytes(8, "little")) % (1 << bits)


def _blocks(n_words: int, bits: int, block: int):
    """Per task: a row for each document, and for each block of documents and bucket the block's shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: list[tuple[int, int | None, int, bytes, bytes]] = []
        sets: dict[bytes, tuple[int, np.ndarray]] = {}
        place, held, task = 0, 0, task_id() << 40

        def send() -> Iterator[pa.RecordBatch]:
            nonlocal held
            rows = np.array([row for row, _ in sets.values()], np.int64)
            base = int(rows.min())
            found = [x for _, x in sets.values()]
            hashes = np.concatenate(found)
            owners = np.repeat(rows - base, [len(x) for x in found])
            order = np.argsort(hashes, kind="stable")
            hashes, owners = hashes[order], owners[order]
            equal = hashes[1:] == hashes[:-1]
            twice = np.r_[False, equal] | np.r_[equal, False]
            # what several documents of the block share is known here; other blocks get it once, without a document
            by = np.argsort(owners[twice], kind="stable")
            of, what = owners[twice][by], hashes[twice][by].astype(np.int64)
            local = dict(zip((rows - base).tolist(), np.split(what, np.searchsorted(of, rows[1:] - base)), strict=True))
            out = {k: [] for k in _BLOCK.names}

            def add(*values) -> None:
                for k, v in zip(_BLOCK.names, values, strict=True):
                    out[k].append(v)

            for row, doc_id, n, same, sha in docs:
                rep = sets[same][0] if n else row
                add(_spread(row, bits), row, None, None, None, doc_id, n, same, rep, sha, local.get(row - base) if rep == row else None)
            once, first = ~twice, twice & ~np.r_[False, equal]
            ones, refs, others = hashes[once], owners[once].astype("<u2"), hashes[first]
            mine, also, mask, none = _parts(ones, bits), _parts(others, bits), np.uint64((1 << (64 - bits)) - 1), slice(0, 0)
            for b in mine.keys() | also.keys():
                at = mine.get(b, none)
                add(b, base, refs[at].tobytes(), _packed(ones[at] & mask), _packed(others[also.get(b, none)] & mask), *[None] * 6)
            docs.clear()
            sets.clear()
            held = 0
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in _BLOCK], schema=_BLOCK)

        def empty() -> Iterator[pa.RecordBatch]:
            rows = [(_spread(row, bits), row, None, None, None, doc_id, n, same, row, sha, None) for row, doc_id, n, same, sha in docs]
            docs.clear()
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _BLOCK, strict=True)], schema=_BLOCK)

        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
                row = task + place
                place += 1
                own = shingles(text, n_words)
                same = xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None
                docs.append((row, doc_id, len(own), same, hashlib.sha256(text).digest()))
                if len(own) and same not in sets:
                    sets[same] = (row, own)
                    held += len(own)
                if held >= block or docs[0][0] + 60_000 <= row:
                    yield from send() if sets else empty()
        if docs:
            yield from send() if sets else empty()

    return run


def _repeated(numbers: list[np.ndarray], owners: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers that occur more than once, with each of their owners; -1 owns nothing."""
    own, what = np.concatenate(owners), np.concatenate(numbers)
    order = np.argsort(what, kind="stable")
    what, own = what[order], own[order]
    equal = what[1:] == what[:-1]
    take = (np.r_[False, equal] | np.r_[equal, False]) & (own >= 0)
    return what[take], own[take]


def _shared(bits: int, sorted_shingles: int):
    """Of one bucket: for each document, the shingles that some other document has too.

    The bucket's range of hashes is worked through in parts, so that few shingles are sorted at a time.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        is_doc = table.column("refs").is_null()
        passed = table.filter(is_doc).rename_columns(["row" if n == "base" else n for n in table.column_names]).select(_ROW.names).cast(_ROW)
        lists: list[tuple[np.ndarray, np.ndarray]] = []
        for chunk in table.filter(pc.invert(is_doc)).select(["base", "refs", "hashes", "others"]).to_batches():
            for base, refs, hashes, others in zip(*(c.to_pylist() for c in chunk.columns), strict=True):
                lists.append((_numbers(hashes), np.frombuffer(refs, "<u2").astype(np.int64) + base))
                lists.append((more := _numbers(others), np.full(len(more), -1, np.int64)))
        pieces = 1 + sum(len(x) for x, _ in lists) // sorted_shingles
        edges = [np.uint64((k << (64 - bits)) // pieces) for k in range(1, pieces)]
        cuts = [[0, *np.searchsorted(x, edges).tolist(), len(x)] for x, _ in lists]
        found = [_repeated([x[c[k] : c[k + 1]] for (x, _), c in zip(lists, cuts, strict=True)], [o[c[k] : c[k + 1]] for (_, o), c in zip(lists, cuts, strict=True)]) for k in range(pieces)] if lists else []
        if not found:
            return passed
        owners = np.concatenate([o for _, o in found])
        order = np.argsort(owners, kind="stable")
        numbers, owners = np.concatenate([x for x, _ in found])[order] | np.uint64(key[0].as_py() << (64 - bits)), owners[order]
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]]) if len(owners) else np.empty(0, np.int64)
        told = {n: pa.nulls(len(starts), t) for n, t in zip(_ROW.names, _ROW.types, strict=True)}
        told |= {"row": pa.array(owners[starts]), "shared": _lists(numbers, np.r_[starts, len(owners)])}
        return pa.concat_tables([passed, pa.table(told, schema=_ROW)])

    return run


def _enough(inter: Column, n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * inter >= percent * (n_a + n_b - inter)


def _possible(a: str, b: str, percent: int) -> Column:
    """What the length, positional and suffix filters leave of pairs that share a prefix shingle."""
    n_a, n_b = F.col(f"{a}.n"), F.col(f"{b}.n")
    length = 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)
    after = F.least(n_a - F.col(f"{a}.position"), n_b - F.col(f"{b}.position"))
    positional = _enough(after, n_a, n_b, percent)
    apart = F.aggregate(F.zip_with(f"{a}.sizes", f"{b}.sizes", lambda x, y: F.abs(x - y)), F.lit(0), lambda s, x: s + x)
    odd = F.aggregate(F.zip_with(f"{a}.marks", f"{b}.marks", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    apart, both = F.greatest(apart, odd), n_a + n_b
    return length & positional & _enough((both - apart - F.col(f"{a}.alone") - F.col(f"{b}.alone")) / 2, n_a, n_b, percent)


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``a, b, linked`` of each pair, from the whole sets."""
    left = sets.select(F.col("row").alias("a"), F.col("n").alias("n_a"), F.col("grams").alias("grams_a"))
    right = sets.select(F.col("row").alias("b"), F.col("n").alias("n_b"), F.col("grams").alias("grams_b"))
    inter = F.size(F.array_intersect("grams_a", "grams_b"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", _enough(inter, F.col("n_a"), F.col("n_b"), percent).alias("linked"))


def _class_size(number: int) -> Column:
    return F.size(F.filter("ranked", lambda x: F.pmod(x.gram, F.lit(CLASSES)) == number))


def _mark(number: int) -> Column:
    """Of 64 classes of shingles, a bit for each that is set if the class holds an odd number."""
    own = F.pmod(F.shiftright("gram", 6), F.lit(MARKS)) == number
    return F.bit_xor(F.when(own, F.expr("shiftleft(1L, cast(gram & 63 as int))")).otherwise(F.lit(0).cast("long")))


def _pairs(left: Column, right: Column) -> list[Column]:
    return [F.least(left, right).alias("a"), F.greatest(left, right).alias("b")]


def _open(posted: DataFrame, found: DataFrame) -> tuple[DataFrame, int, int]:
    """The postings of lists that hold several groups of linked sets, with the list's largest group as ``main``.

    Also their number, and the number of pairs of a member outside the main group with any other.
    """
    x = F.struct("row", "n", "alone", "sizes", "marks", "position").alias("x")
    member = checkpointed(posted.join(found, F.col("row") == F.col("node"), "left").select("gram", x, F.coalesce("component", "row").alias("group")))
    groups = member.groupBy("gram", "group").agg(F.count("*").alias("members"))
    lists = groups.groupBy("gram").agg(
        F.count("*").alias("groups"), F.sum("members").alias("members"), F.max("members").alias("most"), F.max_by("group", F.struct("members", "group")).alias("main")
    )
    lists = checkpointed(lists.where("groups > 1").drop("groups"))
    total, work = lists.agg(F.sum("members"), F.sum(F.col("members") * (F.col("members") - F.col("most")))).first()
    return checkpointed(member.join(lists.select("gram", "main"), "gram")), total or 0, work or 0


def jaccard_components(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_words: int = N,
    percent: int = PERCENT,
    block_shingles: int = BLOCK_SHINGLES,
    bucket_shingles: int = BUCKET_SHINGLES,
    sorted_shingles: int = SORTED_SHINGLES,
) -> DataFrame:
    """Groups of documents whose sets of ``n_words``-word shingles are linked by a similarity of ``percent``.

    Returns ``doc_id, n_shingles, component_id, kept, text_sha256``, one row for each row of ``df``. The
    component is the smallest identifier that links lead to; ``kept`` marks one row of each component.

    1. Each task hashes the shingles of its documents and folds equal sets. Blocks of shingles are dealt by
       hash into buckets, packed; a bucket tells each document which of its shingles others have too. As
       a linked document shares ``percent`` of its shingles, the others are out. Here the rarest shingles,
       those of one document, fill their prefixes.
    2. For the rest, equal sets fold to one; their shared shingles are counted and sorted rare first, and
       each set posts the shingles of its prefix.
    3. In each list of postings, all members are compared with the first. What that links needs no further
       comparison. While lists hold many members that are still apart, each list gets another head by hash, so that
       a set meets a different one in every list it is in; members of other components are compared with it. When
       little is left, or a round leaves most of it, members of different components are compared with each
       other. Pairs must pass the length, positional and suffix filters; each is verified once, over whole sets.
    4. Links and copies go to alternating stars for the components.

    Every link between different texts is found or already implied by others; nothing is capped. Hot
    shingles are pre-aggregated: a block sends a shingle of several of its documents once.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case. Fewer than ``n_words`` words are one shingle.
    A null or empty text has no shingles and links with nothing. Rows that repeat an identifier or have
    none are rows of their own; a null identifier is never the smallest unless all are null. Shingles are
    compared by their hashes. An empty table gives an empty result; other columns are not looked at.
    """
    docs = id_and_text(df, id_col, text_col)
    size, n_rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    bits = max(7, ((size or 0) // 7 // bucket_shingles).bit_length(), (n_rows // BUCKET_ROWS).bit_length())
    sent = docs.mapInArrow(_blocks(n_words, bits, block_shingles), _BLOCK_DDL)
    told = sent.groupBy("bucket").applyInArrow(_shared(bits, sorted_shingles), _ROW_DDL)
    parts = [F.max(c).alias(c) for c in ("doc_id", "n", "same", "rep", "text_sha256")]
    rows = told.groupBy("row").agg(*parts, F.flatten(F.collect_list("shared")).alias("shared"))
    enough = (100 * F.size("shared") >= percent * F.col("n")) & (F.col("n") > 0) & (F.col("row") == F.col("rep"))
    rows = checkpointed(rows.withColumn("shared", F.when(enough, F.col("shared"))))
    del sent, told
    release(df.sparkSession)

    left = rows.where("shared is not null").select("row", "n", "same", "shared")
    firsts = left.groupBy("same").agg(F.min("row").alias("first"))
    copies = left.select("row", "same").join(firsts, "same").where("row <> first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    copies = copies.union(rows.where("row <> rep").select("row", "rep"))
    sets = left.join(firsts.select(F.col("first").alias("row")), "row", "left_semi")

    grams = sets.select("row", F.explode("shared").alias("gram"))
    counts = grams.groupBy("gram").agg(F.count("*").alias("df")).where("df > 1")
    ranked = grams.join(counts, "gram").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("ranked"), F.array(*map(_mark, range(MARKS))).alias("marks"))
    sets = checkpointed(
        ranked.join(sets.select("row", "n"), "row").select(
            "row",
            "n",
            F.transform("ranked", lambda x: x.gram).alias("grams"),
            (F.col("n") - F.size("ranked")).alias("alone"),
            F.array(*map(_class_size, range(CLASSES))).alias("sizes"),
            "marks",
            (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int").alias("prefix"),
        )
    )
    release(df.sparkSession)
    within = F.greatest(F.lit(0), F.col("prefix") - F.col("alone")).cast("int")
    posted = sets.select("row", "n", "alone", "sizes", "marks", F.posexplode(F.slice("grams", F.lit(1), within)).alias("i", "gram"))
    posted = posted.withColumn("position", F.col("alone") + F.col("i")).drop("i")

    heads = posted.groupBy("gram").agg(F.min_by(F.struct("row", "n", "alone", "sizes", "marks", "position"), "row").alias("head"), F.count("*").alias("members")).where("members > 1")
    starred = posted.select("gram", F.struct("row", "n", "alone", "sizes", "marks", "position").alias("x")).join(heads, "gram").where("head.row <> x.row").where(_possible("head", "x", percent))
    first = checkpointed(_verified(starred.select(*_pairs(F.col("head.row"), F.col("x.row"))).distinct(), sets, percent))
    release(df.sparkSession)

    # each turn makes some dozens of shuffles; what they leave takes disk, however small they are
    tested, before, still = first, None, posted
    for turn in count(1):
        found = components(tested.where("linked").select("a", "b"))
        release(df.sparkSession)
        member, total, work = _open(still, found)
        release(df.sparkSession)
        if work <= CROWDED * total or before is not None and work > before * WORTH_WHILE:
            break
        before, still = work, member.select("gram", "x.*")  # a list that is closed stays closed
        ahead = F.min_by(F.struct("x", "group"), F.xxhash64("gram", "x.row", F.lit(turn))).alias("head")
        round_heads = member.groupBy("gram").agg(ahead).select("gram", F.col("head.x").alias("y"), F.col("head.group").alias("other"))
        met = member.join(round_heads, "gram").where("group <> other").where(_possible("x", "y", percent))
        pairs = met.select(*_pairs(F.col("y.row"), F.col("x.row"))).distinct().join(tested, ["a", "b"], "left_anti")
        tested = tested.union(checkpointed(_verified(pairs, sets, percent)))
    minor = member.where("group <> main").select("gram", F.col("x").alias("y"), F.col("group").alias("other"))
    across = minor.join(member, "gram").where((F.col("group") != F.col("other")) & ((F.col("group") == F.col("main")) | (F.col("y.row") < F.col("x.row")))).where(_possible("x", "y", percent))
    pairs = across.select(*_pairs(F.col("y.row"), F.col("x.row"))).distinct().join(tested, ["a", "b"], "left_anti")
    tested = tested.union(_verified(pairs, sets, percent))

    tested = checkpointed(tested.where("linked"))
    release(df.sparkSession)
    found = components(tested.select("a", "b").union(copies))
    release(df.sparkSession)
    grouped = rows.join(found, F.col("row") == F.col("node"), "left")
    grouped = grouped.select("row", "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "row").alias("group"), F.col("component").isNotNull().alias("linked"), F.lower(F.hex("text_sha256")).alias("text_sha256"))
    # the owners are written first, so that the join with them can split a group of very many rows
    owner = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("owner")
    owners = checkpointed(grouped.where("linked").groupBy("group").agg(owner))
    alone = F.struct(F.lit(False).alias("none"), "doc_id", "row")
    named = grouped.join(owners, "group", "left").withColumn("owner", F.coalesce("owner", alone))
    return named.select("doc_id", "n_shingles", F.col("owner.doc_id").alias("component_id"), (F.col("row") == F.col("owner.row")).alias("kept"), "text_sha256")
