"""Exact similarity joins on short texts and on token sets."""

from __future__ import annotations

import hashlib
import json
from functools import reduce
from itertools import combinations, product

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_on, q

#: Classes of runs whose odd numbers stand for a text, as powers of two: always, and at most for a long text.
BRIEF_BITS, MARK_BITS = 10, 14


def _without_one(s: Column) -> Column:
    """All strings one deletion shorter."""
    places = F.sequence(F.lit(1), F.length(s))
    cut = F.transform(places, lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))
    return F.when(F.length(s) > 0, cut).otherwise(F.array().cast("array<string>"))


def deletion_variants(df: DataFrame, col: str, max_dist: int, name: str = "_variant") -> DataFrame:
    """One row per string that at most ``max_dist`` deletions make of the value, the value included."""
    found = F.array(q(col))
    edge = found
    for _ in range(max_dist):
        edge = F.array_distinct(F.flatten(F.transform(edge, _without_one)))
        found = F.array_union(found, edge)
    return df.withColumn(name, F.explode(found))


def _shifts(max_dist: int, parts: int, matched: int) -> list[tuple[int, ...]]:
    """What ``matched`` untouched parts allow: the difference of the lengths, the parts, and how far each has moved.

    Moving by n places takes n edits, so all moves from one untouched part to the next fit into ``max_dist``.
    """
    span = range(-max_dist, max_dist + 1)
    return [
        (delta, *chosen, *moved)
        for delta in span
        for chosen in combinations(range(parts), matched)
        for moved in product(span, repeat=matched)
        if sum(abs(b - a) for a, b in zip((0, *moved), (*moved, delta))) <= max_dist
    ]


def part_keys(df: DataFrame, col: str, max_dist: int, matched: int, probe: bool, name: str = "_key") -> DataFrame:
    """One row per key under which a string is kept, or with ``probe`` looked for.

    A string cut into ``max_dist + matched`` parts keeps at least ``matched`` of them whole after that many edits.
    A key is the length, the numbers and the texts of as many parts. Strings too short to be cut have none.
    """
    parts = max_dist + matched
    specs = _shifts(max_dist, parts, matched) if probe else [(0, *c, *[0] * matched) for c in combinations(range(parts), matched)]
    value = "`" + col.replace("`", "``") + "`"
    size = f"(length({value}) - z[0])"
    inside, found = [f"{size} >= {parts}"], [size]
    for k in range(1, matched + 1):
        # parts are even: part i of n begins at floor(i * size / n)
        begin, end = f"({size} * z[{k}] div {parts})", f"({size} * (z[{k}] + 1) div {parts})"
        moved = f"z[{k + matched}]"
        inside += [f"{begin} + {moved} >= 0", f"{end} + {moved} <= length({value})"]
        found += [f"z[{k}]", f"substring({value}, int({begin} + {moved} + 1), int({end} - {begin}))"]
    key = f"case when {' and '.join(inside)} then xxhash64({', '.join(found)}) end"
    table = f"from_json('{json.dumps(specs)}', 'array<array<int>>')"
    return df.withColumn(name, F.explode(F.expr(f"array_distinct(array_compact(transform({table}, z -> {key})))")))


def close_pairs(
    left: DataFrame, left_col: str, right: DataFrame, right_col: str, max_dist: int,
    on: list[str] | None = None, ordered: bool = False, crowd: int = 64,
) -> DataFrame:
    """Pairs of distinct values within ``max_dist`` edits, with their ``distance``. Exact.

    Cut into d + 1 parts, a string keeps one of them whole after d edits, at most d places away: an equi-join on
    (length, number, text of the part) finds every pair, with rows that depend on d and not on the length. Values of
    the right side that share a part with more than ``crowd`` others, such as a common word, and the left values that
    meet them, are cut into d + 2 parts instead, of which two stay whole, and meet by both. Values of at most d + 1
    letters meet by what up to d deletions make of them. ``on`` names block columns both sides carry; inputs must
    be distinct. ``ordered`` keeps only pairs whose left value is the smaller one.
    """
    on = on or []
    a, b = left.select(*on, left_col), right.select(*on, right_col)
    short = F.length(q(right_col)) <= max_dist + 1
    few = F.length(q(left_col)) <= 2 * max_dist + 1
    met = [join_on(deletion_variants(a.where(few), left_col, max_dist), deletion_variants(b.where(short), right_col, max_dist), [*on, "_variant"], "inner")]
    long = b.where(~short)
    asked, kept = part_keys(a, left_col, max_dist, 1, True), part_keys(long, right_col, max_dist, 1, False)
    heavy = kept.groupBy(*on, "_key").agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).drop("_n")
    met.append(join_on(asked, join_on(kept, heavy, [*on, "_key"], "left_anti"), [*on, "_key"], "inner"))
    again = [join_on(side, heavy, [*on, "_key"], "left_semi").drop("_key").distinct() for side in (asked, kept)]
    met.append(join_on(part_keys(again[0], left_col, max_dist, 2, True), part_keys(again[1], right_col, max_dist, 2, False), [*on, "_key"], "inner"))
    candidates = reduce(DataFrame.union, [m.select(*on, left_col, right_col) for m in met])
    if ordered:
        candidates = candidates.where(q(left_col) < q(right_col))
    distance = F.levenshtein(q(left_col), q(right_col), max_dist)
    return candidates.distinct().withColumn("distance", distance).where(F.col("distance") >= 0)


def _shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Sorted hashes of the runs of ``words`` words of a text in lower case; a shorter text is one run.

    Each word is hashed once; the hashes of a run are mixed in their order.
    """
    found = (text or "").lower().split()
    if not found:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    if len(found) < words:
        return np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64)
    mixed = np.zeros(len(found) - words + 1, np.uint64)
    for i in range(words):
        mixed ^= hashes[i : i + len(mixed)] + np.uint64(0x9E3779B97F4A7C15 * (i + 1) % 2**64)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        mixed ^= mixed >> np.uint64(32)
    return np.unique(mixed)


def _minima(own: np.ndarray, odd: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """For each pair of factors the smallest mixed hash over a set of hashes."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    step = max(1, 400_000 // len(odd))
    for start in range(0, len(own), step):
        mixed = np.multiply.outer(odd, own[start : start + step])
        mixed += plus[:, None]
        least = np.minimum(least, mixed.min(axis=1))
    return least


def _factors(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    odd = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def _band_keys(least: np.ndarray, bands: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(b.tobytes()) for b in least.reshape(bands, -1)], np.uint64).view(np.int64)


def _sketch(least: np.ndarray) -> np.ndarray:
    """Two bits of each minimum, 32 minima to a long."""
    two = np.zeros(-(-len(least) // 32) * 32, np.uint64)
    two[: len(least)] = (least >> np.uint64(30)) & np.uint64(3)
    places = np.arange(32, dtype=np.uint64) * np.uint64(2)
    return np.bitwise_or.reduce(two.reshape(-1, 32) << places, axis=1).view(np.int64)


def _marks(own: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each of 2 ** ``bits`` classes of hashes, by their last bits, that is set if the class holds an odd number."""
    odd = np.bincount((own & np.uint64((1 << bits) - 1)).astype(np.int64), minlength=1 << bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def word_sets(words: int, bands: int, rows: int, seed: int = 42):
    """A column function from a text to a struct that stands for its distinct word runs: their number (``n``), a digest
    of them all (``same``), one MinHash key for each band of ``rows`` minima over them (``bands``; none without words),
    two bits of each minimum (``sketch``), and which classes of runs have an odd number, of 1024 (``brief``) and of two
    to four classes for each run (``marks``).

    Two texts agree in a band with probability similarity ** rows. The function is declared not deterministic, as are
    those below: else Spark repeats it in filters that it pushes under joins, over every row that the join would drop.
    """
    odd, plus = _factors(bands * rows, seed)

    def of(text: str | None) -> tuple:
        own = _shingle_hashes(text, words)
        if not len(own):
            return 0, b"", *[np.empty(0, np.int64)] * 4
        least = _minima(own, odd, plus)
        classes = min(max(6, (2 * len(own) - 1).bit_length()), MARK_BITS)
        found = hashlib.sha256(own.tobytes()).digest(), _band_keys(least, bands), _sketch(least)
        return len(own), *found, _marks(own, BRIEF_BITS), _marks(own, classes)

    @F.pandas_udf("n int, same binary, bands array<long>, sketch array<long>, brief array<long>, marks array<long>")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([of(t) for t in texts], columns=["n", "same", "bands", "sketch", "brief", "marks"])

    return run.asNondeterministic()


def word_runs(words: int):
    """A column function: the hashes of a text's distinct word runs, those that ``word_sets`` signs."""

    @F.pandas_udf("array<long>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_shingle_hashes(t, words).view(np.int64) for t in texts], dtype=object)

    return run.asNondeterministic()


def set_bands(bands: int, rows: int, seed: int = 42):
    """A column function: the MinHash keys of a set of hashed word runs, as in ``word_sets``."""
    odd, plus = _factors(bands * rows, seed)

    @F.pandas_udf("array<long>")
    def run(sets: pd.Series) -> pd.Series:
        return sets.map(lambda own: _band_keys(_minima(np.asarray(own, np.int64).view(np.uint64), odd, plus), bands))

    return run.asNondeterministic()


def sketches_differ(x: str, y: str, longs: int | None = None) -> Column:
    """In how many minima two sketches differ. Where the number of ``longs`` in a sketch is told, Spark compiles this."""

    def different(a: Column, b: Column) -> Column:
        z = a.bitwiseXOR(b)
        return F.bit_count(z.bitwiseOR(F.shiftrightunsigned(z, 1)).bitwiseAND(F.lit(0x5555555555555555)))

    if longs:
        return reduce(lambda p, n: p + n, [different(F.get(x, F.lit(i)), F.get(y, F.lit(i))) for i in range(longs)])
    return F.aggregate(F.zip_with(x, y, different), F.lit(0), lambda total, n: total + n)


def runs_apart(x: str, y: str, longs: int | None = None) -> Column:
    """How many runs, by their ``marks``, two texts at least do not share. Exact: it is never more than they do not share.

    Where the number of ``longs`` in both is told, Spark compiles this. Else marks of twice as many classes are folded
    first; where one has still more classes the answer is 0.
    """
    if longs:
        return reduce(lambda p, n: p + n, [F.bit_count(F.get(x, F.lit(i)).bitwiseXOR(F.get(y, F.lit(i)))) for i in range(longs)])

    def halved(m: str, other: str) -> Column:
        half = F.expr(f"size({m}) div 2").cast("int")
        folded = F.zip_with(F.slice(m, F.lit(1), half), F.slice(m, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(m) > F.size(other), folded).otherwise(F.col(m))

    pairs = F.zip_with(halved(x, y), halved(y, x), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    few, many = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
    return F.when(many <= 2 * few, F.aggregate(pairs, F.lit(0), lambda total, n: total + n)).otherwise(F.lit(0))
