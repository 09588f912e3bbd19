"""Secret scans: fixed patterns, and random strings exposed by their token efficiency."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import replace_column, schema_with, slices, texts
from .bpe import encoding

#: The kinds of spans, in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "random")

# The base patterns and their least lengths.
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_LEAST = {"assign": 12, "access": 18, "hex": 16}

#: Words of which one must be in a text for ``_ASSIGN`` to match.
_WORDS = ("passw", "secret", "token", "api")

#: Where random strings are looked for: runs of the letters of base64 and its URL form.
_RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")

#: Digest lengths in hexadecimal digits: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512.
_DIGESTS = (32, 40, 56, 64, 96, 128)
_ANY_HEX = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)\Z")
_UUID = re.compile(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\Z")
_PIECE = re.compile(r"[^/_-]+")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")

#: Random strings have fewer characters to a token than this; words and names have more.
MOST_RATIO = 1.9

#: The same, at most, for strings of letters alone.
LETTERS_RATIO = 1.85

#: Characters of a random string, and the mean length from which pieces without digits are no initials.
LEAST_RUN, LEAST_PIECE = 20, 4

#: Characters of what a base span leaves of a random string, from which it is reported.
LEAST_PART = 4


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns; leftmost, not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= _LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= _LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def known_form(run: str) -> bool:
    """Digests and identifiers look random but are no secrets."""
    return bool(len(run) in _DIGESTS and _ANY_HEX.match(run) or _UUID.match(run))


def _random(run: str, tokens, most_ratio: float) -> bool:
    if known_form(run) or not _LETTER.search(run):
        return False
    if not _DIGIT.search(run):
        pieces = _PIECE.findall(run)
        size = sum(map(len, pieces))
        if size < max(LEAST_RUN, LEAST_PIECE * len(pieces)):
            return False
        most_ratio = min(most_ratio, LETTERS_RATIO)
    return len(run) < most_ratio * tokens(run)


def _parts(run: str, tokens, most_ratio: float) -> Iterator[tuple[int, int]]:
    """Stretches of neighbouring pieces between ``/``, ``_`` and ``-`` that each have the ratio of random strings.

    Words end a stretch, as do digests; UUIDs are passed over.
    """
    start = end = at = None
    for m in _PIECE.finditer(run):
        if at is not None and m.start() < at:
            continue
        uuid = _UUID.match(run[m.start() : m.start() + 36]) and (m.start() + 36 == len(run) or run[m.start() + 36] in "/_-")
        at = m.start() + 36 if uuid else None
        if not uuid and not known_form(m[0]) and len(m[0]) < most_ratio * tokens(m[0]):
            start, end = m.start() if start is None else start, m.end()
            continue
        if start is not None:
            yield start, end
        start = None
    if start is not None:
        yield start, end


def random_spans(text: str, path: str, pattern: str, most_ratio: float = MOST_RATIO) -> list[tuple[int, int, int]]:
    """Runs of 20 or more letters and digits with fewer than ``most_ratio`` characters to a token, or parts of runs."""

    def tokens(run: str) -> int:
        return len(encoding(path, pattern).encode_ordinary(run))

    found = []
    for m in _RUN.finditer(text):
        if _random(m[0], tokens, most_ratio):
            found.append((m.start(), 3, m.end()))
        elif not known_form(m[0]) and any(x in m[0] for x in "/_-"):
            for start, end in _parts(m[0], tokens, most_ratio):
                if end - start >= LEAST_RUN and _random(m[0][start:end], tokens, most_ratio):
                    found.append((m.start() + start, 3, m.start() + end))
    return found


def _outside(start: int, end: int, covered: list[tuple[int, int]], at: int) -> Iterator[tuple[int, int]]:
    """What a stretch has outside of covered ones, which ascend and do not touch; none before ``at`` reaches it."""
    for low, high in covered[at:]:
        if low >= end:
            break
        if start < low:
            yield start, low
        start = max(start, high)
    if start < end:
        yield start, end


def scan(text: str, path: str, pattern: str, most_ratio: float = MOST_RATIO) -> list[tuple[int, int, int]]:
    """All base spans, and the random strings outside of them.

    A random string that a base span touches is not dropped: what it has outside of the base spans is reported, as
    it is part of a string that was judged as a whole.
    """
    found = base_spans(text)
    extra = random_spans(text, path, pattern, most_ratio)
    if not found or not extra:
        return found + extra
    covered: list[tuple[int, int]] = []
    for start, _, end in found:
        if covered and start <= covered[-1][1]:
            covered[-1] = covered[-1][0], max(end, covered[-1][1])
        else:
            covered.append((start, end))
    out, at = found, 0
    for start, kind, end in extra:
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        for low, high in _outside(start, end, covered, at):
            part = text[low:high].strip("/_-=+")
            low += text[low:high].find(part)
            if len(part) >= LEAST_PART:
                out.append((low, kind, low + len(part)))
    return sorted(out)


_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def secret_spans(df: DataFrame, path: str, pattern: str, text_col: str = "text", spans_col: str = "spans", most_ratio: float = MOST_RATIO) -> DataFrame:
    """``df`` with the secrets of a text column in ``spans_col``: structs of kind, start and end.

    Kinds are ``assign`` (a keyword with a value of 12 or more characters), ``access`` (access keys of 18
    or more), ``hex`` (16 or more digits) and ``random``: runs that the vocabulary in ``path`` needs many
    tokens for, whole or in neighbouring parts between ``/``, ``_`` and ``-``, other than digests, UUIDs,
    and runs without letters. What a base span covers of a random run is left to it, and the rest of the run is
    reported if it has four characters or more. Runs of letters alone must stay below a ratio of 1.85.
    Positions count code points, the end is exclusive; spans are sorted by start, then by kind as listed.
    A null or empty text has no spans; a column that is already called ``spans_col`` is replaced. Repeated rows are
    told row by row, an empty table gives no rows. A map over the rows, without a shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, path, pattern, most_ratio)] for t in texts(batch.column(text_col))]
            yield replace_column(batch, spans_col, pa.array(rows, pa.list_(_SPAN)))

    return df.mapInArrow(run, schema_with(df, spans_col, "array<struct<kind:string,start:long,end:long>>"))


def redacted(df: DataFrame, path: str, pattern: str, text_col: str = "text", mark: str = "[secret]", most_ratio: float = MOST_RATIO) -> DataFrame:
    """``df`` with every secret in a text column replaced by ``mark``; other texts stay as they are, null stays null.

    Spans that overlap or touch are replaced as one. Repeated rows stay repeated, an empty table stays empty.
    """

    def clean(text: str) -> str:
        out, at = [], 0
        reach = -1
        for start, _, end in scan(text, path, pattern, most_ratio):
            if start > reach:
                out += [text[at:start], mark]
            reach = at = max(reach, end)
        return "".join(out) + text[at:] if out else text

    names, schema = df.columns, df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch.column(text_col).to_pylist()
            new = pa.array([None if t is None else clean(t) for t in old], batch.schema.field(text_col).type)
            yield pa.RecordBatch.from_arrays([new if n == text_col else batch.column(n) for n in names], names)

    return df.mapInArrow(run, schema)
