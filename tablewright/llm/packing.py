"""Sum-of-squares packing of token sequences into training windows."""

from __future__ import annotations

import json
import os
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import id_and_text, slices, task_id, texts

WINDOW = 4096

#: Partly filled windows that a task keeps open.
OPEN_WINDOWS = 1024

#: Words whose ids a worker remembers, in each of two generations.
REMEMBERED = 100_000

#: Characters of text that are split before their new words are looked up together.
TOGETHER = 1 << 22

#: Words that are sent to the library at a time; what it returns for each token takes far more than the ids.
SENT = 4096

#: Characters up to this one are split here; texts with others go to the library whole.
_LAST = 0x24F

#: What a vocabulary file must say of its normaliser, its split and its word ends for words to be
#: looked up apart. Texts of other files go to the library whole.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_END = "</w>"


_SPACE, _LETTER, _NUMBER, _SIGN, _OTHER = range(5)


def _kinds() -> np.ndarray:
    """The kind of each UTF-16 code for the vocabulary's own split of a lower-case text into words.

    Only the library can split a text with ``_OTHER``; U+001C to U+001F are white space to some, U+0130 becomes two.
    """
    kinds = np.full(1 << 16, _OTHER, np.uint8)
    for c in range(_LAST + 1):
        kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _SIGN)
    kinds[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0]] = _SPACE
    kinds[[*range(0x1C, 0x20), 0x130]] = _OTHER
    return kinds


_KIND = _kinds()
#: Bytes of each code in UTF-8; white space is left out.
_WIDTH = np.where(_KIND == _SPACE, 0, 1 + (np.arange(1 << 16) >= 0x80)).astype(np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


def _starts(codes: np.ndarray) -> np.ndarray:
    """Where the words of a lower-case text start: ``'s|'t|'re|'ve|'m|'ll|'d``, letters, one number, or signs."""
    kind = _KIND[codes]
    start = (kind == _NUMBER) | (kind != np.r_[np.uint8(_SPACE), kind[:-1]])
    start &= kind != _SPACE
    # no sign comes before an apostrophe that starts a word, and a letter after it ends the signs
    at = np.flatnonzero(start & (codes == ord("'")))
    ahead = np.r_[codes, np.zeros(3, codes.dtype)]
    one, two = ahead[at + 1], ahead[at + 2]
    size = np.isin(one, [ord(c) for c in "stmd"]) * 2
    for x, y in ("re", "ve", "ll"):
        size[(one == ord(x)) & (two == ord(y))] = 3
    at, size = at[size > 0], size[size > 0]
    start[at + 1] = False
    after = (at + size)[at + size < len(codes)]
    start[after] = kind[after] != _SPACE
    return np.flatnonzero(start)


def _byte_letters() -> np.ndarray:
    """The vocabulary's letter for each byte; the space that parts words stays."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = np.arange(256, dtype="<u2")
    other = [b for b in range(256) if b not in plain]
    letters[other] = 0x100 + np.arange(len(other))
    letters[0x20] = 0x20
    return letters


_LETTERS = _byte_letters()


class Memory(dict):
    """Ids of strings, of which the last ``REMEMBERED`` or more are kept: a full generation takes the older one's place."""

    def __init__(self) -> None:
        self.old: dict[str, bytes] = {}

    def known(self, wanted: list[str]) -> list[bytes | None]:
        """The ids of each of ``wanted``, None if in neither generation; what is known is in the newer one afterwards."""
        found = list(map(self.get, wanted))
        if self.old:
            left = [(i, x) for i, (x, ids) in enumerate(zip(wanted, found, strict=True)) if ids is None]
            for (i, x), ids in zip(left, map(self.old.get, [x for _, x in left]), strict=True):
                if ids is not None:
                    found[i] = self[x] = ids
        return found

    def age(self) -> None:
        if len(self) > REMEMBERED:
            self.old = dict(self)
            self.clear()


class WordTokenizer:
    """Ids of a vocabulary that splits a lower-case text into words before its merges.

    The ids of a word do not depend on its neighbours. So many texts are split together, by the kinds of their characters,
    and each word is looked up once and remembered. Words that are new are sent to the library's merges together, and
    told apart by the ids that end a word.
    Ids come as bytes, four for each, little-endian.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        told = json.loads(self.library.to_str())
        self.apart = told["normalizer"] == _NORMALIZER and told["pre_tokenizer"] == _PRE_TOKENIZER and told["model"].get("end_of_word_suffix") == _END
        vocabulary = self.library.get_vocab()
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[i for x, i in vocabulary.items() if x.endswith(_END)]] = True
        # for words in lower case, as letters for their bytes: the merges alone
        self.merges = Tokenizer.from_str(self.library.to_str())
        self.merges.encode_special_tokens = True
        self.merges.normalizer, self.merges.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.merges.model._resize_cache(0)  # each word is sent once, so the library's own memory of words only costs time
        self.memory = Memory()

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _lower(self, text: str) -> np.ndarray | None:
        """The codes of the text in lower case, None if only the library can tell its words."""
        codes = _codes(text.lower())
        if (_KIND[codes] == _OTHER).any() or not text.isascii() and (_KIND[_codes(text)] == _OTHER).any():
            return None
        return codes

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of each word."""
        joined = " ".join(words)
        if not joined.isascii() or not joined.isprintable():
            joined = _LETTERS[np.frombuffer(joined.encode(), np.uint8)].tobytes().decode("utf-16-le")
        ids = np.asarray(self.merges.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):  # an end is missing in the vocabulary
            return self._whole(words)
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        return [raw[x:y] for x, y in zip([0, *cuts[:-1]], cuts, strict=True)]

    def _learn(self, words: list[str]) -> list[bytes]:
        """The ids of each of different words, remembered or new."""
        found = self.memory.known(words)
        new = [i for i, x in enumerate(found) if x is None]
        for start in range(0, len(new), SENT):
            part = new[start : start + SENT]
            own = [words[i] for i in part]
            for i, word, ids in zip(part, own, self._words(own), strict=True):
                found[i] = self.memory[word] = ids
        return found

    def _together(self, texts: list[str]) -> Iterator[bytes]:
        codes, sizes = self._lower("\n".join(texts)), list(map(len, texts))
        whole = set()
        if codes is None:
            each = [self._lower(t) for t in texts]
            whole = {i for i, x in enumerate(each) if x is None}
            codes, sizes = self._lower("\n".join(["" if i in whole else t for i, t in enumerate(texts)])), [0 if x is None else len(x) for x in each]
        starts = _starts(codes)
        solid = codes[_KIND[codes] != _SPACE].tobytes().decode("utf-16-le").encode()
        offsets = np.append(np.cumsum(_WIDTH[codes], dtype=np.int32)[starts] - _WIDTH[codes[starts]], np.int32(len(solid)))
        split = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(solid))
        coded = split.dictionary_encode()
        found, at = self._learn(coded.dictionary.to_numpy(zero_copy_only=False).tolist()), coded.indices.to_numpy()
        lengths = np.fromiter(map(len, found), np.int32, len(found)) // 4
        firsts, ids = np.cumsum(lengths, dtype=np.int32) - lengths, np.frombuffer(b"".join(found), "<u4")
        counts = lengths[at]
        before = np.cumsum(np.r_[0, counts], dtype=np.int64)
        places = np.arange(before[-1], dtype=np.int32)
        places += np.repeat(firsts[at] - before[:-1].astype(np.int32), counts)
        raw = ids.take(places).tobytes()
        # a text and the line end after it hold one more code than the text
        words = np.searchsorted(starts, np.cumsum([0, *sizes]) + np.arange(len(sizes) + 1))
        cuts = (4 * before[words]).tolist()
        for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            yield self._whole([texts[i]])[0] if i in whole else raw[a:b]
        self.memory.age()

    def ids(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text; texts are taken together until they come to ``TOGETHER`` characters."""
        start, size = 0, 0
        for end, text in enumerate(texts, 1):
            size += len(text)
            if size < TOGETHER and end < len(texts):
                continue
            yield from (self._together if self.apart else self._whole)(texts[start:end])
            start, size = end, 0


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


#: A part of a document: doc_id, ids before it, its ids as bytes, ids of the document.
Piece = tuple[int | None, int, bytes, int]


class SumOfSquares:
    """Windows filled online so that the squares of the numbers of windows at each level stay small.

    ``levels[h]`` is the number of open windows that hold ``h`` ids, and ``filled`` lists the levels that have one. A
    piece goes to the level where the sum of the squares of ``levels`` becomes smallest, or to a new window; of
    equal levels to the fullest.
    """

    def __init__(self, size: int) -> None:
        self.size = size
        self.levels = [0] * (size + 1)
        self.filled: list[int] = []
        self.windows: list[list[list[Piece]]] = [[] for _ in range(size)]
        self.n_open = 0

    def place(self, piece: Piece) -> list[Piece] | None:
        """Put a piece of fewer ids than a window holds; the window, if that filled it."""
        n = len(piece[2]) // 4
        counts, size = self.levels, self.size
        level, least = 0, 2 * counts[n] + 1  # a new window
        # what a move to h + n adds to the sum; a full window is no longer counted
        for h in self.filled:
            if h + n >= size:
                if h + n == size and 1 - 2 * counts[h] <= least:
                    level = h
                break
            change = 2 * (counts[h + n] - counts[h]) + 2
            if change <= least:
                level, least = h, change
        if level:
            window = self.windows[level].pop()
            counts[level] -= 1
            self.n_open -= 1
            if not counts[level]:
                del self.filled[bisect_left(self.filled, level)]
        else:
            window = []
        window.append(piece)
        if level + n == size:
            return window
        self.windows[level + n].append(window)
        counts[level + n] += 1
        self.n_open += 1
        if counts[level + n] == 1:
            insort(self.filled, level + n)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """Empty all open windows: pieces of the emptiest fill up the fullest, cut where needed.

        Comes to full windows and, at last, one window for each power of two in what remains.
        """
        left = [p for level in range(self.size - 1, 0, -1) for w in self.windows[level] for p in w]
        self.__init__(self.size)
        total, at = sum(len(p[2]) // 4 for p in left), 0
        left.reverse()
        while total:
            want = self.size if total >= self.size else 1 << (total.bit_length() - 1)
            window, room = [], want
            while room:
                doc_id, start, ids, n = left.pop()
                if len(ids) > 4 * room:
                    left.append((doc_id, start + room, ids[4 * room :], n))
                    ids = ids[: 4 * room]
                window.append((doc_id, start, ids, n))
                room -= len(ids) // 4
            total -= want
            yield window


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]
)


def packed(
    df: DataFrame,
    path: str,
    end_id: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = WINDOW,
    open_windows: int = OPEN_WINDOWS,
) -> DataFrame:
    """Pack the ids of every whole text, followed by ``end_id``, into windows of ``size`` ids.

    Returns a row for each piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``. ``ids`` are
    the piece's ids as unsigned little-endian 32-bit numbers, ``start`` and ``doc_tokens`` count ids of the
    document (with the end), ``offset`` the ids before the piece in its window.

    Each task packs its own rows online, so there is no shuffle and no task holds more than ``open_windows``
    partly filled windows. A text of ``size`` ids or more fills windows of its own; its rest is placed by
    the sum-of-squares rule. When too many windows are open, and at the end, the open ones are filled up
    from each other, which may cut pieces; what a task has left at last goes to windows of powers of two.
    So every window is full or a power of two long, and nothing is padded.

    ``sequence_id`` is the task's number times 2**33 plus a count, so it is unique, and the same if a task
    runs again. A null or empty text is packed as its end alone. Rows that repeat an identifier, or have
    none, are packed one by one. An empty table gives no rows. ``size`` is a power of two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, bins = tokenizer(path), SumOfSquares(size)
        end = int(end_id).to_bytes(4, "little")
        number, rows = task_id() << 33, []

        def emit(window: list[Piece]) -> None:
            nonlocal number
            at = 0
            for doc_id, start, ids, n in window:
                rows.append((doc_id, start, len(ids) // 4, ids, n, number, at))
                at += len(ids) // 4
            number += 1

        def out() -> Iterator[pa.RecordBatch]:
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SCHEMA, strict=True)], schema=_SCHEMA)
                rows.clear()

        for batch in slices(batches):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.ids(texts(batch.column("text"))), strict=True):
                ids += end
                n, at = len(ids) // 4, 0
                while n - at >= size:
                    emit([(doc_id, at, ids[4 * at : 4 * (at + size)], n)])
                    at += size
                if at < n and (full := bins.place((doc_id, at, ids[4 * at :], n))):
                    emit(full)
                if bins.n_open > open_windows:
                    for window in bins.close():
                        if sum(len(p[2]) for p in window) == 4 * size:
                            emit(window)
                        else:
                            for piece in window:
                                if full := bins.place(piece):
                                    emit(full)
                if len(rows) > 1000:
                    yield from out()
        for window in bins.close():
            emit(window)
        yield from out()

    ddl = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return id_and_text(df, id_col, text_col).mapInArrow(run, ddl)
