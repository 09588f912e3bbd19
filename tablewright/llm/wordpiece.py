"""Token counts by a linear longest-match automaton."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .batches import id_and_text, raw, slices

#: Marks the start of a word in the vocabulary.
WORD_START = "▁"

#: Words whose counts a worker remembers; a full memory is emptied.
REMEMBERED = 200_000

_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])


class Automaton:
    """A vocabulary trie with failure links that counts greedy longest-match pieces in one pass.

    ``goto[s]`` maps a character to the next state. If no piece continues from state ``s``, its text is
    ``popped[s]`` pieces followed by the text of state ``failure[s]``; -1 means that the text can't be
    written in pieces at all. Building pieces is never needed to count them.
    """

    def __init__(self, vocabulary: Iterable[str]) -> None:
        self.goto: list[dict[str, int]] = [{}]
        ends = [False]
        for piece in vocabulary:
            at = 0
            for c in piece:
                step = self.goto[at].get(c)
                if step is None:
                    step = self.goto[at][c] = len(self.goto)
                    self.goto.append({})
                    ends.append(False)
                at = step
            ends[at] = True
        ends[0] = False
        self.failure, self.popped = [-1] * len(self.goto), [0] * len(self.goto)
        waiting = deque([0])
        while waiting:
            parent = waiting.popleft()
            for c, s in self.goto[parent].items():
                if ends[s]:
                    self.failure[s], self.popped[s] = 0, 1
                elif parent:
                    u, n = self.failure[parent], self.popped[parent]
                    while u >= 0 and c not in self.goto[u]:
                        n += self.popped[u]
                        u = self.failure[u]
                    if u >= 0:
                        self.failure[s], self.popped[s] = self.goto[u][c], n
                waiting.append(s)

    def count(self, word: str) -> int:
        """The number of pieces of a word, 0 if it can't be written in pieces."""
        goto, failure, popped = self.goto, self.failure, self.popped
        at = n = 0
        for c in word:
            step = goto[at].get(c)
            while step is None:
                n += popped[at]
                if not at or (at := failure[at]) < 0:
                    return 0
                step = goto[at].get(c)
            at = step
        while at:
            n += popped[at]
            if (at := failure[at]) < 0:
                return 0
        return n


@lru_cache(maxsize=2)
def sentencepiece_vocabulary(path: str) -> tuple[str, ...]:
    """The ordinary pieces of a sentencepiece model: no control, unknown or byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple(
        model.id_to_piece(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    )


@lru_cache(maxsize=2)
def automaton(path: str) -> Automaton:
    return Automaton(sentencepiece_vocabulary(path))


def token_counts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_tokens, n_unknown`` of every whole text, one row for each row of ``df``.

    Words are ``[^\\x20\\x09-\\x0D]+``. A word is written, after the mark of a word's start, in the longest
    pieces of the vocabulary from left to right; a word that can't be is one unknown token. ``path`` names
    a sentencepiece model that every executor has. The automaton reads each character of a word once,
    and a worker remembers the counts of recent words. No shuffle. A null or empty text has no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton(path).count, {}
        for batch in slices(batches):
            rows = []
            for text in raw(batch.column("text")):
                words = text.split()
                found = list(map(known.get, words))
                if None in found:
                    for i, n in enumerate(found):
                        if n is None:
                            word = words[i]
                            if (n := known.get(word)) is None:
                                n = known[word] = count(WORD_START + word.decode("utf-8", "replace"))
                            found[i] = n
                    if len(known) > REMEMBERED:
                        known.clear()
                unknown = found.count(0)
                rows.append((len(words), sum(found) + unknown, unknown))
            n_words, n_tokens, n_unknown = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], schema=_SCHEMA)

    return id_and_text(df, id_col, text_col).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
