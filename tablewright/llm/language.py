"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import replace_column, schema_with, slices

#: Labelled rows that the model is fitted on, as an expected number; the model's size depends on this alone.
SAMPLE_ROWS = 10_000

#: Of each language at least so many are taken, as an expected number, and every n-gram of one that has fewer.
LEAST_ROWS = 200

#: Languages whose shares of the sample go to all tasks; beyond that they are joined like any table.
MOST_BROADCAST = 10_000

#: The longest character n-gram that stands in for an unseen word.
LONGEST_GRAM = 4

#: A word or n-gram of fewer occurrences in the sample is not learned.
LEAST_COUNT = 2

UNDETERMINED = "und"

#: Words whose scores a worker remembers; a full memory is emptied.
REMEMBERED = 100_000

_WORDS = re.compile(r"[^\W\d_]+")
_COUNTS = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORDS.findall(text.lower())


def grams_of(word: str, size: int) -> list[str]:
    """The character n-grams of a word between two marks."""
    marked = f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


@dataclass(frozen=True)
class Model:
    """Log frequencies of words (size 0) and n-grams (their size), a column for each language."""

    languages: tuple[str, ...]
    rows: dict[tuple[int, str], int]
    logs: np.ndarray
    longest: int

    def word(self, word: str) -> np.ndarray:
        """The word's log frequencies; of an unseen word, the mean of those of its longest known n-grams."""
        if (row := self.rows.get((0, word))) is not None:
            return self.logs[row]
        for size in range(self.longest, 0, -1):
            known = [r for g in grams_of(word, size) if (r := self.rows.get((size, g))) is not None]
            if known:
                return self.logs[known].mean(axis=0)
        return np.zeros(len(self.languages), np.float32)


def _counted(longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, found in words.items():
                out = Counter({(0, w): n for w, n in found.items()})
                for w, n in found.items():
                    for size in range(1, longest + 1):
                        for g in grams_of(w, size):
                            out[size, g] += n
                sizes, grams = zip(*out, strict=True) if out else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(out), pa.string()), pa.array(sizes, pa.int32()), pa.array(grams, pa.string()), pa.array(out.values(), pa.int64())], schema=_COUNTS)
            words.clear()

        for batch in slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, words.values())) > 200_000:
                yield from flush()
        yield from flush()

    return run


def fit(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
    longest: int = LONGEST_GRAM,
    least_count: int = LEAST_COUNT,
    least_rows: int = LEAST_ROWS,
) -> Model:
    """Learn from whole texts whose text and language are known.

    If there are more than ``sample_rows`` such rows, those with the smallest hashes of their identifier
    are taken, about ``sample_rows`` of them, but of each language about ``least_rows`` or all. Counting is a Spark
    job; the driver gets the words and n-grams that occur ``least_count`` times or more in the sample, or in a
    language of fewer rows at all, so its share does not grow with the table. Every language with a text that holds
    a letter is learned. Rows that repeat an identifier are taken together or not at all.
    """
    known = labelled.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    known = known.where("text is not null and lang is not null")
    n = known.count()
    rows = known.groupBy("lang").agg(F.count("*").alias("rows"))
    share = F.greatest(F.lit(sample_rows / max(1, n)), least_rows / F.col("rows"))
    rates = rows.select(F.col("lang").alias("of"), (F.least(F.lit(1.0), share) * (1 << 30)).cast("long").alias("rate"), (F.col("rows") <= least_rows).alias("few"))
    if rates.count() <= MOST_BROADCAST:
        rates = F.broadcast(rates)
    known = known.join(rates, F.col("lang") == F.col("of")).where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("rate"))
    counts = known.select("lang", "text").mapInArrow(_counted(longest), "lang string, size int, gram string, n long")
    learned = counts.groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).join(rates, F.col("lang") == F.col("of"))
    learned = learned.where((F.col("n") >= least_count) | F.col("few")).select("lang", "size", "gram", "n").toArrow()
    languages = tuple(sorted(learned.column("lang").unique().to_pylist()))
    column = {lang: i for i, lang in enumerate(languages)}
    rows: dict[tuple[int, str], int] = {}
    keys = list(zip(learned.column("size").to_pylist(), learned.column("gram").to_pylist(), strict=True))
    for key in keys:
        rows.setdefault(key, len(rows))
    found = np.zeros((len(rows), len(languages)), np.float64)
    at = [rows[k] for k in keys], [column[x] for x in learned.column("lang").to_pylist()]
    found[at] = learned.column("n").to_numpy()
    sizes = np.fromiter((k[0] for k in rows), np.int32, len(rows))
    logs = np.zeros(found.shape, np.float32)
    for size in range(longest + 1):
        own = sizes == size
        if own.any():
            logs[own] = np.log((found[own] + 0.5) / (found[own].sum(axis=0) + 0.5 * own.sum()))
    return Model(languages, rows, logs, longest)


def identify(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``df`` with ``out_col``, a struct of ``lang`` and ``score``.

    ``lang`` is the language with the largest sum of word scores, of equal sums the first by name; ``und``,
    with score 0, if the text is null or holds no letter, or if nothing was learned. ``score`` is the
    language's share, from 0 to 1, of the languages' likelihoods per word. Whole texts are read; words that
    the model does not know back off to n-grams. A column already called ``out_col`` is replaced. The model
    goes to the tasks as a broadcast; there is no shuffle. Repeated rows are told row by row, an empty table gives
    no rows.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        places: dict[str, int] = {}
        scores = np.zeros((REMEMBERED, len(own.languages)), np.float32)

        def judge(text: str | None) -> tuple[str, float]:
            words = words_of(text or "")
            if not words or not own.languages:
                return UNDETERMINED, 0.0
            total = np.zeros(len(own.languages))
            for start in range(0, len(words), REMEMBERED // 2):
                part = words[start : start + REMEMBERED // 2]
                found = list(map(places.get, part))
                if None in found:
                    if len(places) + len(part) > REMEMBERED:
                        places.clear()
                    for w in part:
                        if w not in places:
                            scores[len(places)] = own.word(w)
                            places[w] = len(places)
                    found = list(map(places.__getitem__, part))
                total += scores[found].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            return own.languages[best], float(1 / np.exp((total - total[best]) / len(words)).sum())

        for batch in slices(batches):
            told = [judge(t) for t in batch.column(text_col).to_pylist()]
            langs, values = zip(*told, strict=True) if told else ((), ())
            yield replace_column(batch, out_col, pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(values, pa.float64())], ["lang", "score"]))

    return df.mapInArrow(run, schema_with(df, out_col, "struct<lang:string,score:double>"))
