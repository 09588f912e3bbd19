"""From raw documents to packed training sequences, in five stages.

Each stage is a function of (spark, docs, sf_dir) that works on all documents its predecessor kept. All but
the last return the columns of ``docs`` as they are; a column of any name beside the five of
``documents`` is carried along. ``doc_id`` and ``text`` must be there, the rest may hold nulls.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.scale import remove_folder, shared_folder
from tablewright.llm import exact, jaccard, language, leaks, packing
from tablewright.llm.queries import BYTE_RANKS, WORD_VOCABULARY, ship, table

#: The id that ends a document in a packed sequence.
END_ID = 2


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _without(docs: DataFrame, told: DataFrame, digest) -> DataFrame:
    """``docs`` without the rows that ``told`` does not keep; rows are known by their identifier and a digest.

    The rows to drop, which are fewer than the rest, are written first: Spark then knows their size, and
    sends them to all tasks if they are below its limit for broadcasts, or else deals both sides by key. Of
    rows with the same identifier and digest, of which one stays, that is the longest text.
    """
    spark, key = docs.sparkSession, _fresh(docs, "key")
    by = [F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("text_sha256")]
    keyed = told.select(F.xxhash64(*by).alias("a"), F.hash(*by).alias("b"), "kept")
    folder = f"{shared_folder(spark)}/dropped-{uuid.uuid4().hex}"
    counted = keyed.groupBy("a", "b").agg(F.count_if("kept").alias("kept"), F.count("*").alias("rows")).where("rows > kept")
    counted.select("a", "b", (F.col("kept") > 0).alias("one")).write.parquet(folder)
    dropped = spark.read.parquet(folder).select(F.struct("a", "b", "one").alias(key))
    own = [F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("-")), digest]
    same = (F.xxhash64(*own) == F.col(f"{key}.a")) & (F.hash(*own) == F.col(f"{key}.b"))
    marked = docs.join(dropped, same, "left").where(F.col(key).isNull() | F.col(f"{key}.one"))
    # copies under one identifier: a few rows, as the others have no key
    repeated, place = marked.where(F.col(key).isNotNull()), _fresh(docs, "place")
    first = Window.partitionBy(key).orderBy(F.length("text").desc_nulls_last(), F.col("text"))
    once = repeated.withColumn(place, F.row_number().over(first)).where(F.col(place) == 1)
    return marked.where(F.col(key).isNull()).select(*docs.columns).union(once.select(*docs.columns))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents without any language: null texts, texts without letters, and texts of which the model knows
    no word and no part of a word, so that all languages are equally likely.

    The identifier is fitted on the documents that have a language. If none has, letters alone decide. Repeated
    rows are judged alike; of equally likely languages, that some are likelier than others is enough to stay.
    """
    ship(spark)
    told = _fresh(docs, "language")
    model = language.fit(docs)
    found = language.identify(docs, model, out_col=told)
    good = F.col(f"{told}.lang") != language.UNDETERMINED
    if len(model.languages) > 1:
        good = good & (F.col(f"{told}.score") > 1 / len(model.languages) + 1e-9)
    return found.where(good if model.languages else F.col("text").rlike(r"\p{L}")).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with the same text but for white space one stays: the longest, then the smallest identifier."""
    ship(spark)
    told = exact.exact_duplicates(docs)
    same = F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]", "")
    return _without(docs, told, F.sha2(same, 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shingles of five words and a similarity of 0.75 that with the smallest identifier stays."""
    ship(spark)
    told = jaccard.jaccard_components(docs)
    return _without(docs, told, F.sha2(F.coalesce("text", F.lit("")), 256))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in its text are replaced by ``[secret]``, and ``n_chars`` follows.

    A null text and a null count stay null; repeated rows are masked alike; spans that touch become one mark.
    """
    ship(spark)
    before = _fresh(docs, "before")
    masked = leaks.redacted(docs.withColumn(before, F.length("text")), BYTE_RANKS, public_tokenizers.PATTERN)
    if "n_chars" in docs.columns:
        shorter = F.col("n_chars") + F.coalesce(F.length("text") - F.col(before), F.lit(0))
        masked = masked.withColumn("n_chars", shorter.cast(docs.schema["n_chars"].dataType))
    return masked.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 4096 tokens, with their ids.

    A null text is packed as its end alone; repeated rows and identifiers are packed one by one.
    """
    ship(spark)
    return packing.packed(docs, WORD_VOCABULARY, END_ID)


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can express neither the language model nor the packing; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last of them stays, as the result reads it.
    """
    docs, before = table(spark, sf_dir, "documents"), None
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove_folder(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
