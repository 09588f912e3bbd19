"""Line dedup with levelled sorted runs of line hashes, in DataFrame functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import checkpointed, remove_folder, shared_folder, shuffle_width

#: Code points of a key, and documents that hold it, from which its lines are dropped.
LEAST_CHARS, LEAST_DOCS = 20, 3

#: Parts in which documents are added, by descending identifier.
BATCHES = 4

#: Runs of a level that are compacted into one of the next.
FAN_IN = 2

_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Stands for a missing identifier: smaller than all others.
_NO_ID = -(2**63)


class LineRuns:
    """Runs of line hashes, each written sorted and bucketed by hash, so that joins with them move only the batch.

    A hash is fresh in the run of the first batch that holds it, with the keeper (the largest identifier of that
    batch); later batches count its documents in their own runs as seen again. So the fresh parts of all
    runs are disjoint. When a level holds ``fan_in`` runs they are compacted into one run of the next level.
    """

    def __init__(self, spark: SparkSession, folder: str, fan_in: int = FAN_IN) -> None:
        self.spark, self.folder, self.fan_in = spark, folder, fan_in
        self.width = shuffle_width(spark)
        self.name = "line_runs_" + uuid.uuid4().hex
        self.levels: list[list[str]] = []
        self.made = 0

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"{self.name}_{self.made}"
        self.made += 1
        dealt = rows.select("a", "b", "keeper", "docs", "fresh").repartition(self.width, "a", "b")
        sink = dealt.write.partitionBy("fresh").bucketBy(self.width, "a", "b").sortBy("a", "b")
        sink.option("path", f"{self.folder}/{name}").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def _drop(self, name: str) -> None:
        self.spark.sql(f"drop table {name}")
        remove_folder(self.spark, f"{self.folder}/{name}")

    def rows(self, names: list[str] | None = None) -> DataFrame:
        """The rows of the given runs, or of all."""
        names = [n for level in self.levels for n in level] if names is None else names
        out = self.spark.table(names[0])
        for name in names[1:]:
            out = out.unionByName(self.spark.table(name))
        return out

    def add(self, keys: DataFrame) -> None:
        """Anti-join a batch of ``a, b, keeper, docs`` (one row for each hash) with all runs; what it has becomes a run.

        The anti-join is a merge join with each run; the rows that match are kept as seen again.
        """
        seen = F.lit(False)
        for i, name in enumerate(n for level in self.levels for n in level):
            run = self.spark.table(name).where("fresh").select("a", "b", F.lit(True).alias(f"in_{i}"))
            keys = keys.join(run.hint("merge"), ["a", "b"], "left")
            seen = seen | F.col(f"in_{i}").isNotNull()
        self._write(keys.withColumn("fresh", ~seen), 0)
        self._compact()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            names = self.levels[level]
            if len(names) < self.fan_in:
                return
            merged = self.rows(names).groupBy("a", "b", "fresh").agg(F.max("keeper").alias("keeper"), F.sum("docs").alias("docs"))
            self.levels[level] = []
            self._write(merged, level + 1)
            for name in names:
                self._drop(name)

    def held(self, least_docs: int) -> DataFrame:
        """``a, b, keeper`` of the hashes that ``least_docs`` documents or more hold."""
        total = self.rows().groupBy("a", "b").agg(F.max("keeper").alias("keeper"), F.sum("docs").alias("docs"))
        return total.where(F.col("docs") >= least_docs).select("a", "b", "keeper")

    def close(self) -> None:
        for names in self.levels:
            for name in names:
                self._drop(name)
        self.levels = []


def _hashes(lines: Column, least_chars: int) -> Column:
    """For each line two 64-bit hashes of its key, null if the key is too short."""
    keys = F.transform(lines, lambda line: F.btrim(line, F.lit(_WHITE)))
    return F.transform(keys, lambda k: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("a"), F.xxhash64(F.lit(1), k).alias("b"))))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dedup_lines(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    least_docs: int = LEAST_DOCS,
    batches: int = BATCHES,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Drop lines that many documents share, but for those of the document with the largest identifier.

    Returns ``doc_id, n_lines, n_dropped, text``, one row for each row of ``df``; ``text`` has the lines that stay.
    Lines are the parts between ``\\n``. A line's key is the line without ``[\\x20\\x09-\\x0D]`` at its ends and with
    A-Z in lower case. Keys of ``least_chars`` code points or more that ``least_docs`` rows hold lose all their
    lines except in the rows with the largest identifier that holds them.

    1. One scan writes the key hashes of each text (128 bits a line), dealt into ``batches`` by descending identifier.
    2. Batches are added to :class:`LineRuns` one by one. As identifiers fall, the first batch that holds a key
       has its keeper; a key's rows are counted where the scan meets them, so a line that a third of all texts
       hold comes to one row for each task.
    3. The hashes of all texts meet the keys that are held often enough; what they lose is gathered as
       positions, for each text of its own, and joined to the text.

    A null or empty text is one empty line. Every row counts as a document, repeated rows too. Rows without identifier
    share the smallest one. Keys are compared by their hashes. An empty table gives an empty result; other
    columns are not looked at.
    """
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    docs = docs.withColumns({"doc": F.coalesce("doc_id", F.lit(_NO_ID)), "same": F.xxhash64("text")})
    shares = [i / batches for i in range(1, batches)]
    borders = docs.agg(F.percentile_approx("doc", shares, 1000)).first()[0] if shares else None
    batch = sum((F.when(F.col("doc") < b, 1).otherwise(0) for b in borders or []), F.lit(0))

    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4().hex}"
    hashed = docs.select("doc", "same", _hashes(_lines(F.translate("text", _UPPER, _LOWER)), least_chars).alias("hashes"), batch.alias("batch"))
    hashed.where(F.exists("hashes", lambda h: h.isNotNull())).write.partitionBy("batch").parquet(f"{folder}/hashes")
    hashed = spark.read.schema("doc long, same long, hashes array<struct<a:long,b:long>>, batch int").parquet(f"{folder}/hashes")

    runs = LineRuns(spark, folder, fan_in)
    for number in range(batches):
        own = hashed.where(F.col("batch") == number).select("doc", F.explode(F.array_compact(F.array_distinct("hashes"))).alias("h"))
        runs.add(own.groupBy("h.a", "h.b").agg(F.max("doc").alias("keeper"), F.count("*").alias("docs")))
    held = checkpointed(runs.held(least_docs))
    runs.close()

    each = hashed.select("doc", "same", F.posexplode("hashes").alias("at", "h")).where("h is not null")
    lost = each.select("doc", "same", "at", "h.a", "h.b").join(held, ["a", "b"]).where("doc < keeper")
    lost = checkpointed(lost.groupBy("doc", "same").agg(F.collect_set("at").alias("lost")))
    remove_folder(spark, folder)

    whole = docs.join(lost, ["doc", "same"], "left")
    n_lines = F.size(_lines(F.col("text"))).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("lost"))
    kept = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return whole.withColumn("lines", F.when(F.col("lost").isNotNull(), _lines(F.col("text")))).select(
        "doc_id",
        n_lines.alias("n_lines"),
        F.when(F.col("lost").isNull(), 0).otherwise(F.size("lost")).cast("long").alias("n_dropped"),
        F.when(F.col("lost").isNull(), F.col("text")).otherwise(kept).alias("text"),
    )
