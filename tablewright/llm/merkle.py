"""A Merkle manifest of a dataset: digest-to-children records, and proofs by descent from the root."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.common import join_on
from ..functions.ordered import row_numbers
from ..functions.scale import checkpointed

#: Nodes of a run, and levels that one shuffle builds.
ARITY, LEVELS = 8, 3

_PATH = "array<struct<before:string,after:string>>"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns: Sequence[Column]) -> Column:
    """The digest of a row: of each value ``-`` if null, else its UTF-8 byte count, ``:`` and the value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def _depth(n: Column) -> Column:
    """Levels above ``n`` leaves until one node is left: the powers of ``ARITY`` that are smaller than ``n``."""
    return F.size(F.filter(F.array(*[F.lit(ARITY**i).cast("long") for i in range(20)]), lambda p: p < n))


def _built(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of trees over ``tree, at, digest``, and ``tree, digest, depth, n`` of their roots.

    Each round gathers up to ``ARITY ** LEVELS`` neighbours of a tree in one row and builds their levels there.
    """
    sizes = nodes.groupBy("tree").agg(F.count("*").alias("n"))
    sizes = checkpointed(sizes.withColumn("depth", _depth(F.col("n"))))
    deepest = sizes.agg(F.max("depth")).first()[0] or 0
    now, records, roots = nodes.select("tree", "at", "digest"), [], []
    for done in range(0, max(1, deepest), LEVELS):
        part = F.floor(F.col("at") / ARITY**LEVELS).cast("long").alias("at")
        own = F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x.digest)
        rows = join_on(now.groupBy("tree", part).agg(own.alias("digests")), sizes, ["tree"]).withColumn("left", F.col("depth") - done)
        made = []
        for i in range(LEVELS):
            starts = F.sequence(F.lit(1), F.size("digests"), F.lit(ARITY))
            runs = F.transform(starts, lambda s: F.slice("digests", s, F.lit(ARITY)))
            up = F.transform(runs, lambda run: F.struct(F.sha2(F.array_join(run, ""), 256).alias("digest"), run.alias("children")))
            rows = rows.withColumn(f"made_{i}", F.when(F.col("left") > i, up))
            rows = rows.withColumn("digests", F.when(F.col("left") > i, F.transform(f"made_{i}", lambda x: x.digest)).otherwise(F.col("digests")))
            made.append(f"made_{i}")
        every = F.flatten(F.array_compact(F.array(*made))).alias("records")
        rows = checkpointed(rows.select("tree", "at", "left", "depth", "n", every, F.get("digests", F.lit(0)).alias("digest")))
        records.append(rows.select(F.explode("records").alias("r")).select("r.digest", "r.children"))
        roots.append(rows.where(F.col("left") <= LEVELS).select("tree", "digest", "depth", "n"))
        now = rows.where(F.col("left") > LEVELS).select("tree", "at", "digest")
    return reduce(DataFrame.union, records), reduce(DataFrame.union, roots)


@dataclass
class Manifest:
    """A content-addressed tree over the rows of a table.

    ``leaves``: ``tree, at, leaf`` and the columns that were carried along; ``trees``: ``tree, place, digest,
    depth, n``, one row for each group; ``records``: ``digest, children``, one for each digest; ``root`` is
    None for an empty table, ``height`` counts the levels from the digests of the groups to the root.
    """

    leaves: DataFrame
    trees: DataFrame
    records: DataFrame
    root: str | None
    height: int


def build(
    df: DataFrame,
    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    id_col: str = "doc_id",
    group_col: str = "lang",
    carry: Mapping[str, Column] | None = None,
) -> Manifest:
    """The manifest of ``df``: a tree for each value of ``group_col``, and one over their roots.

    A leaf is the SHA-256 digest of a row's ``columns``. In a group leaves ascend by ``id_col``, null first; equal
    identifiers ascend by leaf. Every ``ARITY`` consecutive nodes (the last run may be shorter) become the
    digest of their digests as text, until one is left. The groups' roots ascend by group, null first, bytewise.

    The rows are read once; what is dealt by range, so that a group of any size is split, are digests.
    ``carry`` gives further columns of ``leaves``. Nulls, empty and very long texts are values like any other; a
    repeated row is a leaf of its own. An empty table has no root. Other columns are not looked at.
    """
    own = {"tree": F.col(group_col).cast("string"), "id": F.col(id_col).cast("long"), "leaf": leaf_digest([F.col(c) for c in columns])}
    rows = checkpointed(df.select(*[c.alias(n) for n, c in (own | dict(carry or {})).items()]))
    numbered = row_numbers(rows, ["tree"], ["tree", "id", "leaf"], "at")
    leaves = checkpointed(numbered.withColumn("at", F.col("at") - 1))
    records, roots = _built(leaves.select("tree", "at", F.col("leaf").alias("digest")))
    trees = checkpointed(row_numbers(roots, None, ["tree"], "place").withColumn("place", F.col("place") - 1))
    above, top = _built(trees.select(F.lit(None).cast("string").alias("tree"), F.col("place").alias("at"), "digest"))
    store = checkpointed(records.union(above).groupBy("digest").agg(F.first("children").alias("children")))
    found = top.first()
    return Manifest(leaves, trees, store, found.digest if found else None, found.depth if found else 0)


def _segment(children: Column, digit: Column) -> Column:
    """The children that a path does not take: those before and those after it, each joined."""
    before = F.array_join(F.slice(children, F.lit(1), digit), "")
    return F.struct(before.alias("before"), F.array_join(F.slice(children, digit + 2, F.lit(ARITY)), "").alias("after"))


def _descended(frontier: DataFrame, records: DataFrame, now: Column) -> DataFrame:
    """One level down: the children of the frontier rows for which ``now`` holds; the others stay where they are."""
    found = records.select(F.col("digest").alias("known"), "children")
    met = frontier.withColumn("now", now).join(found, F.col("now") & (F.col("digest") == F.col("known")), "left")
    kept = [c for c in frontier.columns if c not in ("digest", "at", "path", "left")]
    each = met.select(*kept, "now", "at", "path", "left", "children", F.posexplode(F.when(F.col("now"), F.col("children")).otherwise(F.array("digest"))).alias("digit", "digest"))
    further = F.concat("path", F.array(_segment(F.col("children"), F.col("digit"))))
    return each.select(
        *kept,
        "digest",
        F.when(F.col("now"), F.col("at") * ARITY + F.col("digit")).otherwise(F.col("at")).alias("at"),
        F.when(F.col("now"), further).otherwise(F.col("path")).alias("path"),
        (F.col("left") - F.col("now").cast("int")).alias("left"),
    )


def proofs(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """The proof of each requested leaf: ``requests`` with ``found`` (its digest) and ``proof``.

    ``requests`` has ``tree, at`` of leaves, in any number and order, and columns of its own. Requests descend from
    the root, one digit of their rank a level, by joins on digests; those that share a prefix go down as one
    row, so no level has more rows than the tree has nodes there, and none is entered that nobody asked for.
    The children that a step does not take become a segment of the path. ``proof`` is the reversed path: from the
    leaf up, ``before`` and ``after`` of each level, digests as text. Of a tree of one leaf it is empty.
    """
    trees, records = manifest.trees, manifest.records
    asked = requests.select("tree").distinct()
    wanted = join_on(trees, asked, ["tree"], "left_semi")
    start = wanted.sparkSession.range(1).select(
        F.lit(manifest.root).alias("digest"), F.lit(0).cast("long").alias("at"), F.array().cast(_PATH).alias("path"), F.lit(manifest.height).alias("left")
    )
    top = start.where("digest is not null")
    for level in range(manifest.height, 0, -1):
        below = wanted.select(F.floor(F.col("place") / ARITY ** (level - 1)).cast("long").alias("at")).distinct()
        top = _descended(top, records, F.lit(True)).join(below, "at", "left_semi")
    roots = wanted.select("tree", F.col("place").alias("at"), "depth")
    frontier = top.drop("left").join(roots, "at").select("tree", "digest", F.lit(0).cast("long").alias("at"), "path", F.col("depth").alias("left"))
    deepest = trees.agg(F.max("depth")).first()[0] or 0
    for level in range(deepest, 1, -1):
        below = requests.select("tree", F.floor(F.col("at") / ARITY ** (level - 1)).cast("long").alias("at")).distinct()
        frontier = join_on(_descended(frontier, records, F.col("left") == level), below, ["tree", "at"], "left_semi")
    known = records.select(F.col("digest").alias("known"), "children")
    runs = frontier.join(known, (F.col("left") == 1) & (F.col("digest") == F.col("known")), "left")
    runs = runs.select("tree", F.col("at").alias("run"), "path", F.coalesce("children", F.array("digest")).alias("children"), (F.col("left") == 1).alias("deep"))
    own = requests.withColumn("run", F.floor(F.col("at") / ARITY).cast("long"))
    met = join_on(own, runs, ["tree", "run"], "inner")
    digit = F.pmod("at", F.lit(ARITY)).cast("int")
    whole = F.when(F.col("deep"), F.concat("path", F.array(_segment(F.col("children"), digit)))).otherwise(F.col("path"))
    return met.select(*requests.columns, F.get("children", digit).alias("found"), F.reverse(whole).alias("proof"))


def proof_digest(proof: Column) -> Column:
    """The digest of all siblings of a proof, from the leaf's to the root's, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s.before, s.after)), ""), 256)


def folded(proof: Column, leaf: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda now, s: F.sha2(F.concat(s.before, now, s.after), 256))


def lowered(text: Column) -> Column:
    """The text with A-Z in lower case."""
    return F.translate(text, _UPPER, _LOWER)
