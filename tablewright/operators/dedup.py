"""Finding and removing duplicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.common import as_list, is_missing, join_on, q
from ..functions.ordered import row_frame, sort_columns
from ..functions.scale import checkpointed, release, stored
from ..functions.text import BRIEF_BITS, close_pairs, runs_apart, set_bands, sketches_differ, word_runs, word_sets
from .graph import connected_components


def _first_per_key(df: DataFrame, keys: Sequence[str], order) -> DataFrame:
    # row_number() <= 1 lets Spark keep one row per key and task before the shuffle.
    w = Window.partitionBy(*[q(k) for k in keys]).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") == 1).drop("_rn")


def dedup_exact(df: DataFrame, cols: Sequence[str] | None = None, tiebreak: Sequence[str] = ()) -> DataFrame:
    """One row per identical group over ``cols`` (all columns if none are given)."""
    if cols is None:
        return df.distinct()
    rest = [c for c in df.columns if c not in cols and c not in tiebreak]
    return _first_per_key(df, list(cols), sort_columns([*tiebreak, *rest]) or [F.lit(0)])


def dedup_keep_recent(df: DataFrame, keys: Sequence[str], ts: str, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The latest version per key; ties by the tiebreak columns, descending."""
    return _first_per_key(df, keys, [q(c).desc_nulls_last() for c in [ts, *tiebreak]])


def dedup_keep_complete(df: DataFrame, keys: Sequence[str], tiebreak: Sequence[str] = ()) -> DataFrame:
    """The row with the fewest missing values per key; ties by the tiebreak columns, ascending."""
    nulls = reduce(lambda a, b: a + b, [is_missing(df, c).cast("int") for c in df.columns])
    return _first_per_key(df, keys, [nulls.asc(), *sort_columns(tiebreak)])


def survivorship(
    df: DataFrame, keys: Sequence[str], rules: Mapping[str, str], ts: str | None = None, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """One golden record per key, built column by column: ``latest`` non-null, ``max``, ``min`` or ``mode``."""
    keys = as_list(keys)
    aggs = []
    for c, rule in rules.items():
        if rule == "latest":
            at = F.struct(*[q(x) for x in [ts, *tiebreak]])
            aggs.append(F.max_by(q(c), F.when(q(c).isNotNull(), at)).alias(c))
        elif rule in ("max", "min"):
            aggs.append(getattr(F, rule)(q(c)).alias(c))
        elif rule != "mode":
            raise ValueError(f"unknown survivorship rule {rule!r}")
    out = df.groupBy(*keys).agg(F.count("*").alias("n_versions"), *aggs)
    for c in [c for c, rule in rules.items() if rule == "mode"]:
        counts = df.where(q(c).isNotNull()).groupBy(*keys, q(c).alias("_v")).agg(F.count("*").alias("_n"))
        best = F.min(F.struct((-F.col("_n")).alias("neg"), F.col("_v").alias("v"))).alias("_b")
        modes = counts.groupBy(*keys).agg(best).select(*keys, F.col("_b.v").alias(c))
        out = join_on(out, modes, keys)
    return out.select(*keys, *rules, "n_versions")


def fuzzy_matches(
    df: DataFrame, id_col: str, col: str, block: Sequence[str] | str | None = None, max_dist: int = 1
) -> DataFrame:
    """Pairs of different values within ``max_dist`` edits in the same block.

    Copies of one value are folded into one entry with its first id and count (``n_a``,
    ``n_b``), so a heavily repeated value costs no more than a rare one.
    """
    blocks = as_list(block)
    values = (
        df.where(q(col).isNotNull())
        .groupBy(*blocks, q(col).alias("value"))
        .agg(F.min(id_col).alias("id"), F.count("*").alias("n"))
    )
    a = values.select(*blocks, F.col("value").alias("value_a"))
    b = values.select(*blocks, F.col("value").alias("value_b"))
    pairs = close_pairs(a, "value_a", b, "value_b", max_dist, blocks, ordered=True)
    for side in ("a", "b"):
        named = values.withColumnsRenamed({"value": f"value_{side}", "id": f"id_{side}", "n": f"n_{side}"})
        pairs = join_on(pairs, named, [*blocks, f"value_{side}"], "inner")
    return pairs.select(*blocks, "id_a", "id_b", "value_a", "value_b", "n_a", "n_b", "distance")


def partial_duplicates(df: DataFrame, keys: Sequence[str], tolerance: Mapping[str, float], crowd: int = 32) -> DataFrame:
    """Rows with a partner that has equal keys and whose numbers all lie within the tolerances.

    Numbers are laid on a grid with cells as wide as the tolerance. Rows that share a cell are partners at once. Rows
    of keys with at most ``crowd`` rows meet each other after one shuffle. Keys with more rows are written to the shared
    folder first, so that Spark knows how few they are; there only rows alone in their cell are compared, with the
    cells next to theirs, so a crowded cell is met by a bounded number of single rows.
    """
    keys, nums = as_list(keys), list(tolerance)
    cell = F.array(*[F.floor(q(c).cast("double") / F.lit(float(t))).cast("bigint") for c, t in tolerance.items()])
    placed = df.withColumn("_cell", cell)
    complete = reduce(lambda a, b: a & b, [q(c).isNotNull() for c in nums])
    known = placed.where(complete)
    if not keys:
        return _partners_by_cells(known, keys, tolerance)
    heavy = stored(known.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd).select(*keys))
    crowded = not heavy.isEmpty()
    thin = join_on(known, heavy, keys, "left_anti") if crowded else known

    def partner(x: Column) -> Column:
        close = [F.abs(q(c) - x[f"v{i}"]) <= F.lit(float(t)) for i, (c, t) in enumerate(tolerance.items())]
        return (x["cell"] == F.col("_cell")) | reduce(lambda a, b: a & b, close)

    own = F.struct(F.col("_cell").alias("cell"), *[q(c).alias(f"v{i}") for i, c in enumerate(nums)])
    met = thin.withColumn("_near", F.collect_list(own).over(Window.partitionBy(*[q(k) for k in keys])))
    # each row meets itself
    found = met.where(F.size(F.filter("_near", partner)) > 1).drop("_cell", "_near")
    return found.union(_partners_by_cells(join_on(known, heavy, keys, "left_semi"), keys, tolerance)) if crowded else found


def _partners_by_cells(known: DataFrame, keys: Sequence[str], tolerance: Mapping[str, float]) -> DataFrame:
    nums = list(tolerance)
    sizes = known.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"), *[F.first(q(c)).alias(c) for c in nums])
    crowded = sizes.where(F.col("_n") > 1).select(*keys, "_cell")
    single = sizes.where(F.col("_n") == 1)
    offsets = [o for o in product((-1, 0, 1), repeat=len(nums)) if any(o)]
    steps = F.array(*[F.array(*[F.lit(s).cast("bigint") for s in o]) for o in offsets])
    asked = single.select(
        *keys,
        F.col("_cell").alias("_home"),
        *[q(c).alias(f"_s_{c}") for c in nums],
        F.explode(F.transform(steps, lambda o: F.zip_with("_cell", o, lambda x, y: x + y))).alias("_cell"),
    )
    # One row per (cell, numbers) is enough on the other side.
    others = known.groupBy(*keys, "_cell", *nums).agg(F.lit(1).alias("_one"))
    close = reduce(
        lambda a, b: a & b, [F.abs(q(c) - q(f"_s_{c}")) <= F.lit(float(t)) for c, t in tolerance.items()]
    )
    matched = join_on(asked, others, [*keys, "_cell"], "inner").where(close)
    flagged = crowded.unionByName(matched.select(*keys, F.col("_home").alias("_cell"))).distinct()
    return join_on(known, flagged, [*keys, "_cell"], "inner").drop("_cell")


def delayed_duplicates(
    df: DataFrame, keys: Sequence[str], ts: str, max_days: int = 7, tiebreak: Sequence[str] = ()
) -> DataFrame:
    """Rows whose content was last seen 1 to ``max_days`` days before, with that instant."""
    seen = row_frame(df, keys, [ts, *tiebreak], 1, lambda w: {"previous_ts": F.lag(q(ts)).over(w)})
    gap = F.unix_micros(q(ts).cast("timestamp")) - F.unix_micros(F.col("previous_ts").cast("timestamp"))
    day = 86_400_000_000
    return seen.where(gap.between(day, max_days * day))


def duplicate_clusters(pairs: DataFrame, a: str = "id_a", b: str = "id_b") -> DataFrame:
    """``(id, cluster)``: every id in a pair, and the smallest id it is connected to."""
    return connected_components(pairs.select(q(a).alias("src"), q(b).alias("dst"))).select(
        F.col("node").alias("id"), F.col("component").alias("cluster")
    )


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose whole sets are as similar as that."""
    left, right = (sets.select(F.col("id").alias(i), F.col("runs").alias(x)) for i, x in (("a", "x"), ("b", "y")))
    shared = F.size(F.array_intersect("x", "y"))
    both = pairs.distinct().join(left.hint("merge"), "a").join(right.hint("merge"), "b")
    return both.where(shared >= similarity * (F.size("x") + F.size("y") - shared)).select("a", "b")


def near_duplicates(
    df: DataFrame, id_col: str, text_col: str, similarity: float = 0.75, words: int = 5, bands: int = 32, rows: int = 3,
    crowd: int = 64, finer: Sequence[tuple[int, int]] = ((64, 6), (160, 9)),
) -> DataFrame:
    """``(id, cluster)``: every text with a near copy, and the smallest id of its cluster.

    Near copies have word runs with a Jaccard ``similarity`` of at least that. Whole texts make MinHash bands; with 32
    bands of 3 rows a pair at 0.75 shares no band once in 40 million. Texts that share a band first meet its smallest
    id. Where that leaves different clusters in a band of at most ``crowd`` texts, these meet each other. The texts of
    larger bands are signed again, with the bands and rows that ``finer`` lists, and meet there in the same way: texts
    that only share a passage part, while a pair at 0.75 stays together but once in 200,000. After the last signing
    the texts that are still together meet each other, however many. Pairs whose sketches (two bits of each minimum
    of the first signing) are five deviations from what the similarity gives are not looked at; neither are pairs whose
    ``marks`` prove them too far apart, which misses none. Of all others the whole sets decide. Texts with equal runs count
    as one beforehand. Texts without words, and rows without an id, are near nothing.

    What is kept of every text is its signs; the sets of texts in pairs that are left, or in large bands, are made from the
    texts again: the texts are read three times, and pass through two shuffles.

    Spark takes an array for one element when it guesses a size, and a row that is exploded for one row: by that guess
    it would send whole sets and bands through the driver. So joins of what grows with the table ask for a merge.
    """
    texts = df.select(q(id_col).alias("id"), q(text_col).cast("string").alias("text")).where("id is not null")
    signs = checkpointed(texts.select("id", word_sets(words, bands, rows)("text").alias("s")).select("id", "s.*").where("n > 0"))
    # written first, so that the join can split a set that very many texts have
    alike = checkpointed(signs.groupBy("same").agg(F.min("id").alias("first")))
    copies = checkpointed(signs.select("id", "same").join(alike.hint("merge"), "same").where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")))
    single = checkpointed(signs.join(alike.select(F.col("first").alias("id")).hint("merge"), "id", "left_semi").dropDuplicates(["id", "same"]).drop("same"))
    facts = single.select("id", F.struct("id", "n", "sketch", "brief", "marks").alias("y"))
    agree = similarity + (1 - similarity) / 4
    most = bands * rows * (1 - agree) + 5 * (bands * rows * agree * (1 - agree)) ** 0.5

    def possible(x: str, y: str):
        low, high = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
        return (low >= similarity * high) & (sketches_differ(f"{x}.sketch", f"{y}.sketch", -(-bands * rows // 32)) <= most)

    def close(x: str, y: str, apart: Column):
        return (1 + similarity) * apart <= (1 - similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6

    def still(pairs: DataFrame) -> DataFrame:
        left, right = (facts.select(F.col("id").alias(i), F.col("y").alias(x)).hint("merge") for i, x in (("a", "x"), ("b", "y")))
        return checkpointed(pairs.distinct().join(left, "a").join(right, "b").where(possible("x", "y") & close("x", "y", runs_apart("x.marks", "y.marks"))).select("a", "b").distinct())

    def whole(ids: DataFrame) -> DataFrame:
        """The sets of some texts, made from the texts again, which take less room than all sets."""
        kept = texts.join(ids.distinct().hint("merge"), "id", "left_semi")
        return checkpointed(kept.select("id", word_runs(words)("text").alias("runs")).where(F.size("runs") > 0))

    def ends(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("id"))

    links, sets = [], None
    asked = single.select("id", F.posexplode("bands").alias("band", "key"))
    for step in range(len(finer) + 1):
        heads = asked.groupBy("band", "key").agg(F.min("id").alias("head"), F.count("*").alias("members")).where("members > 1")
        posted = checkpointed(asked.join(heads.hint("merge"), ["band", "key"]).where("head <> id"))
        pairs = still(posted.select(F.col("head").alias("a"), F.col("id").alias("b")))
        links.append(checkpointed(_verified(pairs, whole(ends(pairs)) if sets is None else sets, similarity)))
        found = duplicate_clusters(reduce(DataFrame.union, links), "a", "b")
        member = posted.select("band", "key", "members", "id").join(found.hint("merge"), "id", "left").withColumn("cluster", F.coalesce("cluster", "id"))
        apart = member.groupBy("band", "key").agg(F.min("cluster").alias("low"), F.max("cluster").alias("high")).where("low < high")
        # the head has met all members of its band
        open_ = member.join(apart.select("band", "key").hint("merge"), ["band", "key"], "left_semi")
        last = step == len(finer)
        own = F.struct("y.id", "y.n", "y.sketch", *["y.brief"] * last)
        member = checkpointed(open_.join(facts.hint("merge"), "id").select("band", "key", "members", own.alias("y"), "cluster"))
        few = member if last else member.where(F.col("members") <= crowd)
        other = few.select("band", "key", F.col("y").alias("x"), F.col("cluster").alias("of"))
        across = few.join(other.hint("merge"), ["band", "key"]).where((F.col("x.id") < F.col("y.id")) & (F.col("cluster") != F.col("of")) & possible("x", "y"))
        # where the number of texts is not bounded, most pairs end here
        across = across.where(close("x", "y", runs_apart("x.brief", "y.brief", 2**BRIEF_BITS // 64))) if last else across
        across = still(across.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")))
        many = member.where(F.col("members") > crowd).select(F.col("y.id").alias("id")).distinct()
        if sets is None:
            # all texts that are signed again, too
            sets = whole(ends(across).union(many))
        links.append(checkpointed(_verified(across, sets, similarity)))
        if last or many.isEmpty():
            break
        keys = set_bands(*finer[step], seed=43 + step)("runs")
        again = checkpointed(sets.join(many.hint("merge"), "id", "left_semi").select("id", keys.alias("bands")))
        asked = again.select("id", F.posexplode("bands").alias("band", "key"))
        # each step makes some dozens of shuffles; what they leave takes disk, however small they are
        del heads, posted, pairs, found, member, apart, open_, few, other, across, many
        release(df.sparkSession)
    return duplicate_clusters(reduce(DataFrame.union, [*links, copies]), "a", "b")


def dedup_audit(df: DataFrame, keys: Sequence[str], id_col: str, ts: str) -> DataFrame:
    """Every row that keeping the latest version would drop: its id, the survivor and the reason."""
    keys = as_list(keys)
    newest = F.max(F.struct(q(ts).alias("ts"), q(id_col).alias("id")))
    survivors = df.groupBy(*keys).agg(newest.alias("_s"))
    joined = join_on(df, survivors, keys)
    same_instant = q(ts).eqNullSafe(F.col("_s.ts"))
    reason = F.when(same_instant, "same instant, smaller id").when(q(ts).isNull(), "no instant").otherwise("older version")
    return joined.where(~(q(id_col).eqNullSafe(F.col("_s.id")) & same_instant)).select(
        *keys, q(id_col).alias("dropped_id"), F.col("_s.id").alias("survivor_id"), reason.alias("reason")
    )
