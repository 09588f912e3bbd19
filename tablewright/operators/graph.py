"""Ranking on graphs held as edge tables ``(src, dst, cnt)``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.common import q
from ..functions.components import components
from ..functions.ordered import row_frame
from ..functions.scale import checkpointed


def edges_from_lists(df: DataFrame, src: str, links: str) -> DataFrame:
    """Adjacency lists to edges; repeated links add up."""
    long = df.select(q(src).alias("src"), F.explode(q(links)).alias("dst"))
    return long.groupBy("src", "dst").agg(F.count("*").cast("double").alias("cnt"))


def edges_from_sequence(df: DataFrame, item: str, order_by: list[str], by: list[str] | str | None = None) -> DataFrame:
    """Edges from each item to the next one in order, counted."""
    nxt = row_frame(df, by, order_by, 0, lambda w: {"_next": F.lead(q(item), 1).over(w)}, ahead=1)
    pairs = nxt.where(F.col("_next").isNotNull() & q(item).isNotNull())
    return pairs.groupBy(q(item).alias("src"), F.col("_next").alias("dst")).agg(
        F.count("*").cast("double").alias("cnt")
    )


def merge_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Accumulate counts."""
    both = old.select("src", "dst", "cnt").unionByName(new.select("src", "dst", "cnt"))
    return both.groupBy("src", "dst").agg(F.sum("cnt").alias("cnt"))


def nodes_of(edges: DataFrame) -> DataFrame:
    """All sources and destinations, once each."""
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


def transition_matrix(edges: DataFrame) -> DataFrame:
    """``(src, dst, p)``: counts over their sum per source; a node without out-edges loops on itself."""
    # written first, so that the join can split a source of very many edges
    totals = checkpointed(edges.groupBy("src").agg(F.sum("cnt").alias("_t")).where(F.col("_t") != 0))
    moves = edges.where(F.col("cnt") != 0).join(totals, "src").select("src", "dst", (F.col("cnt") / F.col("_t")).alias("p"))
    dangling = nodes_of(edges).join(totals, F.col("node") == totals["src"], "left_anti")
    loops = dangling.select(F.col("node").alias("src"), F.col("node").alias("dst"), F.lit(1.0).alias("p"))
    return moves.unionByName(loops)


_EDGES_PER_TASK = 1_000_000


def _iterate(edges: DataFrame, start, d: float, eps: float | None, max_iter: int | None) -> DataFrame:
    # The edge table is read many times below, so it is written once.
    edges = checkpointed(edges.select("src", "dst", "cnt"))
    # The edges stay partitioned by source through all rounds. A source with very many of them
    # is split into parts, and its rank is sent to each part.
    moves = transition_matrix(edges)
    hubs = checkpointed(
        moves.groupBy("src").agg(F.ceil(F.count("*") / _EDGES_PER_TASK).cast("int").alias("_parts")).where("_parts > 1")
    )
    split = not hubs.isEmpty()
    if split:
        part = F.pmod(F.xxhash64("dst"), F.coalesce("_parts", F.lit(1))).cast("int")
        moves = moves.join(hubs, "src", "left").withColumn("_part", part).drop("_parts")
    else:
        moves = moves.withColumn("_part", F.lit(0))
    moves = moves.repartition("src", "_part").persist()
    nodes = nodes_of(edges).persist()
    n = nodes.count()
    teleport = F.lit((1.0 - d) / n) if n else F.lit(0.0)

    def step(ranks: DataFrame) -> DataFrame:
        sent = ranks.select(F.col("node").alias("src"), "rank")
        if split:
            to = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
            sent = sent.join(hubs, "src", "left").select("src", "rank", to.alias("_part"))
        else:
            sent = sent.withColumn("_part", F.lit(0))
        flow = moves.join(sent, ["src", "_part"]).select(
            F.col("dst").alias("node"), (F.col("p") * F.col("rank")).alias("c"), F.lit(0.0).alias("old")
        )
        # The old ranks travel along: they keep nodes nothing links to, and tell how far ranks moved.
        kept = ranks.select("node", F.lit(0.0).alias("c"), F.col("rank").alias("old"))
        summed = flow.unionByName(kept).groupBy("node").agg(F.sum("c").alias("s"), F.max("old").alias("old"))
        return summed.select("node", (F.col("s") * d + teleport).alias("rank"), "old")

    ranks = start(nodes, n)
    rounds = 0
    while True:
        ranks = checkpointed(step(ranks))
        rounds += 1
        if max_iter is not None and rounds > max_iter:
            break
        if eps is not None:
            moved = ranks.agg(F.sqrt(F.sum((F.col("rank") - F.col("old")) ** 2)).alias("m")).first()["m"]
            if moved is None or moved < eps:
                break
    moves.unpersist()
    nodes.unpersist()
    return ranks.select("node", "rank")


def pagerank(
    edges: DataFrame, d: float = 0.85, eps: float | None = 1e-10, max_iter: int | None = None
) -> DataFrame:
    """``(node, rank)`` by power iteration from uniform ranks.

    Stops when the ranks move by less than ``eps`` (L2) or after ``max_iter`` steps beyond
    the first. Every step is one job, checkpointed.
    """
    if eps is None and max_iter is None:
        raise ValueError("give eps or max_iter")
    uniform = lambda nodes, n: nodes.withColumn("rank", F.lit(1.0 / n if n else 0.0))
    return _iterate(edges, uniform, d, eps, max_iter)


def pagerank_seeded(
    edges: DataFrame, seeds: DataFrame, d: float = 0.85, eps: float | None = 1e-10, max_iter: int | None = None
) -> DataFrame:
    """As :func:`pagerank`, from ranks boosted by 1 at each seed (``node``) and renormalised."""

    def start(nodes: DataFrame, n: int) -> DataFrame:
        hit = seeds.select("node").distinct().withColumn("_hit", F.lit(1.0))
        boosted = nodes.join(hit, "node", "left").select("node", (F.lit(1.0 / n) + F.coalesce("_hit", F.lit(0.0))).alias("w"))
        total = boosted.agg(F.sum("w").alias("t")).scalar()
        return boosted.select("node", (F.col("w") / total).alias("rank"))

    return _iterate(edges, start, d, eps, max_iter)


def next_step(edges: DataFrame, node: str) -> DataFrame:
    """``(node, p)``: every node with its one-step probability, likeliest first; empty for an unknown node."""
    moves = transition_matrix(edges).where(F.col("src") == F.lit(node)).select(F.col("dst").alias("node"), "p")
    known = moves.agg((F.count("*") > 0).alias("k")).scalar()
    ranked = nodes_of(edges).where(known).join(moves, "node", "left")
    return ranked.select("node", F.coalesce("p", F.lit(0.0)).alias("p")).orderBy(F.desc("p"), F.asc("node"))


def online_transition_update(adj: DataFrame, links: DataFrame, nodes: DataFrame, d: float = 0.85) -> DataFrame:
    """Fold link occurrences ``(src, dst)`` into a transition table ``(src, dst, p)``.

    Each occurrence moves its entry to ``(1-d)/N + d*p``, with N known nodes; m occurrences
    give ``d^m p + (1-d^m)/N``. Rows of sources with new links are then scaled to sum to 1.
    Links from or to unknown nodes are left out (see :func:`unseen_sources`).
    """
    known = nodes.select("node").distinct()
    n = known.agg(F.count("*").cast("double").alias("n")).scalar()
    seen = (
        links.groupBy("src", "dst").agg(F.count("*").alias("m"))
        .join(known.withColumnRenamed("node", "src"), "src", "left_semi")
        .join(known.withColumnRenamed("node", "dst"), "dst", "left_semi")
    )
    merged = adj.join(seen, ["src", "dst"], "full_outer")
    keep = F.pow(F.lit(d), F.coalesce("m", F.lit(0)).cast("double"))
    moved = merged.select("src", "dst", "m", (keep * F.coalesce("p", F.lit(0.0)) + (1 - keep) / n).alias("p"))
    sums = moved.groupBy("src").agg(F.sum("p").alias("_t"), F.count("m").alias("_new"))
    scaled = F.when(F.col("_new") > 0, F.col("p") / F.col("_t")).otherwise(F.col("p"))
    return moved.join(sums, "src").select("src", "dst", scaled.alias("p"))


def unseen_sources(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources of new links that are no known node."""
    return links.select("src").distinct().join(nodes.select(F.col("node").alias("src")), "src", "left_anti")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node each one is connected to; a node linked to itself alone is its own."""
    found = components(edges.select("src", "dst"))
    alone = edges.where("src = dst").select(F.col("src").alias("node")).distinct().join(found, "node", "left_anti")
    return found.unionByName(alone.select("node", F.col("node").alias("component")))

