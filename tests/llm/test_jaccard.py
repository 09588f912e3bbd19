import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tablewright.functions.components import components
from tablewright.llm import jaccard
from tablewright.llm.jaccard import jaccard_components

from .conftest import pairs


def sets_of(rows):
    out = []
    for doc_id, text in rows:
        w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
        out.append((doc_id, {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}))
    return out


def brute(rows):
    sets = sets_of(rows)
    group = list(range(len(sets)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    where = {}
    for i, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    shared = Counter((i, j) for at in where.values() for k, j in enumerate(at) for i in at[:k])
    for (i, j), n in shared.items():
        if 100 * n >= 75 * (len(sets[i][1]) + len(sets[j][1]) - n):
            group[top(j)] = top(i)
    least = {}
    for i, (doc_id, _) in enumerate(sets):
        if doc_id is not None:
            least[top(i)] = min(doc_id, least.get(top(i), doc_id))
    return Counter((doc_id, len(s), least.get(top(i))) for i, (doc_id, s) in enumerate(sets))


def found(df, **kw):
    got = jaccard_components(df, **kw).cache()
    assert got.where("kept").groupBy("component_id").count().where("count > 1 and component_id is not null").count() == 0
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in got.collect())


def test_equals_brute_force(docs, odd, empty):
    assert found(docs) == brute(pairs(docs))
    assert found(odd) == brute(pairs(odd))
    assert jaccard_components(empty).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_hot_passages_and_borders(spark, seed):
    """Near copies of near copies, a passage in most texts, and similarities close to 0.75 on both sides."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [rng.choice(words) for _ in range(30)]
    rows = []
    for _ in range(12):
        text = [rng.choice(words) for _ in range(rng.randrange(20, 90))]
        for _ in range(12):
            rows.append(" ".join(text))
            text = list(text)
            for _ in range(rng.randrange(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                text = text[: -rng.randrange(1, 6)]
    rows += [" ".join(passage + [rng.choice(words) for _ in range(rng.randrange(0, 14))]) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, block_shingles=300, sorted_shingles=50) == brute(rows)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {x: {x} for e in edges for x in e}
    for a, b in edges:
        if want[a] is not want[b]:
            merged = want[a] | want[b]
            for x in merged:
                want[x] = merged
    assert got == {x: min(s) for x, s in want.items() if len(s) > 1}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_rounds_of_heads_join_a_group_whose_first_member_is_apart(spark):
    """Variants of one text: each links with many others, few with the first; then a group without any link."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(100)]
    rows = []
    for i in range(120):
        text = list(base)
        for _ in range(1 if i % 9 else 3):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(text)))
    other = [f"c{i}" for i in range(60)]
    rows += [(1000 + i, " ".join([*other, *(f"y{i}-{j}" for j in range(14))])) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df) == brute(rows)


def test_sets_with_equal_class_sizes_are_told_apart_before_they_are_verified(spark):
    grams = spark.range(200).selectExpr("id div 100 as row", "id % 100 + 256 * (id div 100) as gram")
    parts = [F.count("*").alias("n"), F.collect_list(F.struct("gram")).alias("ranked"), F.array(*map(jaccard._mark, range(jaccard.MARKS))).alias("marks")]
    sizes = F.array(*map(jaccard._class_size, range(jaccard.CLASSES))).alias("sizes")
    sets = grams.groupBy("row").agg(*parts).select(F.struct("row", "n", F.lit(0).alias("alone"), sizes, "marks", F.lit(0).alias("position")).alias("a"))
    pairs = sets.crossJoin(sets.withColumnRenamed("a", "b")).where(jaccard._possible("a", "b", 75))
    assert sorted((r.a.row, r.b.row) for r in pairs.collect()) == [(0, 0), (1, 1)]


def test_shuffles_of_earlier_rounds_are_let_go(spark, monkeypatch):
    """No more than three tables are written before what made the ones before them is let go."""
    rows = [(i, " ".join(f"w{w}-{i % 7 if w > 90 - i else 0}" for w in range(100))) for i in range(30)]
    written, most = [0], [0]
    write = jaccard.checkpointed

    def counted(df):
        written[0] += 1
        most[0] = max(most[0], written[0])
        return write(df)

    monkeypatch.setattr(jaccard, "checkpointed", counted)
    monkeypatch.setattr(jaccard, "release", lambda session: written.__setitem__(0, 0))
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == brute(rows)
    assert 0 < most[0] <= 3
