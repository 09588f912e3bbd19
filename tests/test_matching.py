"""Similar values and similar texts: brute-force equality, and candidates that do not grow with the square of a group."""

import random

import pytest
from pyspark.sql import functions as F

from tablewright.functions import text as X
from tablewright.functions.scale import checkpointed
from tablewright.operators import dedup as E


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def changed(rng, word, times):
    for _ in range(times):
        at = rng.randrange(len(word) + 1)
        word = word[:at] + rng.choice(["", "q", "ä"]) + word[at + rng.randint(0, 1) :]
    return word


@pytest.mark.parametrize("distance, crowd", [(0, 1), (1, 1), (2, 1), (2, 64), (3, 2)])
def test_pairs_within_edits(spark, distance, crowd):
    rng = random.Random(distance * 10 + crowd)
    base = ["".join(rng.choice("abcd") for _ in range(rng.randint(0, 14))) for _ in range(20)] + ["common word " + c for c in "abcdefgh"]
    words = sorted({changed(rng, w, rng.randint(0, 3)) for w in base for _ in range(4)} | {"", "a", "𝄞x", "x𝄞"})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = X.close_pairs(df, "w", df.withColumnRenamed("w", "v"), "v", distance, crowd=crowd).collect()
    assert {(r.w, r.v): r.distance for r in got} == {(a, b): edits(a, b) for a in words for b in words if edits(a, b) <= distance}
    assert len(got) == len({(r.w, r.v) for r in got})


def test_keys_do_not_grow_with_the_length(spark):
    df = spark.createDataFrame([("abcdefghij" * 30,), ("", ), (None,)], "w string")
    assert X.part_keys(df, "w", 2, 1, True).count() + X.part_keys(df, "w", 2, 1, False).count() < 100
    assert X.part_keys(df, "w", 2, 2, True).count() <= 150


def test_a_common_word_is_refined(spark):
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abcdefghij") for _ in range(10)) + " the common ending" for _ in range(150)})
    words += [changed(rng, w, 1) for w in words[:20]]
    df = spark.createDataFrame([(w,) for w in words], "w string").distinct()
    keep = X.part_keys(df, "w", 2, 1, False)
    assert not keep.groupBy("_key").count().where("count > 64").isEmpty()  # one part is the same in most
    got = E.fuzzy_matches(df.withColumn("id", F.monotonically_increasing_id()), "id", "w", None, 2).collect()
    want = {(a, b) for a in words for b in words if a < b and edits(a, b) <= 2}
    assert {(r.value_a, r.value_b) for r in got} == want


def passages(count, seed):
    """Texts that share a long passage (0.4 alike), and a near copy of every tenth."""
    rng = random.Random(seed)
    passage = [f"p{i}" for i in range(60)]
    rows, want = [], set()
    for i in range(count):
        own = [f"w{rng.random()}" for _ in range(45)]
        rows.append((i, " ".join(passage + own)))
        if i % 10 == 0:
            rows.append((10_000 + i, " ".join(passage + own[:-4])))
            want |= {(i, i), (10_000 + i, i)}
    return rows, want


def test_texts_that_share_a_passage(spark, monkeypatch):
    looked_at = []
    whole = E._verified

    def counted(pairs, sets, similarity):
        looked_at.append(pairs.distinct().count())
        return whole(pairs, sets, similarity)

    monkeypatch.setattr(E, "_verified", counted)
    totals = []
    for count in (150, 300):
        rows, want = passages(count, count)
        looked_at.clear()
        got = E.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", crowd=16)
        assert {tuple(r) for r in got.collect()} == want
        assert len(looked_at) > 2  # bands were signed again
        totals.append(sum(looked_at))
    assert totals[1] <= 2.5 * totals[0] + 100 and totals[1] < 300 * 10


def test_bands_signed_again_keep_what_belongs_together(spark):
    """With no crowd allowed, every open band goes through all signings."""
    rng = random.Random(3)
    rows = []
    for group in range(40):
        own = [f"g{group}w{i}" for i in range(80)]
        for copy in range(4):
            cut = rng.randint(0, 6)
            rows.append((group * 10 + copy, " ".join(own[: len(own) - cut])))
    got = E.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", crowd=0)
    assert {tuple(r) for r in got.collect()} == {(i, i // 10 * 10) for i, _ in rows}


def test_sketches_differ_in_few_minima(spark):
    words = [f"w{i}" for i in range(100)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:90])), (3, " ".join(f"x{i}" for i in range(100)))]
    df = spark.createDataFrame(rows, "id long, t string").select("id", X.word_sets(5, 32, 3)("t").alias("s"))
    a, b = df.select("id", F.col("s.sketch").alias("x")), df.select(F.col("id").alias("other"), F.col("s.sketch").alias("y"))
    far = {(r.id, r.other): r.n for r in a.join(b, F.lit(True)).select("id", "other", X.sketches_differ("x", "y").alias("n")).collect()}
    assert far[1, 1] == 0 and far[1, 2] < 20 and 50 < far[1, 3] < 90


def test_near_duplicates_sign_each_text_once(spark, monkeypatch):
    """Spark repeated the signing in filters that it pushed under joins, over all texts of the table."""
    rng = random.Random(8)
    rows = []
    for group in range(6):
        own = [f"g{group}w{i}" for i in range(80)]
        rows += [(group * 10 + copy, " ".join(own[: len(own) - rng.randint(0, 40)])) for copy in range(6)]
    rows += [(1000 + i, " ".join(rng.choices("abcdefghijklmnop", k=40))) for i in range(30)]
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(E, "checkpointed", seen)
    E.near_duplicates(spark.createDataFrame(rows, "id long, t string"), "id", "t", crowd=0).collect()
    signing = [p for p in plans if "ArrowEvalPython" in p]
    assert len(signing) >= 3  # bands were signed again
    assert all(p.count("ArrowEvalPython") == 1 for p in signing)
    assert all(p.index("ArrowEvalPython") < p.index("Join") for p in signing if "Join" in p)


def test_runs_apart_is_never_too_much(spark):
    """Marks of sets of all sizes say of any pair at most how many runs they do not share, and tell far ones."""
    rng = random.Random(9)
    texts = [" ".join(rng.choices([f"w{i}" for i in range(3000)], k=k)) for k in (1, 4, 5, 20, 36, 40, 75, 130, 300, 9000)]
    for k in (30, 60, 128, 250, 500, 9000):  # copies with some words changed, cut off or added
        words = rng.choices([f"v{i}" for i in range(3000)], k=k)
        for share in (0.01, 0.1, 0.4):
            texts.append(" ".join(w if rng.random() > share else w + "x" for w in words))
            texts.append(" ".join(words[: int(k * (1 - share))]))
        texts.append(" ".join(words + words[::-1]))
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    signed = df.select("id", X.word_sets(5, 32, 3)("t").alias("s"), X.word_runs(5)("t").alias("runs")).collect()
    runs = {r.id: set(r.runs) for r in signed}
    assert all(r.s.n == len(r.runs) == len(runs[r.id]) for r in signed)
    true = {(i, j): len(runs[i] ^ runs[j]) for i in runs for j in runs}
    for kind, longs in (("marks", None), ("brief", 2**X.BRIEF_BITS // 64)):
        marks = spark.createDataFrame([(r.id, r.s[kind]) for r in signed], "id long, m array<long>")
        a, b = marks.select("id", F.struct("m").alias("x")), marks.select(F.col("id").alias("other"), F.struct("m").alias("y"))
        told = {(r.id, r.other): r.n for r in a.crossJoin(b).select("id", "other", X.runs_apart("x.m", "y.m", longs).alias("n")).collect()}
        assert all(0 <= told[p] <= true[p] and told[p] == told[p[::-1]] for p in true)
        assert sum(told[p] > true[p] / 3 for p in true if 4 <= true[p] <= 200) > 20


def test_near_duplicates_send_no_sets_through_the_driver(spark, tmp_path, monkeypatch):
    """Sizes guessed from arrays of one element made Spark broadcast whole sets and bands."""
    rng = random.Random(5)
    texts = [" ".join(rng.choices("abcdefghijklmnop", k=60)) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate([*texts, *(t + " z" for t in texts[:20])])]
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpointed(df)

    monkeypatch.setattr(E, "checkpointed", seen)
    spark.createDataFrame(rows, "id long, t string").write.parquet(f"{tmp_path}/texts")  # a file has a size to guess from
    got = E.near_duplicates(spark.read.parquet(f"{tmp_path}/texts"), "id", "t")
    assert {(r["id"], r["cluster"]) for r in got.collect()} == {(x, i) for i in range(20) for x in (i, i + 40)}
    assert len(plans) >= 4 and not any("BroadcastHashJoin" in p for p in plans)


def test_partial_duplicates_of_few_and_many_rows_to_a_key(spark):
    """Keys of few rows need one shuffle and no copies of rows for neighbouring cells; crowded keys go by cells."""
    rng = random.Random(6)
    rows = [(rng.choice([None, *range(12)]), rng.choice([None, rng.uniform(0, 90)]), rng.randint(0, 40)) for _ in range(60)]
    rows += [(99, rng.uniform(0, 900), rng.randint(0, 900)) for _ in range(80)] + rows[:5]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, k int, x double, y int")

    def near(a, b):
        return a[0] == b[0] and None not in (a[1], b[1]) and abs(a[1] - b[1]) <= 6 and abs(a[2] - b[2]) <= 4

    want = {i for i, a in enumerate(rows) if any(near(a, b) for j, b in enumerate(rows) if i != j)}
    got = E.partial_duplicates(df, ["k"], {"x": 6.0, "y": 4.0})
    assert got.columns == df.columns and sorted(r["id"] for r in got.collect()) == sorted(want)
    thin = E.partial_duplicates(df.where("k < 99"), ["k"], {"x": 6.0, "y": 4.0})
    plan = thin._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan
