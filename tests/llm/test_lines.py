from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm.lines import LineRuns, dedup_lines

from .conftest import pairs


def brute(rows, least_chars=20, least_docs=3):
    def key(line):
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    rows = [(i, -(2**63) if i is None else i, (t or "").split("\n")) for i, t in rows]
    holders = defaultdict(list)
    for _, doc, lines in rows:
        for k in {key(x) for x in lines}:
            holders[k].append(doc)
    out = Counter()
    for i, doc, lines in rows:
        stay = [x for x in lines if len(k := key(x)) < least_chars or len(holders[k]) < least_docs or max(holders[k]) == doc]
        out[(i, len(lines), len(lines) - len(stay), "\n".join(stay))] += 1
    return out


def found(df):
    return Counter(map(tuple, df.collect()))


SHARED = "a line that very many documents share with each other"

LINES = [
    (1, SHARED),
    (2, f"  {SHARED.upper()}\t\nown line"),
    (3, f"{SHARED}\n{SHARED}\n\n{SHARED}  "),
    (4, f"first\n{SHARED}\r\nlast"),
    (5, "twice, so it stays in both documents\nx"),
    (6, "twice, so it stays in both documents\ny"),
    (7, "short line\nshort line"),
    (8, "short line"),
    (9, "short line"),
    (None, SHARED),
    (None, f"{SHARED}\nthree of them have no identifier"),
    (None, "three of them have no identifier"),
    (None, "three of them have no identifier"),
    (10, None),
    (11, ""),
    (12, "\n\n"),
    (13, "exactly 20 letters..\nnineteen letters..."),
    (14, "exactly 20 letters..\nnineteen letters..."),
    (15, "Exactly 20 letters..\nnineteen letters..."),
    (15, "Exactly 20 letters..\nnineteen letters..."),
    (16, "ÉTUDES, ÉTUDES ÉTUDES\n" * 3),
    (17, "études, études études\n" * 2),
    (18, "Études, Études Études"),
    (19, "Études, Études Études"),
    (20, "\n".join(f"{SHARED} {i % 700}" for i in range(30_000))),
    (21, "\n".join(f"{SHARED} {i % 900}" for i in range(2_000))),
    (22, "\n".join(f"{SHARED} {i}" for i in range(800))),
]


@pytest.mark.parametrize("batches, fan_in", [(1, 2), (4, 2), (7, 3)])
def test_equals_brute_force(spark, batches, fan_in):
    df = spark.createDataFrame(LINES, "doc_id long, text string").repartition(3)
    for name in ("a", "b", "doc", "same", "lost", "lines", "h", "batch", "keeper"):
        df = df.withColumn(name, F.lit(7))
    assert found(dedup_lines(df, batches=batches, fan_in=fan_in)) == brute(LINES)


def test_whole_tables(docs, odd, empty):
    assert found(dedup_lines(docs)) == brute(pairs(docs))
    assert found(dedup_lines(odd)) == brute(pairs(odd))
    assert dedup_lines(empty).count() == 0


def test_other_limits(docs):
    assert found(dedup_lines(docs, least_chars=5, least_docs=2)) == brute(pairs(docs), 5, 2)


def test_runs_are_levelled_and_merged_without_a_shuffle(spark, tmp_path):
    runs = LineRuns(spark, str(tmp_path), fan_in=2)
    for i in range(7):
        keys = spark.range(i * 10, i * 10 + 15).select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(100 - i).cast("long").alias("keeper"), F.lit(1).cast("long").alias("docs"))
        runs.add(keys)
    assert [len(level) for level in runs.levels] == [1, 1, 1]
    fresh = runs.rows().where("fresh")
    assert fresh.count() == fresh.select("a", "b").distinct().count() == 75
    assert {r.a: r.keeper for r in fresh.collect()} == {a: 100 - (max(0, a - 5) // 10) for a in range(75)}
    assert runs.held(2).count() == 30
    run = spark.table(runs.levels[2][0]).where("fresh")
    plan = run.join(run.withColumnRenamed("docs", "n").hint("merge"), ["a", "b"], "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith(runs.name)]


def test_plan_has_no_python(docs):
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
