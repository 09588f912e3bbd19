import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablewright.llm import merkle, queries

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DDL = "doc_id long, source string, lang string, n_chars long, text string"


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    texts = [None if v is None else str(v) for v in row]
    return digest(*["-" if t is None else f"{len(t.encode())}:{t}" for t in texts])


def lowered(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(digests):
    """Levels from the digests to the root."""
    levels = [digests]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 8]) for i in range(0, len(below), 8)])
    return levels


def path(levels, at):
    out = []
    for level in levels[:-1]:
        run = level[at // 8 * 8 : at // 8 * 8 + 8]
        out.append(("".join(run[: at % 8]), "".join(run[at % 8 + 1 :])))
        at //= 8
    return out


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(((row[0] is not None, row[0] or 0, leaf(row)), row))
    groups = {k: sorted(v, key=lambda x: x[0]) for k, v in groups.items()}
    order = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: tree([x[0][2] for x in groups[k]]) for k in order}
    top = tree([trees[k][-1][0] for k in order])
    out = Counter()
    for place, k in enumerate(order):
        for at, (_, row) in enumerate(groups[k]):
            segments = path(trees[k], at) + path(top, place)
            crc = zlib.crc32(("" if row[0] is None else str(row[0])).encode())
            now = leaf([*row[:4], lowered(row[4])]) if crc % 3 == 0 else leaf(row)
            for before, after in segments:
                now = digest(before, now, after)
            proof = digest(*[a + b for a, b in segments])
            out[(row[0], leaf(row), trees[k][-1][0], top[-1][0], proof, now, now == top[-1][0])] += 1
    return out


def found(df):
    return Counter(map(tuple, df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()))


def query(spark, tmp_path, df):
    df.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return queries.QUERIES["op13_merkle_manifest"](spark, str(tmp_path))


def rows_of(sizes):
    """Groups of the given sizes with nulls, repeated rows, repeated and missing identifiers."""
    rows = []
    for g, n in enumerate(sizes):
        lang = None if g == 1 else f"{'é' if g % 2 else 'z'}{g}"
        rows += [(i * 7 % 50 if g % 3 == 1 else i + g * 1000, None if i % 5 == 0 else f"s{i % 3}", lang, None if i % 4 == 0 else i, None if i % 6 == 0 else f"Text {i // 2} É" * (i % 3)) for i in range(n)]
    rows += [(None, None, None, None, None)] * 70 + [(None, "s", "z0", 3, "A"), (None, "s", "z0", 3, "a"), (5, "s", "z0", 3, "x" * 300_000)]
    return rows


@pytest.mark.parametrize("sizes", [[1], [8, 1, 9], [65, 64, 3, 1, 1, 1, 1, 1, 1], [520, 2]])
def test_equals_brute_force(spark, tmp_path, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame(rows, DDL).repartition(3).withColumns({c: F.lit(7) for c in ("tree", "at", "leaf", "path", "digest", "id")})
    assert found(query(spark, tmp_path, df)) == brute(rows)


def test_one_group_of_one_row(spark, tmp_path):
    rows = [(1, "s", "en", 2, "Ab")]
    assert found(query(spark, tmp_path, spark.createDataFrame(rows, DDL))) == brute(rows)


def test_whole_table(spark, docs, tmp_path):
    rows = list(map(tuple, docs.select(FIELDS).collect()))
    told = found(query(spark, tmp_path, docs))
    assert told == brute(rows)
    assert {v for *_, v in told} == {True, False}


def test_empty_table(spark, empty, tmp_path):
    assert query(spark, tmp_path, empty.select(FIELDS)).count() == 0


def test_few_requests_meet_few_records(spark, docs):
    told = merkle.build(docs)
    some = told.leaves.where("at % 50 = 7")
    got = merkle.proofs(told, some).collect()
    assert len(got) == some.count()
    whole = {(r.tree, r.at): r for r in merkle.proofs(told, told.leaves).collect()}
    assert all(whole[(r.tree, r.at)].proof == r.proof and r.found == r.leaf for r in got)


def test_equal_rows_share_records(spark):
    told = merkle.build(spark.createDataFrame([(1, "s", "en", 1, "same")] * 600, DDL))
    assert told.records.count() < 10
    proved = merkle.proofs(told, told.leaves)
    assert proved.where(merkle.folded(F.col("proof"), F.col("leaf")) == told.root).count() == 600
