import math
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tablewright.llm import language
from tablewright.llm.batches import fold


def test_held_out_accuracy(docs):
    held = fold("doc_id", 4) == 2
    model = language.fit(docs.where(~held))
    got = language.identify(docs.where(held & F.col("lang").isNotNull()), model).select("lang", "language.lang", "language.score").collect()
    assert sum(r[0] == r[1] for r in got) >= 0.9 * len(got) and len(got) > 20
    assert all(0 <= r[2] <= 1 for r in got)


def test_odd_texts(docs, odd, empty):
    model = language.fit(docs)
    got = language.identify(odd, model).select("text", "language.*").collect()
    assert len(got) == odd.count()
    for r in got:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang, r.score) == ("und", 0)
        else:
            assert r.lang in model.languages and 0 < r.score <= 1
    assert language.identify(empty, model).count() == 0
    nothing = language.fit(empty)
    assert {r.lang for r in language.identify(odd, nothing).select("language.lang").collect()} == {"und"}


def test_unseen_words_back_off_and_ties_go_to_the_first_name(spark):
    rows = [(1, "hello hello world world", "b"), (2, "hallo hallo welt welt", "a"), (3, None, "c"), (4, "zzz", None)]
    model = language.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.languages == ("a", "b")
    asked = spark.createDataFrame([(1, "worlds"), (2, "weltall"), (3, "日本"), (4, "HELLO")], "doc_id long, text string")
    assert {r.doc_id: r.lang for r in language.identify(asked, model).select("doc_id", "language.lang").collect()} == {1: "b", 2: "a", 3: "a", 4: "b"}


def test_sample_is_bounded(docs):
    some = language.fit(docs, sample_rows=30, least_rows=5)
    assert 0 < len(some.rows) < len(language.fit(docs).rows)


def brute(learn, asked):
    """{text: (language, score)} by the method, word by word; ``learn`` has all its rows in the sample."""
    sizes = Counter(lang for _, lang in learn)
    counts = defaultdict(Counter)
    for text, lang in learn:
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            marked = f"^{w}$"
            counts[lang][0, w] += 1
            for n in range(1, 5):
                for i in range(len(marked) - n + 1):
                    counts[lang][n, marked[i : i + n]] += 1
    counts = {lang: {g: n for g, n in own.items() if n >= 2 or sizes[lang] <= 200} for lang, own in counts.items()}
    langs = sorted(x for x, own in counts.items() if own)
    known = {g for own in counts.values() for g in own}
    many = Counter(n for n, _ in known)
    total = {(x, n): sum(v for (m, _), v in counts[x].items() if m == n) for x in langs for n in range(5)}

    def log(lang, g):
        return math.log((counts[lang].get(g, 0) + 0.5) / (total[lang, g[0]] + 0.5 * many[g[0]]))

    def word(lang, w):
        if (0, w) in known:
            return log(lang, (0, w))
        marked = f"^{w}$"
        for n in range(4, 0, -1):
            own = [(n, marked[i : i + n]) for i in range(len(marked) - n + 1) if (n, marked[i : i + n]) in known]
            if own:
                return sum(log(lang, g) for g in own) / len(own)
        return 0.0

    out = {}
    for text in asked:
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not words or not langs:
            out[text] = ("und", 0.0)
            continue
        sums = [sum(word(x, w) for w in words) for x in langs]
        best = max(sums)
        out[text] = (langs[sums.index(best)], 1 / sum(math.exp((s - best) / len(words)) for s in sums))
    return out


def test_equals_brute_force(spark, docs, odd):
    rows = [(r.text, r.lang) for r in docs.select("text", "lang").collect() if r.text is not None and r.lang is not None]
    rows += [("日本語 のテキスト", "ja"), ("seul mot", "xx"), ("123", "yy")]
    df = spark.createDataFrame([(i, t, x) for i, (t, x) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.fit(df)
    assert {"ja", "xx"} <= set(model.languages) and "yy" not in model.languages
    asked = odd.select("text").union(docs.select("text")).union(spark.createDataFrame([("日本",), ("zzzqqq xyx",)], "text string"))
    want = brute(rows, [r.text for r in asked.collect()])
    for r in language.identify(asked, model).select("text", "language.*").collect():
        lang, score = want[r.text]
        assert r.lang == lang and math.isclose(r.score, score, rel_tol=1e-4)


def test_registered_query(spark):
    from tablewright.llm import queries

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    learn = [(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.text is not None and r.lang is not None]
    want = brute(learn, [r.text for r in docs])
    texts = {r.doc_id: r.text for r in docs}
    got = queries.QUERIES["op5_language"](spark, sf).collect()
    assert len(got) == len(docs)
    near = 0
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        near += r.lang_pred == want[texts[r.doc_id]][0] and math.isclose(r.score, want[texts[r.doc_id]][1], rel_tol=1e-3)
    assert near >= len(got) - 1
