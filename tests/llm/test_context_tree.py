import math
from collections import Counter, defaultdict

import numpy as np
import pytest

from tablewright.llm import ctw

from .conftest import pairs


def log_kt(zero, one):
    return math.lgamma(zero + 0.5) + math.lgamma(one + 0.5) - math.lgamma(zero + one + 1) - math.log(math.pi)


class Brute:
    """The same tree, written as a recursion over the training bytes."""

    def __init__(self, texts, depth, least):
        self.depth, self.data = depth, []
        for t in texts:
            padded = b"\0" * depth + t
            self.data += [(padded[i - depth : i], padded[i]) for i in range(depth, len(padded))]
        seen = Counter(c[depth - d :] for c, _ in self.data for d in range(depth + 1))
        self.kept = {c for c, n in seen.items() if n >= least}

    def leaf(self, context):
        d = 0
        while d < self.depth and context[self.depth - d - 1 :] in self.kept:
            d += 1
        return context[self.depth - d :], d < self.depth

    def probability(self, context, bits):
        """Of a next 1 after the byte's first bits."""
        path = [c for d in range(self.depth + 1) if (c := context[self.depth - d :]) in self.kept or d == 0]
        symbols = defaultdict(lambda: [0, 0])
        rest = defaultdict(lambda: [0, 0])
        for c, s in self.data:
            b = f"{s:08b}"
            if b.startswith(bits):
                bit = int(b[len(bits)])
                deepest, short = self.leaf(c)
                for d in range(len(deepest) + 1):
                    symbols[deepest[len(deepest) - d :]][bit] += 1
                if short:
                    rest[deepest][bit] += 1
        kids = defaultdict(set)
        for c in self.kept:
            if c:
                kids[c[1:]].add(c)

        def weighted(c):
            own = log_kt(*symbols[c])
            if len(c) == self.depth:
                return own
            return np.logaddexp(own, below(c)) - math.log(2)

        def below(c):
            return sum(weighted(k) for k in kids[c]) + log_kt(*rest[c])

        deepest, short = self.leaf(context)
        zero, one = (rest if short else symbols)[deepest]
        p = (one + 0.5) / (zero + one + 1)
        for c in reversed([x for x in path if len(x) < self.depth]):
            zero, one = symbols[c]
            w = 1 / (1 + math.exp(min(700, below(c) - log_kt(zero, one))))
            p = w * (one + 0.5) / (zero + one + 1) + (1 - w) * p
        return p

    def log10(self, text):
        padded, total = b"\0" * self.depth + text, 0.0
        for i in range(self.depth, len(padded)):
            bits = ""
            for bit in f"{padded[i]:08b}":
                p = self.probability(padded[i - self.depth : i], bits)
                total += math.log10(p if bit == "1" else 1 - p)
                bits += bit
        return total


@pytest.mark.parametrize("least", [1, 3])
def test_tree_equals_recursion(least):
    depth, texts = 2, [b"abracadabra\0", b"abba\0", b"cab\0"]
    brute = Brute(texts, depth, least)
    rows = Counter()
    for t in texts:
        padded = b"\0" * depth + t
        for i in range(depth, len(padded)):
            for d in range(depth + 1):
                context = padded[i - d : i]
                if context in brute.kept or d == 0:
                    rows[d, int.from_bytes(context[::-1], "little"), padded[i]] += 1
    table = np.array([(*k, n) for k, n in rows.items()]).T
    tree = ctw.weighted(*table, depth)
    for text in (b"abra\0", b"zebra\0", b"\0"):
        assert tree.scores([text])[0] == pytest.approx(brute.log10(text), rel=1e-5)


def test_leaves_are_distributions():
    tree = ctw.weighted(np.array([0, 0, 1, 1, 2]), np.array([0, 0, 97, 98, 97 + 98 * 256]), np.array([98, 97, 98, 97, 98]), np.array([5, 4, 5, 4, 5]), 2)
    assert np.allclose((10.0**tree.logs).sum(axis=1), 1, atol=1e-4)


def test_log_gamma():
    x = np.array([0.5, 1.0, 1.5, 10.5, 12345.5])
    assert np.allclose(ctw.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-10)


def test_rare_contexts_keep_their_nodes_in_a_large_corpus(spark):
    common = [f"the common text number {i % 7} is here again and again" * 40 for i in range(150)]
    rare = ["xylo quark", "xylo quartz", "qwyx xylo quark"]
    texts = [t.encode() + ctw.END for t in common + rare]
    assert sum(map(len, texts)) > 2**17 * 2  # a share of 2**-17 left out what is seen once
    rows = Counter()
    for t in texts:
        padded = b"\0" * ctw.DEPTH + t
        for i in range(ctw.DEPTH, len(padded)):
            for d in range(ctw.DEPTH + 1):
                rows[d, int.from_bytes(padded[i - d : i][::-1], "little"), padded[i]] += 1
    tree = ctw.weighted(*np.array([(*k, n) for k, n in rows.items()]).T, ctw.DEPTH)
    asked = ["xylo quark", "xylo quart", "the common xylo", "zzz \u00e9", ""]
    want = tree.scores([t.encode() + ctw.END for t in asked])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(common + rare)], "doc_id long, text string")
    held = spark.createDataFrame(list(enumerate(asked)), "doc_id long, text string")
    for few, chunk in ((1 << 20, 1 << 18), (50, 30), (0, 1)):  # the broadcast and the chunks change no score
        got = {r.doc_id: r.score for r in ctw.score(held, ctw.fit(docs, frequent_grams=few, chunk_rows=chunk)).collect()}
        assert [got[i] for i in range(len(asked))] == pytest.approx(want.tolist(), rel=1e-5)


def tokens(text):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    return [*lower.split(), None]


def test_base_equals_brute_force(docs, odd):
    for df in (docs, odd):
        rows = pairs(df)
        counts = Counter(t for _, text in rows for t in tokens(text))
        n, v = sum(counts.values()), len(counts)
        model = ctw.fit(df, token_share=0.01)  # most tokens go through the join
        want = sorted((len(tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t)), 6)) for _, t in rows)
        got = ctw.score(df, model).collect()
        assert sorted((r.n_tokens, round(r.base_score, 6)) for r in got) == want
        assert all(r.n_known == r.n_tokens and r.train_tokens == n and r.score < 0 for r in got)


def test_held_out_texts_cost_less_than_plain_bytes(docs):
    held = docs.where("doc_id % 4 = 0")
    got = ctw.score(held, ctw.fit(docs.where("doc_id % 4 <> 0"))).where("n_tokens > 50").select("bits_per_byte", "n_known", "n_tokens").collect()
    assert sum(r.bits_per_byte for r in got) / len(got) < 4
    assert any(r.n_known < r.n_tokens for r in got)


def test_nothing_to_learn_from(empty, odd):
    model = ctw.fit(empty)
    got = ctw.score(odd, model).collect()
    assert len(got) == odd.count() and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert all(r.bits_per_byte == pytest.approx(8, rel=1e-4) for r in got)
    assert ctw.score(empty, model).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 70_000])
def test_places_of_numbers(n):
    """Every number has its place, others none; numbers that meet in a slot are told apart."""
    rng = np.random.default_rng(n)
    keys = np.unique(np.r_[rng.integers(-(2**63), 2**63 - 1, n), np.arange(min(n, 3))])[:n].astype(np.int64)
    rng.shuffle(keys)
    places = ctw.Places(keys)
    assert places.find(keys).tolist() == list(range(len(keys)))
    other = np.setdiff1d(rng.integers(-(2**40), 2**40, 5000), keys)
    assert (places.find(other) == len(keys)).all() and len(places.find(other[:0])) == 0


def test_counting_takes_texts_in_any_order_of_parts(spark, monkeypatch):
    """Keys are the byte and those before it, nearest lowest; counts of parts that are merged are exact."""
    texts = [b"ab\0", b"\0", b"abab\0"]
    keys = ctw._keys(texts, 2).tolist()
    padded = [b"\0\0" + t for t in texts]
    assert keys == [int.from_bytes(t[i - 2 : i + 1], "big") for t in padded for i in range(2, len(t))]
