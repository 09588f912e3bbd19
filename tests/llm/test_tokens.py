import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from tablewright.llm import bpe, packing, wordpiece
from tablewright.llm.packing import SumOfSquares, packed
from tablewright.llm.queries import BYTE_RANKS, PIECE_MODEL, WORD_VOCABULARY

from .conftest import ODD, pairs


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(BYTE_RANKS), special_tokens={})


def test_ids_and_bytes(docs, odd, empty, reference):
    for df in (docs, odd, empty):
        ids = bpe.encode(df, BYTE_RANKS, public_tokenizers.PATTERN, long_text=1000)
        for r in bpe.decode(ids, BYTE_RANKS).collect():
            assert r.ids == reference.encode_ordinary(r.text or "")
            assert bytes(r.decoded) == (r.text or "").encode()


@pytest.mark.parametrize("text", ["a  b\n\n c 'll d's 12 34!? x", "no" * 50, " \n \n ", "café   x y\x1c z", "it 's  \t don't"] + [t for _, t in ODD if t])
def test_safe_boundaries(text, reference):
    for limit in (1, 2, 3, 7):
        assert "".join(bpe.pieces(text, limit)) == text
        assert bpe.encode_text(text, BYTE_RANKS, public_tokenizers.PATTERN, limit) == reference.encode_ordinary(text)


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        size = next((s for s in range(min(longest, len(word) - at), 0, -1) if word[at : at + s] in vocabulary), 0)
        if not size:
            return 0
        at, n = at + size, n + 1
    return n


def test_token_counts(docs, odd, empty):
    vocabulary = set(wordpiece.sentencepiece_vocabulary(PIECE_MODEL))
    longest = max(map(len, vocabulary))
    for df in (docs, odd):
        want = []
        for doc_id, text in pairs(df):
            counts = [greedy("▁" + w.decode(), vocabulary, longest) for w in (text or "").encode().split()]
            want.append((doc_id is None, doc_id or 0, len(counts), sum(max(1, c) for c in counts), counts.count(0)))
        got = [(r[0] is None, r[0] or 0, *r[1:]) for r in wordpiece.token_counts(df, PIECE_MODEL).collect()]
        assert sorted(got) == sorted(want)
    assert wordpiece.token_counts(empty, PIECE_MODEL).count() == 0


def test_automaton_follows_failure_links():
    vocabulary = {"a", "ab", "abcd", "b", "cx", "c", "x"}
    own = wordpiece.Automaton(vocabulary)
    for word in ("", "abcd", "abcx", "abc", "abab", "abz", "z", "abcabcd"):
        assert own.count(word) == greedy(word, vocabulary, 4)


def check_pieces(rows, texts, size, end=2):
    library = Tokenizer.from_file(WORD_VOCABULARY)
    library.encode_special_tokens = True
    ids = {}
    for r in rows:
        got = np.frombuffer(bytes(r.ids), "<u4")
        assert len(got) == r.length > 0
        ids.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, got))
    want = {}
    for doc_id, text in texts:
        x = [*library.encode(text or "", add_special_tokens=False).ids, end]
        want.setdefault((doc_id, len(x)), []).append(x)
    assert set(ids) == set(want)
    for k, pieces in ids.items():
        if len(want[k]) == 1:  # rows that repeat an identifier and a length can't be told apart
            pieces.sort(key=lambda p: p[0])
            assert [s for s, _ in pieces] == np.cumsum([0, *(len(p) for _, p in pieces[:-1])]).tolist()
            assert np.concatenate([p for _, p in pieces]).tolist() == want[k][0]
        else:
            assert sum(len(p) for _, p in pieces) == sum(map(len, want[k]))
    windows = {}
    for r in rows:
        windows.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in windows.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0, *(n for _, n in pieces[:-1])]).tolist()
        total = sum(n for _, n in pieces)
        assert total <= size and total & (total - 1) == 0
    return windows


def test_packing(docs, odd, empty):
    for df, size, most in ((docs, 4096, 1024), (docs.repartition(3), 256, 4), (odd, 64, 1), (odd, 4096, 1024)):
        windows = check_pieces(packed(df, WORD_VOCABULARY, 2, size=size, open_windows=most).collect(), pairs(df), size)
        assert len(windows) > 1
    assert packed(empty, WORD_VOCABULARY, 2).count() == 0


def test_sum_of_squares_takes_the_best_level():
    rng, size = np.random.default_rng(1), 16
    bins = SumOfSquares(size)
    for n in rng.integers(1, size, 300).tolist():
        levels = np.array(bins.levels)
        bins.place((0, 0, bytes(4 * n), n))
        best = None
        for h in range(size - n + 1):
            if h and not levels[h]:
                continue
            after = levels.copy()
            if h:
                after[h] -= 1
            if h + n < size:
                after[h + n] += 1
            best = min(best, (after**2).sum()) if best is not None else (after**2).sum()
        now = np.array(bins.levels)
        assert (now**2).sum() == best
        assert bins.n_open == now.sum() and not now[0] and not now[size]
        assert bins.filled == np.flatnonzero(now).tolist()


def test_words_are_learned_once(monkeypatch):
    """Runs of known words and signs ask the library for nothing; what it is asked gives what it gives for whole texts."""
    words = packing.WordTokenizer(WORD_VOCABULARY)
    signs = "".join(chr(c) for c in range(1, 0x250) if not 0xD800 <= c < 0xE000)
    odd = [" ".join(f"a{c}b {c}{c}s x{c}" for c in signs), "", " lead", "it's we'll 'tis ''s .'re", "naïve façade ǅ ß12½", "Ⱥx \x1cy", "日本 été"]
    assert list(words.ids(odd)) == words._whole(odd)
    list(words.ids(["alpha beta , ! ."]))
    asked = []
    monkeypatch.setattr(words, "_words", lambda part: asked.extend(part) or [b""] * len(part))
    known = ["alpha, beta! alpha.beta"]
    assert list(words.ids(known)) == words._whole(known) and not asked


def test_texts_are_split_together():
    """Texts of any characters, alone and among others, get the ids that the library gives."""
    words, rng = packing.WordTokenizer(WORD_VOCABULARY), np.random.default_rng(3)
    parts = [*"aZ9 '\n\t.,!s\x00\x0b\x85\xa0éßÄ²½ªµǅȺſ", "'s", "'ll", "'RE", "''", "d've", "the", "<|endoftext|>", "'"]
    texts = ["".join(rng.choice(parts, n)) for n in rng.integers(0, 12, 3000)]
    assert list(words.ids(texts)) == words._whole(texts)
    texts[::7] = [t + x for t, x in zip(texts[::7], ["日", "İ", "\x1c", "K", "ẞ", "Σ", "\U0001f600", "e\u0301"] * 60, strict=False)]
    assert list(words.ids(texts)) == words._whole(texts)
    for odd in ([], [""], ["", " ", "\n"], ["İ"], ["", "日", ""], ["'"], ["it'", "s"], ["'l", "l"]):
        assert list(words.ids(odd)) == words._whole(odd)


def test_only_words_are_remembered(monkeypatch):
    """Many runs of few words and signs do not crowd out words."""
    monkeypatch.setattr(packing, "REMEMBERED", 50)
    words = packing.WordTokenizer(WORD_VOCABULARY)
    list(words.ids(["alpha"]))
    for i in range(4):
        list(words.ids([" ".join(f"beta,{n}gamma" for n in range(100 * i, 100 * i + 100))]))
    asked = []
    monkeypatch.setattr(words, "_words", lambda part: asked.extend(part) or [b""] * len(part))
    assert list(words.ids(["alpha, beta"])) == words._whole(["alpha, beta"]) and not asked
