import hashlib
import re
from collections import Counter, defaultdict

from tablewright.llm.exact import exact_duplicates
from tablewright.llm.trie import RadixTrie

from .conftest import pairs


def brute(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0d]", "", text or "")].append((-len(text or ""), doc_id is None, doc_id or 0))
    out = Counter()
    for same, members in groups.items():
        best = min(members)
        keep = None if best[1] else best[2]
        for i, (_, none, doc_id) in enumerate(sorted(members)):
            out[(None if none else doc_id, keep, len(members), i == 0, hashlib.sha256(same.encode()).hexdigest())] += 1
    return out


def found(df):
    return Counter(map(tuple, df.collect()))


def test_equals_brute_force(docs, odd, empty):
    assert found(exact_duplicates(docs)) == brute(pairs(docs))
    assert found(exact_duplicates(odd)) == brute(pairs(odd))
    assert exact_duplicates(empty).count() == 0


def test_spilling_changes_nothing(docs, odd):
    assert found(exact_duplicates(docs.repartition(5), trie_bytes=2000)) == brute(pairs(docs))
    assert found(exact_duplicates(odd, trie_bytes=1)) == brute(pairs(odd))


def test_trie_splits_labels_and_spills_subtrees():
    trie, words = RadixTrie(), [b"", b"a", b"abc", b"abd", b"ab", b"xyz", b"x", b"abc"]
    for w in words:
        trie.terminal(w, list).append(w)
    spilled = dict(trie.spill(trie.bytes - 1))
    assert set(spilled) in ({b"a", b"abc", b"abd", b"ab"}, {b"xyz", b"x"})
    rest = dict(trie.drain())
    assert {**spilled, **rest} == {w: [w] * words.count(w) for w in set(words)}
    assert trie.bytes == 0
