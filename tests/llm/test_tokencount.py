import math
import random
import tracemalloc

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kmerloom.llm import tokencount as t

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCORES = t.unigram_scores(PATH)
SUFFIXES = t.suffix_tree(SCORES)


def brute(word, scores):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[a][0] + scores[word[a:end]], -best[a][1] - 1) for a in range(end) if word[a:end] in scores]
        s, n = max(options)
        best[end] = (s, -n)
    return best[-1][1]


@settings(deadline=None, max_examples=80)
@given(st.sets(st.binary(max_size=14), max_size=20))
def test_trie_equals_dynamic_programming(words):
    trie = t.Trie(SUFFIXES)
    for w in sorted(words):
        assert trie.insert(w) == brute(w, SCORES)


def test_prefixes_are_computed_once(monkeypatch):
    trie, nodes = t.Trie(SUFFIXES), []
    extend = trie._extend
    monkeypatch.setattr(trie, "_extend", lambda word, score, pieces, begin, end, first: (nodes.extend(word[: i + 1] for i in range(begin, end)), extend(word, score, pieces, begin, end, first)))
    words = sorted({b" thing", b" things", b" thinking", b" th", b" other"})
    for w in words:
        trie.insert(w)
    assert sorted(nodes) == sorted({w[:i] for w in words for i in range(1, len(w) + 1)})


@pytest.mark.parametrize("longest", [1, 7, 40])
def test_words_beyond_the_held_path(monkeypatch, longest):
    monkeypatch.setattr(t, "LONGEST", longest)
    rng, trie = random.Random(longest), t.Trie(SUFFIXES)
    words = {bytes(rng.choices(b"thenadisg -=", k=rng.randrange(200))) for _ in range(60)} | {b"=" * n for n in range(0, 150, 7)} | {b" the" * 30 + bytes([x]) for x in b"abc"}
    for w in sorted(words):
        assert trie.insert(w) == brute(w, SCORES)


def test_a_long_token_in_bounded_memory():
    word = bytes(random.Random(3).choices(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=1_000_000))
    tracemalloc.start()
    t.Trie(SUFFIXES).insert(word)
    assert tracemalloc.get_traced_memory()[1] < 4 << 20
    tracemalloc.stop()


def test_counts(spark):
    rng = random.Random(1)
    rows = [(0, None, "x"), (1, "", "x"), (2, " \n", "x"), (3, "naïve\tcafé \x0bend", "x"), (4, "a" * 3000, "x"), (None, "the the", "x"), (5, "the", "x"), (5, "the", "x")]
    rows += [(i, " ".join(rng.choice(["the", "thing", "wälder", "x1", "unlikelyword"]) for _ in range(50)), "x") for i in range(6, 40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    want = sorted((i or -1, len((s or "").encode().split()), sum(brute(b" " + w, SCORES) for w in (s or "").encode().split())) for i, s, _ in rows)
    assert sorted((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in t.token_counts(df, PATH).collect()) == want
    assert t.token_counts(df.limit(0), PATH).count() == 0
    for limit in (0, 2000):  # the memory is emptied all the time
        assert sorted((r.doc_id or -1, r.n_pretokens, r.n_tokens) for r in t.token_counts(df, PATH, limit).collect()) == want


def test_memory_is_bounded_in_bytes():
    rng = random.Random(2)
    memory = t.Memory(SUFFIXES, 20_000)
    for _ in range(60):
        texts = [[rng.randbytes(rng.choice([3, 300, 1500])) for _ in range(rng.randrange(9))] for _ in range(3)]
        assert memory.count(texts) == [sum(brute(b" " + w, SCORES) for w in ws) for ws in texts]
        held = sum(len(w) + t.ENTRY for w in memory.counts)
        assert held == memory.size and all(len(w) <= t.LONGEST for w in memory.counts)
        assert held <= 20_000 + sum(len(w) + t.ENTRY for ws in texts for w in ws)
