import random
from collections import Counter

import numpy as np
import pyarrow as pa

from kmerloom.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id string"
ITEMS = "item_id long, text string, doc_id string"


def brute_similarity(window, item, k=5):
    grams = lambda w: Counter(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else Counter()
    a, b = grams(window), grams(item)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 0.0


def brute(docs, items, least=0.8):
    found = set()
    for i, text in docs:
        w = d.words_of(text)
        for j, item in items:
            v = d.words_of(item)
            if w and v:
                n = min(len(w), max(len(v), 5) if len(w) >= 5 else len(w))
                best = max(brute_similarity(w[s : s + n], v) for s in range(len(w) - n + 1))
                if best >= least:
                    found.add((i, j, round(best, 6)))
    return found


def test_matches_equal_brute_force(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(400)}"
    items = [(j, " ".join(word() for _ in range(rng.randrange(8, 60)))) for j in range(25)] + [(90, None), (91, " ."), (92, "tiny Item"), (93, "a b a b a b a b a b")]
    docs = [(0, None), (1, ""), (2, "!!"), (3, "tiny item"), (4, "say a b, a b a b A b a b again"), (5, "a a a a a " * 2000)]
    for i in range(6, 140):
        before, after = ([word() for _ in range(rng.randrange(0, 80))] for _ in range(2))
        passage = items[rng.randrange(25)][1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(passage))
            passage[at : at + 1] = rng.choice([[], ["new"], [passage[at].upper() + ","], [passage[at], "more"]])
        docs.append((i, " ".join(before + passage * (i % 3 > 0) + after)))
    got = d.benchmark_matches(spark.createDataFrame([(*x, "q") for x in docs], SCHEMA), spark.createDataFrame([(*x, "q") for x in items], ITEMS)).collect()
    assert {(r.doc_id, r.item_id, round(r.similarity, 6)) for r in got} == brute(docs, items)
    hit = {r.doc_id for r in got}
    kept = d.drop_contaminated(spark.createDataFrame([(*x, "q") for x in docs], SCHEMA), spark.createDataFrame([(*x, "q") for x in items], ITEMS))
    assert kept.columns == ["doc_id", "text", "item_id"]
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - hit


def test_multi_index_finds_all_within_radius():
    rng = np.random.default_rng(8)
    base = rng.integers(0, 256, (60, d.BLOCKS)).astype(np.uint8)
    base[50:] = base[:10] ^ rng.choice([0, 0, 0, 1, 16], (10, d.BLOCKS)).astype(np.uint8)
    index = d.MultiIndex(base)
    for f in base:
        for flips in (0, 5, 40, d.RADIUS - 1, d.RADIUS, d.RADIUS + 1):
            for packed in (False, True):  # the bits anywhere, or as many blocks as possible with three
                at = rng.permutation(256)[:flips] if not packed else (8 * rng.permutation(32)[:, None] + np.arange(3)).ravel()[:flips]
                g = f ^ np.packbits(np.isin(np.arange(256), at), bitorder="little")
                assert index.search(g) == np.flatnonzero(np.bitwise_count(base ^ g).sum(axis=1) <= d.RADIUS).tolist()


def test_multi_index_selects():
    rng = np.random.default_rng(9)
    index = d.MultiIndex(rng.integers(0, 256, (20_000, d.BLOCKS)).astype(np.uint8))
    share = np.mean([len(index.candidates(f)) / 20_000 for f in rng.integers(0, 256, (20, d.BLOCKS)).astype(np.uint8)])
    assert 0 < share < 0.01


def test_memory_of_a_block_of_items():
    import tracemalloc

    rng = random.Random(10)
    words = [f"w{i}" for i in range(50_000)]
    items = [(j, " ".join(rng.choices(words, k=rng.randrange(20, 400)))) for j in range(2000)]
    size = sum(len(t) for _, t in items)
    tracemalloc.start()
    held = d.Items(items, 5)
    now, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held.hits(d.shingle_codes(d.words_of(items[5][1]), 5)).tolist()
    assert now < 8 * size and peak < 16 * size


def test_long_document_with_scattered_passages(spark):
    rng = random.Random(11)
    items = [(j, " ".join(f"w{rng.randrange(300)}" for _ in range(30 + j))) for j in range(6)]
    text = " ".join(x for _ in range(12) for x in (" ".join(f"v{rng.randrange(9000)}" for _ in range(2500)), items[rng.randrange(6)][1]))
    got = d.benchmark_matches(spark.createDataFrame([(1, text, "q")], SCHEMA), spark.createDataFrame([(*x, "q") for x in items], ITEMS)).collect()
    assert {(r.item_id, r.similarity) for r in got} == {(j, 1.0) for j, t in items if t in text}
    assert all(" ".join(text.split()[r.start : r.start + r.n_words]) == dict(items)[r.item_id] for r in got)


def test_passes_over_large_benchmarks(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"intro text {i} " + "the very same passage of ten words or so is " * 2, "q") for i in range(3)] + [(None, "nothing", "q")], SCHEMA)
    items = spark.createDataFrame([(j, f"other item number {j} with words", "q") for j in range(30)] + [(99, "the very same passage of ten words or so is", "q")] * 2, ITEMS)
    monkeypatch.setattr(d, "ITEM_BYTES", 300)
    monkeypatch.setattr(d, "TABLE_BITS", 14)
    assert sorted((r.doc_id, r.item_id) for r in d.benchmark_matches(docs, items).collect()) == [(0, 99), (1, 99), (2, 99)]
    out = d.drop_contaminated(docs.selectExpr("*", "1 AS own", "2 AS sig").union(docs.limit(0).selectExpr("*", "1", "2")), items)
    assert out.columns == ["doc_id", "text", "item_id", "own", "sig"]
    assert [tuple(r) for r in out.collect()] == [(None, "nothing", "q", 1, 2)]


def test_table_of_shingles_loses_no_document(spark):
    rng = random.Random(12)
    items = [(j, " ".join(f"w{rng.randrange(200)}" for _ in range(12))) for j in range(30)]
    docs = [(i, " ".join(f"w{rng.randrange(200)}" for _ in range(20)) + " " + items[i % 30][1] * (i % 2)) for i in range(60)] + [(60, ""), (61, "one")]
    table = d._shingle_table(spark.createDataFrame(items, "item_id long, text string"), 5)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in docs], "text": [t for _, t in docs]})
    kept = {i for b in d._touching(table, 5)(iter([batch])) for i in b.column("doc_id").to_pylist()}
    assert {i for i in range(60) if i % 2} <= kept and len(kept) < 40


def test_null_ids_and_copies_of_an_item(spark, monkeypatch):
    passage = "the very same passage of ten words or so is here"
    docs = spark.createDataFrame([(None, passage, "q"), (1, f"some words before {passage}", "q"), (2, "nothing of it", "q")], SCHEMA)
    items = spark.createDataFrame([(None, passage, "q"), (None, passage, "q"), *((j, passage, "q") for j in range(40))], ITEMS)
    expected = {(i, j) for i in (None, 1) for j in (None, *range(40))}
    assert {(r.doc_id, r.item_id) for r in d.benchmark_matches(docs, items).collect()} == expected
    assert [r.doc_id for r in d.drop_contaminated(docs, items).collect()] == [2]
    monkeypatch.setattr(d, "ITEM_BYTES", 1000)
    known, passes = d._items(items)
    assert max(len(d._block(known, i, passes)) for i in range(passes)) < 41  # copies of a text are dealt over the blocks
    got = d.benchmark_matches(docs, items).collect()
    assert len(got) == len(expected) and {(r.doc_id, r.item_id) for r in got} == expected


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, "a b c d e f", "q")], SCHEMA), spark.createDataFrame([(1, "a b c d e f", "q")], ITEMS)
    assert d.benchmark_matches(docs.limit(0), items).count() == 0
    assert d.benchmark_matches(docs, items.limit(0)).count() == 0
    assert d.drop_contaminated(docs, items.limit(0)).count() == 1
