import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from kmerloom.llm import simhash
from kmerloom.operators.components import lowest_reachable

SCHEMA = "doc_id long, text string, extra string"


def brute_fingerprint(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, k=3, radius=2):
    fps = [brute_fingerprint(t, k) for _, t in rows]
    label = [i for i, _ in rows]
    while True:
        new = [min(label[j] for j in range(len(rows)) if (fps[i] ^ fps[j]).bit_count() <= radius) for i in range(len(rows))]
        if new == label:
            return sorted((i, format(f, "016x"), c) for (i, _), f, c in zip(rows, fps, label))
        label = new


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma,", "Über", "δ", "the", "of", "x"]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "x" * 5000)]
    for i in range(7, n):
        if i % 3 and i > 12:
            base = list(rows[rng.randrange(7, len(rows))][1])
            at = rng.randrange(len(base))
            rows.append((i, "".join(base[:at] + list(rng.choice(["", "Z", " of"])) + base[at:])))
        else:
            rows.append((i, " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(rng.randrange(1, 400)))))
    return rows


def test_components_equal_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame([(*r, "e") for r in rows], SCHEMA)
        got = sorted(tuple(r) for r in simhash.simhash_components(df).collect())
        assert got == brute_components(rows)


def test_grid_loses_no_pair_within_two_bits(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, (1 << 64) - 1]
    fps = set(base)
    for f in base:
        for _ in range(6):
            g = f
            for _ in range(rng.randrange(1, 4)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = simhash.grid_edges(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()
    parent = {f: f for f in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    mask = (1 << 64) - 1
    for u, v in edges:
        assert ((u & mask) ^ (v & mask)).bit_count() <= 2
        parent[root(u)] = root(v)
    for i, f in enumerate(signed):
        for g in signed[:i]:
            if ((f & mask) ^ (g & mask)).bit_count() <= 2:
                assert root(f) == root(g)


def test_popcount_vector(spark):
    values = [0, -1, 1, -(1 << 63), 0x0123456789ABCDEF, 0x7777_0000_F0F0_1248]
    got = spark.createDataFrame([(v,) for v in values], "fp long").select(simhash.segment_popcounts(F.col("fp")).alias("c")).collect()
    for v, r in zip(values, got):
        v &= (1 << 64) - 1
        assert r.c == sum((v >> 4 * i & 15).bit_count() << 4 * i for i in range(16))


def test_forest_of_a_large_cell():
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.integers(0, 1 << 63, (30, 8), dtype=np.uint64), 20, axis=0)
    bits[:, 0] ^= np.uint64(1) << rng.integers(0, 64, len(bits), dtype=np.uint64)
    edges = simhash._forest(bits, 2)
    assert len(edges) == 600 - 30
    assert all(np.bitwise_count(bits[a] ^ bits[b]).sum() <= 2 for a, b in edges)


def test_large_cell_is_cut_by_blocks(monkeypatch):
    """The components of all pairs within the radius, in a cell beyond the bound."""
    rng = np.random.default_rng(6)
    bits = np.unique(np.repeat(rng.integers(0, 1 << 63, 150, dtype=np.uint64), 20) ^ (np.uint64(1) << rng.integers(0, 64, 3000, dtype=np.uint64)))[:, None]
    bits[::7] ^= np.uint64(1) << rng.integers(0, 64, len(bits[::7]), dtype=np.uint64)[:, None]
    assert len(bits) > simhash.CELL
    for radius in (0, 1, 2):
        near = np.bitwise_count(bits[:, 0][:, None] ^ bits[:, 0]) <= radius
        want, got = (lowest_reachable(*np.array(x, np.int64).reshape(-1, 2).T) for x in (np.argwhere(near & ~np.eye(len(bits), dtype=bool)), simhash._cell_forest(bits, radius)))
        assert all((x == y).all() for x, y in zip(want, got)) and len(got[0]) > (0 if radius else -1)


def test_clashing_names(spark):
    names = ["own", "OTHER_ID", "sig", "n", "node", "cells", "__own", "__id", "__sig", "a.b", "x`y"]
    rows = [(i, f"the same words for all of {i % 2}", *range(len(names))) for i in range(4)] + [(0, "the same words for all of 0", *range(len(names)))]
    df = spark.createDataFrame(rows, ["doc_id", "text", *names])
    out = simhash.drop_near_duplicates(df, similarity=0.99)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == rows[:2]


def test_empty_table_and_null_ids(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.simhash_components(df).count() == 0
    assert simhash.drop_near_duplicates(df).count() == 0
    df = spark.createDataFrame([(None, "a b c", "x"), (7, "a b c", "y"), (None, "d e f", "z")], SCHEMA)
    got = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert got == {(None, 7), (7, 7), (None, None)}


def test_links_are_exact(spark):
    rng = random.Random(12)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        for edits in (0, 1, 2, 3, 5, 8, 13):
            copy = list(words)
            for at in rng.sample(range(len(copy)), min(edits, len(copy) // 2)):
                copy[at] = f"e{rng.randrange(5000)}"
            rows.append((len(rows), " ".join(copy), "e"))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for _, t, _ in rows)]
    label = list(range(len(rows)))
    while True:
        new = [min(label[j] for j in range(len(rows)) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in range(len(rows))]
        if new == label:
            break
        label = new
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    keeper = {r.component: r.doc_id for r in got if r.keeper}
    assert {r.doc_id: keeper[r.component] for r in got} == dict(enumerate(label))


def test_near_duplicates_keep_one_of_each_group(spark):
    rng = random.Random(9)
    rows, group = [], {}
    for g in range(60):
        words = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(60, 400))]
        for c in range(1 + g % 4):
            copy = list(words)
            if c:
                for _ in range(len(words) // 100):
                    copy[rng.randrange(len(copy))] = "edited"
            i = len(rows)
            rows.append((i, " ".join(copy), "e"))
            group[i] = g
    rows += [(900, None, "n"), (901, "", "n"), (905, "same row", "n"), (905, "same row", "n")]
    out = simhash.drop_near_duplicates(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "extra"]
    kept = [r.doc_id for r in out.collect()]
    assert sorted(group[i] for i in kept if i < 900) == list(range(60))
    assert sorted(i for i in kept if i >= 900) == [900, 905]


def shared_passage(n, pairs, changed, seed):
    """n documents of one 204-word passage and 30 words of their own (Jaccard 0.77); of ``pairs`` of them also an edited
    copy, with the last ``changed`` words replaced."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**6)}"
    passage = [word() for _ in range(204)]
    texts = [passage + [word() for _ in range(30)] for _ in range(n)]
    texts += [t[:-changed] + [word() for _ in range(changed)] for t in texts[:pairs]]
    return [(i, " ".join(t), "e") for i, t in enumerate(texts)]


def lowest(spark, rows):
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    keeper = {r.component: r.doc_id for r in got if r.keeper}
    return {r.doc_id: keeper[r.component] for r in got}


def test_pairs_among_documents_that_share_a_passage(spark):
    """Jaccard 0.8 or more beside hundreds of neighbours just below it."""
    assert lowest(spark, shared_passage(600, 80, 20, 13)) == {i: i - 600 if i >= 600 else i for i in range(680)}


def test_hot_cell_of_many_small_groups(spark):
    """A cell of several blocks; the copies come last and by size, so most pairs lie in different blocks."""
    rows = shared_passage(5000, 400, 15, 14)
    assert lowest(spark, rows) == {i: i - 5000 if i >= 5000 else i for i in range(5400)}


def test_blocks_meet_every_pair_that_sizes_allow():
    rng = np.random.default_rng(15)
    sizes = np.sort(rng.integers(1, simhash.BLOCK_SHINGLES // 3, 40))
    spans, pairs = simhash._blocks(sizes, 0.8)
    met = [(i, j) for x, y in pairs for i in range(*spans[x]) for j in range(*spans[y]) if i < j]
    assert len(met) == len(set(met))
    assert {(i, j) for i in range(40) for j in range(i + 1, 40) if sizes[i] >= 0.8 * sizes[j]} <= set(met)


def test_pairs_of_short_texts(spark):
    """Eight words and one word more: four of five shingles."""
    rng = random.Random(16)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(100)]
    rows = [(i, t, "e") for i, t in enumerate(texts + [f"{t} more{i}" for i, t in enumerate(texts)])]
    assert lowest(spark, rows) == {i: i % 100 for i in range(200)}


def test_a_hot_cell_gives_every_row_once(monkeypatch):
    """However many pairs of blocks there are, a row leaves its cell's task once."""
    monkeypatch.setattr(simhash, "BLOCK_SHINGLES", 1000)
    n = 4000
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int64)), pa.array(np.arange(n)), pa.array(np.full(n, 20))], names=["cell", "node", "size"])
    rows = [r for b in simhash._cell_pairs(0.8)(iter([batch])) for r in b.to_pylist()]
    members = [r for r in rows if r["kind"] == simhash.MEMBER]
    assert sorted(r["u"] for r in members) == list(range(n))
    blocks = {r["key"] for r in members}
    tasks = [(r["u"], r["v"]) for r in rows if r["kind"] == simhash.TASK]
    assert len(blocks) == 80 and len(tasks) == len({frozenset(t) for t in tasks}) == 80 * 81 // 2
    assert len({r["key"] for r in rows if r["kind"] == simhash.TASK}) == len(tasks)


def test_share_of_similar_pairs_that_meet():
    """Pairs of a similarity of 0.80 to 0.83, the least that count: measured share that meets in a cell."""
    g, texts = np.random.default_rng(21), []
    for _ in range(1500):
        words = [f"w{x}" for x in g.integers(0, 10**6, 400)]
        other = list(words)
        for at in g.choice(400, 8, replace=False):  # eight words changed apart change up to 40 shingles of 396
            other[at] = "x" + other[at]
        texts.append((" ".join(words), " ".join(other)))
    sets = [[set(np.frombuffer(simhash.shingle_hashes(t.encode().split(), 5), ">u8").tolist()) for t in pair] for pair in texts]
    close = [i for i, (a, b) in enumerate(sets) if 0.80 <= len(a & b) / len(a | b) < 0.83]
    flat = [t for i in close for t in texts[i]]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(flat))), pa.array(range(len(flat))), pa.array(flat)], names=["doc_id", "sig", "text"])
    cells = [c for b in simhash._sketches(5)(iter([batch])) for c in b.column("cells").to_pylist()]
    met = sum(bool(set(a) & set(b)) for a, b in zip(cells[::2], cells[1::2]))
    print(f"{met} of {len(close)} pairs meet")
    assert len(close) > 300 and met >= 0.99 * len(close)
