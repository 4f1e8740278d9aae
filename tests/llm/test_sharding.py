import random
import zlib
from collections import defaultdict

import numpy as np

from kmerloom.llm import sharding

SCHEMA = "doc_id long, text string, size string"


def check(rows, out, shards):
    assert len(out) == len(rows)
    text = {i: t or "" for i, t, _ in rows}
    home, slots, sizes = defaultdict(set), defaultdict(list), [0] * shards
    for r in out:
        t = text[r.doc_id].encode()
        assert r.size == len(t) + 16 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes" and r.grown_shard is None
        home[t].add(r.shard)
        slots[r.shard].append(r.slot)
        sizes[r.shard] += r.size
    assert all(len(s) == 1 for s in home.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return sizes


def test_shards_balance_bytes(spark):
    rng = random.Random(1)
    rows = [(0, None, "x"), (1, "", "x")] + [(i, "é" * rng.randrange(1, 900) + str(i % 700), "x") for i in range(2, 1200)]
    df = spark.createDataFrame(rows, SCHEMA)
    for bucket, fan_in, run in ((20_000, 256, 100_000), (50, 3, 4)):
        sizes = check(rows, sharding.shard(df, 8, bucket=bucket, fan_in=fan_in, run_rows=run).collect(), 8)
        assert max(sizes) - min(sizes) < 0.01 * sum(sizes) / 8


def test_hot_group_stays_whole(spark):
    rows = [(i, "copy " * 50 if i % 3 == 0 else f"own text {i}" * 9, "x") for i in range(600)]
    check(rows, sharding.shard(spark.createDataFrame(rows, SCHEMA), 5).collect(), 5)


def test_null_ids_repeats_and_empty(spark):
    df = spark.createDataFrame([(None, "a", "x"), (3, "b", "x"), (3, "b", "x")], SCHEMA)
    out = sharding.shard(df, 2).collect()
    assert len(out) == 3 and len({(r.shard, r.slot) for r in out}) == 3
    assert sharding.shard(spark.createDataFrame([], SCHEMA)).count() == 0


def brute_differencing(parts):
    """Karmarkar-Karp on sorted lists of (sum, members), the two of largest spread first (the earlier of equals)."""
    k = len(parts[0])
    todo = [(sorted(((s, [(i, c)]) for c, s in enumerate(p)), key=lambda x: -x[0]), i) for i, p in enumerate(parts)]
    at = len(todo)
    while len(todo) > 1:
        todo.sort(key=lambda x: (x[0][-1][0] - x[0][0][0], x[1]))
        (a, _), (b, _), *todo = todo
        merged = [(a[j][0] + b[k - 1 - j][0], a[j][1] + b[k - 1 - j][1]) for j in range(k)]
        todo.append((sorted(merged, key=lambda x: -x[0]), at))
        at += 1
    return {cell: j for j, (_, members) in enumerate(todo[0][0]) for cell in members}


def test_differencing_equals_plain_karmarkar_karp():
    rng = np.random.default_rng(3)
    for n, k, full in ((1, 3, False), (9, 2, False), (30, 3, False), (40, 5, True), (25, 8, True)):
        parts = rng.integers(1, 1000, (n, k))
        if not full:
            parts[:, 1:] = 0
        parts[: n // 3] = parts[0]  # ties
        got, want = sharding.difference(parts), brute_differencing(parts.tolist())
        assert all(got[i, c] == want[i, c] for i in range(n) for c in range(k) if parts[i, c])


def test_differencing_on_a_known_case():
    # 8 7 6 5 4 into two: differencing leaves a difference of two
    parts = np.array([[8, 0], [7, 0], [6, 0], [5, 0], [4, 0]])
    to = sharding.difference(parts)[:, 0]
    sums = np.bincount(to, [8, 7, 6, 5, 4], 2)
    assert sorted(sums.tolist()) == [14, 16]
