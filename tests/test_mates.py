"""The mate merge in rounds against a serial replay of the pairs."""

import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest

from kmerloom.operators import mates
from kmerloom.operators.components import connected_components
from kmerloom.plans import queries


def replay(size, edges, cap):
    """size: dict of components, edges (pair, a, b) -> component of each, named by the largest."""
    parent, size, name = {c: c for c in size}, dict(size), {c: c for c in size}

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for _, a, b in sorted(edges):
        x, y = root(a), root(b)
        if x != y and min(size[x], size[y]) <= cap:
            if size[x] < size[y]:
                x, y = y, x
            parent[y] = x
            size[x] += size[y]
            name[x] = max(name[x], name[y])
    return {c: name[root(c)] for c in parent}


def graph(seed, first):
    rng = random.Random(seed)
    k = rng.randrange(2, 30)
    size = {first + i: rng.choice([1, 1, 2, 3, rng.randrange(1, 15)]) for i in range(k)}
    if seed % 4 == 0:  # a path, in order
        found = [(i, first + i, first + i + 1) for i in range(k - 1)]
    else:
        found = [(p, first + rng.randrange(k), first + rng.randrange(k)) for p in range(rng.randrange(1, 60))]
    return size, [(10_000 * seed + p, max(a, b), min(a, b)) for p, a, b in found if a != b]


@pytest.mark.parametrize("cap", [1, 2, 4, 10])
def test_thousand_random_graphs(spark, cap):
    """250 graphs for each of four caps."""
    size, edges = {}, []
    for i in range(250):
        own, found = graph(1000 * cap + i, 100 * i)
        size |= own
        edges += found
    first = {}
    for p, a, b in sorted(edges):
        first.setdefault((a, b), p)
    rows = pd.DataFrame([(a, size[a], b, size[b], p) for (a, b), p in first.items()], columns=["a", "na", "b", "nb", "pair"])
    joined = connected_components(mates.accepted_joins(spark.createDataFrame(rows), cap), "max")
    assert {c: c for c in size} | {r.id: r.label for r in joined.collect()} == replay(size, edges, cap)


@pytest.mark.parametrize("ordered", [False, True])
def test_one_cluster_of_many_small_components(spark, ordered):
    """200,000 components of two reads that mates connect, in random order and along a path; a cap of 50 binds."""
    n, g = 200_000, np.random.default_rng(5)
    comp = np.repeat(2 * np.arange(n) + 1, 2)
    labels = pd.DataFrame({"read_id": np.arange(2 * n), "comp_id": comp})
    pairs = pd.DataFrame({"a": 2 * np.arange(n - 1) + 1, "b": 2 * np.arange(n - 1) + 2}) if ordered else pd.DataFrame(np.sort(g.permutation(2 * n).reshape(-1, 2), axis=1), columns=["a", "b"])
    got = mates.merge_mates(spark.createDataFrame(labels), spark.createDataFrame(pairs), 50).toPandas().sort_values("read_id")
    want = replay(dict.fromkeys(comp.tolist(), 2), [(a, int(comp[a]), int(comp[b])) for a, b in pairs.itertuples(index=False)], 50)
    assert got["comp_id"].tolist() == [want[c] for c in comp.tolist()]


def test_no_edges(spark):
    assert mates.accepted_joins(spark.createDataFrame([], "a long, na long, b long, nb long, pair long"), 3).count() == 0


def test_registered_query_with_a_binding_cap(spark):
    """The query over sf0.001 against the replay of all its pairs; the cap matters."""
    rows = queries.reads(spark, "/root/testdata/sf0.001", paired=True)
    own = {r.read_id: r.comp_id for r in queries.labels(rows)[1].collect()}
    got = {r.read_id: r.comp_id for r in queries.QUERIES["mate_merged_components_small_cap"](spark, "/root/testdata/sf0.001").collect()}
    edges = [(r.a, own[r.a], own[r.b]) for r in mates.mate_pairs(rows).collect() if own[r.a] != own[r.b]]
    size = Counter(own.values())
    found = {cap: replay(size, edges, cap) for cap in (queries.SMALL_CAP, 10**9)}
    assert got == {r: found[queries.SMALL_CAP][c] for r, c in own.items()}
    assert found[queries.SMALL_CAP] != found[10**9]


@pytest.mark.parametrize("copies", [1000, 1001])
def test_registered_query_at_its_cap(spark, tmp_path, copies):
    """Equal texts of two fragments that share no k-mer: two components of a read per text, which their mates unite while
    one of them has no more reads than the cap, 1000."""
    rng = random.Random(1)
    letters = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for n in (80, 39)]
    pd.DataFrame({"doc_id": range(copies), "text": ["ж".join(letters)] * copies}).to_parquet(tmp_path / "documents.parquet")
    got = queries.QUERIES["mate_merged_components"](spark, str(tmp_path)).toPandas()
    last = 2 * copies - 1
    assert got.groupby("comp_id").size().to_dict() == ({last: 2 * copies} if copies <= queries.CAP else {last: copies, last - 1: copies})
