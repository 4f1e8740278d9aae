import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from kmerloom.operators import components
from kmerloom.operators.components import connected_components


def union_find(edges, pick):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u != v:
            a, b = root(u), root(v)
            parent[a] = b
    groups = {}
    for x in list(parent):
        groups.setdefault(root(x), []).append(x)
    return {x: pick(g) for g in groups.values() for x in g}


@pytest.mark.parametrize("held", [3, 1 << 20])
@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), max_size=25))
def test_components_equal_union_find(spark, held, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    for label, pick in (("min", min), ("max", max)):
        assert {r.id: r.label for r in connected_components(df, label, held).collect()} == union_find(edges, pick)


@pytest.mark.parametrize("held", [1, 40, 1 << 20])
def test_long_path_and_hub(spark, held):
    edges = [(i, i + 1) for i in range(64)] + [(1000, 1001 + i) for i in range(200)]
    df = spark.createDataFrame(edges, "u long, v long")
    assert {r.id: r.label for r in connected_components(df, "max", held).collect()} == union_find(edges, max)


def test_near_ids_need_no_rounds(spark, monkeypatch):
    """Chains of neighbours, as reads of a document, with edges in any task: blocks are solved whole before any round."""
    rounds, small = [], components._small_star
    monkeypatch.setattr(components, "_small_star", lambda e: rounds.append(1) or small(e))
    edges = [(i, i + 1) for i in range(3000) if i % 100]
    random.Random(1).shuffle(edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(8)
    for label, pick in (("min", min), ("max", max)):
        assert {r.id: r.label for r in connected_components(df, label).collect()} == union_find(edges, pick)
    assert not rounds


@pytest.mark.parametrize("held", [64, 300])
def test_blocks_and_what_lies_between(spark, held):
    rng = random.Random(held)
    edges = [(i, i + 1) for i in range(-600, 600) if rng.random() < 0.9] + [(rng.randrange(-600, 600), rng.randrange(-(10**12), 10**12)) for _ in range(40)]
    edges += [(rng.randrange(-600, 600), rng.randrange(-600, 600)) for _ in range(20)] + [(7, 7), (10**13, 10**13)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    for label, pick in (("min", min), ("max", max)):
        found = connected_components(df, label, held).collect()
        assert len(found) == len({r.id for r in found}) and {r.id: r.label for r in found} == union_find(edges, pick)
