"""Connected components as a fixpoint of star contractions over local forests.

Ids that are near one another, as those of neighbouring reads, are mostly linked. So edges inside a block of ids are dealt
by block first, each block is solved whole in one task and shrinks to one vertex per component, and only edges between
such vertices go through the rounds.

Before anything is shuffled, every task reduces its own edges to the stars of a spanning forest with an array union-find
of bounded size: edges that its other edges imply never leave it. A round is then two joins with map-side combined
aggregates, and the forests of its own tasks again. A hub vertex is a skewed join key, never a collected group, so
adaptive execution can split it. Edges shrink to stars, one per component, in O(log n) rounds; the same steps run at
every size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.arrow import map_arrow
from kmerloom.storage import discard, materialize

#: Edges that a task holds at once, 16 bytes each. A forest that fills more than half of them is passed on.
HELD = 1 << 20


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("p")).select("p.u", "p.v")
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(e: DataFrame) -> DataFrame:
    low = e.groupBy("u").agg(F.min("v").alias("m"))
    pair = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m")))
    return e.join(low, "u").select(pair.alias("p")).select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct()


def lowest_reachable(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices of edges (u, v) and the least vertex that each reaches."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    low = np.arange(len(ids))
    while len(a):
        x, y = low[a], low[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while (low[low] != low).any():
            low = low[low]
    return ids, ids[low]


def _local_stars(held: int):
    def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, low = lowest_reachable(u, v)
        return ids[ids != low], low[ids != low]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            size += batch.num_rows
            if size >= held:
                parts = [stars(*map(np.concatenate, zip(*parts)))]
                size = len(parts[0][0])
                if 2 * size >= held:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, parts[0])], names=["u", "v"])
                    parts, size = [], 0
        if size:
            yield pa.RecordBatch.from_arrays([*map(pa.array, stars(*map(np.concatenate, zip(*parts))))], names=["u", "v"])

    return run


def local_stars(edges: DataFrame, held: int = HELD) -> DataFrame:
    """(u, v), v < u: of every task's edges the stars of a spanning forest, from each vertex to the least it reaches there.

    A task holds ``held`` edges; of more, forests of parts. No row is shuffled."""
    return map_arrow(edges.select("u", "v"), _local_stars(held), "u long, v long")


def _is_star_forest(e: DataFrame) -> bool:
    ends = e.select(F.explode(F.array(F.struct(F.col("u").alias("id"), F.lit(1).alias("leaf"), F.lit(0).alias("root")), F.struct(F.col("v").alias("id"), F.lit(0).alias("leaf"), F.lit(1).alias("root")))).alias("p")).select("p.*")
    return ends.groupBy("id").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root")).where("leaf > 1 OR leaf = 1 AND root = 1").isEmpty()


def _solved_blocks(bits: int, held: int):
    """Edges inside blocks of 2**bits ids, sorted by block -> (id, root): of all that have one, the least id that they reach.

    A block's forest has fewer edges than ids, so what is held after a reduction is of the last, unfinished block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        rows = lambda u, v: pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["id", "root"])
        for batch in batches:
            parts.append(tuple(batch.column(c).to_numpy(zero_copy_only=False) for c in ("u", "v")))
            size += batch.num_rows
            if size >= held:
                last = parts[-1][0][-1] >> bits
                ids, low = lowest_reachable(*map(np.concatenate, zip(*parts)))
                ids, low = ids[ids != low], low[ids != low]
                done = ids >> bits != last
                yield rows(ids[done], low[done])
                parts = [(ids[~done], low[~done])]
                size = len(parts[0][0])
        if size:
            ids, low = lowest_reachable(*map(np.concatenate, zip(*parts)))
            yield rows(ids[ids != low], low[ids != low])

    return run


def _block_roots(near: DataFrame, bits: int, held: int) -> DataFrame:
    """(id, root) by edges inside blocks; every task's forest of its edges is taken before they are dealt."""
    block = F.shiftright("u", bits)
    dealt = local_stars(near, held).repartition(F.xxhash64(block)).sortWithinPartitions(block)
    return map_arrow(dealt, _solved_blocks(bits, held), "id long, root long")


def _contracted(far: DataFrame, roots: DataFrame) -> DataFrame:
    for end in ("u", "v"):
        far = far.join(roots.select(F.col("id").alias(end), F.col("root").alias("root_" + end)), end, "left").withColumn(end, F.coalesce("root_" + end, end)).drop("root_" + end)
    return far.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _fixpoint(edges: DataFrame, held: int) -> DataFrame:
    """(u, v), stored: stars, one per component."""
    e = materialize(local_stars(edges, held), "edges")
    while not _is_star_forest(e):
        step = materialize(local_stars(_small_star(_large_star(e)), held), "edges")
        discard(e)
        e = step
    return e


def connected_components(edges: DataFrame, label: str = "min", held: int = HELD) -> DataFrame:
    """(id, label) of every vertex that has an edge; label is the smallest or the largest id of its component.

    ``edges`` has the columns u and v (long, no nulls; repeats, both directions and self loops are allowed; a vertex
    with self loops only is not returned). Empty edges give an empty result. ``held`` is the number of edges that a task
    holds at once; a block has half as many ids at most.
    """
    sign, bits = F.lit(-1 if label == "max" else 1), max(0, (held // 2).bit_length() - 1)
    e = materialize(edges.select((F.col("u") * sign).alias("u"), (F.col("v") * sign).alias("v")).where("u <> v"), "links")
    same = F.shiftright("u", bits) == F.shiftright("v", bits)
    roots = materialize(_block_roots(e.where(same), bits, held), "roots")
    stars = _fixpoint(_contracted(e.where(~same), roots), held)
    discard(e)
    ends = stars.select(F.col("v").alias("id")).distinct()
    top = stars.select(F.col("u").alias("id"), F.col("v").alias("label")).union(ends.select("id", F.col("id").alias("label")))
    alone = roots.select(F.col("root").alias("id")).distinct().join(top, "id", "left_anti")
    below = roots.join(stars.select(F.col("u").alias("root"), "v"), "root", "left").select("id", F.coalesce("v", "root").alias("label"))
    out = below.union(top).union(alone.select("id", F.col("id").alias("label")))
    return out.select((F.col("id") * sign).alias("id"), (F.col("label") * sign).alias("label"))
