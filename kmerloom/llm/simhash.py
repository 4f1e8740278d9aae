"""SimHash near-duplicates by a segment-popcount embedding.

A 64-bit fingerprint is mapped to 16 counts of set bits, one for each four-bit segment. The Manhattan distance of two
such vectors is at most the Hamming distance of the fingerprints, so fingerprints within two bits lie within distance
two on the integer grid. Every fingerprint is entered in its own cell and in the cells one step up or down along one
axis (33 at most): two vectors within distance two always share a cell, their own or the one midway. The range join is
thus an equi-join on cells, and inside a cell the exact Hamming distance decides.

Cells never emit all their pairs: a cell is searched breadth-first and yields the edges of a spanning forest, at most
one for each fingerprint; a large cell is searched among the rows that agree in a third of their bits, as all within two
bits do. Equal fingerprints are one node from the start, so copies cost nothing here.

For whole-document similarity (``near_duplicates``) two bits are far too near: documents that share four fifths of
their five-word shingles differ in some ten bits of 64. There cells are min-wise sketch bands of the shingle hashes, and
a 512-bit SimHash only makes copies one node. The exact Jaccard similarity of the shingle sets decides on every pair of a
cell: small cells emit their pairs, which are verified once however many cells they share; large cells are cut into
blocks, of which each row is given once, and each pair of blocks is a task that searches the exact graph breadth-first and yields a spanning forest. The
only pairs left out are those whose numbers of shingles rule the similarity out.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import column, free_names, map_arrow, raw, slices, splitmix
from kmerloom.operators.components import connected_components
from kmerloom.storage import materialize

SEED = 42
LANES = np.uint64(0x0101010101010101)
#: Sketch bands of near_duplicates: a pair at similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS.
BANDS, ROWS = 14, 4
WIDE = 8
#: Rows of a cell that emits its pairs; a larger one is cut into blocks of so many shingles (or one longer row).
PAIRED, BLOCK_SHINGLES = 48, 1 << 20
#: Rows of _cell_pairs.
PAIR, MEMBER, TASK = 0, 1, 2
#: Rows of a grid cell that is searched as it is; a larger one is cut by blocks of the fingerprint.
CELL = 2048


def shingle_hashes(words: list[bytes], k: int) -> bytes:
    """XXH64 digests (big-endian) of the k-word shingles, repeats included; fewer words make one shingle."""
    if not words:
        return b""
    if len(words) < k:
        return xxhash.xxh64_digest(b" ".join(words), SEED)
    return b"".join(map(xxhash.xxh64_digest, map(b" ".join, zip(*(words[i:] for i in range(k)))), repeat(SEED)))


def _bit_counts(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(documents, 64) counts of set bits; h holds the hashes of documents of ``sizes`` (all positive) in a row."""
    ends = np.cumsum(sizes)
    starts = ends - sizes
    segments = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts, ends)])  # a lane of eight bits holds 255
    first = np.cumsum(-(-sizes // 255)) - -(-sizes // 255)
    out = np.empty((len(sizes), 64), np.int64)
    for j in range(8):
        lanes = np.add.reduceat((h >> np.uint64(j)) & LANES, segments)
        out[:, j::8] = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8).astype(np.int64), first, axis=0)
    return out


def _majority(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    bits = 2 * _bit_counts(h, sizes) > sizes[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")[:, 0]


def _hashed(batch: pa.RecordBatch, k: int, distinct: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all documents in a row, sizes of the non-empty ones, their row numbers."""
    hashes = [np.frombuffer(shingle_hashes((t or b"").lower().split(), k), ">u8").astype("<u8") for t in raw(batch)]
    if distinct:
        hashes = [np.unique(h) for h in hashes]
    sizes = np.array([len(h) for h in hashes], np.int64)
    rows = np.flatnonzero(sizes)
    return np.concatenate(hashes), sizes[rows], rows


def _fingerprints(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, sizes, rows = _hashed(batch, k)
            fp = np.zeros(batch.num_rows, np.uint64)
            if len(rows):
                fp[rows] = _majority(h, sizes)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id, fp): the SimHash of each row's whole text as a long; null and wordless texts have fingerprint zero."""
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _fingerprints(shingle_words), "doc_id long, fp long")


def segment_popcounts(fp: Column) -> Column:
    """Sixteen four-bit counts of the set bits of four-bit segments, packed in a long."""
    low, high = fp.bitwiseAND(F.lit(0x5555555555555555)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(0x5555555555555555))
    pairs = low.bitwiseXOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    return pairs.bitwiseAND(F.lit(0x3333333333333333)) + F.shiftrightunsigned(pairs, 2).bitwiseAND(F.lit(0x3333333333333333))


def grid_cells(counts: Column) -> Column:
    """The packed vector itself and those one step away along one axis; null where a step leaves the grid."""
    cells = [counts]
    for i in range(16):
        at, step = F.shiftrightunsigned(counts, 4 * i).bitwiseAND(F.lit(15)), F.lit(1 << 4 * i)
        cells += [F.when(at < 4, counts + step), F.when(at > 0, counts - step)]
    return F.array(*cells)


def _forest(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Spanning-forest edges of the graph that joins rows of ``bits`` (n, words) within ``radius`` bits."""
    rest, edges = np.arange(1, len(bits)), []
    queue = [0]
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        at = queue.pop()
        near = rest[np.bitwise_count(bits[rest] ^ bits[at]).sum(axis=1, dtype=np.int32) <= radius]
        if len(near):
            edges += [(at, int(x)) for x in near]
            queue += near.tolist()
            rest = rest[~np.isin(rest, near, assume_unique=True)]
    return edges


def _cell_forest(bits: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges with the components of ``_forest`` for one-word rows. A large cell is cut by blocks of the fingerprint: two
    that differ in ``radius`` bits agree in one of radius + 1 blocks, so searching the rows of equal blocks finds all."""
    if len(bits) <= CELL:
        return _forest(bits, radius)
    edges, width = [], -(-64 // (radius + 1))
    for shift in range(0, 64, width):
        block = bits[:, 0] >> np.uint64(shift) & np.uint64((1 << min(width, 64 - shift)) - 1)
        order = np.argsort(block, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(block[order])) + 1, len(order)]
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if b - a > 1:
                own = order[a:b]
                edges += [(int(own[x]), int(own[y])) for x, y in _forest(bits[own], radius)]
    return edges


def _cell_edges(radius: int):
    """Rows (cell, node) sorted by cell, where nodes are fingerprints -> edges inside every cell. One cell's rows are in
    memory at a time."""

    def solve(cell: np.ndarray, node: np.ndarray) -> pa.RecordBatch:
        bits = node.view(np.uint64)[:, None]
        cuts = np.flatnonzero(np.diff(cell)) + 1
        starts, ends = np.r_[0, cuts], np.r_[cuts, len(cell)]
        two = starts[ends - starts == 2]
        two = two[np.bitwise_count(bits[two] ^ bits[two + 1]).sum(axis=1, dtype=np.int32) <= radius]
        u, v = [node[two]], [node[two + 1]]
        for a, b in zip(*(x[ends - starts > 2] for x in (starts, ends))):
            if found := _cell_forest(bits[a:b], radius):
                pair = np.array(found) + a
                u.append(node[pair[:, 0]])
                v.append(node[pair[:, 1]])
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, node = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            cell, node = (np.concatenate([old, batch.column(i).to_numpy(zero_copy_only=False)]) for i, old in enumerate((cell, node)))
            last = int(np.searchsorted(cell, cell[-1]))  # the last cell may go on in the next batch
            if last:
                yield solve(cell[:last], node[:last])
                cell, node = cell[last:].copy(), node[last:].copy()
        if len(cell):
            yield solve(cell, node)

    return run


def grid_edges(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of distinct fingerprints ``fp`` within ``radius`` bits."""
    if not 0 <= radius <= 2:
        raise ValueError("the one-step grid covers a radius of two bits at most")
    tasks = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select("fp").repartition(tasks, F.xxhash64("fp"))  # by number and anew, so that rows are spread before they multiply
    cells = dealt.select(F.explode(grid_cells(segment_popcounts(F.col("fp")))).alias("cell"), F.col("fp").alias("node")).where("cell is not null")
    return map_arrow(cells.repartition("cell").sortWithinPartitions("cell"), _cell_edges(radius), "u long, v long")


def fingerprint_classes(nodes: DataFrame, radius: int = 2) -> DataFrame:
    """nodes (distinct ``fp``, other columns) with the column ``label``: the least fingerprint, as a long, that links reach."""
    labels = connected_components(grid_edges(nodes.select("fp"), radius))
    return nodes.join(labels, F.col("fp") == F.col("id"), "left").select(*nodes.columns, F.coalesce("label", "fp").alias("label"))


def simhash_components(docs: DataFrame, shingle_words: int = 3, radius: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id.

    Words are runs other than space and 09-0D after lower-casing A-Z; shingles are counted with repeats; a fingerprint
    bit is set if it is set in over half the shingle hashes (XXH64, seed 42). Fingerprints that differ in ``radius``
    bits or fewer are linked; component_id is the smallest doc_id reachable. Null, empty and wordless texts have
    fingerprint zero and link like any other. Repeated rows are returned as often as given. A row with null doc_id
    links, but never names a component unless all doc_ids of that are null. An empty table gives an empty result.
    Other columns are ignored.
    """
    fps = materialize(fingerprints(docs, shingle_words), "fingerprints")
    linked = fingerprint_classes(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), radius)
    lowest = linked.groupBy("label").agg(F.min("low").alias("component_id"))
    named = linked.join(lowest, "label").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _sketches(k: int):
    factors = np.array([splitmix(i) | 1 for i in range(BANDS * ROWS + WIDE)], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            h, sizes, rows = _hashed(batch, k, distinct=True)
            n = batch.num_rows
            wide, low, counts = np.zeros((n, WIDE), np.uint64), np.zeros((n, BANDS * ROWS), np.uint64), np.zeros(n, np.int64)
            counts[rows] = sizes
            if len(rows):
                starts = np.cumsum(sizes) - sizes
                for j in range(WIDE):
                    z = (h ^ h >> np.uint64(29)) * factors[j]
                    wide[rows, j] = _majority(z ^ z >> np.uint64(32), sizes)
                g = h ^ h >> np.uint64(31)
                for j in range(BANDS * ROWS):
                    low[rows, j] = np.minimum.reduceat(g * factors[WIDE + j], starts)
            bands = [[xxhash.xxh64_intdigest(row[ROWS * b : ROWS * (b + 1)].tobytes(), b) - (1 << 63) for b in range(BANDS)] for row in low]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("sig"),
                    pa.array([x.tobytes() for x in wide], pa.binary()),
                    pa.array(counts),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "sig", "wide", "size", "cells"],
            )

    return run


def _blocks(sizes: np.ndarray, similarity: float) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of rows in order of ``sizes``, and the pairs (i, j), i <= j, of ranges that the sizes allow to hold similar
    rows. Together they hold every pair of rows once; i = j stands for the pairs inside a range."""
    ends = np.cumsum(sizes)
    part = (ends - sizes) // BLOCK_SHINGLES
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(sizes)]
    spans = list(zip(cuts, cuts[1:]))
    return spans, [(i, j) for i, x in enumerate(spans) for j, y in enumerate(spans[i:], i) if sizes[x[1] - 1] >= similarity * sizes[y[0]] - 1e-9]


def _cell_pairs(similarity: float):
    """Rows (cell, node, size) sorted by cell -> rows (kind, key, u, v): of small cells the PAIR (u, v); of large ones each
    row u once, as a MEMBER of its block ``key``, and for each two blocks u and v to compare (u = v: inside) a TASK ``key``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((3, 0), np.int64)

        def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            cell, node, size = rows
            cuts = np.flatnonzero(np.diff(cell)) + 1
            starts, counts = np.r_[0, cuts], np.diff(np.r_[0, cuts, len(cell)])
            for n in np.unique(counts[(counts > 1) & (counts <= PAIRED)]).tolist():
                i, j = np.triu_indices(n, 1)
                first = starts[counts == n]
                for at in range(0, len(first), max(1, (1 << 18) // len(i))):
                    some = first[at : at + max(1, (1 << 18) // len(i)), None]
                    x, y = (some + i).ravel(), (some + j).ravel()
                    able = np.minimum(size[x], size[y]) >= similarity * np.maximum(size[x], size[y]) - 1e-9
                    x, y = node[x[able]], node[y[able]]
                    yield batch(PAIR, None, np.maximum(x, y), np.minimum(x, y))
            for a, n in zip(starts[counts > PAIRED].tolist(), counts[counts > PAIRED].tolist()):
                order = a + np.lexsort((node[a : a + n], size[a : a + n]))
                spans, pairs = _blocks(size[order], similarity)
                name = lambda *x: xxhash.xxh64_intdigest(np.array([cell[a], *x]).tobytes(), SEED) - (1 << 63)  # noqa: B023, E731
                ids = np.array([name(i) for i in range(len(spans))])
                for block, (p, q) in zip(ids, spans):
                    yield batch(MEMBER, np.full(q - p, block), node[order[p:q]], None)
                for at in range(0, len(pairs), 1 << 16):
                    i, j = np.array(pairs[at : at + (1 << 16)]).T
                    yield batch(TASK, np.array([name(x, y) for x, y in zip(i.tolist(), j.tolist())]), ids[i], ids[j])

        def batch(kind: int, key: np.ndarray | None, u: np.ndarray, v: np.ndarray | None) -> pa.RecordBatch:
            n, none = len(u), pa.nulls(len(u), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), none if key is None else pa.array(key), pa.array(u), none if v is None else pa.array(v)], names=["kind", "key", "u", "v"])

        for given in batches:
            if not given.num_rows:
                continue
            held = np.concatenate([held, np.array([given.column(i).to_numpy(zero_copy_only=False) for i in range(3)])], axis=1)
            last = int(np.searchsorted(held[0], held[0, -1]))  # the last cell may go on in the next batch
            if last:
                yield from solve(held[:, :last])
                held = held[:, last:].copy()
        if held.size:
            yield from solve(held)

    return run


def _similar_forest(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Spanning-forest edges of the graph that joins sets of ``similarity`` or more, all (side 0) or of different sides.

    A row's intersections with all others are counted at once: members that many rows have as bits, others by the lists
    of rows that have them. Members of one row only count in the sizes.
    """
    n, sizes = len(sets), np.array([len(x) for x in sets], np.int64)
    members, ids, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    common = df > max(64, n // 16)
    rank = np.cumsum(common) - 1
    bits = np.zeros((n, -(-int(common.sum()) // 64) * 8), np.uint8)
    hot = common[ids]
    np.bitwise_or.at(bits, (owner[hot], rank[ids[hot]] >> 3), np.uint8(1) << (rank[ids[hot]] & 7).astype(np.uint8))
    bits = bits.view(np.uint64)
    rare = (df[ids] > 1) & ~hot
    ids, owner = ids[rare], owner[rare]
    own = np.split(ids, np.searchsorted(owner, np.arange(1, n)))
    order = np.argsort(ids, kind="stable")
    lists, starts = owner[order], np.searchsorted(ids[order], np.arange(len(members) + 1))

    rest, edges, queue = np.arange(1, n), [], [0]
    while len(rest):
        if not queue:
            queue, rest = [int(rest[0])], rest[1:]
            continue
        at = queue.pop()
        both = np.bitwise_count(bits[rest] & bits[at]).sum(axis=1, dtype=np.int64)
        if len(own[at]):
            both += np.bincount(np.concatenate([lists[starts[x] : starts[x + 1]] for x in own[at]]), minlength=n)[rest]
        able = (side[rest] != side[at]) | (side[at] == 0)
        near = rest[able & (both >= similarity * (sizes[at] + sizes[rest] - both) - 1e-9)]
        if len(near):
            edges += [(at, int(x)) for x in near]
            queue += near.tolist()
            rest = rest[~np.isin(rest, near, assume_unique=True)]
    return edges


def _task_edges(similarity: float):
    """Rows (task, side, node, shingles) sorted by task -> edges (u, v). One task's rows are in memory at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            pairs = np.array(_similar_forest(sets, np.array(sides), similarity), np.int64).reshape(-1, 2)
            own = np.array(nodes, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(own[pairs[:, 0]]), pa.array(own[pairs[:, 1]])], names=["u", "v"])

        task, sides, nodes, sets = None, [], [], []
        for batch in batches:
            shingles = batch.column("shingles")
            values, offsets = shingles.values.to_numpy(), shingles.offsets.to_numpy()
            for i, (t, side, node) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("task", "side", "node")))):
                if t != task:
                    if len(sets) > 1:
                        yield solve()
                    task, sides, nodes, sets = t, [], [], []
                sides.append(side)
                nodes.append(node)
                sets.append(values[offsets[i] : offsets[i + 1]].copy())
        if len(sets) > 1:
            yield solve()

    return run


def _shingle_sets(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [np.unique(np.frombuffer(shingle_hashes((t or b"").lower().split(), k), ">i8").astype(np.int64)) for t in raw(batch)]
            offsets = np.r_[0, np.cumsum([len(x) for x in sets])].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, np.concatenate(sets))], names=["node", "shingles"])

    return run


def _verified(candidates: DataFrame, rows: DataFrame, nodes: DataFrame, k: int, similarity: float) -> DataFrame:
    """Edges (u, v) of the candidates of _cell_pairs whose shingle sets have a Jaccard similarity of ``similarity`` or
    more; of a task's, a spanning forest. One text speaks for a node."""
    kind = lambda x: candidates.where(F.col("kind") == x)
    ends = kind(PAIR).select(F.explode(F.array("u", "v")).alias("node")).union(kind(MEMBER).select("u")).distinct()
    own = nodes.join(ends, "node", "left_semi").select("node", F.col("doc_id").alias("__id"), F.col("sig").alias("__sig"))
    texts = rows.join(own, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("sig") == F.col("__sig"))).select("node", "text")
    sets = materialize(map_arrow(texts, _shingle_sets(k), "node long, shingles array<long>").dropDuplicates(["node"]), "shingles")
    left, right = sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), sets.select(F.col("node").alias("v"), F.col("shingles").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    pairs = kind(PAIR).select("u", "v").distinct().join(left, "u").join(right, "v").withColumn("both", both)
    near = pairs.where(F.col("both") >= similarity * (F.size("a") + F.size("b") - F.col("both")) - 1e-9).select("u", "v")
    side = lambda n, block: F.struct(F.lit(n).alias("side"), F.col(block).alias("block"))
    blocks = kind(TASK).select(F.col("key").alias("task"), F.explode(F.when(F.col("u") == F.col("v"), F.array(side(0, "u"))).otherwise(F.array(side(1, "u"), side(2, "v")))).alias("x"))
    tasks = blocks.select("task", "x.*").join(kind(MEMBER).select(F.col("key").alias("block"), F.col("u").alias("node")), "block").drop("block").join(sets, "node")
    hot = map_arrow(tasks.repartition("task").sortWithinPartitions("task"), _task_edges(similarity), "u long, v long")
    return near.union(hot.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))).distinct()


def _grid_links(rows: DataFrame, found: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) between the nodes of rows that simhash_components puts in one component, as stars."""
    fps = materialize(fingerprints(rows.select(F.col("sig").alias("doc_id"), "text")).distinct(), "fingerprints")
    classes = fingerprint_classes(fps.select("fp").distinct(), radius)
    classed = fps.join(classes, "fp").select(F.col("doc_id").alias("sig"), "label")
    member = materialize(found.select("node", "sig").distinct().join(classed, "sig").select("node", "label").distinct(), "classes")
    least = member.groupBy("label").agg(F.min("node").alias("v"))
    return member.join(least, "label").where("node <> v").select(F.col("node").alias("u"), "v")


def near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """One row per distinct (doc_id, text): doc_id, sig (hash of the text), n (rows), component, keeper (whether it stays).

    Rows of equal 512-bit SimHash are one node. Nodes that share a band of the min-wise sketch are linked if the Jaccard
    similarity of their shingle sets (lower-cased A-Z) is ``similarity`` or more; no pair of a cell is left out, whatever
    the cell's size. With ``radius`` the links of simhash_components, by its grid and for that radius, count besides, so
    that its components are never divided. Of every component the row of the smallest doc_id (null first; then of the smallest sig) stays. Null,
    empty and wordless texts are copies of one another; fewer words than a shingle make one. An empty table gives an
    empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("sig"), "text")
    found = materialize(map_arrow(rows, _sketches(shingle_words), "doc_id long, sig long, wide binary, size long, cells array<long>").withColumn("node", F.xxhash64("wide")), "sketches")
    nodes = found.groupBy("node").agg(F.min(F.struct("doc_id", "sig", "size", "cells")).alias("one")).select("node", "one.*")
    cells = nodes.select(F.explode("cells").alias("cell"), "node", "size")
    candidates = materialize(map_arrow(cells.repartition("cell").sortWithinPartitions("cell"), _cell_pairs(similarity), "kind int, key long, u long, v long"), "candidates")
    links = _verified(candidates, rows, nodes, shingle_words, similarity)
    labels = connected_components(links if radius is None else links.union(_grid_links(rows, found, radius)))
    each = found.groupBy("doc_id", "sig", "node").agg(F.count("*").alias("n"))
    linked = materialize(each.join(labels, F.col("node") == F.col("id"), "left").select("doc_id", "sig", "n", F.coalesce("label", "node").alias("label")), "members")
    first = linked.groupBy("label").agg(F.min(F.struct("doc_id", "sig")).alias("first"))
    return linked.join(first, "label").select("doc_id", "sig", "n", F.col("label").alias("component"), F.struct("doc_id", "sig").eqNullSafe(F.col("first")).alias("keeper"))


def drop_near_duplicates(docs: DataFrame, shingle_words: int = 5, similarity: float = 0.8, radius: int | None = None) -> DataFrame:
    """The rows of docs, all their columns, with one of every group of near-duplicates (see ``near_duplicates``).

    Of repeated rows (equal doc_id and text) one stays. Extra columns may have any names.
    """
    own, other, sig, n = free_names(docs, "own", "other_id", "sig", "n")
    keep = near_duplicates(docs, shingle_words, similarity, radius).where("keeper")
    keep = materialize(keep.select(F.col("doc_id").alias(other), F.col("sig").alias(sig), F.col("n").alias(n)), "keepers")
    hashed = docs.withColumn(own, F.xxhash64(F.coalesce("text", F.lit(""))))
    kept = hashed.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(own) == F.col(sig)))
    if not keep.where(F.col(n) > 1).isEmpty():
        kept = kept.where(F.col(n) == 1).union(kept.where(F.col(n) > 1).dropDuplicates([other, sig]))
    return kept.select(*(column(c) for c in docs.columns))
