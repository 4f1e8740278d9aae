"""Benchmark decontamination by SimHash windows of item size and multi-index Hamming search.

An item of n words is looked for in every n-word window of a document (the whole of a shorter one). Windows and items
have SimHash fingerprints of 256 bits over their word shingles, and those within ``RADIUS`` bits are found by a
multi-index. Fingerprints are cut into 32 blocks of eight bits. Two within the radius can't have more than 21 blocks that
differ in three bits or more, so at least ``AGREE`` of their blocks differ in two or fewer: looking up each block's
neighbourhood of two bits and counting finds them all, while of unrelated fingerprints four in a thousand get so many.
Candidates within the radius are then verified exactly: the weighted Jaccard similarity of the two shingle multisets,
weights being multiplicities. At a similarity of 0.8 fingerprints differ in 39 bits on average, with a deviation of six.

Two multisets of n and m shingles reach similarity s only if they have s * (n + m) / (1 + s) shingles in common. Windows
with fewer shingles that occur in items of their size are therefore skipped, which loses no match and spares clean text.
"""

from __future__ import annotations

import itertools
import math
import string
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import column, free_names, map_arrow, slices, splitmix
from kmerloom.storage import materialize

WORDS, BLOCKS, REACH, RADIUS = 4, 32, 2, 63
#: Blocks within REACH that fingerprints within RADIUS have at least.
AGREE = BLOCKS - RADIUS // (REACH + 1)
MASKS = np.array([sum(1 << i for i in c) for r in range(REACH + 1) for c in itertools.combinations(range(8), r)], np.uint8)
#: Items of a run: larger benchmarks are searched in blocks of so many bytes, each in a pass of its own over the documents
#: that hold a shingle of any item, as far as a table of 2**TABLE_BITS bits can tell.
ITEM_BYTES, TABLE_BITS = 16 << 20, 27
#: Windows of a document that are fingerprinted at a time.
WINDOWS = 1024
PUNCTUATION = string.punctuation.encode()
HALF = np.uint64(32)
FACTORS = np.array([splitmix(100 + i) | 1 for i in range(WORDS)], np.uint64)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words between ASCII blanks, without ASCII punctuation."""
    return (text or "").lower().encode().translate(None, PUNCTUATION).split()


def shingle_codes(words: list[bytes], k: int) -> np.ndarray:
    """A 64-bit code per k-word shingle: the words' hashes, combined and mixed. Fewer words make one shingle."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < k:
        h = np.concatenate([h, np.zeros(k - len(words), np.uint64)])
    n = len(h) - k + 1
    code = np.zeros(n, np.uint64)
    for i in range(k):
        code = (code ^ h[i : i + n]) * np.uint64(splitmix(i) | 1)
        code ^= code >> HALF
    return code


def fingerprints(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """SimHash of the windows of ``size`` shingles at ``starts``, by prefix sums of bits: (windows, BLOCKS) bytes."""
    wide = (codes ^ codes >> np.uint64(29))[:, None] * FACTORS
    wide ^= wide >> HALF
    bits = np.unpackbits(np.ascontiguousarray(wide, "<u8").view(np.uint8).reshape(-1, BLOCKS), axis=1, bitorder="little")
    sums = np.zeros((len(codes) + 1, 8 * BLOCKS), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return np.packbits(2 * (sums[starts + size] - sums[starts]) > size, axis=1, bitorder="little")


class MultiIndex:
    """Fingerprints by block and value of the block; a query counts the blocks within REACH bits of its own."""

    def __init__(self, fingerprints: np.ndarray):
        self.fingerprints, n = fingerprints, len(fingerprints)
        keys = (fingerprints + 256 * np.arange(BLOCKS)[None, :]).T.ravel().astype(np.uint16)  # block by block
        order = np.argsort(keys, kind="stable")
        self.keys, self.rows = keys[order], (order % n).astype(np.int32) if n else order

    def candidates(self, f: np.ndarray) -> np.ndarray:
        """Positions of the fingerprints of which AGREE blocks or more are near those of f."""
        probes = ((f[:, None] ^ MASKS) + 256 * np.arange(BLOCKS)[:, None]).ravel().astype(np.uint16)
        a, z = np.searchsorted(self.keys, probes, "left"), np.searchsorted(self.keys, probes, "right")
        sizes = z - a
        at = np.arange(int(sizes.sum())) + np.repeat(a - (np.cumsum(sizes) - sizes), sizes)
        return np.flatnonzero(np.bincount(self.rows[at], minlength=len(self.fingerprints)) >= AGREE)

    def search(self, f: np.ndarray) -> list[int]:
        """Positions of all fingerprints within RADIUS of f."""
        near = self.candidates(f)
        return near[np.bitwise_count(self.fingerprints[near] ^ f).sum(axis=1, dtype=np.int32) <= RADIUS].tolist()


def weighted_similarity(a: list[tuple], b: list[tuple]) -> float:
    """Sum of the smaller over sum of the larger multiplicities."""
    x, y = Counter(a), Counter(b)
    both = sum((x & y).values())
    return both / (len(a) + len(b) - both) if a or b else 0.0


def shingles(words: list[bytes], k: int) -> list[tuple]:
    return [tuple(words)] if 0 < len(words) < k else [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]


class Items:
    """The benchmark's items by their number of shingles, with what finds them: arrays over all shingles, and the texts."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, by_size, codes, sizes = k, defaultdict(list), [np.empty(0, np.uint64)], []
        for item_id, text in items:
            words = words_of(text)
            if words:
                c = shingle_codes(words, k)
                by_size[len(c)].append((item_id, text, fingerprints(c, np.zeros(1, np.int64), len(c))[0]))
                codes.append(np.unique(c))
                sizes.append((len(c), len(codes[-1])))
        every = np.concatenate(codes)
        size = np.repeat(np.array([s for s, _ in sizes], np.int64), [n for _, n in sizes]) if sizes else np.empty(0, np.int64)
        order = np.lexsort((size, every))
        every, size = every[order], size[order]
        new = np.r_[True, (every[1:] != every[:-1]) | (size[1:] != size[:-1])] if len(every) else np.empty(0, bool)
        every, self.size_of = every[new], size[new]  # the sizes of the items that hold a code, code by code
        first = np.r_[True, every[1:] != every[:-1]] if len(every) else np.empty(0, bool)
        self.codes, self.starts = every[first], np.r_[np.flatnonzero(first), len(every)]
        self.sizes = {s: ([(i, t) for i, t, _ in found], MultiIndex(np.array([f for _, _, f in found]))) for s, found in by_size.items()}
        self.seen = np.zeros(1 << 20, bool)  # by the top 20 bits: few codes need the search below
        self.seen[(self.codes >> np.uint64(44)).astype(np.int64)] = True

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """Positions of the shingles that occur in an item."""
        if not len(self.codes):
            return np.empty(0, np.int64)
        maybe = np.flatnonzero(self.seen[(codes >> np.uint64(44)).astype(np.int64)])
        at = np.searchsorted(self.codes, codes[maybe])
        at[at == len(self.codes)] = 0
        return maybe[self.codes[at] == codes[maybe]]

    def matches(self, words: list[bytes], codes: np.ndarray, hits: np.ndarray, least: float) -> list[tuple[int, float, int, int]]:
        """(item_id, similarity, first word, words) of every item found: its best window, the earliest of equals."""
        code = np.searchsorted(self.codes, codes[hits])
        counts = self.starts[code + 1] - self.starts[code]
        size_of = self.size_of[np.arange(int(counts.sum())) + np.repeat(self.starts[code] - (np.cumsum(counts) - counts), counts)]
        position = np.repeat(hits, counts)
        best: dict[int, tuple[float, int, int]] = {}
        for size in np.unique(size_of).tolist():
            found, index = self.sizes[size]
            n = min(size, len(codes))
            total = np.zeros(len(codes) + 1, np.int32)
            total[position[size_of == size] + 1] = 1
            np.cumsum(total, out=total)
            starts = np.flatnonzero(total[n:] - total[: len(total) - n] >= math.ceil(least * (n + size) / (1 + least) - 1e-9))
            cuts = np.flatnonzero((np.diff(starts, prepend=-1) > n) | (np.arange(len(starts)) % WINDOWS == 0)).tolist()
            for a, z in zip(cuts, [*cuts[1:], len(starts)]):
                own = starts[a:z]
                for s, f in zip(own.tolist(), fingerprints(codes[own[0] : own[-1] + n], own - own[0], n)):
                    near = index.search(f)
                    if near:
                        window = shingles(words[s : s + n + self.k - 1], self.k)
                        for i in near:
                            item_id, text = found[i]
                            x = weighted_similarity(window, shingles(words_of(text), self.k))
                            if x >= least and x > best.get(item_id, (0.0,))[0]:
                                best[item_id] = (x, s, min(n + self.k - 1, len(words) - s))
        return [(i, *best[i]) for i in sorted(best, key=lambda i: (i is not None, i))]


#: The last items that this process has prepared: its next tasks need the same.
_prepared: dict[tuple[str, int], Items] = {}


def prepared(digest: str, items: list[tuple[int, str]], k: int) -> Items:
    if (digest, k) not in _prepared:
        _prepared.clear()
        _prepared[digest, k] = Items(items, k)
    return _prepared[digest, k]


def digest_of(items: list[tuple[int, str]]) -> str:
    h = xxhash.xxh3_128()
    for item_id, text in items:
        h.update(f"{item_id} {len(text)} {text}")
    return h.hexdigest()


def _search(items: list[tuple[int, str]], k: int, least: float):
    digest = digest_of(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(digest, items, k)
        for batch in slices(batches):
            out = []
            words = [words_of(t) for t in batch.column("text").to_pylist()]
            codes = [shingle_codes(w, k) for w in words]
            hits = known.hits(np.concatenate(codes))
            ends = np.cumsum([len(c) for c in codes])
            for i in np.unique(np.searchsorted(ends, hits, side="right")).tolist():
                own = hits[(hits >= ends[i] - len(codes[i])) & (hits < ends[i])] - (ends[i] - len(codes[i]))
                out += [(i, *m) for m in known.matches(words[i], codes[i], own, least)]
            rows = batch.take(pa.array([x[0] for x in out], pa.int64())) if out else batch.slice(0, 0)
            new = [pa.array([x[j] for x in out], t) for j, t in ((1, pa.int64()), (2, pa.float64()), (3, pa.int64()), (4, pa.int64()))]
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("sig"), *new], names=["doc_id", "sig", "item_id", "similarity", "start", "n_words"])

    return run


def benchmark_matches(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, sig, item_id, similarity, start, n_words): the best window of each item in each row that holds it.

    sig is the text's hash; start counts words. Null, blank and wordless texts and items match nothing. A text or item
    of fewer words than a shingle has one shingle of all its words. Repeated rows match each; items repeated under one
    item_id count once, and those of a null item_id as one item. Empty tables give an empty result; other columns are ignored.
    """
    rows = docs.where("text is not null").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("sig"), "text")
    items, passes = _items(benchmark)
    if passes > 1:
        rows = materialize(map_arrow(rows, _touching(_shingle_table(items, shingle_words), shingle_words), "doc_id long, sig long, text string"), "touching")
    found = None
    for i in range(passes):
        part = map_arrow(rows, _search(_block(items, i, passes), shingle_words, similarity), "doc_id long, sig long, item_id long, similarity double, start long, n_words long")
        found = part if passes == 1 else materialize(part, "matches") if found is None else found.union(materialize(part, "matches"))
    return found


def _items(benchmark: DataFrame) -> tuple[DataFrame, int]:
    """The benchmark's items and the number of blocks that they fall into."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, -(-size // ITEM_BYTES) or 1


def _block(items: DataFrame, i: int, passes: int) -> list[tuple[int, str]]:
    some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == i).orderBy("item_id", "text")
    return [tuple(r) for r in some.collect()]  # ITEM_BYTES on average


def _shingle_table(items: DataFrame, k: int) -> bytes:
    """A bit for every value of the leading TABLE_BITS bits of a shingle's code. The driver holds this table alone."""
    shift = np.uint64(64 - TABLE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            codes = np.concatenate([shingle_codes(words_of(t), k) for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([np.unique(codes >> shift).astype(np.int32).tobytes()], pa.binary())], names=["leading"])

    table = np.zeros(1 << TABLE_BITS - 3, np.uint8)
    for r in map_arrow(items.select("text"), run, "leading binary").toLocalIterator():
        leading = np.frombuffer(r.leading, np.int32)
        np.bitwise_or.at(table, leading >> 3, np.uint8(1) << (leading & 7).astype(np.uint8))
    return table.tobytes()


def _touching(table: bytes, k: int):
    shift = np.uint64(64 - TABLE_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(table, np.uint8)
        for batch in slices(batches):
            leading = [(shingle_codes(words_of(t), k) >> shift).astype(np.int64) for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array([bool((bits[x >> 3] >> (x & 7).astype(np.uint8) & 1).any()) for x in leading], pa.bool_()))

    return run


def _clean(items: list[tuple[int, str]], k: int, least: float):
    digest = digest_of(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = prepared(digest, items, k)
        for batch in slices(batches):
            keep = []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                codes = shingle_codes(words, k)
                hits = known.hits(codes)
                keep.append(not len(hits) or not known.matches(words, codes, hits, least))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle_words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs, all their columns, that hold no item (see ``benchmark_matches``): a filter without a shuffle, or an
    anti-join with the documents found if the benchmark exceeds ITEM_BYTES. Extra columns may have any names."""
    items, passes = _items(benchmark)
    if passes == 1:
        return map_arrow(docs, _clean(_block(items, 0, 1), shingle_words, similarity), docs.schema)
    own, other, sig = free_names(docs, "own", "other_id", "sig")
    found = benchmark_matches(docs, benchmark, shingle_words, similarity).select(F.col("doc_id").alias(other), F.col("sig").alias(sig)).distinct()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(other)) & (F.col(own) == F.col(sig))
    kept = docs.withColumn(own, F.when(F.col("text").isNotNull(), F.xxhash64("text"))).join(found, same, "left_anti")
    return kept.select(*(column(c) for c in docs.columns))
