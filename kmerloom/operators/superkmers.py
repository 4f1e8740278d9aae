"""Linking reads by super-k-mers: runs of k-mers travel as bases and are counted where they meet.

Neighbouring k-mers mostly have the same minimizer, the least of their canonical m-mers in the order of a hash, and both
strands of a k-mer have the same one. A run of k-mers whose minimizers fall in one bucket is a row of two bits a base,
with its read and the bases beside it. Dealt by bucket, all occurrences of a k-mer meet in one task, which sorts some
buckets at a time, takes the branch statistics and marks what they condemn or link there, so no k-mer is ever a row of an
exchange or a join. Buckets are stored and counted before they are dealt; one with too many k-mers for a task is taken
out, and its k-mers go by the operators of ``branch_filter`` and ``links``, which combine counts before the exchange
and leave skewed keys to adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.arrow import map_arrow
from kmerloom.functions.dna import CODE_ORDER, PACKED
from kmerloom.operators.kmers import BASES, COMPLEMENT, UNKNOWN, base_codes, free_windows, kmer_rows, kmer_schema, long_reads, packed, windows
from kmerloom.storage import materialize

#: Bases of a minimizer, and at most, where many buckets ask for more; positions of a slice of reads; k-mers of a run that
#: are unpacked one after the other.
MINIMIZER, LONGEST, SLICE, PIECE = 13, 16, 1 << 17, 64
#: Runs that a task gathers, some 60 bytes each, before it sorts them by bucket: many buckets still get rows of several runs.
GATHERED = 1 << 20
#: Rows that a task makes of what it gathered, at most: with more buckets than these a row holds several of them, so that
#: rows get no shorter, and compress no worse, as the input grows.
ROWS = 1 << 12
#: K-mers that a task sorts at once, some 100 bytes each at the peak: a bucket of more is hot.
HELD = 1 << 20
#: K-mers that a task takes one after the other, about.
TASK = 256 << 20
#: Code order of neighbour bases, in which ties fall.
ORDER = np.array([BASES.index(c) for c in CODE_ORDER], np.uint8)
MET = ["condemned", "reads", "sizes", "members"]
RUNS = "bucket long, n long, reads binary, counts binary, sides binary, bases binary"
#: Runs as they are stored and dealt: of a row the range of buckets, those that it holds, the k-mers of each, and the runs.
PACKED_RUNS = "bucket_range long, buckets array<long>, n array<long>, size long, runs binary"


def minimizer_bases(k: int, buckets: int) -> int:
    """Bases of a minimizer: enough for some sixteen of them in a bucket, but about half a k-mer or 11 less than it at most."""
    wanted = next((m for m in range(MINIMIZER, LONGEST) if 4**m >= 32 * buckets), LONGEST)
    return min(wanted, max((k + 1) // 2, k - 11))


def minimizer_buckets(codes: np.ndarray, k: int, at: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of the minimizer of every window of k bases at the positions ``at``, the same for both strands."""
    m = minimizer_bases(k, buckets)
    digits = codes.astype(np.uint32) & np.uint32(3)
    least = np.minimum(packed(digits, m, False), packed(digits ^ np.uint32(3), m, True))
    least = (least + np.uint32(1)) * np.uint32(0x9E3779B1)  # odd: a permutation, so equal ranks are equal m-mers
    least ^= least >> np.uint32(15)
    width, size = k - m + 1, 1
    while 2 * size <= width:
        least, size = np.minimum(least[:-size], least[size:]), 2 * size
    least = np.minimum(least[at], least[at + width - size]).astype(np.uint64)
    mixed = least * np.uint64(0xD6E8FEB86659FD93)
    return (mixed >> np.uint64(32) ^ mixed & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)


def kmer_runs(reads: DataFrame, k: int, buckets: int, without: np.ndarray | None = None, span: int = 0) -> DataFrame:
    """(bucket, n, reads, counts, sides, bases): the runs of some slices of reads by bucket, n k-mers in all.

    Of every run in a row: its read_id, its number of k-mers, its read's flag ``bad`` and the two bases beside it, and its
    bases, four in a byte. Buckets in ``without`` (sorted) are left out. With ``span`` rows are packed instead, and hold
    the runs of so many neighbouring buckets (see packed_rows).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            codes, ends = base_codes(batch)
            read_id, bad = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("read_id", "bad"))
            for a in range(0, len(codes), SLICE):
                b = min(a + SLICE, len(codes))
                position, read = free_windows(codes, ends, k, a, b)
                if len(position):
                    bucket = minimizer_buckets(codes[a : b + k - 1], k, position - a, buckets)
                    if without is not None and len(without):
                        cold = ~np.isin(bucket, without)
                        position, read, bucket = position[cold], read[cold], bucket[cold]
                if len(position):
                    parts.append(runs_of(codes, ends, read_id, bad, position, read, bucket))
                    size += len(parts[-1][0])
                if size >= GATHERED:
                    yield rows(*map(np.concatenate, zip(*parts)))
                    parts, size = [], 0
        if parts:
            yield rows(*map(np.concatenate, zip(*parts)))

    def runs_of(codes, ends, read_id, bad, position, read, bucket) -> tuple[np.ndarray, ...]:
        first = np.flatnonzero(np.r_[True, (np.diff(position) != 1) | (bucket[1:] != bucket[:-1])])
        counts = np.diff(np.r_[first, len(position)])
        start, read, bucket = position[first], read[first], bucket[first]
        stop = start + counts + k - 1
        prev = np.where(start == np.r_[0, ends[:-1]][read], UNKNOWN, codes[start - 1])
        after = np.where(stop == ends[read], UNKNOWN, codes[np.minimum(stop, len(codes) - 1)])
        quads = -(-(counts + k - 1) // 4)
        end = np.cumsum(quads)
        at = np.repeat(start - 4 * (end - quads), 4 * quads) + np.arange(4 * end[-1])
        bases = (codes[np.minimum(at, len(codes) - 1)] & 3).reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8)
        return bucket.astype(np.int64), read_id[read], counts.astype(np.int32), (50 * bad[read].astype(np.uint8) + 5 * prev + after).astype(np.uint8), bases.astype(np.uint8)

    def rows(bucket, *runs) -> pa.RecordBatch:
        order = np.argsort(bucket, kind="stable")
        bucket, (read, counts, sides, bases) = bucket[order], taken(k, order, *runs)
        end = np.cumsum(base_bytes(counts, k))
        cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
        size = np.diff(cuts)
        cut = lambda data, wide, at: pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[cuts[:-1]]),
                pa.array(np.add.reduceat(counts.astype(np.int64), cuts[:-1])),
                cut(read, 8, cuts),
                cut(counts, 4, cuts),
                cut(sides, 1, cuts),
                cut(bases, 1, np.r_[0, end][cuts]),
            ],
            names=["bucket", "n", "reads", "counts", "sides", "bases"],
        )

    slim = long_reads(reads, k).select("read_id", "seq", F.lit(False).alias("bad")) if "bad" not in reads.columns else reads.where(F.length("seq") > k).select(F.col("read_id").cast("long"), "seq", "bad")
    if span:
        return map_arrow(slim, lambda batches: (packed_rows(batch, span) for batch in run(batches)), PACKED_RUNS)
    return map_arrow(slim, run, RUNS)


def base_bytes(counts: np.ndarray, k: int) -> np.ndarray:
    """Bytes of the bases of runs of so many k-mers."""
    return -(-(counts.astype(np.int64) + k - 1) // 4)


def taken(k: int, at: np.ndarray, read: np.ndarray, counts: np.ndarray, sides: np.ndarray, bases: np.ndarray) -> tuple[np.ndarray, ...]:
    """The runs at the places ``at``, in that order."""
    quads = base_bytes(counts, k)
    begin, quads = (np.cumsum(quads) - quads)[at], quads[at]
    end = np.cumsum(quads)
    return read[at], counts[at], sides[at], bases[np.repeat(begin - (end - quads), quads) + np.arange(quads.sum())]


def _planes(x: np.ndarray) -> np.ndarray:
    """The first bytes of all numbers, then the second ones, ...: equal bytes come together."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.ravel()


def _numbers(planes: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def squeezed(sizes: np.ndarray, read: np.ndarray, counts: np.ndarray, sides: np.ndarray, bases: np.ndarray) -> tuple[int, bytes]:
    """Runs in the order of their buckets, ``sizes`` of each, compressed, and the bytes that they are without that."""
    body = np.concatenate([_planes(sizes.astype(np.int32)), _planes(np.diff(read, prepend=0)), _planes(counts.astype(np.int32)), sides, bases])
    return len(body), pa.compress(body, codec="zstd", asbytes=True)


def unsqueezed(buckets: np.ndarray, size: int, runs: bytes) -> tuple[np.ndarray, ...]:
    """(bucket, read, counts, sides, bases) of the runs of a packed row."""
    body = np.frombuffer(pa.decompress(runs, decompressed_size=size, codec="zstd"), np.uint8)
    at = 4 * len(buckets)
    sizes = _numbers(body[:at], np.int32)
    n = int(sizes.sum())
    return np.repeat(buckets, sizes), np.cumsum(_numbers(body[at : at + 8 * n], np.int64)), _numbers(body[at + 8 * n : at + 12 * n], np.int32), body[at + 12 * n : at + 13 * n], body[at + 13 * n :]


def packed_rows(batch: pa.RecordBatch, span: int) -> pa.RecordBatch:
    """Rows of runs by bucket as rows (bucket_range, buckets, n, size, runs) of ``span`` neighbouring buckets each."""
    bucket, n = (batch.column(c).to_numpy() for c in ("bucket", "n"))
    cuts = np.r_[0, np.flatnonzero(np.diff(bucket // span)) + 1, len(bucket)]
    columns = [batch.column(c).buffers() for c in ("reads", "counts", "sides", "bases")]
    at = [np.frombuffer(offsets, np.int32) for _, offsets, _ in columns]
    data = [np.frombuffer(x, np.uint8) for _, _, x in columns]
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        read, counts, sides, bases = (x[p[a] : p[b]] for x, p in zip(data, at))
        rows.append(squeezed(np.diff(at[2][a : b + 1]), read.view(np.int64), counts.view(np.int32), sides, bases))
    return _packed_batch(bucket[cuts[:-1]] // span, cuts, bucket, n, rows)


def _packed_batch(ranges: np.ndarray, cuts: np.ndarray, buckets: np.ndarray, n: np.ndarray, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    lists = (pa.ListArray.from_arrays(cuts.astype(np.int32), pa.array(x)) for x in (buckets, n))
    sizes, runs = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(ranges), *lists, pa.array(sizes, pa.int64()), pa.array(runs, pa.binary())], names=["bucket_range", "buckets", "n", "size", "runs"])


def _without(k: int, hot: np.ndarray):
    """Packed rows without the runs of the buckets ``hot``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, rows = [], []
            for span, buckets, n, size, runs in zip(*(batch.column(c).to_pylist() for c in ("bucket_range", "buckets", "n", "size", "runs"))):
                cold = ~np.isin(buckets, hot)
                if cold.all():
                    rows.append((size, runs))
                elif cold.any():
                    bucket, *own = unsqueezed(np.array(buckets, np.int64), size, runs)
                    at = np.flatnonzero(~np.isin(bucket, hot))
                    buckets, n = np.array(buckets, np.int64)[cold], np.array(n, np.int64)[cold]
                    rows.append(squeezed(np.diff(np.searchsorted(bucket[at], np.r_[buckets, buckets[-1] + 1])), *taken(k, at, *own)))
                if cold.any():
                    kept.append((span, buckets, n))
            if kept:
                cuts = np.cumsum([0, *(len(b) for _, b, _ in kept)])
                yield _packed_batch(np.array([s for s, _, _ in kept], np.int64), cuts, *(np.concatenate([x[i] for x in kept]).astype(np.int64) for i in (1, 2)), rows)

    return run


def unpacked_runs(k: int, reads: bytes, counts: bytes, sides: bytes, bases: bytes) -> tuple[np.ndarray, ...]:
    """(read_id, bad, kmer, prev, next) of the k-mers of runs in a row, run by run.

    All runs advance together, a base at a time: a k-mer and its reverse complement come from those before. Runs are
    taken in pieces of PIECE k-mers at most, the longest first, so that those that go on stay in front.
    """
    read, count, side = np.frombuffer(reads, np.int64), np.frombuffer(counts, np.int32).astype(np.int64), np.frombuffer(sides, np.uint8)
    quads = np.frombuffer(bases, np.uint8)
    codes = np.empty(4 * len(quads), np.uint8)
    for i in range(4):
        codes[i::4] = quads >> 6 - 2 * i & 3
    size = -(-(count + k - 1) // 4) * 4
    pieces = -(-count // PIECE)
    run = np.repeat(np.arange(len(count)), pieces)
    nth = np.arange(len(run)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    left = count[run] - nth * PIECE
    length = np.minimum(left, PIECE)
    begin = np.cumsum(length) - length
    order = np.argsort(-length, kind="stable")
    run, nth, left, length, begin = run[order], nth[order], left[order], length[order], begin[order]
    start = (np.cumsum(size) - size)[run] + nth * PIECE
    before = np.where(nth == 0, side[run] % 50 // 5, codes[start - 1])
    ends, last = left <= PIECE, side[run] % 5

    two, top = np.uint64(2), np.uint64(2 * k - 2)
    forward, back = np.zeros(len(run), np.uint64), np.zeros(len(run), np.uint64)
    for i in range(k):
        base = codes[start + i].astype(np.uint64)
        forward, back = forward << two | base, back | (np.uint64(3) - base) << np.uint64(2 * i)
    live = np.searchsorted(-length, -np.arange(1, int(length.max()) + 2), side="right")  # pieces of j + 1 k-mers or more
    total = int(count.sum())
    kmer, prev, following = np.empty(total, np.uint64), np.empty(total, np.uint8), np.empty(total, np.uint8)
    for j in range(int(length.max())):
        n, more = int(live[j]), int(live[j + 1])
        after = np.where(ends[:n] & (length[:n] == j + 1), last[:n], codes[np.minimum(start[:n] + k + j, len(codes) - 1)])
        straight, at = forward < back, begin[:n] + j
        kmer[at], prev[at], following[at] = np.where(straight, forward, back), np.where(straight, before, COMPLEMENT[after]), np.where(straight, after, COMPLEMENT[before])
        before, base = codes[start[:more] + j], after[:more].astype(np.uint64)
        forward = (forward[:more] << two | base) & np.uint64((1 << 2 * k) - 1)
        back = back[:more] >> two | (np.uint64(3) - base) << top
    return np.repeat(read, count), np.repeat(side >= 50, count), kmer, prev, following


def together(kmer: np.ndarray) -> np.ndarray:
    """An order that puts equal k-mers side by side.

    Sorting numbers is many times faster than sorting positions by them, so a number of a k-mer's leading hash bits and its
    position is sorted. Where two k-mers share these bits, which is rare, the k-mers themselves order them.
    """
    wide = np.uint64(max(1, len(kmer)).bit_length())
    key = np.sort(kmer * np.uint64(0x9E3779B97F4A7C15) >> wide << wide | np.arange(len(kmer), dtype=np.uint64))  # odd: a permutation
    order, head = (key & np.uint64((1 << int(wide)) - 1)).astype(np.int64), key >> wide
    own = kmer[order]
    mixed = head[1:][(head[1:] == head[:-1]) & (own[1:] != own[:-1])]
    if len(mixed):
        at = np.flatnonzero(np.isin(head, mixed))
        order[at] = order[at[np.lexsort((own[at], head[at]))]]
    return order


class Groups:
    """Branch statistics of k-mers, and what they say of each occurrence (see branch_filter). K-mers seen once are left
    out: they condemn no read and link none."""

    def __init__(self, read: np.ndarray, bad: np.ndarray, kmer: np.ndarray, prev: np.ndarray, after: np.ndarray):
        order = together(kmer)
        kmer = kmer[order]
        first = np.flatnonzero(np.r_[True, kmer[1:] != kmer[:-1]])
        degree = np.diff(np.r_[first, len(kmer)])
        order = order[np.repeat(degree > 1, degree)]
        self.kmer, self.degree = kmer[first[degree > 1]], degree[degree > 1]
        self.first = np.cumsum(self.degree) - self.degree
        self.read, self.bad, self.group = read[order], bad[order], np.repeat(np.arange(len(self.degree)), self.degree)
        self.sides = [self._side(x[order]) for x in (prev, after)]

    def _side(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each k-mer whether it has two bases or more here and whether the second makes a fifth or more; for each
        occurrence whether its base is another than the most frequent."""
        two, fifth, off = np.zeros(len(self.first), bool), np.zeros(len(self.first), bool), np.zeros(len(base), bool)
        if len(base):
            two = np.minimum.reduceat(base, self.first) != np.maximum.reduceat(base, self.first)
        some = np.flatnonzero(two)  # few k-mers have several bases or an N; only these are counted
        if len(some):
            size = self.degree[some]
            at, first = np.repeat(self.first[some], size) + _ranges(size), np.cumsum(size) - size
            base = base[at]
            counts = np.stack([np.add.reduceat((base == c).astype(np.int64), first) for c in ORDER])
            second = np.sort(counts, axis=0)[-2]
            two[some], fifth[some] = second > 0, 5 * second >= size
            off[at] = base != np.repeat(ORDER[counts.argmax(axis=0)], size)
        return two, fifth, off

    def condemned(self) -> np.ndarray:
        """The distinct reads that a one-sided branch makes bad."""
        (two_p, fifth_p, off_p), (two_n, fifth_n, off_n) = self.sides
        left, right = two_p & ~two_n, two_n & ~two_p
        hit = (left & fifth_p | right & fifth_n)[self.group] | left[self.group] & off_p | right[self.group] & off_n
        return np.unique(self.read[hit])

    def sets(self, min_degree: int | None, max_degree: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(reads, sizes, members): the distinct sets of two reads or more that share a linking k-mer. Members are places in
        ``reads``, which ascend, set by set and ascending in each. Neighbouring k-mers mostly have one set."""
        (two_p, _, _), (two_n, _, _) = self.sides
        links = ~(two_p & two_n) & (self.kmer != 0) & (self.degree >= max(2, int(min_degree or 2)))
        if max_degree:
            links &= self.degree < int(max_degree)
        live = links[self.group]
        group, read = self.group[live], self.read[live]
        low = read.min() if len(read) else 0
        wide = int(read.max() - low).bit_length() if len(read) else 0
        ids = None
        if wide + len(self.degree).bit_length() > 62:  # ids too far apart to be sorted with their k-mer's number
            ids, read = np.unique(read, return_inverse=True)
            low, wide = 0, len(ids).bit_length()
        pair = np.sort(group << wide | read - low)
        pair = pair[np.diff(pair, prepend=-1) != 0]
        group, read = pair >> wide, (pair & (1 << wide) - 1) + low
        first = np.flatnonzero(np.diff(group, prepend=-1))
        size = np.diff(np.r_[first, len(group)])
        first, size = first[size > 1], size[size > 1]
        if not len(first):
            return read[:0], size.astype(np.int32), read[:0].astype(np.int32)
        mixed = (read.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        mixed = np.r_[np.uint64(0), np.cumsum(mixed ^ mixed >> np.uint64(32))]
        mixed = mixed[first + size] - mixed[first]
        order = np.lexsort((mixed, size))
        first, size, mixed = first[order], size[order], mixed[order]
        # only a set that equals the one before it, read by read, is left out
        like = np.flatnonzero((size[1:] == size[:-1]) & (mixed[1:] == mixed[:-1])) + 1
        new = np.ones(len(first), bool)
        if len(like):
            within = _ranges(size[like])
            equal = read[np.repeat(first[like], size[like]) + within] == read[np.repeat(first[like - 1], size[like]) + within]
            new[like] = ~np.logical_and.reduceat(equal, np.cumsum(size[like]) - size[like])
        first, size = first[new], size[new]
        used, member = np.unique(read[np.repeat(first, size) + _ranges(size)], return_inverse=True)
        return used if ids is None else ids[used], size.astype(np.int32), member.astype(np.int32)


def _ranges(size: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each size, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def set_stars(reads: np.ndarray, sizes: np.ndarray, members: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct edges from the largest read of each set (see Groups.sets), without bad reads, to its others."""
    live = ~np.isin(reads, bad)[members]
    group, read = np.repeat(np.arange(len(sizes)), sizes)[live], members[live].astype(np.int64)
    if not len(group):
        return reads[:0], reads[:0]
    last = np.r_[np.flatnonzero(np.diff(group)), len(group) - 1]
    centre = np.repeat(read[last], np.diff(np.r_[-1, last]))
    pair = np.unique(centre[centre != read] * len(reads) + read[centre != read])
    return reads[pair // len(reads)], reads[pair % len(reads)]


class Tally:
    """Statistics of all k-mers, also of those seen once (see branch_filter). Columns with a row per k-mer are in the order in
    which k-mers first stand in runs: neighbours share all bases but one, so that files of them compress well."""

    def __init__(self, read: np.ndarray, bad: np.ndarray, kmer: np.ndarray, prev: np.ndarray, after: np.ndarray):
        order = together(kmer)
        kmer = kmer[order]
        self.first = np.flatnonzero(np.r_[True, kmer[1:] != kmer[:-1]])
        self.kmer, self.degree = kmer[self.first].view(np.int64), np.diff(np.r_[self.first, len(kmer)])
        self.order, self.read, self.sides = order, read, (prev, after)

    def reads(self) -> np.ndarray:
        """Distinct reads of each k-mer."""
        again = np.repeat(self.degree > 1, self.degree)
        ids, read = np.unique(self.read[self.order[again]], return_inverse=True)
        group = np.repeat(np.arange(len(self.degree)), self.degree)[again]
        pairs = np.sort(group * max(1, len(ids)) + read)
        own = pairs[np.r_[True, pairs[1:] != pairs[:-1]]] // max(1, len(ids)) if len(pairs) else pairs
        return np.where(self.degree == 1, 1, np.bincount(own, minlength=len(self.degree)))

    def _side(self, base: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of bases, the most frequent one and the count of the second."""
        base = base[self.order]
        counts = np.stack([np.add.reduceat((base == c).astype(np.int32), self.first) for c in ORDER])
        n = (counts > 0).sum(axis=0, dtype=np.int32)
        return n, ORDER[counts.argmax(axis=0)].astype(np.int8), np.sort(counts, axis=0)[-2].astype(np.int64)

    def _by_run(self, *columns: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(self.order[self.first])  # equal k-mers stand in the order of their places
        return [x[order] for x in columns]

    def counts(self) -> list:
        return self._by_run(self.kmer, self.degree, self.reads())

    def degrees(self) -> list:
        return self._by_run(self.kmer, self.reads())

    def distribution(self) -> list:
        return list(np.unique(self.reads(), return_counts=True))

    def branches(self) -> list:
        out = self._by_run(self.kmer, self.degree, np.maximum.reduceat(self.read[self.order], self.first))
        for base in self.sides:
            n, top, second = self._by_run(*self._side(base))
            out += [n, pa.array(top, mask=n == 0), second]
        return out

    def ambiguous(self) -> list:
        several = np.logical_and(*(self._side(base)[0] > 1 for base in self.sides))
        return [self.kmer[several]]

    def mischief(self) -> list:
        found = [(n > 1) & (5 * second >= 2 * self.degree) for n, _, second in map(self._side, self.sides)]
        return [np.array([np.count_nonzero(found[0] & found[1])])]


def _met(k: int, held: int, names: list[str], found: Callable[..., list]):
    """Packed rows of runs, sorted by bucket_range -> what is found in the k-mers of some whole buckets at a time."""

    def lots(parts: list[tuple[np.ndarray, ...]]) -> Iterator[pa.RecordBatch]:
        bucket, *runs = map(np.concatenate, zip(*parts))
        order = np.argsort(bucket, kind="stable")
        first = np.flatnonzero(np.diff(bucket[order], prepend=-1))
        cuts, size = [0], 0
        for at, n in zip(first, np.add.reduceat(runs[1][order].astype(np.int64), first)):
            if 2 * size >= held:
                cuts.append(at)
                size = 0
            size += n
        cuts.append(len(bucket))
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = runs if len(cuts) == 2 else taken(k, order[a:b], *runs)
            columns = found(*unpacked_runs(k, *own))
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, last = [], 0, None
        for batch in batches:
            for span, buckets, n, raw, runs in zip(*(batch.column(c).to_pylist() for c in ("bucket_range", "buckets", "n", "size", "runs"))):
                if span != last and 2 * size >= held:
                    yield from lots(parts)
                    parts, size = [], 0
                parts.append(unsqueezed(np.array(buckets, np.int64), raw, runs))
                last, size = span, size + sum(n)
        if parts:
            yield from lots(parts)

    return run


def _dealt(runs: DataFrame, tasks: int) -> DataFrame:
    return runs.repartition(tasks, F.xxhash64("bucket_range")).sortWithinPartitions("bucket_range")


def bucket_occurrences(reads: DataFrame, k: int, buckets: int, only: np.ndarray) -> DataFrame:
    """The occurrences (read_id, kmer, prev, next) whose minimizer falls in one of the buckets ``only`` (sorted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = base_codes(batch)
            read_id = batch.column("read_id").to_numpy(zero_copy_only=False)
            for a in range(0, len(codes), SLICE):
                b = min(a + SLICE, len(codes))
                position, *found = windows(codes, ends, k, a, b)
                if len(position):
                    hot = np.isin(minimizer_buckets(codes[a : b + k - 1], k, position - a, buckets), only)
                    yield kmer_rows(read_id, k, *(x[hot] for x in found))

    return map_arrow(long_reads(reads, k), run, kmer_schema(k))


class Dealt:
    """The k-mers of reads (a stored table) dealt by minimizer; k is 31 at most.

    buckets: their number, so that one holds a quarter of what a task sorts, on average. hot: the buckets that hold more
    than that, a list no longer than the k-mers over ``held``. cold: the stored runs of all others.
    """

    def __init__(self, reads: DataFrame, k: int, held: int = HELD):
        if k > PACKED:
            raise ValueError(f"runs hold k-mers of {PACKED} bases at most")
        spark = reads.sparkSession
        self.reads, self.k, self.held = reads, k, held
        bases = reads.agg(F.sum(F.length("seq"))).first()[0] or 0
        self.buckets = max(1, 4 * bases // held)
        self.tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), bases // TASK)
        self.runs = materialize(kmer_runs(reads, k, self.buckets, span=-(-self.buckets // ROWS)), "runs")
        counts = self.runs.select(F.explode(F.arrays_zip("buckets", "n")).alias("x")).select("x.*")
        found = counts.groupBy("buckets").agg(F.sum("n").alias("n")).where(F.col("n") > held).select("buckets").collect()
        self.hot = np.array(sorted(r.buckets for r in found), np.uint64)
        self.cold = map_arrow(self.runs, _without(k, self.hot.astype(np.int64)), PACKED_RUNS) if len(self.hot) else self.runs

    def hot_occurrences(self) -> DataFrame | None:
        return bucket_occurrences(self.reads, self.k, self.buckets, self.hot) if len(self.hot) else None

    def tallied(self, schema: str, found: Callable[[Tally], list]) -> DataFrame:
        """What ``found`` makes of the statistics of cold k-mers; each k-mer is in one task."""
        names = [c.split()[0] for c in schema.split(", ")]
        return map_arrow(_dealt(self.cold, self.tasks), _met(self.k, self.held, names, lambda *x: found(Tally(*x))), schema)

    def condemned(self) -> DataFrame:
        """(read_id): reads that a one-sided branch of a cold k-mer makes bad; a read may come from several tasks."""
        return map_arrow(_dealt(self.cold, self.tasks), _met(self.k, self.held, ["read_id"], lambda *x: [Groups(*x).condemned()]), "read_id long")

    def linked(self, min_degree: int | None = None, max_degree: int | None = None) -> DataFrame:
        """(met, condemned, reads, sizes, members), stored: a row for every lot of k-mers that a task sorts, with the reads that
        they condemn and the sets of reads that they link, bad ones included (see Groups.sets)."""
        row = lambda x: pa.ListArray.from_arrays(np.array([0, len(x)], np.int32), pa.array(x))

        def found(*x) -> list:
            groups = Groups(*x)
            reads, sizes, members = groups.sets(min_degree, max_degree)
            return [row(groups.condemned()), row(reads), [sizes.tobytes()], [members.tobytes()]]

        rows = map_arrow(_dealt(self.cold, self.tasks), _met(self.k, self.held, MET, found), "condemned array<long>, reads array<long>, sizes binary, members binary")
        return materialize(rows.withColumn("met", F.monotonically_increasing_id()), "met")

    def stars(self, linked: DataFrame, bad: DataFrame) -> DataFrame:
        """(u, v): star edges of the cold k-mers between reads that aren't bad; an edge may come from several tasks.

        A lot gets those of its own reads that are bad, and takes the stars of its sets without them: no k-mer is sorted
        again, and no more rows are shuffled than lots have reads."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(batch.num_rows):
                    reads, bad = (batch.column(c)[i].values for c in ("reads", "bad"))
                    sizes, members = (np.frombuffer(batch.column(c)[i].as_py(), np.int32) for c in ("sizes", "members"))
                    gone = np.empty(0, np.int64) if bad is None else bad.to_numpy(zero_copy_only=False)
                    yield pa.RecordBatch.from_arrays([*map(pa.array, set_stars(reads.to_numpy(zero_copy_only=False), sizes, members, gone))], names=["u", "v"])

        sets = linked.where(F.size("reads") > 0).select("met", "reads", "sizes", "members")
        marks = sets.select("met", F.explode("reads").alias("read_id")).join(bad, "read_id").groupBy("met").agg(F.collect_list("read_id").alias("bad"))
        return map_arrow(sets.join(marks, "met", "left").select("reads", "sizes", "members", "bad"), run, "u long, v long")
