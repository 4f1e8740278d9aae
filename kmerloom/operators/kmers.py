"""K-mer enumeration: reads exploded into canonical k-mers with their neighbour bases.

Cutting a window at every position as a string copies k bytes for every base, and again for the reverse strand. Here
k-mers are base-4 numbers, built in Arrow batches by doubling: the numbers of 2, 4, 8 ... bases from all positions on
come from those of half as many, forward and in reverse. A slice of positions is worked on at a time, wherever reads
begin and end, so a read may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.arrow import map_arrow
from kmerloom.functions.dna import BASES, PACKED, PREFIX, bucket

MIN_K, MAX_K = 2, 1 << 15
#: Positions of a slice of packed windows; bytes of one of longer windows; positions of the reads that give minimizers.
SLICE, TEXT_BYTES, READS = 1 << 17, 1 << 23, 1 << 18
UNKNOWN = BASES.index("N")
CODES = np.full(256, UNKNOWN, np.uint8)
for _letters in (b"ACGT", b"acgt"):
    CODES[list(_letters)] = range(4)
COMPLEMENT = np.array([3, 2, 1, 0, UNKNOWN], np.uint8)


def check_k(k: int) -> None:
    if not MIN_K <= k <= MAX_K:
        raise ValueError(f"k must be between {MIN_K} and {MAX_K}")


def base_codes(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The bases of all reads in a row, and where each read ends. A letter of several bytes is one unknown base."""
    text = batch.column("seq").cast(pa.large_string())
    _, offsets, data = text.buffers()
    at = np.frombuffer(offsets, np.int64)[text.offset : text.offset + len(text) + 1]
    letters = np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    ends = at[1:] - at[0]
    if len(letters) and letters.max() > 127:
        first = (letters & 0xC0) != 0x80
        ends = np.r_[0, np.cumsum(first)][ends]
        letters = letters[first]
    return CODES[letters], ends


def packed(digits: np.ndarray, k: int, reverse: bool) -> np.ndarray:
    """Base-4 numbers of the k digits from every position on, in the digits' type; in reverse the first digit counts least."""
    n, out, done, size, power, bits = len(digits) - k + 1, None, 0, 1, digits, digits.dtype.type
    while True:
        if k & size:
            part, wide = power[done : done + n], bits(2 * size)
            out = part if out is None else out | part << bits(2 * done) if reverse else out << wide | part
            done += size
        if 2 * size > k:
            return out
        wide = bits(2 * size)
        power = power[:-size] | power[size:] << wide if reverse else power[:-size] << wide | power[size:]
        size *= 2


def _strands(codes: np.ndarray, k: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The windows at the positions ``at`` and their reverse complements: numbers, or bytes if k is too long for those."""
    if k <= PACKED:
        digits = codes.astype(np.uint64) & np.uint64(3)
        return packed(digits, k, False)[at], packed(digits ^ np.uint64(3), k, True)[at]
    letters = np.frombuffer(BASES.encode(), np.uint8)
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x, k)[at]
    text = lambda x: np.ascontiguousarray(x).view(f"S{k}")[:, 0]
    return text(cut(letters[codes])), text(cut(letters[COMPLEMENT[codes]])[:, ::-1])


def free_windows(codes: np.ndarray, ends: np.ndarray, k: int, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, read) of the N-free windows that begin at positions a to b; codes as of base_codes."""
    low, high = np.searchsorted(ends, [a, b], side="right")
    high = min(high + 1, len(ends))
    sizes = np.diff(np.clip(ends[low:high], a, b), prepend=a)
    read = np.repeat(np.arange(low, high), sizes)
    position = np.arange(a, a + len(read))
    unknown = np.cumsum(np.r_[0, codes[a : b + k - 1] == UNKNOWN], dtype=np.int32)
    able = np.flatnonzero(position + k <= ends[read])
    able = able[unknown[able + k] == unknown[able]]
    return position[able], read[able]


def windows(codes: np.ndarray, ends: np.ndarray, k: int, a: int, b: int) -> tuple[np.ndarray, ...]:
    """(position, read, kmer, prev, next) of the N-free windows that begin at positions a to b; codes as of base_codes."""
    position, read = free_windows(codes, ends, k, a, b)
    if not len(position):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.uint64 if k <= PACKED else f"S{k}", np.uint8, np.uint8))
    starts = np.r_[0, ends[:-1]]
    prev = np.where(position == starts[read], UNKNOWN, codes[position - 1])
    after = np.where(position + k == ends[read], UNKNOWN, codes[np.minimum(position + k, len(codes) - 1)])
    forward, back = _strands(codes[a : b + k - 1], k, position - a)
    straight = forward < back
    kmer = np.where(straight, forward, back)
    return position, read, kmer, np.where(straight, prev, COMPLEMENT[after]), np.where(straight, after, COMPLEMENT[prev])


def _kmer_array(kmer: np.ndarray, k: int) -> pa.Array:
    if k <= PACKED:
        return pa.array(kmer.view(np.int64))
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(k), len(kmer), [None, pa.py_buffer(np.ascontiguousarray(kmer))]).cast(pa.binary()).cast(pa.string())


def kmer_rows(read_id: np.ndarray, k: int, read, kmer, prev, after, neighbours: bool = True) -> pa.RecordBatch:
    columns = {"read_id": pa.array(read_id[read]), "kmer": _kmer_array(kmer, k)}
    if neighbours:
        columns |= {"prev": pa.array(prev.astype(np.int8)), "next": pa.array(after.astype(np.int8))}
    return pa.RecordBatch.from_pydict(columns)


def kmer_schema(k: int, neighbours: bool = True) -> str:
    return f"read_id long, kmer {'long' if k <= PACKED else 'string'}" + (", prev tinyint, next tinyint" if neighbours else "")


def long_reads(reads: DataFrame, k: int) -> DataFrame:
    check_k(k)
    return reads.where(F.length("seq") > k).select(F.col("read_id").cast("long"), "seq")


def kmer_occurrences(reads: DataFrame, k: int = 27, neighbours: bool = True) -> DataFrame:
    """(read_id, kmer[, prev, next]), a row per N-free window of every read longer than k.

    kmer is the smaller of window and reverse complement (see functions.dna for its type). prev and next are the numbers
    of the bases beside it in that orientation, N at the ends of a read and beside ambiguous bases; a palindrome takes
    the reverse strand. Any letter other than A, C, G and T, of either case, is N. Null reads have no k-mer.
    """
    step = SLICE if k <= PACKED else max(1, TEXT_BYTES // k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = base_codes(batch)
            read_id = batch.column("read_id").to_numpy(zero_copy_only=False)
            for a in range(0, len(codes), step):
                _, *found = windows(codes, ends, k, a, min(a + step, len(codes)))
                yield kmer_rows(read_id, k, *found, neighbours)

    return map_arrow(long_reads(reads, k), run, kmer_schema(k, neighbours))


def _third_starts(position: np.ndarray, read: np.ndarray, ends: np.ndarray, k: int) -> np.ndarray:
    """Where, in windows sorted by position, the run of every minimizer begins."""
    reads, first, counts = np.unique(read, return_index=True, return_counts=True)
    begin = np.r_[0, ends[:-1]][reads]
    last = ends[reads] - k - begin
    third, stop, at = last // 3, first + counts, first - 1
    until, found = third.copy(), [first]
    while len(at):
        at = np.maximum(np.searchsorted(position, begin + until + 1), at + 1)
        live = at < stop
        begin, last, third, stop, at, until = (x[live] for x in (begin, last, third, stop, at, until))
        found.append(at)
        until = np.where(until + 2 * third > last, last, until + third)
    return np.unique(np.concatenate(found))


def folded_minimizers(codes: np.ndarray, k: int, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kmer, prev, next) of the minimizers of one read, slice by slice of ``step`` positions.

    Between slices only the open window is carried: its end and the least k-mer in it so far.
    """
    ends, last = np.array([len(codes)]), len(codes) - k
    third = last // 3
    until, low, found = third, None, []
    for a in range(0, len(codes), step):
        position, _, kmer, prev, after = windows(codes, ends, k, a, min(a + step, len(codes)))
        real, i = kmer != (0 if k <= PACKED else b"A" * k), 0
        while i < len(position):
            if position[i] > until:
                found += [low] if low else []
                low, until = None, last if until + 2 * third > last else until + third
            j = max(i + 1, int(np.searchsorted(position, until + 1)))
            own = i + np.flatnonzero(real[i:j])
            if len(own):
                best = own[kmer[own].argmin() if k <= PACKED else np.argsort(kmer[own], kind="stable")[0]]
                if low is None or kmer[best] < low[0]:
                    low = kmer[best], prev[best], after[best]
            i = j
    found += [low] if low else []
    kinds = np.uint64 if k <= PACKED else f"S{k}", np.uint8, np.uint8
    return tuple(np.array([x[c] for x in found], kind) for c, kind in enumerate(kinds))


def minimizers3(reads: DataFrame, k: int = 27) -> DataFrame:
    """(read_id, kmer, prev, next): the least canonical k-mer of each third of a read, three rows a read as a rule.

    Windows end at last/3, then a third on, then at the last position; N-free k-mers are taken in order and a window
    advances one step per k-mer that lies beyond its end, so gaps of N shift it. A k-mer of A only is never a minimum;
    of equal ones the first counts. Reads are taken many at once; one longer than a slice is folded over its slices.
    """
    step = READS if k <= PACKED else max(1, TEXT_BYTES // k)

    def least(codes: np.ndarray, ends: np.ndarray, a: int, b: int) -> tuple[np.ndarray, ...] | None:
        position, read, kmer, prev, after = windows(codes, ends, k, a, b)
        if not len(read):
            return None
        starts = _third_starts(position, read, ends, k)
        rank = kmer if k <= PACKED else np.unique(kmer, return_inverse=True)[1].astype(np.uint64)
        rank = np.where(kmer == (0 if k <= PACKED else b"A" * k), np.uint64(2**64 - 1), rank)
        low = np.minimum.reduceat(rank, starts)
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(rank)]))
        hit = np.flatnonzero((rank == low[group]) & (rank != np.uint64(2**64 - 1)))
        pick = hit[np.unique(group[hit], return_index=True)[1]]
        return read[pick], kmer[pick], prev[pick], after[pick]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, ends = base_codes(batch)
            read_id = batch.column("read_id").to_numpy(zero_copy_only=False)
            long = np.flatnonzero(np.diff(ends, prepend=0) > step)
            edges = np.unique(np.r_[0, ends[np.flatnonzero(np.diff(ends // step))], ends[long], np.r_[0, ends][long], len(codes)])
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                read = int(np.searchsorted(ends, a, side="right"))
                if ends[read] == b and b - a > step:
                    kmer, prev, after = folded_minimizers(codes[a:b], k, step)
                    if len(kmer):
                        yield kmer_rows(read_id, k, np.full(len(kmer), read), kmer, prev, after)
                elif found := least(codes, ends, a, b):
                    yield kmer_rows(read_id, k, *found)

    return map_arrow(long_reads(reads, k), run, kmer_schema(k))


def with_bucket(occurrences: DataFrame, k: int, bases: int = PREFIX) -> DataFrame:
    return occurrences.withColumn("bucket", bucket(F.col("kmer"), k, bases))


def canonical_counts(occurrences: DataFrame) -> DataFrame:
    """(kmer, n, reads): occurrences and distinct reads of each k-mer."""
    return occurrences.groupBy("kmer", "read_id").agg(F.count("*").alias("n")).groupBy("kmer").agg(F.sum("n").alias("n"), F.count("*").alias("reads"))
