"""Super-k-mers against plain Python: runs hold every k-mer once, and link and condemn what rows of k-mers do."""

import random

import numpy as np
import plain
import pyarrow as pa
import pytest

from kmerloom.operators import superkmers
from kmerloom.operators.kmers import base_codes
from kmerloom.plans.partition_reads import condemned_reads, link_reads
from kmerloom.storage import materialize

COMPLEMENT = str.maketrans("ACGT", "TGCA")


def some_reads(seed, n=150, size=60):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(500)) + "ACACACAC" * 8 + "A" * 40
    out = []
    for _ in range(n):
        at = rng.randrange(len(genome) - 10)
        s = list(genome[at : at + rng.randrange(5, size)])
        for _ in range(rng.choice([0, 0, 1, 2])):
            s[rng.randrange(len(s))] = rng.choice("ACGTNn-é")
        s = "".join(s)
        out.append(s.translate(COMPLEMENT)[::-1] if rng.random() < 0.5 else s)
    return out + ["", None, "ACGT", "N" * 50, "acgtac" * 12]


def frame(spark, seqs):
    return spark.createDataFrame([(i, s) for i, s in enumerate(seqs)], "read_id long, seq string").repartition(4)


def number(kmer):
    return int(kmer.translate(str.maketrans("ACGT", "0123")), 4)


def test_minimizers_grow_with_the_buckets():
    assert [superkmers.minimizer_bases(27, b) for b in (1, 10**6, 10**7, 10**8, 10**10)] == [13, 13, 15, 16, 16]
    assert [superkmers.minimizer_bases(k, 10**9) for k in (2, 3, 8, 20, 31)] == [1, 2, 4, 10, 16]


@pytest.mark.parametrize("k,buckets", [(3, 7), (8, 16), (27, 50), (27, 10**8), (31, 3), (31, 10**9)])
def test_runs_hold_every_kmer_once(spark, k, buckets):
    seqs = some_reads(k, 60)
    found, home = [], {}
    for r in superkmers.kmer_runs(frame(spark, seqs), k, buckets).collect():
        read, bad, kmer, prev, after = superkmers.unpacked_runs(k, *map(bytes, (r.reads, r.counts, r.sides, r.bases)))
        assert not bad.any() and len(read) == r.n
        found += zip(read.tolist(), kmer.tolist(), ("ACGTN"[x] for x in prev), ("ACGTN"[x] for x in after))
        for x in kmer.tolist():
            assert home.setdefault(x, r.bucket) == r.bucket < buckets  # all occurrences meet
    assert sorted(found) == sorted((i, number(x), p, n) for i, s in enumerate(seqs) for _, x, p, n in plain.canonical(s or "", k))


def test_a_kmer_and_its_reverse_complement_share_a_bucket():
    rng = random.Random(3)
    for k in (2, 5, 27, 31):
        for _ in range(50):
            s = "".join(rng.choice("ACGT") for _ in range(k))
            at, found = np.array([0]), []
            for x in (s, s.translate(COMPLEMENT)[::-1]):
                codes, _ = base_codes(pa.RecordBatch.from_pydict({"seq": [x]}))
                found.append(int(superkmers.minimizer_buckets(codes, k, at, 1 << 20)[0]))
            assert found[0] == found[1]


def expected(seqs, k, low=2, high=10**9):
    occurrences = [(i, x, p, n) for i, s in enumerate(seqs) for _, x, p, n in plain.canonical(s or "", k)]
    ambiguous, bad = plain.branch(occurrences)
    groups, degree = {}, {}
    for r, x, _, _ in occurrences:
        degree[x] = degree.get(x, 0) + 1
        if r not in bad and x not in ambiguous and x != "A" * k:
            groups.setdefault(x, set()).add(r)
    return bad, {(max(g), r) for x, g in groups.items() if low <= degree[x] < high for r in g if r != max(g)}


@pytest.mark.parametrize("held", [40, 3000, superkmers.HELD])
def test_links_and_bad_reads(spark, held):
    """With 40 held most buckets are hot and go by rows, with 3000 some, else none."""
    for seed, k in ((1, 8), (2, 27)):
        seqs = some_reads(seed)
        reads = materialize(frame(spark, seqs), "reads")
        linked = link_reads(reads, k, held=held)
        bad, edges = expected(seqs, k)
        assert {r.read_id for r in linked.bad.collect()} == bad
        got = [tuple(r) for r in linked.edges.select("u", "v").collect()]
        assert len(got) == len(set(got)) and set(got) == edges
        assert {r.read_id for r in condemned_reads(reads, k).collect()} == bad
        hot = len(superkmers.Dealt(reads, k, held).hot)
        assert hot > 0 if held == 40 else hot == 0 if held == superkmers.HELD else True


def test_degree_limits(spark):
    seqs = some_reads(5)
    for held in (40, superkmers.HELD):
        got = link_reads(materialize(frame(spark, seqs), "reads"), 8, min_degree=3, max_degree=6, held=held).edges
        assert {tuple(r) for r in got.select("u", "v").collect()} == expected(seqs, 8, 3, 6)[1]


def test_long_reads_are_cut_at_slices(spark):
    seqs = ["".join(random.Random(9).choice("ACGT") for _ in range(3 * superkmers.SLICE)), "ACGT" * 100]
    runs = superkmers.kmer_runs(frame(spark, seqs), 27, 1 << 16)
    assert runs.groupBy().sum("n").first()[0] == sum(len(s) - 26 for s in seqs)
    ends = runs.where("n > 0").selectExpr("length(reads) / 8 AS r", "length(counts) / 4 AS c", "length(sides) AS s").where("r <> c OR c <> s").count()
    assert ends == 0


def test_no_reads(spark):
    none = materialize(spark.createDataFrame([], "read_id long, seq string"), "reads")
    linked = link_reads(none, 8)
    assert linked.bad.count() == 0 and linked.edges.count() == 0


def test_equal_kmers_come_together():
    """With leading hash bits shared by different k-mers too."""
    g = np.random.default_rng(2)
    odd, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    close = np.array([(h * inverse) & (1 << 64) - 1 for h in range(500)], np.uint64)  # their products with odd differ in low bits only
    for kmer in (g.integers(0, 50, 3000).astype(np.uint64), g.choice(close, 3000), np.zeros(5, np.uint64), np.empty(0, np.uint64), g.integers(0, 1 << 62, 9, dtype=np.uint64)):
        order = superkmers.together(kmer)
        assert sorted(order.tolist()) == list(range(len(kmer)))
        own = kmer[order]
        assert 1 + (own[1:] != own[:-1]).sum() == len(np.unique(kmer)) if len(kmer) else True
    assert odd * inverse % (1 << 64) == 1


def test_runs_longer_than_a_piece(spark):
    seqs = ["ACGGT" * 200, "A" * 500, "ACGTTGCA" * 90 + "N" + "ACGTTGCA" * 90]
    found = []
    for r in superkmers.kmer_runs(frame(spark, seqs), 27, 1).collect():
        read, _, kmer, prev, after = superkmers.unpacked_runs(27, *map(bytes, (r.reads, r.counts, r.sides, r.bases)))
        found += zip(read.tolist(), kmer.tolist(), ("ACGTN"[x] for x in prev), ("ACGTN"[x] for x in after))
    assert sorted(found) == sorted((i, number(x), p, n) for i, s in enumerate(seqs) for _, x, p, n in plain.canonical(s, 27))


@pytest.mark.parametrize("far", [1, 10**13])
def test_sets_of_linked_reads(far):
    """The stars of what the sets are, for any bad reads; equal sets once; ids far apart too."""
    rng = np.random.default_rng(5)
    kmer = np.r_[rng.integers(0, 40, 300), np.repeat(np.arange(50, 60), 3)].astype(np.uint64)
    read = np.r_[rng.integers(0, 30, 300), np.tile([31, 32, 33], 10)] * far
    prev, after = (np.where(rng.random(len(kmer)) < 0.2, rng.integers(0, 5, len(kmer)), 1).astype(np.uint8) for _ in range(2))
    groups = superkmers.Groups(read, np.zeros(len(kmer), bool), kmer, prev, after)
    ids, sizes, members = groups.sets(None, None)
    found = [tuple(x) for x in np.split(ids[members], np.cumsum(sizes)[:-1])]
    several = lambda x, side: len({int(b) for b, y in zip(side, kmer) if y == x and b < 4}) > 1
    live = [int(x) for x in np.unique(kmer) if x and not (several(x, prev) and several(x, after))]
    sets = {t for x in live if len(t := tuple(sorted({int(r) for r, y in zip(read, kmer) if y == x}))) > 1}
    assert len(found) == len(set(found)) and set(found) == sets and (31 * far, 32 * far, 33 * far) in sets
    for bad in ([], [33 * far], list(range(0, 30 * far, 2 * far))[:15]):
        u, v = superkmers.set_stars(ids, sizes, members, np.array(bad, np.int64))
        left = [[r for r in s if r not in bad] for s in sets]
        assert sorted(zip(u.tolist(), v.tolist())) == sorted({(s[-1], r) for s in left if s for r in s[:-1]})


@pytest.mark.parametrize("span", [1, 3, 1000])
def test_packed_rows_hold_the_same_runs(spark, span):
    """Rows of some neighbouring buckets each, and those without hot ones."""
    seqs, buckets = some_reads(7) + ["ACGGT" * 200], 50
    plain_rows = superkmers.kmer_runs(frame(spark, seqs), 27, buckets).collect()
    rows = superkmers.kmer_runs(frame(spark, seqs), 27, buckets, span=span)
    hot = np.array(sorted({r.bucket for r in plain_rows})[::2], np.int64)
    for found, out in ((rows, []), (rows.mapInArrow(superkmers._without(27, hot), superkmers.PACKED_RUNS), hot.tolist())):
        got, count = [], {}
        for r in found.collect():
            assert {b // span for b in r.buckets} == {r.bucket_range} and not set(r.buckets) & set(out)
            bucket, *runs = superkmers.unsqueezed(np.array(r.buckets), r.size, bytes(r.runs))
            assert sorted(set(bucket.tolist())) == r.buckets
            read, bad, kmer, prev, after = superkmers.unpacked_runs(27, *runs)
            got += zip(read.tolist(), kmer.tolist(), prev.tolist(), after.tolist())
            for b, n in zip(r.buckets, r.n):
                count[b] = count.get(b, 0) + n
        want, total = [], {}
        for r in plain_rows:
            if r.bucket not in out:
                read, _, kmer, prev, after = superkmers.unpacked_runs(27, *map(bytes, (r.reads, r.counts, r.sides, r.bases)))
                want += zip(read.tolist(), kmer.tolist(), prev.tolist(), after.tolist())
                total[r.bucket] = total.get(r.bucket, 0) + r.n
        assert sorted(got) == sorted(want) and count == total


def test_rows_get_no_shorter_with_more_buckets(spark, monkeypatch):
    """A task makes a row per range of buckets, and reads more often stored than a bucket each."""
    monkeypatch.setattr(superkmers, "ROWS", 3)
    dealt = superkmers.Dealt(materialize(frame(spark, some_reads(6)).coalesce(1), "reads"), 27, 300)
    assert dealt.buckets > 30 and dealt.runs.count() <= 4 * 3
    assert dealt.runs.selectExpr("max(size(buckets)) AS n").first().n > 1


@pytest.mark.parametrize("held", [40, 300, 3000])
def test_links_with_several_buckets_in_a_row(spark, monkeypatch, held):
    monkeypatch.setattr(superkmers, "ROWS", 5)
    seqs = some_reads(1)
    linked = link_reads(materialize(frame(spark, seqs), "reads"), 8, held=held)
    bad, edges = expected(seqs, 8)
    assert {r.read_id for r in linked.bad.collect()} == bad
    assert {tuple(r) for r in linked.edges.select("u", "v").collect()} == edges


def test_kmers_come_run_by_run():
    """Neighbours of a run stay neighbours, also in runs of several pieces and beside shorter ones."""
    rng = random.Random(8)
    seqs = ["".join(rng.choice("ACGT") for _ in range(n)) for n in (40, 400, 28, 90)]
    codes = [np.array(["ACGT".index(c) for c in s] + [0] * (-len(s) % 4), np.uint8).reshape(-1, 4) @ np.array([64, 16, 4, 1], np.uint8) for s in seqs]
    counts = np.array([len(s) - 26 for s in seqs], np.int32)
    found = superkmers.unpacked_runs(27, np.arange(4).tobytes(), counts.tobytes(), bytes([24] * 4), np.concatenate(codes).astype(np.uint8).tobytes())
    want = [number(x) for s in seqs for _, x, _, _ in plain.canonical(s, 27)]
    assert found[2].tolist() == want and found[0].tolist() == np.repeat(np.arange(4), counts).tolist()
    tally = superkmers.Tally(*found)
    first = list(dict.fromkeys(want))
    for columns in (tally.degrees(), tally.counts(), tally.branches()):
        assert np.asarray(columns[0]).tolist() == first
