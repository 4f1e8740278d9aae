"""Read operators against plain Python on hand-made and random reads."""

import random
import tracemalloc

import numpy as np
import plain
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kmerloom.functions import dna
from kmerloom.operators import branch_filter, histograms, kmers, links, mates, stats
from kmerloom.operators.binpack import component_partitions, partition_manifest
from kmerloom.operators.prefix import dense_ids, exclusive_sum
from kmerloom.plans.partition_reads import partition_reads

quick = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
READS = "read_id long, mate_id long, seq string, record string"


def frame(spark, seqs, mated=False):
    return spark.createDataFrame([(i, (i ^ 1 if (i ^ 1) < len(seqs) else None) if mated else None, s, f"@r{i}\n{s}\n+\n{chr(73) * len(s or str())}") for i, s in enumerate(seqs)], READS)


def random_reads(seed, n=60, k=8):
    rng = random.Random(seed)
    genome = "".join(rng.choice("ACGT") for _ in range(400))
    out = []
    for _ in range(n):
        at, size = rng.randrange(360), rng.randrange(k - 2, 40)
        s = list(genome[at : at + size])
        if rng.random() < 0.3:
            s[rng.randrange(len(s))] = rng.choice("ACGTNn-")
        s = "".join(s)
        out.append(s.translate(plain.COMPLEMENT)[::-1] if rng.random() < 0.5 else s)
    return out


CASES = ["ACGTACG", "ACGTACGT", "ACGTACGTA", "ACGTNACGTTGCA", "acgtacgtac", "A" * 15, "T" * 15, "", "NNNNNNNNNNNN", "ACGTTGCAAT-GCATTGCA", "GATTACAGATTACA", "ACGTÉGTACGTTGAA€CGTACGATTG", None]


def spelled(df, k):
    text = {"kmer": dna.kmer_text(F.col("kmer"), k)} | {c: dna.base_text(F.col(c)) for c in ("prev", "next")}
    return sorted(tuple(r) for r in df.select("read_id", *(x.alias(c) for c, x in text.items())).collect())


@pytest.mark.parametrize("k,step", [(4, 1 << 17), (7, 5), (8, 1 << 17), (31, 50), (32, 50), (33, 1 << 17), (40, 7)])
def test_occurrences(spark, monkeypatch, k, step):
    """Packed and long k-mers, in slices that cut reads anywhere."""
    monkeypatch.setattr(kmers, "SLICE", step)
    monkeypatch.setattr(kmers, "TEXT_BYTES", step * k)
    rng = random.Random(k)
    seqs = CASES + random_reads(1) + ["".join(rng.choice("ACGT" * 20 + "N") for _ in range(300)) for _ in range(3)]
    got = spelled(kmers.kmer_occurrences(frame(spark, seqs), k), k)
    assert got == sorted((r, *x[1:]) for r, s in enumerate(seqs) for x in plain.canonical(s or "", k))
    assert len(got) > 100


def test_length_equal_to_k_gives_none_and_one_more_gives_two(spark):
    n = {r.read_id: r.n for r in kmers.kmer_occurrences(frame(spark, ["ACGTACGTAC", "ACGTACGTACG", "ACGTACGTA"]), 10).groupBy("read_id").agg(F.count("*").alias("n")).collect()}
    assert n == {1: 2}


@pytest.mark.parametrize("k,step", [(4, 1 << 18), (7, 30), (33, 1 << 18), (35, 20)])
def test_minimizers(spark, monkeypatch, k, step):
    monkeypatch.setattr(kmers, "READS", step)
    monkeypatch.setattr(kmers, "TEXT_BYTES", step * k)
    rng = random.Random(5)
    seqs = CASES + ["".join(rng.choice("ACGT") for _ in range(k + last)) for last in (1, 2, 3, 4, 5, 8, 9, 20)]
    seqs += ["".join(rng.choice("AAACGTN") for _ in range(rng.randrange(k, k + 60))) for _ in range(80)] + ["A" * (k + 30)]
    got = spelled(kmers.minimizers3(frame(spark, seqs), k), k)
    assert got == sorted((r, *x) for r, s in enumerate(seqs) for x in plain.minimizers(s or "", k))


def occurrence_frame(spark, rows):
    """K-mers as text, as of long ones."""
    return spark.createDataFrame([(r, k, dna.BASES.index(p), dna.BASES.index(n)) for r, k, p, n in rows], "read_id long, kmer string, prev byte, next byte")


def check_branch(spark, rows):
    df = occurrence_frame(spark, rows)
    groups = branch_filter.branch_groups(df)
    ambiguous, bad = plain.branch(rows)
    assert {r.kmer for r in branch_filter.ambiguous_kmers(groups).collect()} == ambiguous
    assert {r.read_id for r in branch_filter.bad_reads(branch_filter.touched_occurrences(df, groups)).collect()} == bad


@pytest.mark.parametrize("minor", [19, 20, 21])
def test_branch_at_a_fifth(spark, minor):
    check_branch(spark, [(i, "ACGT", "C" if i < minor else "G", "A") for i in range(100)])


def test_branch_ties_boundaries_and_both_sides(spark):
    check_branch(spark, [(1, "AC", "G", "A"), (2, "AC", "T", "A"), (3, "AC", "N", "A"), (4, "CC", "A", "A"), (5, "CC", "C", "T"), (6, "GA", "N", "N"), (7, "GA", "A", "N")])


@quick
@given(st.lists(st.tuples(st.integers(0, 12), st.sampled_from(["AC", "CA", "GG"]), st.sampled_from("ACGTN"), st.sampled_from("AAACN")), max_size=40))
def test_branch_random(spark, rows):
    check_branch(spark, rows)


def reference(seqs, k, mated, cap, parts):
    occ = [(r, *x[1:]) for r, s in enumerate(seqs) for x in plain.canonical(s, k)]
    ambiguous, bad = plain.branch(occ)
    by_kmer = {}
    for r, kmer, _, _ in occ:
        if kmer not in ambiguous and r not in bad and kmer != "A" * k:
            by_kmer.setdefault(kmer, set()).add(r)
    labels = plain.components(range(len(seqs)), [(max(g), r) for g in by_kmer.values() for r in g])
    pairs = [(i, i + 1) for i in range(0, len(seqs) - 1, 2)] if mated else []
    merged = plain.merge_mates(labels, pairs, cap)
    return labels, merged, plain.bin_pack(merged, parts)


@pytest.mark.parametrize("seed,cap,parts", [(1, 1000, 16), (2, 3, 4), (3, 2, 100)])
def test_whole_plan(spark, seed, cap, parts):
    seqs, k = random_reads(seed, 90), 8
    labels, merged, bins = reference(seqs, k, True, cap, parts)
    reads = frame(spark, seqs, mated=True)
    got = partition_reads(reads, k, mate_cap=cap, parts=parts)
    assert {r.read_id: r.comp_id for r in got.components.collect()} == labels
    assert {r.read_id: r.comp_id for r in got.labels.collect()} == merged
    assert {r.comp_id: r.part_id for r in got.partitions.collect()} == bins
    manifest = sorted(tuple(r) for r in got.manifest.collect())
    want = []
    for i in range(len(seqs)):
        want += [(bins[c], i) for c in {merged[i], merged.get(i ^ 1, merged[i])}]
    assert manifest == sorted(want)
    pairs = mates.mate_pairs(reads)
    apart = sum(labels[a] != labels[a + 1] and not (labels[a] == a and labels[a + 1] == a + 1) for a in range(0, len(seqs) - 1, 2))
    assert stats.separated_pairs(got.components, pairs).first().separated == apart


def test_strand_and_order_do_not_matter(spark):
    seqs = random_reads(7, 70)
    rng = random.Random(1)
    flipped = [s.translate(plain.COMPLEMENT)[::-1] if rng.random() < 0.5 else s for s in seqs]
    order = list(range(len(seqs)))
    rng.shuffle(order)
    shuffled = [seqs[i] for i in order]

    def groups(s, ids):
        found = {}
        for r in partition_reads(frame(spark, s), 8).components.collect():
            found.setdefault(r.comp_id, set()).add(ids[r.read_id])
        return sorted(map(sorted, found.values()))

    same = range(len(seqs))
    assert groups(seqs, same) == groups([s.upper() for s in flipped], same) == groups(shuffled, order)


def test_mate_merge_random(spark):
    rng = random.Random(11)
    for cap in (1, 3, 6):
        labels = {}
        for c in range(0, 200, 5):
            size = rng.randrange(1, 6)
            for i in range(c, c + size):
                labels[i] = c + size - 1
        ids = sorted(labels)
        pairs = [(a, b) for a, b in zip(ids[::2], ids[1::2])] + [(a, b) for a, b in zip(ids[:40], ids[50:90])]
        pairs = list({a: (min(a, b), max(a, b)) for a, b in pairs}.values())
        df = spark.createDataFrame(sorted(labels.items()), "read_id long, comp_id long")
        got = mates.merge_mates(df, spark.createDataFrame(pairs, "a long, b long"), cap)
        assert {r.read_id: r.comp_id for r in got.collect()} == plain.merge_mates(labels, pairs, cap)


def test_supported_merge(spark):
    df = spark.createDataFrame([(0, 1), (1, 1), (2, 3), (3, 3), (4, 5), (5, 5)], "read_id long, comp_id long")
    pairs = spark.createDataFrame([(0, 2), (1, 3), (0, 4)], "a long, b long")
    assert sorted(tuple(r) for r in mates.merge_supported(df, pairs, 1).collect()) == [(0, 3), (1, 3), (2, 3), (3, 3), (4, 5), (5, 5)]


@quick
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40), st.integers(1, 8))
def test_bin_packing(spark, sizes, parts):
    labels, at = {}, 0
    for n in sizes:
        for i in range(at, at + n):
            labels[i] = at + n - 1
        at += n
    df = spark.createDataFrame(list(labels.items()), "read_id long, comp_id long")
    assert {r.comp_id: r.part_id for r in component_partitions(df, parts).collect()} == plain.bin_pack(labels, parts)


def test_single_reads_go_out_once(spark):
    reads = frame(spark, ["A", "C"])
    labels = spark.createDataFrame([(0, 0), (1, 1)], "read_id long, comp_id long")
    assert sorted(tuple(r) for r in partition_manifest(labels, reads, component_partitions(labels, 2)).collect()) == [(0, 0), (1, 1)]


@quick
@given(st.lists(st.tuples(st.integers(0, 4**10 - 1), st.integers(1, 50)), min_size=1, max_size=30, unique_by=lambda x: x[0]), st.integers(1, 9), st.booleans())
def test_ranges_equal_the_scan(spark, rows, parts, up):
    total = sum(n for _, n in rows)
    average = max(1, -(-total // parts) if up else total // parts)
    counts, before, bounds = dict(rows), 0, [0]
    for b in range(4**10 + 1):
        if before >= len(bounds) * average and len(bounds) <= parts:
            bounds.append(b)
        before += counts.get(b, 0)
    bounds += [4**10] * (parts + 1 - len(bounds))
    got = histograms.equal_frequency_ranges(spark.createDataFrame(rows, "bucket int, n long"), parts, up)
    assert [r.bound for r in got.orderBy("idx").collect()] == bounds
    prefix = {r.bucket: r.before for r in histograms.bucket_prefix_sum(spark.createDataFrame(rows, "bucket int, n long")).collect()}
    assert prefix[4**10] == total and prefix == {b: sum(n for x, n in rows if x < b) for b in [*counts, 4**10]}


def test_bucket_is_the_rank_of_ten_bases(spark):
    kmer = ["AAAAAAAAAAT", "TTTTTTTTTTA", "ACGTACGTACG"]
    got = spark.createDataFrame([(x,) for x in kmer], "kmer string").select(dna.bucket(F.col("kmer"), 99).alias("b")).collect()
    number = lambda x: int(x.translate(str.maketrans("ACGT", "0123")), 4)
    assert [r.b for r in got] == [number(x[:10]) for x in kmer]
    for size in (4, 10, 11):
        codes = spark.createDataFrame([(number(x[:size]),) for x in kmer], "kmer long")
        got = codes.select(dna.bucket(F.col("kmer"), size).alias("b"), dna.kmer_text(F.col("kmer"), size).alias("t"), dna.other_than_a(codes).alias("a")).collect()
        assert [tuple(r) for r in got] == [(number(x[: min(size, 10)]), x[:size], x[:size] != "A" * size) for x in kmer]


def test_dense_ids_and_sums(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1009).alias("x")).repartition(7)
    rows = dense_ids(df, ["x"], "rank").orderBy("x").collect()
    assert [r["rank"] for r in rows] == list(range(1000))
    sums = exclusive_sum(df, ["x"], "x", "before").orderBy("x").collect()
    total = 0
    for r in sums:
        assert r.before == total
        total += r.x


def test_star_edges_are_linear(spark):
    survivors = spark.createDataFrame([(i % 50, "K") for i in range(200)] + [(7, "L")], "read_id long, kmer string")
    edges = links.star_edges(survivors).collect()
    assert sorted((r.u, r.v) for r in edges) == [(49, i) for i in range(49)]


def test_statistics(spark):
    labels = spark.createDataFrame([(0, 2), (2, 2), (1, 3), (3, 3), (4, 4)], "read_id long, comp_id long")
    assert tuple(stats.largest_component(labels).first()) == (2, 2)
    assert sorted(tuple(r) for r in stats.component_size_distribution(labels).collect()) == [(1, 1), (2, 2)]
    alone = spark.createDataFrame([(0, 0), (1, 1)], "read_id long, comp_id long")
    assert tuple(stats.largest_component(alone).first()) == (0, 0)


def test_no_reads(spark):
    got = partition_reads(frame(spark, ["ACGT"]).limit(0), 4)
    assert got.manifest.count() == 0 and got.partitions.count() == 0


def test_modes(spark):
    with pytest.raises(ValueError):
        partition_reads(frame(spark, ["ACGT"]), 4, mode="other")
    assert partition_reads(frame(spark, random_reads(3)), 8, mode="min3").labels.count() == 60


@pytest.mark.parametrize("k", [4, 9, 33])
def test_folded_minimizers(k):
    """Slices of one position to seven, on reads rich in N, A and ties."""
    rng = random.Random(k)
    for n in range(250):
        seq = "".join(rng.choices("ACGTN", weights=[5, 2, 2, 2, n % 3], k=rng.randrange(k + 1, 160))) + "A" * rng.randrange(3 * k) * (n % 2)
        codes = kmers.CODES[np.frombuffer(seq.encode(), np.uint8)]
        kmer, prev, after = kmers.folded_minimizers(codes, k, 1 + n % 7)
        spell = lambda x: x.decode() if k > dna.PACKED else "".join("ACGT"[int(x) >> 2 * i & 3] for i in range(k))[::-1]  # noqa: B023, E731
        assert [(spell(x), "ACGTN"[p], "ACGTN"[a]) for x, p, a in zip(kmer, prev, after)] == plain.minimizers(seq, k)


def test_long_reads_among_short_ones(spark, monkeypatch):
    rng = random.Random(17)
    seqs = ["".join(rng.choices("ACGTN", weights=[5, 5, 5, 5, 1], k=n)) for n in (30, 700_000, 50, 40, 300_000, 12, 600_000, 9)] + [None, ""]
    assert max(map(len, filter(None, seqs))) > 2 * kmers.READS
    got = spelled(kmers.minimizers3(frame(spark, seqs), 9), 9)
    assert got == sorted((i, *x) for i, s in enumerate(seqs) for x in plain.minimizers(s or "", 9))


def test_a_long_read_in_bounded_memory():
    codes = np.random.default_rng(4).integers(0, 5, 20_000_000).astype(np.uint8)
    tracemalloc.start()
    kmers.folded_minimizers(codes, 27, kmers.READS)
    assert tracemalloc.get_traced_memory()[1] < 60 << 20
    tracemalloc.stop()
