"""Statistics of k-mers by runs, against the operators on rows; no exchange holds a row per occurrence."""

import pathlib
import time

import pytest
from pyspark.sql import functions as F
from test_superkmers import frame, some_reads

from kmerloom.functions import dna
from kmerloom.operators import branch_filter, histograms, stats, superkmers
from kmerloom.operators.kmers import canonical_counts, kmer_occurrences
from kmerloom.operators.superkmers import HELD
from kmerloom.plans import kmer_statistics, queries
from kmerloom.storage import CLEANUP, materialize, release, session_root

BY_ROWS = {
    "canonical_counts": canonical_counts,
    "kmer_degrees": stats.kmer_degrees,
    "degree_distribution": stats.degree_distribution,
    "branch_groups": branch_filter.branch_groups,
    "ambiguous_kmers": lambda rows: branch_filter.ambiguous_kmers(branch_filter.branch_groups(rows)),
    "mischief_count": lambda rows: branch_filter.mischief_count(branch_filter.branch_groups(rows)),
}


def rows(df):
    return sorted(map(tuple, df.select(*sorted(df.columns)).collect()), key=str)


@pytest.mark.parametrize("k,held", [(8, 40), (8, 3000), (8, HELD), (27, HELD), (33, HELD)])
def test_equal_to_rows(spark, k, held):
    """All buckets hot, some, none; k-mers too long for runs."""
    reads = materialize(frame(spark, some_reads(11)), "reads")
    for name, by_rows in BY_ROWS.items():
        got, want = getattr(kmer_statistics, name)(reads, k, held), by_rows(kmer_occurrences(reads, k))
        assert rows(got) == rows(want), name
        assert sorted(got.dtypes) == sorted(want.dtypes), name


def test_no_reads(spark):
    none = materialize(spark.createDataFrame([], "read_id long, seq string"), "reads")
    assert kmer_statistics.kmer_degrees(none, 8).count() == 0
    assert kmer_statistics.mischief_count(none, 8).first().mischief == 0


@pytest.mark.parametrize("name", ["ambiguous_kmers", "branch_groups", "degree_distribution", "kmer_canonical_counts", "kmer_degree", "mischief_count"])
def test_queries_shuffle_runs(spark, name):
    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(kmer" not in plan and "hashpartitioning(xxhash64(bucket" in plan


def test_kmer_text(spark):
    for k in (2, 3, 4, 7, 27, 31):
        ids = [0, 1, 4**k - 1, 4**k // 3]
        got = [r.t for r in spark.createDataFrame([(i,) for i in ids], "kmer long").select(dna.kmer_text(F.col("kmer"), k).alias("t")).collect()]
        assert got == ["".join("ACGT"[i >> 2 * j & 3] for j in range(k - 1, -1, -1)) for i in ids]


@pytest.mark.parametrize("k", [8, 27, 33])
def test_chunk_histogram_shuffles_reads_only(spark, monkeypatch, k):
    monkeypatch.setattr(histograms, "SLICE", 70)
    chunks = frame(spark, some_reads(4) + ["ACGTTGCA" * 60]).select((F.col("read_id") / 20).cast("int").alias("chunk_id"), "seq")
    got, want = histograms.chunk_bucket_histogram(chunks, k), histograms.chunk_bucket_histogram(chunks, k, kmer_occurrences)
    assert rows(got) == rows(want) and sorted(got.dtypes) == sorted(want.dtypes)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert k > 31 or "hashpartitioning(chunk_id" in plan and ", bucket" not in plan.split("hashpartitioning", 1)[1].split("]")[0]


def test_runs_of_small_batches_are_gathered(spark):
    """A row per bucket and task, not one per bucket and batch of Arrow."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        found = superkmers.kmer_runs(frame(spark, some_reads(6)).coalesce(1), 27, 5).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == len({r.bucket for r in found}) <= 5


@pytest.mark.parametrize("k,held", [(8, 40), (8, 3000), (27, HELD)])
def test_equal_to_rows_with_several_buckets_in_a_row(spark, monkeypatch, k, held):
    monkeypatch.setattr(superkmers, "ROWS", 3)
    test_equal_to_rows(spark, k, held)


@pytest.mark.parametrize("name", ["branch_groups", "kmer_canonical_counts", "kmer_degree"])
def test_queries_keep_runs_only(spark, name):
    """Neither encoded texts nor reads stay beside the runs that the result is read from."""
    release(spark)
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    kept = {f.name.split("-")[0] for f in pathlib.Path(session_root(spark).removeprefix("file://")).iterdir()}
    assert "runs" in kept and not kept & {"reads", "encoded"}
    assert got.count() > 0


def test_reads_with_hot_kmers_are_kept(spark):
    reads = materialize(frame(spark, some_reads(11)), "reads")
    assert rows(kmer_statistics.kmer_degrees(reads, 8, 40, spent=True)) == rows(stats.kmer_degrees(kmer_occurrences(reads, 8)))


def test_a_stored_table_leaves_nothing_shuffled(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in map(str, disk.getAllBlocks().mkString(" ").split()) if f.startswith("shuffle_")}
    before = shuffled()
    own = spark.conf.get(CLEANUP, None)
    stored = materialize(spark.range(1000).repartition(4, "id"), "dealt")
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert stored.count() == 1000 and spark.conf.get(CLEANUP, None) == own
