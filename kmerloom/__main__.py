"""Command line: index, view, histogram and partition FASTQ input sets.

    python -m kmerloom index     -o DIR [--paired A B]... [--single F]... [--interleaved F]...
    python -m kmerloom view      DIR
    python -m kmerloom histogram -o DIR -k 27 [--min3] [--index DIR] [files as above]
    python -m kmerloom ranges    DIR [--parts 16]
    python -m kmerloom partition -o DIR -k 27 [--min3] [--parts 16] [--mate-cap 1000] [--merge-support N]
                                 [--min-degree N] [--max-degree N] [--largest] [--index DIR] [files as above]

``--index`` takes the output of ``index`` over the same files and chunk size, which spares counting their records;
``ranges`` takes the output of ``histogram``.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.operators import histograms, mates, stats
from kmerloom.operators.kmers import kmer_occurrences, minimizers3
from kmerloom.plans.partition_reads import partition_reads
from kmerloom.sources.fastq import fastq_index, read_fastq
from kmerloom.sources.fastq_sink import write_largest_component, write_partitions
from kmerloom.storage import materialize


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="kmerloom")
    commands = top.add_subparsers(dest="command", required=True)
    for name in ("index", "histogram", "partition"):
        p = commands.add_parser(name)
        p.add_argument("-o", "--out", required=True)
        p.add_argument("--paired", nargs=2, action="append", default=[], metavar=("A", "B"))
        p.add_argument("--single", action="append", default=[])
        p.add_argument("--interleaved", action="append", default=[])
        p.add_argument("--chunk-bytes", type=int, default=64 << 20)
        if name != "index":
            p.add_argument("-k", type=int, default=27)
            p.add_argument("--min3", action="store_true")
            p.add_argument("--index")
        if name == "partition":
            p.add_argument("--parts", type=int, default=16)
            p.add_argument("--mate-cap", type=int, default=1000)
            p.add_argument("--merge-support", type=int, help="unite components that more mate pairs than this join")
            p.add_argument("--min-degree", type=int)
            p.add_argument("--max-degree", type=int)
            p.add_argument("--largest", action="store_true", help="also write the largest component apart from all others")
    commands.add_parser("view").add_argument("index")
    p = commands.add_parser("ranges")
    p.add_argument("histogram")
    p.add_argument("--parts", type=int, default=16)
    return top


def reads_of(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    index = spark.read.parquet(args.index) if args.index else None
    return materialize(read_fastq(spark, [tuple(p) for p in args.paired], args.single, args.interleaved, args.chunk_bytes, index), "reads")


def index(spark: SparkSession, args: argparse.Namespace) -> None:
    fastq_index(spark, [tuple(p) for p in args.paired], args.single, args.interleaved, args.chunk_bytes).write.parquet(args.out)


def view(spark: SparkSession, args: argparse.Namespace) -> None:
    """One line per chunk: id, file, first byte, reads."""
    for r in spark.read.parquet(args.index).where("n > 0").orderBy("chunk_id").toLocalIterator():
        print(r.chunk_id, r.file_no, r.first_offset, r.n)


def histogram(spark: SparkSession, args: argparse.Namespace) -> None:
    """Per-chunk and whole histograms over buckets, prefix sums and reads per chunk, as Parquet under the output."""
    reads = reads_of(spark, args)
    by_chunk = materialize(histograms.chunk_bucket_histogram(reads, args.k, minimizers3 if args.min3 else kmer_occurrences), "histogram")
    whole = by_chunk.groupBy("bucket").agg(F.sum("n").alias("n"))
    by_chunk.write.parquet(f"{args.out}/chunk_histogram")
    whole.write.parquet(f"{args.out}/histogram")
    histograms.bucket_prefix_sum(whole).write.parquet(f"{args.out}/prefix_sums")
    histograms.reads_per_chunk(reads).write.parquet(f"{args.out}/reads_per_chunk")


def ranges(spark: SparkSession, args: argparse.Namespace) -> None:
    """One line per boundary of equal-frequency bucket ranges: number, first bucket."""
    stored = spark.read.parquet(f"{args.histogram}/histogram")
    for r in histograms.equal_frequency_ranges(stored, args.parts).orderBy("idx").collect():  # a row per part
        print(r.idx, r.bound)


def partition(spark: SparkSession, args: argparse.Namespace) -> None:
    """Write FASTQ text per partition and the labels; print the statistics."""
    reads = reads_of(spark, args)
    out = partition_reads(reads, args.k, "min3" if args.min3 else "all", args.mate_cap, args.parts, args.min_degree, args.max_degree, args.merge_support)
    write_partitions(out.manifest, reads, f"{args.out}/reads")
    if args.largest:
        write_largest_component(out.labels, reads, stats.largest_component(out.labels).first().comp_id, f"{args.out}/largest")
    out.labels.write.parquet(f"{args.out}/labels")
    stats.component_size_distribution(out.labels).write.parquet(f"{args.out}/component_sizes")
    pairs = mates.mate_pairs(reads)
    for name, labels in (("before mates", out.components), ("after mates", out.labels)):
        top, apart = stats.largest_component(labels).first(), stats.separated_pairs(labels, pairs).first().separated
        n = stats.component_sizes(labels).count()
        print(f"{name}: {n} components, largest {top.comp_id} of {top.n} reads, {apart} separated pairs")
    print(f"filtered reads: {out.linked.bad.count()}")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("kmerloom").getOrCreate()
    {"index": index, "view": view, "histogram": histogram, "ranges": ranges, "partition": partition}[args.command](spark, args)


if __name__ == "__main__":
    main(sys.argv[1:])
