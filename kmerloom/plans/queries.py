"""The registered queries: every operator over reads derived from the whole texts of the driver's tables, k = 27."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kmerloom.functions.dna import base_text, kmer_text
from kmerloom.operators import components, histograms, kmers, links, mates, stats
from kmerloom.operators.binpack import component_partitions, partition_manifest
from kmerloom.plans import kmer_statistics
from kmerloom.plans.partition_reads import Linked, condemned_reads, link_reads
from kmerloom.sources.fastq import fastq_index, read_fastq, scan_fastq
from kmerloom.sources.fastq_sink import read_partitions, write_largest_component, write_partitions
from kmerloom.sources.text_reads import conversation_reads, stored_document_reads
from kmerloom.storage import materialize, new_path, spread

K, PARTS, CAP, SMALL_CAP, CHUNK = 27, 16, 1000, 8, 1000
#: Of the FASTQ files that queries write: reads of a file by id, bytes of a scanned range and of a task.
FILE_IDS, RANGE, TASK = 8192, 1 << 16, 1 << 20
#: -1 for reads without a mate.
MATE = "coalesce(mate_id, -1) AS mate_id"

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def reads(spark: SparkSession, sf_dir: str, paired: bool = False) -> DataFrame:
    """F1 (overlapping fragments of documents) or F2 (the same in mate pairs), stored."""
    return stored_document_reads(spread(spark.read.parquet(f"{sf_dir}/documents.parquet")), paired=paired)


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """turns of conversations, two and two as mates, stored."""
    return materialize(conversation_reads(spread(spark.read.parquet(f"{sf_dir}/conversations.parquet"))), "turns")


def occurrences(spark: SparkSession, sf_dir: str, neighbours: bool = True) -> DataFrame:
    return kmers.kmer_occurrences(spread(reads(spark, sf_dir)), K, neighbours)


def spelled(df: DataFrame) -> DataFrame:
    """Numbers of k-mers and bases as text."""
    text = {"kmer": kmer_text(F.col("kmer"), K)} | {c: base_text(F.col(c)) for c in ("prev", "next", "top_prev", "top_next")}
    return df.withColumns({c: x for c, x in text.items() if c in df.columns})


def chunks(rows: DataFrame) -> DataFrame:
    return rows.select(F.expr(f"CAST(read_id div {CHUNK} AS INT)").alias("chunk_id"), "seq")


def labels(rows: DataFrame, mode: str = "all") -> tuple[Linked, DataFrame]:
    linked = link_reads(rows, K, mode)
    return linked, mates.full_labels(rows, components.connected_components(linked.edges, "max"))


def merged(rows: DataFrame, cap: int = CAP) -> DataFrame:
    _, own = labels(rows)
    return materialize(mates.merge_mates(materialize(own, "components"), mates.mate_pairs(rows), cap), "labels")


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The text files of a written folder, in order of their names."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    found, names = path.getFileSystem(sc._jsc.hadoopConfiguration()).listFiles(path, True), []
    while found.hasNext():
        names.append(found.next().getPath().toString())
    names = sorted(n for n in names if n.rpartition("/")[2].startswith("part-"))
    return [n if "://" in n else n.replace("file:/", "file:///", 1) for n in names]


def fastq(name: Column) -> Column:
    """The record of a named read without its last line end."""
    return F.concat(F.lit("@"), name, F.lit("\n"), F.col("seq"), F.lit("\n+\n"), F.repeat(F.lit("@"), F.length("seq")))


def stored_files(rows: DataFrame, first: str = "read_id") -> list[str]:
    """Write rows (read_id, record) as FASTQ files of FILE_IDS ids of ``first`` each; the files in order."""
    spark = rows.sparkSession
    path = new_path(spark, "files")
    filed = rows.withColumn("file", F.expr(f"lpad(CAST({first} div {FILE_IDS} AS STRING), 12, '0')")).repartition("file").sortWithinPartitions("file", "read_id")
    filed.select("file", F.col("record").alias("value")).write.partitionBy("file").text(path)
    return listed(spark, path)


def headed(rows: DataFrame) -> DataFrame:
    return rows.selectExpr("read_id", MATE, "substring_index(record, '\\n', 1) AS header", "seq")


def mated_records(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(read_id, first, record) of mates, named as their pair's first with /1 and /2, and of single reads."""
    first = F.least("read_id", "mate_id")
    side = F.when(F.col("read_id") == first, "/1").otherwise("/2")
    pairs = rows.where("mate_id IS NOT NULL").select("read_id", first.alias("first"), fastq(F.concat(F.lit("r"), first, side)).alias("record"))
    return pairs, rows.where("mate_id IS NULL").select("read_id", fastq(F.concat(F.lit("r"), F.col("read_id"))).alias("record"))


@query
def read_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("seq").cast("long")
    return reads(spark, sf_dir).select("read_id", "doc_id", n.alias("bases"), (n - F.length(F.replace("seq", F.lit("N"), F.lit("")))).alias("ambiguous"))


@query
def paired_read_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads(spark, sf_dir, paired=True).selectExpr("read_id", MATE, "doc_id", "seq")


@query
def conversation_read_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).selectExpr("read_id", MATE, "seq")


@query
def read_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir)
    return stats.totals(rows, kmers.kmer_occurrences(rows, K, neighbours=False))


@query
def kmer_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per read: its k-mers, the least and the greatest."""
    return occurrences(spark, sf_dir, False).groupBy("read_id").agg(F.count("*").alias("n"), kmer_text(F.min("kmer"), K).alias("least"), kmer_text(F.max("kmer"), K).alias("greatest"))


@query
def kmer_canonical_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(kmer_statistics.canonical_counts(reads(spark, sf_dir), K, spent=True))


@query
def kmer_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(occurrences(spark, sf_dir).groupBy("prev", "next").agg(F.count("*").alias("n")))


@query
def bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.bucket_histogram(occurrences(spark, sf_dir, False), K)


@query
def chunk_bucket_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.chunk_bucket_histogram(spread(chunks(reads(spark, sf_dir))), K)


@query
def bucket_prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.bucket_prefix_sum(histograms.bucket_histogram(occurrences(spark, sf_dir, False), K))


@query
def equal_frequency_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.equal_frequency_ranges(materialize(histograms.bucket_histogram(occurrences(spark, sf_dir, False), K), "histogram"), PARTS)


@query
def reads_per_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.reads_per_chunk(chunks(reads(spark, sf_dir)))


@query
def kmer_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(kmer_statistics.kmer_degrees(reads(spark, sf_dir), K, spent=True))


@query
def degree_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_statistics.degree_distribution(reads(spark, sf_dir), K)


@query
def branch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(kmer_statistics.branch_groups(reads(spark, sf_dir), K, spent=True))


@query
def ambiguous_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(kmer_statistics.ambiguous_kmers(reads(spark, sf_dir), K))


@query
def bad_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return condemned_reads(reads(spark, sf_dir), K)


@query
def mischief_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmer_statistics.mischief_count(reads(spark, sf_dir), K)


@query
def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_reads(reads(spark, sf_dir), K).edges


@query
def star_edges_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the optional frequency filter: k-mers of 3 to 9 occurrences."""
    return link_reads(reads(spark, sf_dir), K, min_degree=3, max_degree=10).edges


@query
def read_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(reads(spark, sf_dir))[1]


@query
def component_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.component_sizes(labels(reads(spark, sf_dir))[1])


@query
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.largest_component(labels(reads(spark, sf_dir))[1])


@query
def component_size_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.component_size_distribution(labels(reads(spark, sf_dir))[1])


@query
def separated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, paired=True)
    return stats.separated_pairs(materialize(labels(rows)[1], "components"), mates.mate_pairs(rows))


@query
def mate_merged_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(reads(spark, sf_dir, paired=True))


@query
def mate_merged_components_small_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a cap that binds: what unites depends on the order of pairs, which SQL doesn't express."""
    return merged(reads(spark, sf_dir, paired=True), SMALL_CAP)


@query
def conversation_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merged(turns(spark, sf_dir))


@query
def supported_component_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional merge of components that more than one mate pair joins."""
    rows = reads(spark, sf_dir, paired=True)
    return mates.merge_supported(materialize(labels(rows)[1], "components"), mates.mate_pairs(rows), 1)


@query
def component_partitions_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return component_partitions(merged(reads(spark, sf_dir, paired=True)), PARTS)


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reads(spark, sf_dir, paired=True)
    own = merged(rows)
    return partition_manifest(own, rows, component_partitions(own, PARTS))


@query
def partition_manifest_16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(spark, sf_dir)


@query
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.partition_sizes(manifest(spark, sf_dir))


@query
def minimizers3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelled(kmers.minimizers3(spread(reads(spark, sf_dir)), K))


@query
def minimizer_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histograms.bucket_histogram(kmers.minimizers3(spread(reads(spark, sf_dir)), K), K)


@query
def minimizer_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(reads(spark, sf_dir), "min3")[1]


@query
def fastq_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads written as FASTQ text and scanned again in small byte ranges."""
    path = new_path(spark, "fastq")
    reads(spark, sf_dir).select(fastq(F.concat(F.lit("r"), F.col("read_id"))).alias("value")).write.text(path)
    return scan_fastq(spark, listed(spark, path), RANGE, TASK).select("header", "seq", F.length("qual").cast("long").alias("quals"))


@query
def paired_input_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mates written to two files each, single reads to others, read as one input set."""
    pairs, alone = mated_records(reads(spark, sf_dir, paired=True))
    left, right = (stored_files(pairs.where(side), "first") for side in ("read_id = first", "read_id <> first"))
    return headed(read_fastq(spark, list(zip(left, right)), stored_files(alone), chunk_bytes=RANGE, task_bytes=TASK))


@query
def interleaved_input_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs, alone = mated_records(reads(spark, sf_dir, paired=True))
    return headed(read_fastq(spark, single=stored_files(alone), interleaved=stored_files(pairs, "first"), chunk_bytes=RANGE, task_bytes=TASK))


def indexed(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame]:
    files = stored_files(mated_records(reads(spark, sf_dir))[1])
    return files, materialize(fastq_index(spark, single=files, chunk_bytes=RANGE, task_bytes=TASK), "index")


@query
def stored_chunk_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of byte ranges, written and read again."""
    return indexed(spark, sf_dir)[1].where("n > 0").select("chunk_id", "file_no", "first_offset", "n")


@query
def indexed_input_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An input set that takes its ids from a stored index."""
    files, index = indexed(spark, sf_dir)
    return headed(read_fastq(spark, single=files, chunk_bytes=RANGE, index=index, task_bytes=TASK))


@query
def written_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by partition, pairs of two components twice, and scanned again."""
    rows = reads(spark, sf_dir, paired=True)
    own = merged(rows)
    path = new_path(spark, "partitions")
    records = rows.withColumn("record", fastq(F.concat(F.lit("r"), F.col("read_id"))))
    write_partitions(partition_manifest(own, rows, component_partitions(own, PARTS)), records, path, FILE_IDS)
    return read_partitions(spark, path, RANGE, TASK).select("part_id", "header", "seq")


@query
def written_largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records of the largest component, written apart from all others and scanned again."""
    rows = reads(spark, sf_dir)
    own = materialize(labels(rows)[1], "components")
    path = new_path(spark, "largest")
    write_largest_component(own, rows.withColumn("record", fastq(F.concat(F.lit("r"), F.col("read_id")))), stats.largest_component(own).first().comp_id, path)
    return read_partitions(spark, path, RANGE, TASK).select((F.col("part_id") == 1).alias("largest"), "header", "seq")


@query
def component_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components with more than one read, written and read again."""
    own = materialize(labels(reads(spark, sf_dir))[1], "components")
    return materialize(own.join(stats.component_sizes(own).where("n > 1"), "comp_id"), "dump").select("comp_id", "read_id", "n")
