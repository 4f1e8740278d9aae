"""Statistics over k-mers, reads, components and partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def component_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("comp_id").agg(F.count("*").alias("n"))


def largest_component(labels: DataFrame) -> DataFrame:
    """One row (comp_id, n). Of equal sizes the component whose second largest read comes first; 0, 0 if all are single."""
    ranked = labels.groupBy("comp_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("read_id") != F.col("comp_id"), F.col("read_id"))).alias("second"))
    top = ranked.where("n > 1").agg(F.max(F.struct(F.col("n"), (-F.col("second")).alias("second"), F.col("comp_id"))).alias("m"))
    return top.select(F.coalesce("m.comp_id", F.lit(0)).alias("comp_id"), F.coalesce("m.n", F.lit(0)).alias("n"))


def component_size_distribution(labels: DataFrame) -> DataFrame:
    return component_sizes(labels).groupBy("n").agg(F.count("*").alias("components"))


def separated_pairs(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: pairs whose mates lie in different components, other than pairs that both name their own."""
    left, right = labels.select(F.col("read_id").alias("a"), F.col("comp_id").alias("c1")), labels.select(F.col("read_id").alias("b"), F.col("comp_id").alias("c2"))
    apart = pairs.join(left, "a").join(right, "b").where("c1 <> c2 AND NOT (c1 = a AND c2 = b)")
    return apart.agg(F.count("*").alias("separated"))


def kmer_degrees(occurrences: DataFrame) -> DataFrame:
    """(kmer, deg): distinct reads of each k-mer."""
    return occurrences.select("kmer", "read_id").distinct().groupBy("kmer").agg(F.count("*").alias("deg"))


def degree_distribution(occurrences: DataFrame) -> DataFrame:
    return kmer_degrees(occurrences).groupBy("deg").agg(F.count("*").alias("kmers"))


def totals(reads: DataFrame, occurrences: DataFrame) -> DataFrame:
    """One row: reads, bases and k-mer occurrences."""
    r = reads.agg(F.count("*").alias("reads"), F.coalesce(F.sum(F.length("seq").cast("long")), F.lit(0)).alias("bases"))
    return r.crossJoin(occurrences.agg(F.count("*").alias("kmers")))  # two one-row tables


def partition_sizes(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("part_id").agg(F.count("*").alias("n"))
