"""The local branch filter: ambiguous k-mers and the reads that support minority branches.

Of every k-mer the neighbour bases are counted on both sides with conditional sums, which combine before the shuffle;
there is no window and no collected group, so a k-mer of a repeat costs one row per task. A k-mer that branches on both
sides is ambiguous and dropped. One that branches on one side keeps, but its reads with another base there than the
most frequent one are bad, and all its reads are if the second base makes up a fifth or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.dna import CODE_ORDER, code, other_than_a

SIDES = ("prev", "next")


def _counted(side: str) -> list[Column]:
    return [F.sum(F.when(F.col(side) == code(c), 1).otherwise(0)).alias(f"{side}_{c}") for c in CODE_ORDER]


def branch_groups(occurrences: DataFrame) -> DataFrame:
    """Per k-mer: deg (occurrences), last_read (largest read_id), and for each side the number of bases n_, the most
    frequent base top_ (ties by code order A, C, T, G) and the count of the second s_."""
    counts = occurrences.groupBy("kmer").agg(F.count("*").alias("deg"), F.max("read_id").alias("last_read"), *_counted("prev"), *_counted("next"))
    out = ["kmer", "deg", "last_read"]
    for side in SIDES:
        of = [F.col(f"{side}_{c}") for c in CODE_ORDER]
        most = F.greatest(*of)
        top = F.when(most == 0, None)
        for c, n in zip(CODE_ORDER, of):
            top = top.when(n == most, code(c))
        out += [
            sum(F.when(n > 0, 1).otherwise(0) for n in of).cast("int").alias(f"n_{side}"),
            top.alias(f"top_{side}"),
            F.element_at(F.sort_array(F.array(*of), asc=False), 2).alias(f"s_{side}"),
        ]
    return counts.select(*out)


def ambiguous_kmers(groups: DataFrame) -> DataFrame:
    """K-mers that branch on both sides."""
    return groups.where("n_prev > 1 AND n_next > 1").select("kmer")


def mischief_count(groups: DataFrame) -> DataFrame:
    """One row: the k-mers whose second base holds two fifths or more on both sides."""
    return groups.agg(F.count_if(F.expr("n_prev > 1 AND n_next > 1 AND 5 * s_prev >= 2 * deg AND 5 * s_next >= 2 * deg")).alias("mischief"))


def touched_occurrences(occurrences: DataFrame, groups: DataFrame, min_degree: int | None = None, max_degree: int | None = None) -> DataFrame:
    """(read_id, kmer, condemned, linking) of the occurrences that matter later, in one join of all with their groups.

    condemned: a one-sided branch makes the read bad, since its base there isn't the most frequent one or the second has a
    fifth or more. linking: the k-mer may link reads: it is seen twice or more, not ambiguous, not of A only.
    min_degree and max_degree keep k-mers of min_degree <= deg < max_degree; both are off by default.
    """
    link = f"deg >= {max(2, int(min_degree or 2))} AND NOT (n_prev > 1 AND n_next > 1)" + (f" AND deg < {int(max_degree)}" if max_degree else "")
    forked = F.expr("(n_prev > 1) <> (n_next > 1)")
    marks = groups.select(
        "kmer",
        forked.alias("forked"),
        F.when(F.col("n_prev") > 1, F.col("top_prev")).alias("want_prev"),
        F.when(F.col("n_next") > 1, F.col("top_next")).alias("want_next"),
        F.expr("5 * if(n_prev > 1, s_prev, s_next) >= deg").alias("all_bad"),
        (F.expr(link) & other_than_a(groups)).alias("linking"),
    )
    condemned = F.expr("forked AND (all_bad OR coalesce(prev <> want_prev, false) OR coalesce(next <> want_next, false))")
    return occurrences.join(marks.where("forked OR linking"), "kmer").select("read_id", "kmer", condemned.alias("condemned"), "linking").where("condemned OR linking")


def bad_reads(touched: DataFrame) -> DataFrame:
    """Distinct read_ids that a one-sided branch condemns."""
    return touched.where("condemned").select("read_id").distinct()


def surviving_occurrences(touched: DataFrame, bad: DataFrame) -> DataFrame:
    """(read_id, kmer) that link reads: of linking k-mers and reads that aren't bad."""
    return touched.where("linking").select("read_id", "kmer").join(bad, "read_id", "left_anti")
