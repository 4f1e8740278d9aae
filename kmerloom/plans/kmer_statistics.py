"""Statistics of all k-mers of reads, without a row per occurrence.

K-mers of up to 31 bases travel as runs and are counted where they meet (see superkmers). Those of hot buckets and longer
ones go by rows, through the operators whose results these are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.dna import PACKED
from kmerloom.operators import branch_filter, kmers, stats
from kmerloom.operators.superkmers import HELD, Dealt, Tally
from kmerloom.storage import discard, spread

SIDE = "n_{0} int, top_{0} tinyint, s_{0} long"
BRANCHES = f"kmer long, deg long, last_read long, {SIDE.format('prev')}, {SIDE.format('next')}"


def _tallied(reads: DataFrame, k: int, held: int, schema: str, found: Callable[[Tally], list], by_rows: Callable[[DataFrame], DataFrame], neighbours: bool = False, spent: bool = False) -> DataFrame:
    """What ``found`` makes of cold k-mers and ``by_rows`` of the occurrences of all others. reads should be stored; if
    ``spent``, nothing else will read them, and they are deleted once their runs are stored, unless there are hot k-mers."""
    rows = spread(reads)
    if k > PACKED:
        return by_rows(kmers.kmer_occurrences(rows, k, neighbours))
    dealt = Dealt(rows, k, held)
    cold, hot = dealt.tallied(schema, found), dealt.hot_occurrences()
    if spent and hot is None:
        discard(reads)
    return cold if hot is None else cold.union(by_rows(hot).select(*cold.columns))


def canonical_counts(reads: DataFrame, k: int, held: int = HELD, spent: bool = False) -> DataFrame:
    """(kmer, n, reads): occurrences and distinct reads of each k-mer."""
    return _tallied(reads, k, held, "kmer long, n long, reads long", Tally.counts, kmers.canonical_counts, spent=spent)


def kmer_degrees(reads: DataFrame, k: int, held: int = HELD, spent: bool = False) -> DataFrame:
    """(kmer, deg): distinct reads of each k-mer."""
    return _tallied(reads, k, held, "kmer long, deg long", Tally.degrees, stats.kmer_degrees, spent=spent)


def degree_distribution(reads: DataFrame, k: int, held: int = HELD) -> DataFrame:
    """(deg, kmers): k-mers of each number of distinct reads."""
    parts = _tallied(reads, k, held, "deg long, kmers long", Tally.distribution, stats.degree_distribution)
    return parts.groupBy("deg").agg(F.sum("kmers").alias("kmers"))


def branch_groups(reads: DataFrame, k: int, held: int = HELD, spent: bool = False) -> DataFrame:
    """The statistics of branch_filter.branch_groups."""
    return _tallied(reads, k, held, BRANCHES, Tally.branches, branch_filter.branch_groups, True, spent)


def ambiguous_kmers(reads: DataFrame, k: int, held: int = HELD) -> DataFrame:
    """(kmer): k-mers that branch on both sides."""
    return _tallied(reads, k, held, "kmer long", Tally.ambiguous, lambda rows: branch_filter.ambiguous_kmers(branch_filter.branch_groups(rows)), True)


def mischief_count(reads: DataFrame, k: int, held: int = HELD) -> DataFrame:
    """One row: the k-mers whose second base holds two fifths or more on both sides."""
    parts = _tallied(reads, k, held, "mischief long", Tally.mischief, lambda rows: branch_filter.mischief_count(branch_filter.branch_groups(rows)), True)
    return parts.agg(F.coalesce(F.sum("mischief"), F.lit(0)).alias("mischief"))
