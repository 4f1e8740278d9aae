"""The flagship plan: partition reads by shared k-mers."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.functions.dna import PACKED
from kmerloom.operators.binpack import component_partitions, partition_manifest
from kmerloom.operators.branch_filter import bad_reads, branch_groups, surviving_occurrences, touched_occurrences
from kmerloom.operators.components import connected_components
from kmerloom.operators.kmers import kmer_occurrences, minimizers3
from kmerloom.operators.links import star_edges
from kmerloom.operators.mates import full_labels, mate_pairs, merge_mates, merge_supported
from kmerloom.operators.superkmers import HELD, Dealt
from kmerloom.storage import discard, materialize, spread

#: K-mers of a shuffled partition that a join may hash, some 100 bytes each, instead of sorting both sides.
HASHED = 1 << 20


def joinable(groups: DataFrame) -> DataFrame:
    """Stored groups as the hashed side of a join while partitions stay small, else of a merge join.

    Without either hint occurrences would count as no larger than the reads they come from, and might be broadcast.
    """
    partitions = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return groups.hint("shuffle_hash" if groups.count() <= HASHED * partitions else "merge")


@dataclass
class Linked:
    """What links reads: condemned reads, edges."""

    bad: DataFrame
    edges: DataFrame


@dataclass
class Partitioned:
    """labels (read_id, comp_id) before and after the mate merge; partitions (comp_id, n, part_id); manifest (part_id, read_id)."""

    linked: Linked
    components: DataFrame
    labels: DataFrame
    partitions: DataFrame
    manifest: DataFrame


def occurrences_of(reads: DataFrame, k: int = 27, mode: str = "all") -> DataFrame:
    if mode not in ("all", "min3"):
        raise ValueError("mode is 'all' or 'min3'")
    return kmer_occurrences(reads, k) if mode == "all" else minimizers3(reads, k)


def _marked(occurrences: DataFrame, min_degree: int | None, max_degree: int | None) -> DataFrame:
    """The stored occurrences that condemn or may link reads, by one join with the statistics of k-mers seen twice."""
    groups = materialize(branch_groups(occurrences).where("deg > 1"), "groups")
    return materialize(touched_occurrences(occurrences, joinable(groups), min_degree, max_degree), "touched")


def condemned_reads(reads: DataFrame, k: int = 27) -> DataFrame:
    """(read_id) of the reads that support a minority branch of any k-mer."""
    if k > PACKED:
        occurrences = kmer_occurrences(spread(reads), k)
        return bad_reads(touched_occurrences(occurrences, joinable(materialize(branch_groups(occurrences).where("deg > 1"), "groups"))))
    dealt = Dealt(spread(reads), k)
    hot = dealt.hot_occurrences()
    found = dealt.condemned()
    return (found if hot is None else found.union(bad_reads(_marked(hot, None, None)))).distinct()


def link_reads(reads: DataFrame, k: int = 27, mode: str = "all", min_degree: int | None = None, max_degree: int | None = None, held: int = HELD) -> Linked:
    """Filter k-mers and reads, then take star edges.

    reads should be a stored table. All k-mers of up to 31 bases travel once, as runs, for their statistics, which condemn
    reads, and for the sets of reads that they link, from which edges are taken once all condemned reads are known. Those
    of hot buckets of more than ``held``, longer ones and minimizers are rows, generated once for the statistics and once
    for the join that marks what they condemn and link.
    """
    rows = spread(reads)
    dealt = Dealt(rows, k, held) if mode == "all" and k <= PACKED else None
    occurrences = dealt.hot_occurrences() if dealt else occurrences_of(rows, k, mode)
    condemned, edges, touched = [], [], None
    if dealt:
        linked = dealt.linked(min_degree, max_degree)
        discard(dealt.runs)
        condemned.append(linked.select(F.explode("condemned").alias("read_id")))
    if occurrences is not None:
        touched = _marked(occurrences, min_degree, max_degree)
        condemned.append(bad_reads(touched))
    bad = materialize(reduce(DataFrame.union, condemned).distinct(), "bad")
    if dealt:
        edges.append(dealt.stars(linked, bad))
    if touched is not None:
        survivors = materialize(surviving_occurrences(touched, bad), "survivors")
        discard(touched)
        edges.append(star_edges(survivors))
    stars = materialize(reduce(DataFrame.union, edges).distinct(), "stars")
    if dealt:
        discard(linked)
    return Linked(bad, stars)


def partition_reads(
    reads: DataFrame, k: int = 27, mode: str = "all", mate_cap: int = 1000, parts: int = 16, min_degree: int | None = None, max_degree: int | None = None, merge_support: int | None = None
) -> Partitioned:
    """reads: read_id (dense from 0), mate_id (null for single reads), seq. merge_support unites components that more
    mate pairs than this join, before the mate merge; off by default."""
    linked = link_reads(reads, k, mode, min_degree, max_degree)
    components = materialize(full_labels(reads, connected_components(linked.edges, "max")), "components")
    if merge_support is not None:
        components = materialize(merge_supported(components, mate_pairs(reads), merge_support), "supported")
    labels = materialize(merge_mates(components, mate_pairs(reads), mate_cap), "labels")
    partitions = materialize(component_partitions(labels, parts), "parts")
    return Partitioned(linked, components, labels, partitions, partition_manifest(labels, reads, partitions))
