"""Mate merge: components that a mate pair joins become one, as long as one of them is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.operators.components import connected_components
from kmerloom.storage import discard, materialize


def mate_pairs(reads: DataFrame) -> DataFrame:
    """(a, b) with a < b, one row per pair; reads has read_id and mate_id (null for single reads)."""
    return reads.where("mate_id IS NOT NULL AND read_id < mate_id").select(F.col("read_id").alias("a"), F.col("mate_id").alias("b"))


def full_labels(reads: DataFrame, labels: DataFrame) -> DataFrame:
    """(read_id, comp_id) of every read: unlinked and filtered reads are components of their own."""
    return reads.select("read_id").join(labels, F.col("read_id") == F.col("id"), "left").select("read_id", F.coalesce("label", "read_id").alias("comp_id"))


def _ends(edges: DataFrame) -> DataFrame:
    """Every edge (a, na, b, nb, pair) seen from both of its ends: (x, nx, y, ny, pair)."""
    seen = lambda x, y: F.struct(F.col(x).alias("x"), F.col("n" + x).alias("nx"), F.col(y).alias("y"), F.col("n" + y).alias("ny"), "pair")
    return edges.select(F.explode(F.array(seen("a", "b"), seen("b", "a"))).alias("end")).select("end.*")


def accepted_joins(edges: DataFrame, cap: int) -> DataFrame:
    """(u, v): joins whose components are those of a serial replay of edges (a, na, b, nb, pair; na and nb: reads of the
    components a and b, pair: unique), which in the order of ``pair`` unites two components unless both exceed the cap.

    A block is a set of components that are one at some moment of the replay; small if it has ``cap`` reads or fewer.
    A small block unites along its earliest edge, whatever is there by then, and these joins are all there are, as two
    blocks over the cap stay apart. So only blocks are to be found. Small blocks that point along their earliest edges
    form trees, in which edges get earlier towards the root. Let p be the earliest edge that leaves a tree. Before p the
    root's block holds exactly those whose own edge is earlier than p. If that is a small block, it is one from now on,
    and the others still wait; if not, or if the tree points to a block over the cap, all of its members end in one over
    the cap and point nowhere any more. Two earliest edges meet in the root of every tree, and of these only blocks found
    anew can be part, so the number of trees at least halves: O(log n) rounds of joins and combined aggregates.
    """
    spark, joins = edges.sparkSession, []
    e = materialize(edges.where(F.least("na", "nb") <= cap), "open")
    while not e.isEmpty():
        small = _ends(e).where(F.col("nx") <= cap)
        first = small.groupBy("x").agg(F.max("nx").alias("nx"), F.min(F.struct("pair", "y", "ny")).alias("first")).select("x", "nx", "first.*")
        first = materialize(first, "first")
        joins.append(materialize(first.select(F.col("x").alias("u"), F.col("y").alias("v")), "joins"))
        trees = connected_components(first.where(F.col("ny") <= cap).select(F.col("x").alias("u"), F.col("y").alias("v")))
        member = materialize(first.join(trees, F.col("x") == F.col("id"), "left").select("x", "nx", "pair", (F.col("ny") > cap).alias("shut"), F.coalesce("label", "x").alias("tree")), "trees")
        discard(first)
        own = lambda side: member.select(F.col("x").alias(side), F.col("tree").alias("t" + side), F.col("pair").alias("f" + side))
        placed = materialize(e.join(own("a"), "a", "left").join(own("b"), "b", "left"), "placed")  # one over the cap has no tree
        discard(e)
        leaving = placed.where(~F.col("ta").eqNullSafe(F.col("tb"))).select(F.explode(F.array("ta", "tb")).alias("tree"), "pair").where("tree IS NOT NULL")
        until = leaving.groupBy("tree").agg(F.min("pair").alias("until"))
        inside = F.col("until").isNull() | (F.col("pair") < F.col("until"))
        plan = member.join(until, "tree", "left").groupBy("tree").agg(
            F.max("until").alias("until"), F.coalesce(F.sum(F.when(inside, F.col("nx"))), F.lit(0)).alias("n"), F.max(F.when(inside, F.col("x"))).alias("name"), F.max("shut").alias("shut"), F.max("x").alias("last")
        )
        over = F.col("shut") | (F.col("n") > cap)
        plan = materialize(plan.select("tree", F.when(~over, F.col("until")).alias("until"), F.when(over, F.lit(cap + 1)).otherwise(F.col("n")).alias("n"), F.when(over, F.col("last")).otherwise(F.col("name")).alias("name")), "plan")
        discard(member)
        for side in ("a", "b"):
            of = plan.select(F.col("tree").alias("t" + side), "until", F.col("n").alias("size"), "name")
            moves = F.col("name").isNotNull() & (F.col("until").isNull() | (F.col("f" + side) < F.col("until")))
            placed = placed.join(of, "t" + side, "left").withColumns({side: F.when(moves, F.col("name")).otherwise(F.col(side)), "n" + side: F.when(moves, F.col("size")).otherwise(F.col("n" + side))}).drop("until", "size", "name")
        apart = placed.where(F.col("a") != F.col("b")).where(F.least("na", "nb") <= cap)
        turned = F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb"))
        ordered = apart.select(F.when(F.col("a") > F.col("b"), turned[0]).otherwise(turned[1]).alias("edge"), "pair").select("edge.*", "pair")
        e = materialize(ordered.groupBy("a", "b").agg(F.max("na").alias("na"), F.max("nb").alias("nb"), F.min("pair").alias("pair")), "open")
    out = spark.createDataFrame([], "u long, v long")
    for found in joins:
        out = out.union(found)
    return out


def merge_mates(labels: DataFrame, pairs: DataFrame, cap: int = 1000) -> DataFrame:
    """(read_id, comp_id) after the mates' components are united, in ascending order of pairs, wherever one of the two
    has ``cap`` reads or fewer at that moment; the larger id names the union.

    Sizes only grow, so components over the cap (giants) never unite with one another, whatever joins them, and of the
    pairs between the same two components the first decides. Without its giants the graph of components therefore falls
    into clusters that can't touch each other. A cluster of no more reads than the cap in all unites as a whole, and with
    its giant if it has one. For clusters that exceed the cap by small components alone, or lie between several giants,
    ``accepted_joins`` finds what the order of pairs leads to.
    """
    sizes = labels.groupBy("comp_id").agg(F.count("*").alias("n"))
    left, right = labels.select(F.col("read_id").alias("a"), F.col("comp_id").alias("c1")), labels.select(F.col("read_id").alias("b"), F.col("comp_id").alias("c2"))
    joined = pairs.join(left, "a").join(right, "b").where("c1 <> c2").select(F.greatest("c1", "c2").alias("c1"), F.least("c1", "c2").alias("c2"), F.col("a").alias("pair"))
    first = joined.groupBy("c1", "c2").agg(F.min("pair").alias("pair"))
    sized = first.join(sizes.select(F.col("comp_id").alias("c1"), F.col("n").alias("n1")), "c1").join(sizes.select(F.col("comp_id").alias("c2"), F.col("n").alias("n2")), "c2")
    edges = materialize(sized.where(F.least("n1", "n2") <= cap), "mates")

    small = edges.select(F.explode(F.array(F.struct(F.col("c1").alias("id"), F.col("n1").alias("n")), F.struct(F.col("c2").alias("id"), F.col("n2").alias("n")))).alias("x")).select("x.*").where(F.col("n") <= cap).distinct()
    joins = connected_components(edges.where((F.col("n1") <= cap) & (F.col("n2") <= cap)).select(F.col("c1").alias("u"), F.col("c2").alias("v")), "max")
    member = materialize(small.join(joins, "id", "left").select("id", "n", F.coalesce("label", "id").alias("cluster")), "clusters")
    inner = F.when(F.col("n1") <= cap, F.col("c1")).otherwise(F.col("c2"))  # an edge has a small end, and the cluster of that
    placed = edges.withColumn("id", inner).join(member.select("id", "cluster"), "id").drop("id")
    giant = F.when(F.col("n1") > cap, F.col("c1")).when(F.col("n2") > cap, F.col("c2"))
    around = placed.groupBy("cluster").agg(F.min(giant).alias("g1"), F.max(giant).alias("g2"))
    plan = member.groupBy("cluster").agg(F.sum("n").alias("total")).join(around, "cluster").withColumn("whole", (F.col("total") <= cap) & F.col("g1").eqNullSafe(F.col("g2")))
    plan = materialize(plan.select("cluster", "g1", "whole"), "plan")
    moved = member.join(plan.where("whole"), "cluster").select(F.col("id").alias("comp_id"), F.coalesce("g1", "cluster").alias("merged"))
    bound = placed.join(plan.where("NOT whole").select("cluster"), "cluster").select(F.col("c1").alias("a"), F.col("n1").alias("na"), F.col("c2").alias("b"), F.col("n2").alias("nb"), "pair")
    replayed = materialize(connected_components(accepted_joins(bound, cap), "max"), "replayed")
    if not replayed.isEmpty():
        root = replayed.select(F.col("id").alias("merged"), F.col("label").alias("root"))  # a giant may have whole clusters too
        moved = moved.join(root, "merged", "left").select("comp_id", F.coalesce("root", "merged").alias("merged")).union(replayed.where("id <> label"))
    moved = materialize(moved, "moved")
    names = moved.groupBy("merged").agg(F.greatest(F.max("comp_id"), F.col("merged")).alias("name"))
    every = moved.join(names, "merged").select("comp_id", "name").union(names.select("merged", "name")).distinct()
    return labels.join(every, "comp_id", "left").select("read_id", F.coalesce("name", "comp_id").alias("comp_id"))


def merge_supported(labels: DataFrame, pairs: DataFrame, support: int) -> DataFrame:
    """Unite components that more than ``support`` mate pairs join. Optional: no plan uses it by default."""
    left, right = labels.select(F.col("read_id").alias("a"), F.col("comp_id").alias("u")), labels.select(F.col("read_id").alias("b"), F.col("comp_id").alias("v"))
    joined = pairs.join(left, "a").join(right, "b").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    strong = joined.groupBy("u", "v").count().where(F.col("count") > support)
    merged = connected_components(strong.select("u", "v"), "max")
    return labels.join(merged, F.col("comp_id") == F.col("id"), "left").select("read_id", F.coalesce("label", "comp_id").alias("comp_id"))
