"""A corpus pipeline from the training-data operators: classify, cut recurring lines, deduplicate, decontaminate, pack."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kmerloom.llm import queries
from kmerloom.llm.common import table
from kmerloom.llm.decontaminate import drop_contaminated
from kmerloom.llm.linededup import drop_recurring_lines
from kmerloom.llm.packing import pack
from kmerloom.llm.simhash import drop_near_duplicates
from kmerloom.storage import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts."""
    from kmerloom.llm.puquality import drop_rejected

    return drop_rejected(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of templates that recur across documents."""
    return drop_recurring_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates.

    Rows are linked by op5's operator: SimHash fingerprints within two bits, found by the segment-popcount grid and the
    exact Hamming check. Documents whose five-word shingles have a Jaccard similarity of 0.8 or more, which mostly differ
    in a seventh of these bits and so lie beyond the grid's radius, are linked besides, by min-wise bands and that exact
    similarity. Groups are the components of both kinds of links.
    """
    return drop_near_duplicates(docs, radius=2)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return pack(docs, queries.tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]

#: Trained models, SimHash and the tokenizer have no SQL form: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's output stored and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
