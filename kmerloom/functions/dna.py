"""Column expressions on bases and k-mers. All are built-in functions and stay in generated code.

Bases are numbered A 0, C 1, G 2, T 3 and N 4. A k-mer of up to ``PACKED`` bases is a long, its base-4 number; a longer
one is its text. Both order as the text does.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

#: Bases of the bucket prefix, and of the longest k-mer that fits a long.
PREFIX, PACKED = 10, 31
BASES = "ACGTN"
#: Ties between neighbour bases go by this order.
CODE_ORDER = "ACTG"


def code(base: str) -> Column:
    return F.lit(BASES.index(base)).cast("tinyint")


def base_text(base: Column) -> Column:
    """The letter of a base's number; null for null."""
    return F.substring(F.lit(BASES), base.cast("int") + 1, F.lit(1))


def kmer_text(kmer: Column, k: int) -> Column:
    """The letters of a k-mer, looked up four bases at a time."""
    if k > PACKED:
        return kmer
    parts = []
    for left in range(k, 0, -4):
        n = min(4, left)
        words = F.split(F.lit(" ".join(map("".join, product("ACGT", repeat=n)))), " ")  # a constant of the plan
        parts.append(F.get(words, F.shiftrightunsigned(kmer, 2 * (left - n)).bitwiseAND(F.lit(4**n - 1)).cast("int")))
    return F.concat(*parts)


def bucket(kmer: Column, k: int, bases: int = PREFIX) -> Column:
    """Rank of the leading bases: their base-4 number."""
    if k > PACKED:
        return F.conv(F.translate(F.substring(kmer, 1, bases), "ACGT", "0123"), 4, 10).cast("int")
    return F.shiftright(kmer, 2 * max(0, k - bases)).cast("int")


def other_than_a(kmers: DataFrame) -> Column:
    """Whether the column kmer holds another base than A."""
    return F.col("kmer") != 0 if kmers.schema["kmer"].dataType == LongType() else F.ltrim(F.col("kmer"), F.lit("A")) != ""
