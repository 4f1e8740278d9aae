"""Reads derived from text tables: letters become bases, so that any text corpus can be partitioned or tested with."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from kmerloom.arrow import map_arrow
from kmerloom.operators.prefix import dense_ids, exclusive_sum
from kmerloom.storage import discard, materialize

ALPHABET, BASES = "abcdefghijklmnopqrstuvwxyz", "ACGT" * 6 + "AC"
#: Bytes of text that are looked up at once.
SLICE = 1 << 18


def encode_text(text: Column) -> Column:
    """All letters of the lower-cased text as bases, in turn of the alphabet; other letters than a to z are N."""
    letters = F.regexp_replace(F.lower(text), r"[^\p{L}]+", "")
    return F.regexp_replace(F.translate(letters, ALPHABET, BASES), "[^ACGT]", "N")


@cache
def _letters(spark: SparkSession) -> tuple[np.ndarray, np.ndarray]:
    """What encode_text makes of every code point, as (first code points, bytes) of ranges with one byte; 0: no letter.
    Beyond the first four planes there are no letters."""
    text = F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')")
    found = spark.range(0x40000).where("id NOT BETWEEN 55296 AND 57343").select("id", F.ascii(encode_text(text)).alias("base")).where("base > 0").toArrow()
    table = np.zeros(0x110000, np.uint8)
    table[found["id"].to_numpy()] = found["base"].to_numpy()
    first = np.flatnonzero(np.diff(table, prepend=255))
    return first, table[first]


def encoded(rows: DataFrame, text: str, bases: str) -> DataFrame:
    """rows with encode_text of the column ``text`` as the column ``bases`` instead of it, looked up by code points.

    A slice of a batch is worked on at a time, wherever texts begin and end, so a text may have any length."""
    first, letters = _letters(rows.sparkSession)
    names = [c for c in rows.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.repeat(letters, np.diff(np.r_[first, 0x110000]))
        for batch in batches:
            texts = batch.column(text).cast(pa.large_string())
            _, offsets, data = texts.buffers()
            at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
            at, ends, parts, kept, a = at - at[0], np.zeros(len(at), np.int64), [], 0, 0
            while a < len(data):
                b = min(a + SLICE, len(data))
                while b < len(data) and data[b] & 0xC0 == 0x80:
                    b += 1
                own = data[a:b]
                if own.max() < 128:
                    base = table[own]
                else:
                    base, begins = np.zeros(len(own), np.uint8), (own & 0xC0) != 0x80
                    points = np.frombuffer(own.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
                    base[begins] = table[points]
                low, high = np.searchsorted(at, [a, b], side="right")
                count = np.cumsum(base > 0)
                ends[low:high] = kept + count[at[low:high] - a - 1]
                parts.append(base[base > 0])
                kept, a = kept + int(count[-1]), b
            found = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.concatenate(parts) if parts else b"")])
            if texts.null_count:
                found = pc.if_else(texts.is_valid(), found, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), found], names=[*names, bases])

    return map_arrow(rows, run, StructType([*(rows.schema[c] for c in names), StructField(bases, StringType())]))


def document_reads(documents: DataFrame, length: int = 100, stride: int = 60, paired: bool = False) -> DataFrame:
    """(read_id, mate_id, doc_id, seq): overlapping fragments over the whole length of every document; ids are dense in
    (doc_id, fragment). Paired: fragments 2j and 2j + 1 are mates, and a last one without a mate is a single read.

    A text is encoded once and stored; documents are numbered by rows without text, which join it again; one pass of a
    pattern then cuts a text, whatever its length. Texts without letters have no reads; of rows of one doc_id that of the
    smaller hash comes first.
    """
    return _fragments(_stored_bases(documents, stride), length, stride, paired)


def stored_document_reads(documents: DataFrame, length: int = 100, stride: int = 60, paired: bool = False) -> DataFrame:
    """The reads of document_reads, stored; encoded texts are deleted once they are cut."""
    encoded = _stored_bases(documents, stride)
    reads = materialize(_fragments(encoded, length, stride, paired), "reads")
    discard(encoded)
    return reads


def _stored_bases(documents: DataFrame, stride: int) -> DataFrame:
    rows = documents.select("doc_id", F.xxhash64("text").alias("hash"), F.make_valid_utf8("text").alias("text"), F.monotonically_increasing_id().alias("tie"))
    return materialize(encoded(rows, "text", "bases").withColumn("n", F.coalesce(F.ceil(F.length("bases") / stride), F.lit(0)).cast("long")), "encoded")


def _fragments(stored: DataFrame, length: int, stride: int, paired: bool) -> DataFrame:
    first = exclusive_sum(stored.select("doc_id", "hash", "tie", "n"), ["doc_id", "hash", "tie"], "n", "first").select("tie", "first")
    cut = F.regexp_extract_all("bases", F.lit(f"(?=(.{{1,{length}}})).{{1,{stride}}}"), F.lit(1))
    parts = stored.where("n > 0").join(first, "tie").select("doc_id", "n", "first", F.posexplode(cut).alias("o", "seq"))
    read_id = (F.col("first") + F.col("o")).alias("read_id")
    mate = F.expr("CASE WHEN o % 2 = 1 THEN first + o - 1 WHEN o + 1 < n THEN first + o + 1 END") if paired else F.lit(None).cast("long")
    return parts.select(read_id, mate.alias("mate_id"), "doc_id", "seq")


def conversation_reads(conversations: DataFrame) -> DataFrame:
    """(read_id, mate_id, seq): every turn is a read of its whole text; ids are dense in (conv_id, turn). Turns 2j and
    2j + 1 of a conversation are mates. A turn without the other one, or of which there are several, is a single read."""
    turns = conversations.select("conv_id", F.expr("turn div 2").alias("j"), "turn", encode_text(F.coalesce("text", F.lit(""))).alias("seq"))
    numbered = materialize(dense_ids(turns, ["conv_id", "turn"], "read_id"), "numbered")
    pairs = numbered.groupBy("conv_id", "j").agg(F.min("read_id").alias("a"), F.max("read_id").alias("b"), F.count("*").alias("n"), F.min("turn").alias("low"), F.max("turn").alias("high"))
    mated = pairs.where("n = 2 AND low < high").select(F.expr("stack(2, a, b, b, a) AS (read_id, mate_id)"))
    return numbered.join(mated, "read_id", "left").select("read_id", "mate_id", "seq")
