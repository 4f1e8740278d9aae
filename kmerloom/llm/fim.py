"""Fill-in-middle by bit-parallel work on big integers.

A text's UTF-8 bytes are turned into class masks by ``bytes.translate``: one bit a byte, in one integer as long as the
text. Shifted boolean operations mark where lines begin, ``bit_count`` gives their number, and the beginning of the line
of a rank is found by halving: count the lower half's bits and go on in the half that holds the ranked one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, raw, slices

#: Before the prefix, the suffix and the middle.
MARKERS = ("<P>", "<S>", "<M>")
LINE_END = bytes.maketrans(bytes(range(256)), b"0" * 10 + b"1" + b"0" * 245)
#: Every UTF-8 byte but a continuation begins a code point.
LEAD = bytes.maketrans(bytes(range(256)), b"1" * 128 + b"0" * 64 + b"1" * 64)
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def class_mask(data: bytes, table: bytes) -> int:
    """Bit i is set if the table has a 1 for byte i."""
    return int(data.translate(table)[::-1] or b"0", 2)


def ranked_bits(mask: int, width: int, ranks: list[int]) -> list[int]:
    """The positions of the set bits of these ranks (from 0, rising) in a mask of ``width`` bits."""
    if not ranks:
        return []
    if width == 1:
        return [0] * len(ranks)
    half = width // 2
    low = mask & (1 << half) - 1
    n = low.bit_count()
    upper = ranked_bits(mask >> half, width - half, [r - n for r in ranks if r >= n])
    return ranked_bits(low, half, [r for r in ranks if r < n]) + [half + x for x in upper]


def line_starts(data: bytes) -> int:
    """A mask of the bytes that begin a line: the first, and those after a line end."""
    return (class_mask(data, LINE_END) << 1 | 1) & (1 << len(data)) - 1


def cut(data: bytes, first: int, second: int) -> tuple[int, int, int]:
    """(number n of lines, bytes before line ``first % (n + 1)``, bytes before line ``second % (n + 1)``), rising."""
    starts = line_starts(data)
    n = starts.bit_count()
    ranks = sorted((first % (n + 1), second % (n + 1)))
    at = ranked_bits(starts, len(data), [r for r in ranks if r < n])
    return n, *(at + [len(data)] * (2 - len(at)))


def fill_in_middle(docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, markers: tuple[str, str, str] = MARKERS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): every row's text with a middle of whole lines moved last.

    h1 to h4 are the first four 8-digit groups of the hex sha256 of "<seed>:<doc_id>" (nothing after the colon for a null
    doc_id). The prefix ends after the smaller of h1 % (n + 1) and h2 % (n + 1) of the text's n lines, the middle after the
    larger. form: plain if the text is empty, holds a marker or h3 % 100 >= fim_percent; else spm if h4 % 100 <
    spm_percent, else psm. Null texts are empty ones; a plain output is the text itself, with null numbers of characters.
    Lines end after \\n only; texts may have any length. Rows of one doc_id are cut alike; repeated rows stay; an empty
    table gives an empty result; other columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    kind = F.when(h[2] % 100 >= fim_percent, "plain").when(h[3] % 100 < spm_percent, "spm").otherwise("psm")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h[0].alias("first"), h[1].alias("second"), kind.alias("form"), "text")
    p, s, m = (x.encode() for x in markers)
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def moved(data: bytes, first: int, second: int, form: str) -> tuple:
        n, a, b = cut(data, first, second)
        if form == "plain" or not data or p in data or s in data or m in data:
            return n, "plain", None, None, data
        lead = class_mask(data, LEAD)
        prefix = (lead & (1 << a) - 1).bit_count()
        middle = (lead & (1 << b) - 1).bit_count() - prefix
        parts = [s, data[b:], p, data[:a], m, data[a:b]] if form == "spm" else [p, data[:a], s, data[b:], m, data[a:b]]
        return n, form, prefix, middle, b"".join(parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            given = (batch.column(c).to_pylist() for c in ("first", "second", "form"))
            n, form, prefix, middle, output = zip(*(moved(t or b"", *x) for t, *x in zip(raw(batch), *given)))
            numbers = [pa.array(x, pa.int64()) for x in (n, prefix, middle)]
            columns = [batch.column("doc_id"), numbers[0], pa.array(form), *numbers[1:], pa.array(output, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return map_arrow(rows, run, SCHEMA)


def restored(output: Column, form: Column, markers: tuple[str, str, str] = MARKERS) -> Column:
    """The text that an output was made of. A text that holds a marker is plain, so each stands once in other outputs."""
    parts = F.split(output, "|".join(re.escape(x) for x in markers))
    part = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)


def digests(docs: DataFrame) -> DataFrame:
    """fill_in_middle's rows with sha256 digests of the output and of the text restored from it, in place of the output."""
    moved = fill_in_middle(docs)
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
