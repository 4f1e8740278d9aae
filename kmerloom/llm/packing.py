"""Token packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of pieces."""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, slices

EOS = 0
#: Pieces of a group at most, on average: groups multiply with the input, their size doesn't grow.
GROUP_PIECES = 20_000
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


@functools.cache
def encoder(path: str):
    """A function from text to its ids, a uint32 array: those of ``tokenizers`` for this file.

    Plain texts go through tiktoken over the same ranks, several times as fast; texts with the string of an added
    token go to ``tokenizers`` itself. A file that isn't a plain byte-level BPE goes to ``tokenizers`` always.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    slow = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
    spec = json.load(open(path, encoding="utf-8"))
    plain = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
    if spec["normalizer"] or any((spec["pre_tokenizer"] or {}).get(k) != v for k, v in plain.items()) or spec["model"]["type"] != "BPE":
        return slow
    import tiktoken
    from public_tokenizers import PATTERN

    added = {x["content"]: x["id"] for x in spec["added_tokens"]}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]  # bytes that stand for themselves
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ranks = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    fast = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        return slow(text) if any(x in text for x in added) else np.asarray(fast.encode_to_numpy(text, disallowed_special=()), np.uint32)

    return encode


def _pieces(path: str, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.append(encode(text or ""), np.uint32(EOS)).astype("<u4")
                data = ids.tobytes()
                for start in range(0, len(ids), size):
                    out.append((doc_id, start, min(size, len(ids) - start), zlib.crc32(data[4 * start : 4 * (start + size)]), len(ids)))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


class Tournament:
    """Remaining capacities of bins under a complete binary tree of maxima: first fit in a logarithmic walk."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (max(1, bins) - 1).bit_length())
        self.best = [capacity] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """Put an item in the first bin that has room for it."""
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < size:
                at += 1
        best[at] -= size
        node = at >> 1
        while node:
            top = max(best[2 * node], best[2 * node + 1])
            if best[node] == top:
                break
            best[node] = top
            node >>= 1
        return at - self.leaves


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item; ties keep their order."""
    order = np.argsort(-sizes, kind="stable")
    tree, used = Tournament(len(sizes), capacity), {}
    bins, offsets = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    for i in order.tolist():
        size = int(sizes[i])
        b = tree.place(size)
        bins[i], offsets[i] = b, used.get(b, 0)
        used[b] = offsets[i] + size
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """Pack documents into sequences of at most ``size`` tokens; one row per piece.

    A document is its ids and id 0 (null or empty text: id 0 alone). It is cut at multiples of ``size``: full pieces
    fill a sequence each, the rests are packed first-fit decreasing, in groups that a hash deals. Rows: doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id (group * 2**32 + bin), offset. Repeated rows and rows of null doc_id
    are packed each on its own: equal pieces are counted and numbered, so that they fall in different groups. An empty
    table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    n, most = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    groups = max(1, -(-(n + most // size) // group_pieces))  # a token has a byte or more, so this bounds the pieces
    pieces = map_arrow(rows, _pieces(tokenizer, size), PIECES)
    alike = pieces.groupBy(pieces.columns).agg(F.count("*").alias("copies"))
    numbered = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    dealt = numbered.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "copy"), F.lit(groups))).drop("copies", "copy")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        bins, pdf["offset"] = first_fit_decreasing(pdf["length"].to_numpy(), size)
        pdf["sequence_id"] = pdf["group"] * (1 << 32) + bins
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return dealt.groupBy("group").applyInPandas(solve, f"{PIECES}, sequence_id long, offset long")
