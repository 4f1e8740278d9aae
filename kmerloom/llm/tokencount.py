"""Token counts under a unigram model by dynamic programming on a trie.

The distinct pre-tokens of a batch are inserted in a byte trie. A node stands for a prefix; its forward score is the
best log-probability of any segmentation of that prefix into vocabulary pieces, which depends on the path alone, so it
is computed once however many pre-tokens share the prefix. A terminal node stores the number of pieces of its best
segmentation, and a text's count is the sum over its pre-tokens. Only the open path is held.
"""

from __future__ import annotations

import functools
import json
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, raw, slices

#: Bytes that remembered pre-tokens may take in a Python worker, of which each takes some ENTRY beside its own; beyond, the
#: worker starts anew. Longer pre-tokens than LONGEST are counted wherever they occur.
REMEMBERED, ENTRY, LONGEST = 64 << 20, 130, 1 << 10


@functools.cache
def unigram_scores(path: str) -> dict[bytes, float]:
    """Piece -> log-probability, from the rank order of a byte-level BPE vocabulary file.

    Pieces of two bytes or more follow Zipf's law over their ids (1 / (id + 2.7)); the 256 single bytes, which any text
    can fall back to, share the rank after the last. Scores are multiples of 2**-20, so that sums are exact and ties
    don't depend on the order of addition.
    """
    spec = json.load(open(path, encoding="utf-8"))
    added = {x["content"] for x in spec["added_tokens"]}
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    pieces = {bytes(of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in added}
    weight = {p: 1 / ((i if len(p) > 1 else len(pieces)) + 2.7) for p, i in pieces.items()}
    total = sum(weight.values())
    return {p: round(math.log(w / total) * (1 << 20)) / (1 << 20) for p, w in weight.items()}


def suffix_tree(scores: dict[bytes, float]) -> dict:
    """The pieces in a trie of their reversed bytes: byte -> [score or None, deeper nodes]."""
    top: dict = {}
    for piece, score in scores.items():
        at = top
        for b in piece[:0:-1]:
            at = at.setdefault(b, [None, {}])[1]
        at.setdefault(piece[0], [None, {}])[0] = score
    return top


def deepest(tree: dict) -> int:
    return 1 + max((deepest(below) for _, below in tree.values()), default=-1)


class Trie:
    """Words must come in ascending order: then a branch that is left is never entered again, and the open path is all of
    the trie that has to be held, a score and a number of pieces for each of its nodes.

    Of a word's bytes beyond ``LONGEST`` only the last few nodes are held that a piece reaches back to: that far down no
    prefix is shared, and a word of any length takes the same memory.
    """

    def __init__(self, suffixes: dict):
        self.suffixes, self.reach = suffixes, deepest(suffixes)
        self.score, self.pieces = [0.0], [0]  # of the best segmentation of a node's prefix; of equal scores, the fewest pieces
        self.word = b""

    def _extend(self, word: bytes, score: list[float], pieces: list[int], begin: int, end: int, first: int) -> None:
        """Append the nodes of the bytes begin to end; the lists begin with the node of the first ``first`` bytes."""
        for at_byte in range(begin, end):
            best, fewest, at, start = -math.inf, 0, self.suffixes, at_byte
            while start >= 0:
                node = at.get(word[start])
                if node is None:
                    break
                if node[0] is not None:
                    s, n = score[start - first] + node[0], pieces[start - first] + 1
                    if s > best or s == best and n < fewest:
                        best, fewest = s, n
                at, start = node[1], start - 1
            score.append(best)
            pieces.append(fewest)

    def insert(self, word: bytes) -> int:
        """Number of pieces of the word's best segmentation: what its terminal node stores."""
        head, shared = word[:LONGEST], 0
        for a, b in zip(self.word, head):
            if a != b:
                break
            shared += 1
        score, pieces = self.score, self.pieces
        del score[shared + 1 :], pieces[shared + 1 :]
        self._extend(word, score, pieces, shared, len(head), 0)
        self.word = head
        if len(word) == len(head):
            return pieces[-1]
        for begin in range(len(head), len(word), LONGEST):
            first = max(0, begin - self.reach)
            score, pieces = score[first - begin - 1 :], pieces[first - begin - 1 :]
            self._extend(word, score, pieces, begin, min(begin + LONGEST, len(word)), first)
        return pieces[-1]


class Memory:
    """Counts of pre-tokens, bounded in bytes."""

    def __init__(self, suffixes: dict, limit: int):
        self.suffixes, self.limit, self.size, self.counts = suffixes, limit, 0, {}

    def count(self, texts: list[list[bytes]]) -> list[int]:
        """Tokens of every text, given as its pre-tokens."""
        distinct = set().union(*texts)
        new = distinct.difference(self.counts)
        size = sum(map(len, new)) + ENTRY * len(new)
        if self.size + size > self.limit:
            self.counts, self.size, new = {}, 0, distinct
            size = sum(map(len, new)) + ENTRY * len(new)
        trie = Trie(self.suffixes)
        for w in sorted(new):
            self.counts[w] = trie.insert(b" " + w)
        self.size += size
        tokens = [sum(map(self.counts.__getitem__, ws)) for ws in texts]
        for w in new:
            if len(w) > LONGEST:
                self.size -= len(w) + ENTRY
                del self.counts[w]
        return tokens


@functools.cache
def _memory(path: str, limit: int) -> Memory:
    return Memory(suffix_tree(unigram_scores(path)), limit)


def _count(path: str, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = _memory(path, limit)
        for batch in slices(batches):
            words = [(t or b"").split() for t in raw(batch)]
            columns = [batch.column("doc_id"), pa.array(map(len, words), pa.int64()), pa.array(memory.count(words), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, remembered: int = REMEMBERED) -> DataFrame:
    """One row per input row: doc_id, n_pretokens, n_tokens.

    Pre-tokens are the runs other than space and 09-0D, each with one space in front. Null, empty and blank texts
    count 0. Repeated rows and null doc_ids are counted like any other; an empty table gives an empty result; other
    columns are ignored.
    """
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), _count(vocabulary, remembered), "doc_id long, n_pretokens long, n_tokens long")
