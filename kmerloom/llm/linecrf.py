"""Quality rules with line labels: a linear-chain conditional random field marks lines as content or boilerplate.

Lines are the positions of a chain with two labels. Emission scores are linear in the features of a line, transition
scores are a two-by-two table; Viterbi decoding gives the best labelling of a document. The model is fitted here, to
evidence that its features don't hold: whether a line recurs in other documents of the whole table, and the quality marks
of a bounded sample of documents. In a document of quality 1 lines that recur are boilerplate and all others content, so
labels change inside documents; a document of which most lines recur is a copy, which tells nothing, and is left out. The
lines of a document of quality 0 are boilerplate with less weight, since its mark is of the whole. The log-likelihood of
these labels, with gradients by forward-backward, is maximised. Without documents of both kinds, rules of high precision
label the lines instead. A document stays if its base statistics pass and enough of its words stand in content lines.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, raw, slices, splitmix
from kmerloom.llm.sampling import hashed_sample, remainder

#: Documents fitted on at most, lines of a run, and runs of each: all of a shorter document, else those of least hash.
#: Documents whose crc32(doc_id as text) is divisible by HELD_OUT are never fitted on.
DOCUMENTS, LINES, RUNS, HELD_OUT = 1000, 40, 4, 5
CONTENT_SHARE = 0.5
#: Documents in which a line stands that recurs; share of a run's lines that recur in a copy; weight of quality 0.
RECURS, COPIED, WEAK = 3, 0.5, 0.25
SYMBOLS, UPPER, DIGITS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))
CONTINUATION = bytes(range(128, 192))  # of UTF-8: every other byte begins a code point
LEGAL = re.compile(rb"(?i)licen[sc]e|copyright|all rights reserved|cookie|https?://|www\.|\xc2\xa9")
FEATURES, STEPS, RATE, DECAY = 15, 200, 0.3, 1e-5
CONTENT, BOILERPLATE = 0, 1


def line_features(line: bytes, words: list[bytes], before: bool, after: bool, first: bool, last: bool) -> tuple:
    """Features of a line that has words; before and after: an equal line stands there; first and last of the document."""
    n, size = len(words), len(line)
    count = lambda chars: size - len(line.translate(None, chars))
    return (
        1.0,
        min(n, 40) / 40,
        min(1.0, count(SYMBOLS) / n),
        count(UPPER) / size,
        min(1.0, line.count(b"!") / n),
        min(1.0, 3 * count(DIGITS) / size),
        float(line.rstrip().endswith((b".", b"!", b"?", b":", b'"'))),
        min(1.0, line.count(b"|") / n),
        sum(map(eq, words, words[1:])) / n,
        float(before),
        len(set(words)) / n,
        float(LEGAL.search(line) is not None),
        float(after),
        float(first),
        float(last),
    )


def seed_label(f: tuple) -> int:
    """Boilerplate if symbols, capitals, bars or repeats dominate, or a short line has legal or link words."""
    _, length, symbols, upper, bangs, digits, _, bars, adjacent, repeated, distinct, legal, *_ = f
    odd = symbols > 0.3 or upper > 0.4 or bangs > 0.4 or bars > 0.3 or adjacent > 0.3 or digits > 0.6 or distinct < 0.3
    return BOILERPLATE if odd or repeated or legal and length < 0.5 else CONTENT


class Chain:
    """Weights of a linear-chain CRF with two labels."""

    def __init__(self):
        self.emit, self.move = np.zeros((FEATURES, 2)), np.zeros((2, 2))

    def gradient(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log-likelihood per line and its gradients; x (n, t, FEATURES), y and mask (n, t): padded chains; weight (n)
        of each chain, 1 if None."""
        n, t, _ = x.shape
        weight = np.ones(n) if weight is None else weight
        e = x @ self.emit
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = e[:, 0]
        for i in range(1, t):
            step = np.logaddexp.reduce(alpha[:, i - 1, :, None] + self.move, axis=1) + e[:, i]
            alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
        z = np.logaddexp.reduce(alpha[:, -1], axis=1)
        for i in range(t - 2, -1, -1):
            step = np.logaddexp.reduce(self.move + (e[:, i + 1] + beta[:, i + 1])[:, None, :], axis=2)
            beta[:, i] = np.where(mask[:, i + 1, None], step, 0)
        single = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
        gold = np.eye(2)[y] * mask[..., None]
        emit = np.einsum("ntf,ntk->fk", x, (gold - single) * weight[:, None, None])
        both = mask[:, 1:] & mask[:, :-1]
        pair = np.exp(alpha[:, :-1, :, None] + self.move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - z[:, None, None, None]) * both[..., None, None]
        gold_pair = gold[:, :-1, :, None] * gold[:, 1:, None, :]
        total = (mask.sum(axis=1) * weight).sum()
        value = (((e * gold).sum(axis=(1, 2)) + (gold_pair * self.move).sum(axis=(1, 2, 3)) - z) * weight).sum()
        return value / total, emit / total, ((gold_pair - pair).sum(axis=1) * weight[:, None, None]).sum(axis=0) / total

    def viterbi(self, e: np.ndarray) -> list[int]:
        """The best labels for emission scores e (t, 2); of equal scores content wins."""
        (cc, cb), (bc, bb) = self.move.tolist()
        back, (c, b) = [], e[0].tolist()
        for ec, eb in e[1:].tolist():
            from_c, from_b = c + cc >= b + bc, c + cb >= b + bb
            c, b = (c + cc if from_c else b + bc) + ec, (c + cb if from_b else b + bb) + eb
            back.append((CONTENT if from_c else BOILERPLATE, CONTENT if from_b else BOILERPLATE))
        labels = [CONTENT if c >= b else BOILERPLATE]
        for step in reversed(back):
            labels.append(step[labels[-1]])
        return labels[::-1]


def fit(documents: list[tuple[list[tuple], int | None, list[bool]]]) -> Chain:
    """Adam on the likelihood of the labels of lines; documents are lists of line features, each with its quality and
    with whether each line recurs in others.

    Without documents of both qualities seed labels take their place. Without any line weights stay zero.
    """
    chain = Chain()
    documents = [d for d in documents if d[0]]
    if {q for _, q, _ in documents} >= {0, 1}:
        labelled = [(d, [BOILERPLATE] * len(d), WEAK) for d, q, _ in documents if q == 0]
        labelled += [(d, [BOILERPLATE if r else CONTENT for r in recurs], 1.0) for d, q, recurs in documents if q == 1 and sum(recurs) <= COPIED * len(d)]
    else:
        labelled = [(d, [seed_label(f) for f in d], 1.0) for d, *_ in documents]
    if not labelled:
        return chain
    n, t = len(labelled), max(len(d) for d, *_ in labelled)
    x, y, mask = np.zeros((n, t, FEATURES)), np.zeros((n, t), int), np.zeros((n, t), bool)
    weight = np.array([w for *_, w in labelled])
    for i, (d, labels, _) in enumerate(labelled):
        x[i, : len(d)], y[i, : len(d)], mask[i, : len(d)] = d, labels, True
    weights = [chain.emit, chain.move]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(1, STEPS + 1):
        _, *grads = chain.gradient(x, y, mask, weight)
        for w, g, m, v in zip(weights, grads, first, second):
            g = g - DECAY * w
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            w += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return chain


def base_statistics(text: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    blanks = len(text) - sum(map(len, words))
    continued = len(text) - len(text.translate(None, CONTINUATION))
    lines = text.split(b"\n")
    dup = 0
    if len(set(lines)) < len(lines):
        dup = sum(k - 1 for line, k in Counter(lines).items() if k > 1 and line.strip())
    repeat = 0
    if len(words) > 3:
        grams = list(zip(words, words[1:], words[2:]))
        counts = Counter(grams)
        if len(counts) < len(grams):
            hit = np.fromiter((counts[g] > 1 for g in grams), bool, len(grams))
            covered = np.zeros(len(words), bool)
            for i in range(3):
                covered[i : i + len(grams)] |= hit
            repeat = int(covered.sum())
    return len(words), len(text) - blanks - continued, len(text) - len(text.translate(None, SYMBOLS)), dup, repeat


def document_lines(text: bytes) -> tuple[list[tuple], list[int]]:
    """Features and word counts of the \\n-split lines that have words."""
    given = [(line, words) for line in text.split(b"\n") if (words := line.split())]
    left, seen, found = Counter(line for line, _ in given), set(), []
    for i, (line, words) in enumerate(given):
        left[line] -= 1
        found.append(line_features(line, words, line in seen, left[line] > 0, i == 0, i == len(given) - 1))
        seen.add(line)
    return found, [len(words) for _, words in given]


def line_keys(text: bytes) -> list[int]:
    """A hash of each line that has words, without the blanks around it."""
    return [xxhash.xxh64_intdigest(own) - (1 << 63) for line in text.split(b"\n") if (own := line.strip())]


def sampled_runs(text: bytes) -> list[tuple[list[tuple], list[int]]]:
    """Features and keys of at most RUNS runs of LINES lines (the last may be shorter), from anywhere in the document."""
    found, keys = document_lines(text)[0], line_keys(text)
    seed = xxhash.xxh64_intdigest(text)
    starts = sorted(range(0, len(found), LINES), key=lambda a: splitmix(seed + a))[:RUNS]
    return [(found[a : a + LINES], keys[a : a + LINES]) for a in sorted(starts)]


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        runs = [(q, *run) for q, t in zip(batch.column("quality").to_pylist(), raw(batch)) for run in sampled_runs(t or b"")]
        x = pa.array([[v for f in run for v in f] for _, run, _ in runs], pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([pa.array([q for q, *_ in runs], pa.int32()), x, pa.array([k for *_, k in runs], pa.list_(pa.int64()))], names=["quality", "x", "keys"])


def recurring_lines(docs: DataFrame, keys: np.ndarray, least: int = RECURS) -> set[int]:
    """Those of the keys (sorted, of the sample's lines) whose line stands in ``least`` rows of docs or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            own = [np.unique(np.array(line_keys(t or b""), np.int64)) for t in raw(batch)]
            key, n = np.unique(np.concatenate(own), return_counts=True)
            known = np.isin(key, keys)
            yield pa.RecordBatch.from_arrays([pa.array(key[known]), pa.array(n[known])], names=["key", "n"])

    counted = map_arrow(docs.select("text"), run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    return {r.key for r in counted.where(F.col("n") >= least).select("key").collect()}  # of the sample's lines


def train(docs: DataFrame, labels: DataFrame | None = None) -> Chain:
    """Fit on a hashed sample of the documents that labels (doc_id, quality) mark, or of all if there are no labels.

    Whether a line of the sample recurs is counted over all rows of docs.
    """
    fitted = F.coalesce(remainder("doc_id", HELD_OUT) != 0, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long"), "text").where(fitted)
    marks = None
    if labels is not None:
        own = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where(fitted & F.col("quality").isin(0, 1))
        marks = own.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(DOCUMENTS)
    if marks is None or marks.isEmpty():
        marks = hashed_sample(rows.select("doc_id"), DOCUMENTS).distinct().withColumn("quality", F.lit(None).cast("int"))
    chosen = rows.join(F.broadcast(marks), "doc_id").select("quality", "text")  # DOCUMENTS rows of two numbers
    found = map_arrow(chosen, _sampled, "quality int, x array<double>, keys array<long>").collect()  # RUNS runs of DOCUMENTS documents
    keys = np.unique(np.array([k for r in found for k in r["keys"]], np.int64))
    recurring = recurring_lines(docs, keys) if {r.quality for r in found} >= {0, 1} else set()
    split = lambda x: [tuple(x[i : i + FEATURES]) for i in range(0, len(x), FEATURES)]
    ordered = sorted(found, key=lambda r: (r["x"], r["quality"] or 0, r["keys"]))
    return fit([(split(r["x"]), r["quality"], [k in recurring for k in r["keys"]]) for r in ordered])


def apply_rules(docs: DataFrame, labels: DataFrame | None = None, min_words: int = 50, repeat_percent: int = 50, content_share: float = CONTENT_SHARE) -> DataFrame:
    """One row per input row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    content_share.

    Words are runs other than space and 09-0D. base_failed: fewer than ``min_words`` words, or more than
    ``repeat_percent`` in a hundred words stand in three-word windows found twice or more. kept: not base_failed, and
    ``content_share`` or more of the words are in lines decoded as content. Null, empty and blank texts have no words:
    they fail. Of labels of equal score content wins. Repeated rows and null doc_ids are judged like any other; an empty
    table gives an empty result; other columns are ignored. labels (doc_id, quality) is what the field is fitted to;
    repeated labels of one document count once, by the smallest quality.
    """
    chain = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t or b"" for t in raw(batch)]
            words = [t.split() for t in texts]
            base = np.array([base_statistics(t, w) for t, w in zip(texts, words)], np.int64)
            failed = (base[:, 0] < min_words) | (100 * base[:, 4] > repeat_percent * base[:, 0])
            lines = [document_lines(t) for t in texts]
            sizes = [len(f) for f, _ in lines]
            flat = np.array([f for found, _ in lines for f in found]).reshape(-1, FEATURES) @ chain.emit
            ends, share = np.cumsum(sizes), np.zeros(len(texts))
            for i, (_, counts) in enumerate(lines):
                if counts:
                    labels = chain.viterbi(flat[ends[i] - sizes[i] : ends[i]])
                    share[i] = sum(c for c, k in zip(counts, labels) if k == CONTENT) / sum(counts)
            columns = [batch.column("doc_id"), *(pa.array(base[:, j]) for j in range(5)), pa.array(failed), pa.array(~failed & (share >= content_share)), pa.array(share)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"]
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, schema)
