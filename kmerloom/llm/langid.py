"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of two, three and four bytes slide over fixed-length windows of the lower-cased text; each is pooled to its
maximum in the window, cut at zero, and a softmax layer reads the pooled values. Since bytes are discrete, a filter is a
table of 256 values per offset, and two neighbouring offsets fold into one table over byte pairs: applying the network
takes two lookups per position. A document's logits are the mean of those of its windows, which cover the whole text.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, raw, slices
from kmerloom.llm.sampling import remainder

WIDTHS, FILTERS, WINDOW = (2, 3, 4), 8, 256
#: Labelled rows fitted on at most, dealt equally to the languages (to each at most so many), and windows of each row.
ROWS, PER_LANGUAGE, EACH = 4000, 1000, 3
#: A language with fewer windows than this share of the most frequent one's has its windows repeated.
LEAST_SHARE = 0.25
BATCH, STEPS, RATE = 64, 700, 0.01
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def windows(text: bytes) -> np.ndarray:
    """(n, WINDOW) bytes that cover the text, padded with zeros."""
    n = max(1, -(-len(text) // WINDOW))
    return np.frombuffer(text.ljust(n * WINDOW, b"\0"), np.uint8).reshape(n, WINDOW)


class Network:
    def __init__(self, languages: list[str]):
        rng = np.random.default_rng(11)
        self.languages = languages
        self.filters = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
        for f in self.filters:
            f[:, 0] = 0  # padding
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def parameters(self) -> list[np.ndarray]:
        return [*self.filters, self.out, self.bias]

    def step(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Gradients of the cross-entropy over windows x with labels y."""
        n, pooled, where = len(x), [], []
        for f, w in zip(self.filters, WIDTHS):
            z = sum(f[j][x[:, j : WINDOW - w + 1 + j]] for j in range(w))
            at = z.argmax(axis=1)
            where.append(at)
            pooled.append(np.take_along_axis(z, at[:, None], axis=1)[:, 0])
        h = np.concatenate(pooled, axis=1)
        active = np.maximum(h, 0)
        logits = active @ self.out + self.bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), y] -= 1
        p /= n
        inner = (p @ self.out.T) * (h > 0)
        grads = []
        for i, (f, w) in enumerate(zip(self.filters, WIDTHS)):
            g, slope = np.zeros_like(f), inner[:, i * FILTERS : (i + 1) * FILTERS]
            for j in range(w):
                np.add.at(g[j], (x[np.arange(n)[:, None], where[i] + j], np.arange(FILTERS)[None, :]), slope)
            g[:, 0] = 0
            grads.append(g)
        return [*grads, active.T @ p, p.sum(axis=0)]

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """Over byte pairs (first * 256 + second): what the pair at a position adds, and the pair two bytes on."""
        two, three, four = self.filters
        pair = lambda a, b: (a[:, None] + b[None, :]).reshape(65536, FILTERS)
        zero = np.zeros_like(three[0])
        here = np.concatenate([pair(two[0], two[1]), pair(three[0], three[1]), pair(four[0], four[1])], axis=1)
        on = np.concatenate([pair(three[2], zero), pair(four[2], four[3])], axis=1)
        return np.ascontiguousarray(here), np.ascontiguousarray(on)

    def logits(self, x: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        here, on = tables
        out = np.empty((len(x), len(self.languages)), np.float32)
        for a in range(0, len(x), 128):
            part = x[a : a + 128].astype(np.intp)
            pair = part[:, :-1] * 256 + part[:, 1:]
            z = here.take(pair[:, :-2], axis=0, mode="clip")
            z[:, :, FILTERS:] += on.take(pair[:, 2:], axis=0, mode="clip")
            h = z.max(axis=1)
            last = here.take(pair[:, -2:], axis=0, mode="clip")  # narrower filters fit at two and one more positions
            h[:, :FILTERS] = np.maximum(h[:, :FILTERS], last[:, :, :FILTERS].max(axis=1))
            end = last[:, 0, FILTERS : 2 * FILTERS] + self.filters[1][2][part[:, -1]]
            h[:, FILTERS : 2 * FILTERS] = np.maximum(h[:, FILTERS : 2 * FILTERS], end)
            out[a : a + 128] = np.maximum(h, 0) @ self.out + self.bias
        return out


def fit(samples: list[tuple[str, bytes]]) -> Network | None:
    """Adam over shuffled batches of (language, window), STEPS of them or a few more; None without samples."""
    languages = sorted({lang for lang, _ in samples})
    if not languages:
        return None
    net, rng = Network(languages), np.random.default_rng(5)
    x = np.concatenate([windows(t)[:1] for _, t in samples]).astype(np.intp)
    y = np.array([languages.index(lang) for lang, _ in samples])
    counts = np.bincount(y)
    repeats = np.maximum(1, LEAST_SHARE * counts.max() // counts).astype(int)
    x, y = np.repeat(x, repeats[y], axis=0), np.repeat(y, repeats[y])
    first, second, t = [np.zeros_like(w) for w in net.parameters()], [np.zeros_like(w) for w in net.parameters()], 0
    while t < STEPS:
        order = rng.permutation(len(x))
        for a in range(0, len(x), BATCH):
            pick, t = order[a : a + BATCH], t + 1
            for w, g, m, v in zip(net.parameters(), net.step(x[pick], y[pick]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                w -= RATE * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-7)
    return net


def _samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A few windows of every sampled row, at offsets that a hash of the text gives."""
    for batch in slices(batches):
        out = []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            if has_letter(text):
                data = text.lower().encode()
                for i in range(EACH):
                    at = zlib.crc32(data, i) % max(1, len(data) - WINDOW + 1)
                    out.append((lang, data[at : at + WINDOW]))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.binary())], names=["lang", "data"])


def train(docs: DataFrame) -> Network | None:
    """Fit on rows of non-null lang whose crc32(doc_id) mod 4 is not 2, as many of each language as there are."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string").alias("lang"), "text").where((remainder("doc_id", 4) != 2) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("doc_id").alias("n")).orderBy(F.desc("n"), "lang").limit(ROWS).collect()  # ROWS languages
    each = min(PER_LANGUAGE, max(1, ROWS // max(1, len(counts))))
    # some four times as many rows as wanted are of a hash below this; the least are then chosen among those
    below = docs.sparkSession.createDataFrame([(r.lang, int(min(1.0, 4 * each / max(1, r.n)) * (2**63 - 1025))) for r in counts], "lang string, below long")
    key = F.shiftrightunsigned(F.xxhash64("doc_id"), 1)
    near = rows.select("doc_id", "lang", key.alias("key")).join(F.broadcast(below), "lang").where((F.col("key") <= F.col("below")) | (F.col("below") > 2**62))
    place = F.row_number().over(W.partitionBy("lang").orderBy("key", "doc_id"))
    ids = near.withColumn("place", place).where(F.col("place") <= each).select("doc_id", "lang").distinct()
    found = map_arrow(rows.join(F.broadcast(ids), ["doc_id", "lang"]).select("lang", "text"), _samples, "lang string, data binary").collect()  # ROWS ids
    return fit(sorted((r.lang, bytes(r.data)) for r in found))


def identify(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score (probability of lang_pred).

    Null texts and texts without a letter are 'und' with score 0, as is everything if no row can be learned from. Of
    equally probable languages the first by name is taken.
    Repeated rows are predicted each; a row of null doc_id is never learned from and counts as not held out; an empty
    table gives an empty result; columns other than doc_id, text and lang are ignored.
    """
    net = train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables() if net else None
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if net and has_letter(t)]
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            if known:
                x = [windows(texts[i].lower().encode()) for i in known]
                sizes = np.array([len(w) for w in x])
                logits = net.logits(np.concatenate(x), tables).astype(np.float64)
                mean = np.add.reduceat(logits, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
                p = np.exp(mean - mean.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                for i, k, s in zip(known, p.argmax(axis=1).tolist(), p.max(axis=1).tolist()):
                    lang[i], score[i] = net.languages[k], min(1.0, s)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, lang_pred string, score double")
