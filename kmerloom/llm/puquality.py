"""A quality classifier by positive-unlabelled learning.

A small network is fitted on trusted positives (rows of quality label 1) and unlabelled documents. Its risk is the
non-negative unbiased one: prior * E_pos[l(z)] + max(0, E_unl[l(-z)] - prior * E_pos[l(-z)]) with the logistic loss l;
where the bracket is negative its gradient is reversed, which undoes overfitting. The class prior is estimated as the
share of label 1 among the labelled training rows, which are taken for a fair sample of the corpus: where only some kind
of documents is labelled the prior is that of this kind. Labels of quality 0 serve that estimate alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import map_arrow, raw, slices
from kmerloom.llm.sampling import hashed_sample, remainder

#: Rows fitted on at most: trusted positives, unlabelled documents.
POSITIVES, UNLABELLED = 4000, 8000
THRESHOLD = 0.3
HIDDEN, STEPS, RATE, DECAY = 16, 900, 0.02, 1e-4
SYMBOLS = b"#*$%&|<>"
FEATURES = 18


def features(text: bytes | None) -> np.ndarray:
    """Shares and rates of characters, words and lines; zeros for null or blank text."""
    out = np.zeros(FEATURES)
    words = (text or b"").split()
    if not words:
        return out
    n, size = len(words), len(text)
    count = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, wide = int(count[65:91].sum()), int(count[97:123].sum()), int(count[128:].sum())
    letters = max(1, upper + lower + wide)
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = count[count > 0] / size
    symbols = int(count[list(SYMBOLS)].sum())
    out[:] = (
        np.log1p(n),
        upper / letters,
        int(count[33]) / n,
        symbols / n,
        int(count[124]) / n,
        int(count[48:58].sum()) / size,
        (int(count[44]) + int(count[46])) / n,
        wide / size,
        letters / size,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(len, words)) / n,
        -(share * np.log(share)).sum(),
        len(lines) / n,
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / len(lines),
        sum(x.isupper() for x in lines) / len(lines),
        sum(b" | " in x for x in lines) / len(lines),
        len(set(lines)) / len(lines),
    )
    return out


class Model:
    """Standardised features, one hidden layer, one logit."""

    def __init__(self, x: np.ndarray):
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        rng = np.random.default_rng(7)
        self.weights = [rng.normal(0, 0.3, (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 0.3, HIDDEN), np.zeros(1)]

    def prepare(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b, c, d = self.weights
        hidden = np.tanh(x @ a + b)
        return hidden, hidden @ c + d[0]

    def backward(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        inner = slope[:, None] * self.weights[2] * (1 - hidden**2)
        return [x.T @ inner, inner.sum(axis=0), hidden.T @ slope, np.array([slope.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Rounded, since the last bits of a matrix product depend on the rows beside a row."""
        return np.round(_sigmoid(self.forward(self.prepare(x))[1]), 12)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """The two terms of the risk: of positives, and the bracket before it is cut at zero."""
    return prior * np.logaddexp(0, -zp).mean(), np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Model:
    """Full-batch Adam on the non-negative risk."""
    model = Model(unlabelled)
    p, u = model.prepare(positive), model.prepare(unlabelled)
    first, second = ([np.zeros_like(w) for w in model.weights] for _ in range(2))
    for step in range(1, STEPS + 1):
        (hp, zp), (hu, zu) = model.forward(p), model.forward(u)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        if risk(zp, zu, prior)[1] >= 0:
            slope_p, slope_u = prior * (sp - 1 - sp), su
        else:
            slope_p, slope_u = prior * sp, -su
        grads = [a + b for a, b in zip(model.backward(p, hp, slope_p / len(p)), model.backward(u, hu, slope_u / len(u)))]
        for i, g in enumerate(grads):
            g = g + DECAY * model.weights[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            model.weights[i] = model.weights[i] - RATE * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return model


def _featurised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        x = [features(t).tolist() for t in raw(batch)]
        yield pa.RecordBatch.from_arrays([batch.column("positive"), pa.array(x, pa.list_(pa.float64()))], names=["positive", "x"])


def train(docs: DataFrame, labels: DataFrame) -> Model | None:
    """Fit on rows whose crc32(doc_id) mod 5 is not 0; None where no such row has quality 1."""
    marked = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("quality")).where((remainder("doc_id", 5) != 0) & F.col("quality").isNotNull())
    good, total = marked.agg(F.sum("quality"), F.count("*")).first()
    if not good:
        return None
    prior = min(0.98, max(0.02, good / total))
    open_docs = docs.select(F.col("doc_id").cast("long"), "text").where(remainder("doc_id", 5) != 0)
    known = open_docs.select("doc_id")
    trusted = hashed_sample(marked.where("quality = 1").select("doc_id").distinct(), POSITIVES).withColumn("positive", F.lit(True))
    plain = hashed_sample(known, UNLABELLED).withColumn("positive", F.lit(False)).distinct()
    rows = open_docs.join(F.broadcast(trusted.union(plain)), "doc_id")  # POSITIVES + UNLABELLED rows of two small columns
    found = map_arrow(rows.select("positive", "text"), _featurised, "positive boolean, x array<double>").collect()
    positive, unlabelled = (np.array(sorted(r.x for r in found if r.positive == kind)) for kind in (True, False))
    if not len(positive) or not len(unlabelled):
        return None
    return fit(positive, unlabelled, prior)


def scores(model: Model | None, texts: list[bytes | None]) -> np.ndarray:
    if model is None:
        return np.full(len(texts), 0.5)
    return model.score(np.array([features(t) for t in texts]).reshape(-1, FEATURES))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Null and empty texts have all features zero and are scored like any other. Without a training row of quality 1
    every score is 0.5. Repeated rows are scored each; a row of null doc_id is never fitted on and counts as not held
    out; an empty table gives an empty result; other columns are ignored.
    """
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = scores(model, raw(batch))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return map_arrow(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all their columns, that score THRESHOLD or more. No shuffle: a filter."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(scores(model, raw(batch)) >= THRESHOLD))

    return map_arrow(docs, run, docs.schema)
