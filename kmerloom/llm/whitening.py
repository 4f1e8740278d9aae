"""Embedding whitening by LOBPCG: the leading components of the covariance without forming it.

Entries are fixed to whole numbers, so sums and distances to the mean are exact. Every step of the eigensolver multiplies
the covariance with a block of vectors in one pass over the distinct rows: a task centres its rows, multiplies them with
the block and with the outcome, and returns partial sums of dimension times block size, which Spark adds up. Rayleigh-Ritz
runs on the span of three blocks (iterate, residual, previous direction) at the driver, which holds nothing that grows
with the rows. Steps go on until the residuals of all components wanted are certified and no longer shrink.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kmerloom.llm.common import column, map_arrow
from kmerloom.storage import materialize, spread

SCALE, SHIFT = 64, 1_000_000
#: Columns of the iterate beside the components wanted, steps at most, residual over the largest eigenvalue, and the
#: eigenvalue over the largest one down to which a component can be whitened.
GUARD, STEPS, CERTIFIED, RANK = 8, 1000, 1e-12, 1e-10
#: Fixed entries beyond this stay at it.
LARGEST = 1 << 52
WIDTHS = (np.int16, np.int32, np.int64)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole-numbered vectors, less SHIFT, as bytes of the least width that holds their entries: equal if those are."""
    for batch in batches:
        vectors = batch.column("vector")
        size = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        entries, row = vectors.flatten().to_numpy(zero_copy_only=False).astype(float), np.repeat(np.arange(len(size)), size)  # a null is nan
        size[row[~np.isfinite(entries)]] = 0
        y = np.floor(np.clip(entries[size[row] > 0], -LARGEST, LARGEST) * SCALE).clip(-LARGEST, LARGEST).astype(np.int64)
        at, end = np.flatnonzero(size), np.cumsum(size)
        first = end[at] - size[at]
        wide = np.where(y < 0, ~y, y)
        most = np.maximum.reduceat(wide, first) if len(at) else wide
        width = 1 + np.searchsorted([np.iinfo(w).max for w in WIDTHS[:-1]], most)
        for dim, w in sorted(set(zip(size[at].tolist(), width.tolist()))):
            of = (size[at] == dim) & (width == w)
            data = y[first[of, None] + np.arange(dim)].astype(WIDTHS[w - 1])
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(dim * data.itemsize), len(data), [None, pa.py_buffer(data.tobytes())]).cast(pa.binary())
            columns = [batch.column("vec_id").take(pa.array(at[of])), pa.array([dim] * len(data), pa.int32()), packed]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "dim", "y"])


def _unpacked(data: pa.Array, dim: int) -> np.ndarray:
    rows = data.to_pylist()
    wide, out = np.array([len(y) // dim for y in rows]), np.empty((len(rows), dim), np.int64)
    for w in WIDTHS:
        at = np.flatnonzero(wide == np.dtype(w).itemsize)
        out[at] = np.frombuffer(b"".join(rows[i] for i in at), w).reshape(-1, dim)
    return out


def fixed_vectors(embeddings: DataFrame, vector: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, y) of the rows with a usable vector, and the dimension (0 without any)."""
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), column(vector).cast("array<double>").alias("vector"))
    stored = materialize(map_arrow(spread(rows.where("vector IS NOT NULL")), _packed, "vec_id long, dim int, y binary"), "vectors")
    found = stored.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = found.dim if found else 0
    return stored.where(F.col("dim") == dim).select("vec_id", "y"), dim


def _summed(rows: DataFrame, dim: int, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum over all rows of what ``part`` makes of some of them: an array of ``shape``, which no table bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += part(_unpacked(batch.column("y"), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    out = np.zeros(shape).ravel()
    for r in map_arrow(rows, run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():  # an entry each
        out[r.at] = r.v
    return out.reshape(shape)


def column_sums(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension: upper and lower halves are added apart as longs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high, low, n = np.zeros(dim, np.int64), np.zeros(dim, np.int64), 0
        for batch in batches:
            y = _unpacked(batch.column("y"), dim)
            high, low, n = high + (y >> 26).sum(axis=0), low + (y & (1 << 26) - 1).sum(axis=0), n + len(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(high), pa.array(low), pa.array([n] * dim)], names=["at", "high", "low", "n"])

    found = map_arrow(rows, run, "at long, high long, low long, n long").groupBy("at").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect()
    sums = {r.at: (r.high << 26) + r.low for r in found}  # a row per dimension
    return (found[0].n if found else 0), [sums.get(i, 0) for i in range(dim)]


def _extended(x: np.ndarray, *blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns of x and then of what the blocks add to them."""
    basis = np.linalg.qr(x)[0]
    for block in blocks:
        length = np.linalg.norm(block, axis=0)
        block = block[:, length > 0] / length[length > 0]
        for _ in range(2):
            block = block - basis @ (basis.T @ block)
        if block.size:
            u, s, _ = np.linalg.svd(block, full_matrices=False)
            u = u[:, s > 1e-8][:, : len(basis) - basis.shape[1]]
            u = u - basis @ (basis.T @ u)
            basis = np.hstack([basis, np.linalg.qr(u)[0]]) if u.shape[1] else basis
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dim: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and unit eigenvectors as columns, of a symmetric operator.

    ``product`` multiplies it with a (dim, m) block. ArithmeticError if residuals aren't certified after STEPS steps.
    """
    m = min(dim, wanted + GUARD)
    basis, last = np.linalg.qr(np.random.default_rng(0).standard_normal((dim, m)))[0], np.inf
    for _ in range(STEPS):
        image = product(basis)
        small = basis.T @ image
        e, y = np.linalg.eigh((small + small.T) / 2)
        e, y = e[::-1][:m], y[:, ::-1][:, :m]
        x = basis @ y
        residual = image @ y - x * e
        worst = np.linalg.norm(residual[:, :wanted], axis=0).max()
        if worst <= CERTIFIED * e[0] and worst > last / 2 or e[0] <= 0:
            return e[:wanted], x[:, :wanted]
        last = worst
        basis = _extended(x, residual, basis[:, m:] @ y[m:])
    raise ArithmeticError(f"residuals of {worst} after {STEPS} steps")


def whiten(embeddings: DataFrame, vector: str = "embedding", components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row per usable row and component.

    An entry c becomes x = floor(64 * c) + 1000000 (64 * c beyond 2**52 stays there). The fit list holds each distinct x
    once: n vectors, with sums S. Components are unit eigenvectors of its covariance, numbered from 1 by falling
    eigenvalue; of each the entry of the largest size is positive. deviation is the exact sum of (n * x - S)**2, null if
    that exceeds a long; whitened is x - S / n along the component over the square root of its eigenvalue; explained the
    eigenvalue's share of the trace; identity_error the largest entry of the whitened fit list's covariance less the
    identity.

    Rows whose vector is null, empty, holds a null or a non-finite entry, or has another length than most vectors have
    (the longer of equally frequent ones), are left out. There are fewer than ``components`` components if the dimension
    or the rank is smaller (eigenvalues below 1e-10 of the largest count as none): one vector, equal vectors or an
    empty table give an empty result. Repeated rows and null vec_ids are kept; other columns are ignored.
    """
    vectors, dim = fixed_vectors(embeddings, vector)
    if not dim:
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    fit = spread(materialize(vectors.select("y").distinct(), "fit"))
    n, sums = column_sums(fit, dim)
    mean = np.array([s / n for s in sums])

    def covariance(block: np.ndarray) -> np.ndarray:
        def part(y: np.ndarray) -> np.ndarray:
            z = y - mean
            return z.T @ (z @ block)

        return _summed(fit, dim, part, block.shape) / n

    e, axes = lobpcg(covariance, dim, min(dim, components))
    e = e[: int((e > RANK * max(e[0], 0)).sum())]
    if not len(e):
        return embeddings.sparkSession.createDataFrame([], SCHEMA)
    axes = axes[:, : len(e)]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(len(e))])
    spectrum = e / (_summed(fit, dim, lambda y: ((y - mean) ** 2).sum().reshape(1, 1), (1, 1))[0, 0] / n)
    onto = axes / np.sqrt(e)

    def squared(y: np.ndarray) -> np.ndarray:
        w = (y - mean) @ onto
        return w.T @ w

    error = float(np.abs(_summed(fit, dim, squared, (len(e), len(e))) / n - np.eye(len(e))).max())

    def deviation(y: np.ndarray) -> pa.Array:
        far = n * max(int(np.abs(y).max()), 1) + max(abs(s) for s in sums)
        if far * far * dim < 1 << 63:
            return pa.array(((n * y - np.array(sums, np.int64)) ** 2).sum(axis=1))
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in y.tolist()]
        return pa.array([x if x < 1 << 63 else None for x in exact], pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(e)
        for batch in batches:
            if not batch.num_rows:
                continue
            y = _unpacked(batch.column("y"), dim)
            each = pa.array(np.repeat(np.arange(len(y)), k))
            numbers = [np.tile(np.arange(1, k + 1, dtype=np.int32), len(y)), np.full(len(y) * k, n, np.int64)]
            values = [((y - mean) @ onto).ravel(), np.tile(spectrum, len(y)), np.full(len(y) * k, error)]
            columns = [batch.column("vec_id").take(each), *map(pa.array, numbers), deviation(y).take(each), *map(pa.array, values)]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SCHEMA.split(", ")])

    return map_arrow(vectors, run, SCHEMA)
