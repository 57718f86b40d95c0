"""Embedding whitening from an exact scatter in residue numbers.

Entries become integers (256 steps to a unit). The scatter of the distinct vectors is computed
modulo several primes: a partition multiplies blocks of residues in double precision, where every
product and sum of a block stays an exact integer, and keeps remainders. Sums of the remainders
over all partitions give the whole scatter, the sums of each dimension and the number of vectors
(a column of ones stands beside the vectors) by Chinese remaindering, without any rounding. Of
the exact covariance, rounded once, a double-precision eigendecomposition gives the components.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm._common import small_batches, stored

#: Steps to a unit, components that are returned.
STEPS, COMPONENTS = 256, 4
#: Residues lie within half a prime around 0, so a block of so many products of two stays under 2^53.
PRIME_BITS, BLOCK_ROWS = 21, 1 << 13
#: Rows of vectors that one numpy pass works on.
PASS_ROWS = 1 << 12
_LONG = 1 << 63


def primes(bound: int) -> list[int]:
    """The largest primes under 2^PRIME_BITS, as many as tell numbers of at most ``bound`` in size apart."""
    found, p = [], 1 << PRIME_BITS
    small = [q for q in range(2, 1 << ((PRIME_BITS + 1) // 2)) if all(q % r for r in range(2, int(q**0.5) + 1))]
    while prod(found) <= 2 * bound:
        p -= 1
        if all(p % q for q in small):
            found.append(p)
    return found


def residues(x: np.ndarray, p: int) -> np.ndarray:
    """The remainders nearest to 0."""
    r = np.mod(x, p)
    return np.where(r > p // 2, r - p, r)


def modular_scatter(x: np.ndarray, p: int) -> np.ndarray:
    """The product of the transpose of x with x, modulo p."""
    total = np.zeros((x.shape[1], x.shape[1]), dtype=np.int64)
    for a in range(0, len(x), BLOCK_ROWS):
        r = residues(x[a : a + BLOCK_ROWS], p).astype(np.float64)
        total = np.mod(total + (r.T @ r).astype(np.int64), p)
    return total


def remaindered(remainders: list[np.ndarray], moduli: list[int]) -> np.ndarray:
    """The integers (as Python's) nearest to 0 that have these remainders."""
    whole = prod(moduli)
    total = np.zeros(remainders[0].shape, dtype=object)
    for r, p in zip(remainders, moduli, strict=True):
        others = whole // p
        total = total + np.mod(r, p).astype(object) * (others * pow(others, -1, p))
    total = total % whole
    return np.where(total > whole // 2, total - whole, total)


# ---------------------------------------------------------------- vectors as bytes


def _entries(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(usable rows, offsets of these, integer entries of these): a usable vector has finite entries and at least one."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values
    good = np.isfinite(values.to_numpy(zero_copy_only=False).astype(np.float64)) & ~np.asarray(values.is_null())
    bad_before = np.r_[0, np.cumsum(~good)]
    size = np.diff(offsets)
    usable = ~np.asarray(column.is_null()) & (size > 0) & (bad_before[offsets[1:]] == bad_before[offsets[:-1]])
    rows = np.flatnonzero(usable)
    at = np.repeat(offsets[rows] - (np.cumsum(size[rows]) - size[rows]), size[rows]) + np.arange(int(size[rows].sum()))
    scaled = np.floor(values.to_numpy(zero_copy_only=False).astype(np.float64)[at] * STEPS)
    whole = np.clip(scaled, -float(_LONG), float(_LONG - 1024)).astype(np.int64)
    whole[scaled >= float(_LONG)] = _LONG - 1
    return rows, np.r_[0, np.cumsum(size[rows])], whole


def packed(x: np.ndarray) -> list[bytes]:
    """Vectors as bytes, each of the least width that holds its own entries, so equal vectors have equal bytes."""
    top = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
    out = np.empty(len(x), dtype=object)
    left = np.ones(len(x), dtype=bool)
    for kind in ("<i1", "<i2", "<i4", "<i8"):
        fits = left & (top <= np.iinfo(kind).max)
        for i, row in zip(np.flatnonzero(fits), x[fits].astype(kind), strict=True):
            out[i] = row.tobytes()
        left &= ~fits
    return out.tolist()


def unpacked(images: pa.Array, size: int) -> np.ndarray:
    """The vectors (of ``size`` entries) in a column of such bytes."""
    offsets = np.frombuffer(images.buffers()[1], dtype=np.int32, count=images.offset + len(images) + 1)[images.offset :]
    x = np.empty((len(images), size), dtype=np.int64)
    widths = np.diff(offsets) // size
    for width in np.unique(widths):
        rows = np.flatnonzero(widths == width)
        if len(rows) == len(images):
            x[:] = np.frombuffer(images.buffers()[2], dtype=f"<i{width}", count=len(rows) * size, offset=int(offsets[0])).reshape(-1, size)
        else:
            x[rows] = np.stack([np.frombuffer(images[int(i)].as_py(), dtype=f"<i{width}") for i in rows])
    return x


def _whole_vectors(vectors: DataFrame, column: str, size: int | None) -> DataFrame:
    """(vec_id, x) of usable rows with ``size`` entries, or without it (size, rows, top) of each batch."""

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PASS_ROWS):
                part = batch.slice(a, PASS_ROWS)
                rows, offsets, whole = _entries(part.column(1))
                sizes = np.diff(offsets)
                if size is None:
                    kinds, kind = np.unique(sizes, return_inverse=True)
                    tops = np.zeros(len(kinds))
                    np.maximum.at(tops, np.repeat(kind, sizes), np.abs(whole.astype(np.float64)))
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, type=pa.int64()), pa.array(np.bincount(kind, minlength=len(kinds)), type=pa.int64()), pa.array(tops)], names=["size", "rows", "top"])
                else:
                    own = np.flatnonzero(sizes == size)
                    x = whole[(offsets[own][:, None] + np.arange(size)).reshape(-1)].reshape(-1, size)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[own])), pa.array(packed(x) if len(x) else [], type=pa.binary())], names=["vec_id", "x"])

    rows = vectors.select(F.col("`vec_id`").cast("bigint").alias("vec_id"), F.col(f"`{column}`").cast("array<double>").alias("v"))
    return rows.mapInArrow(encode, "size long, rows long, top double" if size is None else "vec_id long, x binary")


# ---------------------------------------------------------------- scatter and components


def exact_scatter(fit: DataFrame, size: int, moduli: list[int]) -> np.ndarray:
    """The scatter of the vectors (column x) with a one after each, as Python integers."""

    def scatter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, any_rows = [np.zeros((size + 1, size + 1), dtype=np.int64) for _ in moduli], False
        for batch in batches:
            any_rows = any_rows or batch.num_rows > 0
            for a in range(0, batch.num_rows, PASS_ROWS):
                x = unpacked(batch.column(0).slice(a, PASS_ROWS), size)
                x = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
                for k, p in enumerate(moduli):
                    totals[k] = np.mod(totals[k] + modular_scatter(x, p), p)
        for k, total in enumerate(totals if any_rows else []):
            rows = pa.array(range(size + 1), type=pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([k] * (size + 1), type=pa.int32()), rows, pa.array(list(total), type=pa.list_(pa.int64()))], names=["k", "i", "row"])

    parts = fit.select("x").mapInArrow(scatter, "k int, i int, row array<long>")
    cells = parts.select("k", "i", F.posexplode("row").alias("j", "r")).groupBy("k", "i", "j").agg(F.sum("r").alias("r"))
    sums = np.zeros((len(moduli), size + 1, size + 1), dtype=np.int64)
    for batch in cells.toArrow().to_batches():  # a cell for each pair of dimensions, whatever the rows
        k, i, j, r = (batch.column(c).to_numpy() for c in range(4))
        sums[k, i, j] = r
    return remaindered(list(sums), moduli)


def covariance(scatter: np.ndarray) -> np.ndarray:
    """The exact covariance (divisor n), each entry rounded to a double once."""
    n, sums = int(scatter[-1, -1]), scatter[-1, :-1]
    centred = n * scatter[:-1, :-1] - np.outer(sums, sums)
    return np.array([[int(v) / (n * n) for v in row] for row in centred])


class Whitener:
    """Mean and components of a fit list; whitens vectors and tells their deviations."""

    def __init__(self, scatter: np.ndarray, components: int = COMPONENTS):
        self.n, self.sums = int(scatter[-1, -1]), [int(s) for s in scatter[-1, :-1]]
        v = covariance(scatter)
        values, vectors = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        self.trace = float(np.trace(v))
        self.values, self.vectors = values[order], vectors[:, order]
        #: Components without variance beyond rounding cannot be whitened.
        self.flat = self.values <= len(v) * np.finfo(float).eps * max(float(values.max()), 0.0)
        self.explained = self.values / self.trace if self.trace > 0 else np.full(len(order), np.nan)
        self._scale = np.where(self.flat, np.nan, 1 / np.sqrt(np.where(self.flat, 1.0, self.values)))
        self.identity_error: float | None = None

    def _centred(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, as machine integers where all of these and their squares' sums fit."""
        top = self.n * max(int(np.abs(x.astype(np.float64)).max(initial=0)) + 1, 1) * 2 + max(map(abs, self.sums), default=0)
        if top * top * x.shape[1] < _LONG:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def whiten(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """(exact sum of the squares of n * x - S, whitened values) of each vector."""
        centred = self._centred(x)
        return (centred * centred).sum(axis=1).tolist(), (centred / self.n).astype(np.float64) @ self.vectors * self._scale


def _identity_error(fit: DataFrame, size: int, whitener) -> float | None:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    width = int((~whitener.value.flat).sum())
    if not width:
        return None
    keep = np.flatnonzero(~whitener.value.flat)

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            for a in range(0, batch.num_rows, PASS_ROWS):
                y = whitener.value.whiten(unpacked(batch.column(0).slice(a, PASS_ROWS), size))[1][:, keep]
                y = np.concatenate([y, np.ones((len(y), 1))], axis=1)
                total += y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), type=pa.int32()), pa.array(total.reshape(-1))], names=["cell", "v"])

    cells = fit.select("x").mapInArrow(moments, "cell int, v double").groupBy("cell").agg(F.sum("v").alias("v")).orderBy("cell").collect()
    total = np.array([c.v for c in cells]).reshape(width + 1, width + 1)
    mean = total[-1, :-1] / total[-1, -1]
    return float(np.abs(total[:-1, :-1] / total[-1, -1] - np.outer(mean, mean) - np.eye(width)).max())


def whiten(vectors: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    A row is usable if its vector is not null, not empty and without null or non-finite entries.
    All vectors should have one size; of several the most frequent counts (of equally frequent ones
    the largest) and rows of another size are left out. Rows with the same vector, or the same
    vec_id, each get their rows, while the fit list has each vector once. Entries beyond a long
    take its ends. ``deviation`` is null where it does not fit in a long; ``whitened`` is null for a
    component without variance, as is ``explained`` where no component has any, and
    ``identity_error`` covers the other components (null without any). A null vec_id stays null;
    without a usable row there are no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    kinds = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    sizes = _whole_vectors(vectors, column, None).groupBy("size").agg(F.sum("rows").alias("rows"), F.max("top").alias("top"))
    most = sizes.orderBy(F.desc("rows"), F.desc("size")).first()
    if most is None:
        return spark.createDataFrame([], kinds)
    size, top = most["size"], int(most.top) + 1024 if most.top > 1 << 52 else int(most.top)
    rows = _whole_vectors(vectors, column, size)
    fit = stored(rows.select("x").distinct(), "vectors")
    moduli = primes(most.rows * max(top, 1) ** 2)
    model = Whitener(exact_scatter(fit, size, moduli), components)
    model.identity_error = _identity_error(fit, size, spark.sparkContext.broadcast(model))
    whitener = spark.sparkContext.broadcast(model)

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = whitener.value
        width = len(w.values)
        some = lambda v: pa.array(v, type=pa.float64(), from_pandas=True)  # noqa: E731 - not a number: null
        for batch in batches:
            for a in range(0, batch.num_rows, PASS_ROWS):
                part = batch.slice(a, PASS_ROWS)
                deviation, y = w.whiten(unpacked(part.column(1), size))
                m = len(deviation)
                which = np.repeat(np.arange(m), width)
                fits = pa.array([d if d < _LONG else None for d in deviation], type=pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(which)), pa.array(np.tile(np.arange(1, width + 1), m), type=pa.int32()), pa.array(np.full(m * width, w.n), type=pa.int64()),
                        fits.take(pa.array(which)), some(y.reshape(-1)), some(np.tile(w.explained, m)), pa.array([w.identity_error] * (m * width), type=pa.float64()),
                    ],
                    names=[k.split()[0] for k in kinds.split(", ")],
                )

    return rows.mapInArrow(apply, kinds)
