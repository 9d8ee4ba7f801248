"""Whitening of embeddings from exact bit-sliced cross-products.

Entries become integers ``floor(64 * c) + 1000000``. Inside a task, a block of rows is shifted
by each dimension's smallest entry, and every bit of a dimension becomes a plane: one bit a
row, packed into words. A cross-product of two dimensions is the sum over their planes of
``2^(i + j)`` times the ones of the planes' AND. Blocks add up to exact integer sums of x and
of x x^T; these are centred as integers, and only then become doubles for the eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinsheet.session import materialize

SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 16
#: Rows whose planes are held at once.
BLOCK_ROWS = 8192
#: Entries of plane products held at once.
PRODUCT_WORDS = 1 << 20
#: Eigenvalues below this share of the largest are rounding of zero.
LEAST_SHARE = 1e-12
LARGEST_LONG = (1 << 63) - 1


def whole_entries(vector: Column) -> Column:
    """Null, empty or with a null or non-finite entry: null; else the entries as longs."""
    usable = (F.size(vector) > 0) & ~F.exists(
        vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf"))
    )
    scaled = F.transform(
        vector, lambda c: F.floor(c.cast("double") * SCALE).cast("long") + F.lit(OFFSET).cast("long")
    )
    return F.when(usable, scaled)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


# Cross-products ------------------------------------------------------------------------------


def planes(shifted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(words, weight)``: the packed bit planes of all dimensions, and ``dimension, bit``."""
    rows, width = shifted.shape
    depth = [int(m).bit_length() for m in shifted.max(axis=0)]
    owner = np.array([(d, b) for d in range(width) for b in range(depth[d])], dtype=np.int64)
    words = np.zeros((len(owner), -(-rows // 64)), dtype=np.uint64)
    for i, (d, b) in enumerate(owner.tolist()):
        bits = np.packbits(((shifted[:, d] >> np.uint64(b)) & np.uint64(1)).astype(bool))
        words[i].view(np.uint8)[: len(bits)] = bits
    return words, owner.reshape(-1, 2)


def plane_counts(words: np.ndarray) -> np.ndarray:
    """Ones of the AND of every pair of planes, upper half filled from the lower one."""
    count = len(words)
    out = np.zeros((count, count), dtype=np.int64)
    step = max(1, PRODUCT_WORDS // max(1, count * words.shape[1]))
    for a in range(0, count, step):
        both = words[a : a + step, None, :] & words[None, a:, :]
        out[a : a + step, a:] = np.bitwise_count(both).sum(axis=2, dtype=np.int64)
    return np.triu(out) + np.triu(out, 1).T


def scatter(x: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """``(n, sums, products)`` of the rows of ``x``, as exact Python integers."""
    rows, width = x.shape
    low = x.min(axis=0)
    shifted = (x.astype(object) - low.astype(object)).astype(np.uint64)
    words, owner = planes(shifted)
    counts = plane_counts(words).astype(object)
    spread = np.zeros((width, len(owner)), dtype=object)
    spread[owner[:, 0], np.arange(len(owner))] = [1 << int(b) for b in owner[:, 1]]
    products = spread.dot(counts).dot(spread.T) if len(owner) else np.zeros((width, width), object)
    ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64).astype(object)
    part = spread.dot(ones) if len(owner) else np.zeros(width, object)
    low = low.astype(object)
    products = products + np.outer(low, part) + np.outer(part, low) + rows * np.outer(low, low)
    return rows, part + rows * low, products


def _scatter_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row ``(width, a, b, value)`` a cross-product; ``b`` -1: sums, ``a`` -1 too: rows."""
    total = None
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK_ROWS):
            part = scatter(_matrix(batch.column(0).slice(start, BLOCK_ROWS)))
            total = part if total is None else tuple(x + y for x, y in zip(total, part))
    if total is None:
        return
    n, sums, products = total
    width = len(sums)
    a, b = np.triu_indices(width)
    values = [n, *sums.tolist(), *products[a, b].tolist()]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([[-1], np.arange(width), a]), pa.int32()),
            pa.array(np.concatenate([[-1], np.full(width, -1), b]), pa.int32()),
            pa.array([str(v) for v in values]),
        ],
        ["a", "b", "value"],
    )


class Moments:
    """Rows, sums and centred products ``n * sum(x x^T) - S S^T`` of a fit list, exact."""

    def __init__(self, fit: DataFrame):
        parts = fit.select("x").mapInArrow(_scatter_task, "a int, b int, value string")
        summed = parts.groupBy("a", "b").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("v"))
        found = {(r["a"], r["b"]): int(r["v"]) for r in summed.collect()}
        self.n = found.pop((-1, -1), 0)
        self.width = sum(b == -1 for _, b in found)
        self.sums = np.array([found[d, -1] for d in range(self.width)], dtype=object)
        self.centred = np.zeros((self.width, self.width), dtype=object)
        for (a, b), v in found.items():
            if b >= 0:
                self.centred[a, b] = self.centred[b, a] = self.n * v - self.sums[a] * self.sums[b]

    def covariance(self) -> np.ndarray:
        square = self.n * self.n
        cells = [v / square for v in self.centred.ravel().tolist()]  # rounded once
        return np.array(cells).reshape(self.width, self.width)


# Components ----------------------------------------------------------------------------------


class Whitening:
    """``axes`` (a column a component, over the root of its eigenvalue), ``explained``."""

    def __init__(self, moments: Moments, components: int = COMPONENTS):
        self.n, self.sums = moments.n, moments.sums
        if not moments.n:
            self.axes, self.explained = np.zeros((0, 0)), np.zeros(0)
            return
        cov = moments.covariance()
        values, vectors = np.linalg.eigh(cov)
        values, vectors = values[::-1], vectors[:, ::-1]
        used = min(components, int((values > LEAST_SHARE * max(values[0], 0.0)).sum()))
        self.axes = vectors[:, :used] / np.sqrt(values[:used])
        self.explained = values[:used] / np.trace(cov)

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """``n * x - S``, in longs where they and their squares' sums fit, else exact objects."""
        largest = self.n * max(abs(int(x.min())), abs(int(x.max())))
        largest += max(abs(int(s)) for s in self.sums)
        if largest <= LARGEST_LONG:
            out = x * np.int64(self.n) - self.sums.astype(np.int64)
            most = max(abs(int(out.min())), abs(int(out.max())))
            return out if most * most * x.shape[1] <= LARGEST_LONG else out.astype(object)
        return x.astype(object) * self.n - self.sums

    def apply(self, x: np.ndarray) -> tuple[list, np.ndarray]:
        """Squared deviation (None beyond a long) and the whitened components of each row."""
        far = self.deviations(x)
        squared = (far * far).sum(axis=1).tolist()
        squared = [v if v <= LARGEST_LONG else None for v in squared]
        return squared, (far.astype(np.float64) / self.n) @ self.axes

    def identity_error(self, fit: DataFrame) -> float:
        """Largest distance of an entry of the whitened fit list's covariance from identity."""
        used = self.axes.shape[1]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, products = np.zeros(used), np.zeros((used, used))
            for batch in batches:
                if batch.num_rows:
                    y = self.apply(_matrix(batch.column(0)))[1]
                    sums += y.sum(axis=0)
                    products += y.T @ y
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(used * (used + 1)), pa.int32()), pa.array([*products.ravel(), *sums])],
                ["at", "value"],
            )

        added = fit.select("x").mapInArrow(run, "at int, value double").groupBy("at")
        found = {r["at"]: r["v"] for r in added.agg(F.sum("value").alias("v")).collect()}
        cells = np.array([found[i] for i in range(used * (used + 1))]) / self.n
        mean = cells[used * used :]
        cov = cells[: used * used].reshape(used, used) - np.outer(mean, mean)
        return float(np.abs(cov - np.eye(used)).max())


def whitened(
    table: DataFrame, *, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS
) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    A row for each usable vector and component, numbered from 1 by falling eigenvalue. The fit
    list holds each distinct integer vector once, folded before its shuffle, so a vector that
    many rows hold is no hot key. Rows with a null or empty vector, or one with a null or
    non-finite entry, go; repeated rows and null ids stay. Components without variance are left
    out (no scaling makes them 1): a table with one distinct vector or none gives no rows.
    Vectors of different lengths raise ValueError. ``deviation`` is null where it exceeds a
    long. The driver holds one number a pair of dimensions.
    """
    rows = table.select(
        F.col(id_col).cast("long").alias("vec_id"), whole_entries(F.col(vector)).alias("x")
    ).where("x IS NOT NULL")
    rows = materialize(rows)
    widths = rows.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("high")).first()
    if widths["low"] != widths["high"]:
        raise ValueError(f"vectors have {widths['low']} to {widths['high']} entries")
    fit = materialize(rows.select("x").distinct())
    model = Whitening(Moments(fit), components)
    used = model.axes.shape[1]
    error = model.identity_error(fit) if used else 0.0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows if used else 0, BLOCK_ROWS):
                part = batch.slice(start, BLOCK_ROWS)
                squared, y = model.apply(_matrix(part.column("x")))
                each = np.repeat(np.arange(part.num_rows), used)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("vec_id").take(pa.array(each)),
                        pa.array(np.tile(np.arange(1, used + 1), part.num_rows), pa.int32()),
                        pa.array(squared, pa.int64()).take(pa.array(each)),
                        pa.array(y.ravel()),
                        pa.array(np.tile(model.explained, part.num_rows)),
                    ],
                    ["vec_id", "component", "deviation", "whitened", "explained"],
                )

    schema = "vec_id long, component int, deviation long, whitened double, explained double"
    return rows.mapInArrow(run, schema).select(
        "vec_id",
        "component",
        F.lit(model.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        "explained",
        F.lit(error).alias("identity_error"),
    )
