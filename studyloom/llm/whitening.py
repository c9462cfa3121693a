"""Whitening of embeddings by a covariance that loses nothing to rounding.

Vectors are made whole numbers on a grid. Sums and centred outer products are accumulated in double-double arithmetic: a pair of
doubles, high and low, whose rounding errors are caught by error-free transformations (two_sum, two_product). Every task hands
over its high and its low parts, which are merged as a tree. The covariance, one row and column a dimension, is solved on the
driver by reduction to tridiagonal form and divide and conquer (LAPACK's syevd, which numpy's eigh calls).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, tree_merged

#: Steps of the grid in a unit, what is added, most components, and the largest |entry| that the grid tells apart exactly.
STEPS, SHIFT, COMPONENTS, LARGEST = 64, 1_000_000, 16, float(1 << 46)
#: Rows of a block of outer products.
BLOCK = 512
Pair = tuple[np.ndarray, np.ndarray]


def two_sum(a: np.ndarray, b: np.ndarray) -> Pair:
    """a + b rounded, and what the rounding lost."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a: np.ndarray, b: np.ndarray) -> Pair:
    """a * b rounded, and what the rounding lost; factors are split in halves of 26 bits."""
    p = a * b
    a1, b1 = a * 134217729.0, b * 134217729.0
    a1, b1 = a1 - (a1 - a), b1 - (b1 - b)
    a2, b2 = a - a1, b - b1
    return p, ((a1 * b1 - p) + a1 * b2 + a2 * b1) + a2 * b2


def added(x: Pair, y: Pair) -> Pair:
    """The sum of two double-doubles."""
    s, e = two_sum(x[0], y[0])
    t, f = two_sum(x[1], y[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def summed(x: Pair) -> Pair:
    """The sum over the first axis, by halves."""
    high, low = x
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([v, np.zeros_like(v[:1])]) for v in (high, low))
        half = len(high) // 2
        high, low = added((high[:half], low[:half]), (high[half:], low[half:]))
    return (high[0], low[0]) if len(high) else (np.zeros(high.shape[1:]), np.zeros(high.shape[1:]))


def outer_products(rows: np.ndarray, mean: Pair) -> Pair:
    """The sum of the products of all pairs of columns i <= j of `rows`, centred by `mean` first; row by row of the triangle."""
    dim = rows.shape[1]
    total = np.zeros(dim * (dim + 1) // 2), np.zeros(dim * (dim + 1) // 2)
    for k in range(0, len(rows), BLOCK):
        high, low = added((rows[k : k + BLOCK], np.zeros((min(BLOCK, len(rows) - k), dim))), (-mean[0], -mean[1]))
        found = []
        for i in range(dim):
            p, e = two_product(high[:, i : i + 1], high[:, i:])
            found.append(summed((p, e + (high[:, i : i + 1] * low[:, i:] + low[:, i : i + 1] * high[:, i:]))))
        total = added(total, tuple(np.concatenate([f[part] for f in found]) for part in (0, 1)))
    return total


def accumulated(fit: DataFrame, make: Callable[[np.ndarray], np.ndarray], part: Callable[[np.ndarray], Pair], size: int) -> Pair:
    """(x array<long>) -> the sum over all rows of part(make(rows)), a double-double of `size` places: one a task, merged as a tree."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size), np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total = added(total, part(make(matrix(batch.column("x")))))
        yield pa.RecordBatch.from_arrays([pa.array([t.tobytes()], pa.binary()) for t in total], names=["high", "low"])

    parts = fit.select("x").mapInArrow(add, "high binary, low binary")
    return tree_merged(parts, lambda r: (np.frombuffer(r["high"]), np.frombuffer(r["low"])), added, (np.zeros(size), np.zeros(size)))


def covariance(fit: DataFrame, n: int, make: Callable[[np.ndarray], np.ndarray], dim: int) -> tuple[Pair, np.ndarray]:
    """Sums of the `dim` columns of make(x) over the n rows of `fit`, as double-doubles, and their covariance, divisor n."""
    sums = accumulated(fit, make, lambda rows: summed((rows, np.zeros_like(rows))), dim)
    mean = divided(sums, n)
    high, low = accumulated(fit, make, lambda rows: outer_products(rows, mean), dim * (dim + 1) // 2)
    square = np.zeros((dim, dim))
    square[np.triu_indices(dim)] = divided((high, low), n)[0]
    return sums, square + np.triu(square, 1).T


def divided(x: Pair, n: int) -> Pair:
    """x / n of a double-double and a whole number below 2**53."""
    q = x[0] / n
    p, e = two_product(q, np.full_like(q, n))
    return two_sum(q, ((x[0] - p) - e + x[1]) / n)


def matrix(column: pa.ListArray) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def from_mean(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact: as long, or as whole numbers of any size where a long could overflow."""
    exact = n * int(np.abs(x).max(initial=0)) + max(map(abs, sums)) < 1 << 62
    kind = np.int64 if exact else object
    return x.astype(kind) * n - np.array(sums, kind)


def deviations(off: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; null beyond a long."""
    if off.dtype != object and float(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 2.0**62:
        return (off * off).sum(axis=1).tolist()
    found = (sum(int(v) * int(v) for v in row) for row in off)
    return [v if v < 1 << 63 else None for v in found]


def solved(square: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a covariance, falling, and their unit eigenvectors as columns, the entry of largest size positive.
    Those that rounding can't tell from zero are left out: nothing is divided by them."""
    values, vectors = np.linalg.eigh(square)
    order = np.argsort(-values, kind="stable")[:most]
    order = order[values[order] > max(values[order].max(initial=0), 0) * len(values) * np.finfo(float).eps]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if len(order) else np.ones(0)
    return values[order], vectors * signs


def on_grid(embedding: Column) -> Column:
    """The vector as whole numbers, floor(STEPS * c) + SHIFT, or null: where it is null or empty, holds a null or non-finite entry, or
    one beyond LARGEST, which the grid can't tell from its neighbours."""
    c = embedding.cast("array<double>")
    able = (F.size(c) > 0) & F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return F.when(F.coalesce(able, F.lit(False)), F.transform(c, lambda v: F.floor(STEPS * v).cast("long") + SHIFT))


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """(vec_id, embedding, ...) -> a row per vector and component: vec_id, component int, n long, deviation long, whitened double,
    explained double, identity_error double.

    Fitted on each different grid vector once. Rows whose vector has no place on the grid (see on_grid) are dropped. Repeated rows
    are rows of their own, but one vector of the fit. Components whose variance is zero, or lost in rounding, have no rows: a
    single vector, or equal ones, give none, and an empty table gives an empty result. A deviation beyond a long is null.
    Vectors of each length are whitened among themselves, a few jobs a length. A null vec_id stays; other columns are not read.
    """
    held = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), on_grid(F.col("embedding")).alias("x")).where("x IS NOT NULL"), "grid")
    fit = materialize(held.select("x").distinct(), "fit")
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    out = held.sparkSession.createDataFrame([], schema)
    for r in fit.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect():
        out = out.unionByName(whitened_rows(*(t.where(F.size("x") == r["dim"]) for t in (held, fit)), r["dim"], r["n"], most, schema))
    return out


def whitened_rows(held: DataFrame, fit: DataFrame, dim: int, n: int, most: int, schema: str) -> DataFrame:
    sums, square = covariance(fit, n, lambda x: x.astype(float), dim)
    sums = [int(h) + int(low) for h, low in zip(*sums)]
    values, vectors = solved(square, most)
    explained, count = values / np.trace(square), len(values)
    project = lambda x: (from_mean(x, n, sums) / n).astype(float) @ vectors / np.sqrt(values)
    error = float(np.abs(covariance(fit, n, project, count)[1] - np.eye(count)).max()) if count else 0.0

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.num_rows
            if not size or not count:
                continue
            x = matrix(batch.column("x"))
            at = pa.array(np.repeat(np.arange(size), count))
            deviation = pa.array(deviations(from_mean(x, n, sums)), pa.int64())
            columns = [
                batch.column("vec_id").take(at), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), size)), pa.array(np.full(size * count, n)), deviation.take(at),
                pa.array(project(x).reshape(-1)), pa.array(np.tile(explained, size)), pa.array(np.full(size * count, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(rows, schema)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
