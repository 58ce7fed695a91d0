"""Whitening of embeddings from an exact scatter matrix, by residue numbers.

Entries become whole numbers x = floor(64 * c) + 1000000. Their products are far larger than their spread, so a scatter in doubles
would lose what matters in the difference of large numbers. Each task therefore works modulo several primes: residues stay small
enough that a matrix product of them in doubles is exact. Tasks' sums of residues are added by a shuffle, reduced, and put together
by the Chinese remainder theorem, which gives the sums of products as whole numbers of any size. The covariance follows without
rounding until its last division, and its eigenvectors in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._common import boxed, cut, unboxed

SCALE, SHIFT = 64, 1_000_000
#: An entry of larger size has no x that fits in a long with room for its difference from others.
MOST = 1 << 55
COMPONENTS = 16
#: Primes are under 2**BITS: products of residues (from -p/2 to p/2) of BLOCK rows sum up to less than 2**53.
BITS, BLOCK = 21, 8192


def primes(n: int, bits: int = BITS) -> list[int]:
    """The n largest primes below 2**bits."""
    sieve = np.ones(1 << bits, bool)
    sieve[:2] = False
    for i in range(2, 1 << (bits + 1) // 2):
        if sieve[i]:
            sieve[i * i :: i] = False
    found = np.flatnonzero(sieve)
    if n > len(found):
        raise ValueError(f"there are only {len(found)} primes below 2**{bits}")
    return [int(p) for p in found[::-1][:n]]


def enough_primes(bound: int) -> list[int]:
    """Primes whose product is over twice bound, so that a number of at most that size is told by its residues."""
    n = 1
    while reduce(lambda a, p: a * p, found := primes(n), 1) <= 2 * bound:
        n = n + max(1, (2 * bound).bit_length() // BITS - n)
    return found


def modular_gram(x: np.ndarray, p: int) -> np.ndarray:
    """Of rows x (long) with a column of ones added: the matrix product of its transpose with it, modulo p."""
    out = np.zeros((x.shape[1] + 1,) * 2, np.int64)
    for i in range(0, len(x), BLOCK):
        r = np.mod(x[i : i + BLOCK], p)
        r = np.concatenate([np.where(r > p // 2, r - p, r), np.ones((len(r), 1), np.int64)], axis=1).astype(np.float64)
        out = np.mod(out + np.mod((r.T @ r).astype(np.int64), p), p)
    return out


def from_residues(residues: list[int], moduli: list[int]) -> int:
    """The number of least size with these residues, by the Chinese remainder theorem."""
    x, product = 0, 1
    for r, p in zip(residues, moduli, strict=True):
        x += product * ((r - x) * pow(product, -1, p) % p)
        product *= p
    return x - product if 2 * x > product else x


def matrix(column: pa.Array | pa.ChunkedArray, dimension: int, kind: type) -> np.ndarray:
    """A column of lists of equal length as an array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).astype(kind, copy=False).reshape(len(column), dimension)


def whole(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """embeddings as (row, x) without rows whose vector is null, or holds null, non-finite or too large entries (over 2**55 / 64)."""
    wide = F.col(column).cast("array<double>")
    # NaN is larger than any number to Spark.
    ok = wide.isNotNull() & F.forall(wide, lambda c: F.coalesce((F.abs(c) <= MOST // SCALE), F.lit(False)))
    x = F.transform(F.col("wide"), lambda c: F.floor(c * SCALE) + SHIFT)
    return boxed(embeddings, F.when(ok, wide).alias("wide")).where("wide is not null").select("row", x.alias("x"))


@dataclass
class Whitening:
    """The fitted transform. sums and n are whole numbers; directions (dimension, components) are eigenvectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    directions: np.ndarray
    trace: float
    largest: int
    identity_error: float | None = None

    @property
    def scales(self) -> np.ndarray:
        """1 / sqrt(e), or NaN for components without variance."""
        none = self.values <= len(self.sums) * np.finfo(float).eps * max(self.trace, 0)
        return np.where(none, np.nan, 1 / np.sqrt(np.where(none, 1, self.values)))

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - S, exactly: as longs where they fit, else as Python's whole numbers."""
        if self.n * (2 * self.largest + 1) < 1 << 62:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def squared(self, d: np.ndarray) -> list[int] | np.ndarray:
        """The sum of the squares of each row, exactly."""
        most = int(np.abs(d).max(initial=0))
        if most * most * d.shape[1] >= 1 << 62:
            d = d.astype(object)
        return (d * d).sum(axis=1)

    def project(self, d: np.ndarray) -> np.ndarray:
        """Whitened components of deviations, NaN where a component has no variance."""
        return (d / self.n).astype(np.float64) @ self.directions * self.scales


def covariance(products: list[list[int]]) -> tuple[int, list[int], np.ndarray]:
    """(n, sums, covariance) from the sums of products of rows with a one added; only the division of whole numbers rounds."""
    n, sums = products[-1][-1], products[-1][:-1]
    return n, sums, np.array([[(n * q - sums[i] * sums[j]) / (n * n) for j, q in enumerate(row[:-1])] for i, row in enumerate(products[:-1])])


def scatter(fitted: DataFrame, dimension: int, moduli: list[int]) -> list[list[int]]:
    """Sums of products of the columns of fitted (x) with a one added, as whole numbers."""

    def residues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros((dimension + 1,) * 2, np.int64) for _ in moduli]
        for batch in batches:
            x = matrix(batch.column("x"), dimension, np.int64)
            sums = [np.mod(s + modular_gram(x, p), p) for s, p in zip(sums, moduli, strict=True)]
        # The matrix is symmetric: a row from its diagonal on.
        rows = [(k, i, s[i, i:]) for k, s in enumerate(sums) for i in range(dimension + 1)]
        flat = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for *_, r in rows])]), pa.int32()), pa.array(np.concatenate([r for *_, r in rows])))
        yield pa.RecordBatch.from_arrays([pa.array([k for k, *_ in rows], pa.int32()), pa.array([i for _, i, _ in rows], pa.int32()), flat], ["k", "i", "r"])

    parts = fitted.select("x").mapInArrow(residues, "k int, i int, r array<long>")
    summed = parts.select("k", "i", F.posexplode("r").alias("j", "r")).groupBy("k", "i", "j").agg(F.sum("r").alias("r"))
    # One row for each prime and pair of dimensions, however many vectors there are.
    found = {(r.i, r.i + r.j, r.k): r.r for r in summed.collect()}
    out = [[0] * (dimension + 1) for _ in range(dimension + 1)]
    for i in range(dimension + 1):
        for j in range(i, dimension + 1):
            out[i][j] = out[j][i] = from_residues([found[i, j, k] for k in range(len(moduli))], moduli)
    return out


def measured(fitted: DataFrame, model: Whitening) -> float:
    """The largest entry, by size, of the covariance of the whitened fit list minus the identity."""
    sent = fitted.sparkSession.sparkContext.broadcast(model)
    dimension, kept = len(model.sums), np.flatnonzero(~np.isnan(model.scales))
    if not len(kept):
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        total = np.zeros((len(kept) + 1,) * 2)
        for batch in batches:
            w = m.project(m.deviations(matrix(batch.column("x"), dimension, np.int64)))[:, kept]
            w = np.concatenate([w, np.ones((len(w), 1))], axis=1)
            total += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])

    rows = fitted.select("x").mapInArrow(products, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
    total = np.zeros((len(kept) + 1,) * 2)
    total.ravel()[[r.i for r in rows]] = [r.v for r in rows]
    # What is projected is centred already, on the exact mean; what rounding leaves of a mean goes too.
    mean = total[-1, :-1] / model.n
    return float(np.abs(total[:-1, :-1] / model.n - np.outer(mean, mean) - np.eye(len(kept))).max())


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Whitening | None:
    """The transform of vectors (x), each distinct one counted once; those of another length than most vectors have don't count.

    Of lengths that are as frequent, the larger one counts. None where there are no vectors with entries.
    """
    # Repeats meet within a task before anything is shuffled.
    distinct = cut(vectors.select("x").distinct(), "fitted", compression="zstd")
    size = distinct.where("size(x) > 0").groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.greatest(F.array_max("x"), -F.array_min("x"))).alias("largest"))
    found = size.orderBy(F.desc("n"), F.desc("d")).first()
    if found is None:
        return None
    fitted = distinct.where(F.size("x") == found.d)
    n, sums, v = covariance(scatter(fitted, found.d, enough_primes(found.n * max(found.largest, 1) ** 2)))
    e, directions = np.linalg.eigh(v)
    order = np.argsort(-e, kind="stable")[:components]
    model = Whitening(n, sums, np.maximum(e[order], 0), directions[:, order], float(np.trace(v)), found.largest)
    model.identity_error = measured(fitted, model)
    return model


def whiten(embeddings: DataFrame, components: int = COMPONENTS, column: str = "embedding") -> DataFrame:
    """For each row and component: the columns of embeddings, and component (from 1), n, deviation, whitened, explained, identity_error.

    Rows whose vector is null, holds null, non-finite or too large entries, is empty, or is not as long as most vectors, are left
    out. Repeated rows are kept, and count once in the fit. deviation is a decimal(38, 0), null where it has more digits. A component
    without variance (there is but one vector, or fewer than components independent ones) has null whitened values and explains 0.
    An empty table gives no rows. Columns of embeddings with the names that are added are replaced, all others pass.
    """
    rows = whole(embeddings, column)
    model = fit(rows, components)
    kind = "struct<deviation:decimal(38,0),whitened:array<double>>"
    if model is None:
        found = rows.where(F.lit(False)).select("row", F.lit(None).cast(kind).alias("p"))
        model = Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0, 0)
    else:
        sent = embeddings.sparkSession.sparkContext.broadcast(model)

        @F.arrow_udf(kind)
        def project(x: pa.Array) -> pa.Array:
            m = sent.value
            d = m.deviations(matrix(x, len(m.sums), np.int64))
            w = m.project(d)
            squared = pa.array([int(v) if abs(int(v)) < 10**38 else None for v in m.squared(d)], pa.decimal128(38, 0))
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), flat)
            return pa.StructArray.from_arrays([squared, lists], ["deviation", "whitened"])

        found = rows.where(F.size("x") == len(model.sums)).select("row", project("x").alias("p"))
    explained = F.array(*(F.lit(float(e) / model.trace if model.trace > 0 else 0.0) for e in model.values)).cast("array<double>")
    each = found.select("row", "p", F.posexplode("p.whitened").alias("k", "w"))
    return unboxed(
        each.select("row", "p", "k", "w"),
        component=F.col("k") + 1,
        n=F.lit(model.n).cast("long"),
        deviation=F.col("p")["deviation"],
        whitened=F.col("w"),
        explained=F.get(explained, F.col("k")),
        identity_error=F.lit(model.identity_error).cast("double"),
    )
