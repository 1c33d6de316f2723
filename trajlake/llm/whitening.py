"""Whitening of vectors by Golub-Kahan-Lanczos bidiagonalisation of their centred rows.

With A the centred rows, a step takes p = A v, the product of all rows with a direction, and A'u, the sum of the rows weighted by
the normalised p, and makes both orthogonal to all earlier ones: v against the right vectors, u against the left ones. A is thus
U B V' with a small bidiagonal B, whose singular values and vectors give those of A.

A left vector has an entry for each row and is never kept: as each is a combination of rows times directions, u = A c for a short
c, a pass makes all of them again, with their products with p. One pass over the rows therefore is one step, and what leaves it is
a partial sum of a few numbers for each dimension. Rows are centred before anything is multiplied.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajlake.llm._shared import materialize, scratch

#: Entries are scaled by the first number, floored, and moved by the second.
SCALE, SHIFT = 1024, 100_000
#: A direction counts as used up where what is left of it is so small beside the largest singular value.
USED_UP = 1e-11
#: A singular triplet is found when its residual is so small beside the distance to the next singular value.
EXACT = 1e-14
_FITS = float(1 << 62)


class Fit(NamedTuple):
    """Of all fitted vectors: how many, sums by dimension, trace of the covariance, its largest eigenvalues and their unit vectors."""

    n: int
    sums: tuple[int, ...]
    trace: float
    values: np.ndarray
    vectors: np.ndarray  # one a row


def integers(vectors: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """vec_id and x, an array of long: each entry scaled, floored and moved.

    Vectors that are null, empty, or hold null or non-finite entries go, as do those of another length than most have (of equally
    frequent lengths the greatest counts), and those with entries beyond what a long can hold.
    """
    limit = F.lit(float(1 << 42))
    listed = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("x"))
    fine = F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < limit) & ~F.isnan(c))
    listed = listed.filter(F.col("x").isNotNull() & (F.size("x") > 0)).filter(fine)
    lengths = listed.groupBy(F.size("x").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).limit(1)
    listed = listed.join(F.broadcast(lengths.select("length")), F.size("x") == F.col("length")).drop("length")
    return listed.select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE) + SHIFT).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], fit_sums: tuple[int, ...], n: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch, its rows less whole means, and the same less means."""
    whole = np.array([s // n for s in fit_sums], np.int64)
    part = np.array([(s % n) / n for s in fit_sums])
    for batch in batches:
        if batch.num_rows:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) - whole
            yield batch, x, x - part


def _summed(rows: DataFrame, shape: tuple[int, ...], of: Callable[[np.ndarray], np.ndarray], sums: tuple[int, ...], n: int) -> np.ndarray:
    """The sum over all blocks of centred rows of what of() makes of each, an array of that shape. Partial sums are one a task."""

    def each(batches):
        total = np.zeros(int(np.prod(shape)))
        for _, _, block in _blocks(batches, sums, n):
            total += of(block).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "part"])

    parts = rows.select("x").mapInArrow(each, "i long, part double").groupBy("i").agg(F.sum("part").alias("total")).collect()
    out = np.zeros(int(np.prod(shape)))
    for i, total in parts:
        out[i] = total
    return out.reshape(shape)


def _away(x: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """x without what it shares with the orthonormal rows, taken off twice."""
    for _ in range(2):
        x = x - rows.T @ (rows @ x)
    return x


def _totals(rows: DataFrame) -> tuple[int, tuple[int, ...]]:
    """How many rows, and their exact sums by dimension."""

    def each(batches):
        total, n = None, 0
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                block = [int(a) * (1 << 26) + int(b) for a, b in zip(np.sum(x >> 26, axis=0), np.sum(x & ((1 << 26) - 1), axis=0), strict=True)]
                total, n = block if total is None else [a + b for a, b in zip(total, block, strict=True)], n + len(x)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(total)), pa.int64()), pa.array(map(Decimal, [n, *total]), pa.decimal128(38, 0))], ["i", "part"])

    found = {r.i: int(r.total) for r in rows.select("x").mapInArrow(each, "i long, part decimal(38,0)").groupBy("i").agg(F.sum("part").alias("total")).collect()}
    return found.pop(-1, 0), tuple(found[i] for i in sorted(found))


def bidiagonalise(rows: DataFrame, sums: tuple[int, ...], n: int, wanted: int, avoid: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Singular values of the centred rows, less their part along the directions to avoid, and right singular vectors, a row each.

    The largest ones, as many as wanted, are found; where the steps come to half the directions, all of them are taken, which the
    last item tells.
    """
    spark, d = rows.sparkSession, len(sums)
    room = d - len(avoid)
    random = np.random.default_rng(seed)
    right, left = np.zeros((0, d)), np.zeros((0, d))  # the left ones by their c
    images, mixed = np.zeros((0, d)), np.zeros((0, 0))  # A'u of each left vector; B, left by right
    largest = 0.0

    def fresh() -> np.ndarray | None:
        x = _away(_away(random.standard_normal(d), avoid), right)
        return x / np.linalg.norm(x)

    v, last = fresh(), 0.0
    while len(right) < room:
        known = spark.sparkContext.broadcast((v, left, last))

        def of(block, known=known):
            v, left, last = known.value
            p = block @ v
            if len(left):
                p -= last * (block @ left[-1])
            inner = (block @ left.T).T @ p
            return np.concatenate([block.T @ p, inner, [p @ p]])

        got = _summed(rows, (d + len(left) + 1,), of, sums, n)
        known.destroy()
        image, inner, square = got[:d], got[d:-1], got[-1]
        image = image - images.T @ inner
        square = max(0.0, square - inner @ inner)
        alpha = float(np.sqrt(square))
        largest = max(largest, alpha, last)
        right = np.vstack([right, v])
        mixed = np.hstack([mixed, np.zeros((len(left), 1))])
        if len(left):
            mixed[:, -1] = inner
            mixed[-1, -1] += last
        if alpha > USED_UP * largest:
            shift = last * left[-1] if len(left) else 0.0
            left = np.vstack([left, (v - shift - left.T @ inner) / alpha])
            images = np.vstack([images, image / alpha])
            mixed = np.vstack([mixed, np.zeros((1, len(right)))])
            mixed[-1, -1] = alpha
            v = _away(images[-1] - alpha * right[-1], np.vstack([avoid, right]))
            last = float(np.linalg.norm(v))
        else:
            last = 0.0
        tied = last <= USED_UP * largest
        if tied or len(right) == room:
            last = 0.0
        _, found, _ = _small(mixed)
        if len(found) > wanted and 2 * len(right) < room and _settled(mixed, last, wanted):
            break
        if len(right) < room:
            v = fresh() if last == 0.0 else v / last
    _, values, turned = _small(mixed)
    return values, turned @ right, len(right) == room


def _small(mixed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    u, values, turned = np.linalg.svd(mixed, full_matrices=False)
    return u, values, turned


def _settled(mixed: np.ndarray, last: float, wanted: int) -> bool:
    """Whether the residuals of the wanted triplets, which the last entry of each left vector tells, are below what matters."""
    u, values, _ = _small(mixed)
    gaps = np.minimum(values[:wanted] - values[1 : wanted + 1], np.concatenate([[np.inf], values[: wanted - 1] - values[1:wanted]]))
    return bool(np.all(last * np.abs(u[-1, :wanted]) <= EXACT * np.maximum(gaps, EXACT * values[0])))


def fit(rows: DataFrame, components: int = 8, seed: int = 0) -> Fit:
    """The largest eigenvalues of the covariance (divisor: the number of rows) and their unit vectors, from the rows of integers().

    Components of no variance are left out. A direction of an eigenvalue that occurs twice doesn't show in one run, so others
    follow, kept away from the vectors found, until the largest that is left is no more than the least one taken.
    """
    n, sums = _totals(rows)
    d = len(sums)
    values, vectors = np.zeros(0), np.zeros((0, d))
    trace = float(_summed(rows, (1,), lambda block: np.array([np.sum(block * block)]), sums, n)[0]) / n if n else 0.0
    while len(vectors) < d:
        more, directions, complete = bidiagonalise(rows, sums, n, 1 if len(vectors) else components, vectors, seed + len(vectors))
        least = values[components - 1] if len(values) >= components else 0.0
        keep = np.flatnonzero(more > least * (1 + 1e-12))[: 1 if len(vectors) and not complete else components]
        values, vectors = np.concatenate([values, more[keep]]), np.vstack([vectors, directions[keep]])
        order = np.argsort(-values, kind="stable")
        values, vectors = values[order], vectors[order]
        if complete or not len(keep):
            break
    top = values[:components]
    able = top > USED_UP * (top[0] if len(top) else 1.0)
    vectors = vectors[: len(top)][able]
    return Fit(n, sums, trace, top[able] ** 2 / n, vectors / np.linalg.norm(vectors, axis=1, keepdims=True) if len(vectors) else vectors)


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def whiten(rows: DataFrame, model: Fit) -> DataFrame:
    """A row per vector and component: deviation (null beyond a long), the whitened coordinate, and the share of all variance."""

    def each(batches):
        sums = np.array([s % model.n for s in model.sums], np.int64)
        k = len(model.values)
        for batch, x, block in _blocks(batches, model.sums, model.n):
            fits = np.sum((model.n * block) ** 2, axis=1) < _FITS
            apart = np.where(fits[:, None], model.n * np.where(fits[:, None], x, 0) - sums, 0)
            deviation = pa.array(np.repeat(np.sum(apart * apart, axis=1), k), mask=np.repeat(~fits, k))
            whitened = block @ model.vectors.T / np.sqrt(model.values)
            m = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                    pa.array(np.full(m * k, model.n)), deviation, pa.array(whitened.ravel()), pa.array(np.tile(model.values / model.trace, m)),
                ],
                [c.split()[0] for c in WHITENED.split(", ")],
            )

    return rows.mapInArrow(each, WHITENED)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest absolute entry of the whitened vectors' covariance less the identity; 0 without components."""
    k = len(model.values)
    if not k:
        return 0.0
    turn = model.vectors.T / np.sqrt(model.values)
    mean = _summed(rows, (k,), lambda block: np.sum(block @ turn, axis=0), model.sums, model.n) / model.n
    square = _summed(rows, (k, k), lambda block: (block @ turn - mean).T @ (block @ turn - mean), model.sums, model.n)
    return float(np.max(np.abs(square / model.n - np.eye(k))))


def whitening(vectors: DataFrame, key: str = "vec_id", column: str = "embedding", components: int = 8) -> DataFrame:
    """whiten() and identity_error of all vectors, fitted on all of them.

    Null ids are rows like any other, repeated rows count each; no vectors left, or all of them equal, give no rows; fewer
    dimensions than components give as many components as there are with some variance. Other columns are ignored.
    """
    rows = integers(vectors, key, column)
    with scratch(vectors.sparkSession):
        kept = materialize(rows, "whitening_rows")
        model = fit(kept, components)
        error = identity_error(kept, model)
    return whiten(rows, model).withColumn("identity_error", F.lit(error))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: SQL has no singular value decomposition; tests hold the result against numpy's.
SQL = None
