"""Whitening of embeddings by matrix-free block Lanczos with full reorthogonalisation.

Components become integers, far from zero; equal vectors are fitted once. The covariance V is never formed: a pass over the stored fit list gives V times a block of a few directions, as sums of X'(X B) over centred rows, where
centring is exact (n * x - S in integers, then one division). The driver holds the basis alone (dimensions x BASIS numbers), and orthogonalises each new block twice against all of it. Where a block breaks down, directions that
are already covered give way to random ones; where the basis is full, the best Ritz vectors start it anew with their products. It ends when the residual |V u - e u| of every wanted component is below TOLERANCE of the largest
eigenvalue (or below ROUNDING and no longer falling), or the basis spans the space. The trace is the sum of all deviations, an integer, over n^3.

Defined cases: null vectors and such with a null, NaN or infinite component have no rows; nor have vectors whose length isn't the most frequent (the longer of equals), as no covariance joins them. Repeated rows are fitted once
and each has its rows; a null vec_id stays null. Eigenvalues that are zero (below ZERO of the largest) have no component, so vectors that are all equal give an empty result, as an empty table does. Equal eigenvalues give some
basis of their space. ``deviation`` is null where it would leave a long; ``deviation_exact`` holds it as a decimal. A component beyond +-2^31 after scaling raises an error. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, slices, stored

#: Scale and offset of the integers, and components returned at most.
SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Directions of a pass, columns of the basis before it is restarted, passes at most.
BLOCK, BASIS, PASSES = 16, 160, 200
#: Residuals, relative to the largest eigenvalue: wanted, and good enough where rounding lets them fall no further. Eigenvalues that count as zero.
TOLERANCE, ROUNDING, ZERO = 1e-14, 1e-12, 1e-13


def shifted(df: DataFrame, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Rows with a finite vector of the most frequent length, and ``y``: its integers before the offset, which a covariance doesn't feel."""
    whole = f"size(`{vector}`) > 0 and forall(`{vector}`, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
    finite = df.filter(whole)
    usual = finite.groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), F.desc("n")).first()
    fits = F.expr(f"forall(`{vector}`, x -> abs({scale}.0D * x) < 2147483647.0D)")
    y = F.expr(f"transform(`{vector}`, x -> cast(floor({scale}.0D * cast(x as double)) as int))")
    kept = finite.filter(F.size(vector) == (usual.n if usual else 0))
    # Spark may evaluate y beside the filter, so y looks at whole vectors only
    return kept.withColumn("y", F.when(F.expr(whole), F.when(fits, y).otherwise(F.raise_error(F.lit("a component is beyond 2^31 after scaling")))))


class Centre:
    """n, the sums S of ``y`` and exact deviations from their mean."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.near = n, np.array([s // n for s in sums], np.int64)
        self.rest = np.array([s % n for s in sums], np.int64)  # S - n * near, 0 to n - 1

    def times_n(self, y: np.ndarray) -> np.ndarray:
        """n * y - S."""
        return self.n * (y - self.near) - self.rest

    def rows(self, column: pa.Array) -> np.ndarray:
        y = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(self.near))
        return self.times_n(y)


def summed(fit: DataFrame, fn: Callable[[pa.Array], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of the ``size`` numbers that ``fn`` makes of a batch; each task sends one row, and as many numbers as ``size`` reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        total = np.zeros(size)
        for batch in batches:
            for part in slices(batch, 8 << 20, 8_192):
                total += fn(part.column(0)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.float64()))], ["v"])

    parts = fit.select("y").mapInArrow(run, "v array<double>").select(F.posexplode("v").alias("i", "x"))
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("x").alias("x")).collect():
        out[r.i] = r.x
    return out


def orthonormal(block: np.ndarray, basis: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Directions of ``block`` that the basis lacks, orthonormal to it (projected twice) and to each other; what breaks down is replaced at random while room is left."""
    d, out = len(block), basis
    for v in block.T:
        for fresh in (v, *(rng.standard_normal(d) for _ in range(3))):
            if out.shape[1] == d:
                break
            length = np.linalg.norm(fresh)
            u = fresh / length if length > 0 else fresh
            before = np.linalg.norm(u)
            for _ in range(2):
                u = u - out @ (out.T @ u)
            left = np.linalg.norm(u)
            if before > 0 and left > 1e-10:
                u = u / left
                u = u - out @ (out.T @ u)
                out = np.concatenate([out, (u / np.linalg.norm(u))[:, None]], axis=1)
                break
    return out[:, basis.shape[1] :]


def lanczos(times: Callable[[np.ndarray], np.ndarray], d: int, k: int, block: int = BLOCK, most: int = BASIS, tolerance: float = TOLERANCE, seed: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues of a symmetric matrix that is known by its products only, falling, and their unit vectors as columns."""
    rng = np.random.default_rng(seed)
    k, most = min(k, d), min(d, max(most, k + 2 * block))
    basis, products = np.zeros((d, 0)), np.zeros((d, 0))
    fresh = orthonormal(rng.standard_normal((d, min(block, d))), basis, rng)
    least, stalled = np.inf, 0
    for _ in range(PASSES):
        image = times(fresh)
        basis, products = np.concatenate([basis, fresh], axis=1), np.concatenate([products, image], axis=1)
        t = basis.T @ products
        values, y = np.linalg.eigh((t + t.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, images = basis @ y[:, :k], products @ y[:, :k]
        residuals = images - ritz * values[:k]
        far = np.linalg.norm(residuals, axis=0).max(initial=0) if basis.shape[1] >= k else np.inf
        stalled = stalled + 1 if far > least / 2 else 0
        least = min(least, far)
        top = max(values[0], 0)
        if far <= tolerance * top or (stalled >= 3 and far <= ROUNDING * top) or basis.shape[1] == d:
            break
        fresh = orthonormal(image[:, : max(1, min(block, d - basis.shape[1]))], basis, rng)
        if basis.shape[1] + block > most and most < d:  # restart from the best directions, whose products are known; what is missing of all of them lies in the fresh ones
            keep = min(most - block, k + block)
            basis, products = basis @ y[:, :keep], products @ y[:, :keep]
    else:
        raise RuntimeError(f"no convergence in {PASSES} passes")
    ritz = ritz / np.linalg.norm(ritz, axis=0)
    ritz = ritz * np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(ritz.shape[1])])  # the largest entry is positive
    return values[:k], ritz


def whiten(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``key``, ``component``, ``n``, ``deviation``, ``whitened``, ``explained``, ``identity_error`` and ``deviation_exact``: a row for each kept row and component."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"key {kind}, deviation string, whitened array<double>"
    rows = shifted(df.select(key, vector), vector, scale).select(key, "y")
    fit = stored(rows.select("y").distinct())
    each = fit.select(F.posexplode("y").alias("i", "x")).groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).cast("string").alias("s")).orderBy("i").collect()
    n, sums = (each[0].n if each else 0), [int(r.s) for r in each]
    if not n:
        return _named(df.sparkSession.createDataFrame([], schema), key, 0, np.zeros(0), 0.0)
    centre, d = Centre(n, sums), len(sums)

    def trace_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 8 << 20, 8_192):
                total = sum(deviations(centre.rows(part.column(0))))
                yield pa.RecordBatch.from_arrays([pa.array([total >> 40], pa.int64()), pa.array([total & ((1 << 40) - 1)], pa.int64())], ["high", "low"])

    whole = F.sum(F.col("high").cast("decimal(38,0)") * (1 << 40) + F.col("low")).cast("string").alias("total")
    trace = int(fit.mapInArrow(trace_part, "high long, low long").agg(whole).first().total) / n**3
    times = lambda b: summed(fit, lambda c: (x := centre.rows(c) / n).T @ (x @ b) / n, d * b.shape[1]).reshape(d, -1)
    values, vectors = lanczos(times, d, components)
    good = values > ZERO * max(values[0], 0)
    values, vectors = values[good], vectors[:, good]
    k = len(values)
    project = lambda x: (x / n) @ vectors / np.sqrt(values)
    moments = summed(fit, lambda c: np.concatenate([(z := project(centre.rows(c))).T @ z, z.sum(axis=0)[None]]), k * (k + 1)).reshape(k + 1, k)
    means = moments[k] / n
    error = float(np.abs(moments[:k] / n - np.outer(means, means) - np.eye(k)).max(initial=0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frugal()
        for batch in batches:
            for part in slices(batch, 8 << 20, 4_096):
                x = centre.rows(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([str(v) for v in deviations(x)], pa.string()), pa.array(list(project(x)), pa.list_(pa.float64()))], ["key", "deviation", "whitened"])

    return _named(rows.mapInArrow(run, schema), key, n, values / trace if trace else values, error)


def deviations(x: np.ndarray) -> list[int]:
    """Sum of squares of each row of integers, exact: in 64 bits where they suffice, else in Python's integers."""
    top = int(np.abs(x).max(initial=0))
    if top * top * max(1, x.shape[1]) < 1 << 63:
        return np.square(x).sum(axis=1).tolist()
    return [sum(v * v for v in row) for row in x.tolist()]


def _named(found: DataFrame, key: str, n: int, explained: np.ndarray, error: float) -> DataFrame:
    shares = F.array(*[F.lit(float(e)) for e in explained]) if len(explained) else F.array().cast("array<double>")
    each = found.select("key", "deviation", F.posexplode("whitened").alias("i", "whitened"))
    return each.select(
        F.col("key").alias(key), (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), F.expr("try_cast(deviation as long)").alias("deviation"), "whitened",
        F.get(shares, F.col("i")).alias("explained"), F.lit(error).alias("identity_error"), F.expr("try_cast(deviation as decimal(38,0))").alias("deviation_exact"),
    )
