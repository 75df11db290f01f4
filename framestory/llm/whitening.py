"""Whitening of appearance embeddings by Chebyshev-filtered subspace iteration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framestory.session import cut_lineage

BLOCK_VECTORS, GUARD, DEGREE, MOST_ROUNDS = 4096, 4, 10, 200
#: Residuals of the wanted pairs, as a share of the largest eigenvalue, that count as converged.
CERTIFIED = 5e-14
#: Components below this share of the trace are noise of a vanishing direction.
LEAST_SHARE = 1e-12
#: Partial sums that the driver adds up itself; more are added by tasks first.
DRIVER_PARTS = 64
LONG_MAX = 2 ** 63 - 1


def usable(embedding: Column, scale: float) -> Column:
    """Whether a vector and all its components are there, finite, and within a long after scaling."""
    good = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) * scale < 2.0 ** 62))
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.coalesce(good, F.lit(False))


def _grid(vectors, scale: float, shift: int) -> np.ndarray:
    m = np.array([np.asarray(v, dtype=np.float64) for v in vectors], dtype=np.float64)
    return np.floor(scale * m).astype(np.int64) + shift


def _apart(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """``n * x - S``, exact: longs where they suffice, else Python integers."""
    if n * (int(np.abs(x).max(initial=0)) + 1) < 2 ** 61:
        return n * x - sums.astype(np.int64)
    return n * x.astype(object) - sums.astype(object)


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    return _apart(x, n, sums).astype(np.float64) / n


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int | None]:
    d = _apart(x, n, sums)
    if d.dtype != object and float(np.abs(d).max(initial=0)) ** 2 * d.shape[1] < 2.0 ** 62:
        return (d * d).sum(axis=1).tolist()
    exact = [sum(int(v) ** 2 for v in row) for row in d]
    return [v if v <= LONG_MAX else None for v in exact]


def _total(blocks: DataFrame, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], dtype, width: int) -> np.ndarray:
    """Sum of ``work`` over all blocks: per task, then in a second stage where there are many tasks, then here."""
    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(shape, dtype)
        for pdf in frames:
            for b in pdf["x"]:
                acc = acc + work(np.frombuffer(b, np.int64).reshape(-1, width))
        yield pd.DataFrame({"t": [acc.astype(dtype).tobytes()]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros(shape, dtype)
        for pdf in frames:
            for b in pdf["t"]:
                acc = acc + np.frombuffer(b, dtype).reshape(shape)
        yield pd.DataFrame({"t": [acc.tobytes()]})

    parts = blocks.mapInPandas(partial, "t binary")
    if blocks.rdd.getNumPartitions() > DRIVER_PARTS:
        parts = parts.repartition(DRIVER_PARTS).mapInPandas(added, "t binary")
    out = np.zeros(shape, dtype)
    for r in parts.collect():
        out = out + np.frombuffer(r["t"], dtype).reshape(shape)
    return out


def _chebyshev(apply: Callable[[np.ndarray], np.ndarray], q: np.ndarray, vq: np.ndarray, cut: float, top: float, degree: int) -> np.ndarray:
    """``q`` under a polynomial that is small on [0, cut] and grows fastest beyond; scaled to be 1 near ``top``."""
    half = cut / 2
    sigma = first = half / (top - half)
    last, now = q, (vq - half * q) * (sigma / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - sigma)
        last, now = now, (apply(now) - half * now) * (2 * following / half) - (sigma * following) * last
        sigma = following
    return now


def leading_components(apply: Callable[[np.ndarray], np.ndarray], width: int, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues of a symmetric positive semidefinite operator, falling, and unit eigenvectors as columns.

    A block of ``GUARD`` times as many vectors is filtered, made orthonormal (QR)
    and rotated to its Ritz vectors until every wanted residual is certified: it
    bounds the eigenvalue's error, and divided by the gap the vector's.  Where
    rounding keeps residuals from falling any further, that is the end, too.
    """
    size = min(width, GUARD * wanted)
    q, _ = np.linalg.qr(np.random.default_rng(7).standard_normal((width, size)))
    best, stalled, degree = np.inf, 0, DEGREE
    kept = None
    for _ in range(MOST_ROUNDS):
        vq = apply(q)
        t = q.T @ vq
        e, u = np.linalg.eigh((t + t.T) / 2)
        e, u = e[::-1], u[:, ::-1]
        q, vq = q @ u, vq @ u
        worst = float(np.linalg.norm(vq[:, :wanted] - q[:, :wanted] * e[:wanted], axis=0).max(initial=0.0))
        if worst < best / 2:
            best, stalled, kept = worst, 0, (e[:wanted].copy(), q[:, :wanted].copy())
        else:
            stalled += 1
            kept = kept or (e[:wanted].copy(), q[:, :wanted].copy())
        if e[0] <= 0 or worst <= CERTIFIED * e[0] or (stalled > 2 and best <= 1e-11 * e[0]) or size == width and stalled:
            return kept
        cut = max(float(e[-1]), 0.0)
        if size == width:
            y = vq
        elif cut > 1e-9 * e[0]:
            y = _chebyshev(apply, q, vq, cut, float(e[0]), degree)
            degree = min(40, degree + 4)
        else:
            y = vq
        q, _ = np.linalg.qr(y)
    raise ArithmeticError(f"the leading components were not certified: residual {best:.3g} of {e[0]:.3g}")


def whiten_tracks(tracks: DataFrame, components: int = 8, key: str = "track_id", embedding: str = "embedding", scale: float = 1024.0,
                  shift: int = 100_000) -> DataFrame:
    """Appearance embeddings of tracks on their leading principal components, scaled to unit variance.

    A component c of an embedding becomes the whole number ``floor(scale * c) +
    shift``, so that sums and distances are exact.  The covariance V is over all
    usable tracks (divisor n), centred before multiplying.  Returns a row per
    usable track and component: ``key``, ``component`` (from 1, by falling
    eigenvalue), ``n``, ``deviation`` (sum of (n * x - S)^2 over dimensions, S the
    sums; null beyond a long), ``whitened``, ``explained`` (the eigenvalue's
    share of V's trace) and ``identity_error`` (largest entry of the whitened
    covariance minus the identity, one value for all rows).  The sign of a
    component is free but the same for all rows.

    V itself is never formed: each step multiplies a block of vectors by centred
    XᵀX in one pass over packed blocks, and only width x block sums reach the driver.

    Embeddings that are null or hold null, non-finite or (after scaling) too
    large components take no part; nor do empty ones and those of another length
    than most have (the longer of two equally frequent lengths counts).  Directions
    without variance give no component, so equal tracks or a single one give no
    rows, as does an empty table.  Null keys and repeated rows are tracks like any
    other; columns besides the two named don't pass.
    """
    schema = f"_id {tracks.schema[key].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    empty = tracks.sparkSession.createDataFrame([], schema).withColumnRenamed("_id", key)
    d = tracks.select(F.col(key).alias("_id"), F.col(embedding).alias("_e")).where(usable(F.col("_e"), scale))
    d = d.withColumn("_e", F.col("_e").cast("array<double>"))
    lengths = d.groupBy(F.size("_e").alias("w")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), F.col("w").desc()).limit(1).collect()
    if not lengths:
        return empty
    width, n = lengths[0]
    d = d.where(F.size("_e") == width)

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), BLOCK_VECTORS):
                yield pd.DataFrame({"x": [_grid(pdf["_e"].iloc[i:i + BLOCK_VECTORS], scale, shift).tobytes()]})

    blocks = cut_lineage(d.select("_e").mapInPandas(packed, "x binary"))
    small = int(np.abs(_total(blocks, lambda x: np.array([[float(np.abs(x).max(initial=0))]]), (1, 1), np.float64, width)[0, 0])) * n < 2 ** 61
    sums = _total(blocks, lambda x: x.sum(axis=0), (width,), np.int64, width) if small else _wide_sums(blocks, width)
    trace = float(_total(blocks, lambda x: np.array([(_centred(x, n, sums) ** 2).sum()]), (1,), np.float64, width)[0]) / n
    if trace == 0:
        return empty

    def times(q: np.ndarray) -> np.ndarray:
        def work(x: np.ndarray) -> np.ndarray:
            c = _centred(x, n, sums)
            return c.T @ (c @ q)

        return _total(blocks, work, q.shape, np.float64, width) / n

    e, q = leading_components(times, width, min(components, width))
    good = e > LEAST_SHARE * trace
    e, q = e[good], q[:, good]
    k, project = len(e), q / np.sqrt(e)
    mean = _total(blocks, lambda x: (_centred(x, n, sums) @ project).sum(axis=0), (k,), np.float64, width) / n

    def spread(x: np.ndarray) -> np.ndarray:
        w = _centred(x, n, sums) @ project - mean
        return w.T @ w

    error = float(np.abs(_total(blocks, spread, (k, k), np.float64, width) / n - np.eye(k)).max())
    explained = e / trace

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i in range(0, len(pdf), BLOCK_VECTORS):
                part = pdf.iloc[i:i + BLOCK_VECTORS]
                x = _grid(part["_e"], scale, shift)
                w = _centred(x, n, sums) @ project
                m = len(part)
                yield pd.DataFrame({
                    "_id": part["_id"].repeat(k).array, "component": np.tile(np.arange(1, k + 1, dtype=np.int32), m), "n": n,
                    "deviation": pd.array(_deviation(x, n, sums), dtype="Int64").repeat(k), "whitened": w.ravel(),
                    "explained": np.tile(explained, m), "identity_error": error})

    return d.mapInPandas(run, schema).withColumnRenamed("_id", key)


def _wide_sums(blocks: DataFrame, width: int) -> np.ndarray:
    """Sums that may exceed a long, from those of the upper and lower halves of each number."""
    high = _total(blocks, lambda x: (x >> 31).sum(axis=0), (width,), np.int64, width)
    low = _total(blocks, lambda x: (x & (2 ** 31 - 1)).sum(axis=0), (width,), np.int64, width)
    return high.astype(object) * 2 ** 31 + low.astype(object)
