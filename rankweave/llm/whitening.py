"""Whitening of embeddings by a one-sided Jacobi SVD.

Vectors become whole numbers, and each distinct vector counts once. Their sums are added exactly; the rows,
centred by them, are compressed block by block to triangular factors (TSQR), which are stacked and compressed
again, ``FAN`` at a time, until one R is left, of as many rows and columns as vectors have entries: all that
the driver ever holds. Plane rotations then make R's columns orthogonal; the rotations, accumulated, are the
components, and the columns' lengths their standard deviations. No covariance is formed on this way, so small
deviations keep their digits.

Results of the corner cases: a row whose vector is null or holds null or non-finite entries gives no row;
neither does one whose vector is shorter or longer than most (of equally common lengths the longest counts).
Entries beyond 2^53 in size after scaling are taken as +-2^53. A deviation that a long can't hold is null.
Directions without variance are no components, so one distinct vector, like an empty table, gives no rows.
Repeated rows each get theirs; columns beyond the vector pass through if named in ``keep``, unless an output
has their name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common as C

#: Steps a unit, added to each entry; components at most; partial results merged in one task, about; rotations end below this cosine.
STEPS, SHIFT, MOST, FAN, TINY = 64, 1_000_000, 16, 32, 1e-15
SWEEPS = 60
OUTPUT = ("component", "n", "deviation", "whitened", "explained", "identity_error")


def quantised(rows: DataFrame, vector: str = "embedding", steps: int = STEPS, shift: int = SHIFT) -> DataFrame:
    """The rows that take part, with ``__x``: their vectors in whole numbers."""
    v = F.col(f"`{vector}`")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    edge = float(1 << 53)
    whole = F.transform(v, lambda c: (F.floor(F.greatest(F.lit(-edge), F.least(F.lit(edge), steps * c.cast("double")))) + shift).cast("long"))
    fine = rows.where(v.isNotNull() & (F.size(v) > 0) & finite).withColumn("__x", whole)
    sizes = fine.groupBy(F.size("__x").alias("size")).agg(F.count(F.lit(1)).alias("k"))
    common = sizes.agg(F.max_by("size", F.struct("k", "size"))).first()[0]
    return fine.where(F.size("__x") == (common or 0))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), -1)


def _packed(parts: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in parts], pa.int64()), pa.array([m.astype("<f8").tobytes() for _, m in parts], pa.binary())], ["n", "m"])


Part = tuple[int, np.ndarray]


def reduced(parts: DataFrame, width: int, merge: Callable[[list[Part]], Part]) -> Part | None:
    """One of the partial results (n, m) of ``parts``, m an array of rows of ``width`` doubles, merged about FAN at a time in tasks, a round for each factor of FAN."""
    fan = max(2, min(FAN, (1 << 26) // (8 * width * width)))
    unpacked = lambda n, m: (n, np.frombuffer(m, "<f8").reshape(-1, width))

    def merged(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_packed([merge([unpacked(n, m) for n, m in zip(group["n"].to_pylist(), group["m"].to_pylist(), strict=True)])])])

    while True:
        parts = C.stored(parts.select("n", "m", F.monotonically_increasing_id().alias("at")), "parts")
        count = parts.count()
        if count <= fan:
            break
        dealt = F.pmod(F.xxhash64("at"), F.lit(-(-count // fan)))
        parts = parts.groupBy(dealt.alias("g")).applyInArrow(merged, "n bigint, m binary")
    last = [unpacked(r.n, bytes(r.m)) for r in parts.orderBy("at").collect()]
    return merge(last) if last else None


def totals(fit: DataFrame) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each entry."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b["__x"])
            if len(x):  # high and low halves, so that no sum of a batch overflows
                high, low = x >> 32, x & 0xFFFFFFFF
                yield pa.RecordBatch.from_arrays([pa.array(range(x.shape[1])), pa.array([len(x)] * x.shape[1]), pa.array(high.sum(axis=0)), pa.array(low.sum(axis=0))], ["d", "n", "high", "low"])

    wide = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = fit.mapInArrow(summed, "d bigint, n bigint, high bigint, low bigint").groupBy("d").agg(F.sum("n").alias("n"), wide("high").alias("high"), wide("low").alias("low")).orderBy("d").collect()
    return (sums[0].n if sums else 0), [(int(r.high) << 32) + int(r.low) for r in sums]


class Centre:
    """Takes the mean off whole-number vectors without loss: as n * x - S, or in doubles."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.floor, self.rest = n, np.array([s // n for s in sums]), np.array([s % n for s in sums])

    def doubles(self, x: np.ndarray) -> np.ndarray:
        return (x - self.floor) - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - S)^2 of each row, in whole numbers."""
        near = x - self.floor
        if len(near) and int(np.abs(near).max()) * self.n + self.n < min(1 << 31, int((1 << 63) / x.shape[1]) ** 0.5):
            return ((near * self.n - self.rest) ** 2).sum(axis=1).tolist()
        exact = (near.astype(object) * self.n - self.rest.astype(object)) ** 2
        return [int(v) if v < 1 << 63 else None for v in exact.sum(axis=1)] if len(near) else []


def triangle(rows: np.ndarray) -> np.ndarray:
    """R of a block; of fewer rows than columns the block itself."""
    return np.linalg.qr(rows, mode="r") if len(rows) > rows.shape[1] else rows


def tsqr(fit: DataFrame, centre: Centre) -> np.ndarray:
    """R of all centred rows, with as many rows as columns at most."""
    width = len(centre.floor)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r, n = np.zeros((0, width)), 0
        for b in batches:
            x = _matrix(b["__x"]) if b.num_rows else np.zeros((0, width))
            r, n = triangle(np.vstack([r, centre.doubles(x)])), n + len(x)
        if n:
            yield _packed([(n, r)])

    return reduced(fit.mapInArrow(blocks, "n bigint, m binary"), width, lambda parts: (sum(n for n, _ in parts), triangle(np.vstack([m for _, m in parts]))))[1]


def _rounds(width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """All pairs of columns, in rounds of disjoint pairs."""
    ring = list(range(width + width % 2))
    out = []
    for _ in range(len(ring) - 1):
        pairs = [(a, b) for a, b in zip(ring[: len(ring) // 2], ring[::-1][: len(ring) // 2], strict=True) if a < width and b < width]
        out.append((np.array([min(p) for p in pairs], dtype=int), np.array([max(p) for p in pairs], dtype=int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def jacobi(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(components as rows, singular values), by falling value, of a matrix: plane rotations of its columns until all are orthogonal."""
    a, v = np.array(r, dtype=np.float64), np.eye(r.shape[1])
    rounds = _rounds(r.shape[1])
    for _ in range(SWEEPS):
        most = 0.0
        for i, j in rounds:
            alpha, beta, gamma = (a[:, i] ** 2).sum(axis=0), (a[:, j] ** 2).sum(axis=0), (a[:, i] * a[:, j]).sum(axis=0)
            size = np.sqrt(alpha * beta)
            turn = np.abs(gamma) > TINY * size
            if not turn.any():
                continue
            most = max(most, float((np.abs(gamma[turn]) / size[turn]).max()))
            i, j, zeta = i[turn], j[turn], (beta[turn] - alpha[turn]) / (2 * gamma[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            for m in (a, v):
                m[:, i], m[:, j] = c * m[:, i] - c * t * m[:, j], c * t * m[:, i] + c * m[:, j]
        if most <= 4 * TINY:
            break
    sigma = np.sqrt((a**2).sum(axis=0))
    order = np.argsort(-sigma, kind="stable")
    components = v[:, order].T
    top = components[np.arange(len(components)), np.abs(components).argmax(axis=1)]
    return components * np.where(top < 0, -1, 1)[:, None], sigma[order]


class Whitener:
    """What a fit learned: n, the mean, components, their standard deviations and shares of the variance."""

    def __init__(self, centre: Centre | None, components: np.ndarray, deviations: np.ndarray, explained: np.ndarray):
        self.centre, self.components, self.deviations, self.explained = centre, components, deviations, explained

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centre.doubles(x) @ self.components.T / self.deviations


def fit(rows: DataFrame, most: int = MOST) -> tuple[Whitener, DataFrame]:
    """The whitener of the distinct vectors of quantised ``rows``, and these vectors as a stored table."""
    distinct = C.stored(rows.select("__x").distinct(), "vectors")
    n, sums = totals(distinct)
    if not n:
        return Whitener(None, np.zeros((0, 0)), np.zeros(0), np.zeros(0)), distinct
    centre = Centre(n, sums)
    components, sigma = jacobi(tsqr(distinct, centre))
    real = (sigma > sigma[0] * len(sigma) * np.finfo(float).eps) & (sigma > 0)
    explained = sigma**2 / max(float((sigma**2).sum()), np.finfo(float).tiny)
    kept = np.flatnonzero(real)[:most]
    return Whitener(centre, components[kept], sigma[kept] / np.sqrt(n), explained[kept]), distinct


def identity_error(distinct: DataFrame, model: Whitener) -> float:
    """Largest entry, in size, of the whitened distinct vectors' covariance less the identity."""
    width = len(model.components)
    if not width:
        return 0.0
    whitened = model.whitened

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = [moments(whitened(_matrix(b["__x"]))) for b in batches if b.num_rows]
        if own:
            yield _packed([together(own)])

    def moments(w: np.ndarray) -> Part:
        off = w - w.mean(axis=0)
        return len(w), np.vstack([w.mean(axis=0), off.T @ off])

    def together(parts: list[Part]) -> Part:
        n = sum(k for k, _ in parts)
        mean = sum(k * m[0] for k, m in parts) / n
        return n, np.vstack([mean, sum(m[1:] + k * np.outer(m[0] - mean, m[0] - mean) for k, m in parts)])

    n, m = reduced(distinct.mapInArrow(blocks, "n bigint, m binary"), width, together)
    return float(np.abs(m[1:] / n - np.eye(width)).max())


def whiten(rows: DataFrame, vector: str = "embedding", keep: Sequence[str] = ("vec_id",), most: int = MOST) -> DataFrame:
    """For each row that takes part and each component: ``keep``, component from 1, n, deviation, whitened, explained and identity_error."""
    keep = [c for c in keep if c.lower() not in OUTPUT]
    fine = quantised(rows.select(*keep, F.col(f"`{vector}`").alias("__v")), "__v")
    model, distinct = fit(fine, most)
    error = identity_error(distinct, model)
    shared = rows.sparkSession.sparkContext.broadcast(model)  # entries times components

    @F.arrow_udf("struct<deviation bigint,whitened array<double>>")
    def projected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = shared.value
        for batch in batches:
            x = _matrix(batch)
            if own.centre is None or not len(x):
                w, far = np.zeros((len(x), 0)), [None] * len(x)
            else:
                w, far = own.whitened(x), own.centre.deviations(x)
            stops = pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32())
            yield pa.StructArray.from_arrays([pa.array(far, pa.int64()), pa.ListArray.from_arrays(stops, pa.array(w.ravel()))], ["deviation", "whitened"])

    shares: Column = F.array(*(F.lit(float(e)) for e in model.explained)).cast("array<double>")
    out = fine.select(*keep, projected("__x").alias("__p")).select(*keep, "__p.deviation", F.posexplode("__p.whitened").alias("__i", "whitened"))
    return out.select(*keep, (F.col("__i") + 1).alias("component"), F.lit(model.centre.n if model.centre else 0).cast("long").alias("n"), "deviation", "whitened", F.get(shares, F.col("__i")).alias("explained"), F.lit(error).alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(C.table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
