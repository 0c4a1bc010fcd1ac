"""Whitening of embeddings by the cyclic Jacobi method.

Entries become integers. One pass sums them, a second the products of their
distances from the whole part of the mean: both sums are exact, so the
covariance is the same however rows are dealt, and centring comes before
multiplying. The driver gets these d x d numbers, and rotates pairs of
dimensions until no off-diagonal entry is left to the last bit beside its two
diagonal ones, which keeps small eigenvalues accurate. The matrix of the
wanted components goes to all tasks, which project every vector; what comes
out is measured once more against the identity.

Defined cases: rows whose vector is null, empty, or holds null or non-finite
entries take no part, nor do those of another length than most rows have (of
equally many, the shorter); repeated rows and null ids are kept; scaled entries
are held within 2**40; a component without variance (one vector, equal vectors,
dependent dimensions) has no `whitened` and counts for no error; a deviation
over 64 bits is null; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, table

HELD = float(1 << 40)
#: Centred entries up to this are multiplied in doubles, STEP rows at a time, without rounding.
SMALL, STEP = 1 << 20, 1 << 12
#: An eigenvalue below this part of the largest is rounding.
NOTHING = 1e-13
SWEEPS = 60


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and v (doubles) of rows whose vector is finite and as long as most."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    rows = vectors.filter(x.isNotNull() & (F.size(x) > 0)).filter(~bad).select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("v"))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.filter(F.size("v") == (usual["d"] if usual else 0))


def whole(column: pa.Array, scale: float, shift: int) -> np.ndarray:
    """floor(scale * entry) + shift."""
    x = np.asarray(column.flatten(), np.float64).reshape(len(column), -1)
    return np.clip(np.floor(scale * x), -HELD, HELD).astype(np.int64) + shift


def _sums(scale: float, shift: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                s = whole(batch.column(0), scale, shift).sum(0).astype(object)
                n, total = n + batch.num_rows, s if total is None else total + s
        if n:
            yield _row(n, total)

    return run


def _row(n: int, values: np.ndarray) -> pa.RecordBatch:
    """A count and exact numbers of any size, as text."""
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([list(map(str, values.tolist()))], pa.list_(pa.string()))], ["n", "sums"])


def scatter(y: np.ndarray) -> np.ndarray:
    """Exact y' y of whole numbers, as Python's."""
    out = np.zeros((y.shape[1], y.shape[1]), object)
    far = np.abs(y).max(1, initial=0) > SMALL
    near = y[~far].astype(np.float64)
    for i in range(0, len(near), STEP):
        part = near[i : i + STEP]
        out = out + (part.T @ part).astype(np.int64)
    wide = y[far].astype(object)
    for i in range(0, len(wide), 64):
        out = out + wide[i : i + 64].T @ wide[i : i + 64]
    return out


def _scatters(scale: float, shift: int, middle: np.ndarray):
    """The upper triangle of the task's scatter about `middle`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros((len(middle), len(middle)), object)
        for batch in batches:
            n, total = n + batch.num_rows, total + scatter(whole(batch.column(0), scale, shift) - middle if batch.num_rows else np.zeros((0, len(middle)), np.int64))
        if n:
            yield _row(n, total[np.triu_indices(len(middle))])

    return run


def _added(parts: DataFrame, kind: str) -> tuple[int, list]:
    """(rows, sums) of what the tasks have summed: one number a place reaches the driver."""
    placed = parts.select("n", F.posexplode("sums").alias("place", "part"))
    rows = placed.groupBy("place").agg(F.sum("n").alias("n"), F.sum(F.col("part").cast(kind)).alias("total")).orderBy("place").collect()
    return rows[0]["n"] if rows else 0, [r["total"] for r in rows]


def covariance(n: int, sums: list[int], middle: list[int], upper: list[int]) -> np.ndarray:
    """Divisor n, from the exact scatter about whole numbers near the mean."""
    d = len(sums)
    out, off = np.zeros((d, d)), [s - n * m for s, m in zip(sums, middle, strict=True)]
    for (i, j), t in zip(zip(*(x.tolist() for x in np.triu_indices(d)), strict=True), upper, strict=True):
        out[i, j] = out[j, i] = float(Fraction(n * t - off[i] * off[j], n * n))
    return out


def jacobi(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling value."""
    a, u, d = v.astype(np.float64).copy(), np.eye(len(v)), len(v)
    tiny = np.finfo(np.float64).tiny
    for _ in range(SWEEPS):
        turned = False
        for p in range(d - 1):
            for q in range(p + 1, d):
                off = a[p, q]
                # an entry beside which the last bit of both diagonal ones is larger is as good as none
                if abs(off) <= np.finfo(np.float64).eps * np.sqrt(abs(a[p, p]) * abs(a[q, q])) or abs(off) < tiny:
                    a[p, q] = a[q, p] = 0.0
                    continue
                turned = True
                half = (a[q, q] - a[p, p]) / (2 * off)
                t = (1.0 if half >= 0 else -1.0) / (abs(half) + np.hypot(half, 1.0))
                c = 1 / np.hypot(t, 1.0)
                s = t * c
                app, aqq = a[p, p] - t * off, a[q, q] + t * off
                row = c * a[p] - s * a[q]
                a[q] = s * a[p] + c * a[q]
                a[p] = row
                a[:, p], a[:, q] = a[p], a[q]
                a[p, p], a[q, q], a[p, q], a[q, p] = app, aqq, 0.0, 0.0
                left = c * u[:, p] - s * u[:, q]
                u[:, q] = s * u[:, p] + c * u[:, q]
                u[:, p] = left
        if not turned:
            break
    e = np.diag(a).copy()
    order = np.argsort(-e, kind="stable")
    return e[order], u[:, order]


def _projected(scale: float, shift: int, n: int, sums: list[int], w: np.ndarray):
    """id, deviation and the whitened components of each vector."""
    middle = np.array([floor(Fraction(s, n)) for s in sums], np.int64)
    rest = np.array([float(Fraction(s - n * m, n)) for s, m in zip(sums, middle.tolist(), strict=True)])
    exact = np.array(sums, object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = whole(batch.column(1), scale, shift)
            y = (x - middle) - rest
            if n * (int(np.abs(x).max()) + 1) < 1 << 61:
                off = n * x - exact.astype(np.int64)
                small = int(np.abs(off).max()) ** 2 * x.shape[1] < 1 << 63
            else:
                off, small = n * x.astype(object) - exact, False
            if small:
                deviation = (off * off).sum(1).tolist()
            else:
                deviation = [z if z < 1 << 63 else None for z in (off.astype(object) ** 2).sum(1)]
            out = y @ w
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(deviation, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * w.shape[1], pa.int32()), pa.array(out.ravel()))], ["id", "deviation", "w"])

    return run


def _moments(k: int):
    """Sums of the k whitened components and of their products; they are centred already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(k + k * k)
        for batch in batches:
            if batch.num_rows:
                w = np.asarray(batch.column(0).flatten()).reshape(-1, k)
                n, total = n + len(w), total + np.concatenate([w.sum(0), (w.T @ w).ravel()])
        if n:
            yield _row(n, total)

    return run


def whiten(vectors: DataFrame, *, components: int = 8, scale: float = 1024.0, shift: int = 100_000, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, n, deviation, w (whitened components by falling eigenvalue), explained (of each) and identity_error."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = usable(vectors, key, column)
    kind = "n long, sums array<string>"
    n, total = _added(rows.select("v").mapInArrow(_sums(scale, shift), kind), "decimal(38,0)")
    if not n:
        return spark.createDataFrame([], "id long, n long, deviation long, w array<double>, explained array<double>, identity_error double")
    sums = list(map(int, total))
    middle = [s // n for s in sums]
    _, upper = _added(rows.select("v").mapInArrow(_scatters(scale, shift, np.array(middle, np.int64)), kind), "decimal(38,0)")
    e, u = jacobi(covariance(n, sums, middle, list(map(int, upper))))
    k = min(components, len(e))
    live = int((e[:k] > NOTHING * max(e[0], 0)).sum())
    explained = (e[:k] / e.sum()).tolist() if live else [0.0] * k
    thin = scratch.cut(rows.mapInArrow(_projected(scale, shift, n, sums, u[:, :live] / np.sqrt(e[:live])), "id long, deviation long, w array<double>"), "whitened")
    error = None
    if live:
        _, m = _added(thin.select("w").mapInArrow(_moments(live), kind), "double")
        mean = np.array(m[:live]) / n
        error = float(np.abs(np.array(m[live:]).reshape(live, live) / n - np.outer(mean, mean) - np.eye(live)).max())
    padded = F.concat("w", F.array_repeat(F.lit(None).cast("double"), k - live))
    return thin.select("id", F.lit(n).cast("long").alias("n"), "deviation", padded.alias("w"), F.array(*map(F.lit, explained)).alias("explained"), F.lit(error).cast("double").alias("identity_error"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 8 whitened components of all embeddings."""
    found = whiten(table(spark, sf_dir, "embeddings"))
    each = found.select("id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("w", "explained")).alias("place", "c"))
    return each.select(F.col("id").alias("vec_id"), (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", F.col("c.w").alias("whitened"), F.col("c.explained").alias("explained"), "identity_error")
