"""Centroid clustering in rounds, filtered by ball trees.

Vectors become integers and stay where they are read: each task packs what it
scans into blocks and builds a metric tree over each. A node stores its radius,
count and integer sum (its centre is sum / count). The trees are written once;
a round reads them, not the vectors' table.

In a round the few centroids go to all tasks. A ball drops every centroid
that the triangle inequality shows to be farther than another for all its
members; if one is left, the ball's count and sum go to it whole, else its
children inherit what is left, down to leaves, where distances are exact
integers. Each task sends a sum for each centroid; the new centroids are exact
floors of sums over counts, so a run is the same however rows are dealt.

Defined cases: rows whose vector is null, has another number of components
than `dim`, or holds null or non-finite ones take no part; repeated rows are
vectors of their own; ties of distance go to the smaller number; with fewer
vectors than k each is a centroid; centroids without vectors stay; a null id is
kept, and becomes a first centroid only where ids run out; equal ids start in
the order of their vectors; an empty table gives no rows; scaled components
are held within 2**26, so that distances are exact in 64 bits. k centroids and
their sums are all that the driver ever holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import Scratch, table

#: Vectors of a tree, and of a leaf.
BLOCK, LEAF = 4096, 32
HELD = 1 << 26
#: Up to this component all terms of a squared distance are whole numbers that doubles hold.
DOUBLES = 1 << 22


class Tree:
    """Nodes in breadth-first order over vectors in the order of their leaves."""

    PARTS = ("x", "start", "end", "child", "radius", "total")

    def __init__(self, dim: int, **parts: bytes) -> None:
        self.x = np.frombuffer(parts["x"], np.int32).reshape(-1, dim).astype(np.int64)
        self.start, self.end, self.child = (np.frombuffer(parts[p], np.int32).astype(np.int64) for p in ("start", "end", "child"))
        self.radius = np.frombuffer(parts["radius"], np.float64)
        self.total = np.frombuffer(parts["total"], np.int64).reshape(-1, dim)
        self.centre = self.total / (self.end - self.start)[:, None]

    @staticmethod
    def build(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, dict[str, bytes]]:
        """(order of the vectors, packed parts): each node is cut in halves along the line through two vectors far apart."""
        order = np.arange(len(x))
        start, end, child, radius, total = [0], [len(x)], [], [], []
        i = 0
        while i < len(start):
            s, e = start[i], end[i]
            own = x[order[s:e]]
            total.append(own.sum(0))
            p = own.astype(np.float64)
            far = np.einsum("ij,ij->i", p - total[-1] / (e - s), p - total[-1] / (e - s))
            radius.append(float(np.sqrt(far.max())))
            if e - s > leaf and radius[-1] > 0:
                a = p[int(far.argmax())]
                along = p @ (p[int(np.einsum("ij,ij->i", p - a, p - a).argmax())] - a)
                half = (e - s) // 2
                order[s:e] = order[s:e][np.argpartition(along, half)]
                child.append(len(start))
                start += [s, s + half]
                end += [s + half, e]
            else:
                child.append(-1)
            i += 1
        parts = {"x": x[order].astype(np.int32), "radius": np.array(radius), "total": np.array(total, np.int64)}
        parts |= {k: np.array(v, np.int32) for k, v in (("start", start), ("end", end), ("child", child))}
        return order, {k: np.ascontiguousarray(parts[k]).tobytes() for k in Tree.PARTS}

    def filtered(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(nodes, their one centroid) of whole balls and (vectors, their centroid) of leaves."""
        front, left = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        balls, ball_of, rows, row_of = [], [], [], []
        while len(front):
            apart = self.centre[front][:, None, :] - c[None, :, :]
            d = np.where(left, np.sqrt(np.einsum("ijk,ijk->ij", apart, apart)), np.inf)
            near, r = d.min(1, keepdims=True), self.radius[front][:, None]
            # what rounding may have taken; a tie is never cut off
            left = left & (d - r <= near + r + 1e-9 * (1 + near + r))
            whole = left.sum(1) == 1
            balls.append(front[whole])
            ball_of.append(left[whole].argmax(1))
            ends = ~whole & (self.child[front] < 0)
            if ends.any():
                n = (self.end - self.start)[front[ends]]
                at = np.repeat(self.start[front[ends]] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                exact = distances(self.x[at], c)
                exact[~np.repeat(left[ends], n, axis=0)] = np.iinfo(np.int64).max
                rows.append(at)
                row_of.append(exact.argmin(1))
            deeper = ~whole & ~ends
            front, left = np.repeat(self.child[front[deeper]], 2), np.repeat(left[deeper], 2, axis=0)
            front[1::2] += 1
        return tuple(np.concatenate(v) if v else np.zeros(0, np.int64) for v in (balls, ball_of, rows, row_of))

    def sums(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, sum) of the vectors of each centroid."""
        ball, of_ball, row, of_row = self.filtered(c)
        count = np.bincount(of_row, minlength=len(c)) + np.bincount(of_ball, (self.end - self.start)[ball], minlength=len(c)).astype(np.int64)
        total = np.zeros(c.shape, np.int64)
        np.add.at(total, of_ball, self.total[ball])
        order = np.argsort(of_row, kind="stable")
        at = np.flatnonzero(np.diff(of_row[order], prepend=-1))
        if len(at):
            total[of_row[order][at]] += np.add.reduceat(self.x[row[order]], at, axis=0)
        return count, total

    def assigned(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) of each vector."""
        ball, of_ball, row, of_row = self.filtered(c)
        out = np.zeros(len(self.x), np.int64)
        out[row] = of_row
        for node, k in zip(ball.tolist(), of_ball.tolist(), strict=True):
            out[self.start[node] : self.end[node]] = k
        apart = self.x - c[out]
        return out, np.einsum("ij,ij->i", apart, apart)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of all x with all c."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    kind = np.float64 if top < DOUBLES and 4 * x.shape[1] * top * top < 1 << 53 else np.int64
    x, c = x.astype(kind), c.astype(kind)
    return (np.einsum("ij,ij->i", x, x)[:, None] - 2 * (x @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)


def whole_vectors(vectors: DataFrame, column: str, dim: int) -> Column:
    """True for vectors of `dim` finite components."""
    x = F.col(column)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v.cast("double")) | (F.abs(v.cast("double")) == float("inf")))
    return F.coalesce((F.size(x) == dim) & ~bad, F.lit(False))


def _scaled(column: pa.Array, scale: float, dim: int) -> np.ndarray:
    x = np.asarray(column.flatten(), np.float64).reshape(-1, dim)
    return np.clip(np.floor(scale * x), -HELD, HELD).astype(np.int64)


TREES = "ids array<bigint>, " + ", ".join(f"{p} binary" for p in Tree.PARTS)


def _grown(scale: float, dim: int, block: int):
    """Rows (id, vector) to one row a tree."""

    def tree(ids: list[pa.Array], rows: list[np.ndarray]) -> pa.RecordBatch:
        order, parts = Tree.build(np.concatenate(rows))
        ids = pa.concat_arrays(ids).take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([parts[p]], pa.binary()) for p in Tree.PARTS)], ["ids", *Tree.PARTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            x, i = _scaled(batch.column(1), scale, dim), 0
            while i < len(x):
                j = min(len(x), i + block - held)
                ids.append(batch.column(0).slice(i, j - i))
                rows.append(x[i:j])
                held, i = held + j - i, j
                if held == block:
                    yield tree(ids, rows)
                    ids, rows, held = [], [], 0
        if held:
            yield tree(ids, rows)

    return run


def _trees(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for r in range(batch.num_rows):
            yield batch.column(0)[r].values, Tree(dim, **{p: batch.column(k + 1)[r].as_buffer() for k, p in enumerate(Tree.PARTS)})


def _sums(c: np.ndarray):
    """A row for each centroid that has vectors in the task's trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for _, tree in _trees(batches, c.shape[1]):
            n, s = tree.sums(c)
            count += n
            total += s
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], ["cluster", "n", "total"])

    return run


def _assigned(c: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, tree in _trees(batches, c.shape[1]):
            of, d = tree.assigned(c)
            yield pa.RecordBatch.from_arrays([ids, pa.array(of, pa.int32()), pa.array(d)], ["id", "cluster", "distance"])

    return run


def first_centroids(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """The vectors of the k ids of least SHA-256 of `seed:id`, in that order."""
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    return rows.select(named.alias("name"), "v").orderBy(F.asc_nulls_last("name"), "v").limit(k)


def cluster(vectors: DataFrame, *, k: int, rounds: int, scale: float, dim: int, seed: int = 1, key: str = "vec_id", column: str = "embedding", block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector that takes part, and the final centroids."""
    scratch = Scratch(vectors.sparkSession, "balls")
    rows = vectors.filter(whole_vectors(vectors, column, dim)).select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    trees = scratch.cut(rows.mapInArrow(_grown(scale, dim, block), TREES), "trees")
    held = F.transform("v", lambda x: F.greatest(F.least(F.floor(x * scale).cast("double"), F.lit(float(HELD))), F.lit(float(-HELD))).cast("long"))
    first = first_centroids(rows.select("id", held.alias("v")), k, seed).collect()
    c = np.array([r["v"] for r in first], np.int64).reshape(len(first), dim)
    for _ in range(rounds if len(c) else 0):
        parts = trees.mapInArrow(_sums(c), "cluster int, n long, total array<bigint>")
        summed = parts.select("cluster", "n", F.posexplode("total").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum("part").alias("total"))
        c = c.copy()
        for r in summed.collect():
            c[r["cluster"], r["place"]] = r["total"] // r["n"]
    return trees.mapInArrow(_assigned(c), "id long, cluster int, distance long"), c


def with_inertia(found: DataFrame, centroids: np.ndarray, scratch: Scratch) -> DataFrame:
    """found with cluster_inertia, inertia and centroid_sha256."""
    found = scratch.cut(found, "assigned")
    spent = {r["cluster"]: r["d"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    facts = [(i, spent.get(i, 0), sum(spent.values()), names[i]) for i in range(len(centroids))]
    of = found.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(of), "cluster")  # k rows


K, ROUNDS, SCALE, DIM, SEED = 16, 3, 64.0, 64, 1


def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings in 16 clusters after three rounds."""
    found, centroids = cluster(table(spark, sf_dir, "embeddings"), k=K, rounds=ROUNDS, scale=SCALE, dim=DIM, seed=SEED)
    found = with_inertia(found, centroids, Scratch(spark, "clusters"))
    return found.select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _round(r: int) -> str:
    """SQL of one assignment (a{r}) and of the centroids after it (c{r + 1})."""
    return f""", d{r} AS (
  SELECT p.r, c.k, CAST(sum((p.x - c.x) * (p.x - c.x)) AS BIGINT) AS d FROM p JOIN c{r} AS c ON p.i = c.i GROUP BY p.r, c.k
), a{r} AS (
  SELECT r, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, k) = 1
), c{r + 1} AS (
  SELECT c.k, c.i, coalesce(m.x, c.x) AS x
  FROM c{r} AS c LEFT JOIN (
    SELECT a.k, p.i, CAST(floor(sum(p.x)::DOUBLE / count(*)) AS BIGINT) AS x FROM a{r} AS a JOIN p ON a.r = p.r GROUP BY a.k, p.i
  ) AS m ON c.k = m.k AND c.i = m.i
)"""


OP11_SQL = f"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT r, unnest(range({DIM})) AS i, unnest(v) AS x FROM v
), s AS (
  SELECT r, row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id) NULLS LAST, v) - 1 AS k FROM v
), c0 AS (
  SELECT s.k, p.i, p.x FROM s JOIN p ON s.r = p.r WHERE s.k < {K}
){"".join(map(_round, range(ROUNDS + 1)))}, h AS (
  SELECT k, sha256(string_agg(x, ',' ORDER BY i)) AS centroid_sha256 FROM c{ROUNDS} GROUP BY k
)
SELECT v.vec_id, CAST(a.k AS INT) AS cluster, a.d AS distance,
  CAST(sum(a.d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, h.centroid_sha256
FROM a{ROUNDS} AS a JOIN v ON a.r = v.r JOIN h ON a.k = h.k
"""
