"""Exact top-k by inner product with vector-approximation files.

Every vector is kept twice: as one cell number of a few bits for each
component, and exactly. A query scans the cells only: the bounds of a cell give
bounds of the score, and the exact vector is read only where the upper bound
reaches the k-th exact score so far, so the result is certain.

Vectors are dealt evenly to groups that one task holds, with no key that a
common vector could crowd. Blocks of queries go to every group by a shuffle and
stream past its vectors; each group returns k rows a query. Nothing is
broadcast, and the driver sees the extremes of the components only.

Defined cases: vectors that are null or have null, NaN or infinite components
and rows with a null id take no part; a query's own id is no candidate; with
fewer than k candidates all are returned; ties go to the smaller id; repeated
rows are candidates of their own with the same id; a query id that repeats asks
once, with its least vector (the SQL pairs each of its rows); vectors of another
length than the first are an error; an empty table gives no rows; components are held
within 2**53 and scores within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.llm.common import Scratch, table

BITS = 8
#: Vectors of a group at least, if there are as many, and bytes of its cells and exact vectors at most.
BLOCK, GROUP_BYTES = 8192, 40 << 20
#: Queries of a block, vectors that they meet at once, vectors that give the first bounds, and pairs scored exactly at once.
QUERY_BLOCK, STEP, SEEDS, PAIRS = 1024, 2048, 1024, 1 << 16
NONE = np.iinfo(np.int64).min


def usable(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """id and v (doubles) of the rows that take part."""
    x = F.col(column)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return vectors.filter(F.col(key).isNotNull() & x.isNotNull() & (F.size(x) > 0)).filter(~bad).select(F.col(key).cast("long").alias("id"), x.cast("array<double>").alias("v"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1)


def _to_int(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * x), -(2.0**53), 2.0**53).astype(np.int64)


def _extent(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        n = 0
        for batch in batches:
            if batch.num_rows:
                x = _to_int(_matrix(batch.column(0)), scale)
                n += len(x)
                a, b = x.min(0), x.max(0)
                low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([low.tolist()], pa.list_(pa.int64())), pa.array([high.tolist()], pa.list_(pa.int64())), pa.array([n], pa.int64())], ["low", "high", "n"])

    return run


class Cells:
    """A grid of 2**bits cells for each component between its extremes."""

    def __init__(self, low: np.ndarray, high: np.ndarray, bits: int) -> None:
        self.low, self.n = low.astype(np.float64), 1 << bits
        self.width = np.maximum((high - low + 1) / self.n, 1e-300)
        self.kind = np.uint8 if self.n <= 256 else np.uint16

    def of(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.low) / self.width, 0, self.n - 1).astype(self.kind)


class Queries:
    """A block of queries, with what bounds their scores by cells."""

    def __init__(self, cells: Cells, ids: np.ndarray, q: np.ndarray) -> None:
        self.ids, self.exact = ids, q
        x, scaled = np.abs(q.astype(np.float64)), q * cells.width
        reach = np.abs(scaled).sum(1) * cells.n
        self.kind = np.float32 if reach.max() < 1e30 else np.float64
        self.scaled = scaled.astype(self.kind)
        self.middle = q @ (cells.low + cells.width / 2)
        # half a cell and one unit, as rounding may put a value over its edge; then the rounding of the products
        self.slack = x @ (cells.width / 2 + 1e-9 * (np.abs(cells.low) + cells.n * cells.width)) + 1e-9
        self.slack += reach * (q.shape[1] + 4) * np.finfo(self.kind).eps

    def products(self, codes: np.ndarray) -> np.ndarray:
        """Of all queries (rows) with all codes: a true score is within this + middle +- slack."""
        return self.scaled @ codes.astype(self.kind).T

    def least(self, floor: np.ndarray) -> np.ndarray:
        """What a product must reach for its score to reach the floor."""
        low = np.where(floor == NONE, -np.inf, floor - self.middle - self.slack)
        return np.nextafter(low.astype(self.kind), self.kind(-np.inf))[:, None]


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row-wise integer inner products."""
    top = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if top < 1 << 62:
        return (x * q).sum(1)
    whole = (x.astype(object) * q.astype(object)).sum(1)
    return np.array([max(-(1 << 63), min((1 << 63) - 1, v)) for v in whole], np.int64)


def _place(*keys: np.ndarray) -> np.ndarray:
    """The place of each row within its run of equal keys."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.arange(len(new))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Top:
    """The k best (score, id) of each of n queries."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.held = k, np.zeros(n, np.int64)
        self.score, self.id = np.full((n, k), NONE), np.zeros((n, k), np.int64)

    def add(self, of: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        some = np.unique(of)
        had = np.arange(self.k) < self.held[some, None]
        of, ids, score = np.concatenate([np.repeat(some, self.held[some]), of]), np.concatenate([self.id[some][had], ids]), np.concatenate([self.score[some][had], score])
        order = np.lexsort((ids, ~score, of))
        of, ids, score = of[order], ids[order], score[order]
        place = _place(of)
        keep = place < self.k
        of, place = of[keep], place[keep]
        self.score[of, place], self.id[of, place] = score[keep], ids[keep]
        self.held[some] = np.bincount(of, minlength=len(self.held))[some]

    def floor(self) -> np.ndarray:
        """The k-th best, or NONE."""
        return self.score[:, -1]


class Group:
    """The vectors that one task holds.

    Copies of a vector are scored once, and keep the ids that ranks may need:
    of one id at most k rows, and of one vector 2 k, as k of these may be the
    query's own.
    """

    def __init__(self, ids: np.ndarray, codes: np.ndarray, exact: np.ndarray, k: int) -> None:
        self.k = k
        one = np.ascontiguousarray(exact).view(np.dtype((np.void, exact.itemsize * exact.shape[1])))[:, 0]
        _, first, of = np.unique(one, return_index=True, return_inverse=True)
        self.codes, self.exact = codes[first], exact[first]
        order = np.lexsort((ids, of))
        of, ids = of[order], ids[order]
        keep = _place(of, ids) < k
        of, ids = of[keep], ids[keep]
        keep = _place(of) < 2 * k
        self.ids, self.start = ids[keep], np.searchsorted(of[keep], np.arange(len(first) + 1))

    def _read(self, top: Top, queries: Queries, of: np.ndarray, row: np.ndarray) -> None:
        """Score the exact vectors of some rows for their queries."""
        size = max(1, PAIRS * 64 // self.exact.shape[1])
        for s in range(0, len(of), size):
            o, r = of[s : s + size], row[s : s + size]
            score = exact_scores(self.exact[r].astype(np.int64), queries.exact[o])
            n = self.start[r + 1] - self.start[r]
            at = np.repeat(self.start[r] - np.cumsum(n) + n, n) + np.arange(n.sum())
            o, ids, score = np.repeat(o, n), self.ids[at], np.repeat(score, n)
            other = ids != queries.ids[o]
            if other.any():
                top.add(o[other], ids[other], score[other])

    def best(self, queries: Queries) -> Top:
        m, k = len(queries.ids), self.k
        # the k-th exact score of some vectors bounds what the scan reads
        seeds = np.arange(0, len(self.codes), max(1, len(self.codes) // SEEDS))
        n = min(len(seeds), 2 * k)
        likely = np.argpartition(queries.products(self.codes[seeds]), len(seeds) - n, axis=1)[:, len(seeds) - n :]
        first, top = Top(m, k), Top(m, k)
        self._read(first, queries, np.repeat(np.arange(m), n), seeds[likely.ravel()])
        least = queries.least(first.floor())
        for s in range(0, len(self.codes), STEP):
            codes = self.codes[s : s + STEP]
            hit = np.flatnonzero(queries.products(codes) >= least)
            if len(hit):
                of, row = np.divmod(hit, len(codes))
                self._read(top, queries, of, s + row)
                least = queries.least(np.maximum(first.floor(), top.floor()))
        return top


def _dealt(scale: float, cells: Cells, kind: type, groups: int, most: int):
    """Rows (id, v) to rows (group, ids, codes, exact): every group gets its share of each `most` vectors or so."""

    def shares(ids: list, rows: list) -> pa.RecordBatch:
        own, x = np.concatenate(ids), np.concatenate(rows)
        codes, exact = cells.of(x), x.astype(kind)
        n, start = min(groups, len(x)), TaskContext.get().partitionId()
        number = [(start + g) % groups for g in range(n)]
        return pa.RecordBatch.from_arrays([pa.array(number, pa.int32()), *(pa.array([c[g::groups].tobytes() for g in range(n)], pa.binary()) for c in (own, codes, exact))], ["group", "ids", "codes", "exact"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, held = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids.append(np.asarray(batch.column(0)))
                rows.append(_to_int(_matrix(batch.column(1)), scale))
                held += batch.num_rows
            if held >= most:
                yield shares(ids, rows)
                ids, rows, held = [], [], 0
        if held:
            yield shares(ids, rows)

    return run


def _asked(scale: float, kind: type):
    """Rows (id, v) to blocks of queries (ids, exact)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, x = np.asarray(batch.column(0)), _to_int(_matrix(batch.column(1)), scale).astype(kind) if batch.num_rows else None
            for s in range(0, len(own), QUERY_BLOCK):
                yield pa.RecordBatch.from_arrays([pa.array([c[s : s + QUERY_BLOCK].tobytes()], pa.binary()) for c in (own, x)], ["ids", "exact"])

    return run


def _scan(cells: Cells, kind: type, k: int):
    """Rows (group, asks, ids, codes, exact) in that order, vectors before queries, to the k best of each query in each group."""
    d = len(cells.low)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, group = None, [], None
        for batch in batches:
            for r in range(batch.num_rows):
                if batch.column(0)[r].as_py() != now:
                    now, parts, group = batch.column(0)[r].as_py(), [], None
                ids, exact = np.frombuffer(batch.column(2)[r].as_buffer(), np.int64), np.frombuffer(batch.column(4)[r].as_buffer(), kind).reshape(-1, d)
                if not batch.column(1)[r].as_py():
                    parts.append((ids, np.frombuffer(batch.column(3)[r].as_buffer(), cells.kind).reshape(-1, d), exact))
                    continue
                if parts:
                    group, parts = Group(*map(np.concatenate, zip(*parts, strict=True)), k), []
                if group is not None:
                    top = group.best(Queries(cells, ids, exact.astype(np.int64)))
                    some = np.arange(k) < top.held[:, None]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, top.held)), pa.array(top.id[some]), pa.array(top.score[some])], ["query_id", "id", "score"])

    return run


def _kind(low: np.ndarray, high: np.ndarray) -> type:
    """The narrowest integers that hold all components."""
    return next(t for t in (np.int16, np.int32, np.int64) if low.min() >= np.iinfo(t).min and high.max() <= np.iinfo(t).max)


def top_k(vectors: DataFrame, is_query: Column, *, k: int, scale: float = 256.0, bits: int = BITS, key: str = "vec_id", column: str = "embedding", block: int = BLOCK, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """query_id, rank, id, score: the k largest integer inner products of each query with all other rows."""
    spark = vectors.sparkSession
    rows = usable(vectors, key, column)
    extent = rows.select("v").mapInArrow(_extent(scale), "low array<long>, high array<long>, n long").collect()
    if not extent:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    low, high, n = np.min([r["low"] for r in extent], 0), np.max([r["high"] for r in extent], 0), sum(r["n"] for r in extent)
    cells, kind = Cells(low, high, bits), _kind(low, high)
    most = max(1, group_bytes // (8 + len(low) * (np.dtype(cells.kind).itemsize + np.dtype(kind).itemsize)))
    # queries go to every group: no more groups than keep all cores busy, or than memory asks for
    groups = max(-(-n // most), min(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism, -(-n // block)))
    data = rows.mapInArrow(_dealt(scale, cells, kind, groups, min(most, 8 * block)), "group int, ids binary, codes binary, exact binary")
    # one row a query id: repeated ones would return each candidate several times
    asking = rows.filter(is_query).groupBy("id").agg(F.min("v").alias("v")).mapInArrow(_asked(scale, kind), "ids binary, exact binary")
    ask = asking.select(F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), F.lit(True).alias("asks"), "ids", F.lit(None).cast("binary").alias("codes"), "exact")
    met = data.withColumn("asks", F.lit(False)).select(ask.columns).union(ask).repartitionById(groups, F.col("group")).sortWithinPartitions("group", "asks")
    found = Scratch(spark, "vafile").cut(met.mapInArrow(_scan(cells, kind, k), "query_id long, id long, score long"), "found")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op7_va_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best of all embeddings for every fiftieth."""
    found = top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
