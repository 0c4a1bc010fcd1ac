"""Approximate nearest neighbours by NN-descent and greedy graph search.

The graph of K neighbours starts from a forest of random-projection trees,
fitted on a bounded sample; every row falls into one leaf of each tree and
gets its best neighbours there. NN-descent then improves it by Spark joins:
each node meets its neighbours and those it is a neighbour of, and introduces
them to each other where one of the two is new to it; what beats the worst
neighbour of either is merged in. Queries walk the graph: from the neighbours
of the query's own node on, the best unexpanded nodes are expanded, until
the best BEAM * k found are all expanded. What is found is scored exactly at last.

Largest inner product is nearness on a sphere after adding one component,
sqrt(M^2 - |x|^2) with M the largest norm, to every vector; the query gets 0
there. Nodes are dealt to tasks in blocks of neighbouring leaves, and each
block is sent every vector it needs once. A block keeps the K best that it
finds for a node, and sends what it found for a bucket of nodes as one row.
A leaf that is larger than meant is dealt out by id, so that leaves and blocks
stay of one size as the table grows.

The index is approximate: a node keeps K neighbours and meets at most K of
those that name it, as the method has it; those are cut to K where they are
read, so a hub gathers K from each batch of rows at most. Recall is measured
in the tests.

Defined cases: rows with a null id, and vectors that are null, zero, or have
null, NaN or infinite components take no part; of rows that repeat an id the
least vector counts; a query's own id is no candidate; with fewer than k
candidates all are returned; ties go to the smaller id; an empty table gives
no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.llm.common import Scratch, distinct_pairs, lists, packed, table, whole_groups
from canvass.llm.va_file import usable

#: Neighbours of a node, rounds of NN-descent at most, share of changed neighbours below which it ends.
K, ROUNDS, ENOUGH = 40, 4, 0.02
#: Trees, rows of a leaf, rows they are fitted on.
TREES, LEAF, SAMPLE = 6, 1500, 20_000
#: Nodes and queries of a block, candidates a query keeps, nodes it expands at once.
BLOCK, QUERY_BLOCK, KEPT, EXPAND = 4096, 512, 96, 16
#: Of the best found for a query, as many times k are expanded before its walk ends.
BEAM = 3
#: Nodes of a bucket; what a block finds for a bucket, or asks of it, is one row. Their number follows the table, not the cluster.
BUCKET = 512


def best_of(owner: np.ndarray, other: np.ndarray, sim: np.ndarray, fresh: np.ndarray, k: int, alike: bool = True):
    """For each owner its k most similar distinct others, best first; of a pair that is there twice the older counts.

    alike: owners and others are numbered alike, and an owner is no neighbour of its own.
    """
    order = np.lexsort((fresh, other, owner))
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    keep = np.concatenate([[True], (owner[1:] != owner[:-1]) | (other[1:] != other[:-1])]) if len(owner) else np.zeros(0, bool)
    if alike:
        keep &= owner != other
    owner, other, sim, fresh = owner[keep], other[keep], sim[keep], fresh[keep]
    order = np.lexsort((other, -sim, owner))
    owner, other, sim, fresh = owner[order], other[order], sim[order], fresh[order]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
    place = np.arange(len(owner)) - np.repeat(first, np.diff(np.append(first, len(owner))))
    keep = place < k
    owner, other, sim, fresh = owner[keep], other[keep], sim[keep], fresh[keep]
    ids, counts = np.unique(owner, return_counts=True)
    return ids, counts, other, sim, fresh


# the forest


class Tree:
    """Hyperplanes in arrays; node i has children in `kids`, negative ones being leaves."""

    def __init__(self, x: np.ndarray, leaf: int, rng: np.random.Generator) -> None:
        self.normals, self.offsets, self.kids, self.sizes = [], [], [], []
        self.root = self._grow(x, np.arange(len(x)), leaf, rng)
        self.normals = np.array(self.normals, np.float32).reshape(-1, x.shape[1])
        self.offsets, self.kids = np.array(self.offsets, np.float32), np.array(self.kids, np.int64).reshape(-1, 2)

    def _grow(self, x: np.ndarray, rows: np.ndarray, leaf: int, rng: np.random.Generator) -> int:
        if len(rows) > leaf:
            for _ in range(4):
                a, b = rng.choice(rows, 2, replace=False)
                normal = x[a] - x[b]
                side = x[rows] @ normal
                offset = float(np.median(side))
                right = side > offset
                if 0.1 < right.mean() < 0.9:
                    at = len(self.kids)
                    self.normals.append(normal)
                    self.offsets.append(offset)
                    self.kids.append([0, 0])
                    self.kids[at] = [self._grow(x, rows[~right], leaf, rng), self._grow(x, rows[right], leaf, rng)]
                    return at
        self.sizes.append(len(rows))
        return -len(self.sizes)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        at = np.full(len(x), self.root, np.int64)
        while (at >= 0).any():
            go = np.flatnonzero(at >= 0)
            n = at[go]
            right = (x[go] * self.normals[n]).sum(1) > self.offsets[n]
            at[go] = self.kids[n, right.astype(np.int64)]
        return -at - 1


def _unit(norm: float):
    """(id, v) to the unit vector of the augmented space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.asarray(b.column(1).flatten(), np.float64).reshape(b.num_rows, -1) / norm
                u = np.concatenate([x, np.sqrt(np.maximum(0, 1 - (x * x).sum(1)))[:, None]], 1).astype(np.float32)
                yield pa.RecordBatch.from_arrays([b.column(0), packed(u.ravel(), np.full(len(u), u.shape[1]))], ["id", "u"])

    return run


def _lot(member: np.ndarray, node: np.ndarray, turn: int) -> np.ndarray:
    """A seeded order of those that name a node."""
    return (member.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ (node + turn).astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(buckets)).astype(np.int32)


def _leaves(forest, splits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, parts = pickle.loads(forest.value), splits
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column(0))
            u = lists(b.column(1), np.float32)[0].reshape(b.num_rows, -1)
            spread = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            block = None
            for t, tree in enumerate(trees):
                leaf = tree.leaf_of(u)
                n = parts[t][leaf]
                key = (np.int64(t) << 48) | (leaf << 24) | (spread % n)
                # pieces of the first tree's leaves, counted through
                block = (np.cumsum(parts[t]) - parts[t])[leaf] + spread % n if block is None else block
                yield pa.RecordBatch.from_arrays([pa.array(key), b.column(0), b.column(1), pa.array(block)], ["leaf", "id", "u", "block"])

    return run


NEAR = "id long, block long, u binary, nbrs binary, sims binary, fresh binary"
#: What is merged: such rows, and rows (ids, counts, nbrs, sims, fresh) with what a block found for a bucket of nodes.
FOUND = f"bucket int, {NEAR}, ids binary, counts binary"
FOUND_NAMES = [x.split()[0] for x in FOUND.split(", ")]


def _found_rows(buckets: int, ids: np.ndarray, rest: list[pa.Array]) -> pa.RecordBatch:
    nothing = pa.nulls(len(ids), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(bucket_of(ids, buckets)), pa.array(ids), *rest, nothing, nothing], FOUND_NAMES)


def _within_leaves(k: int, most: int, per_block: int, buckets: int):
    """Best neighbours within each leaf, a leaf at a time and never more than `most` rows of it together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            keys = np.asarray(t.column(0))
            cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])).tolist()
            for i, j in zip(cut, [*cut[1:], len(keys)], strict=True):
                pieces = -(-(j - i) // most)
                for p in range(pieces):
                    part = t.slice(i + (j - i) * p // pieces, (j - i) * (p + 1) // pieces - (j - i) * p // pieces)
                    ids = np.asarray(part.column(1))
                    u = lists(part.column(2), np.float32)[0].reshape(len(ids), -1)
                    m = min(k, len(ids) - 1)
                    nbrs, sims = np.zeros((len(ids), m), np.int64), np.zeros((len(ids), m), np.float32)
                    for a in range(0, len(ids) if m else 0, 512):
                        s = u[a : a + 512] @ u.T
                        s[np.arange(len(s)), a + np.arange(len(s))] = -2
                        top = np.argpartition(s, -m, axis=1)[:, -m:]
                        nbrs[a : a + 512], sims[a : a + 512] = ids[top], np.take_along_axis(s, top, 1)
                    n = np.full(len(ids), m)
                    own = (keys[i] >> 48) == 0  # the first tree's rows carry the vector on
                    u_out = part.column(2).combine_chunks() if own else pa.nulls(len(ids), pa.binary())
                    if isinstance(u_out, pa.ChunkedArray):
                        u_out = pa.concat_arrays(u_out.chunks)
                    yield _found_rows(buckets, ids, [pa.array(np.asarray(part.column(3)) // per_block), u_out, packed(nbrs.ravel(), n), packed(sims.ravel(), n), packed(np.ones(nbrs.size, bool), n)])

    return run


def _merge(k: int):
    """Rows of FOUND in order of bucket, one of which has u for each id, to one row for each id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 1):
            single = ~np.asarray(t.column(1).is_null())
            ids = np.asarray(t.column(1).fill_null(0))
            nbrs, n = lists(t.column(4), np.int64)
            sims, fresh = lists(t.column(5), np.float32)[0], lists(t.column(6), bool)[0]
            many, m = lists(t.column(7), np.int64)
            owners = np.where(single, 1, m)
            row = np.repeat(single, owners)
            owner, count = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            owner[row], count[row] = ids[single], n[single]
            owner[~row], count[~row] = many, lists(t.column(8), np.int32)[0]
            who, counts, nbrs, sims, fresh = best_of(np.repeat(owner, count), nbrs, sims, fresh, k)
            has = np.flatnonzero(~np.asarray(t.column(3).is_null()))
            own, at = np.unique(ids[has], return_index=True)
            full = np.zeros(len(own), np.int64)
            full[np.searchsorted(own, who)] = counts
            rows = t.take(pa.array(has[at]))
            u = rows.column(3)
            u = pa.concat_arrays(u.chunks) if isinstance(u, pa.ChunkedArray) else u
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.asarray(rows.column(2))), u, packed(nbrs, full), packed(sims, full), packed(fresh, full)], ["id", "block", "u", "nbrs", "sims", "fresh"])

    return run


EDGES = "node long, member long, fresh boolean, named boolean, block long"


def _edges(k: int, turn: int):
    """Each neighbour of a node, and the node as one of those that name its neighbour: k of them from a batch at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in EDGES.split(", ")]
        with np.errstate(over="ignore"):
            for b in batches:
                ids, block = np.asarray(b.column(0)), np.asarray(b.column(1))
                nbrs, n = lists(b.column(3), np.int64)
                fresh = lists(b.column(5), bool)[0]
                own = np.repeat(ids, n)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(nbrs), pa.array(fresh), pa.array(np.zeros(len(own), bool)), pa.array(np.repeat(block, n))], names)
                order = np.lexsort((_lot(own, nbrs, turn), nbrs))
                own, nbrs, fresh = own[order], nbrs[order], fresh[order]
                first = np.flatnonzero(np.concatenate([[True], nbrs[1:] != nbrs[:-1]])) if len(nbrs) else np.zeros(0, np.int64)
                keep = np.arange(len(nbrs)) - np.repeat(first, np.diff(np.append(first, len(nbrs)))) < k
                own, nbrs, fresh = own[keep], nbrs[keep], fresh[keep]
                yield pa.RecordBatch.from_arrays([pa.array(nbrs), pa.array(own), pa.array(fresh), pa.array(np.ones(len(own), bool)), pa.array(np.full(len(own), -1))], names)

    return run


def _meetings(k: int, turn: int):
    """For each node those who meet there: its neighbours, and k of those that name it, dealt by a seeded order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, 100_000):
            node, member, fresh, named, block = (np.asarray(c) for c in t.columns)
            order = np.lexsort((_lot(member, node, turn), named, node))
            node, member, fresh, named, block = node[order], member[order], fresh[order], named[order], block[order]
            first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (named[1:] != named[:-1])]))
            place = np.arange(len(node)) - np.repeat(first, np.diff(np.append(first, len(node))))
            keep = ~named | (place < k)
            node, member, fresh, block = node[keep], member[keep], fresh[keep], block[keep]
            order = np.lexsort((~fresh, member, node))
            node, member, fresh, block = node[order], member[order], fresh[order], block[order]
            once = np.concatenate([[True], (node[1:] != node[:-1]) | (member[1:] != member[:-1])])
            where = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            of = np.maximum.reduceat(block, where)
            counts = np.add.reduceat(once.astype(np.int64), where)
            yield pa.RecordBatch.from_arrays([pa.array(of), pa.array(node[where]), packed(member[once], counts), packed(fresh[once], counts)], ["block", "node", "members", "fresh"])

    return run


#: Buckets of nodes, and what blocks ask of them: (id, u, kth) offered, (block, ids) asked.
EXCHANGE = "bucket int, block long, id long, u binary, kth float, ids binary"
EXCHANGE_NAMES = [x.split()[0] for x in EXCHANGE.split(", ")]
ANSWER = "block long, ids binary, us binary, kths binary"


def _asked(buckets: int):
    """What lists (block, node, members) need: for each block and bucket of nodes a row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members, n = lists(b.column(2), np.int64)
            block, ids = distinct_pairs(np.repeat(np.asarray(b.column(0)), n), members)
            bucket = bucket_of(ids, buckets)
            order = np.lexsort((ids, block, bucket))
            block, ids, bucket = block[order], ids[order], bucket[order]
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])])) if len(ids) else np.zeros(0, np.int64)
            nothing = lambda kind: pa.nulls(len(first), kind)
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(block[first]), nothing(pa.int64()), nothing(pa.binary()), nothing(pa.float32()), packed(ids, np.diff(np.append(first, len(ids))))], EXCHANGE_NAMES)

    return run


def _offered(k: int, buckets: int):
    """Each node with its vector and the similarity that a new neighbour has to beat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sims, n = lists(b.column(4), np.float32)
            kth = np.full(b.num_rows, -2, np.float32)
            full = n >= k
            kth[full] = sims[(np.cumsum(n) - 1)[full]]
            yield pa.RecordBatch.from_arrays([pa.array(bucket_of(np.asarray(b.column(0)), buckets)), pa.nulls(b.num_rows, pa.int64()), b.column(0), b.column(2), pa.array(kth), pa.nulls(b.num_rows, pa.binary())], EXCHANGE_NAMES)

    return run


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each block that asks a bucket: the ids, vectors and similarities it asked for."""
    for t in whole_groups(batches, 1):
        bucket, own = np.asarray(t.column(0)), ~np.asarray(t.column(2).is_null())
        nodes, ask = t.filter(pa.array(own)), t.filter(pa.array(~own))
        if not ask.num_rows:
            continue
        ids = np.asarray(nodes.column(2))
        order = np.argsort(ids)
        ids = ids[order]
        u = lists(_column(nodes, "u"), np.float32)[0].reshape(len(ids), -1)[order]
        kth = np.asarray(nodes.column(4))[order]
        wanted, n = lists(_column(ask, "ids"), np.int64)
        block, bucket = np.repeat(np.asarray(ask.column(1)), n), np.repeat(bucket[~own], n)
        order = np.lexsort((wanted, block, bucket))
        block, bucket, wanted = block[order], bucket[order], wanted[order]
        keep = np.concatenate([[True], (wanted[1:] != wanted[:-1]) | (block[1:] != block[:-1])])
        block, bucket, at = block[keep], bucket[keep], np.searchsorted(ids, wanted[keep])
        first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])]))
        ends = np.append(first[1:], len(at))
        for i in range(0, len(first), 64):  # some rows at a time: vectors are copied for each that asks
            part = slice(first[i], ends[min(i + 64, len(first)) - 1])
            size = (ends - first)[i : i + 64]
            yield pa.RecordBatch.from_arrays([pa.array(block[first[i : i + 64]]), packed(ids[at[part]], size), packed(u[at[part]].ravel(), size * u.shape[1]), packed(kth[at[part]], size)], [x.split()[0] for x in ANSWER.split(", ")])


def answered(asking: DataFrame, graph: DataFrame, k: int, buckets: int) -> DataFrame:
    """(block, ids, us, kths) of what lists (block, node, members) need of the graph. Buckets of nodes answer blocks with a row each."""
    both = graph.mapInArrow(_offered(k, buckets), EXCHANGE).union(asking.mapInArrow(_asked(buckets), EXCHANGE))
    parts = min(buckets, int(graph.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return both.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_answers, ANSWER)


def _column(t: pa.Table, name: str):
    c = t.column(name)
    return c.combine_chunks() if isinstance(c, pa.ChunkedArray) and c.num_chunks else c


def _introduce(k: int, buckets: int):
    """In one block: all pairs that meet, one of them new, kept where they beat the k-th neighbour of either; one row a bucket."""

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        ids = lists(_column(right, "ids"), np.int64)[0]
        order = np.argsort(ids)
        ids = ids[order]
        u = lists(_column(right, "us"), np.float32)[0].reshape(len(ids), -1)[order]
        floor = lists(_column(right, "kths"), np.float32)[0][order]
        members, n = lists(_column(left, "members"), np.int64)
        fresh = lists(_column(left, "fresh"), bool)[0]
        at = np.searchsorted(ids, members)
        ends = np.concatenate([[0], np.cumsum(n)])
        found: list[list[np.ndarray]] = [[], [], []]
        done: list[tuple] = []

        def fold() -> None:
            a, b, s = (np.concatenate(x) for x in found)
            who, counts, other, sim, _ = best_of(np.concatenate([a, *(d[0] for d in done)]), np.concatenate([b, *(d[1] for d in done)]), np.concatenate([s, *(d[2] for d in done)]), np.ones(len(a) + sum(len(d[0]) for d in done), bool), k)
            done[:] = [(np.repeat(who, counts), other, sim)]
            for x in found:
                x.clear()

        size = 0
        for r in range(len(n)):
            i, new = at[ends[r] : ends[r + 1]], fresh[ends[r] : ends[r + 1]]
            if not new.any():
                continue
            x = u[i]
            s = x @ x.T
            better = s > floor[i][:, None]
            better &= new[:, None] | new[None, :]
            np.fill_diagonal(better, False)
            p, q = np.nonzero(better)
            found[0].append(i[p])
            found[1].append(i[q])
            found[2].append(s[p, q])
            size += len(p)
            if size > 2_000_000:
                fold()
                size = 0
        if found[0] or done:
            if found[0]:
                fold()
            who, other, sim = done[0]
        else:
            who = other = np.zeros(0, np.int64)
            sim = np.zeros(0, np.float32)
        own, counts = np.unique(who, return_counts=True)
        bucket = bucket_of(ids[own], buckets)
        order = np.argsort(bucket, kind="stable")
        begin, counts, bucket = (np.cumsum(counts) - counts)[order], counts[order], bucket[order]
        place = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(len(who))
        first = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
        nodes = np.diff(np.append(first, len(bucket)))
        size = np.add.reduceat(counts, first) if len(first) else first
        nothing = lambda kind: pa.nulls(len(first), kind)
        return pa.table([pa.array(bucket[first]), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.binary()), packed(ids[other[place]], size), packed(sim[place].astype(np.float32), size), packed(np.ones(len(who), bool), size), packed(ids[own[order]], nodes), packed(counts.astype(np.int32), nodes)], FOUND_NAMES)

    return run


def build(rows: DataFrame, scratch: Scratch, *, k: int = K, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame, int] | None:
    """(graph, meetings, buckets) of rows (id, v): the neighbours of each node, those that it meets both ways, and the number of buckets."""
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n, norm = rows.agg(F.count("*"), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    if not n:
        return None
    base = scratch.cut(rows.mapInArrow(_unit(float(norm)), "id long, u binary"), "base")
    some = base.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    x = np.array([np.frombuffer(r["u"], np.float32) for r in some])
    rng = np.random.default_rng(1)
    leaf = max(8, LEAF * len(x) // n)
    trees = [Tree(x, leaf, rng) for _ in range(TREES if n > LEAF else 1)]
    # a leaf that the sample shows to be larger than meant is dealt out by id
    splits = [np.array([max(1, round(s * n / len(x) / (2 * LEAF))) for s in t.sizes]) for t in trees]
    forest = spark.sparkContext.broadcast(pickle.dumps(trees))
    dealt = base.mapInArrow(_leaves(forest, splits), "leaf long, id long, u binary, block long")
    per_block, buckets = max(1, round(BLOCK / max(1, n / int(splits[0].sum())))), -(-n // BUCKET)
    near = dealt.repartition(parts, "leaf").sortWithinPartitions("leaf").mapInArrow(_within_leaves(max(k // 2, 20), 4 * LEAF, per_block, buckets), FOUND)
    merged = lambda df: df.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(_merge(k), NEAR)
    graph = scratch.cut(merged(near), "graph-0")
    scratch.drop("base")
    turn, going = 0, True
    while True:
        edges = graph.mapInArrow(_edges(k, turn), EDGES)
        meet = edges.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(_meetings(k, turn), "block long, node long, members binary, fresh binary")
        meet = scratch.cut(meet, f"meet-{turn}")
        if turn == rounds or not going:
            return graph, meet, buckets
        # who has met all its members already introduces nobody
        news = meet.filter(F.contains("fresh", F.lit(bytearray(b"\x01"))))
        new = news.groupBy("block").cogroup(answered(news.select("block", "node", "members"), graph, k, buckets).groupBy("block")).applyInArrow(_introduce(k, buckets), FOUND)
        old = graph.mapInArrow(_seen(buckets), FOUND)
        graph = scratch.cut(merged(old.union(new)), f"graph-{turn + 1}")
        scratch.drop(f"graph-{turn}", f"meet-{turn}")
        changed = graph.mapInArrow(_changed, "n long").agg(F.sum("n")).first()[0] or 0
        turn, going = turn + 1, changed >= ENOUGH * n * k


def _seen(buckets: int):
    """All neighbours have met now."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, n = lists(b.column(5), bool)
            yield _found_rows(buckets, np.asarray(b.column(0)), [*b.columns[1:5], packed(np.zeros(len(flat), bool), n)])

    return run


def _changed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays([pa.array([sum(int(lists(b.column(5), bool)[0].sum()) for b in batches)], pa.int64())], ["n"])


WALK = "block long, node long, q binary, ids binary, sims binary, done binary"


def _start(blocks: int):
    """Queries with their own neighbours, unscored, as candidates; the added component of a query is 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = np.asarray(b.column(0))
            u = lists(b.column(1), np.float32)[0].reshape(len(ids), -1).copy()
            u[:, -1] = 0
            u /= np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-30)
            nothing = np.zeros(len(ids), np.int64)
            block = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
            yield pa.RecordBatch.from_arrays([pa.array(block), b.column(0), packed(u.ravel(), np.full(len(ids), u.shape[1])), packed(np.zeros(0, np.int64), nothing), packed(np.zeros(0, np.float32), nothing), packed(np.zeros(0, bool), nothing)], [x.split()[0] for x in WALK.split(", ")])

    return run


def _frontier(expand: int, k: int):
    """(node to expand, query, block) of the best that are not expanded; the query's own node at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, node = np.asarray(b.column(0)), np.asarray(b.column(1))
            ids, n = lists(b.column(3), np.int64)
            done = lists(b.column(5), bool)[0]
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            open_ = ~done
            waits = np.bincount(row[open_ & (place < k)], minlength=len(n)) > 0  # the best are not all expanded yet
            rank = np.cumsum(open_) - np.repeat(np.concatenate([[0], np.cumsum(open_)])[np.cumsum(n) - n], n)
            take = open_ & (rank <= expand) & waits[row]
            at = np.concatenate([ids[take], node[n == 0]])
            who = np.concatenate([row[take], np.flatnonzero(n == 0)])
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(node[who]), pa.array(block[who])], ["node", "query", "block"])

    return run


def _advance(expand: int, k: int, kept: int):
    """In one block of queries: mark what was expanded, score what it led to, keep the best."""

    def run(key, left: pa.Table, met: pa.Table) -> pa.Table:
        node = np.asarray(_column(left, "node"))
        q = lists(_column(left, "q"), np.float32)[0].reshape(len(node), -1)
        ids, n = lists(_column(left, "ids"), np.int64)
        sims, done = lists(_column(left, "sims"), np.float32)[0], lists(_column(left, "done"), bool)[0].copy()
        isnt = np.asarray(_column(met, "query").is_null())
        vectors, links = met.filter(pa.array(isnt)), met.filter(pa.array(~isnt))
        vid = lists(_column(vectors, "ids"), np.int64)[0] if vectors.num_rows else np.zeros(0, np.int64)
        order = np.argsort(vid)
        vid = vid[order]
        u = lists(_column(vectors, "us"), np.float32)[0].reshape(len(vid), -1)[order] if len(vid) else np.zeros((0, q.shape[1]), np.float32)
        asked = np.asarray(_column(links, "query")) if links.num_rows else np.zeros(0, np.int64)
        to, m = lists(_column(links, "ids"), np.int64) if links.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        by = np.argsort(node)
        row = by[np.searchsorted(node[by], np.repeat(asked, m))] if len(asked) else np.zeros(0, np.int64)
        pairs = np.stack(distinct_pairs(row, to), 1)
        pairs = pairs[pairs[:, 1] != node[pairs[:, 0]]]
        at = np.searchsorted(vid, pairs[:, 1])
        score = np.concatenate([np.zeros(0, np.float32), *((q[pairs[i : i + 100_000, 0]] * u[at[i : i + 100_000]]).sum(1) for i in range(0, len(pairs), 100_000))])
        # mark the expanded as _frontier chose them
        own = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
        open_ = ~done
        waits = np.bincount(own[open_ & (place < k)], minlength=len(n)) > 0
        rank = np.cumsum(open_) - np.repeat(np.concatenate([[0], np.cumsum(open_)])[np.cumsum(n) - n], n)
        done |= open_ & (rank <= expand) & waits[own]
        who, counts, other, sim, new = best_of(np.concatenate([own, pairs[:, 0]]), np.concatenate([ids, pairs[:, 1]]), np.concatenate([sims, score]).astype(np.float32), np.concatenate([~done, np.ones(len(pairs), bool)]), kept, alike=False)
        full = np.zeros(len(node), np.int64)
        full[who] = counts
        return pa.table([pa.array(np.asarray(_column(left, "block"))), pa.array(node), packed(q.ravel(), np.full(len(node), q.shape[1])), packed(other, full), packed(sim, full), packed(~new, full)], [x.split()[0] for x in WALK.split(", ")])

    return run


def search(graph: DataFrame, meet: DataFrame, buckets: int, is_query: Column, scratch: Scratch, *, k: int, kept: int = KEPT) -> DataFrame:
    """(query, id): the candidates that greedy search finds for the nodes of the graph that are queries."""
    queries = graph.select("id", "u").filter(is_query)
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    beam = BEAM * k
    kept = max(kept, beam)
    walk = scratch.cut(queries.mapInArrow(_start(blocks), WALK), "walk-0")
    turn = 0
    while True:  # each turn expands nodes that were not expanded, until no query has one among its best
        front = scratch.cut(walk.mapInArrow(_frontier(EXPAND, beam), "node long, query long, block long"), f"front-{turn}")
        if front.isEmpty():
            break
        links = scratch.cut(front.join(meet.select("node", "members"), "node").select("block", "query", "members"), f"links-{turn}")
        told = answered(links, graph, k, buckets).select("block", F.lit(None).cast("long").alias("query"), "ids", "us")
        both = told.union(links.select("block", "query", "members", F.lit(None).cast("binary")))
        after = walk.groupBy("block").cogroup(both.groupBy("block")).applyInArrow(_advance(EXPAND, beam, kept), WALK)
        walk = scratch.cut(after, f"walk-{turn + 1}")
        scratch.drop(f"walk-{turn}", f"front-{turn}", f"links-{turn}")
        turn += 1
    return walk.mapInArrow(_found(max(2 * k, 40)), "query long, id long")


def _found(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n = lists(b.column(3), np.int64)
            place = np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(b.column(1)), n)[place < most]), pa.array(ids[place < most])], ["query", "id"])

    return run


def neighbours(vectors: DataFrame, is_query: Column, *, k: int, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """query_id, rank, id, score: the k largest inner products found for each query (a condition on id)."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "neighbours")
    rows = usable(vectors, key, column).filter(F.exists("v", lambda x: x != 0)).groupBy("id").agg(F.min("v").alias("v"))
    rows = scratch.cut(rows, "rows")
    built = build(rows, scratch)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, id long, score double")
    pairs = search(*built, is_query, scratch, k=k)
    full = pairs.join(rows.withColumnRenamed("v", "x"), "id").join(rows.select(F.col("id").alias("query"), F.col("v").alias("q")), "query")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, q = (np.asarray(b.column(c).flatten(), np.float64).reshape(b.num_rows, -1) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array((x * q).sum(1))], ["query_id", "id", "score"])

    scored = full.select("query", "id", "x", "q").mapInArrow(score, "query_id long, id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings found for every twentieth."""
    found = neighbours(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
