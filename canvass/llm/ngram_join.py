"""Jaccard join of documents on word n-grams, as a blocked sparse product.

The document by n-gram incidence matrix is never multiplied whole. Its
columns are put in one global order, rare n-grams first, by a counting sketch
of fixed size over all documents. A size-derived bound then says how many of
a document's first columns must hold one that a similar document holds too
(n - ceil(t n) + 1 of n); only these entries are sent, cut into blocks of
columns, and columns with one row are dropped, as are those that have the
rows of an earlier one. Equal rows (copies) are one
row of the matrix, and a row is known by a hash of its set.

The product of a block is formed inside the task that holds it: pairs of rows
of one column are weighed in numpy and leave it only if bounds allow them to
be similar. These bounds are exact, so that no pair is lost: the overlap that
the two sizes ask for must fit behind the places of their first common column
in both rows, and the parity maps of the rows (one bit for each of about n
values, flipped by each n-gram) must not differ in more bits than the sizes
allow the sets to differ in n-grams. What is left is counted on whole sets.

Only connectivity is asked for, so pairs within one known component are never
formed. Rounds of cheap comparisons with pivots come first: of each column
the row with the fewest rarer columns, which is the most central one of a
crowd of near copies, and one at random. Then all pairs of rows that share a
column and lie in different components are looked at, which makes the result
whole. A column of very many rows is dealt out by pairs of parts of it.

Defined cases: null or empty texts and texts of spaces have no n-grams and
link with nothing; fewer words than n form one n-gram; equal n-gram sets
link; repeated rows are documents alike, and rows without an id link others
like any row; an empty table gives no rows; other columns are not read. Sets
are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import LOWER, SPACES, STEP_BYTES, BytesHash, Scratch, distinct, distinct_pairs, flat_text, lists, mix64, packed, steps, table, tidy, whole_groups, words

N, PERCENT = 5, 80
#: The sketch that orders n-grams has a one-byte counter for about GRAMS_PER_COUNTER of them, within these powers of two: 64 MB as broadcast at most.
LEAST_BITS, MOST_BITS, GRAMS_PER_COUNTER, SKETCH_BLOCKS = 18, 26, 32, 64
#: Documents whose ids are broadcast to filter a scan; beyond it a shuffled join does it.
BROADCAST_IDS = 1_000_000
#: Rounds with pivots at most, pairs for each entry that need no further round, and the share of pairs that a useful round leaves at most.
PIVOT_ROUNDS, PAIRS_PER_ENTRY, WORTH = 5, 10, 0.7
#: Pivots that a row is compared with in a round, and rows that one copy of a pivot's set is sent to.
TRIES, TAILS = 2, 1000
#: Rows of a column that are compared in one task; columns of up to FEW rows are compared many at once, and others in matrices of CELLS cells.
PART, FEW, CELLS = 32_768, 48, 1 << 20
#: Sizes of parity maps as powers of two, in bits.
LEAST_MAP, MOST_MAP = 6, 12
_HASH = BytesHash(11)
_WORD = [np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(5).integers(1 << 40, 1 << 62, 64)]


def word_hashes(b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words of each row as offsets), letters A-Z lower-cased."""
    if len(b) <= 4 * STEP_BYTES:
        s, e, o = words(b, offsets)
        return _HASH.of(LOWER[b], s, e), o
    out, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for r in range(len(offsets) - 1):  # long rows by parts that end at a space
        at, end = int(offsets[r]), int(offsets[r + 1])
        while at < end:
            to = min(at + STEP_BYTES, end)
            while to < end and not SPACES[b[to]]:
                to += 1
            part = b[at:to]
            s, e, _ = words(part, np.array([0, len(part)]))
            out.append(_HASH.of(LOWER[part], s, e))
            counts[r] += len(s)
            at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(counts)])


def shingle_sets(b: np.ndarray, offsets: np.ndarray, n: int = N) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each row."""
    w, o = word_hashes(b, offsets)
    whole = np.zeros(max(0, len(w) - n + 1), np.uint64)
    for j in range(n):
        whole += w[j : j + len(whole)] * _WORD[j]
    whole = mix64(whole)
    out = []
    for i, j in zip(o[:-1].tolist(), o[1:].tolist(), strict=True):
        if j - i >= n:
            out.append(distinct(whole[i : j - n + 1]))
        elif j > i:
            few = sum((w[i + k] * _WORD[k] for k in range(j - i)), np.uint64(j - i))
            out.append(mix64(np.array([few], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _each(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """(rows, sets) by steps of a stream whose last column is the text."""
    with np.errstate(over="ignore"):
        for batch in batches:
            b, o = flat_text(batch.column(batch.num_columns - 1))
            for i, j in steps(o):
                yield batch.slice(i, j - i), shingle_sets(b[o[i] : o[j]], o[i : j + 1] - o[i], n)


def node_ids(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each set; 0 for empty ones."""
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    out = np.zeros((2, len(sets)), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        flat = np.concatenate(sets)
        out[0, full] = np.add.reduceat(mix64(flat ^ np.uint64(0xA5A5A5A5)), at[full])
        out[1, full] = np.bitwise_xor.reduceat(mix64(flat + np.uint64(77)), at[full])
    return out[0].view(np.int64), out[1].view(np.int64)


def parity_maps(sets: list[np.ndarray]) -> pa.Array:
    """For each set a map of 2**k bits, at least as many as n-grams within bounds; each n-gram flips one bit."""
    n = np.array([len(s) for s in sets], np.int64)
    bits = np.left_shift(1, np.clip(np.ceil(np.log2(np.maximum(n, 1))), LEAST_MAP, MOST_MAP).astype(np.int64))
    start = np.concatenate([[0], np.cumsum(bits)])
    at = (np.concatenate(sets) >> np.uint64(17)).astype(np.int64) & np.repeat(bits - 1, n) if n.sum() else np.zeros(0, np.int64)
    odd = np.bincount(at + np.repeat(start[:-1], n), minlength=start[-1]) & 1
    return packed(np.packbits(odd.astype(np.uint8), bitorder="little"), bits // 8)


SKETCHED = "doc_id long, uid long, n long, node long, node2 long, map binary, block int, counts binary"
SKETCHED_NAMES = [x.split()[0] for x in SKETCHED.split(", ")]


def _count(total: np.ndarray, held: list[np.ndarray]) -> None:
    """Count into one-byte counters that stay at 255; a task's share is all that it has to tell."""
    at, times = np.unique(np.concatenate(held), return_counts=True)
    total[at] = np.minimum(total[at] + np.minimum(times, 255).astype(np.uint16), 255)


def _sketch(n: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << bits, np.uint8)
        held, size = [], 0
        for rows, sets in _each(batches, n):
            k = len(sets)
            one, two = node_ids(sets)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(one), pa.array(two), parity_maps(sets), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], SKETCHED_NAMES)
            for s in sets:
                held.append((s & np.uint64((1 << bits) - 1)).astype(np.int64))
                size += len(s)
            if size > 1 << 20:
                _count(total, held)
                held, size = [], 0
        if held:
            _count(total, held)
        if total.any():
            # a task has counted few of the counters up, so that their bytes follow its n-grams rather than their number
            part = [pa.compress(x.tobytes(), "zstd", asbytes=True) for x in total.reshape(SKETCH_BLOCKS, -1)]
            empty = pa.nulls(SKETCH_BLOCKS, pa.int64())
            yield pa.RecordBatch.from_arrays([empty] * 5 + [pa.nulls(SKETCH_BLOCKS, pa.binary()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(part, pa.binary())], SKETCHED_NAMES)

    return run


def _sum_blocks(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block not in sums:
                    sums[block] = np.zeros(width, np.uint32)
                sums[block] += np.frombuffer(pa.decompress(x.as_buffer(), width, "zstd"), np.uint8)
        quick = lambda x: (4 * np.log2(1 + x.astype(np.float32))).astype(np.uint8).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([quick(x) for x in sums.values()], pa.binary())], ["block", "rank"])

    return run


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """First columns of a row of n, one of which any similar row must share."""
    return n - -(-n * percent // 100) + 1


def _incidence(n: int, percent: int, rank, blocks: int):
    """Entries of the first columns of each row: by block of columns, (gram, node, size and place) as bytes."""

    def flush(held: list[np.ndarray], nodes: list[np.ndarray], facts: list[np.ndarray]) -> pa.RecordBatch:
        g, d, x = (np.concatenate(c) for c in (held, nodes, facts))
        block = (g >> np.uint64(32)).astype(np.int64) % blocks
        order = np.lexsort((g, block))
        g, d, x, block = g[order], d[order], x[order], block[order]
        at = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        return pa.RecordBatch.from_arrays([pa.array(block[at], pa.int32()), packed(np.stack([g, d, x], 1).ravel(), 3 * np.diff(np.append(at, len(g))))], ["block", "entries"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = np.frombuffer(rank.value, np.uint8)
        low = np.uint64(len(order) - 1)
        held, nodes, facts, size, seen = [], [], [], 0, set()
        for _, sets in _each(batches, n):
            for s, node in zip(sets, node_ids(sets)[0].tolist(), strict=True):
                if not len(s) or node in seen:
                    continue
                seen.add(node)
                total, k = len(s), prefix_length(len(s), percent)
                first = (order[(s & low).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
                if k < total:
                    pick = np.argpartition(first, k - 1)[:k]
                    s, first = s[pick], first[pick]
                held.append(s[np.argsort(first)])
                nodes.append(np.full(k, node, np.int64).view(np.uint64))
                facts.append(np.uint64(total << 32) | np.arange(k, dtype=np.uint64))
                size += k
            if size > 1 << 18:
                yield flush(held, nodes, facts)
                held, nodes, facts, size, seen = [], [], [], 0, set()
        if held:
            yield flush(held, nodes, facts)

    return run


COLUMNS, COLUMNS_NAMES = "rows long, rows2 long, first int, gram long, entries binary", ["rows", "rows2", "first", "gram", "entries"]
ENTRIES = "gram long, node long, n int, place int"
#: Entries of a column that are sent in one row.
CHUNK = 1 << 14


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of blocks that arrive in order, the columns that have two rows at least: two hashes of their rows, the place in the least of these, and the entries."""

    def of(parts: list[bytes]) -> pa.RecordBatch:
        x = np.frombuffer(b"".join(parts), np.uint64).reshape(-1, 3)
        x = x[np.lexsort((x[:, 1], x[:, 0]))]
        same = np.concatenate([[False], (x[1:, :2] == x[:-1, :2]).all(axis=1)])
        x = x[~same]
        next_ = np.concatenate([x[1:, 0] == x[:-1, 0], [False]])
        x = x[next_ | np.concatenate([[False], next_[:-1]])]
        begin = np.flatnonzero(np.concatenate([[True], x[1:, 0] != x[:-1, 0]])) if len(x) else np.zeros(0, np.int64)
        size = np.diff(np.append(begin, len(x)))
        one, two = (np.add.reduceat(mix64(x[:, 1] ^ np.uint64(salt)), begin) if len(x) else np.zeros(0, np.uint64) for salt in (0xC3C3C3C3, 0x5A5A5A5A5A))
        times = -(-size // CHUNK)
        at = np.repeat(begin, times) + CHUNK * (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        first = (x[begin, 2] & np.uint64(0xFFFFFFFF)).astype(np.int32)
        whole = (one.view(np.int64), two.view(np.int64), first, x[begin, 0].astype(np.int64))
        return pa.RecordBatch.from_arrays([*(pa.array(np.repeat(c, times)) for c in whole), packed(np.ascontiguousarray(x[:, 1:]).ravel(), 2 * np.diff(np.append(at, len(x))))], COLUMNS_NAMES)

    now, parts = None, []
    with np.errstate(over="ignore"):
        for batch in batches:
            for block, entries in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block != now and parts:
                    yield of(parts)
                    parts = []
                now = block
                parts.append(entries)
        if parts:
            yield of(parts)


def _apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of columns that arrive in order, less those of columns with the rows of one before.

    Columns stand in one order in all rows, so the first of those with equal
    rows has the least place in each, and whatever pair a later one shows to be
    possible, it shows too.
    """
    rows, kept = None, None
    for batch in batches:
        keys, gram = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True), batch.column(3).to_pylist()
        stays = []
        for r, (key, g) in enumerate(zip(keys, gram, strict=True)):
            if key != rows:
                rows, kept = key, g
            if g == kept:
                stays.append(r)
        t = batch.take(pa.array(stays, pa.int64()))
        flat, n = lists(t.column(4), np.uint64)
        x = flat.reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(t.column(3)), n // 2)), pa.array(x[:, 0].astype(np.int64)), pa.array((x[:, 1] >> np.uint64(32)).astype(np.int32)), pa.array((x[:, 1] & np.uint64(0xFFFFFFFF)).astype(np.int32))], ["gram", "node", "n", "place"])


# the product of a block


class _Maps:
    """Parity maps of many rows; those of a pair are compared at the smaller of their sizes."""

    def __init__(self, column) -> None:
        words_, n = lists(column, np.uint64)
        self.level = np.log2(n).astype(np.int64)
        start = np.cumsum(n) - n
        self.row, self.folded = {}, {}
        above, rows_above = np.zeros((0, 2 << (MOST_MAP - 6)), np.uint64), np.zeros(0, np.int64)
        for k in range(MOST_MAP - 6, -1, -1):
            half = 1 << k
            own = np.flatnonzero(self.level == k)
            mine = words_[(start[own][:, None] + np.arange(half)).ravel()].reshape(-1, half)
            above = np.concatenate([above[:, :half] ^ above[:, half:], mine])
            rows_above = np.concatenate([rows_above, own])
            self.folded[k] = above
            self.row[k] = np.full(len(n), -1, np.int32)
            self.row[k][rows_above] = np.arange(len(rows_above))

    def differ(self, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Bits in which the maps of rows p and q differ: no more than the n-grams in which the sets do."""
        out = np.zeros(len(p), np.int64)
        level = np.minimum(self.level[p], self.level[q])
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            m, row = self.folded[k], self.row[k]
            for i in range(0, len(at), CELLS >> k):
                part = at[i : i + (CELLS >> k)]
                out[part] = np.bitwise_count(m[row[p[part]]] ^ m[row[q[part]]]).sum(1)
        return out


#: Marks of the copies of a large column's two pivots, which go to all its parts.
FIRST, SECOND = -1, -2


def _product(percent: int, pivots: int | None):
    """Pairs of rows of columns that may be similar, from (key, part, node, n, place, c, map) in order of key.

    pivots: the turn, if rows are compared with the pivots of their column only; else all pairs are.
    Rows of part FIRST and SECOND are copies of the pivots of a column that is dealt out in parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for t in whole_groups(batches, 30_000):
                key, part, node, n, place, c = (np.asarray(t.column(i)) for i in range(6))
                n, room = n.astype(np.int32), (n - place).astype(np.int32)
                maps = _Maps(t.column(6))
                found: list[tuple[np.ndarray, np.ndarray]] = []

                def weigh(p: np.ndarray, q: np.ndarray) -> None:
                    need = -((n[p] + n[q]) * percent // -(100 + percent))
                    ok = (c[p] != c[q]) & (np.minimum(room[p], room[q]) >= need)
                    p, q, need = p[ok], q[ok], need[ok]
                    ok = maps.differ(p, q) <= n[p] + n[q] - 2 * need
                    found.append((p[ok], q[ok]))

                begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                size = np.diff(np.append(begin, len(key)))
                group = np.repeat(np.arange(len(begin)), size)
                if pivots is not None:
                    lot = mix64(node.astype(np.uint64) ^ np.uint64(pivots + 1))
                    everyone = np.flatnonzero(part >= 0)
                    for order in (np.lexsort((lot, place - n, place, part != FIRST, group)), np.lexsort((lot, part != SECOND, group))):
                        weigh(everyone, order[begin][group[everyone]])
                else:
                    few = np.flatnonzero((size <= FEW)[group])
                    for i in range(0, len(few), 1 << 14):
                        p = few[i : i + (1 << 14)]
                        m = (begin + size)[group[p]] - p - 1
                        q = np.repeat(p + 1 - (np.cumsum(m) - m), m) + np.arange(m.sum())
                        weigh(np.repeat(p, m), q)
                    for g in np.flatnonzero(size > FEW):
                        _, of, m = np.unique(c[begin[g] : begin[g] + size[g]], return_inverse=True, return_counts=True)
                        minor, parts_ = of != m.argmax(), part[begin[g] : begin[g] + size[g]]
                        across = parts_.min() != parts_.max()
                        a = np.flatnonzero(minor)
                        for i in range(0, len(a), max(1, CELLS // size[g])):
                            x, y = np.nonzero(_possible(n, room, c, begin[g] + a[i : i + max(1, CELLS // size[g])], begin[g], size[g], percent))
                            x = a[i + x]
                            # a pair of two of the minor is seen from both sides
                            ok = (~minor[y] | (x < y)) & ((parts_[x] != parts_[y]) | (not across))
                            weigh(begin[g] + x[ok], begin[g] + y[ok])
                p, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
                a, b = node[p], node[q]
                if pivots is None:
                    a, b = distinct_pairs(np.minimum(a, b), np.maximum(a, b))
                    times = np.ones(len(a), np.int64)
                else:
                    order = np.lexsort((b, a))
                    a, b = a[order], b[order]
                    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
                    a, b, times = a[first], b[first], np.diff(np.append(first, len(order)))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(times)], ["a", "b", "times"])

    return run


def _possible(n: np.ndarray, room: np.ndarray, c: np.ndarray, rows: np.ndarray, begin: int, size: int, percent: int) -> np.ndarray:
    """Matrix of rows by all rows of a column: in different components, and with room for the overlap they need."""
    all_ = slice(begin, begin + size)
    need = -((n[rows][:, None] + n[all_]) * percent // -(100 + percent))
    return (np.minimum(room[rows][:, None], room[all_]) >= need) & (c[rows][:, None] != c[all_])


# exact overlaps


def _whole_sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _each(batches, n):
            yield pa.RecordBatch.from_arrays([pa.array(node_ids(sets)[0]), packed(np.concatenate(sets), np.array([len(s) for s in sets]))], ["node", "grams"])

    return run


def _overlaps(percent: int):
    """Pairs (a, b) that reach the threshold, from rows in which the set of b comes before those of its partners a."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = None, None
        for batch in batches:
            b, kind, node = (np.asarray(batch.column(i)) for i in (0, 2, 3))
            flat, size = lists(batch.column(4), np.uint64)
            ends, keep = np.cumsum(size), np.zeros(len(b), bool)
            for r in range(len(b)):
                s = flat[ends[r] - size[r] : ends[r]]
                if kind[r] == 0:
                    held, of = s.copy(), b[r]
                elif of == b[r]:
                    at = np.searchsorted(held, s)
                    at[at == len(held)] = 0
                    common = int((held[at] == s).sum())
                    keep[r] = 100 * common >= percent * (len(held) + len(s) - common)
                else:
                    raise ValueError("a set is missing")
            mask = pa.array(keep)
            yield pa.RecordBatch.from_arrays([batch.column(3).filter(mask), batch.column(0).filter(mask)], ["a", "b"])

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, component) of the ids in edges (a, b), the component being its least id: alternating large and small stars."""
    spark = edges.sparkSession
    state, stamp, i = edges.filter("a <> b"), None, 0
    files = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8)  # links are few beside documents
    while True:
        both = state.select("a", "b").union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        down = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = down.groupBy("a").agg(F.min("b").alias("m"))
        star = down.join(small, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(small.select("a", F.col("m").alias("b"))).distinct()
        state = scratch.cut(star.coalesce(files), f"{name}-{i}")
        if i:
            scratch.drop(f"{name}-{i - 1}")
        now = state.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == stamp:
            break
        stamp, i = now, i + 1
    return state.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def grouped(docs: DataFrame, scratch: Scratch, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, uid (hash of the text), n, node, node2 and c of each row of docs (doc_id, text).

    c is the component, null for rows without n-grams.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")).alias("uid"), F.col("text").cast("string"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    files = max(8, parts // 8)
    grams = (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6
    bits = min(MOST_BITS, max(LEAST_BITS, (grams // GRAMS_PER_COUNTER).bit_length()))
    first = scratch.cut(docs.mapInArrow(tidy(_sketch(n, bits)), SKETCHED), "rows")
    order = bytearray(1 << bits)
    width = len(order) // SKETCH_BLOCKS
    counted = first.filter("block is not null").select("block", "counts").repartition(min(SKETCH_BLOCKS, parts), "block").mapInArrow(_sum_blocks(width), "block int, rank binary").collect()
    for r in counted:
        order[r["block"] * width : (r["block"] + 1) * width] = r["rank"]
    rows = first.filter("block is null")

    rank = spark.sparkContext.broadcast(bytes(order))
    entries = docs.select("text").mapInArrow(tidy(_incidence(n, percent, rank, 4 * parts)), "block int, entries binary")
    columns = entries.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(tidy(_shared), COLUMNS)
    # near copies share most of their columns: of columns with the same rows the first says all
    apart = columns.repartition(parts, "rows", "rows2").sortWithinPartitions("rows", "rows2", "first", "gram")
    shared = scratch.cut(apart.mapInArrow(_apart, ENTRIES), "entries")
    # one document of each row that is left, by which its set can be read again, and the row's parity map
    wanted = rows.join(shared.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "uid", "map")
    wanted = scratch.cut(wanted.dropDuplicates(["node"]), "wanted")
    size = shared.count()
    at = shared.withColumn("c", F.col("node"))

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """The pairs whose whole sets reach the threshold. Only documents of these pairs are read again; b's set is sent once for TAILS of its partners."""
        pairs = scratch.cut(pairs.select("a", "b"), f"{name}-pairs")
        ids = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ids = scratch.cut(ids.join(wanted, "node").select(F.col("doc_id").alias("i"), F.col("uid").alias("u")), f"{name}-ids")
        few = ids.count() <= BROADCAST_IDS
        texts = docs.join(F.broadcast(ids) if few else ids, (docs["uid"] == ids["u"]) & _same(docs["doc_id"], ids["i"]), "left_semi").select("text")
        sets = scratch.cut(texts.mapInArrow(tidy(_whole_sets(n)), "node long, grams binary"), f"{name}-sets")
        copies = pairs.groupBy("b").agg(F.ceil(F.count("*") / TAILS).cast("int").alias("k"))
        heads = copies.select("b", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("part"), F.lit(0).alias("kind"), F.col("b").alias("node"))
        tails = pairs.join(copies, "b").select("b", F.pmod(F.xxhash64("a"), F.col("k")).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("a").alias("node"))
        sent = heads.union(tails).join(sets.hint("merge"), "node").select("b", "part", "kind", "node", "grams")
        sent = sent.repartition(parts, "b", "part").sortWithinPartitions("b", "part", "kind")
        out = scratch.cut(sent.mapInArrow(tidy(_overlaps(percent)), "a long, b long").coalesce(files), name)
        scratch.drop(f"{name}-pairs", f"{name}-ids", f"{name}-sets")
        return out

    def product(pivots: int | None) -> DataFrame:
        # maps are many times as wide as entries, so they are joined only to be sent to the product
        wide = at.join(wanted.select("node", "map"), "node")
        keyed = wide.select(F.col("gram").alias("key"), F.lit(0).alias("part"), "node", "n", "place", "c", "map")
        large = at.groupBy("gram").count().filter(F.col("count") > PART).select("gram", F.ceil(F.col("count") / PART).cast("int").alias("k"))
        if not large.isEmpty():
            large = scratch.cut(large, f"large-{pivots}")
            columns = ("node", "n", "place", "c", "map")
            mine = wide.join(large, "gram").withColumn("part", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
            if pivots is None:
                # parts of a large column meet in pairs
                split = mine.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
                split = split.select(F.xxhash64("gram", F.least("part", "other"), F.greatest("part", "other")).alias("key"), "part", *columns)
            else:
                # each part meets the pivots of the whole column
                lot, row = F.xxhash64("node", F.lit(pivots)), F.struct(*columns)
                picked = mine.groupBy("gram", "k").agg(F.min_by(row, F.struct("place", F.col("place") - F.col("n"), lot)).alias("first"), F.min_by(row, lot).alias("second"))
                sent = picked.select("gram", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("at"), F.array(F.struct(F.lit(FIRST).alias("part"), F.col("first").alias("row")), F.struct(F.lit(SECOND).alias("part"), F.col("second").alias("row"))).alias("pivots"))
                copies = sent.select("gram", "at", F.explode("pivots").alias("p")).select(F.xxhash64("gram", "at").alias("key"), "p.part", *(f"p.row.{c}" for c in columns))
                split = mine.select(F.xxhash64("gram", "part").alias("key"), F.lit(0).alias("part"), *columns).union(copies)
            keyed = wide.join(large, "gram", "left_anti").select(F.col("gram").alias("key"), F.lit(0).alias("part"), *columns).union(split)
        return keyed.repartition(parts, "key").sortWithinPartitions("key").mapInArrow(tidy(_product(percent, pivots)), "a long, b long, times long")

    found, before, turn = None, math.inf, 0
    while size:
        tries = product(turn).groupBy("a", "b").agg(F.sum("times").alias("times"))
        best = tries.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("times", "b")), asc=False), 1, TRIES).alias("x")).select("a", F.explode("x.b").alias("b"))
        new = verified(best, f"pivot-{turn}")
        found = new if found is None else found.union(new)
        labels = components(found, scratch, f"labels-{turn}")
        named = at.drop("c").join(labels, at["node"] == labels["id"], "left").withColumn("c", F.coalesce("component", "node")).drop("id", "component")
        open_ = named.groupBy("gram", "c").count().groupBy("gram").agg(F.count("*").alias("k"), F.sum("count").alias("m"), F.sum(F.col("count") * F.col("count")).alias("mm")).filter("k > 1")
        open_ = scratch.cut(open_.select("gram", ((F.col("m") * F.col("m") - F.col("mm")) / 2).alias("pairs")), f"open-{turn}")
        left = open_.agg(F.sum("pairs")).first()[0] or 0
        at = scratch.cut(named.join(open_.select("gram"), "gram", "left_semi").select("gram", "node", "n", "place", "c"), f"at-{turn}")
        scratch.drop(f"at-{turn - 1}" if turn else "entries", f"open-{turn}")
        turn += 1
        if turn == PIVOT_ROUNDS or left <= PAIRS_PER_ENTRY * size or left > WORTH * before:
            break
        before = left
    if found is None:
        return rows.select("doc_id", "uid", "n", "node", "node2", F.when(F.col("n") > 0, F.col("node")).alias("c"))
    # all pairs of rows that share a column, across components
    new = verified(product(None).select("a", "b").distinct(), "rest")
    labels = components(found.union(new), scratch, "labels")
    named = rows.select("doc_id", "uid", "n", "node", "node2").join(labels, rows["node"] == labels["id"], "left")
    return named.withColumn("c", F.when(F.col("n") > 0, F.coalesce("component", "node"))).drop("id", "component")


def link(docs: DataFrame, *, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of docs (doc_id, text): components of pairs whose Jaccard reaches percent."""
    scratch = Scratch(docs.sparkSession, "ngrams")
    rows = scratch.cut(grouped(docs, scratch, n=n, percent=percent).select("doc_id", "n", "c"), "grouped")
    # components of one row need no join
    named = rows.filter("c is not null").groupBy("c").agg(F.min("doc_id").alias("least"), F.count("*").alias("m")).filter("m > 1").select("c", "least")
    out = rows.join(named, "c", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs, with all their columns, less all rows but one of each component: that of the least id, then of the least hash of the text.

    Rows without an id come after all others; of equal rows one stays.
    """
    scratch = Scratch(docs.sparkSession, "kept")
    rows = scratch.cut(grouped(docs.select("doc_id", "text"), scratch, **options).filter("c is not null").select("c", "doc_id", "uid"), "grouped")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("i"), F.col("uid").alias("u"))
    kept = rows.groupBy("c").agg(F.min(rank).alias("k"), F.count("*").alias("m")).filter("m > 1").select("c", "k.i", "k.u")
    members = scratch.cut(rows.join(kept, "c"), "members")
    stays = _same(F.col("doc_id"), F.col("i")) & (F.col("uid") == F.col("u"))
    gone = members.filter(~stays).select(F.col("doc_id").alias("i"), F.col("uid").alias("u")).distinct()
    again = members.filter(stays).groupBy("i", "u").count().filter("count > 1").select("i", "u")
    few = lambda df: F.broadcast(df) if df.count() <= BROADCAST_IDS else df
    keyed = docs.withColumn("__uid", F.xxhash64(F.col("text").cast("string")))
    on = lambda x: (keyed["__uid"] == x["u"]) & _same(keyed["doc_id"].cast("long"), x["i"])
    left = keyed.join(few(gone), on(gone), "left_anti")
    if again.isEmpty():
        return left.select(docs.columns)
    again = scratch.cut(again, "again")
    twice = left.join(few(again), on(again), "left_semi").dropDuplicates(["doc_id", "__uid"])
    return left.join(few(again), on(again), "left_anti").union(twice).select(docs.columns)


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return link(table(spark, sf_dir, "documents").select("doc_id", "text"))
