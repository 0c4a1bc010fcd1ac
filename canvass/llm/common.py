"""Helpers that the operators of this subpackage share.

Shared scratch space, Arrow text batches as flat byte arrays, and vectorised
hashing of bytes, words and spans.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.session import shared_dir

#: Bytes of text that one vectorised step works on; longer texts form a step of their own.
STEP_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Tables and files of one run of an operator, in the shared folder.

    A written table cuts the lineage: after the loss of an executor it is
    read again rather than computed again.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.base = f"{shared_dir(spark)}/canvass/{label}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        """Write df as a table and read it back."""
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            p = jvm.org.apache.hadoop.fs.Path(self.path(name))
            p.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(p, True)


#: Names that Hadoop's clients have for stores that Arrow knows by others.
SCHEMES = {"s3a": "s3", "s3n": "s3", "abfss": "abfs", "wasbs": "abfs"}


def open_fs(uri: str):
    """(file system, path) of a URI, on the driver or in a task."""
    from pyarrow import fs

    if "://" not in uri:
        return fs.LocalFileSystem(), uri.removeprefix("file:")
    scheme, rest = uri.split("://", 1)
    return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")


def write_file(uri: str, write) -> None:
    """Write a file under a name of this attempt, then move it: a repeated task replaces its own file."""
    fs, path = open_fs(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    attempt = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    try:
        with fs.open_output_stream(attempt) as out:
            write(out)
        fs.move(attempt, path)
    except BaseException:
        if fs.get_file_info(attempt).type.name != "NotFound":
            fs.delete_file(attempt)
        raise


def _trim():
    """The C library's call that returns freed memory, where it has one."""
    import ctypes

    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system: a worker that waits for its next task would keep it beside the others."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def tidy(run):
    """A function of Arrow batches that gives back what it freed when a task ends."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def flat_text(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()[:3]
    n = len(column)
    if n == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    b = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if column.null_count:
        gone = np.diff(o) * np.asarray(column.is_null())
        if gone.any():  # a null with bytes below it
            return flat_text(column.fill_null(b"" if pa.types.is_binary(column.type) else ""))
    return b[o[0] : o[-1]], o - o[0]


def steps(offsets: np.ndarray, limit: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about `limit` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 20_000) -> Iterator[pa.Table]:
    """The stream, sorted by its first column, in tables that hold all rows of their keys."""
    held, n = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = np.asarray(b.column(0))
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut or (held and np.asarray(held[-1].column(0))[-1] != keys[0]):
            if cut:
                held.append(b.slice(0, cut))
                n += cut
            if n >= least:
                yield pa.Table.from_batches(held).combine_chunks()
                held, n = [], 0
        held.append(b.slice(cut))
        n += b.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def lists(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """(values, number in each row) of a binary column of packed values."""
    b, o = flat_text(column)
    return np.frombuffer(b.tobytes(), kind), np.diff(o) // np.dtype(kind).itemsize


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """A binary column, row r holding the next counts[r] values."""
    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32) * values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for many small arrays far cheaper than a hash table of each."""
    x = np.sort(x)
    keep = np.ones(len(x), bool)
    np.not_equal(x[1:], x[:-1], out=keep[1:])
    return x[keep]


def distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs, in order of a and b."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    keep = np.ones(len(a), bool)
    keep[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[keep], b[keep]


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class BytesHash:
    """64-bit hashes of byte strings: eight bytes at a time, each step a bijection of the state; strings up to eight bytes of one length never collide."""

    #: Longer strings go through BLAKE2b.
    LONG = 256

    def __init__(self, seed: int) -> None:
        self.seed, self.of_size, self.of_piece = (np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(seed).integers(1 << 40, 1 << 62, 3))

    def of(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of b[start : end] for each."""
        size = end - start
        pieces = _pieces(b)
        h = mix64(size.astype(np.uint64) * self.of_size + self.seed)
        h = mix64(h ^ ((pieces[start] & _MASKS[np.minimum(size, 8)]) * self.of_piece))
        at, done = np.flatnonzero((size > 8) & (size <= self.LONG)), 8
        while len(at):
            h[at] = mix64(h[at] ^ ((pieces[start[at] + done] & _MASKS[np.minimum(size[at] - done, 8)]) * self.of_piece))
            done += 8
            at = at[size[at] > done]
        for i in np.flatnonzero(size > self.LONG).tolist():
            h[i] = int.from_bytes(hashlib.blake2b(b[start[i] : end[i]], digest_size=8, salt=int(self.seed).to_bytes(16, "little")).digest(), "little")
        return h


#: Masks of the first 0 to 8 bytes of a little-endian word.
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def _pieces(b: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as numbers; zeros follow the end."""
    padded = np.zeros(len(b) + 8, np.uint8)
    padded[: len(b)] = b
    return np.ndarray(len(b) + 1, "<u8", padded, strides=(1,))


def grown(x: np.ndarray) -> np.ndarray:
    """Twice as long, zeros after what is there; these take no memory before they are written."""
    out = np.zeros((2 * len(x), *x.shape[1:]), x.dtype)
    out[: len(x)] = x
    return out


class SpanTable:
    """Numbers of the byte strings seen so far, found by hash and compared by their bytes."""

    def __init__(self, seed: int, slots: int) -> None:
        self.hash, self.slots = BytesHash(seed), slots
        self.keys, self.codes = np.zeros(1 << slots, np.uint64), np.zeros(1 << slots, np.int32)
        self.clear()

    def clear(self) -> None:
        self.keys[:] = 0
        self.n = 0
        self.at, self.bytes = np.zeros(1 << 12, np.int64), np.zeros(1 << 16, np.uint8)

    @property
    def held(self) -> int:
        """Bytes of the strings held."""
        return int(self.at[self.n])

    def hashes(self, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return np.maximum(self.hash.of(b, start, end), np.uint64(1))  # 0 marks a free slot

    def _same(self, code: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        own = self.at[code]
        ok = self.at[code + 1] - own == size
        mine, theirs = np.ndarray(len(self.bytes) - 7, "<u8", self.bytes, strides=(1,)), _pieces(b)
        at, done = np.flatnonzero(ok & (size <= BytesHash.LONG)), 0
        while len(at):
            mask = _MASKS[np.minimum(size[at] - done, 8)]
            good = (mine[own[at] + done] & mask) == (theirs[start[at] + done] & mask)
            ok[at[~good]] = False
            done += 8
            at = at[good & (size[at] > done)]
        for i in np.flatnonzero(ok & (size > BytesHash.LONG)).tolist():
            ok[i] = np.array_equal(self.bytes[own[i] : own[i] + size[i]], b[start[i] : start[i] + size[i]])
        return ok

    def find(self, h: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each string, -1 where it is new."""
        out, left = np.full(len(h), -1, np.int32), np.arange(len(h))
        slot = (h >> np.uint64(64 - self.slots)).astype(np.int64)
        while len(left):
            there = self.keys[slot]
            hit = there == h[left]
            which = np.flatnonzero(hit)
            code = self.codes[slot[which]]
            hit[which] = self._same(code, b, start[left[which]], (end - start)[left[which]])
            out[left[which]] = np.where(hit[which], code, -1)
            go = ~hit & (there != 0)
            left, slot = left[go], (slot[go] + 1) & ((1 << self.slots) - 1)
        return out

    def add(self, h: np.ndarray, strings: list[bytes]) -> None:
        """Number strings that are not held, of distinct hashes."""
        body = np.frombuffer(b"".join(strings), np.uint8)
        ends = self.held + np.cumsum([len(x) for x in strings])
        while len(self.at) < self.n + len(strings) + 1:
            self.at = grown(self.at)
        while len(self.bytes) < ends[-1] + 8:
            self.bytes = grown(self.bytes)
        self.bytes[self.held : ends[-1]] = body
        self.at[self.n + 1 : self.n + 1 + len(strings)] = ends
        code, left = np.arange(self.n, self.n + len(strings), dtype=np.int32), np.arange(len(strings))
        slot = (h >> np.uint64(64 - self.slots)).astype(np.int64)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            mine = free & (self.keys[slot] == h[left])
            self.codes[slot[mine]] = code[left[mine]]
            left, slot = left[~mine], (slot[~mine] + 1) & ((1 << self.slots) - 1)
        self.n += len(strings)


class SpanHash:
    """Fingerprints of byte spans from prefix sums: equal spans have equal values wherever they stand."""

    def __init__(self, seed: int) -> None:
        rng = np.random.default_rng(seed)
        self.of_byte = rng.integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
        self.base = (int(rng.integers(1 << 40, 1 << 62)) * 8 + 5) % (1 << 64)
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up), STEP_BYTES)
            with np.errstate(over="ignore"):
                self.up, self.down = (np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))]) for x in (self.base, self.inverse))

    def prefix(self, b: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array, one longer than it."""
        self._grow(len(b) + 1)
        p = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(self.of_byte[b] * self.up[: len(b)], out=p[1:])
        return p

    def span(self, p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((p[end] - p[start]) * self.down[start])


#: Space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def labelled(docs: DataFrame, labels: DataFrame, column: str, fold: int, held_out: int, most: int) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled documents outside the held-out fold, the least by a hash of their ids.

    Only ids are ordered, and their number is bounded by `most`, so they are broadcast to the scan of the texts.
    """
    learn = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & (fold_of("doc_id", fold) != held_out))
    ids = learn.groupBy("doc_id").agg(F.max(column).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def fold_of(key: str, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds


def words(b: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, words of each row as offsets) of the runs of bytes not in `outside`; no word crosses a row."""
    inside = np.zeros(len(b) + 1, bool)
    inside[:-1] = ~outside[b]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    last = inside[:-1] & ~inside[1:]
    if len(b):
        cut = offsets[:-1][np.diff(offsets) > 0]
        first[cut] = inside[cut]
        cut = offsets[1:][np.diff(offsets) > 0] - 1
        last[cut] = inside[cut]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, offsets)
