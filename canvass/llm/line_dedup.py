"""Lines that stand in many documents, dropped.

Every line has a key: the line without white space at its ends, A-Z in lower
case. A task hashes the keys of a batch of texts at once (128 bits) and sends
each key of the batch once, with the number of documents that hold it; Spark
adds these up. Keys in at least `min_docs` documents are common.

A second scan of the texts drops their lines and joins the rest in order. Its
tasks get the common keys, if these are at most MOST; texts are then never
shuffled. Beyond that they get the keys so frequent that there can't be more
than MOST of them, and lines of the other common keys are found by a join of
hashes and places, in which no key is hot any more.

Defined cases: a row is a document, so a repeated row counts again and null ids
are kept; a null or empty text has one empty line; keys under `min_chars` code
points are never common; a carriage return at the end of a line is white space
of the key, but stays in a line that is kept; if all lines go the text is
empty; an empty table gives no rows; other columns travel in `row`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import LOWER, SPACES, BytesHash, Scratch, flat_text, lists, steps, table

#: Common keys that each task may hold: 16 bytes each.
MOST = 1_000_000
HASHES = (BytesHash(131), BytesHash(132))
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


class Lines:
    """The lines of some texts: whose they are, where they stand, and the hash of their keys."""

    def __init__(self, b: np.ndarray, offsets: np.ndarray, min_chars: int) -> None:
        at = np.flatnonzero(b == 10)
        # a text of n breaks has n + 1 lines
        breaks = np.searchsorted(at, offsets)
        self.n = np.diff(breaks) + 1
        self.first = np.concatenate([[0], np.cumsum(self.n)])
        self.row = np.repeat(np.arange(len(self.n)), self.n)
        last = self.first[1:] - 1
        self.end = np.zeros(len(self.row), np.int64)
        inner = np.ones(len(self.row), bool)
        inner[last] = False
        self.end[inner], self.end[last] = at, offsets[1:]
        self.start = np.zeros(len(self.row), np.int64)
        self.start[1:] = self.end[:-1] + 1
        self.start[self.first[:-1]] = offsets[:-1]
        # first and last byte of a line that is no white space
        solid = np.flatnonzero(~SPACES[b])
        i, j = np.searchsorted(solid, self.start), np.searchsorted(solid, self.end)
        some = i < j
        lo, hi = self.start.copy(), self.start.copy()
        lo[some], hi[some] = solid[i[some]], solid[j[some] - 1] + 1
        points = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])
        self.counts = points[hi] - points[lo] >= max(1, min_chars)
        if min_chars < 1:
            self.counts[:] = True
        low = LOWER[b]
        self.key = np.empty(len(lo), KEY)
        for name, h in zip(KEY.names, HASHES, strict=True):
            self.key[name] = h.of(low, lo, hi)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """(distinct keys that count, texts that hold them)."""
        key, row = self.key[self.counts], self.row[self.counts]
        order = np.lexsort((row, key["b"], key["a"]))
        key, row = key[order], row[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        once = new.copy()
        once[1:] |= row[1:] != row[:-1]
        return key[new], np.add.reduceat(once.astype(np.int64), np.flatnonzero(new)) if len(key) else np.zeros(0, np.int64)


class Known:
    """A set of keys."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        order = np.lexsort((b, a))
        self.a, self.b = a[order], b[order]

    def has(self, key: np.ndarray) -> np.ndarray:
        at, out = np.searchsorted(self.a, key["a"]), np.zeros(len(key), bool)
        left = np.flatnonzero(at < len(self.a))
        while len(left):  # keys of equal first halves follow each other
            left = left[self.a[at[left]] == key["a"][left]]
            hit = self.b[at[left]] == key["b"][left]
            out[left[hit]] = True
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < len(self.a)]
        return out


def _counted(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, o = flat_text(batch.column(0))
            for i, j in steps(o):
                key, n = Lines(b[o[i] : o[j]], o[i : j + 1] - o[i], min_chars).keys()
                yield pa.RecordBatch.from_arrays([pa.array(key["a"].view(np.int64)), pa.array(key["b"].view(np.int64)), pa.array(n)], ["a", "b", "n"])

    return run


def _places(min_chars: int, known: Known):
    """Lines that the known keys don't settle: uid, place, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, o = flat_text(batch.column(1))
            for i, j in steps(o):
                t = Lines(b[o[i] : o[j]], o[i : j + 1] - o[i], min_chars)
                at = np.flatnonzero(t.counts & ~known.has(t.key))
                place = at - t.first[t.row[at]]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(t.row[at] + i)), pa.array(place.astype(np.int32)), pa.array(t.key["a"][at].view(np.int64)), pa.array(t.key["b"][at].view(np.int64))], ["uid", "place", "a", "b"])

    return run


def _kept(min_chars: int, known: Known, places: bool):
    """(row, text[, packed places]) to what is left of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, o = flat_text(batch.column(1))
            for i, j in steps(o):
                own, off = b[o[i] : o[j]], o[i : j + 1] - o[i]
                t = Lines(own, off, min_chars)
                gone = t.counts & known.has(t.key)
                if places:
                    at, n = lists(batch.column(2).slice(i, j - i), np.int32)
                    gone[at + np.repeat(t.first[:-1], n)] = True
                dropped = np.add.reduceat(gone.astype(np.int64), t.first[:-1]) if j > i else np.zeros(0, np.int64)
                stay = np.flatnonzero(~gone)
                # a line that is kept takes its break along; each text then loses the last one
                body = np.append(own, np.uint8(10))
                size = t.end[stay] - t.start[stay] + 1
                ends = np.cumsum(size)
                take = np.repeat(t.start[stay] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
                take[ends - 1] = len(own)
                length = np.bincount(t.row[stay], size, minlength=j - i).astype(np.int64)
                edge = np.concatenate([[0], np.cumsum(length)])
                hold = np.ones(len(take), bool)
                hold[edge[1:][length > 0] - 1] = False
                at = np.concatenate([[0], np.cumsum(np.maximum(length - 1, 0))]).astype(np.int64)
                text = pa.Array.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(body[take[hold]].tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(t.n), pa.array(dropped), text.cast(pa.binary()).cast(pa.string())], ["row", "n_lines", "n_dropped", "kept"])

    return run


def common_keys(docs: DataFrame, scratch: Scratch, *, text: str, min_docs: int, min_chars: int) -> DataFrame:
    """a, b, n: hashes of the keys in at least min_docs documents, and in how many."""
    counts = docs.select(F.col(text).cast("string")).mapInArrow(_counted(min_chars), "a long, b long, n long")
    return scratch.cut(counts.groupBy("a", "b").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_docs), "common")


def drop_common_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1, most: int = MOST) -> DataFrame:
    """row (all columns of docs but the text), n_lines, n_dropped and kept, the text that is left."""
    scratch = Scratch(docs.sparkSession, "lines")
    common = common_keys(docs, scratch, text=text, min_docs=min_docs, min_chars=min_chars)
    size, total = common.agg(F.count("*"), F.sum("n")).first()
    # total / n keys at most are in n documents
    least = min_docs if size <= most else -(-total // most)
    sure = common.filter(F.col("n") >= least).select("a", "b").toArrow()
    known = Known(*(np.asarray(sure.column(c)).view(np.uint64) for c in range(2)))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)) if len(docs.columns) > 1 else F.struct(F.lit(None).cast("string").alias("none"))
    body = F.col(text).cast("string").alias("text")
    rows = docs.select(row.alias("row"), body)
    kind = f"row {rows.schema['row'].dataType.simpleString()}, n_lines long, n_dropped long, kept string"
    if size <= most:
        return rows.mapInArrow(_kept(min_chars, known, False), kind)
    # rows of one text share its places; other columns part the copies of a text
    uid = F.concat_ws(":", F.xxhash64("row", "text"), F.xxhash64("text", "row"))
    rows = rows.select(uid.alias("uid"), "row", "text")
    places = rows.select("uid", "text").mapInArrow(_places(min_chars, known), "uid string, place int, a long, b long")
    rest = common.filter(F.col("n") < least).select("a", "b")
    by_row = places.join(rest, ["a", "b"], "left_semi").groupBy("uid").agg(F.collect_set("place").alias("places"))
    by_row = scratch.cut(by_row, "places").mapInArrow(_packed_places, "uid string, places binary")
    return rows.join(by_row, "uid", "left").select("row", "text", "places").mapInArrow(_kept(min_chars, known, True), kind)


def _packed_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        places = [np.asarray(x.values, np.int32).tobytes() for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary())], ["uid", "places"])


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that stand in ten or more."""
    kept = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents
), e AS (
  SELECT r, doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS place FROM d
), k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), c AS (
  SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10
), m AS (
  SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""
