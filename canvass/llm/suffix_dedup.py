"""Removal of byte strings that occur more than once, by prefix doubling.

Prefix doubling names every position by the rank of the string of length h
that starts there, pairs the names of positions h apart, sorts the pairs and
so names strings of length 2h; positions whose name is unique drop out. Here
names grow in the same way, from 8 bytes on: the name at length 2h is that of
the pair of names h apart. But a name is a fingerprint of the pair, which
each task computes alike, so that Spark has to sort names only where that
tells unique from repeated: at half the threshold and at the threshold.

At half the threshold not all positions are sent. In each window of LENGTH
bytes the least hash of a string of GRAM bytes marks an anchor; equal windows
have equal anchors at equal offsets, so a window repeats only where its anchor
does. Spark sorts the names of anchors, and those with a unique name drop out
with all their windows. Among anchors of one name, all windows of an anchor
are named at once by the string that spans them: if that repeats, they all
do. Only where anchors of one name stand in differing surroundings are windows
named one by one, from the pair of names half a window apart, and sorted;
those past the threshold of LENGTH bytes that repeat are removed.

A string that is everywhere does not meet in one task. What a task has seen
twice itself it does not send twice; where it sees an anchor's name in many
surroundings, it says so once, and deals these rows by name and surroundings;
and the windows of a name with many anchors are dealt by their own names too.

Defined cases: a null text is an empty one, and nothing of it or of texts
shorter than LENGTH is removed; overlapping occurrences count, within a text
too; equal rows (same doc_id and text) are two occurrences; an empty table
gives no rows; other columns are not read. Anchors are compared by 64 bits,
and spans and windows by 64 bits more among those whose anchors have one name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import _MASKS, STEP_BYTES, Scratch, _pieces, flat_text, lists, mix64, packed, steps, table, tidy, whole_groups

LENGTH, GRAM = 400, 200
#: Documents whose ids are broadcast to filter a scan; beyond it a shuffled join does it.
BROADCAST_IDS = 1_000_000
#: Surroundings of one name in a batch beyond which they are dealt on their own, and anchors of a name whose windows meet in one task.
MANY, TOGETHER = 1, 400
_BITS = np.uint64(22)
_FIRST, _LEFT, _SALT = (np.uint64(int(x) * 2 + 1) for x in np.random.default_rng(101).integers(1 << 40, 1 << 62, 3))
NO_ID = -(1 << 63)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The name of two names, one after the other."""
    return mix64(left * _LEFT + right)


def names(b: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """For each length, in growing order, the names of the strings of that length at every place that has one, by doubling."""
    out, h = [], min(8, lengths[0])
    name = mix64((_pieces(b)[: max(0, len(b) - h + 1)] & _MASKS[h]) * _FIRST)
    for length in lengths:
        while 2 * h <= length:
            name = _pair(name[: max(0, len(name) - h)], name[h:])
            h *= 2
        # two strings that overlap, if it is no power of two
        out.append(name if h == length else _pair(name[: max(0, len(b) - length + 1)], name[length - h :]))
    return out


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of x[i : i + w] for each i that has as many."""
    n = len(x)
    full = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    full[:n] = x
    rows = full.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def anchor_runs(b: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Row, first window start and anchor (in the row), windows, anchor name and two names of the spanning string, for each anchor."""
    nothing = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 3
    if len(b) < length:
        return nothing
    at = np.arange(len(b) - gram + 1)
    name = names(b, gram)[0]
    # by hash, then leftmost: the low bits hold the position
    ordered = (name >> _BITS << _BITS) | at.astype(np.uint64)
    anchor = (_sliding_min(ordered, length - gram + 1) & np.uint64((1 << int(_BITS)) - 1)).astype(np.int64)
    valid = np.zeros(len(b) + 1, np.int64)
    ok = np.diff(offsets) >= length
    np.add.at(valid, offsets[:-1][ok], 1)
    np.add.at(valid, offsets[1:][ok] - length + 1, -1)
    start = np.flatnonzero(np.cumsum(valid[: len(anchor)]))
    if not len(start):
        return nothing
    a = anchor[start]
    begin = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
    n = np.diff(np.concatenate([begin, [len(start)]]))
    first, a = start[begin], a[begin]
    row = np.searchsorted(offsets, first, "right") - 1
    u, v = _spanning(name, first, n, length, gram, ((a - first) << 32 | n).astype(np.uint64))
    return row, first - offsets[row], a - offsets[row], n, name[a], u, v


def _spanning(name: np.ndarray, first: np.ndarray, n: np.ndarray, length: int, gram: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of strings of length + n - 1 bytes with an anchor at `place`, each from names of strings that cover them."""
    end = first + n - 1 + length - gram  # where the last string of GRAM bytes starts
    u = v = mix64(place)
    for i in range(0, length, gram):
        u = _pair(u, name[np.minimum(first + i, end)])
        v = _pair(v + _SALT, name[np.maximum(end - i, first)])
    # runs of more windows than a gram is long are covered gram by gram
    long, at = np.flatnonzero(n > gram), length
    while len(long):
        u[long] = _pair(u[long], name[np.minimum(first[long] + at, end[long])])
        v[long] = _pair(v[long] + _SALT, name[np.maximum(end[long] - at, first[long])])
        at += gram
        long = long[first[long] + at < end[long] + gram]
    u, v = _pair(u, name[end]), _pair(v + _SALT, name[first])
    return u, v


def _parts(column: pa.Array, length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, bytes before it that were done, bytes, offsets) of a text column; long rows come in overlapping pieces."""
    b, o = flat_text(column)
    for i, j in steps(o):
        x = b[o[i] : o[j]]
        if j == i + 1 and len(x) > STEP_BYTES:
            for at in range(0, len(x) - length + 1, STEP_BYTES):
                piece = x[at : at + STEP_BYTES + length - 1]
                yield i, at, piece, np.array([0, len(piece)])
        else:
            yield i, 0, x, o[i : j + 1] - o[i]


RUNS = "deal long, name long, u long, v long, doc_id long, uid long, first long, n int, whole boolean, known boolean, many boolean"
RUN_NAMES = [x.split()[0] for x in RUNS.split(", ")]


def _anchors(length: int, gram: int, many: int):
    """Runs of windows by anchor.

    Of equal runs in one batch one is sent as `known` to repeat, and the others
    as `whole`, done with. A name in more than `many` surroundings is sent once
    as a row without a document; its runs are dealt by their surroundings.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                parts = []
                for i, before, b, o in _parts(batch.column(2), length):
                    row, first, _, n, name, u, v = anchor_runs(b, o, length, gram)
                    parts.append((row + i, first + before, n, name, u, v))
                if not parts:
                    continue
                row, first, n, name, u, v = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((v, u, name))
                same, new = np.zeros(len(u), bool), np.ones(len(u), bool)
                same[1:] = (u[order][1:] == u[order][:-1]) & (v[order][1:] == v[order][:-1]) & (name[order][1:] == name[order][:-1])
                new[1:] = name[order][1:] != name[order][:-1]
                whole, known, hot = np.zeros(len(u), bool), np.zeros(len(u), bool), np.zeros(len(u), bool)
                whole[order] = same
                known[order[:-1]] = same[1:] & ~same[:-1]
                group = np.cumsum(new) - 1
                crowded = np.bincount(group, ~same) > many if len(u) else new
                hot[order] = crowded[group]
                # what is done with is dealt by place: it is much where a string is everywhere
                deal = np.where(whole, mix64(first.astype(np.uint64) + u), np.where(hot, mix64(name ^ mix64(u)), name))
                told = order[new][crowded]
                at, k = pa.array(np.concatenate([row, row[told]])), len(told)
                also = lambda x, y: pa.array(np.concatenate([x, y]))
                longs = [pa.array(np.concatenate([x, y]).view(np.int64)) for x, y in ((deal, name[told]), (name, name[told]), (u, u[told]), (v, v[told]))]
                no = np.zeros(k, bool)
                yield pa.RecordBatch.from_arrays([*longs, batch.column(0).take(at), batch.column(1).take(at), also(first, first[told]), pa.array(np.concatenate([n, np.zeros(k, n.dtype)]).astype(np.int32)), also(whole, no), also(known, no), also(hot, ~no)], RUN_NAMES)

    return run


OPEN = "name long, doc_id long, uid long, first long, n int, whole boolean, open boolean"
OPEN_NAMES = [x.split()[0] for x in OPEN.split(", ")]


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of runs in order of deal: `whole` ones, whose spanning string repeats, and `open` ones, one for each kind of a name with several."""
    for t in whole_groups(batches, 50_000):
        deal, name, u, v = (np.asarray(t.column(i)) for i in range(4))
        n, done, known, many = (np.asarray(t.column(i)) for i in (7, 8, 9, 10))
        keys = np.flatnonzero(~done)
        order = keys[np.lexsort((v[keys], u[keys], name[keys], deal[keys]))]
        a, b, c, d = name[order], u[order], v[order], deal[order]
        new_name = np.concatenate([[True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])]) if len(order) else np.zeros(0, bool)
        new_kind = new_name | np.concatenate([[True], (b[1:] != b[:-1]) | (c[1:] != c[:-1])]) if len(order) else new_name
        kind, group = np.cumsum(new_kind) - 1, np.cumsum(new_name) - 1
        real = n[order] > 0
        size = np.bincount(kind, real) if len(order) else kind
        several = (np.bincount(group[new_kind]) > 1) | (np.bincount(group, many[order]) > 0) if len(order) else group
        heard = np.bincount(kind, known[order]) > 0 if len(order) else known[:0]
        whole, open_ = done.copy(), np.zeros(len(name), bool)
        whole[order] = (size[kind] > 1) | heard[kind]
        # one of each kind: the first that has a document
        of = order[real]
        _, at = np.unique(kind[real], return_index=True)
        open_[of[at]] = several[group[real][at]]
        keep = np.flatnonzero((whole | open_) & (n > 0))
        at = pa.array(keep)
        yield pa.RecordBatch.from_arrays([pa.array(name[keep]), *(t.column(i).combine_chunks().take(at) for i in (4, 5, 6, 7)), pa.array(whole[keep]), pa.array(open_[keep])], OPEN_NAMES)


WINDOWS = "deal long, name long, doc_id long, uid long, first long, places binary, keys binary, hits binary"
WINDOW_NAMES = [x.split()[0] for x in WINDOWS.split(", ")]


def _window_names(length: int):
    """The names of the windows of each open run, from those of their halves, as 64-bit values in a binary column.

    Of equal ones in one flush, one is sent as a hit and the others, hits as
    well, are blank. Runs of a name that is dealt out are cut into parts by the
    windows' names; places then tell which windows a part holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name, doc, uid, first, n, done, parts, keys = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            hits = np.repeat(done, n)
            order = np.argsort(keys, kind="stable")
            same = np.zeros(len(keys), bool)
            same[1:] = keys[order][1:] == keys[order][:-1]
            again = np.zeros(len(keys), bool)
            again[order] = same
            hits[order[1:]] |= same[1:]
            hits[order[:-1]] |= same[1:]
            part = (keys >> np.uint64(7)) % np.repeat(parts, n).astype(np.uint64)
            keys[again] = 0
            row = np.repeat(np.arange(len(n)), n)
            place = (np.arange(len(keys)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
            if parts.max() > 1:
                order = np.lexsort((place, part, row))
                row, place, part, keys, hits = row[order], place[order], part[order], keys[order], hits[order]
            begin = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (part[1:] != part[:-1])]))
            m, of = np.diff(np.append(begin, len(row))), row[begin]
            deal = np.where(parts[of] > 1, mix64(name[of].astype(np.uint64) + mix64(part[begin])).view(np.int64), name[of])
            return pa.RecordBatch.from_arrays([pa.array(deal), pa.array(name[of]), pa.array(doc[of]), pa.array(uid[of]), pa.array(first[of]), packed(place, m), packed(keys, m), packed(hits, m)], WINDOW_NAMES)

        with np.errstate(over="ignore"):
            for batch in batches:
                ids, uids = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                runs = batch.column(3)
                ends, flat = np.asarray(runs.offsets), runs.values
                name, first, n, done, parts = (np.asarray(flat.field(x)) for x in ("name", "first", "n", "whole", "parts"))
                for r in range(len(ids)):
                    b, _ = flat_text(batch.column(2).slice(r, 1))
                    part = slice(ends[r], ends[r + 1])
                    f, k = first[part], n[part].astype(np.int64)
                    for i, j, low, high in _stretches(f, k, length):
                        key = names(b[low:high], length)[0]
                        s = np.repeat(f[i:j] - low - (np.cumsum(k[i:j]) - k[i:j]), k[i:j]) + np.arange(k[i:j].sum())
                        key = np.maximum(key[s], np.uint64(1))
                        at = slice(ends[r] + i, ends[r] + j)
                        held.append((name[at], np.full(j - i, ids[r]), np.full(j - i, uids[r]), f[i:j], k[i:j], done[at], parts[at], key))
                        size += len(s)
                        if size > 1 << 19:
                            yield flush()
                            size = 0
            if held:
                yield flush()

    return run


def _stretches(first: np.ndarray, n: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """Runs i to j in order of place, with the bytes low to high that their windows cover: at most about a step, and no wide gaps."""
    i = 0
    while i < len(first):
        low, j, high = int(first[i]), i + 1, int(first[i] + n[i]) - 1 + length
        while j < len(first) and first[j] < high + length and first[j] + n[j] - low < STEP_BYTES:
            high = max(high, int(first[j] + n[j]) - 1 + length)
            j += 1
        yield i, j, low, high
        i = j


SPANS = "doc_id long, uid long, first long, n int"


def _window_hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows in order of deal, runs of those whose own names repeat."""
    for t in whole_groups(batches, 5_000):
        name = np.asarray(t.column(1))
        place, n = lists(t.column(5), np.int32)
        keys = lists(t.column(6), np.uint64)[0]
        hits = lists(t.column(7), bool)[0].copy()
        of = np.repeat(name, n)
        order = np.lexsort((keys, of))
        k, a = keys[order], of[order]
        same = (k[1:] == k[:-1]) & (a[1:] == a[:-1]) & (k[1:] != 0)
        hits[order[1:]] |= same
        hits[order[:-1]] |= same
        row = np.repeat(np.arange(len(n)), n)
        next_ = (row[1:] == row[:-1]) & (place[1:] == place[:-1] + 1) & hits[1:] & hits[:-1]
        begin = np.flatnonzero(hits & ~np.concatenate([[False], next_])) if len(hits) else row
        end = np.flatnonzero(hits & ~np.concatenate([next_, [False]])) if len(hits) else row
        at = pa.array(row[begin])
        yield pa.RecordBatch.from_arrays([t.column(2).combine_chunks().take(at), t.column(3).combine_chunks().take(at), pa.array(np.asarray(t.column(4))[row[begin]] + place[begin]), pa.array((end - begin + 1).astype(np.int32))], ["doc_id", "uid", "first", "n"])


def _docs_of(docs: DataFrame, ids: DataFrame, kind: str) -> DataFrame:
    """Documents whose key is (left_semi) or is not (left_anti) in ids."""
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, ["doc_id", "uid"], kind)


def repeated_spans(docs: DataFrame, scratch: Scratch, *, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, uid and spans, an array of (first, n): n windows from byte `first` on occur elsewhere; docs has doc_id, uid, text."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = docs.select("doc_id", "uid", "text").mapInArrow(tidy(_anchors(length, gram, MANY)), RUNS)
    runs = runs.repartition(parts, "deal").sortWithinPartitions("deal")
    found = scratch.cut(runs.mapInArrow(tidy(_repeated), OPEN), "found")
    # names with many anchors: their windows are dealt out in parts
    crowded = found.filter("open").groupBy("name").count().filter(F.col("count") > TOGETHER).select("name", F.ceil(F.col("count") / TOGETHER).cast("int").alias("parts"))
    crowded = scratch.cut(crowded, "crowded")
    open_ = found.filter("open").join(F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded, "name", "left")
    by_doc = open_.groupBy("doc_id", "uid").agg(F.array_sort(F.collect_list(F.struct("first", "name", "n", "whole", F.coalesce("parts", F.lit(1)).alias("parts")))).alias("runs"))
    by_doc = scratch.cut(by_doc, "open")
    texts = _docs_of(docs, by_doc.select("doc_id", "uid"), "left_semi")
    named = texts.join(by_doc.hint("merge"), ["doc_id", "uid"]).select("doc_id", "uid", "text", "runs").mapInArrow(tidy(_window_names(length)), WINDOWS)
    single = named.repartition(parts, "deal").sortWithinPartitions("deal").mapInArrow(tidy(_window_hits), SPANS)
    spans = found.filter("whole").select("doc_id", "uid", "first", "n").union(single)
    return spans.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("first", "n")).alias("spans"))


CUT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"


def _remove(length: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            b, o = flat_text(batch.column(2))
            lists = batch.column(4) if batch.num_columns > 4 else None
            for r in range(batch.num_rows):
                x, removed, spans = b[o[r] : o[r + 1]], 0, 0
                if lists is not None:
                    item = lists[r].values
                    f, n = np.asarray(item.field("first")), np.asarray(item.field("n")).astype(np.int64)
                    edge = np.zeros(len(x) + 1, np.int64)
                    np.add.at(edge, f, 1)
                    np.add.at(edge, f + n - 1 + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
                    n_bytes, x = len(x), x[~gone]
                else:
                    n_bytes = len(x)
                kept = x.tobytes()
                rows.append((n_bytes, removed, spans, hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore") if texts else None))
            cols = list(zip(*rows, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(3), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True))], CUT_NAMES)

    return run


CUT_NAMES = ["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]


def remove_repeats(docs: DataFrame, *, length: int = LENGTH, gram: int = GRAM, texts: bool = False) -> DataFrame:
    """row (all columns of docs but text), n_bytes, n_removed, n_spans, kept_sha256 and, if asked, the kept text of docs (doc_id, text, ...).

    A character of which a byte is removed is not in the kept text; the checksum is that of the kept bytes.
    """
    scratch = Scratch(docs.sparkSession, "repeats")
    row = F.struct(*(c for c in docs.columns if c != "text")).alias("row")
    # a null id gets the least one as key: rows of the same text under both have the same spans
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    docs = docs.select(key, F.xxhash64("text").alias("uid"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"), row)
    spans = scratch.cut(repeated_spans(docs.select("doc_id", "uid", "text"), scratch, length=length, gram=gram), "spans")
    scratch.drop("found", "open", "crowded")
    ids = spans.select("doc_id", "uid")
    hit = _docs_of(docs, ids, "left_semi").join(spans, ["doc_id", "uid"]).select("doc_id", "uid", "text", "row", "spans")
    rest = _docs_of(docs, ids, "left_anti").select("doc_id", "uid", "text", "row")
    kind = f"row {docs.schema['row'].dataType.simpleString()}, {CUT}"
    return hit.mapInArrow(tidy(_remove(length, texts)), kind).union(rest.mapInArrow(tidy(_remove(length, texts)), kind))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of 400 bytes that repeat, removed from all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
