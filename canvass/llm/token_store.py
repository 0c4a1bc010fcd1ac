"""Token ids of documents in a content-addressed store of binary files.

Every document is encoded and closed with an end id. A rolling hash over the
last WINDOW ids cuts its id stream into chunks, so that equal passages give
equal chunks. Each distinct chunk is stored once, in pack files; recipe files,
in ascending document order, list the chunks of each document; a Merkle
manifest over packs and recipes allows to verify them.

Pack file: magic, then for each chunk digest[16], ids u32 (top bit: wide),
stored bytes u32, and the ids as u16 or (wide) u32 in a raw deflate stream. The
digest is that of the ids. Recipe file: magic, then for each
document row key i64, document i64, flag u8 (1: null id), chunks u32, and for
each chunk digest[16], ids u32. All numbers are little-endian.

Defined cases: a null text is an empty one and gives only the end id; a null
doc_id sorts first; rows that repeat a doc_id are documents of their own, one
after the other; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import LOWER, Scratch, SpanHash, SpanTable, flat_text, mix64, open_fs, steps, write_file

END_ID, WINDOW, LEAST, MASK, MOST = 2, 16, 64, 255, 2048
PACK, RECIPE = b"CVPACK01", b"CVRECP01"
#: Words that a worker keeps with their ids, their bytes, and chunk digests it knows as sent.
WORDS_KEPT, BYTES_KEPT, DIGESTS_KEPT = 1_000_000, 1 << 25, 1_000_000
_ROLL = SpanHash(7)

_encoders: dict = {}


#: Kinds of bytes: white space, letter, number (a token each), other.
SPACE, LETTER, NUMBER, OTHER = range(4)


def _kinds() -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """The kind of each ASCII byte, and of the second byte after 0xC2 and 0xC3 (Latin-1)."""
    one = lambda c: SPACE if c.isspace() and c not in "\x1c\x1d\x1e\x1f" else LETTER if c.isalpha() else NUMBER if c.isnumeric() else OTHER
    ascii_ = np.array([one(chr(i)) for i in range(128)] + [OTHER] * 128, np.uint8)
    return ascii_, {lead: np.array([one(bytes([lead, i]).decode()) if 0x80 <= i < 0xC0 else OTHER for i in range(256)], np.uint8) for lead in (0xC2, 0xC3)}


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: itself if printable in Latin-1, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [i for i in range(256) if i not in shown]
    return {i: chr(i) for i in shown} | {x: chr(256 + i) for i, x in enumerate(rest)}


_KIND, _KIND2 = _kinds()
_LETTERS = _byte_letters()
#: Slots of the table of known words, as a power of two.
SLOTS = 21


#: What a tokenizer file has to say of normalising and parting for `WordEncoder` to part texts itself.
PARTED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


class WordEncoder:
    """Ids of texts by way of their words.

    If its file says so, the tokenizer lower-cases, drops white space, and parts runs of letters,
    single numbers and runs of other characters before its merges, which
    never cross these. So the ids of a text are those of its words in turn;
    each distinct word goes through the library's model once and is then
    looked up by its bytes. Texts with letters beyond Latin-1, with
    contractions or with what may be a special token go to the library whole,
    and so do all texts if the file parts texts otherwise.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        dropout = (said.get("model") or {}).get("dropout")
        self.parts = all(said.get(k) == v for k, v in PARTED.items()) and not dropout and all(t["content"].startswith("<|") for t in said.get("added_tokens") or [])
        self.known = SpanTable(31, SLOTS)
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.offsets, self.flat = np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32)

    def _add(self, h: np.ndarray, words: list[bytes]) -> None:
        got = [[t.id for t in self.model.tokenize("".join(map(_LETTERS.__getitem__, w)))] for w in words]
        n, k = self.known.n, len(words)
        ends = self.offsets[n] + np.cumsum([len(x) for x in got])
        while len(self.offsets) < n + k + 1:
            self.offsets = np.concatenate([self.offsets, np.zeros_like(self.offsets)])
        while len(self.flat) < ends[-1]:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.offsets[n] : ends[-1]] = np.fromiter((i for x in got for i in x), np.uint32, int(ends[-1] - self.offsets[n]))
        self.offsets[n + 1 : n + 1 + k] = ends
        self.known.add(h, words)

    def encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets by row) of rows of UTF-8 text."""
        with np.errstate(over="ignore"):
            return self._encode(b, offsets)

    def _encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind, low = _KIND[b], LOWER[b]
        ahead = np.append(b[1:], np.uint8(0))
        for lead in (0xC2, 0xC3):
            at = np.flatnonzero(b == lead)
            at = at[at + 1 < len(b)]
            kind[at] = kind[at + 1] = _KIND2[lead][b[at + 1]]
            if lead == 0xC3:
                upper = at[(b[at + 1] >= 0x80) & (b[at + 1] <= 0x9E) & (b[at + 1] != 0x97)] + 1
                low[upper] += 0x20
        # rows for the library: beyond Latin-1, an apostrophe before a letter, or the start of a special token
        odd = np.flatnonzero((b >= 0xC4) | ((b == 39) & (_KIND[ahead] == LETTER)) | ((b == 60) & (ahead == 124)))
        odd = np.unique(np.searchsorted(offsets, odd, "right") - 1) if self.parts else np.flatnonzero(np.diff(offsets))
        edge = np.zeros(len(b) + 1, bool)
        edge[offsets] = True
        lead = (b & 0xC0) != 0x80
        new = np.ones(len(b), bool)
        new[1:] = (kind[1:] != kind[:-1]) | ((kind[1:] == NUMBER) & lead[1:]) | edge[1:-1]
        start = np.flatnonzero(new)
        end = np.append(start[1:], len(b)) if len(start) else start
        word = kind[start] != SPACE
        start, end = start[word], end[word]
        h = self.known.hashes(low, start, end)
        if self.known.n > WORDS_KEPT or self.known.held > BYTES_KEPT:
            self.clear()
        raw = low.tobytes()
        while len(fresh := np.flatnonzero((code := self.known.find(h, low, start, end)) < 0)):
            _, first = np.unique(h[fresh], return_index=True)
            fresh = fresh[first]
            for k in range(0, len(fresh), 65536):
                part = fresh[k : k + 65536]
                self._add(h[part], [raw[i:j] for i, j in zip(start[part].tolist(), end[part].tolist(), strict=True)])
        first, n = self.offsets[code], self.offsets[code + 1] - self.offsets[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(start, offsets)]
        if len(odd):
            rows = np.split(ids, bounds[1:-1])
            texts = [b[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace") for r in odd.tolist()]
            for r, e in zip(odd.tolist(), self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                rows[r] = np.asarray(e.ids, np.uint32)
            ids, bounds = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        return ids, bounds


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """For each row the ends of its chunks, in ids: where the hash of the last WINDOW ids has MASK clear, LEAST to MOST ids apart."""
    with np.errstate(over="ignore"):
        _ROLL._grow(len(ids) + 1)
        p = np.zeros(len(ids) + 1, np.uint64)
        np.cumsum(mix64(ids.astype(np.uint64) + np.uint64(1)) * _ROLL.up[: len(ids)], out=p[1:])
        # the hash that ends at i; a chunk is longer than the window, so that no hash reaches into the row before
        roll = mix64((p[WINDOW:] - p[:-WINDOW]) * _ROLL.down[: max(0, len(ids) + 1 - WINDOW)])
    likely = np.flatnonzero(roll & np.uint64(MASK) == 0) + WINDOW
    out, steps_ = [], likely.tolist()
    for last, n in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        ends = []
        while n - last > LEAST:
            i = bisect.bisect_left(steps_, last + LEAST)
            last = min(steps_[i] if i < len(steps_) else n, last + MOST, n)
            ends.append(last)
        if last < n:
            ends.append(n)
        out.append(ends)
    return out


def _deflate(body: bytes) -> bytes:
    z = zlib.compressobj(1, zlib.DEFLATED, -15)
    return z.compress(body) + z.flush()


TOKENS = "doc_id long, row long, seq int, n int, digest binary, wide boolean, body binary"


def tokenize(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """One row for each chunk of each document; the body only where this task has not sent the chunk yet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sent = encoder(path), set()
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            b, o = flat_text(batch.column(1))
            for i, j in steps(o):
                ids, at = enc.encode(b[o[i] : o[j]], o[i : j + 1] - o[i])
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
                wide = bool(len(ids) and ids.max() > 0xFFFF)
                raw, width = ids.astype("<u4" if wide else "<u2").tobytes(), 4 if wide else 2
                cols: list[list] = [[], [], [], [], [], []]
                for r, ends in enumerate(cuts(ids, at)):
                    begin = int(at[r])
                    for seq, end in enumerate(ends):
                        body = raw[width * begin : width * end]
                        if wide and max(ids[begin:end]) <= 0xFFFF:
                            body = ids[begin:end].astype("<u2").tobytes()
                        digest = hashlib.blake2b(body, digest_size=16, key=b"w" if len(body) > 2 * (end - begin) else b"").digest()
                        fresh = digest not in sent
                        if fresh:
                            if len(sent) >= DIGESTS_KEPT:
                                sent.clear()
                            sent.add(digest)
                        for c, x in zip(cols, (r, seq, end - begin, digest, len(body) > 2 * (end - begin), _deflate(body) if fresh else None), strict=True):
                            c.append(x)
                        begin = end
                r = pa.array(cols[0], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(r), pc.add(r, row), *(pa.array(c, t) for c, t in zip(cols[1:], (pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.binary()), strict=True))], ["doc_id", "row", "seq", "n", "digest", "wide", "body"])
                row += j - i

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, TOKENS)


FILES = "path string, part int, items long, ids long, root binary"


def _merkle(leaves: list[bytes]) -> bytes:
    """Root over leaf digests; an odd one goes up as it is."""
    level = leaves or [hashlib.blake2b(b"", digest_size=16).digest()]
    while len(level) > 1:
        level = [hashlib.blake2b(b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


class MerkleStream:
    """The same root with one digest kept for each level."""

    def __init__(self) -> None:
        self.levels: list[bytes | None] = []

    def add(self, leaf: bytes) -> None:
        for i, x in enumerate(self.levels):
            if x is None:
                self.levels[i] = leaf
                return
            leaf = hashlib.blake2b(x + leaf, digest_size=16).digest()
            self.levels[i] = None
        self.levels.append(leaf)

    def root(self) -> bytes:
        up = None
        for x in self.levels:
            if x is not None:
                up = x if up is None else hashlib.blake2b(x + up, digest_size=16).digest()
        return up or _merkle([])


def _write_packs(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, facts = f"{base}/packs/pack-{part:06d}.bin", [0, 0]
        tree = MerkleStream()

        def write(out) -> None:
            out.write(PACK)
            last = None
            for batch in batches:
                for digest, n, wide, body in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if digest != last:
                        out.write(digest + struct.pack("<II", n | (wide << 31), len(body)) + body)
                        tree.add(digest)
                        facts[0] += 1
                        facts[1] += n
                        last = digest

        write_file(path, write)
        yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "items": facts[0], "ids": facts[1], "root": tree.root()}], FILE_SCHEMA)

    return run


FILE_SCHEMA = pa.schema([("path", pa.string()), ("part", pa.int32()), ("items", pa.int64()), ("ids", pa.int64()), ("root", pa.binary())])


def _write_recipes(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        path, facts = f"{base}/recipes/recipe-{part:06d}.bin", [0, 0]
        tree = MerkleStream()

        def write(out) -> None:
            out.write(RECIPE)
            now, entries = None, []

            def close() -> None:
                if now is not None:
                    body = struct.pack("<qqBI", now[0], now[1] or 0, now[1] is None, len(entries)) + b"".join(entries)
                    out.write(body)
                    tree.add(hashlib.blake2b(body, digest_size=16).digest())
                    facts[0] += 1

            for batch in batches:
                for doc, row, n, digest in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                    if now != (row, doc):
                        close()
                        now, entries = (row, doc), []
                    entries.append(digest + struct.pack("<I", n))
                    facts[1] += n
            close()

        write_file(path, write)
        yield pa.RecordBatch.from_pylist([{"path": path, "part": part, "items": facts[0], "ids": facts[1], "root": tree.root()}], FILE_SCHEMA)

    return run


def write_store(docs: DataFrame, base: str, path: str, scratch: Scratch, end_id: int = END_ID) -> dict:
    """Encode docs (doc_id, text) and write packs, recipes and manifest.json below base; returns the manifest."""
    spark = docs.sparkSession
    tokens = scratch.cut(tokenize(docs, path, end_id), "tokens")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = tokens.filter("body is not null").select("digest", "n", "wide", "body").repartition(parts, "digest").sortWithinPartitions("digest")
    packs = packs.mapInArrow(_write_packs(base), FILES).collect()
    recipes = tokens.select("doc_id", "row", "n", "digest", "seq").repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row", "seq")
    recipes = recipes.mapInArrow(_write_recipes(base), FILES).collect()
    scratch.drop("tokens")
    manifest = {k: [{"path": r["path"].removeprefix(base + "/"), "items": r["items"], "ids": r["ids"], "root": r["root"].hex()} for r in sorted(rows, key=lambda r: r["part"])] for k, rows in (("packs", packs), ("recipes", recipes))}
    manifest["root"] = _merkle([bytes.fromhex(r["root"]) for k in ("packs", "recipes") for r in manifest[k]]).hex()
    write_file(f"{base}/manifest.json", lambda out: out.write(json.dumps(manifest).encode()))
    return manifest


def read_manifest(base: str) -> dict:
    fs, path = open_fs(f"{base}/manifest.json")
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


class _Reader:
    def __init__(self, uri: str, magic: bytes) -> None:
        fs, path = open_fs(uri)
        self.f = fs.open_input_stream(path, buffer_size=1 << 20)
        if self.f.read(len(magic)) != magic:
            raise ValueError(f"{uri} is not a file of this format")

    def take(self, n: int) -> bytes:
        out = self.f.read(n)
        if out and len(out) < n:
            raise ValueError("a file of the store is cut short")
        return out


def _file_rows(spark: SparkSession, base: str, files: list[dict]) -> DataFrame:
    start, rows = 0, []
    for r in files:
        rows.append((f"{base}/{r['path']}", start, bytearray.fromhex(r["root"])))
        start += r["ids"]
    return spark.createDataFrame(rows, "path string, start long, root binary").repartition(max(1, len(rows)))


def read_chunks(spark: SparkSession, base: str, manifest: dict, bodies: bool = False) -> DataFrame:
    """(digest, n, crc) of every stored chunk, verified against its digest and the pack's root; with the ids if asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, root in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                r, tree, rows = _Reader(path, PACK), MerkleStream(), []
                while head := r.take(24):
                    n, stored = struct.unpack("<II", head[16:])
                    wide, n = n >> 31, n & 0x7FFFFFFF
                    body = zlib.decompress(r.take(stored), -15)
                    if hashlib.blake2b(body, digest_size=16, key=b"w" if wide else b"").digest() != head[:16]:
                        raise ValueError(f"a chunk of {path} does not match its digest")
                    tree.add(head[:16])
                    ids = np.frombuffer(body, "<u4" if wide else "<u2").astype("<u4").tobytes()
                    rows.append((head[:16], n, zlib.crc32(ids), ids if bodies else None))
                    if len(rows) == 4096:
                        yield _chunk_batch(rows)
                        rows = []
                if tree.root() != root:
                    raise ValueError(f"{path} does not match its root")
                yield _chunk_batch(rows)

    return _file_rows(spark, base, manifest["packs"]).mapInArrow(run, "digest binary, n int, crc long, ids binary")


def _chunk_batch(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["digest", "n", "crc", "ids"])


RECIPE_ROWS = "row long, doc_id long, start long, seq int, digest binary, n int, tail long"


def read_recipes(spark: SparkSession, base: str, manifest: dict) -> DataFrame:
    """One row for each chunk of each document: ids of all documents before it, and ids of the document after the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "doc_id", "start", "seq", "digest", "n", "tail"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int64())
        for batch in batches:
            for path, start, root in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                r, tree, rows = _Reader(path, RECIPE), MerkleStream(), []
                while head := r.take(21):
                    row, doc, null, count = struct.unpack("<qqBI", head)
                    body = r.take(20 * count)
                    tree.add(hashlib.blake2b(head + body, digest_size=16).digest())
                    n = np.frombuffer(body, np.dtype([("d", "V16"), ("n", "<u4")]))["n"].astype(np.int64)
                    tail = n.sum() - np.cumsum(n)
                    rows += [(row, None if null else doc, start, i, body[20 * i : 20 * i + 16], int(n[i]), int(tail[i])) for i in range(count)]
                    start += int(n.sum())
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                        rows = []
                if tree.root() != root:
                    raise ValueError(f"{path} does not match its root")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return _file_rows(spark, base, manifest["recipes"]).mapInArrow(run, RECIPE_ROWS)


def _zero_operators() -> np.ndarray:
    """For each k the images of the 32 bits of a CRC-32 after 2**k more zero bytes."""
    one = np.zeros(32, np.uint64)
    one[0] = 0xEDB88320
    one[1:] = np.uint64(1) << np.arange(31, dtype=np.uint64)
    apply = lambda m, v: np.bitwise_xor.reduce(np.where((v[:, None] >> np.arange(32, dtype=np.uint64)) & np.uint64(1), m, np.uint64(0)), axis=1)
    for _ in range(3):
        one = apply(one, one)
    out = [one]
    for _ in range(47):
        out.append(apply(out[-1], out[-1]))
    return np.array(out)


_ZEROS = _zero_operators()


def crc_before(crc: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """What each piece gives to the CRC-32 of the whole if `tail` bytes follow; the whole is the XOR of these."""
    crc, k = crc.astype(np.uint64), 0
    tail = tail.astype(np.int64)
    while (tail >> k).any():
        on = np.flatnonzero((tail >> k) & 1)
        x, y = crc[on], np.zeros(len(on), np.uint64)
        for j in range(32):
            y ^= np.where((x >> np.uint64(j)) & np.uint64(1), _ZEROS[k][j], np.uint64(0))
        crc[on] = y
        k += 1
    return crc.astype(np.int64)


def digests(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files.

    A chunk is checksummed once, where it is stored; the checksum of a
    document is put together from those of its chunks and what follows each,
    so no ids are sent again and a chunk of many documents costs no more.
    """
    manifest = read_manifest(base)
    recipes = read_recipes(spark, base, manifest)
    chunks = read_chunks(spark, base, manifest).select(F.col("digest"), F.col("n").alias("stored"), "crc")

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.column(3).null_count or not np.array_equal(b.column(3), b.column(5)):
                raise ValueError("a recipe names a chunk that the store lacks")
            part = crc_before(np.asarray(b.column(4)), 4 * np.asarray(b.column(6)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(part)], ["row", "doc_id", "start", "n", "part"])

    # sizes of what files hold are unknown to the planner, which could take them for small: a merge join, whatever it thinks
    joined = recipes.join(chunks.hint("merge"), "digest", "left").select("row", "doc_id", "start", "n", "crc", "stored", "tail")
    parts = joined.mapInArrow(shift, "row long, doc_id long, start long, n int, part long")
    docs = parts.groupBy("row", "doc_id", "start").agg(F.sum("n").alias("n_tokens"), F.expr("bit_xor(part)").alias("ids_crc32"))
    return docs.select("doc_id", F.col("start"), "n_tokens", "ids_crc32")


def reconstruct(spark: SparkSession, base: str) -> DataFrame:
    """(doc_id, ids as little-endian u32) of every document, rebuilt from recipes and chunks."""
    manifest = read_manifest(base)
    chunks = read_chunks(spark, base, manifest, bodies=True).select("digest", "ids")
    whole = read_recipes(spark, base, manifest).join(chunks.hint("merge"), "digest").groupBy("row", "doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "ids"))).alias("x"))
    return whole.select("doc_id", F.expr("aggregate(x, cast('' as binary), (a, y) -> concat(a, y.ids))").alias("ids"))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to the store and back."""
    import public_tokenizers

    from canvass.llm.common import table

    scratch = Scratch(spark, "tokens")
    base = scratch.path("store")
    write_store(table(spark, sf_dir, "documents").select("doc_id", "text"), base, public_tokenizers.path("word_bpe_49k.json"), scratch)
    return digests(spark, base)
