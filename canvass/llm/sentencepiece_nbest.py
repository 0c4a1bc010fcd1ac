"""SentencePiece encoding and decoding with the N best segmentations.

The lattice of a text has an edge for each piece of the vocabulary at each
place. Forward Viterbi gives the best score from the start to each place;
these are exact heuristics for an A-star search backwards from the end, which
so pops complete segmentations in the order of their scores.

A lattice falls apart where no piece holds the two neighbouring characters
(before most spaces, around punctuation). Both searches run once for each
distinct part; the best of a text are put together from those of its parts by
their gaps to the best. Characters without a piece go as bytes, at a score
below all pieces.

Texts get the model's leading space and spaces become the mark U+2581, with
no other normalisation. Pieces of type byte, control, unknown or unused are
no edges. Of equal scores the order is that of the search, which depends on
the part alone.

Defined cases: null and empty texts have no pieces, score 0 and one
segmentation; U+2581 in a text is decoded as a space; repeated rows are
encoded alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import SpanTable, flat_text, give_back, grown, steps, table

MARK = "▁"
NBEST = 3
#: Parts that a worker keeps with their segmentations, their bytes, and slots of their table as a power of two.
PARTS_KEPT, BYTES_KEPT, SLOTS = 800_000, 1 << 25, 21
#: Bytes of text that are segmented in one step, and ids that are decoded in one.
STEP, IDS_AT_ONCE = 1 << 18, 1 << 15
#: Scores below this mark pieces that are there by hand; they do not set the score of unknown characters.
BY_HAND = -1e8
_models: dict = {}


class Pieces:
    """The vocabulary of a model, and the segmentations of parts."""

    def __init__(self, path: str, nbest: int) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.nbest = nbest
        self.edges: dict[str, tuple[int, float]] = {}
        self.of_byte = np.zeros(256, np.int64)
        self.bytes_of: list[bytes] = []
        for i in range(sp.vocab_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.of_byte[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.bytes_of.append(b"")
            else:
                self.edges[piece] = (i, sp.get_score(i))
                self.bytes_of.append(piece.replace(MARK, " ").encode())
        self.longest: dict[str, int] = {}  # of the pieces with these first two characters
        for piece in self.edges:
            if len(piece) > 1:
                self.longest[piece[:2]] = max(len(piece), self.longest.get(piece[:2], 0))
        self.unknown = min((s for _, s in self.edges.values() if s > BY_HAND), default=0.0) - 10
        self.joined = np.zeros((256, 256), bool)  # last byte of a character, first byte of the next, within some piece
        for piece in self.edges:
            for a, b in zip(piece, piece[1:], strict=False):
                for x in {a, " "} if a == MARK else {a}:
                    for y in {b, " "} if b == MARK else {b}:
                        self.joined[x.encode()[-1], y.encode()[0]] = True
        self.size = np.array([len(x) for x in self.bytes_of])
        self.at = np.concatenate([[0], np.cumsum(self.size)])
        self.all_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.known = SpanTable(41, SLOTS)
        self.clear()

    def clear(self) -> None:
        self.known.clear()
        self.flat, self.offsets = np.zeros(1 << 14, np.int32), np.zeros(1 << 12, np.int64)
        self.score = np.zeros((1 << 12, self.nbest))
        self.others, self.other_at = np.zeros(1 << 14, np.int32), np.zeros((1 << 12) * max(1, self.nbest - 1) + 1, np.int64)

    # one part

    def search(self, part: str) -> list[tuple[float, list[int]]]:
        """The N best (score, ids) of a part."""
        n, edges, reach, byte = len(part), self.edges, self.longest, (-1, self.unknown)
        ending: list[list[tuple[int, int, float]]] = [[] for _ in range(n + 1)]
        best = [0.0] + [-np.inf] * n
        for i in range(n):
            base = best[i]
            e = edges.get(part[i], byte)
            ending[i + 1].append((i, *e))
            if base + e[1] > best[i + 1]:
                best[i + 1] = base + e[1]
            for j in range(i + 2, min(n, i + reach.get(part[i : i + 2], 0)) + 1):
                if (e := edges.get(part[i:j])) is not None:
                    ending[j].append((i, e[0], e[1]))
                    if base + e[1] > best[j]:
                        best[j] = base + e[1]
        out, count = [], 0
        heap: list = [(-best[n], 0, n, 0.0, None)]
        while heap and len(out) < self.nbest:
            f, _, at, gone, path = heapq.heappop(heap)
            if at == 0:
                ids = []
                while path is not None:
                    begin, end, i, path = path
                    if i >= 0:
                        ids.append(i)
                    else:
                        ids += self.of_byte[list(part[begin:end].encode())].tolist()
                out.append((-f, ids))
                continue
            for begin, i, s in ending[at]:
                count += 1
                heapq.heappush(heap, (-(gone + s + best[begin]), count, begin, gone + s, (begin, at, i, path)))
        return out

    # many texts

    def _add(self, h: np.ndarray, parts: list[bytes]) -> None:
        found = [self.search(x.decode("utf-8", "replace").replace(" ", MARK)) for x in parts]
        n, k = self.known.n, len(parts)
        ends = self.offsets[n] + np.cumsum([len(x[0][1]) for x in found])
        while len(self.offsets) < n + k + 1:
            self.offsets, self.score = grown(self.offsets), grown(self.score)
        while len(self.flat) < ends[-1]:
            self.flat = grown(self.flat)
        self.flat[self.offsets[n] : ends[-1]] = [i for x in found for i in x[0][1]]
        self.offsets[n + 1 : n + 1 + k] = ends
        self.score[n : n + k] = [[x[j][0] if j < len(x) else -np.inf for j in range(self.nbest)] for x in found]
        if width := self.nbest - 1:
            ids = [x[j][1] if j < len(x) else [] for x in found for j in range(1, self.nbest)]
            upto = self.other_at[n * width] + np.cumsum([len(x) for x in ids])
            while len(self.other_at) < (n + k) * width + 1:
                self.other_at = grown(self.other_at)
            while len(self.others) < upto[-1]:
                self.others = grown(self.others)
            self.others[self.other_at[n * width] : upto[-1]] = [i for x in ids for i in x]
            self.other_at[n * width + 1 : (n + k) * width + 1] = upto
        self.known.add(h, parts)

    def parts_of(self, b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Starts of the parts of rows that carry their leading space already."""
        new = np.ones(len(b), bool)
        new[1:] = ~self.joined[b[:-1], b[1:]] & ((b[1:] & 0xC0) != 0x80)
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        return np.flatnonzero(new)

    def encode(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(code of each part, parts of each row as offsets, ids of the best, their offsets by row)."""
        start = self.parts_of(b, offsets)
        end = np.append(start[1:], len(b)) if len(start) else start
        h = self.known.hashes(b, start, end)
        if self.known.n > PARTS_KEPT or self.known.held > BYTES_KEPT:
            self.clear()
        raw = b.tobytes()
        while len(fresh := np.flatnonzero((code := self.known.find(h, b, start, end)) < 0)):
            _, first = np.unique(h[fresh], return_index=True)
            fresh = fresh[first]
            for k in range(0, len(fresh), 4096):
                x = fresh[k : k + 4096]
                self._add(h[x], [raw[i:j] for i, j in zip(start[x].tolist(), end[x].tolist(), strict=True)])
        first, n = self.offsets[code], self.offsets[code + 1] - self.offsets[code]
        upto = np.concatenate([[0], np.cumsum(n)])
        ids = self.flat[np.repeat(first - upto[:-1], n) + np.arange(upto[-1])]
        of_row = np.searchsorted(start, offsets)
        return code, of_row, ids, upto[of_row]

    def combine(self, code: np.ndarray) -> list[tuple[float, dict[int, int]]]:
        """The N best of a text of these parts: (score, {part: rank of its segmentation, where not the first})."""
        total = float(self.score[code, 0].sum())
        out: list[tuple[float, dict[int, int]]] = [(total, {})]
        if self.nbest == 1 or not len(code):
            return out
        gaps = self.score[code, 0] - self.score[code, 1]
        k = min(len(code), self.nbest - 1)
        near = np.argsort(gaps, kind="stable")[:k] if len(code) < 64 else np.sort(np.argpartition(gaps, k - 1)[:k])
        near = [int(p) for p in near[np.argsort(gaps[near], kind="stable")] if np.isfinite(gaps[p])]
        heap, count = [(0.0, 0, 0, ())], 0  # (cost, order, parts decided, ranks of the decided)
        # each state decides the next of the nearest parts; the cost only grows
        out = []
        while heap and len(out) < self.nbest:
            cost, _, i, ranks = heapq.heappop(heap)
            if i == len(near):
                out.append((total - cost, {p: r for p, r in zip(near, ranks, strict=True) if r}))
                continue
            row = self.score[code[near[i]]]
            for r in range(self.nbest):
                if np.isfinite(row[r]):
                    count += 1
                    heapq.heappush(heap, (cost + float(row[0] - row[r]), count, i + 1, (*ranks, r)))
        return out

    def nbest_of(self, b: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, rank from 1, score, ids, offsets of the ids) of the N best segmentations of rows, in order."""
        code, at, _, _ = self.encode(b, offsets)
        found = [self.combine(code[i:j]) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        row = np.repeat(np.arange(len(found)), [len(x) for x in found])
        rank = np.array([k for x in found for k in range(1, len(x) + 1)], np.int32)
        score = np.array([s for x in found for s, _ in x], np.float64)
        n = at[row + 1] - at[row]
        upto = np.concatenate([[0], np.cumsum(n)])
        code = code[np.repeat(at[row] - upto[:-1], n) + np.arange(upto[-1])]
        first, size = self.offsets[code], self.offsets[code + 1] - self.offsets[code]
        changed = [(begin + p, r) for begin, (_, ranks) in zip(upto.tolist(), (y for x in found for y in x), strict=False) for p, r in ranks.items()]
        where, ranks = (np.array(c, np.int64) for c in (zip(*changed, strict=True) if changed else ((), ())))
        slot = code[where].astype(np.int64) * (self.nbest - 1) + ranks - 1
        first[where], size[where] = self.other_at[slot], self.other_at[slot + 1] - self.other_at[slot]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(first - ends[:-1], size) + np.arange(ends[-1])
        other = np.zeros(len(code), bool)
        other[where] = True
        other = np.repeat(other, size)
        ids = self.flat[np.where(other, 0, place)]
        ids[other] = self.others[place[other]]
        return row, rank, score, ids, ends[upto]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets by row) of the texts, each with its leading space still there."""
        upto = np.concatenate([[0], np.cumsum(self.size[ids])])
        out = np.empty(upto[-1], np.uint8)
        for i in range(0, len(ids), IDS_AT_ONCE):  # a place of eight bytes for each byte: not for all at once
            x, at = ids[i : i + IDS_AT_ONCE], upto[i : i + IDS_AT_ONCE + 1]
            out[at[0] : at[-1]] = self.all_bytes[np.repeat(self.at[x] - at[:-1], self.size[x]) + np.arange(at[0], at[-1])]
        return out, upto[offsets]


def pieces(path: str, nbest: int) -> Pieces:
    if (path, nbest) not in _models:
        _models[path, nbest] = Pieces(path, nbest)
    return _models[path, nbest]


def _spaced(docs: DataFrame) -> DataFrame:
    """(doc_id, text with its leading space, or '')."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.when(F.length(text) > 0, F.concat(F.lit(" "), text)).otherwise("").alias("text"))


def encode_nbest(docs: DataFrame, path: str, nbest: int = NBEST) -> DataFrame:
    """doc_id, rank (from 1), score, ids of the N best segmentations of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, nbest)
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(1))
                for i, j in steps(o, STEP):
                    row, rank, score, ids, upto = model.nbest_of(b[o[i] : o[j]], o[i : j + 1] - o[i])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + i)), pa.array(rank), pa.array(score), pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), pa.array(ids))], ["doc_id", "rank", "score", "ids"])

    return _spaced(docs).mapInArrow(run, "doc_id long, rank int, score double, ids array<int>")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with text, decoded from its ids; malformed bytes become U+FFFD."""

    @F.pandas_udf("string")
    def text(column):
        import pandas as pd

        model = pieces(path, 1)

        def one(x) -> str | None:
            if x is None:
                return None
            out = model.decode(np.asarray(x, np.int64), np.array([0, len(x)]))[0].tobytes().decode("utf-8", "replace")
            return out.removeprefix(" ")

        return pd.Series([one(x) for x in column], dtype=object)

    return encoded.withColumn("text", text(F.col(ids)))


RANKED = "rank int, score double, n_pieces long, ids_crc32 long, decodes boolean"
DIGEST = f"doc_id long, n_pieces long, score double, ids_crc32 long, n_best int, last_score double, decodes boolean, nbest array<struct<{RANKED}>>"


def digest(docs: DataFrame, path: str, nbest: int = NBEST) -> DataFrame:
    """A row for each document, from all that `encode_nbest` puts together.

    nbest has for each of the N best the rank, score, number of pieces, checksum
    of the ids (little-endian u32) and whether decoding gives the text. Beside
    it stand those of the best, how many there are, the score of the last, and
    whether all decode to the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path, nbest)
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(1))
                for i, j in steps(o, STEP):
                    x, at = b[o[i] : o[j]], o[i : j + 1] - o[i]
                    row, rank, score, ids, upto = model.nbest_of(x, at)
                    back, bounds = model.decode(ids, upto)
                    raw, text, said = ids.astype("<u4").tobytes(), x.tobytes(), back.tobytes()
                    crc = np.array([zlib.crc32(raw[4 * p : 4 * q]) for p, q in zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True)], np.int64)
                    good = np.array([said[p:q] == text[u:v] for p, q, u, v in zip(bounds[:-1].tolist(), bounds[1:].tolist(), at[row].tolist(), at[row + 1].tolist(), strict=True)], bool)
                    n = np.diff(upto)
                    first = np.searchsorted(row, np.arange(j - i + 1))
                    best, last = first[:-1], first[1:] - 1
                    ranked = pa.StructArray.from_arrays([pa.array(c) for c in (rank, score, n, crc, good)], [c.split()[0] for c in RANKED.split(", ")])
                    cols = (n[best], score[best], crc[best], np.diff(first).astype(np.int32), score[last], np.logical_and.reduceat(good, best))
                    names = ["doc_id", "n_pieces", "score", "ids_crc32", "n_best", "last_score", "decodes", "nbest"]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, cols), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), ranked)], names)
                # the text and what was made of it, before the next batch or task comes
                batch = b = x = row = rank = score = ids = back = raw = text = said = ranked = cols = None
                give_back()

    return _spaced(docs).mapInArrow(run, DIGEST)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded in the N best ways, and each decoded again."""
    return digest(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
