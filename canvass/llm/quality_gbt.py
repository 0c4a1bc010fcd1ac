"""Quality classifier: gradient-boosted trees on histograms of document statistics.

Statistics of whole texts are computed from their bytes, vectorised over
batches. The trees are grown on binned features (one histogram of gradients
for each feature and node), at most SAMPLE labelled rows, and flattened into
arrays; scoring walks all rows down a tree level by level.

Defined cases: a null text is an empty one; empty texts have a score too; a
null doc_id is not held out; with no labels, or labels of one kind, all scores
are the prior of the labels (0.5 without any); repeated rows are scored
alike; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.llm.common import LOWER, BytesHash, distinct, fold_of, flat_text, labelled, steps, table, tidy, words

#: Labelled rows that the trees are fitted on, at most.
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE, RIDGE = 60, 4, 64, 0.2, 1.0
#: Rows on either side of a split, at least: a twentieth of all, within these bounds.
FEWEST_ROWS, LEAST_ROWS = 2, 20
_HASH = BytesHash(17)

FEATURES = (
    "log_bytes", "log_words", "word_mean", "word_deviation", "word_longest", "letters", "upper", "digits", "marks", "beyond_ascii",
    "pipes", "symbols", "spaces", "lines_per_byte", "line_mean", "distinct_words", "commonest_word", "same_as_before", "same_as_two_before",
    "distinct_lines", "distinct_pairs", "stops_per_word", "words_ending_in_mark", "commas_per_word", "entropy", "braces", "quotes",
)


def _byte_kinds() -> np.ndarray:
    """Which counted kinds each byte belongs to, as columns."""
    c = np.arange(256)
    sets = [
        ((c | 32) >= 97) & ((c | 32) <= 122), (c >= 65) & (c <= 90), (c >= 48) & (c <= 57),
        np.isin(c, list(b".,;:!?\"'()-")), c >= 128, c == 124, np.isin(c, list(b"#$%&*@^~=+_<>/\\")), c == 32, c == 10,
        np.isin(c, list(b".!?")), c == 44, np.isin(c, list(b"{}[]")), np.isin(c, list(b"\"'")),
    ]
    return np.array(sets, np.float64).T


_KINDS = _byte_kinds()


def features(b: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of statistics for each text."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    s, e, o = words(b, offsets)
    h = _HASH.of(LOWER[b], s, e) if len(s) else np.zeros(0, np.uint64)
    size = (e - s).astype(np.float64)
    marked = _KINDS[:, 3].astype(bool) | _KINDS[:, 6].astype(bool)
    ends_in_mark = marked[b[e - 1]] if len(e) else np.zeros(0, bool)
    for r in range(n):
        x = b[offsets[r] : offsets[r + 1]]
        if not len(x):
            continue
        counts = np.bincount(x, minlength=256)
        kinds = counts @ _KINDS / len(x)
        share = counts[counts > 0] / len(x)
        i, j = o[r], o[r + 1]
        w, k = h[i:j], max(1, j - i)
        row = out[r]
        lines = max(1.0, kinds[8] * len(x) + 1)
        row[0], row[1] = np.log1p(len(x)), np.log1p(j - i)
        if j > i:
            row[2], row[3], row[4] = size[i:j].mean(), size[i:j].std(), np.log1p(size[i:j].max())
            _, times = np.unique(w, return_counts=True)
            row[15], row[16] = len(times) / k, times.max() / k
            row[17] = (w[1:] == w[:-1]).sum() / k
            row[18] = (w[2:] == w[:-2]).sum() / k
            row[20] = len(distinct(w[1:] * np.uint64(3) + w[:-1])) / k
            row[22] = ends_in_mark[i:j].mean()
        row[5:14] = kinds[:9]
        row[13] = kinds[8]
        row[14] = len(x) / lines
        cut = np.concatenate([[-1], np.flatnonzero(x == 10), [len(x)]])
        row[19] = len({x[p + 1 : q].tobytes() for p, q in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)}) / (len(cut) - 1)
        row[21], row[23] = kinds[9] * len(x) / k, kinds[10] * len(x) / k
        row[24] = -(share * np.log2(share)).sum()
        row[25], row[26] = kinds[11], kinds[12]
    return out


@dataclass
class Forest:
    """Trees as arrays: node i of a tree goes left (2i + 1) if feature[i] <= threshold[i]; leaves are the last level."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        inner = self.feature.shape[1]
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE) -> Forest:
    """Trees for logistic loss, the two kinds of label weighing the same."""
    inner, leaves = 2**depth - 1, 2**depth
    share = float(y.mean()) if len(y) else 0.5
    if not len(y) or not 0 < share < 1:
        base = float(np.log((share * len(y) + 0.5) / ((1 - share) * len(y) + 0.5)))
        return Forest(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    weight = np.where(y == 1, 0.5 / share, 0.5 / (1 - share))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)])
    least = min(LEAST_ROWS, max(FEWEST_ROWS, len(y) // 20))
    margin = np.zeros(len(y))
    feature, threshold, value = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    for t in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * p * (1 - p)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = node - first
            gain, best = np.zeros(width), np.zeros((width, 2), np.int64)
            for f in range(x.shape[1]):
                cell = at * bins + binned[f]
                sums = [np.bincount(cell, v, minlength=width * bins).reshape(width, bins).cumsum(1) for v in (g, h, np.ones(len(y)))]
                (gl, hl, nl), (ga, ha, na) = sums, (s[:, -1:] for s in sums)
                gains = gl**2 / (hl + RIDGE) + (ga - gl) ** 2 / (ha - hl + RIDGE) - ga**2 / (ha + RIDGE)
                gains[(nl < least) | (na - nl < least)] = 0
                gains[:, len(edges[f]) :] = 0
                cut = gains.argmax(1)
                top = gains[np.arange(width), cut]
                better = top > gain + 1e-9
                gain[better] = top[better]
                best[better] = np.stack([np.full(width, f), cut], 1)[better]
            right = np.zeros(len(y), bool)
            for k in np.flatnonzero(gain > 0):
                f, cut = best[k]
                feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
                mine = at == k
                right[mine] = binned[f][mine] > cut
            node = 2 * node + 1 + right
        leaf = node - inner
        value[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + RIDGE)
        margin += value[t][leaf]
    return Forest(0.0, feature, threshold, value)


def statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns `keep` of docs and x, the statistics of text as doubles in a binary column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(0))
                rows = [x.tobytes() for i, j in steps(o) for x in features(b[o[i] : o[j]], o[i : j + 1] - o[i])]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(rows, pa.binary())], [*batch.schema.names[1:], "x"])

    picked = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{kinds}, x binary")


def train(docs: DataFrame, labels: DataFrame, *, column: str = "quality", folds: int = 3, held_out: int = 1, most: int = SAMPLE) -> Forest:
    rows = statistics(labelled(docs, labels, column, folds, held_out, most), ["doc_id", "y"]).orderBy("doc_id").collect()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(-1, len(FEATURES))
    return fit(x, np.array([r["y"] for r in rows], np.float64))


def score(docs: DataFrame, forest: Forest, keep: list[str]) -> DataFrame:
    """Columns `keep` and score, the share of trust in label 1."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(forest))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(model.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(0))
                parts = [trees.score(features(b[o[i] : o[j]], o[i : j + 1] - o[i])) for i, j in steps(o)]
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(np.concatenate(parts or [np.zeros(0)]))], [*batch.schema.names[1:], "score"])

    picked = docs.select(F.col("text").cast("string").alias("__text"), *keep)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[1:])
    return picked.mapInArrow(run, f"{kinds}, score double")


def keep_good(docs: DataFrame, forest: Forest, least: float = 0.5) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least `least`."""
    model = docs.sparkSession.sparkContext.broadcast(pickle.dumps(forest))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = pickle.loads(model.value)
        with np.errstate(over="ignore"):
            for batch in batches:
                b, o = flat_text(batch.column(at))
                for i, j in steps(o):
                    good = trees.score(features(b[o[i] : o[j]], o[i : j + 1] - o[i])) >= least
                    yield batch.slice(i, j - i).filter(pa.array(good))

    return docs.mapInArrow(tidy(run), docs.schema)


def op2_quality_gbt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    forest = train(docs, table(spark, sf_dir, "labels"))
    held = F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False))
    return score(docs, forest, ["doc_id"]).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
