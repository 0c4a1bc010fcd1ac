"""Ball trees, whitening and line dedup against brute force and on awkward tables."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from canvass.llm import ball_tree, entries, line_dedup, whitening
from tests.llm.test_operators import awkward, empty

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"


def odd_rows(dim):
    """Null, short, empty and non-finite vectors, a null id, repeated rows."""
    ok = [float(i % 7) for i in range(dim)]
    return [(1, None, 0), (2, [1.0] * (dim - 1), 0), (3, [], 0), (4, [None] + [1.0] * (dim - 1), 0), (5, [float("nan")] * dim, 0), (6, [float("inf")] * dim, 0), (None, ok, 0), (7, ok, 0), (7, ok, 0), (8, [-x for x in ok], 0)]


# 11


def brute_clusters(rows, k, rounds, scale, dim):
    good = [(i, v) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    x = np.array([[int(np.floor(scale * float(c))) for c in v] for _, v in good], np.int64).reshape(len(good), dim)
    first = sorted(range(len(good)), key=lambda r: (good[r][0] is None, hashlib.sha256(f"1:{good[r][0]}".encode()).hexdigest() if good[r][0] is not None else "", x[r].tolist()))[:k]
    c = x[first].copy()
    for _ in range(rounds):
        of = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        c = np.array([x[of == j].sum(0) // max(1, (of == j).sum()) if (of == j).any() else c[j] for j in range(len(c))]).reshape(len(c), dim)
    d = ((x[:, None] - c[None]) ** 2).sum(2)
    return sorted(((good[r][0] is None, good[r][0] or 0, int(d[r].argmin()), int(d[r].min())) for r in range(len(good))))


def clumps(spark, n=900, dim=4, spread=0.05):
    """Points about a few centres, and a third of all rows alike."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, dim)) * 4
    x = centres[rng.integers(0, 6, n)] + rng.normal(size=(n, dim)) * spread
    x[: n // 3] = centres[0]
    return spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], VECTORS)


@pytest.mark.parametrize("block", [50, 4096])
def test_clusters_of_clumps(spark, block):
    df = clumps(spark).repartition(5)
    found, c = ball_tree.cluster(df, k=8, rounds=4, scale=64.0, dim=4, block=block)
    mine = sorted((r["id"] is None, r["id"] or 0, r["cluster"], r["distance"]) for r in found.collect())
    assert mine == brute_clusters([(r[0], r[1]) for r in df.collect()], 8, 4, 64.0, 4)


def test_whole_balls_are_settled_without_their_vectors():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.integers(0, 20, (500, 3)), rng.integers(5000, 5020, (500, 3))]).astype(np.int64)
    order, parts = ball_tree.Tree.build(x)
    tree = ball_tree.Tree(3, **parts)
    ball, of_ball, row, _ = tree.filtered(np.array([[10, 10, 10], [5010, 5010, 5010]]))
    assert len(row) == 0 and sorted(of_ball.tolist()) == [0, 1]
    assert (tree.end - tree.start)[ball].sum() == len(x)
    assert (x[order] == tree.x).all() and (tree.total[0] == x.sum(0)).all()


@pytest.mark.parametrize("seed", range(4))
def test_trees_agree_with_all_distances(seed):
    rng = np.random.default_rng(seed)
    top = [3, 50, 1 << 24, 1 << 26][seed]  # many ties; beyond what doubles hold
    x, c = rng.integers(-top, top, (700, 5)), rng.integers(-top, top, (9, 5))
    c[3] = c[7]
    order, parts = ball_tree.Tree.build(x)
    tree = ball_tree.Tree(5, **parts)
    d = ((x[order].astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(2)
    of, near = tree.assigned(c)
    assert of.tolist() == [int(np.argmin(r)) for r in d] and near.tolist() == [min(r) for r in d]
    n, total = tree.sums(c)
    assert n.tolist() == [int((of == k).sum()) for k in range(9)]
    assert all((total[k] == tree.x[of == k].sum(0)).all() for k in range(9))


def test_clusters_awkward(spark):
    df = spark.createDataFrame(odd_rows(64), VECTORS).withColumns({"id": F.lit("x"), "cluster": F.lit(2), "v": F.lit(3), "distance": F.lit(4)})
    found, c = ball_tree.cluster(df, k=16, rounds=3, scale=64.0, dim=64)
    assert len(c) == 4
    got = sorted((r["id"] is None, r["id"] or 0, r["cluster"], r["distance"]) for r in found.collect())
    assert got == brute_clusters([(r[0], r[1]) for r in df.collect()], 16, 3, 64.0, 64)
    found, c = ball_tree.cluster(df.filter("false"), k=16, rounds=3, scale=64.0, dim=64)
    assert found.count() == 0 and len(c) == 0


def test_query_of_clusters_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], VECTORS).write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("op11_ball_tree", "op12_whitening"):
        assert entries.queries()[name](spark, str(tmp_path)).count() == 0


# 12


def brute_whitening(x, k=8):
    """Centred in whole numbers, decomposed by another method."""
    n = len(x)
    off = n * x.astype(object) - x.sum(0).astype(object)
    v = np.array((off.T @ off) / (n**3), float)
    e, u = np.linalg.eigh(v)
    return (off**2).sum(1), e[::-1][:k], u[:, ::-1][:, :k], e.sum()


def test_whitening_whole_table(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in r["embedding"]] for r in rows])
    deviation, e, u, trace = brute_whitening(x)
    got = entries.queries()["op12_whitening"](spark, SF).collect()
    assert len(got) == 8 * len(rows) and {r["n"] for r in got} == {len(rows)}
    assert {r["vec_id"]: r["deviation"] for r in got} == {r["vec_id"]: d for r, d in zip(rows, deviation, strict=True)}
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    want = ((x - x.mean(0)) @ u) / np.sqrt(e)
    for k in range(8):
        mine = {r["vec_id"]: r["whitened"] for r in got if r["component"] == k + 1}
        mine = np.array([mine[r["vec_id"]] for r in rows])
        sign = np.sign(mine @ want[:, k])
        assert np.abs(mine - sign * want[:, k]).max() < 1e-8
        assert {round(r["explained"] / (e[k] / trace), 9) for r in got if r["component"] == k + 1} == {1.0}


def test_jacobi_keeps_small_eigenvalues():
    from fractions import Fraction

    # graded: diag(g) H diag(g) with values down to 1e-24 of the largest
    rng = np.random.default_rng(3)
    h = rng.normal(size=(5, 5))
    h, g = h @ h.T / 5 + np.eye(5), 10.0 ** -np.arange(0, 15, 3)
    a = g[:, None] * h * g[None, :]
    e, u = whitening.jacobi(a)
    # the product of all eigenvalues, exactly
    m = [[Fraction(float(v)) for v in row] for row in np.triu(a) + np.triu(a, 1).T]
    det = Fraction(1)
    for i in range(5):
        det *= m[i][i]
        for j in range(i + 1, 5):
            f = m[j][i] / m[i][i]
            m[j] = [y - f * z for y, z in zip(m[j], m[i], strict=True)]
    assert abs(np.prod(e) / float(det) - 1) < 1e-12
    assert np.abs(u.T @ u - np.eye(5)).max() < 1e-13
    assert (np.diff(e) <= 0).all()


def test_scatter_is_exact():
    rng = np.random.default_rng(2)
    y = rng.integers(-1000, 1000, (300, 4))
    y[7] = 1 << 40
    y[8] = -(1 << 33) + 1
    assert (whitening.scatter(y) == y.astype(object).T @ y.astype(object)).all()


def test_covariance_of_far_values(spark):
    rows = [(i, [1e6 + (i % 5) / 1024, float(i)], 0) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = whitening.whiten(df, components=2).collect()
    x = np.array([[int(np.floor(1024 * c)) + 100_000 for c in r[1]] for r in rows])
    deviation, e, _, trace = brute_whitening(x, 2)
    assert [r["deviation"] for r in sorted(got, key=lambda r: r["id"])] == list(deviation)
    assert np.allclose(got[0]["explained"], e / trace, rtol=1e-6)


def test_whitening_awkward(spark):
    df = spark.createDataFrame(odd_rows(6), VECTORS).withColumns({"id": F.lit("x"), "n": F.lit(2), "v": F.lit(3), "w": F.lit(4)})
    got = whitening.whiten(df).collect()
    assert sorted((r["id"] is None, r["id"] or 0) for r in got) == [(False, 7), (False, 7), (False, 8), (True, 0)]
    assert all(len(r["w"]) == 6 and r["w"][0] is not None and r["w"][1:] == [None] * 5 for r in got)  # all lie on a line
    assert got[0]["identity_error"] < 1e-9
    one = whitening.whiten(df.filter("vec_id = 8")).collect()
    assert one[0]["w"] == [None] * 6 and one[0]["identity_error"] is None and one[0]["deviation"] == 0
    huge = whitening.whiten(spark.createDataFrame([(1, [1e30, 0.0]), (2, [-1e30, 1.0])], "vec_id long, embedding array<double>"))
    assert [r["deviation"] for r in huge.collect()] == [None, None]


# 13


def brute_lines(texts, min_docs, min_chars):
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for t in texts:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] = held.get(k, 0) + 1
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(keep), "\n".join(keep)))
    return sorted(out)


def random_texts(n, seed):
    rng = np.random.default_rng(seed)
    pool = ["Share this", " share THIS\r", "é" * 3, "É" * 3, "", "  ", "a", "A\t", "\x0b\x0cend of page", "x" * 300, "X" * 300 + " ", " a", *(f"line {i}" for i in range(30))]
    return ["\n".join(pool[i] for i in rng.integers(0, len(pool), rng.integers(0, 12))) for _ in range(n)] + [None, "", "\n", "\n\n", "a\n", "\na", "a"]


@pytest.mark.parametrize("most", [1, 3, line_dedup.MOST])
@pytest.mark.parametrize(("min_docs", "min_chars"), [(3, 1), (10, 4), (2, 0)])
def test_lines_against_brute_force(spark, most, min_docs, min_chars):
    texts = random_texts(60, min_docs)
    df = spark.createDataFrame([(i % 50, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = line_dedup.drop_common_lines(df, min_docs=min_docs, min_chars=min_chars, most=most).collect()
    assert sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == brute_lines(texts, min_docs, min_chars)


def test_lines_in_small_steps(monkeypatch):
    import pyarrow as pa

    from canvass.llm import common

    texts = random_texts(40, 9)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["row", "text"])
    b, o = common.flat_text(batch.column(1))
    key, n = line_dedup.Lines(b, o, 1).keys()
    known = line_dedup.Known(key["a"][n >= 5], key["b"][n >= 5])
    monkeypatch.setattr(line_dedup, "steps", lambda o: common.steps(o, 64))
    got = [(r["n_lines"], r["n_dropped"], r["kept"]) for out in line_dedup._kept(1, known, False)(iter([batch])) for r in out.to_pylist()]
    assert sorted(got) == brute_lines(texts, 5, 1)


def test_keys_with_equal_halves():
    known = line_dedup.Known(np.array([5, 5, 9], np.uint64), np.array([1, 3, 2], np.uint64))
    key = np.array([(5, 3), (5, 2), (9, 2), (5, 1), (10, 0), (0, 0)], line_dedup.KEY)
    assert known.has(key).tolist() == [True, False, True, True, False, False]


@pytest.mark.parametrize("most", [1, line_dedup.MOST])
def test_lines_awkward(spark, most):
    df = awkward(spark).withColumns({"row": F.lit(1), "uid": F.lit(2), "a": F.lit(3), "n_lines": F.lit(4), "place": F.lit(5)})
    rows = df.collect()
    got = line_dedup.drop_common_lines(df, min_docs=2, most=most).collect()
    assert sorted((r["n_lines"], r["n_dropped"], r["kept"]) for r in got) == brute_lines([r["text"] for r in rows], 2, 1)
    assert sorted(map(repr, (r["row"]["doc_id"] for r in got))) == sorted(map(repr, (r["doc_id"] for r in rows)))
    assert line_dedup.drop_common_lines(empty(spark), most=most).count() == 0
    assert line_dedup.drop_common_lines(df.select("text"), min_docs=2, most=most).count() == len(rows)
