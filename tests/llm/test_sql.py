"""Queries of the subpackage against SQL, and the pipeline against its stages' brute-force rules."""

import duckdb
import pytest
from pyspark.sql import functions as F

from canvass.llm import entries, mixing
from tests.llm.test_operators import brute_components

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entries.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in ("pages", "embeddings", "documents"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entries.queries()[name](spark, SF)
    want = con.sql(entries.oracle_sql()[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(repr, (tuple(r) for r in df.collect()))) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def stages(spark, docs, sf_dir):
    """What each stage of the pipeline returns, by name."""
    import corpus_pipeline as p

    out = {}
    for name, stage in p.STAGES:
        docs = out[name] = spark.createDataFrame(stage(spark, docs, sf_dir).collect(), stage(spark, docs, sf_dir).schema)
    return out


def test_pipeline_on_awkward_and_empty_tables(spark, tmp_path):
    from tests.llm.test_operators import awkward

    docs = awkward(spark).withColumns({"row": F.lit(1), "key": F.lit(2), "copies": F.lit(3), "uid": F.lit(4), "i": F.lit(5)})
    spark.read.parquet(f"{SF}/labels.parquet").filter("false").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (docs, docs.filter("false")):
        got = stages(spark, rows, str(tmp_path))
        for name in ("quality", "near_duplicates", "repeats", "mixture"):
            assert got[name].columns == rows.columns, name
        assert got["quality"].count() == rows.count()  # nothing is known against any
        assert all(r["decodes"] for r in got["encoding"].collect())
        if not rows.isEmpty():
            assert sorted(r["doc_id"] for r in got["near_duplicates"].collect()) == [1, 3, 4, 5, 6, 7, 9]
            assert got["repeats"].count() == 7


def test_equal_rows_of_the_mix_are_dealt_together(spark):
    import corpus_pipeline as p

    rows = [(1, "a b c", "en", "s", 5)] * 3 + [(None, "d e", "en", "s", 3)] * 2 + [(i, "x y", "en", "t", 3) for i in range(2, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    size = lambda df: {r["source"]: r["w"] for r in df.groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("w")).collect()}
    got = p.mixture(spark, docs, SF)
    thin = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    whole = mixing.mix(thin, F.col("words"), F.array("source")).groupBy("source").agg(F.sum("taken").alias("w"))
    assert size(got) == {r["source"]: r["w"] for r in whole.collect()}
    assert {tuple(r) for r in got.collect()} <= {tuple(r) for r in docs.collect()}


def test_repeats_catch_passages_of_fifty_words(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(8)
    words = lambda n: [rng.choice("abcdefghij") + "".join(rng.choice("klmnopqrs") for _ in range(rng.randint(1, 8))) for _ in range(n)]
    passages = [" ".join(words(51)) for _ in range(20)]
    rows = [(i, " ".join(words(120)) + " " + passages[i % 20] + " " + " ".join(words(80)), "en", "s", 1) for i in range(60)]
    clean = [(100 + i, " ".join(words(200)), "en", "s", 1) for i in range(40)]
    docs = spark.createDataFrame(rows + clean, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r["doc_id"]: r["text"] for r in p.repeats(spark, docs, SF).collect()}
    caught = [passages[i % 20] not in got[i] and len(got[i]) < len(t) - 200 for i, t, *_ in rows]
    assert sum(caught) >= 0.9 * len(caught)
    assert all(got[i] == t for i, t, *_ in clean)


def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in p.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, SF).cache()
        after = docs.collect()
        if name != "encoding":
            assert docs.columns == columns
        kept = {r["doc_id"] for r in after}
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            wrong = [i for i, y in labels.items() if (i in kept) != (y == 1)]
            assert len(wrong) <= 0.05 * len(labels)
        elif name == "near_duplicates":
            assert kept == {c for _, _, c in brute_components([(r["doc_id"], r["text"]) for r in before])}
        elif name == "repeats":
            assert len(after) == len(before) and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "mixture":
            assert kept <= {r["doc_id"] for r in before}
            assert {tuple(r) for r in after} <= {tuple(r) for r in before}
        else:
            assert len(after) == len(before) and all(r["decodes"] for r in after)
