"""Reply store and fetched data sets."""

import threading

import pytest

from canvass.errors import DataError, EnvironmentFault
from canvass.plans import fetching, report
from canvass.sources.replies import ReplyStore


def pairs(spark, lo, hi, say="r"):
    return spark.createDataFrame([(f"k{i}", f"{say}{i}") for i in range(lo, hi)], "key string, raw string")


def known(store, keys):
    return {r["key"]: r["raw"] for r in store.look_up(keys).collect()}


def test_replies_of_two_jobs_stay(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "s"), buckets=4)
    keys = spark.createDataFrame([(f"k{i}",) for i in range(50)], "key string")
    assert set(known(store, keys).values()) == {None} and store.compact() == 0
    threads = [threading.Thread(target=lambda i=i: store.add(pairs(spark, 10 * i, 10 * i + 10))) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    want = {f"k{i}": f"r{i}" if i < 30 else None for i in range(50)}
    assert known(store, keys) == want
    assert store.compact() == 1 and store.additions() == [] and known(store, keys) == want
    store.add(pairs(spark, 25, 35))  # five of them again
    want |= {f"k{i}": f"r{i}" for i in range(30, 35)}
    assert known(store, keys) == want
    assert store.compact() == 2 and known(ReplyStore(spark, str(tmp_path / "s"), buckets=4), keys) == want
    (tmp_path / "s" / "added" / "half").mkdir()  # a writer that has not come to its end
    assert store.additions() == []


def test_look_ups_leave_the_bulk_where_it_lies(spark, tmp_path):
    store = ReplyStore(spark, str(tmp_path / "s"), buckets=4)
    store.add(pairs(spark, 0, 30))
    store.compact()
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = store.look_up(spark.createDataFrame([("k1",)], "key string"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange") == 1 and "Bucketed: true" in plan  # the batches' side alone


def test_fetching(spark, tmp_path):
    store, source = str(tmp_path), {"twin2k_500": fetching.Source({"p": lambda: spark.range(7), "o": lambda: spark.read.parquet("/no/such")}, ["o"], {"p": 7})}
    with pytest.raises(EnvironmentFault, match="run: fetch twin2k_500"):
        fetching.load(spark, store, "twin", "p")
    got = sorted(map(tuple, fetching.fetch(spark, store, ["twin", "twin2k"], source).collect()))
    assert got == [("twin2k_500", "o", 0, "skipped"), ("twin2k_500", "p", 7, "fetched")]
    assert fetching.load(spark, store, "TWIN", "p").count() == 7
    facts = fetching.manifest(spark, store, "twin")
    assert facts["rows"] == {"p": 7} and facts["skipped"] == ["o"] and facts["limit"] is None
    wrong = {"twin2k_500": fetching.Source({"p": lambda: spark.range(6)}, (), {"p": 7})}
    with pytest.raises(DataError, match="p has 6 rows, not 7"):
        fetching.fetch(spark, store, ["twin"], wrong)
    assert fetching.load(spark, store, "twin", "p").count() == 7  # what was there stays
    assert fetching.fetch(spark, store, ["twin"], wrong, limit=3).first()["rows"] == 3
    with pytest.raises(DataError, match="no source"):
        fetching.fetch(spark, store, ["sim"], source)


def test_older_scores(spark):
    table, older = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "m string, x double"), spark.createDataFrame([("a", 3.0)], "m string, x double")
    assert sorted(map(tuple, report.with_older(table, older, ["m"], ["x"]).collect())) == [("a", 1.0, 3.0), ("b", 2.0, None)]
    with pytest.raises(DataError):
        report.with_older(table, older.union(older), ["m"], ["x"])
