"""Asking once, limits, numbered lines, publishing, progress and jobs."""

import contextlib
import json
import os
import random
import re
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from canvass.errors import DataError, EnvironmentFault, TransportError
from canvass.operators import relational
from canvass.plans import batching, jobs, simulation
from canvass.plans.bundle import from_records
from canvass.sources import publish, readers

RECORDS = "id string, demographics map<string,string>, persona_text string, questions array<struct<id:string,prompt:string,options:array<string>,kind:string,gold:string>>"


def ids_of(user):
    return re.findall(r"(?m)^question_id: (\S+)$", user)


def people(spark, n=10, questions=4):
    ask = [(f"q{i}", f"Question {i}?", ["a", "b"], "multiple_choice", "a") for i in range(questions)]
    return from_records(spark.createDataFrame([(f"p{i}", {"age": "40"}, f"Card {i}", ask) for i in range(n)], RECORDS), "twin2k_500")


def counting(folder):
    """A provider that leaves a file for each call and answers at random."""

    def told(system, user):
        open(f"{folder}/{uuid.uuid4().hex}", "w").close()
        return json.dumps({"answers": [{"question_id": q, "answer": random.random()} for q in ids_of(user)]})

    return told


def test_a_batch_is_asked_once(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    run = simulation.simulate(simulation.packages(people(spark), "fixed_text"), counting(calls), model="m", size=3)
    rows = run.results.collect()
    assert len(rows) == 40 and run.cache.count() == 20 and run.failed.count() == 0
    assert run.results.count() == 40 and len(os.listdir(calls)) == 20  # p x ceil(4 / 3), whatever is read how often
    for r in rows:
        said = {a["question_id"]: a["answer"] for a in json.loads(r["raw"])["answers"]}
        assert float(r["answer"]) == said[r["question_id"]]
    kept = {r["raw"] for r in run.cache.collect()}
    assert kept == {r["raw"] for r in rows}


def test_a_log_answers_what_was_asked_before(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    asked, log = simulation.packages(people(spark), "fixed_text"), str(tmp_path / "log")
    first = simulation.simulate(asked, counting(calls), model="m", size=4, log=log).results.collect()
    again = simulation.simulate(asked, counting(calls), model="m", size=4, log=log).results.collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and len(os.listdir(calls)) == 10
    simulation.simulate(asked, counting(calls), model="other", size=4, log=log)
    assert len(os.listdir(calls)) == 20


def test_waits_of_retries_do_not_grow_with_the_batches(spark, tmp_path):
    def down(system, user):
        open(f"{tmp_path}/{uuid.uuid4().hex}", "w").close()
        raise TransportError("no route")

    batches = batching.pack(simulation.packages(people(spark, 300, 1), "fixed_text"), 1).coalesce(1)
    began = time.monotonic()
    assert {r["failure"] for r in batching.ask(batches, down).collect()} == {"no route"}
    assert len(os.listdir(tmp_path)) == 300 * batching.ATTEMPTS  # each is tried as often as before
    assert time.monotonic() - began < 300 * 3 * batching.PAUSE / batching.Limits().in_flight / 2


def test_a_log_has_a_file_for_a_task_and_leaves_out_cut_lines(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    asked, log = simulation.packages(people(spark), "fixed_text"), tmp_path / "log"
    ask = lambda: {r["key"]: r["raw"] for r in batching.ask(batching.pack(asked, 4).withColumn("key", F.col("subject_id")).coalesce(2), counting(tmp_path / "calls"), log=str(log)).collect()}
    first = ask()
    files = [f for f in log.rglob("*") if f.is_file() and not f.name.startswith(".")]
    assert len(files) <= 2 and len(os.listdir(tmp_path / "calls")) == 10
    whole = files[0].read_text().splitlines(True)
    files[0].write_text("".join(whole[:-1]) + whole[-1][: len(whole[-1]) // 2])
    (log / f".{files[0].name}.crc").unlink(missing_ok=True)
    again = ask()
    lost = json.loads(whole[-1])["key"]
    assert {k for k in first if again[k] != first[k]} == {lost} and len(os.listdir(tmp_path / "calls")) == 11


def test_a_task_holds_several_requests(spark, tmp_path):
    asked = simulation.packages(people(spark, 24, 1), "fixed_text")
    batches = batching.pack(asked, 1).coalesce(1)

    def slow(system, user):
        time.sleep(0.25)
        return "{}"

    batches.cache().count()
    began = time.monotonic()
    assert batching.ask(batches, slow, batching.Limits(in_flight=12)).count() == 24
    assert batching.ask(batches, slow, batching.Limits(in_flight=12)).filter("raw = '{}'").count() == 24
    assert time.monotonic() - began < 24 * 0.25 * 2


def test_bucket_keeps_its_rate():
    clock = [0.0]
    slept = []

    def sleep(s):
        slept.append(s)
        clock[0] += s

    b = batching.Bucket(4.0, lambda: clock[0], sleep)
    for _ in range(20):
        b.take()
    assert clock[0] == pytest.approx(4.0)  # four at once, then four a second
    clock[0] += 100
    before = clock[0]
    for _ in range(4):
        b.take()
    assert clock[0] == before
    free = batching.Bucket(None, lambda: clock[0], sleep)
    n = len(slept)
    free.take()
    assert len(slept) == n


def test_retries_take_tokens_and_failures_stay_apart(spark):
    def half(system, user):
        if "Card 3" in user:
            raise TransportError("no route")
        return json.dumps({"answers": [{"question_id": q, "answer": 1} for q in ids_of(user)]})

    run = simulation.simulate(simulation.packages(people(spark, 5), "fixed_text"), half, model="m", size=4, limits=batching.Limits(2, 100.0))
    assert [r["subject_id"] for r in run.failed.collect()] == ["p3"] and run.results.select("subject_id").distinct().count() == 4


@pytest.mark.parametrize("size", [20, 97, 1 << 20])
def test_lines_are_numbered_over_blocks(spark, tmp_path, size):
    rng = random.Random(2)
    for name in ("a", "b"):
        lines = ["x" * rng.randint(0, 30) if rng.random() < 0.8 else "" for _ in range(300)]
        (tmp_path / f"{name}.txt").write_text("".join(x + rng.choice(["\n", "\r\n"]) for x in lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        got = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    for name in ("a", "b"):
        mine = sorted((r["line"], r["value"]) for r in got if r["file"].endswith(f"{name}.txt"))
        assert mine == list(enumerate((tmp_path / f"{name}.txt").read_text().splitlines(), 1))


def test_strict_and_lenient_lines(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1}\n\n[2]\n{"a": \n{"a": 5}\n')
    with pytest.raises(Exception, match=r"x\.jsonl:(3: not a JSON object: \[2\]|4: not JSON: )"):
        readers.read_jsonl(spark, str(p), "a int").collect()
    assert [r["a"] for r in readers.read_jsonl(spark, str(p), "a int", limit=1).collect()] == [1]
    good, bad = readers.read_lenient(spark, str(p), "a int")
    assert sorted((r["line"], r["a"]) for r in good.collect()) == [(1, 1), (5, 5)]
    assert sorted((r["line"], r["reason"]) for r in bad.collect()) == [(3, "not a JSON object"), (4, "not JSON")]
    stream = spark.readStream.schema("value string").text(str(tmp_path))
    for i, part in enumerate(readers.sorted_out(stream, "a int")):
        part.writeStream.format("memory").queryName(f"sorted{i}").trigger(availableNow=True).start().awaitTermination()
    assert {r["a"] for r in spark.table("sorted0").collect()} == {1, 5}
    assert {r["reason"] for r in spark.table("sorted1").collect()} == {"not a JSON object", "not JSON"}


@pytest.mark.parametrize("placed", [True, False])
def test_the_first_record_wins_however_rows_are_dealt(spark, tmp_path, placed):
    rows = [{"id": f"p{i % 5}", "persona_text": f"card {i}", "questions": [{"id": "q", "prompt": f"version {i}?", "kind": "text"}]} for i in range(40)]
    (tmp_path / "r.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    records = readers.read_jsonl(spark, str(tmp_path), RECORDS, place="ord" if placed else None)
    seen = []
    for n in (1, 7, 50):
        b = from_records(records.repartition(n), "twin2k_500")
        seen.append(sorted((r["subject_id"], r["persona_text"]) for r in b.subjects.collect()))
        assert b.questions.count() == 40 and b.asked().count() == 40  # each its own wording
    assert seen[0] == seen[1] == seen[2]
    if placed:
        assert seen[0] == [(f"p{i}", f"card {i}") for i in range(5)]


def test_persons_are_asked_their_own_question(spark):
    one = lambda i, product, price: (i, {}, "Card", [("buy", f"Buy {product} at {price}?", [product, "skip"], "multiple_choice", "skip")])
    b = from_records(spark.createDataFrame([one("1", "A", "1.50"), one("2", "B", "7.25"), one("3", "B", "7.25")], RECORDS), "twin2k_500")
    assert b.questions.count() == 2
    asked = {r["subject_id"]: (r["prompt"], r["options"]) for r in simulation.packages(b, "fixed_text").collect()}
    assert asked == {"1": ("Buy A at 1.50?", ["A", "skip"]), "2": ("Buy B at 7.25?", ["B", "skip"]), "3": ("Buy B at 7.25?", ["B", "skip"])}


def test_publishing(spark, tmp_path):
    path = str(tmp_path / "store")
    with pytest.raises(EnvironmentFault):
        publish.read_published(spark, path, "t")
    assert publish.publish({"t": spark.range(5)}, path, source="one") == 1
    with pytest.raises(Exception, match="died"):
        publish.publish({"t": spark.range(9), "u": spark.range(3).withColumn("x", F.raise_error(F.lit("died")).cast("string"))}, path)
    assert publish.versions(spark, path) == [1] and publish.read_published(spark, path, "t").count() == 5
    assert publish.publish({"t": spark.range(7)}, path) == 2
    assert publish.read_published(spark, path, "t").count() == 7 and publish.read_published(spark, path, "t", 1).count() == 5
    assert publish.lock_of(spark, path, 1)[1]["source"] == "one"
    with pytest.raises(DataError, match="no table u"):
        publish.read_published(spark, path, "u")
    folder = tmp_path / "store" / "v00000002"
    part = next(p for p in (folder / "t").iterdir() if p.name.startswith("part-"))
    extra = folder / "t" / "part-extra.parquet"
    extra.write_bytes(part.read_bytes())
    with pytest.raises(DataError, match="extra"):
        publish.read_published(spark, path, "t")
    extra.unlink()
    lock = (folder / "lock.json").read_text()
    (folder / ".lock.json.crc").unlink()  # a local file system would notice by itself
    (folder / "lock.json").write_text(lock.replace('"tables"', '"table5"'))
    with pytest.raises(DataError, match="was changed"):
        publish.read_published(spark, path, "t")
    (folder / "lock.json").unlink()
    with pytest.raises(DataError, match="no lock"):
        publish.read_published(spark, path, "t")


def test_two_writers_take_two_numbers(spark, tmp_path):
    path, got = str(tmp_path / "store"), []
    threads = [threading.Thread(target=lambda i=i: got.append((publish.publish({"t": spark.range(i)}, path), i))) for i in (3, 4, 5)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in got) == [1, 2, 3]
    assert all(publish.read_published(spark, path, "t", v).count() == i for v, i in got)


def test_progress_grows_while_tasks_run(spark, tmp_path):
    asked = simulation.packages(people(spark, 12, 2), "fixed_text")
    batches = batching.pack(asked, 1).repartition(12)
    assert jobs.batches_of(asked, 1) == 24 and jobs.batches_of(asked, 15) == 12
    seen, path = [], str(tmp_path / "progress.json")

    def slow(system, user):
        time.sleep(0.3)
        if "Card 5\n" in user:
            raise TransportError("gone")
        return "{}"

    with jobs.Progress(spark, path, 24, every=0.1) as p:
        told = batching.ask(batches, p.counted(slow), batching.Limits(1))
        t = threading.Thread(target=lambda: told.count())
        t.start()
        while t.is_alive():
            with contextlib.suppress(FileNotFoundError):  # a local file is replaced in two steps
                seen.append(json.loads(open(path).read())["done"])
            time.sleep(0.05)
        t.join()
    last = json.loads(open(path).read())
    assert len(set(seen)) > 3 and seen == sorted(seen)
    assert last["done"] == 22 and last["failed"] >= 2 and last["left"] == 0


def test_a_grid_of_jobs_resumes(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    down = [True]
    grid = jobs.grid(str(tmp_path / "out"), ["x", "y"], ["fixed_text"], ["a", "b", "c"], size=2)

    def call_of(model):
        if model == "c" and down[0]:

            def broken(system, user):
                if "Card 1\n" in user:
                    raise TransportError("no route")
                return counting(calls)(system, user)

            return broken
        return counting(calls)

    def bundle_of(name):
        return people(spark, 3 if name == "x" else 2)

    first = {(r["dataset"], r["model"]): r["state"] for r in jobs.run_jobs(spark, grid, bundle_of, call_of).collect()}
    assert first == {(d, m): "batch_errors" if m == "c" else "responses" for d in "xy" for m in "abc"}
    n = len(os.listdir(calls))
    down[0] = False
    second = {(r["dataset"], r["model"]): r["state"] for r in jobs.run_jobs(spark, grid, bundle_of, call_of).collect()}
    assert second == {(d, m): "responses" if m == "c" else "complete" for d in "xy" for m in "abc"}
    assert len(os.listdir(calls)) == n + 4  # the two batches of one person in either survey
    odd = jobs.run_jobs(spark, [jobs.Job("z", "fixed_text", "a", str(tmp_path / "z"))], lambda name: 1 / 0, call_of).first()
    assert odd["state"] == "failed" and "ZeroDivisionError" in odd["reason"]


def test_leaks_in_a_long_text(spark):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(20_000)]
    needles = [" ".join(words[700:712]), words[19_990], "x" + words[5], "not there at all, that is", None, "", f"{words[3]} {words[4]}"]
    texts = spark.createDataFrame([(1, " ".join(words)), (2, None), (3, f"({needles[0]})"), (4, "")], "doc long, text string")
    found = relational.contained(texts, spark.createDataFrame(list(enumerate(needles)), "n long, needle string"), "text", "needle")
    began = time.monotonic()
    got = sorted((r["doc"], r["n"]) for r in found.collect())
    assert time.monotonic() - began < 60
    want = sorted((i, n) for i, t in ((1, " ".join(words)), (3, f"({needles[0]})")) for n, x in enumerate(needles) if x and x in t)
    assert got == want and (1, 0) in got and (3, 0) in got
    assert relational.contained(texts, spark.createDataFrame([(1, "")], "n long, needle string"), "text", "needle").count() == 0
