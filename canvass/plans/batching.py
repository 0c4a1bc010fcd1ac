"""Questions to batches, batches to replies, replies to one row for each question."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSelector
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from canvass.errors import TransportError
from canvass.functions.jsonx import reply_object
from canvass.functions.text import question_body
from canvass.operators.relational import chunks
from canvass.operators.sampling import contract
from canvass.sources.files import open_fs
from canvass.sources.publish import _fs

# Fixed instruction texts of the request protocol.
ANSWER_SYSTEM = (
    "You answer as the person described in the persona. Stay consistent with that description. Reply with JSON only, using this schema and no other text: "
    '{"answers": [{"question_id": "...", "answer": "...", "rationale": "..."}]}. Include one object for every question_id.'
)
DISTRIBUTION_SYSTEM = (
    "You simulate the response distribution of the described group. Do not invent an individual respondent. Reply with JSON only, using this schema and no other text: "
    '{"answers": [{"question_id": "...", "distribution": {"option": 0.5}, "rationale": "..."}]}. Weights are non-negative and sum to 1. Include one object for every question_id.'
)
ATTEMPTS, PAUSE = 3, 0.2


def pack(packages: DataFrame, size: int, outer: bool = False, system: str | None = None) -> DataFrame:
    """(subject_id, chunk, question_ids, system, user) of packages (subject_id, ord, question_id, persona, prompt, options, kind, response_mode); `system` takes the place of the instruction to answer."""
    body = question_body(F.col("prompt"), F.col("options"))
    lead = F.concat(F.lit("question_id: "), F.col("question_id"), F.lit("\n"))
    if outer:
        lead = F.concat(lead, F.lit("response: "), contract(F.col("options"), F.col("kind")), F.lit("\n"))
    cut = chunks(packages.withColumn("block", F.concat(lead, body)), "subject_id", ["ord"], size)
    rows = F.array_sort(F.collect_list(F.struct("ord", "question_id", "block")))
    out = cut.groupBy("subject_id", "chunk").agg(rows.alias("rows"), F.min("persona").alias("persona"), F.max("persona").alias("other"), F.min("response_mode").alias("mode"))
    ids = F.transform("rows", lambda r: r["question_id"])
    wrong = F.when(F.col("persona") != F.col("other"), "a batch must share one persona").when(F.size(F.array_distinct(ids)) < F.size(ids), "duplicate question_id in batch")
    user = F.concat(F.lit("Persona:\n\n"), F.col("persona"), F.lit("\n\nQuestions:\n\n"), F.array_join(F.transform("rows", lambda r: r["block"]), "\n\n"))
    system = F.when(F.col("mode") == "distribution", DISTRIBUTION_SYSTEM).otherwise(ANSWER_SYSTEM if system is None else system)
    return out.select("subject_id", "chunk", ids.alias("question_ids"), F.col("mode").alias("response_mode"), F.when(wrong.isNotNull(), F.raise_error(wrong)).otherwise(system).alias("system"), user.alias("user"))


def cache_key(provider: str, model: str, *columns: str) -> Column:
    """A hash of all that decides a reply; no secret is among it."""
    return F.sha2(F.to_json(F.struct(F.lit(provider).alias("provider"), F.lit(model).alias("model"), *columns)).cast("binary"), 256)


def with_retry(call: Callable[[str, str], str], attempts: int = ATTEMPTS, pause: float = PAUSE) -> Callable[[str, str], str]:
    """call, tried again after transport errors, waiting twice as long each time."""

    def tried(system: str, user: str) -> str:
        for i in range(attempts):
            try:
                return call(system, user)
            except TransportError:
                if i + 1 == attempts:
                    raise
                time.sleep(pause * 2**i)
        raise AssertionError

    return tried


@dataclass(frozen=True)
class Limits:
    """in_flight: requests that a task has open at once; per_second: requests that the job may begin, shared out among the tasks that can run at once; None is without limit."""

    in_flight: int = 4
    per_second: float | None = None


class Bucket:
    """Tokens of one task: one for each request, renewed at a steady rate, with room for one second's worth."""

    def __init__(self, rate: float | None, now: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.rate, self.now, self.sleep, self.lock = rate, now, sleep, threading.Lock()
        self.held, self.at = max(1.0, rate or 1.0), now()

    def take(self) -> None:
        if self.rate is None:
            return
        with self.lock:  # those that wait do so one after the other
            t = self.now()
            self.held = min(max(1.0, self.rate), self.held + (t - self.at) * self.rate)
            self.at = t
            if self.held < 1:
                self.sleep((1 - self.held) / self.rate)
                self.at += (1 - self.held) / self.rate
                self.held = 1.0
            self.held -= 1


class Log:
    """What one task has been told: a file of JSON lines, one for each reply, handed to the file system as replies come.

    Earlier tries of the task left their files beside it, whose whole lines are read first.
    """

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = open_fs(folder)
        self.out, self.lock, self.told = None, threading.Lock(), {}
        for f in self.fs.get_file_info(FileSelector(self.folder, allow_not_found=True)):
            with self.fs.open_input_stream(f.path) as lines:
                for line in lines.read().split(b"\n")[:-1]:
                    x = json.loads(line)
                    self.told[x["key"]] = x["raw"]

    def add(self, key: str, raw: str) -> None:
        with self.lock:
            if self.out is None:
                self.fs.create_dir(self.folder, recursive=True)
                self.out = self.fs.open_output_stream(f"{self.folder}/{uuid.uuid4().hex}.jsonl")
            self.out.write(json.dumps({"key": key, "raw": raw}).encode() + b"\n")
            self.out.flush()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()


def log_of(spark: SparkSession, log: str) -> DataFrame | None:
    """(key, raw) of the logs of earlier runs, a line that was cut short left out; None if there are none."""
    fs, p = _fs(spark, log)
    if not fs.exists(p):
        return None
    lines = spark.read.schema("key string, raw string").option("recursiveFileLookup", True).json(log)
    return lines.filter("key is not null and raw is not null").groupBy("key").agg(F.min("raw").alias("raw"))


def in_rounds(n: int, begin: Callable[[int], str], pool: ThreadPoolExecutor, attempts: int = ATTEMPTS, pause: float = PAUSE) -> list[tuple[str | None, str | None]]:
    """(reply, failure) of n rows, several at a time. Those that meet a transport error are all tried again after one wait, twice as long each time, so waits don't grow with the rows."""

    def one(i: int) -> tuple[str | None, str | None]:
        try:
            return begin(i), None
        except TransportError as error:
            return None, str(error)

    said, left = [(None, None)] * n, list(range(n))
    for attempt in range(attempts):
        if attempt:
            time.sleep(pause * 2 ** (attempt - 1))
        for i, x in zip(left, pool.map(one, left), strict=True):
            said[i] = x
        left = [i for i in left if said[i][1] is not None]
        if not left:
            break
    return said


def ask(batches: DataFrame, call: Callable[[str, str], str], limits: Limits | None = None, log: str | None = None) -> DataFrame:
    """batches with `raw` and `failure`. Each task calls the provider for its own rows, several at a time; one batch that fails leaves the others be.

    log: a shared folder with a file for each task, of replies by the batches'
    `key`. A task that is tried again reads what it has been told before; what
    earlier runs were told is joined.
    """
    limits = limits or Limits()
    spark = batches.sparkSession
    schema = T.StructType([*batches.schema.fields, T.StructField("raw", T.StringType()), T.StructField("failure", T.StringType())])
    rate = None if limits.per_second is None else limits.per_second / max(1, spark.sparkContext.defaultParallelism)
    before = None if log is None else log_of(spark, log)
    known = batches.withColumn("__known", F.lit(None).cast("string")) if before is None else batches.join(before.withColumnRenamed("raw", "__known"), "key", "left").select(*batches.columns, "__known")
    mine = None if log is None else f"{log}/{uuid.uuid4().hex}"

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = Bucket(rate)
        book = None if mine is None else Log(f"{mine}/{TaskContext.get().partitionId()}")
        try:
            with ThreadPoolExecutor(limits.in_flight) as pool:
                for batch in frames:
                    names = batch.schema.names[:-1]
                    keys = batch.column("key").to_pylist() if "key" in names else [""] * batch.num_rows
                    system, user, old = (batch.column(c).to_pylist() for c in ("system", "user", "__known"))
                    if book is not None:
                        old = [book.told.get(k) if x is None else x for k, x in zip(keys, old, strict=True)]

                    def begin(i: int) -> str:
                        if old[i] is not None:
                            return old[i]
                        bucket.take()
                        reply = call(system[i], user[i])
                        if book is not None:
                            book.add(keys[i], reply)
                        return reply

                    said = in_rounds(batch.num_rows, begin, pool)
                    raw, failure = ([x[i] for x in said] for i in range(2))
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(raw, pa.string()), pa.array(failure, pa.string())], [*names, "raw", "failure"])
        finally:
            if book is not None:
                book.close()

    return known.mapInArrow(run, schema)


def with_cache(batches: DataFrame, cache: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(batches whose reply is in the cache, batches to ask)."""
    known = cache.select(key, "raw")
    return batches.join(known, key), batches.join(known, key, "left_anti")


def listed(raw: Column) -> Column:
    """The answers of a reply, each as JSON text, in order."""
    return F.transform(F.try_variant_get(F.try_parse_json(reply_object(raw)["json"]), "$.answers", "array<variant>"), lambda v: F.to_json(v))


def answers(replies: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row for each question asked: (subject_id, chunk, question_id, answer as JSON, error), and columns of the reply.

    A question that the reply names twice has its last answer; one that it
    does not name has an error.
    """
    parsed = replies.withColumn("reply", reply_object(F.col("raw")))
    listed = F.try_variant_get(F.try_parse_json("reply.json"), "$.answers", "array<variant>")
    asked = parsed.withColumn("items", listed).select("subject_id", "chunk", "response_mode", F.posexplode("question_ids").alias("pos", "question_id"), "items", F.col("reply.error").alias("bad"), *keep)
    name = lambda v: F.try_variant_get(v, "$.question_id", "string")
    mine = F.element_at(F.filter("items", lambda v: name(v) == F.col("question_id")), -1)
    rows = asked.withColumn("item", F.when(F.size(F.filter("items", lambda v: name(v) == F.col("question_id"))) > 0, F.to_json(mine)))
    field = F.when(F.col("response_mode") == "distribution", F.lit("distribution")).otherwise(F.lit("answer"))
    value = F.when(F.col("response_mode") == "distribution", F.get_json_object("item", "$.distribution")).otherwise(F.get_json_object("item", "$.answer"))
    error = (
        F.when(F.col("bad").isNotNull(), F.col("bad"))
        .when(F.col("items").isNull(), "batch JSON is missing answers")
        .when(F.col("item").isNull(), F.concat(F.lit("missing question_id "), F.col("question_id")))
        .when(value.isNull(), F.concat(F.col("question_id"), F.lit(" is missing "), field))
    )
    return rows.select("subject_id", "chunk", "pos", "question_id", F.when(error.isNull(), value).alias("answer"), error.alias("error"), *keep)


def clean_batches(results: DataFrame) -> DataFrame:
    """Batches of which every question was answered: those that go to the cache."""
    return results.groupBy("subject_id", "chunk").agg(F.count_if(F.col("error").isNotNull()).alias("bad")).filter("bad = 0").drop("bad")


def mock_reply(question_ids: Column, options: Column | None = None) -> Column:
    """The reply of the provider of tests: mock to all, or even shares of the options."""
    if options is None:
        return F.to_json(F.struct(F.transform(question_ids, lambda q: F.struct(q.alias("question_id"), F.lit("mock").alias("answer"), F.lit("mock reply").alias("rationale"))).alias("answers")))
    even = F.map_from_arrays(options, F.transform(options, lambda o: F.lit(1.0) / F.size(options)))
    return F.to_json(F.struct(F.transform(question_ids, lambda q: F.struct(q.alias("question_id"), even.alias("distribution"))).alias("answers")))
