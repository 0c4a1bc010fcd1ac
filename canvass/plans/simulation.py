"""The run of a survey: packages, batches, cached and new replies, outer draws, results, and what is left to do."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions import let
from canvass.functions.text import strip
from canvass.operators.relational import attach
from canvass.operators.sampling import by_shares, clamp_prob, contract, outer_choice, outer_price, stratified_draw
from canvass.plans import batching
from canvass.plans.builders import adapted, refuse_expansion
from canvass.plans.bundle import Bundle
from canvass.plans.cards import life_cards, tendency_cards
from canvass.session import shared_dir
from canvass.sources.publish import write_text
from canvass.sources.replies import ReplyStore
from canvass.sources.writers import write_jsonl


def group_persona(subjects: DataFrame) -> DataFrame:
    return subjects.select("subject_id", strip(F.col("persona_text")).alias("persona"))


def expanded(subjects: DataFrame, seed: int) -> DataFrame:
    """Life histories of subjects, with the day of those that have one."""
    if "routine" not in subjects.columns:
        subjects = subjects.withColumn("routine", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    known = refuse_expansion("", "individual", subjects)
    return life_cards(known.withColumn("demographics", adapted(F.col("demographics"))), seed).withColumnRenamed("text", "persona")


def inclined(subjects: DataFrame, seed: int) -> DataFrame:
    """Life histories with the person's tendencies below."""
    both = expanded(subjects, seed).join(tendency_cards(subjects), "subject_id")
    return both.select("subject_id", F.concat_ws("\n\n", "persona", "text").alias("persona"))


#: Ways to a persona: (subjects, seed) to (subject_id, persona), whether replies are drawn outside, and the kind of reply.
METHODS: dict[str, tuple[Callable[[DataFrame, int], DataFrame], bool, str]] = {
    "fixed_text": (lambda s, seed: group_persona(s), False, "answer"),
    "group": (lambda s, seed: group_persona(s), False, "distribution"),
    "atus_expanded": (expanded, False, "answer"),
    "atus_expanded_skill": (inclined, True, "answer"),
}


def method(name: str) -> tuple[Callable[[DataFrame, int], DataFrame], bool, str]:
    if name not in METHODS:
        raise DataError(f"unknown method {name}; use one of {sorted(METHODS)}")
    return METHODS[name]


def packages(bundle: Bundle, name: str, seed: int = 0, under: str = "") -> DataFrame:
    """A row for each case: (subject_id, ord, question_id, persona, prompt, options, kind, response_mode).

    under: instructions that follow every persona, as those of a skill do. An empty persona is an error.
    """
    make, _, mode = method(name)
    text = let(F.coalesce(strip(F.col("persona")), F.lit("")), lambda p: F.when(p == "", F.raise_error(F.concat(F.lit(f"{name} made an empty persona for "), F.col("subject_id")))).otherwise(F.concat_ws("\n\n", p, F.lit(under.strip() or None))))
    personas = make(bundle.subjects, seed).select("subject_id", text.alias("persona"))
    return bundle.asked().join(personas, "subject_id").select("subject_id", F.struct("ord", "pos").alias("ord"), "question_id", "persona", "prompt", "options", "kind", F.lit(mode).alias("response_mode"))


def outer_answer(answer: Column, reply: Column, kind: Column, options: Column, seed: int, person: Column, item: Column) -> Column:
    """(answer, error): draws by the probabilities of a reply where its question calls for them, else its answer."""
    p = F.get_json_object(reply, "$.buy_prob").try_cast("double")
    listed = F.from_json(F.get_json_object(reply, "$.probs"), "array<double>")
    named = F.from_json(F.get_json_object(reply, "$.probs"), "map<string,double>")
    weights = F.coalesce(F.when(F.size(named) > 0, F.transform(options, lambda o: F.coalesce(F.element_at(named, o), F.lit(0.0)))), listed)
    error = (
        F.when((kind == "pricing") & F.get_json_object(reply, "$.buy_prob").isNull(), F.concat(item, F.lit(" is missing buy_prob")))
        .when((kind == "pricing") & p.isNull(), F.concat(item, F.lit(" buy_prob is not a number")))
        .when((kind == "choice") & ~F.coalesce(F.size(weights) == F.size(options), F.lit(False)), F.concat(item, F.lit(" probs must match its options")))
        .when(kind.eqNullSafe(F.lit("direct")) & answer.isNull(), F.concat(item, F.lit(" is missing answer")))
    )
    drawn = F.when(kind == "pricing", outer_price(clamp_prob(p), seed, person, item)).when(kind == "choice", outer_choice(weights, options, seed, person, item)).otherwise(answer)
    return F.struct(F.when(error.isNull(), drawn).alias("answer"), error.alias("error"))


@dataclass(frozen=True)
class Run:
    """results: a row for each question asked; cache: replies to keep; failed: batches to try again."""

    results: DataFrame
    cache: DataFrame
    failed: DataFrame


def written(spark: SparkSession, path: str | None = None, name: str = "replies") -> Callable[[DataFrame], DataFrame]:
    """A function that writes a table, in the shared folder unless a path is given, and reads it back."""

    def cut(df: DataFrame) -> DataFrame:
        place = path or f"{shared_dir(spark)}/canvass/{name}-{uuid.uuid4().hex[:12]}"
        df.write.mode("overwrite").parquet(place)
        return spark.read.schema(df.schema).parquet(place)

    return cut


def tasks(spark: SparkSession) -> int:
    """Parts for work that the bytes sent say little of: as many as shuffles have before they are merged."""
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def simulate(
    asked: DataFrame, call: Callable[[str, str], str], *, model: str, provider: str = "provider", size: int = 15, seed: int = 0, outer: bool = False, system: str | None = None,
    cache: DataFrame | ReplyStore | None = None, path: str | None = None, limits: batching.Limits | None = None, log: str | None = None,
) -> Run:
    """Ask packages in batches of one person. Replies in the cache are not asked again.

    Replies cost money and differ the next time, so they are written down
    before anything is read off them: below path, or in the shared folder. A
    batch is asked once, however often the results are read; with a log, also
    where tasks are tried again. A batch whose questions were all answered goes
    to the cache; one that could not be sent has no results.
    """
    if isinstance(size, bool) or not isinstance(size, int) or size < 1:
        raise DataError("a batch must have 1 question at least")
    batches = batching.pack(asked, size, outer, system).withColumn("key", batching.cache_key(provider, model, "system", "user", "response_mode"))
    if isinstance(cache, ReplyStore):
        looked = cache.look_up(batches)
        known, ask = looked.filter("raw is not null"), looked.filter("raw is null").drop("raw")
    else:
        known, ask = (batches.limit(0).withColumn("raw", F.lit("")), batches) if cache is None else batching.with_cache(batches, cache)
    # a reply takes far longer than its bytes say, so tasks are not merged by size
    rated = limits is not None and limits.per_second is not None  # a rate is shared out for one wave of tasks
    spread = ask.repartition(asked.sparkSession.sparkContext.defaultParallelism if rated else tasks(asked.sparkSession), "key")
    live = batching.ask(spread, call, limits, log).withColumn("cached", F.lit(False))
    told = written(asked.sparkSession, path)(live.unionByName(known.select(*batches.columns, "raw", F.lit(None).cast("string").alias("failure"), F.lit(True).alias("cached"))))
    replies = told.filter("failure is null")
    rows = batching.answers(replies, ["raw", "cached"])
    if outer:
        facts = asked.select("subject_id", "question_id", "options", contract(F.col("options"), F.col("kind")).alias("__kind"))
        items = replies.select("subject_id", "chunk", F.posexplode(batching.listed(F.col("raw"))).alias("__i", "item")).select("subject_id", "chunk", F.get_json_object("item", "$.question_id").alias("question_id"), "__i", "item")
        last = items.groupBy("subject_id", "chunk", "question_id").agg(F.max_by("item", "__i").alias("item"))
        drawn = outer_answer(F.col("answer"), F.col("item"), F.col("__kind"), F.col("options"), seed, F.col("subject_id"), F.col("question_id"))
        # a reply that asks for a draw has no answer of its own; other errors stay
        lost = F.coalesce(F.col("error").rlike("^(model reply|batch JSON|missing question_id)"), F.lit(False))
        rows = rows.join(facts, ["subject_id", "question_id"]).join(last, ["subject_id", "chunk", "question_id"], "left").withColumn("x", drawn)
        rows = rows.withColumns({"answer": F.when(~lost, F.col("x.answer")), "error": F.when(lost, F.col("error")).otherwise(F.col("x.error"))}).drop("x", "item", "__kind", "options")
    good = replies.filter("not cached").join(batching.clean_batches(rows), ["subject_id", "chunk"], "left_semi")
    return Run(rows.select("subject_id", "chunk", "pos", "question_id", "answer", "error", "raw", "cached"), good.select("key", "raw"), told.filter("failure is not null").select("subject_id", "chunk", "question_ids", "failure"))


def read_replies(spark: SparkSession, path: str) -> DataFrame:
    """(key, raw): the replies that a run has kept, one for each key."""
    return ReplyStore(spark, path).replies()


def with_gold(results: DataFrame, gold: DataFrame) -> DataFrame:
    """Results with the held-out answers, which no prompt has seen; names that are taken get gold_ before them."""
    keys = ["subject_id", "question_id"]
    held = gold.drop("dataset")
    named = held.withColumnsRenamed({c: f"gold_{c}" for c in held.columns if c in results.columns and c not in keys})
    # texts that repeat are small when they are sent and large when they are sorted, so parts are not merged by what was sent
    parts = tasks(results.sparkSession)
    return attach(results.repartition(parts, *keys), named.repartition(parts, *keys), keys)


def progress(run: Run, planned: int, seconds: float = 0.0) -> dict[str, object]:
    """Batches done, failed and left, and the time they will take at the mean of the live ones."""
    per = run.results.select("subject_id", "chunk", "cached").distinct().agg(F.count("*").alias("n"), F.count_if("cached").alias("cached")).first()
    failed = run.failed.count()
    live = max(0, per["n"] - per["cached"])
    left = planned - per["n"] - failed
    return {"done": per["n"], "cached": per["cached"], "failed": failed, "left": left, "eta_seconds": round(seconds / live * left, 1) if live else None}


def write_results(run: Run, rows: DataFrame, path: str, manifest: Mapping[str, object]) -> str:
    """responses and manifest.json below path if no batch failed, else batch_errors and no responses; returns which."""
    spark = rows.sparkSession
    if not run.failed.isEmpty():
        write_jsonl(run.failed, f"{path}/batch_errors", ["subject_id", "chunk"])
        return "batch_errors"
    write_jsonl(rows, f"{path}/responses", ["subject_id", "chunk", "pos"])
    # the manifest goes last and at once: it says that the run is complete
    write_text(spark, f"{path}/manifest.json", json.dumps(dict(manifest), ensure_ascii=False, indent=2) + "\n")
    return "responses"


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a run has its manifest and responses that are not empty: it need not be made again."""
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    there = all(path_of(f"{path}/{x}").getFileSystem(conf).exists(path_of(f"{path}/{x}")) for x in ("manifest.json", "responses/_SUCCESS"))
    return there and not spark.read.text(f"{path}/responses").isEmpty()


def income_sample(bundle: Bundle, stratum: Column, seats: DataFrame | int, seed: int) -> Bundle:
    """The bundle of persons drawn by stratum, by given seats (stratum, seats) or n in all by the strata's shares."""
    rows = bundle.subjects.withColumn("stratum", stratum)
    if isinstance(seats, int):
        drawn, _ = by_shares(rows, "stratum", "subject_id", seats, seed, "income")
    else:
        drawn = stratified_draw(rows, ["stratum"], "subject_id", seats, seed, "income")
    drawn = drawn.select("subject_id")
    subjects = bundle.subjects.join(drawn, "subject_id", "left_semi")
    return Bundle(subjects, bundle.questions, bundle.cases.join(drawn, "subject_id", "left_semi"), bundle.gold)


def topped_up(bundle: Bundle, chosen: DataFrame, n: int, sample: Callable[[Bundle, int], Bundle], seed: int) -> Bundle:
    """The persons of a bundle who were chosen elsewhere; if there are fewer than n, a sample of its own by the next seed."""
    cases = bundle.cases.join(chosen.select("subject_id").distinct(), "subject_id", "left_semi")
    subjects = bundle.subjects.join(chosen.select("subject_id").distinct(), "subject_id", "left_semi")
    return sample(bundle, seed + 1) if subjects.count() < n else Bundle(subjects, bundle.questions, cases, bundle.gold)


def run_job(bundle: Bundle, call: Callable[[str, str], str], *, name: str, model: str, path: str, size: int = 15, seed: int = 0, facts: Mapping[str, object] | None = None, limits: batching.Limits | None = None) -> str:
    """A job from start to end: skipped if complete, else simulated with the cache of its folder, scored against gold later, and written."""
    spark = bundle.cases.sparkSession
    if is_complete(spark, path):
        return "complete"
    _, outer, _ = method(name)

    store = ReplyStore(spark, f"{path}/cache")
    run = simulate(packages(bundle, name, seed), call, model=model, size=size, seed=seed, outer=outer, cache=store, path=f"{path}/replies", limits=limits, log=f"{path}/log")
    store.add(run.cache)
    return write_results(run, with_gold(run.results, bundle.gold), path, {"method": name, "model": model, "seed": seed, "batch_size": size, **(facts or {})})


def public_row(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns that are shown outside."""
    return table.select(*columns)
