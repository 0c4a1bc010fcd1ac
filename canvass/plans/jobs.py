"""Runs of several surveys, methods and models: counts while they go on, and what is left when some fail."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.plans import simulation
from canvass.plans.bundle import Bundle
from canvass.sources.publish import write_text


class Progress:
    """A file that says how many batches are done, failed and left, and how long the rest takes, rewritten while tasks run.

    Tasks add to accumulators, which reach the driver as each task ends; a task
    that is tried again may count twice, so the counts are for people.
    """

    def __init__(self, spark: SparkSession, path: str, planned: int, every: float = 1.0) -> None:
        self.spark, self.path, self.planned, self.every = spark, path, planned, every
        self.done, self.failed = (spark.sparkContext.accumulator(0) for _ in range(2))
        self.began, self.over, self.thread = time.monotonic(), threading.Event(), None

    def facts(self) -> dict[str, object]:
        done, failed, spent = self.done.value, self.failed.value, time.monotonic() - self.began
        left = max(0, self.planned - done - failed)
        return {"planned": self.planned, "done": done, "failed": failed, "left": left, "seconds": round(spent, 1), "eta_seconds": round(spent / (done + failed) * left, 1) if done + failed else None}

    def _write(self) -> None:
        write_text(self.spark, self.path, json.dumps(self.facts()) + "\n")

    def _run(self) -> None:
        while not self.over.wait(self.every):
            self._write()

    def __enter__(self) -> Progress:
        self._write()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_: object) -> None:
        self.over.set()
        self.thread.join()
        self._write()

    def counted(self, call: Callable[[str, str], str]) -> Callable[[str, str], str]:
        """call, with its outcome counted in the task that makes it."""
        done, failed = self.done, self.failed

        def told(system: str, user: str) -> str:
            try:
                reply = call(system, user)
            except Exception:
                failed.add(1)
                raise
            done.add(1)
            return reply

        return told


def batches_of(asked: DataFrame, size: int) -> int:
    """Batches that packages make: of each person as many as questions need."""
    per = asked.groupBy("subject_id").agg(F.ceil(F.count("*") / size).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass(frozen=True)
class Job:
    """One survey asked by one method of one model; results, cache and log lie below path."""

    dataset: str
    method: str
    model: str
    path: str
    seed: int = 0
    size: int = 15


def grid(base: str, datasets: Iterable[str], methods: Iterable[str], models: Iterable[str], **more: int) -> list[Job]:
    methods, models = list(methods), list(models)
    return [Job(d, m, x, f"{base}/{d}/{m}/{x}", **more) for d in datasets for m in methods for x in models]


STATES = "dataset string, method string, model string, state string, reason string"


def run_jobs(spark: SparkSession, jobs: Iterable[Job], bundle_of: Callable[[str], Bundle], call_of: Callable[[str], Callable[[str, str], str]], at_once: int = 2) -> DataFrame:
    """(dataset, method, model, state, reason) of all jobs: complete before, responses written, batch_errors, or failed with its reason.

    Jobs run side by side, each in a pool of the fair scheduler (where that is
    on), so that one that waits for a provider leaves the executors to others.
    What is complete is not made again; one that fails stops no other, and the
    next call takes it up where its log ends.
    """
    from pyspark import InheritableThread  # keeps the pool with its own thread

    jobs, states = list(jobs), {}

    def one(job: Job) -> None:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"{job.dataset}/{job.method}/{job.model}")
        try:
            state = simulation.run_job(bundle_of(job.dataset), call_of(job.model), name=job.method, model=job.model, path=job.path, size=job.size, seed=job.seed, facts={"dataset": job.dataset})
            states[job] = (state, None)
        except Exception as error:
            states[job] = ("failed", f"{type(error).__name__}: {error}"[:500])

    def threaded(job: Job) -> None:
        t = InheritableThread(target=one, args=(job,))
        t.start()
        t.join()

    with ThreadPoolExecutor(at_once) as pool:
        list(pool.map(threaded, jobs))
    return spark.createDataFrame([(j.dataset, j.method, j.model, *states[j]) for j in jobs], STATES)
