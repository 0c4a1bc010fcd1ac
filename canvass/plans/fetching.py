"""Data sets put into the store by name, from a mirror that Spark can read."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from canvass.errors import DataError, EnvironmentFault
from canvass.plans.bundle import resolve
from canvass.sources.publish import lock_of, publish, read_published, versions


@dataclass(frozen=True)
class Source:
    """read: the tables of a data set by name, each a function that makes it; optional ones may be absent; expected: rows of published tables."""

    read: Mapping[str, Callable[[], DataFrame]]
    optional: Sequence[str] = ()
    expected: Mapping[str, int] | None = None


FETCHED = "dataset string, table string, rows long, state string"


def fetch(spark: SparkSession, store: str, names: Iterable[str], sources: Mapping[str, Source], limit: int | None = None) -> DataFrame:
    """(dataset, table, rows, state) of data sets by any of their names: each is written as one version, with its counts in the lock.

    A published table with another number of rows is an error, unless a limit
    was asked for; an optional table that can't be read is recorded as skipped.
    """
    report = []
    for dataset in dict.fromkeys(map(resolve, names)):
        if dataset not in sources:
            raise DataError(f"{dataset} has no source")
        source, tables, counts, skipped = sources[dataset], {}, {}, []
        for name, make in source.read.items():
            try:
                df = make()
                counts[name] = df.limit(limit).count() if limit else df.count()
            except Exception:
                if name not in source.optional:
                    raise
                skipped.append(name)
                continue
            want = (source.expected or {}).get(name)
            if limit is None and want is not None and counts[name] != want:
                raise DataError(f"{dataset} {name} has {counts[name]} rows, not {want}")
            tables[name] = df.limit(limit) if limit else df
        publish(tables, f"{store}/{dataset}", rows=counts, skipped=skipped, limit=limit)
        report += [(dataset, n, counts[n], "fetched") for n in tables] + [(dataset, n, 0, "skipped") for n in skipped]
    return spark.createDataFrame(report, FETCHED)


def load(spark: SparkSession, store: str, name: str, table: str) -> DataFrame:
    """A table of a data set that was fetched; where it was not, the error names the command."""
    dataset = resolve(name)
    if not versions(spark, f"{store}/{dataset}"):
        raise EnvironmentFault(f"{dataset} is not in {store}; run: fetch {dataset}")
    return read_published(spark, f"{store}/{dataset}", table)


def manifest(spark: SparkSession, store: str, name: str) -> dict:
    """What was written of a data set: its files, counts, and what was skipped."""
    return lock_of(spark, f"{store}/{resolve(name)}")[1]
