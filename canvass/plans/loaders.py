"""Whole surveys from their files, checked in the passes that read them, and the data sets built from them."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions.text import strip
from canvass.plans.assembly import Assembled, assemble, lettuce_outcomes, read_catalog, wave_items
from canvass.plans.builders import DRAWN_PRICE, DRAWN_PRODUCT, OUTCOMES, PUBLISHED, SHOPPER
from canvass.session import shared_dir
from canvass.sources.readers import read_csv, read_parquet

#: Persons that an error names.
SHOWN = 5


@dataclass(frozen=True)
class Loaded:
    """rows: the cells of each person, as they are, an empty one as ''; items: what they answered; audit: counts of the passes."""

    rows: DataFrame
    items: DataFrame
    audit: Mapping[str, int]
    stems: Mapping[str, str] = field(default_factory=dict)
    options: Mapping[str, Sequence[str]] = field(default_factory=dict)


def by_person(df: DataFrame, name: str, key: str = "pid") -> DataFrame:
    """(pid, n_name, name): how many rows a person has in a source, and one of them whole. It combines before the shuffle that the join needs anyway."""
    named = df.withColumn(key, F.coalesce(strip(F.col(key).cast("string")), F.lit("")))
    return named.groupBy(key).agg(F.count("*").alias(f"n_{name}"), F.any_value(F.struct(*(c for c in df.columns if c != key))).alias(name))


def _columns(found: Sequence[str], required: Sequence[str], known: Sequence[str], name: str) -> None:
    if lacking := sorted(set(required) - set(found)):
        raise DataError(f"{name} lacks the columns {lacking}")
    if unknown := sorted(set(found) - set(required) - set(known)):
        raise DataError(f"{name} has unknown columns {unknown}")


def checked(joined: DataFrame, sources: Sequence[str], persons: int | None, faults: Mapping[str, Column], counts: Mapping[str, Column], path: str, key: str = "pid") -> tuple[DataFrame, dict[str, int]]:
    """joined, once written, with counts that were taken while it was.

    A source with other than `persons` rows, blank or repeated persons, persons
    that a source lacks, and rows for which a fault holds are errors that name
    some of them, read off what was written and not off the sources.
    """
    missing = {f"{s} lacks persons": F.col(f"n_{s}").isNull() for s in sources}
    rules = {"blank persons": F.col(key) == "", **{f"{s} repeats persons": F.coalesce(F.col(f"n_{s}") > 1, F.lit(False)) for s in sources}, **missing, **faults}
    seen = Observation(f"load-{uuid.uuid4().hex[:8]}")
    totals = [F.coalesce(F.sum(f"n_{s}"), F.lit(0)).alias(f"rows_{s}") for s in sources]
    joined.observe(seen, *totals, *(F.count_if(c).alias(f"fault_{i}") for i, c in enumerate(rules.values())), *(F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in counts.items())).write.parquet(path)
    facts, spark = seen.get, joined.sparkSession
    stored = spark.read.schema(joined.schema).parquet(path)
    for s in sources:
        if persons is not None and facts[f"rows_{s}"] != persons:
            raise DataError(f"{s} has {facts[f'rows_{s}']} rows, not {persons}")
    for i, (what, rule) in enumerate(rules.items()):
        if facts[f"fault_{i}"]:
            raise DataError(f"{what}: {facts[f'fault_{i}']}, such as {[r[0] for r in stored.filter(rule).select(key).orderBy(key).limit(SHOWN).collect()]}")
    return stored, {k: facts[k] for k in (*(f"rows_{s}" for s in sources), *counts)}


def load_twin(spark: SparkSession, *, earlier: str, later: str, catalog: str, waves: Sequence[str], payload: str, basic: Sequence[str], ids: Sequence[str], persons: int | None, files: int = 7, path: str | None = None) -> Loaded:
    """The twin survey: two waves as CSV, a catalog of questions, and the trees of the last wave as Parquet files.

    All three sources must have the same persons, and the later table the
    answers of the trees; the audit counts cells that the two waves agree on.
    Each table is read once, the trees twice (their depth, then their answers).
    """
    stems, columns, unmapped = read_catalog(spark.read.option("multiLine", True).json(catalog), basic)
    if found := [r[0] for r in unmapped.limit(SHOWN).collect()]:
        raise DataError(f"the catalog has demographic questions without a place: {found}")
    listed = [r[0] for r in columns.collect()]
    first, second = (read_csv(spark, p, ["pid"], trim=False) for p in (earlier, later))
    other = [c for c in listed if c not in basic and c not in ids]
    _columns(first.columns, ["pid", *basic, *ids], other, earlier)
    _columns(second.columns, ["pid", *ids], other, later)
    trees = wave_items(read_parquet(spark, waves, ["pid", payload], files), payload, ids)
    joined = by_person(first, "earlier").join(by_person(second, "later"), "pid", "full_outer").join(by_person(trees, "trees"), "pid", "full_outer")
    cell = lambda source, c: F.coalesce(strip(F.col(f"{source}.`{c}`")), F.lit(""))
    said = lambda i: F.coalesce(F.get("trees.items", F.lit(i))["answer"], F.lit(""))
    both = F.col("n_earlier").isNotNull() & F.col("n_later").isNotNull()
    same = [(cell("earlier", q) == cell("later", q)).cast("int") for q in ids]
    alike = sum(same[1:], same[0])
    differs = both & F.col("n_trees").isNotNull() & F.array_contains(F.array(*(cell("later", q) != said(i) for i, q in enumerate(ids))), True)
    counts = {"cells_equal": F.when(both, alike), "cells_differ": F.when(both, len(ids) - alike)}
    stored, audit = checked(joined, ["earlier", "later", "trees"], persons, {"answers differ between table and tree": differs}, counts, path or f"{shared_dir(spark)}/canvass/twin-{uuid.uuid4().hex[:12]}")
    catalogued = stems.collect()
    return Loaded(
        stored.select("pid", *(F.coalesce(f"earlier.`{c}`", F.lit("")).alias(c) for c in (*basic, *ids))), stored.select("pid", F.col("trees.items").alias("items")), audit,
        {r["question_id"]: r["stem"] for r in catalogued}, {r["question_id"]: list(r["options"]) for r in catalogued},
    )


def load_lettuce(spark: SparkSession, *, table: str, known: Sequence[str] = (), persons: int | None = PUBLISHED, path: str | None = None) -> Loaded:
    """The lettuce survey, one CSV: a closed header, one row a person, the seven outcomes in order."""
    rows = read_csv(spark, table, ["pid"], trim=False)
    shopper = [c for c, _, _ in SHOPPER]
    _columns(rows.columns, ["pid", *OUTCOMES, DRAWN_PRODUCT, DRAWN_PRICE], [*shopper, *known], table)
    blank = {"blank_outcomes": sum(((F.coalesce(strip(F.col(f"lettuce.{c}")), F.lit("")) == "").cast("int") for c in OUTCOMES), F.lit(0))}
    stored, audit = checked(by_person(rows, "lettuce"), ["lettuce"], persons, {}, blank, path or f"{shared_dir(spark)}/canvass/lettuce-{uuid.uuid4().hex[:12]}")
    flat = stored.select("pid", *(F.coalesce(f"lettuce.`{c}`", F.lit("")).alias(c) for c in rows.columns if c != "pid"))
    return Loaded(flat, lettuce_outcomes(flat), audit)


def build_twin(loaded: Loaded, *, basic: Sequence[str], ids: Sequence[str], strata: Sequence[str], seed: int, source: str, size: int | None = None, ages: Sequence[str] = ()) -> Assembled:
    """The pricing data set of the twin survey: cards with the catalog's wording, outcomes of the last wave."""
    with_stimulus = loaded.items.withColumn("items", F.transform("items", lambda i: i.withField("stimulus", F.lit(None).cast("map<string,string>"))))
    return assemble(loaded.rows.select("pid", *basic), with_stimulus, dataset="twin2k_500", source=source, columns=basic, strata=strata, outcome_ids=ids, seed=seed, stems=loaded.stems, options=loaded.options, allowed=["pid", *basic], forbidden=ids, size=size, ages=ages)


def build_lettuce(loaded: Loaded, *, columns: Sequence[str], strata: Sequence[str], seed: int, source: str, size: int | None = None, ages: Sequence[str] = ()) -> Assembled:
    """The pricing data set of the lettuce survey: the purchase goes with what was drawn, and neither is on a card."""
    hidden = [*OUTCOMES, DRAWN_PRODUCT, DRAWN_PRICE]
    return assemble(loaded.rows.select("pid", *columns), loaded.items, dataset="bdm_lettuce", source=source, columns=columns, strata=strata, outcome_ids=OUTCOMES, seed=seed, allowed=["pid", *columns], forbidden=hidden, size=size, ages=ages)
