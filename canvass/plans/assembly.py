"""A data set from its source tables: who can be used, how many are drawn, their cards, and the checks on them."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions import let
from canvass.functions.text import normalize_cell, outcome_strings, strip
from canvass.functions.trees import priced
from canvass.operators.relational import audit_equal, key_difference, numeric_first, unpivot
from canvass.operators.sampling import allocate_two_margins, hamilton, planned_size, stratified_draw
from canvass.plans.builders import DRAWN_PRICE, DRAWN_PRODUCT, OUTCOMES, PURCHASE
from canvass.plans.cards import basic_cards, eligibility, generated_text, leaks
from canvass.plans.report import decade, field_report
from canvass.sources.readers import assert_unique, expect_rows, read_parquet
from canvass.sources.writers import write_jsonl

#: Examples that an error names.
SHOWN = 5


def refuse(bad: DataFrame, what: str) -> None:
    """An error that names some of the rows, if there are any."""
    if rows := bad.limit(SHOWN).collect():
        raise DataError(f"{what}: {[tuple(r) for r in rows]}")


# the source tables


def read_catalog(catalog: DataFrame, basic: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stems (question_id, stem, options), table columns (column), demographics without a column) of a question catalog.

    catalog: QuestionID, BlockName, QuestionText, Options, csv_columns.
    Repeated columns, repeated or missing stems, and stems without options are errors.
    """
    ids = strip(F.coalesce("QuestionID", F.lit("")))
    refuse(catalog.filter(ids == "").select("QuestionText"), "catalog entries without a QuestionID")
    columns = catalog.select(F.explode("csv_columns").alias("column"))
    refuse(columns.groupBy("column").count().filter("count > 1"), "the catalog repeats columns")
    known = ids.isin(*basic)
    stems = catalog.filter(known).select(ids.alias("question_id"), F.col("QuestionText").alias("stem"), F.col("Options").alias("options"))
    refuse(stems.groupBy("question_id").count().filter("count > 1"), "the catalog repeats stems")
    refuse(stems.filter((F.coalesce(strip(F.col("stem")), F.lit("")) == "") | (F.coalesce(F.size("options"), F.lit(0)) < 1)).select("question_id"), "stems without text or options")
    if lacking := sorted(set(basic) - {r[0] for r in stems.select("question_id").collect()}):
        raise DataError(f"the catalog lacks stems of {lacking}")
    return stems, columns, catalog.filter((F.col("BlockName") == "Demographics") & ~known).select(ids.alias("question_id"))


def wave_items(rows: DataFrame, payload: str, ids: Sequence[str], key: str = "pid") -> DataFrame:
    """(pid, items) of survey trees: the answer, place and text of exactly these questions in order; anything else is an error."""
    found = priced(rows.select(strip(F.col(key).cast("string")).alias(key), F.col(payload).cast("string").alias("__tree")), "__tree", "x")
    want = F.array(*map(F.lit, ids))
    named = lambda items: F.array_sort(F.transform(items, lambda i: i["question_id"]))
    wrong = lambda x: F.coalesce(x["error"], F.when(named(x["items"]) != F.array_sort(want), "not the expected questions"))
    in_order = lambda items: F.transform(want, lambda q: F.get(F.filter(items, lambda i: i["question_id"] == q), F.lit(0)))
    checked = lambda x: let(wrong(x), lambda w: F.when(w.isNotNull(), F.raise_error(F.concat(F.lit("pid "), F.col(key), F.lit(": "), w))).otherwise(in_order(x["items"])))
    return found.select(key, let(F.col("x"), checked).alias("items"))


def read_waves(spark: SparkSession, paths: Sequence[str], payload: str, ids: Sequence[str], files: int = 7) -> DataFrame:
    """`wave_items` of a given number of files, of which only two columns are read; a person in two files is an error."""
    return wave_items(assert_unique(read_parquet(spark, paths, ["pid", payload], files), ["pid"]), payload, ids)


def paired_waves(earlier: DataFrame, later: DataFrame, items: DataFrame, ids: Sequence[str], key: str = "pid") -> DataFrame:
    """(equal, differ): cells of the two waves. The three tables must have the same persons, and the later table the answers of the items."""
    for other, name in ((later, "the later wave"), (items, "the answers")):
        refuse(key_difference(earlier, other, [key]), f"{name} has other persons")
    long = lambda df: unpivot(df.select(key, *(F.coalesce(strip(F.col(c)), F.lit("")).alias(c) for c in ids)), [key], ids, "item", "value", keep_blank=True)
    said = items.select(key, F.explode("items").alias("i")).select(key, F.col("i.question_id").alias("item"), F.col("i.answer").alias("said"))
    refuse(long(later).join(said, [key, "item"]).filter(~F.col("value").eqNullSafe(F.col("said"))).select(key, "item"), "answers differ between table and tree")
    return audit_equal(long(earlier), long(later), [key, "item"], "value")


def lettuce_outcomes(rows: DataFrame, key: str = "pid") -> DataFrame:
    """(pid, items) of the seven outcomes in order; the purchase goes with what was drawn."""
    cell = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    drawn = F.create_map(*(x for c in (DRAWN_PRICE, DRAWN_PRODUCT) for x in (F.lit(c), cell(c))))
    none = F.lit(None).cast("map<string,string>")
    one = lambda c: F.struct(F.lit(c).alias("question_id"), cell(c).alias("answer"), F.lit("").alias("question_text"), F.lit(c).alias("source_column"), (drawn if c == PURCHASE else none).alias("stimulus"))
    return rows.select(strip(F.col(key)).alias(key), F.array(*map(one, OUTCOMES)).alias("items"))


# the data set


@dataclass(frozen=True)
class Assembled:
    """Five tables and the numbers of the plan."""

    cards: DataFrame
    report: DataFrame
    exclusions: DataFrame
    outcomes: DataFrame
    sample: DataFrame
    seats: DataFrame
    plan: Mapping[str, object]


def values_differ(cards: DataFrame, rows: DataFrame, columns: Sequence[str], key: str = "pid") -> DataFrame:
    """(subject_id, column) of card fields that are not their source cells, and of cells without a field or fields without a cell."""
    told = cards.select("subject_id", F.explode("basic_info").alias("f")).select("subject_id", F.col("f.source_column").alias("column"), F.struct("f.value", "f.status").alias("told"))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), normalize_cell(F.col(c)).alias("cell")) for c in columns))
    source = rows.select(strip(F.col(key)).alias("subject_id"), F.explode(cells).alias("c")).select("subject_id", "c.column", "c.cell")
    return told.join(source, ["subject_id", "column"], "full_outer").filter(~F.col("told").eqNullSafe(F.col("cell"))).select("subject_id", "column")


def seats_of(rows: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """Seats of the cells of one stratifier (largest remainders) or two (both margins so)."""
    if len(strata) == 1:
        return hamilton(rows.groupBy(strata[0]).agg(F.count("*").alias("population")), strata[0], "population", n)
    if len(strata) == 2:
        return allocate_two_margins(rows, *strata, n)
    raise DataError("one or two stratifiers")


def margin_balance(seats: DataFrame, strata: Sequence[str], n: int) -> DataFrame:
    """(field, level, population, sample, quota, gap) of each margin; a level that is a seat or more off its quota is an error."""
    total = seats.agg(F.sum("population")).first()[0]
    out = None
    for c in strata:
        part = seats.groupBy(F.lit(c).alias("field"), F.col(c).cast("string").alias("level")).agg(F.sum("population").alias("population"), F.sum("seats").alias("sample"))
        out = part if out is None else out.union(part)
    quota = F.lit(n) * F.col("population") / F.lit(total)
    gap = F.abs(F.col("sample") - quota)
    fit = F.when(gap >= 1, F.raise_error(F.concat_ws(" ", "field", "level", F.lit("is off its quota by a seat")))).otherwise(gap)
    return out.select("field", "level", "population", "sample", quota.alias("quota"), fit.alias("gap"))


def assemble(
    rows: DataFrame, outcomes: DataFrame, *, dataset: str, source: str, columns: Sequence[str], strata: Sequence[str], outcome_ids: Sequence[str], seed: int,
    stems: Mapping[str, str] | None = None, options: Mapping[str, Sequence[str]] | None = None, allowed: Sequence[str] | None = None, forbidden: Sequence[str] = (),
    size: int | None = None, ages: Sequence[str] = (), key: str = "pid",
) -> Assembled:
    """Validate, choose, plan, draw, make cards, check them, and report.

    rows are text cells by person; outcomes have items array<struct<question_id,
    answer, question_text, source_column, stimulus>>. No card may show an
    outcome, have generated text, or differ from its source; ages are reported
    by decade.
    """
    if allowed is not None and (unknown := sorted(set(rows.columns) - set(allowed))):
        raise DataError(f"unknown columns {unknown}")
    if shown := sorted(set(columns) & set(forbidden)):
        raise DataError(f"blocked columns on cards: {shown}")
    named = rows.withColumn(key, F.coalesce(strip(F.col(key)), F.lit("")))
    assert_unique(named.filter(F.col(key) != ""), [key])
    exclusions = eligibility(named, outcomes, outcome_ids, key).select(F.col(key).alias("subject_id"), "reason")
    eligible = named.filter(F.col(key) != "").join(exclusions.select(F.col("subject_id").alias(key)), key, "left_anti").select(named.columns)
    population = eligible.count()
    n = planned_size(population, override=size)
    seats = seats_of(eligible, strata, n)
    drawn = stratified_draw(eligible, strata, key, seats, seed, dataset).select(F.col(key).alias("subject_id"), "draw_order")
    cards = basic_cards(eligible, dataset, source, columns, stems, options, key)
    refuse(cards.filter(generated_text(F.col("text"))).select("subject_id"), "cards with generated text")
    refuse(values_differ(cards, eligible, columns, key), "cards differ from their source")
    items = eligible.select(key).join(outcomes, key).select(F.col(key).alias("subject_id"), F.lit(dataset).alias("dataset"), "items")
    needles = items.select("subject_id", F.explode("items").alias("i")).select("subject_id", F.explode(outcome_strings(F.col("i"))).alias("text"))
    refuse(leaks(cards, needles), "cards that show an outcome")
    marked = eligible.join(drawn.select(F.col("subject_id").alias(key), F.lit(True).alias("__in")), key, "left").withColumn("__in", F.coalesce("__in", F.lit(False)))
    report = field_report(marked.withColumns({c: decade(c) for c in ages}), columns, "__in")
    plan = {"dataset": dataset, "population": population, "sample_size": n, "seed": seed, "stratify_columns": list(strata), "input_rows": rows.count()}
    return Assembled(cards.drop(key), report, exclusions, items, drawn, seats, plan)


def write(made: Assembled, path: str) -> None:
    """The five documents as JSON lines, persons in order of their numbers."""
    by_person = lambda df: df.orderBy(*numeric_first(F.col("subject_id")))
    for name, df in (("cards", by_person(made.cards)), ("outcomes", by_person(made.outcomes)), ("exclusions", made.exclusions.orderBy("subject_id", "reason")), ("distribution", made.report.orderBy("field", "value")), ("sample", made.sample.orderBy("draw_order"))):
        write_jsonl(df, f"{path}/{name}")


def fingerprint(df: DataFrame) -> tuple:
    """The number of rows and an order-free sum of their hashes."""
    as_text = [F.to_json(c) if t.startswith(("array", "struct", "map")) else c for c, t in df.dtypes]
    return tuple(df.agg(F.count("*"), F.sum(F.xxhash64(*as_text).cast("decimal(38,0)"))).first())


def twice(build: Callable[[], Assembled]) -> Assembled:
    """What build makes, once a second build has come out alike."""
    first, second = build(), build()
    tables = ("cards", "report", "exclusions", "outcomes", "sample")
    if changed := [t for t in tables if fingerprint(getattr(first, t)) != fingerprint(getattr(second, t))]:
        raise DataError(f"two builds differ in {changed}")
    return first


def checked_source(rows: DataFrame, n: int | None, name: str) -> DataFrame:
    """Rows of a source whose number is published; None takes any."""
    return rows if n is None else expect_rows(rows, n, name)
