"""Respondents, questions, cases and held-out answers as four tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions import let
from canvass.functions.text import blank_to_null, canonical_pid, strip
from canvass.operators.relational import attach, first_wins

#: Other names of the data sets.
ALIASES = {
    "twin": "twin2k_500", "twin2k": "twin2k_500", "twin-2k": "twin2k_500", "twin-2k-500": "twin2k_500",
    "mega": "twin2k_mega_study", "mega-study": "twin2k_mega_study", "mega_study": "twin2k_mega_study",
    "bdm": "bdm_lettuce", "lettuce": "bdm_lettuce", "sim": "simbench", "sim-bench": "simbench",
}
DATASETS = ("twin2k_500", "twin2k_mega_study", "simbench", "bdm_lettuce")


def resolve(name: str) -> str:
    key = name.strip().lower()
    key = ALIASES.get(key, key)
    if key not in DATASETS:
        raise DataError(f"unknown data set {name}")
    return key


#: What makes a version of a question; its hash is the key between cases and questions.
CONTENT = ("prompt", "options", "kind")


def versioned(flat: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cases, questions) of rows that hold their question's wording: each wording is kept once, and each case has the hash of its own."""
    rows = flat.withColumn("version", F.sha2(F.to_json(F.struct(*CONTENT), {"ignoreNullFields": "false"}), 256))
    # all columns are keys: texts beside keys would be sorted to find the first of each, with all rows of a task in memory
    questions = rows.select("dataset", "question_id", "version", *CONTENT).distinct()
    return rows.drop(*CONTENT), questions


@dataclass(frozen=True)
class Bundle:
    """cases hold keys only: persons with different prices, products or options have different versions of a question. gold is a table of its own, so no prompt can reach it."""

    subjects: DataFrame
    questions: DataFrame
    cases: DataFrame
    gold: DataFrame

    def asked(self) -> DataFrame:
        """Cases with the wording that their person is asked."""
        return self.cases.join(self.questions, ["dataset", "question_id", "version"])

    def filtered(self, keep) -> Bundle:
        cases = self.cases.filter(keep)
        return Bundle(self.subjects.join(cases.select("subject_id").distinct(), "subject_id", "left_semi"), self.questions, cases, self.gold)


def in_order(records: DataFrame) -> DataFrame:
    """records with `ord`: the place that a reader gave them, else a hash of all they hold, so that the first of several is the same however rows are dealt."""
    return records if "ord" in records.columns else records.withColumn("ord", F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in records.columns)))))


def from_records(records: DataFrame, dataset: str) -> Bundle:
    """A bundle of nested records (id, demographics, persona_text, questions array<struct<id, prompt, options, kind, gold>>).

    Blank golds are no golds; a prompt that shows its own gold is an error.
    """
    base = in_order(records).withColumn("subject_id", canonical_pid(F.col("id")))
    subjects = first_wins(base.select("subject_id", "demographics", blank_to_null(F.col("persona_text")).alias("persona_text"), "ord"), ["subject_id"], ["ord"])
    flat = base.select("subject_id", "ord", F.posexplode("questions").alias("pos", "q"))
    prompt, gold = strip(F.col("q.prompt")), blank_to_null(F.col("q.gold"))
    leak = F.coalesce(F.contains(prompt, F.concat(F.lit("Answer: "), gold)), F.lit(False))
    fit = lambda value: F.when(leak, F.raise_error(F.lit("a prompt shows its held-out answer"))).when(prompt == "", F.raise_error(F.lit("a question has no prompt"))).otherwise(value)
    cases = flat.select(F.lit(dataset).alias("dataset"), "subject_id", fit(F.col("q.id")).alias("question_id"), "ord", "pos", fit(prompt).alias("prompt"), F.col("q.options").alias("options"), F.coalesce(F.col("q.kind"), F.lit("text")).alias("kind"))
    cases, questions = versioned(cases)
    golds = flat.filter(gold.isNotNull()).select(F.lit(dataset).alias("dataset"), "subject_id", F.col("q.id").alias("question_id"), gold.alias("answer"))
    return Bundle(subjects.drop("ord"), questions, cases, golds)


def attach_personas(bundle: Bundle, personas: DataFrame) -> Bundle:
    """Personas of another survey by subject; subjects without one keep what they have."""
    replace = [c for c in personas.columns if c != "subject_id" and c in bundle.subjects.columns]
    return Bundle(attach(bundle.subjects, personas, ["subject_id"], replace), bundle.questions, bundle.cases, bundle.gold)


#: Survey ids of demographic answers and the keys that cards read.
DEMOGRAPHICS = {
    "QID11": "region", "QID12": "sex", "QID13": "age", "QID14": "education", "QID15": "race", "QID16": "citizenship", "QID17": "marital_status",
    "QID18": "religion", "QID19": "worship_attendance", "QID20": "political_party", "QID21": "income", "QID22": "political", "QID23": "household_size", "QID24": "employment",
}


def canonical_demographics(c):
    """A map of answers without blanks, with keys for survey ids that have none yet."""
    blocked = {"income": "income_over_50k", "employment": "work_hours"}

    def keyed(kept):
        pairs = []
        for qid, key in DEMOGRAPHICS.items():
            free = ~F.map_contains_key(kept, F.lit(key))
            if key in blocked:
                free &= ~F.map_contains_key(kept, F.lit(blocked[key]))
            pairs.append(F.when(free & F.map_contains_key(kept, F.lit(qid)), F.struct(F.lit(key).alias("key"), F.element_at(kept, qid).alias("value"))))
        return F.map_concat(kept, F.map_from_entries(F.array_compact(F.array(*pairs))))

    trimmed = F.transform_values(F.map_filter(c, lambda k, v: v.isNotNull() & (F.trim(v) != "")), lambda k, v: F.trim(v))
    return let(trimmed, keyed)
