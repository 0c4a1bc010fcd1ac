"""Bundles of the four surveys from their records, and the refusals that keep outcomes and groups where they belong."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions import let
from canvass.functions.jsonx import decoded
from canvass.functions.text import blank_to_null, canonical_pid, education_bucket, format_template, group_key, income_over_50k, purchase_prompt, strip, weekly_hours, wtp_prompt
from canvass.operators.relational import first_wins, unequal_counts
from canvass.plans.bundle import Bundle, canonical_demographics, from_records, in_order, versioned
from canvass.sources.readers import expect_rows, require_fields

# Fixed columns of the lettuce survey: source column, key, label on the card.
SHOPPER = (
    ("survey_q01_age", "age", "Age"),
    ("survey_q02_sex", "sex", "Sex"),
    ("survey_q03_price", "price_importance", "Importance of price when buying produce"),
    ("survey_q03_locally_grown", "locally_grown_importance", "Importance of locally grown produce"),
    ("survey_q03_pesticide_free", "pesticide_free_importance", "Importance of pesticide-free produce"),
    ("survey_q03_brand_name", "brand_importance", "Importance of brand name"),
    ("survey_q04_heard_of_vertical_farming", "heard_of_vertical_farming", "Heard of vertical farming"),
    ("survey_q05_heard_of_greenhouse_growing", "heard_of_greenhouse_growing", "Heard of greenhouse growing"),
    ("survey_q06_primary_grocery", "primary_grocery_shopper", "Primary grocery shopper"),
    ("survey_q07_primary_cook", "primary_cook", "Primary cook"),
    ("survey_q08_leafy_green_meals", "leafy_green_meals", "Leafy-green meals (survey category)"),
    ("survey_q09_not_prepared_meals", "meals_not_prepared_at_home", "Meals not prepared at home (survey category)"),
    ("survey_q10_try_novel_technology", "try_novel_food_technology", "Likelihood of trying food from novel technology"),
    ("survey_q11_grow_own_food", "grows_own_food", "Grows some of their own food"),
    ("survey_q12_variety_concern", "food_variety_concern", "Concern about food variety"),
    ("survey_q13_lack_of_resources", "food_resource_constraints", "Food-resource constraints reported in the survey"),
    ("survey_q14_political", "political", "Political leaning"),
    ("survey_q15_income", "income", "Household income"),
    ("survey_q16_education", "education", "Education"),
    ("survey_q17_household_size", "household_size", "Household size"),
)
PREFACE = "Structured shopper profile from the Canadian BDM lettuce survey (Gibson and Li). These are demographics and consumer habits, not a long narrative persona."
# Fixed outcome columns of the lettuce survey and the products they ask about.
PRODUCTS = {
    "local_field": "local field-grown lettuce",
    "local_greenhouse": "local greenhouse-grown lettuce",
    "local_vertical": "local vertically farmed lettuce",
    "nonlocal_field": "non-local field-grown lettuce",
    "nonlocal_greenhouse": "non-local greenhouse-grown lettuce",
    "nonlocal_vertical": "non-local vertically farmed lettuce",
}
PURCHASE, DRAWN_PRODUCT, DRAWN_PRICE = "conclusion_purchased_product", "conclusion_selected_product", "conclusion_generated_price"
OUTCOMES = (*PRODUCTS, PURCHASE)
#: Respondents of the published lettuce survey.
PUBLISHED = 610


def string_map(c: Column) -> Column:
    """A map without null and blank values; null is an empty map."""
    kept = F.map_filter(c, lambda k, v: v.isNotNull() & (strip(v) != ""))
    return F.coalesce(kept, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def background(demographics: Column) -> Column:
    """The shopper profile of a map of demographics; '' if nothing of it is known."""
    lines = F.array_compact(F.array(*(F.when(strip(F.element_at(demographics, key)) != "", F.concat(F.lit(f"{label}: "), strip(F.element_at(demographics, key)))) for _, key, label in SHOPPER)))
    return F.when(F.size(lines) > 0, F.concat(F.lit(f"{PREFACE}\n\n"), F.array_join(lines, "\n"))).otherwise("")


def gold_shows(gold: Column, text: Column) -> Column:
    """A bid with a mark that occurs in a text; short tokens may, as 2 does in an age."""
    return F.coalesce(gold.rlike(r"[.$]") & F.contains(text, gold), F.lit(False))


def lettuce_records(rows: DataFrame, expected: int | None = PUBLISHED) -> DataFrame:
    """Records of the wide table: demographics and seven questions, the purchase question last; blank bids are no golds."""
    if expected is not None:
        expect_rows(rows, expected, "the lettuce table")
    cell = lambda c: F.coalesce(strip(F.col(c)), F.lit(""))
    none = F.array().cast("array<string>")
    question = lambda name, prompt, options, kind: F.struct(F.lit(name).alias("id"), prompt.alias("prompt"), options.alias("options"), F.lit(kind).alias("kind"), cell(name).alias("gold"))
    asked = [question(c, wtp_prompt(F.lit(p)), none, "numeric") for c, p in PRODUCTS.items()]
    asked.append(question(PURCHASE, purchase_prompt(cell(DRAWN_PRODUCT), cell(DRAWN_PRICE)), F.array(F.lit("TRUE"), F.lit("FALSE")), "multiple_choice"))
    known = F.map_from_entries(F.array(*(F.struct(F.lit(key).alias("key"), cell(c).alias("value")) for c, key, _ in SHOPPER if c in rows.columns)))
    return rows.select(cell("pid").alias("id"), string_map(known).alias("demographics"), F.lit(None).cast("string").alias("persona_text"), F.array(*asked).alias("questions"), *(c for c in rows.columns if c == "ord"))


def lettuce_bundle(records: DataFrame) -> Bundle:
    """A bundle whose personas are profiles; an outcome among the demographics, or a bid in the profile, is an error."""
    text = background(F.col("demographics"))
    shown = F.exists("questions", lambda q: gold_shows(strip(q["gold"]), text))
    outcome = F.exists(F.map_keys("demographics"), lambda k: k.isin(*OUTCOMES))
    fit = F.when(outcome, F.raise_error(F.concat("id", F.lit(" stored an outcome column on the persona")))).when(shown, F.raise_error(F.concat("id", F.lit(" copied a held-out answer into the persona"))))
    return from_records(records.withColumn("persona_text", F.coalesce(fit.cast("string"), text)), "bdm_lettuce")


def study_records(rows: DataFrame, study: str) -> DataFrame:
    """(id, study, survey_text, gold_payload) of rows that name their fields in several ways."""
    have = lambda *names: F.coalesce(*(F.col(n).cast("string") for n in names if n in rows.columns), F.lit(None).cast("string"))
    payload = have("survey_json_with_human_response")
    need = require_fields(id=canonical_pid(have("PID", "pid", "id")), survey_text=strip(have("survey_text")))
    return rows.select(need["id"].alias("id"), F.lit(study).alias("study"), need["survey_text"].alias("survey_text"), payload_text(payload).alias("gold_payload"), *(c for c in rows.columns if c == "ord"))


def payload_text(c: Column) -> Column:
    """A payload as JSON text: unwrapped if it is a JSON string of JSON, as it is if it decodes to nothing else."""
    return F.coalesce(decoded(c), c)


def study_bundle(records: DataFrame, studies: Sequence[str]) -> Bundle:
    """One case for each row, named study:person; the first row of a person is the subject. A prompt with the payload in it is an error."""
    need = require_fields(id=canonical_pid(F.col("id")), study=F.col("study"), survey_text=strip(F.col("survey_text")))
    payload = blank_to_null(F.col("gold_payload"))
    known = F.when(F.col("study").isin(*studies), need["study"]).otherwise(F.raise_error(F.concat(F.lit("unknown study "), F.col("study"))))
    copied = F.coalesce(F.contains("survey_text", payload), F.lit(False))
    prompt = F.when(copied, F.raise_error(F.concat(F.lit("a survey text holds the answers of "), F.col("id")))).otherwise(need["survey_text"])
    rows = in_order(records)
    flat = rows.select(F.lit("twin2k_mega_study").alias("dataset"), need["id"].alias("subject_id"), F.concat_ws(":", known, need["id"]).alias("question_id"), "ord", F.lit(0).alias("pos"), prompt.alias("prompt"), F.array().cast("array<string>").alias("options"), F.lit("text").alias("kind"), payload.alias("payload"))
    nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    subjects = first_wins(flat.select("subject_id", nothing.alias("demographics"), F.lit(None).cast("string").alias("persona_text"), "ord"), ["subject_id"], ["ord"]).drop("ord")
    cases, questions = versioned(flat.drop("payload"))
    return Bundle(subjects, questions, cases, flat.filter("payload is not null").select("dataset", "subject_id", "question_id", "payload"))


#: Columns that only rows of single persons have.
PERSONAL = ("pid", "persona_text", "respondent_id")


def refuse_persons(rows: DataFrame, answer: str = "human_answer") -> DataFrame:
    """rows, if they are of groups: no column of persons, and answers that are objects."""
    if found := [c for c in PERSONAL if c in rows.columns]:
        raise DataError(f"group rows have columns of persons: {found}")
    if answer not in rows.columns or rows.schema[answer].dataType.typeName() != "string":
        return rows
    is_map = F.schema_of_variant(F.try_parse_json(decoded(F.col(answer)))).startswith("OBJECT")
    bad = F.col(answer).isNotNull() & ~F.coalesce(is_map, F.lit(False))
    return rows.withColumn(answer, F.when(bad, F.raise_error(F.lit("an answer of a group must be a distribution"))).otherwise(F.col(answer)))


def distribution(c: Column) -> Column:
    """The weights of a JSON object of options; an empty one, and a weight below 0, are errors."""
    wrong = lambda p: F.exists(F.map_values(p), lambda w: w.isNull() | (w < 0))
    checked = lambda p: F.when(F.coalesce(F.size(p), F.lit(0)) < 1, F.raise_error(F.lit("an answer of a group must have options"))).when(wrong(p), F.raise_error(F.lit("weights must be numbers of 0 at least"))).otherwise(p)
    return let(F.from_json(decoded(c), "map<string,double>"), checked)


def item_id(auxiliary: Column, index: Column) -> Column:
    """The first of three ids that is there, else the place of the row."""
    ids = lambda body: F.coalesce(*(blank_to_null(F.get_json_object(body, f"$.{k}")) for k in ("task_id", "question_id_original", "question_id")))
    return F.coalesce(let(decoded(auxiliary), ids), F.concat(F.lit("item-"), index.cast("string")))


def group_records(rows: DataFrame, split: str) -> DataFrame:
    """Records of published groups: rows (dataset_name, group_prompt_template, group_prompt_variable_map, human_answer, auxiliary, input_template, group_size, index)."""
    checked = refuse_persons(rows)
    variables = string_map(F.from_json(decoded(F.col("group_prompt_variable_map")), "map<string,string>"))
    name = F.coalesce(blank_to_null(F.col("dataset_name")), F.lit(split))
    base = checked.select("*", variables.alias("__v"), name.alias("__d"))
    shares = distribution(F.col("human_answer"))
    return base.withColumn("__s", shares).select(
        F.lit(split).alias("split"), F.col("__d").alias("dataset_name"), group_key(F.col("__d"), F.col("__v")).alias("group_key"), strip(format_template(F.col("group_prompt_template"), F.map_entries("__v"))).alias("group_prompt"),
        F.col("__v").alias("variables"), item_id(F.col("auxiliary"), F.col("index")).alias("question_id"), strip(F.col("input_template")).alias("prompt"), F.map_keys("__s").alias("options"), F.col("__s").alias("distribution"), "group_size", "index",
    )


def group_bundle(records: DataFrame) -> Bundle:
    """One case for each record of a group; the first record of a group is the subject, and gold is its distribution."""
    need = require_fields(group_key=strip(F.col("group_key")), group_prompt=strip(F.col("group_prompt")), prompt=strip(F.col("prompt")))
    flat = records.select(F.lit("simbench").alias("dataset"), need["group_key"].alias("subject_id"), F.col("variables").alias("demographics"), need["group_prompt"].alias("persona_text"), "question_id", F.col("index").alias("ord"), need["prompt"].alias("prompt"), "options", F.lit("distribution").alias("kind"), "distribution", "group_size")
    subjects = first_wins(flat.select("subject_id", "demographics", "persona_text", "ord"), ["subject_id"], ["ord"]).drop("ord")
    cases, questions = versioned(flat.select("dataset", "subject_id", "question_id", "ord", F.lit(0).alias("pos"), "prompt", "options", "kind"))
    return Bundle(subjects, questions, cases, flat.select("dataset", "subject_id", "question_id", "distribution", F.col("group_size").cast("long").alias("group_size")))


def preferred_json(c: Sequence[str]) -> Column:
    """Of several JSON texts of one person the first that decodes to an object."""
    return F.coalesce(*(let(decoded(F.col(x)), lambda body: F.when(F.schema_of_variant(F.try_parse_json(body)).startswith("OBJECT"), body)) for x in c))


def only_questions(records: DataFrame, prefix: str) -> DataFrame:
    """Records with the questions whose ids have the prefix."""
    return records.withColumn("questions", F.filter("questions", lambda q: F.startswith(q["id"], F.lit(prefix))))


def fixed_personas(personas: DataFrame, questions: DataFrame, persons: int, asked: int, options: Sequence[str]) -> DataFrame:
    """Packages of given card texts (id, text), each with all questions (id, prompt, options); counts and texts are checked.

    Questions are few and go along as one array with every person.
    """
    expect_rows(personas, persons, "personas")
    expect_rows(questions, asked, "questions")
    rows = [(i, r["id"], r["prompt"], list(r["options"] or options)) for i, r in enumerate(questions.collect())]
    need = require_fields(id=F.col("id"), text=strip(F.col("text")))
    listed = F.array(*(F.struct(F.lit(i).alias("ord"), F.lit(q).alias("question_id"), F.lit(p).alias("prompt"), F.array(*map(F.lit, o)).alias("options")) for i, q, p, o in rows))
    return personas.select(need["id"].cast("string").alias("subject_id"), need["text"].alias("persona"), F.explode(listed).alias("q")).select("subject_id", "persona", "q.*", F.lit("multiple_choice").alias("kind"), F.lit("answer").alias("response_mode"))


def pricing(dataset: str, question_id: Column) -> Column:
    """Whether a question is of the pricing study of its survey."""
    if dataset == "twin2k_500":
        return F.startswith(question_id, F.lit("QID9_"))
    if dataset == "bdm_lettuce":
        return question_id.isin(*OUTCOMES)
    raise DataError(f"{dataset} has no pricing study")


def pricing_bundle(bundle: Bundle, dataset: str, asked: int) -> Bundle:
    """The pricing questions of a survey; a person with other than `asked` of them is an error."""
    kept = bundle.filtered(pricing(dataset, F.col("question_id")))
    if odd := unequal_counts(kept.subjects, kept.cases, "subject_id", asked).limit(5).collect():
        raise DataError(f"persons without {asked} pricing questions: {[tuple(r) for r in odd]}")
    return kept


def float_map(c: Column) -> Column:
    """The entries of a map of texts that are numbers, as numbers."""
    return F.map_filter(F.transform_values(c, lambda k, v: v.try_cast("double")), lambda k, v: v.isNotNull())


def adapted(demographics: Column) -> Column:
    """What a card reads of a person: known keys for survey ids, no outcomes, and education, hours and income derived where they are not given."""
    def derived(kept: Column) -> Column:
        at = lambda k: F.element_at(kept, k)
        more = {
            "education_bucket": F.when(at("education").isNotNull(), education_bucket(at("education"))),
            "work_hours": F.when(at("work_hours").isNull(), F.bround(weekly_hours(at("employment"))).cast("int").cast("string")),
            "income_over_50k": F.when(at("income_over_50k").isNull() & at("income").isNotNull(), F.coalesce(income_over_50k(at("income")), F.lit(False)).cast("string")),
        }
        entries = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in more.items())), lambda e: e["value"].isNotNull())
        return F.map_concat(F.map_filter(kept, lambda k, v: k != "education_bucket"), F.map_from_entries(entries))

    return let(F.map_filter(canonical_demographics(demographics), lambda k, v: ~k.isin(*OUTCOMES, DRAWN_PRODUCT, DRAWN_PRICE)), derived)


def refuse_expansion(dataset: str, unit: str, subjects: DataFrame) -> DataFrame:
    """subjects whose life may be told: persons with something known of them."""
    if unit != "individual" or dataset == "simbench":
        raise DataError("a life history is of one person; groups are refused")
    known = (F.coalesce(F.size("demographics"), F.lit(0)) > 0) | (F.coalesce(strip(F.col("persona_text")), F.lit("")) != "")
    return subjects.withColumn("subject_id", F.when(known, F.col("subject_id")).otherwise(F.raise_error(F.concat("subject_id", F.lit(" has no demographics to expand")))))


def income_stratum(demographics: Column, keys: Sequence[str] = ("QID21", "income", "household_income"), text: Column | None = None) -> Column:
    """The first of these demographics that is not blank, else an income answer in a text, else 'unknown'."""
    found = [blank_to_null(F.element_at(demographics, k)) for k in keys]
    if text is not None:
        lines = F.filter(F.split(text, "\n"), lambda line: F.contains(F.lower(line), F.lit("answer:")) & line.rlike(r"\$|income|000"))
        found.append(strip(F.regexp_extract(F.get(lines, 0), "^[^:]*:(.*)$", 1)))
    return F.coalesce(*found, F.lit("unknown"))


def field_map(dataset: str, source: str, columns: Sequence[str], stems: Mapping[str, str] | None, options: Mapping[str, Sequence[str]] | None, blocked: Sequence[str]) -> dict:
    """How each column gets onto a card, for the manifest."""
    # fixed sentence of the manifest
    rule = "Copy the cell after removing only leading and trailing whitespace. A blank cell is stored as MISSING. A cell whose text is that token fails. No other value is inferred."
    one = lambda c: {
        "card_section": "Basics", "source_column": c, "source_file": source, "source_question_id": c, "transform": rule,
        "source_question_text": stems[c] if stems else None, "source_options": list((options or {}).get(c, [])) if stems else None,
        "source_question_text_status": "copied_from_question_catalog" if stems else "unavailable_machine_readable_wording",
    }
    return {"blocked_columns": list(blocked), "dataset": dataset, "fields": [one(c) for c in columns], "source_file": source}
