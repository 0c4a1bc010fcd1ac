"""Cards of persons: exact copies of survey cells, seeded life histories, and the audit for leaks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions import arrow_udf
from canvass.functions.text import blank_to_null, distinctive, education_bucket, family_key, income_over_50k, leak_tokens, normalize_cell, place_line, strip, weekly_hours
from canvass.operators.relational import reasons
from canvass.operators.sampling import first_uniform

CARD_VERSION = "basic_info_v1"


def basic_cards(rows: DataFrame, dataset: str, source: str, columns: Sequence[str], stems: Mapping[str, str] | None = None, options: Mapping[str, Sequence[str]] | None = None, key: str = "pid") -> DataFrame:
    """One card for each row: every column with its value or MISSING, its stem and options; a value outside its options is an error."""
    if lacking := [c for c in columns if c not in rows.columns]:
        raise DataError(f"required columns are absent: {lacking}")
    if stems is not None and (empty := [c for c in columns if not (stems.get(c) or "").strip()]):
        raise DataError(f"no question text for {empty}")
    cells = {c: normalize_cell(F.col(c)) for c in columns}
    fields = []
    for c in columns:
        allowed = list((options or {}).get(c, ()))
        value, status = cells[c]["value"], cells[c]["status"]
        if allowed:
            value = F.when((status == "present") & ~value.isin(*allowed), F.raise_error(F.concat(F.lit(f"{c} value is not in the catalog options: "), value))).otherwise(value)
        fields.append(F.struct(
            F.lit(c).alias("source_column"), F.array(*map(F.lit, allowed)).cast("array<string>").alias("source_options"), F.lit(c).alias("source_question_id"),
            F.lit(stems[c] if stems else None).cast("string").alias("source_question_text"), F.lit("copied" if stems else "unavailable").alias("source_question_text_status"),
            status.alias("status"), value.alias("value"),
        ))
    info = F.array(*fields)
    subject = strip(F.col(key))
    head = F.concat(F.lit(f"## Identity\ndataset: {dataset}\nsubject_id: "), subject, F.lit(f"\nsource_file: {source}\nsource_id_column: {key}\n\n## Basics\n"))
    text = F.concat(head, F.array_join(F.transform("basic_info", lambda f: F.concat(f["source_column"], F.lit(": "), f["value"])), "\n"), F.lit("\n"))
    out = rows.select(info.alias("basic_info"), F.when(subject == "", F.raise_error(F.lit("row is missing pid"))).otherwise(subject).alias("subject_id"), F.col(key))
    return out.select(
        "basic_info", F.lit(CARD_VERSION).alias("card_version"), F.lit(dataset).alias("dataset"), F.lit(source).alias("source_file"), F.lit(key).alias("source_id_column"), "subject_id", text.alias("text")
    )


#: Words that only generated text has.
GENERATED = ("## Life history", "## Typical day", "Childhood:", "Turning point:", "Work path:", "Moves:", "Answer:")


def generated_text(text: Column) -> Column:
    """True if a card has a mark of generated text or other headings than its two."""
    marks = reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in GENERATED))
    return marks | (F.size(F.regexp_extract_all(text, F.lit("(?m)^(## .*)$"), F.lit(1))) != 2)


def eligibility(rows: DataFrame, outcomes: DataFrame, expected: Sequence[str], key: str = "pid") -> DataFrame:
    """(pid, reason) of the rows that cannot be used, with the first reason that holds; outcomes have items array<struct<question_id, answer>>."""
    joined = rows.select(key).join(outcomes, key, "left")
    ids = F.transform("items", lambda i: i["question_id"])
    blank = F.get(F.filter("items", lambda i: F.trim(F.coalesce(i["answer"], F.lit(""))) == ""), 0)
    reason = reasons([
        (F.trim(F.coalesce(F.col(key).cast("string"), F.lit(""))) == "", "missing pid"),
        (F.col("items").isNull() | (F.size("items") == 0), "missing pricing outcomes"),
        (ids != F.array(*map(F.lit, expected)), "pricing outcome ids are not the expected set in order"),
    ])
    reason = F.coalesce(reason, F.when(blank.isNotNull(), F.concat(F.lit("pricing outcome "), blank["question_id"], F.lit(" is blank"))))
    return joined.select(key, reason.alias("reason")).filter("reason is not null")


def leaks(cards: DataFrame, outcomes: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, kind, text) of outcomes that show on the person's own card.

    Persons are joined first, so nothing is compared across persons. Digits
    count only as all that a line says, distinctive strings wherever they stand,
    codes and prices as whole tokens. What is a value of the card itself is
    no leak.
    """
    body = F.element_at(F.split("text", "\n## Basics\n"), -1)
    values = F.transform("basic_info", lambda f: f["value"])
    mine = cards.select(key, body.alias("body"), values.alias("values"), leak_tokens(body).alias("tokens"))
    pairs = mine.join(outcomes.select(key, blank_to_null(F.col("text")).alias("needle")).filter("needle is not null"), key)
    pairs = pairs.filter(~F.array_contains("values", F.col("needle")))
    digits = F.col("needle").rlike("^[0-9]+$")
    lines = F.filter(F.split("body", "\n"), lambda x: F.contains(x, F.lit(": ")))
    shown = F.transform(lines, lambda x: F.regexp_extract(x, r"(?s)^.*?: (.*)$", 1))
    kind = (
        F.when(digits, F.when(F.array_contains(shown, F.col("needle")), "value"))
        .when(distinctive(F.col("needle")) & F.contains("body", F.col("needle")), "text")
        .when(F.size(F.array_except(F.array_intersect("tokens", leak_tokens(F.col("needle"))), "values")) > 0, "token")
    )
    return pairs.select(key, kind.alias("kind"), F.col("needle").alias("text")).filter("kind is not null")


# Fixed sentences of life histories.
CHILDHOOD = (
    "Grew up in a small town where weekends meant yard work and church potlucks.",
    "Raised in a dense suburb; after-school time was split between homework and siblings.",
    "Spent childhood near extended family; holidays were crowded and loud.",
    "Moved once as a kid for a parent's job and learned to make friends quickly.",
    "Grew up in a quiet household that valued keeping to a routine.",
)
SCHOOLING = {
    "less_than_high_school": ("Left school early to help with bills and never finished a diploma track.", "Tried adult-ed classes later but did not complete a credential."),
    "high_school": ("Finished high school and went straight into local work instead of college.", "Graduated high school, briefly considered trade school, then took a steady job."),
    "some_college": ("Started community college, paused after a few semesters, and may go back.", "Earned certificates between jobs but never completed a bachelor's degree."),
    "bachelor_or_higher": ("Completed a bachelor's degree and still leans on that training at work.", "Finished college later than peers and treats the degree as a hard-won reset."),
    "unknown": ("Education path is uneven; learning mostly happened on the job.",),
}
WORK = {
    "high": (
        "Built a full-time career with raises tied to long hours and reliability.",
        "Moved into a higher-paying role after a stretch of overtime and skill-building.",
        "Keeps a demanding schedule; work often crowds evenings.",
    ),
    "low": (
        "Pieces together part-time or gig work around other obligations.",
        "Has had uneven employment; some months are thin on hours.",
        "Prioritizes flexible shifts even when pay stays modest.",
    ),
    "mid": ("Holds a regular job with ordinary hours and few dramatic promotions.", "Stayed in the same field for years; changes come slowly."),
}
FAMILY = {
    "Married": ("Shares a household with a spouse and coordinates chores around both schedules.", "Married life means joint budgets, shared errands, and evening check-ins."),
    "Never married": ("Lives independently; close friends fill some of the roles a partner might.", "Has stayed single and keeps a household routine built around personal habits."),
    "Divorced": ("After a divorce, rebuilt a quieter home routine and clearer boundaries.", "Post-divorce years meant relearning solo logistics and smaller gatherings."),
    "Separated": ("Currently separated; day-to-day plans are in flux and often negotiated.",),
    "Widowed": ("Lost a spouse and adjusted to a house that feels too large on some days.",),
    "Living with a partner": ("Shares a home with a partner without a marriage, and splits day-to-day costs.", "Living with a partner means two schedules and one grocery list."),
    "Unknown": ("Family life is private; weekdays are mostly self-managed.",),
}
MOVES = (
    "Settled in the current state for work and stayed longer than planned.",
    "Followed family to the current state and gradually put down roots.",
    "Came for school or a first job, then the place became home.",
    "Relocated within the last decade and is still learning the local rhythms.",
)
TURNING = (
    "A caregiving stretch reordered the week and still shows up in daily minutes.",
    "A job change lengthened the commute and shortened leisure.",
    "A health scare in the family pushed personal care and rest higher on the list.",
    "Remote or flexible work briefly expanded free time, then responsibilities crept back.",
    "Money stress led to an extra shift and less evening social time.",
)
# Further lines of a card, in order: key and label.
EXTRAS = {
    "income": "Household income", "household_size": "Household size", "political": "Political leaning", "political_party": "Political party", "employment": "Employment",
    "citizenship": "US citizen", "religion": "Religion", "worship_attendance": "Religious attendance", "primary_grocery_shopper": "Primary grocery shopper", "primary_cook": "Primary cook",
}

#: Draws with the generator of a name: one index for each of the given numbers of choices, in turn.
seeded_choices = arrow_udf(lambda name, sizes: (lambda rng: [rng.randrange(n) for n in sizes])(first_uniform(name)), "array<int>")


def _array(items: Sequence[str]) -> Column:
    return F.array(*map(F.lit, items))


def _by_key(table: Mapping[str, Sequence[str]], key: Column) -> Column:
    return reduce(lambda out, kv: F.when(key == kv[0], _array(kv[1])).otherwise(out), table.items(), _array(table.get("Unknown") or table.get("unknown") or next(iter(table.values()))))


def minutes(c: Column) -> Column:
    """Whole minutes, halves to even."""
    return F.bround(c, 0).cast("long").cast("string")


def life_cards(persons: DataFrame, seed: int = 0) -> DataFrame:
    """(subject_id, text): basics, a seeded life history and the day of persons (subject_id, demographics, routine).

    Only the draws are Python; texts are put together in the JVM.
    """
    d = lambda k: blank_to_null(F.element_at("demographics", k))
    age, sex, race, education, marital = (F.coalesce(d(k), F.lit(v)) for k, v in (("age", "unknown"), ("sex", "Unknown"), ("race", "Unknown"), ("education", "unknown"), ("marital_status", "Unknown")))
    hours = F.coalesce(d("work_hours").try_cast("double"), weekly_hours(d("employment")))
    rich = F.coalesce(F.lower(d("income_over_50k")).isin("1", "true", "yes", "y"), income_over_50k(d("income")), F.lit(False))
    state, region = F.coalesce(d("state"), d("state_name")), d("region")
    work = F.when(rich & (hours.isNull() | (hours >= 35)), "high").when((hours < 30) | ~rich, "low").otherwise("mid")
    lists = [_array(CHILDHOOD), _by_key(SCHOOLING, education_bucket(education)), _by_key(WORK, work), _by_key(FAMILY, family_key(marital)), _array(MOVES), _array(TURNING)]
    base = persons.select("subject_id", "demographics", "routine", *(x.alias(f"l{i}") for i, x in enumerate(lists)), hours.alias("hours"), rich.alias("rich"), state.alias("state"), region.alias("region"))
    drawn = base.withColumn("i", seeded_choices(F.concat(F.lit(f"{seed}:"), "subject_id"), F.array(*(F.size(f"l{i}") for i in range(6)))))
    pick = [F.get(F.col(f"l{i}"), F.get("i", i)) for i in range(6)]
    whole_hours = minutes(F.col("hours"))
    place = F.when(F.col("state").isNotNull(), F.concat(F.lit(" Current home state: "), "state", F.lit("."))).when(F.col("region").isNotNull(), F.concat(F.lit(" Current census region: "), "region", F.lit("."))).otherwise("")
    entries = F.map_entries("routine")
    ranked = F.array_sort(F.transform(entries, lambda e: F.struct((-e["value"]).alias("m"), e["key"].alias("k"))))
    # of equal minutes the activity that the map names first
    top = F.get(F.array_sort(F.transform(entries, lambda e, i: F.struct((-e["value"]).alias("m"), i.alias("i"), e["key"].alias("k")))), 0)
    note = F.when(top.isNotNull(), F.concat(F.lit(" Time-use note: "), top["k"], F.lit(" averages about "), minutes(-top["m"]), F.lit(" minutes on a diary day."))).otherwise("")
    life = [
        ("Childhood", pick[0]), ("Schooling", pick[1]),
        ("Work path", F.concat(pick[2], F.when(F.col("hours").isNull(), " Weekly hours vary.").otherwise(F.concat(F.lit(" Typical weekly hours: "), whole_hours, F.lit("."))))),
        ("Family", pick[3]), ("Moves", F.concat(pick[4], place)), ("Turning point", F.concat(pick[5], note)),
    ]
    line = lambda label, value: F.concat(F.lit(f"{label}: "), value)
    basics = [
        line("Age", age), line("Sex", sex), place_line(F.col("state"), F.col("region")), line("Education", education), line("Marital status", marital), line("Race", race),
        line("Personal income", F.when(F.col("rich"), "over $50,000").otherwise("$50,000 or less")), line("Usual weekly work hours", F.coalesce(whole_hours, F.lit("unknown"))),
        F.when(F.col("state").isNotNull() & F.col("region").isNotNull(), line("Region", F.col("region"))), *(F.when(d(k).isNotNull(), line(label, d(k))) for k, label in EXTRAS.items()),
    ]
    day = F.concat(F.lit("\n\n## Typical day (ATUS minutes)\n"), F.array_join(F.transform(ranked, lambda r: F.concat(F.lit("- "), r["k"], F.lit(": "), minutes(-r["m"]), F.lit(" minutes"))), "\n"))
    text = F.concat(F.lit("## Basics\n"), F.concat_ws("\n", *basics), F.lit("\n\n## Life history\n"), F.concat_ws("\n", *(line(k, v) for k, v in life)), F.when(F.size("routine") > 0, day).otherwise(""))
    return drawn.select("subject_id", text.alias("text"))


# Fixed axes of tendency cards, with three levels each.
AXES = (
    ("问卷认真度", ("低", "中", "高")),
    ("价格敏感", ("低", "中", "高")),
    ("冲动", ("低", "中", "高")),
    ("对新奇零食 / 电子小件", ("排斥", "无所谓", "想试试")),
    ("对「看起来贵的日用品」", ("死抠", "一般", "不在乎")),
    ("未知品类默认", ("偏向不买", "五五开", "偏向买")),
)
TENDENCY_HEAD, TENDENCY_TAIL = "【本轮个人倾向｜整场调查固定不变】", "用这些倾向回答所有题；不要每题重新发明一套价值观。"


def tendency_cards(persons: DataFrame, key: str = "subject_id") -> DataFrame:
    """(key, text): one level of each axis, drawn by the id alone."""
    drawn = persons.select(key, seeded_choices(F.concat(F.lit("tendency:"), F.col(key)), F.array(*(F.lit(len(o)) for _, o in AXES))).alias("i"))
    lines = [F.concat(F.lit(f"- {label}："), F.get(_array(levels), F.get("i", n))) for n, (label, levels) in enumerate(AXES)]
    return drawn.select(key, F.concat_ws("\n", F.lit(TENDENCY_HEAD), *lines, F.lit(TENDENCY_TAIL)).alias("text"))
