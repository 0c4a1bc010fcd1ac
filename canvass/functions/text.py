"""Text, label and number functions; all of them run inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from canvass.functions import let

#: White space as Python's str.strip and \\s see it, spelled out so that other engines can share it.
SPACE = "[\\t\\n\\x0b\\f\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends; null is ''."""
    return strip(F.regexp_replace(F.coalesce(c, F.lit("")), f"{SPACE}+", " "))


def blank_to_null(c: Column) -> Column:
    return let(strip(c), lambda x: F.nullif(x, F.lit("")))


def strip_html(c: Column) -> Column:
    """Tags to spaces, two entities decoded, white space squeezed; null is ''."""
    text = F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), "<[^>]*>", " ")
    return squeeze(F.replace(F.replace(text, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&")))


#: Letters whose full case folding is longer than their lower case.
LONG_FOLDS = {"ß": "ss", "ŉ": "ʼn", "ǰ": "ǰ", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "ẞ": "ss", "ς": "σ", "ſ": "s"}


def casefold(c: Column) -> Column:
    # one letter of the list leads to the replacements; ẞ is lowered to ß first
    long = lambda low: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), LONG_FOLDS.items(), low)
    return let(F.lower(c), lambda low: F.when(low.rlike(f"[{''.join(LONG_FOLDS)}]"), long(low)).otherwise(low))


def norm_label(c: Column) -> Column:
    """Stripped and case-folded; blank is null."""
    return casefold(blank_to_null(c))


def normalize_cell(c: Column) -> Column:
    """(value, status): blank is MISSING; the text MISSING itself and line breaks are errors."""
    text = strip(F.coalesce(c, F.lit("")))
    value = (
        F.when(text == "", F.lit("MISSING"))
        .when(text == "MISSING", F.raise_error(F.lit("source cell is the reserved token MISSING")))
        .when(text.rlike("[\\n\\r]"), F.raise_error(F.lit("source cell contains a newline")))
        .otherwise(text)
    )
    return F.struct(value.alias("value"), F.when(text == "", "missing").otherwise("present").alias("status"))


def sanitize_dataset(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "")


def make_qid(dataset: Column, template: Column) -> Column:
    """SB_, the bare dataset name, and 8 hex digits of the SHA-1 of dataset, two bars and the squeezed template."""
    digest = F.sha1(F.concat(dataset, F.lit("||"), squeeze(template)).cast("binary"))
    return F.concat(F.lit("SB_"), sanitize_dataset(dataset), F.lit("_"), F.substring(digest, 1, 8))


def canonical_pid(c: Column) -> Column:
    return F.regexp_replace(strip(c.cast("string")), "^(?i)pid_", "")


def format_template(template: Column, variables: Column) -> Column:
    """{key} replaced by its value, one entry after the other in the order of `variables`, an array of (key, value)."""
    return F.aggregate(variables, template, lambda text, kv: F.replace(text, F.concat(F.lit("{"), kv["key"], F.lit("}")), kv["value"]))


def group_key(dataset: Column, variables: Column) -> Column:
    """dataset:k=v|k=v by key, or dataset:population without variables; `variables` is a map."""
    pairs = F.transform(F.array_sort(F.map_entries(variables)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(dataset, F.lit(":"), F.when(F.coalesce(F.size(pairs), F.lit(0)) <= 0, F.lit("population")).otherwise(F.array_join(pairs, "|")))


# Fixed phrases of yes-no answers, in the order in which they are tried.
NO_PHRASES = ("would not", "wouldn't", "will not", "not purchase", "not buy", "do not", "don't")
YES_PHRASES = ("would purchase", "would buy", "will buy", "will purchase", "i'd buy")


def normalize_yes_no(c: Column) -> Column:
    """Yes or No from the start of the answer, else from phrases; null if neither."""
    text = F.lower(strip(c))
    has = lambda phrases: reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))
    return F.when(text.rlike("^yes"), "Yes").when(text.rlike("^no"), "No").when(has(NO_PHRASES), "No").when(has(YES_PHRASES), "Yes")


#: Numbers that need no rule but a percent sign dropped, and are finite; most answers are.
PLAIN = r"^[+-]?([0-9]{1,300}(\.[0-9]*)?|\.[0-9]+)%?$"


def parse_number(c: Column) -> Column:
    """A finite double, with true and yes as 1, false and no as 0, commas dropped and a percent sign at the end ignored."""

    def told(text: Column) -> Column:
        finite = lambda bare: F.when(bare.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), bare.try_cast("double"))
        number = let(let(F.regexp_replace(F.replace(text, F.lit(",")), "%$", ""), finite), lambda x: F.when(F.abs(x) < float("inf"), x))
        return let(F.lower(text), lambda low: F.when(low.isin("true", "yes"), 1.0).when(low.isin("false", "no"), 0.0).otherwise(number))

    # the rules are tried on what is left only; a text is stripped and folded once
    return F.when(c.rlike(PLAIN), F.rtrim(c, F.lit("%")).try_cast("double")).otherwise(let(strip(c), told))


def encode_folded(text: Column, folded: Column) -> Column:
    """1-based option of a folded answer among folded options: the same, else the first of which one is the other's prefix; null if none."""
    hits = F.filter(F.transform(folded, lambda o, i: F.when(o.startswith(text) | text.startswith(o), i + 1)), lambda i: i.isNotNull())
    return F.when(text.isNotNull(), let(F.array_position(folded, text), lambda exact: F.when(exact > 0, exact).otherwise(F.get(hits, F.lit(0)).cast("long"))))


def encode_with_options(answer: Column, options: Column) -> Column:
    """1-based option: an exact folded match, else the first of which one is the other's prefix; null if none."""
    return let(F.struct(norm_label(answer).alias("t"), F.transform(options, norm_label).alias("o")), lambda x: encode_folded(x["t"], x["o"]))


# Education: (bucket, words of which one must occur), in the order in which they are tried.
EDUCATION_RULES = (
    ("less_than_high_school", ("less than", "no formal")),
    ("some_college", ("some college", "some university", "associate")),
    ("high_school", ("high school",)),
    ("bachelor_or_higher", ("bachelor", "college graduate", "postgrad", "graduate", "university", "professional", "master", "doctorate", "doctoral")),
    ("some_college", ("college",)),
)


def first_rule(text: Column, rules: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The label of the first rule one of whose words occurs."""
    out = F.lit(otherwise)
    for label, words in reversed(rules):
        hit = reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words))
        out = F.when(hit, F.lit(label)).otherwise(out)
    return out


def education_bucket(c: Column) -> Column:
    names = sorted({label for label, _ in EDUCATION_RULES} | {"unknown"})
    return F.when(c.isin(*names), c).otherwise(first_rule(F.replace(F.lower(c), F.lit("’"), F.lit("'")), EDUCATION_RULES, "unknown"))


# Family labels by folded answer.
FAMILY = {
    "never been married": "Never married",
    "never married": "Never married",
    "living with a partner": "Living with a partner",
    "married": "Married",
    "divorced": "Divorced",
    "separated": "Separated",
    "widowed": "Widowed",
}


def family_key(c: Column) -> Column:
    out = F.lit("Unknown")
    for folded, label in FAMILY.items():
        out = F.when(F.lower(c) == folded, label).otherwise(out)
    return out


# Statuses outside paid work.
NONWORK = ("unemployed", "retired", "student", "home-maker", "homemaker", "home maker")


def weekly_hours(c: Column) -> Column:
    """0 outside paid work (also for a full-time student), 20 part-time, 40 full-time, else null."""
    text = F.lower(strip(c))
    idle = reduce(lambda a, b: a | b, (text.endswith(w) | F.contains(text, F.lit(f" {w}")) for w in NONWORK))
    return F.when(idle, 0.0).when(text.rlike("part[- ]time"), 20.0).when(text.rlike("full[- ]time"), 40.0)


def income_over_50k(c: Column) -> Column:
    first = F.regexp_replace(F.regexp_extract(c, r"\d[\d,]*", 0), ",", "")
    return F.coalesce(F.nullif(first, F.lit("")).try_cast("decimal(38,0)") >= 50_000, F.lit(False))


def truthy(c: Column) -> Column:
    return F.coalesce(F.lower(strip(c)).isin("1", "true", "yes", "y"), F.lit(False))


def place_line(state: Column, region: Column) -> Column:
    s, r = blank_to_null(state), blank_to_null(region)
    return F.when(s.isNotNull(), F.concat(F.lit("State: "), s)).when(r.isNotNull(), F.concat(F.lit("Region: "), r)).otherwise("State: Unknown")


def with_options(prompt: Column, options: Column) -> Column:
    """The prompt and a bullet list of its options."""
    listed = F.concat(F.lit("Options:\n"), F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o)), "\n"))
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, prompt).when(prompt == "", listed).otherwise(F.concat(prompt, F.lit("\n"), listed))


def question_body(prompt: Column, options: Column) -> Column:
    """A prompt that gets its options listed unless it lists some itself."""
    listed = F.concat(strip(prompt), F.lit("\n\nOptions:\n"), F.array_join(F.transform(options, lambda o: F.concat(F.lit("- "), o)), "\n"))
    return F.when((F.coalesce(F.size(options), F.lit(0)) > 0) & ~F.contains(prompt, F.lit("Options:")), listed).otherwise(strip(prompt))


def question_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("mc", "multiple choice"), "multiple_choice").when(low == "matrix", "likert").when(low == "slider", "numeric").otherwise("text")


def proportion8(part: Column, whole: Column) -> Column:
    """part / whole to 8 places, halves to even, in integers: the share times 10^8."""
    scaled = part.cast("decimal(38,0)") * 100_000_000
    whole = whole.cast("decimal(38,0)")
    q = F.floor(scaled / whole).cast("long")
    twice = (scaled - q.cast("decimal(38,0)") * whole) * 2
    up = (twice > whole) | ((twice == whole) & (q % 2 == 1))
    return q + up.cast("long")


def distinctive(c: Column) -> Column:
    """Long or marked enough to betray an outcome by occurring in a text."""
    return (F.length(c) >= 4) | c.rlike(r"[_$.]")


def leak_tokens(c: Column) -> Column:
    """Codes and prices in a text."""
    tokens = F.regexp_extract_all(c, F.lit(r"([A-Za-z0-9]+(?:[._-][A-Za-z0-9]+)*|\$\d+(?:\.\d+)?)"), F.lit(1))
    return F.array_distinct(F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$") & t.rlike(r"_|\.|^\$")))


#: How a question of the pricing study names its product and price.
PRICED = r"following product in that category: (.+?)\. The product is priced at: (\$\d+(?:\.\d+)?)"


def outcome_strings(item: Column) -> Column:
    """What an outcome may betray itself by: its answer, id, text and column, what it showed, and the product and price in its text."""
    question = item["question_text"]
    parts = [item[k] for k in ("answer", "question_id", "question_text", "source_column")]
    priced = [F.nullif(F.regexp_extract(question, PRICED, i), F.lit("")) for i in (1, 2)]
    found = F.concat(F.array(*parts), F.coalesce(F.map_values(item["stimulus"]), F.array().cast("array<string>")), F.array(*priced))
    return F.array_distinct(F.filter(F.transform(found, strip), lambda x: x.isNotNull() & (x != "")))


def hours(c: Column) -> Column:
    """A number of hours, or null."""
    return strip(c).try_cast("double")


def wtp_prompt(product: Column) -> Column:
    start = "You are taking part in a Becker-DeGroot-Marschak elicitation in Ontario, Canada. What is the most you would pay, in Canadian dollars from 0 to 10, for "
    return F.concat(F.lit(start), product, F.lit("?"))


def purchase_prompt(product: Column, price: Column) -> Column:
    what = F.coalesce(blank_to_null(product), F.lit("the randomly selected lettuce"))
    cost = F.coalesce(blank_to_null(price), F.lit("the randomly drawn price"))
    return F.concat(
        F.lit("Under the same Becker-DeGroot-Marschak rule, one product was drawn at random ("), what, F.lit(") and a price was drawn at random ("), cost,
        F.lit(" Canadian dollars). Would you purchase that product at the drawn price? Answer TRUE or FALSE."),
    )
