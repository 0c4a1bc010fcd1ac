"""From replies and held-out answers to metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canvass.errors import DataError
from canvass.functions import let, trees
from canvass.functions.text import encode_folded, norm_label, parse_number
from canvass.operators import metrics
from canvass.operators.relational import first_wins, made_once
from canvass.plans.builders import PURCHASE
from canvass.plans.simulation import written


def paired_labels(responses: DataFrame, item: str, human: str, model: str) -> DataFrame:
    """(item, label, human, model) counts over rows that have both labels."""
    pairs = responses.select(F.col(item).alias("item"), norm_label(F.col(human)).alias("h"), norm_label(F.col(model)).alias("m")).filter("h is not null and m is not null")
    long = pairs.select("item", F.explode(F.array(F.struct(F.col("h").alias("label"), F.lit(1).alias("human"), F.lit(0).alias("model")), F.struct(F.col("m").alias("label"), F.lit(0).alias("human"), F.lit(1).alias("model")))).alias("x"))
    return long.groupBy("item", "x.label").agg(F.sum("x.human").alias("human"), F.sum("x.model").alias("model"))


def mean_tvd_by_item(responses: DataFrame, item: str, human: str, model: str) -> DataFrame:
    """Unweighted means over items of total variation and top-1."""
    per = metrics.tvd_top1(paired_labels(responses, item, human, model), ["item"])
    return per.agg(F.avg("tvd").alias("mean_tvd"), F.avg("top1").alias("mean_top1"), F.count("*").alias("items"))


def scales(asked: DataFrame, catalog: DataFrame) -> DataFrame:
    """(question_id, options, span, kind) of questions asked (question_id, options, kind, ord), with what the catalog knows beside.

    What was asked comes first; the catalog (QuestionID, QuestionType, Options,
    Columns, Rows, Range struct<Min, Max>) fills holes and adds its own
    questions and, for each row of a matrix, QID:n with the matrix' options.
    """
    several = lambda c: F.when(F.size(c) >= 2, (F.size(c) - 1).cast("double"))
    clean = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    first = first_wins(asked.filter("question_id <> ''").select("question_id", F.coalesce("options", F.array().cast("array<string>")).alias("options"), "kind", "ord"), ["question_id"], ["ord"])
    mine = first.select("question_id", "options", several(F.col("options")).alias("span"), "kind")
    options = F.when(F.size(clean(F.col("Options"))) > 0, clean(F.col("Options"))).otherwise(clean(F.col("Columns")))
    listed = catalog.select(F.col("QuestionID").alias("question_id"), options.alias("c_options"), F.coalesce(several(options), F.col("Range.Max").cast("double") - F.col("Range.Min").cast("double")).alias("c_span"), F.coalesce("QuestionType", F.lit("")).alias("c_kind"), F.coalesce(F.size("Rows"), F.lit(0)).alias("rows"))
    both = mine.join(listed.drop("rows"), "question_id", "full_outer")
    filled = F.coalesce(F.size("options"), F.lit(0)) == 0
    base = both.select("question_id", F.when(filled, F.coalesce("c_options", "options")).otherwise(F.col("options")).alias("options"), F.coalesce("span", "c_span").alias("span"), F.coalesce("kind", "c_kind").alias("kind"))
    rows = listed.filter((F.col("rows") > 0) & (F.size("c_options") > 0)).select(F.explode(F.sequence(F.lit(1), F.col("rows"))).alias("i"), "question_id", "c_options")
    children = rows.select(F.concat_ws(":", "question_id", "i").alias("question_id"), F.col("c_options").alias("options"), (F.size("c_options") - 1).cast("double").alias("span"), F.lit("likert").alias("kind"))
    return base.unionByName(children.join(base.select("question_id"), "question_id", "left_anti"))


#: The span of a list of numbers of unknown scale.
SLIDER = 100.0
#: Scales that every task may hold.
FEW = 100_000


def encode_pairs(responses: DataFrame, scales: DataFrame) -> DataFrame:
    """(item, human, model, span) numbers of responses (question_id, human, model).

    Two lists with commas and as many parts give an item for each part, from 1;
    else options encode both answers; else both are numbers. A scale is that
    of the question or of the name before its colon; without one a list's span
    is SLIDER, and others are left to what is observed.
    """
    s = scales.select(F.col("question_id").alias("sid"), F.transform("options", norm_label).alias("options"), "span")
    if scales.limit(FEW + 1).count() <= FEW:
        # a question has any number of answers, which a join by the question would send to one task
        s = F.broadcast(s)
    base = F.element_at(F.split("question_id", ":"), 1)
    joined = responses.join(s.alias("a"), F.col("question_id") == F.col("a.sid"), "left").join(s.alias("b"), base == F.col("b.sid"), "left")
    rows = joined.select("question_id", F.coalesce("a.options", "b.options").alias("options"), F.coalesce("a.span", "b.span").alias("span"), "human", "model")
    pair = lambda item, human, model, span: F.struct(item.alias("item"), human.alias("human"), model.alias("model"), span.alias("span"))
    h, m = F.split("human", ","), F.split("model", ",")
    is_list = F.contains("human", F.lit(",")) & F.contains("model", F.lit(",")) & (F.size(h) == F.size(m))
    part = lambda x, i: pair(F.concat("question_id", F.lit(":"), i + 1), parse_number(x["h"]), parse_number(x["m"]), F.coalesce("span", F.lit(SLIDER)))
    code = lambda c: F.when(F.size("options") > 0, encode_folded(c, F.col("options"))).cast("double")
    coded = let(F.struct(let(norm_label(F.col("human")), code).alias("h"), let(norm_label(F.col("model")), code).alias("m")), lambda x: F.when(x["h"].isNotNull() & x["m"].isNotNull(), x))
    number = pair(F.col("question_id"), parse_number(F.col("human")), parse_number(F.col("model")), F.col("span"))
    single = let(coded, lambda x: F.when(x.isNotNull(), pair(F.col("question_id"), x["h"], x["m"], F.coalesce("span", (F.size("options") - 1).cast("double")))).otherwise(number))
    pairs = F.when(is_list, F.transform(F.arrays_zip(h.alias("h"), m.alias("m")), part)).otherwise(F.array(single))
    return made_once(rows, pairs=pairs).select(F.inline("pairs")).filter("human is not null and model is not null")


def encode_bids(responses: DataFrame) -> DataFrame:
    """(item, human, model, span) of bids from 0 to 10 and of the purchase, yes as 1."""
    span = F.when(F.col("question_id") == PURCHASE, 1.0).otherwise(10.0)
    out = made_once(responses, x=F.struct(parse_number(F.col("human")).alias("human"), parse_number(F.col("model")).alias("model")))
    return out.select(F.col("question_id").alias("item"), "x.human", "x.model", span.alias("span")).filter("human is not null and model is not null")


def study_cells(responses: DataFrame) -> DataFrame:
    """(study, h, m) of responses (question_id, payload, model): the questions of a survey tree beside the entries of a reply."""
    rows = responses.filter("payload is not null and model is not null").select(F.element_at(F.split("question_id", ":"), 1).alias("study"), F.col("payload").cast("string").alias("payload"), F.col("model").cast("string").alias("model"))
    parts = trees.reply_parts(trees.survey_parts(rows, "payload", "h"), "model", "m").select("study", "h", "m")
    return trees.read_once(parts, {"h": trees.survey_read, "m": trees.reply_read})


def _paired(cells: DataFrame) -> DataFrame:
    """(study, name, h, m) of cells, by place if equally many, else along the longest common run of types."""
    types = lambda c: F.transform(c, lambda x: x["type"])
    typed = made_once(cells, th=types(F.col("h")), tm=types(F.col("m")))
    pairs = made_once(typed, pairs=trees.aligned(F.col("th"), F.col("tm"))).select("study", "h", "m", F.explode("pairs").alias("p"))
    return pairs.select("study", F.get("h", F.col("p.human")).alias("h"), F.get("m", F.col("p.model")).alias("m")).select("study", F.col("m.name").alias("name"), "h", "m")


def study_labels(cells: DataFrame) -> DataFrame:
    """(question_id, human, model) forms of cells. Questions without an answer are left out before they are paired."""
    said = lambda c: F.filter(c, lambda x: x["form"].isNotNull())
    pairs = _paired(cells.withColumns({c: said(F.col(c)) for c in "hm"}))
    return pairs.select(F.concat_ws(":", "study", "name").alias("question_id"), F.col("h.form").alias("human"), F.col("m.form").alias("model"))


def encode_cells(cells: DataFrame) -> DataFrame:
    """(item, human, model, span) numbers of cells. Lists of one length give an item for each part, from 1.

    All questions of the tree are paired, and the entries of the reply that
    hold more than a list of places which are no numbers.

    The span is the human side's, else the model's, else what the two numbers
    are apart, or 1; an item has the largest of its spans.
    """
    pairs = _paired(cells.withColumn("m", F.filter("m", lambda x: x["told"])))
    options = F.when(F.size("h.options") > 0, F.col("h.options")).otherwise(F.col("m.options"))
    known = F.coalesce("h.span", "m.span", F.when(F.size(options) >= 2, (F.size(options) - 1).cast("double")))
    item = F.concat_ws(":", "study", "name")
    rows = pairs.select(item.alias("item"), known.alias("known"), F.col("h.codes").alias("hc"), F.col("m.codes").alias("mc"), F.col("h.several").alias("hs"), F.col("m.several").alias("ms"))
    lists = F.col("hs") & F.col("ms") & (F.size("hc") == F.size("mc"))
    ones = ~F.col("hs") & ~F.col("ms") & (F.size("hc") == 1) & (F.size("mc") == 1)
    every = F.concat("hc", "mc")
    apart = F.array_max(every) - F.array_min(every)
    # a scale of no length is kept for lists, where it makes 1; a single number takes what is observed
    span = F.when(lists, F.coalesce("known", apart)).otherwise(F.when(F.col("known") > 0, F.col("known")).otherwise(apart))
    fit = rows.filter(lists | ones).select("item", lists.alias("several"), F.when(span > 0, span).otherwise(1.0).alias("span"), F.posexplode(F.arrays_zip("hc", "mc")).alias("i", "x"))
    return fit.select(F.when(F.col("several"), F.concat_ws(":", "item", F.col("i") + 1)).otherwise(F.col("item")).alias("item"), F.col("x.hc").alias("human"), F.col("x.mc").alias("model"), "span")


def summary(codes: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of pooled metrics of codes (item, human, model, span) and labels (question_id, human, model)."""
    means = mean_tvd_by_item(labels, "question_id", "human", "model")
    return metrics.coded_summary(codes).join(means.drop("items"), F.lit(True))  # one row beside one row


def score_run(dataset: str, responses: DataFrame, scales_: DataFrame | None = None) -> DataFrame:
    """The metrics of a run of one survey; responses have question_id, human, model, and payload for studies."""
    if dataset == "twin2k_500":
        if scales_ is None:
            raise DataError("the twin survey needs scales")
        return summary(encode_pairs(responses, scales_), responses)
    if dataset == "bdm_lettuce":
        return summary(encode_bids(responses), responses)
    if dataset == "twin2k_mega_study":
        # read three times, by labels, numbers and ranges, and dear to make
        cells = written(responses.sparkSession, name="cells")(study_cells(responses))
        return summary(encode_cells(cells), study_labels(cells))
    raise DataError(f"no scorer for {dataset}")


def yes_no_cards(questions: DataFrame, responses: DataFrame, human: DataFrame) -> DataFrame:
    """A card for each question (qid, body): counts of yes and no, what was neither, the human share, total variation and mean, to 6 places.

    responses: qid, answer (Yes, No or other); human: qid, yes, no. Human
    shares are scaled to 1; a question without answers is 1 away.
    """
    counts = responses.groupBy("qid").agg(F.count_if(F.col("answer") == "Yes").alias("yes"), F.count_if(F.col("answer") == "No").alias("no"), F.count_if(~F.coalesce(F.col("answer").isin("Yes", "No"), F.lit(False))).alias("unparsed"))
    whole = F.col("yes") + F.col("no")
    said = human.select("qid", F.coalesce(F.try_divide("yes", whole), F.lit(0.0)).alias("human_yes"), F.coalesce(F.try_divide("no", whole), F.lit(0.0)).alias("human_no"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    joined = questions.join(said, "qid").join(counts, "qid", "left").withColumns({c: zero(F.col(c)) for c in ("yes", "no", "unparsed")})
    n = F.col("yes") + F.col("no")
    yes = F.coalesce(F.try_divide("yes", n), F.lit(0.0))
    tvd = F.when(n == 0, 1.0).otherwise((F.abs(yes - F.col("human_yes")) + F.abs(1 - yes - F.col("human_no"))) / 2)
    return joined.select("qid", "body", "yes", "no", n.alias("n"), "unparsed", F.round("human_yes", 6).alias("human_yes"), F.round("human_no", 6).alias("human_no"), F.round(tvd, 6).alias("tvd"), F.round(yes, 6).alias("mean"))


def score(responses: DataFrame, scales: DataFrame) -> DataFrame:
    """One row of all pooled metrics of a run."""
    return summary(encode_pairs(responses, scales), responses)


def compare(table: DataFrame, keys: Sequence[str], method: str, base: str, other: str, values: Sequence[str]) -> DataFrame:
    """Two methods side by side and other - base to 6 places; null where one is missing."""
    wide = table.groupBy(*keys).pivot(method, [base, other]).agg(*(F.first(v).alias(v) for v in values))
    if len(values) == 1:
        wide = wide.withColumnsRenamed({base: f"{base}_{values[0]}", other: f"{other}_{values[0]}"})
    return wide.withColumns({f"delta_{v}": F.round(F.col(f"{other}_{v}") - F.col(f"{base}_{v}"), 6) for v in values})


def exact_matches(responses: DataFrame, human: Column, model: Column, error: Column) -> DataFrame:
    """Hits, missing answers and errors, and the share of hits among the answered."""
    h, m = norm_label(human), norm_label(model)
    row = responses.select(h.alias("h"), m.alias("m"), error.alias("e"))
    answered = F.col("h").isNotNull() & F.col("m").isNotNull()
    hits, n = F.count_if(answered & (F.col("h") == F.col("m"))), F.count_if(answered)
    return row.agg(n.alias("n"), hits.alias("hits"), F.count_if(F.col("m").isNull() & F.col("e").isNull()).alias("missing"), F.count_if(F.col("e").isNotNull()).alias("errors"), F.try_divide(hits, n).alias("accuracy"))
