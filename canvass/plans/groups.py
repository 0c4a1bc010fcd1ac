"""Group distributions: catalog of questions, cases, and shares of answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.functions.text import group_key, make_qid

#: Cases that are counted together, and ranges of a split at most.
RANGE_ROWS, MOST_RANGES = 500_000, 4096
#: Splits whose bounds go to every task.
FEW_SPLITS = 1000
OPTION = r"(?m)^\(([A-Za-z0-9]+)\)\s*:\s*(.*)$"
BLOCK = r"(?i)\n\s*Options:\s*\n"


def parse_options(template: Column, answer_options: Column, human_answer: Column) -> Column:
    """(stem, keys, texts, status) of a question: from an answer map, an options block, options in the text, or the keys of the answer."""
    parts = F.split(template, BLOCK, 2)
    block = F.size(parts) == 2
    stem = F.trim(F.get(parts, 0))
    rank = lambda k: F.when(k.rlike("^[A-Za-z]$"), 0).when(k.rlike("^[0-9]+$"), 1).otherwise(2)
    order = lambda k: F.struct(rank(k).alias("r"), F.when(rank(k) == 1, k).try_cast("decimal(38,0)").alias("n"), F.when(rank(k) == 0, F.upper(k)).otherwise(k).alias("u"))
    entries = F.array_sort(F.transform(F.map_entries(answer_options), lambda e: F.struct(order(e["key"]).alias("o"), e["key"].alias("k"), e["value"].alias("v"))))
    fallback = F.array_sort(F.transform(F.map_keys(human_answer), lambda k: F.struct((F.length(k) != 1).alias("o"), k.alias("k"))))
    pick = lambda text, i: F.regexp_extract_all(text, F.lit(OPTION), F.lit(i))
    body = F.get(parts, 1)
    inline = F.regexp_extract(template, r"(?s)^(.*?)\([A-Za-z0-9]+\)\s*:", 1)
    out = lambda s, k, t, status: F.struct(s.alias("stem"), k.alias("keys"), t.alias("texts"), F.lit(status).alias("status"))
    none = F.array().cast("array<string>")
    keys = lambda x: F.transform(x, lambda e: e["k"])
    return (
        F.when(F.size(answer_options) > 0, out(F.when(block, stem).otherwise(template), keys(entries), F.transform(entries, lambda e: e["v"]), "from_answer_options"))
        .when(block & (F.size(pick(body, 1)) > 0), out(stem, pick(body, 1), F.transform(pick(body, 2), lambda o: F.trim(o)), "from_options_block"))
        .when(~block & (F.size(pick(template, 1)) > 0), out(F.trim(inline), pick(template, 1), F.transform(pick(template, 2), lambda o: F.trim(o)), "from_inline_options"))
        .when(F.size(human_answer) > 0, out(F.when(block, stem).otherwise(F.trim(template)), keys(fallback), keys(fallback), "fallback_human_answer_keys"))
        .otherwise(F.when(block, out(stem, none, none, "fail_options_block_no_match")).otherwise(out(F.trim(template), none, none, "fail_no_options_block")))
    )


def cases(rows: DataFrame) -> DataFrame:
    """rows (split, dataset_name, input_template, variables, ord) with question and case ids; the index counts within a split.

    The index is a running count over ranges of `ord`, as many as the largest
    split needs for RANGE_ROWS each, and not one window over a split. Ranges are
    cut at approximate quantiles, which decide how even they are and not what
    the index is: a row's range follows from its `ord` alone.
    """
    largest, splits = rows.groupBy("split").count().agg(F.coalesce(F.max("count"), F.lit(0)), F.count("*")).first()
    ranges = min(MOST_RANGES, max(2, -(-largest // RANGE_ROWS)))
    grid = F.array(*(F.lit(i / ranges) for i in range(1, ranges)))
    bounds = rows.groupBy("split").agg(F.array_distinct(F.percentile_approx("ord", grid, max(1000, 10 * ranges))).alias("__bounds"))
    ranged = rows.join(F.broadcast(bounds) if splits <= FEW_SPLITS else bounds, "split").withColumn("__p", F.size(F.filter("__bounds", lambda b: b < F.col("ord")))).drop("__bounds")
    counts = ranged.groupBy("split", "__p").count()
    before = counts.withColumn("before", F.sum("count").over(W.partitionBy("split").orderBy("__p")) - F.col("count")).drop("count")
    at = F.row_number().over(W.partitionBy("split", "__p").orderBy("ord"))
    numbered = ranged.withColumn("__i", at).join(before, ["split", "__p"]).withColumn("idx", F.col("before") + F.col("__i") - 1)
    named = numbered.withColumn("question_id", make_qid(F.col("dataset_name"), F.col("input_template")))
    return named.withColumns({"case_id": F.concat_ws(":", "split", "dataset_name", F.format_string("%05d", "idx")), "group_key": group_key(F.col("dataset_name"), F.col("variables"))}).drop("__p", "__i", "before")


def catalog(rows: DataFrame) -> DataFrame:
    """One row for each question: its first template, the first options of any row, where it occurs."""
    order = F.struct("split", "ord")
    has = F.size("options") > 0
    source = F.collect_set("split")
    out = rows.groupBy("question_id").agg(
        F.min_by("input_template", order).alias("template"), F.min_by(F.when(has, F.col("options")), F.when(has, order)).alias("options"),
        F.array_sort(F.collect_set("dataset_name")).alias("datasets"), F.when(F.size(source) > 1, "both").otherwise(F.get(source, 0)).alias("source"), F.count("*").alias("cases"),
    )
    return out


def breakdown(rows: DataFrame, key: str, splits: Sequence[str]) -> DataFrame:
    """(key, a column for each split, total): rows of each key by split."""
    return rows.groupBy(key).agg(*(F.count_if(F.col("split") == s).alias(s) for s in splits), F.count("*").alias("total"))


def unknown_questions(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Question ids of rows that a catalog lacks, with the rows they have."""
    return rows.join(known.select("question_id"), "question_id", "left_anti").groupBy("question_id").agg(F.count("*").alias("rows"))


def shares(rows: DataFrame) -> DataFrame:
    """(case_id, label, share) of answer maps; sums over 1.5 are percentages."""
    total = F.aggregate(F.map_values("answer"), F.lit(0.0), lambda a, x: a + x)
    long = rows.select("case_id", total.alias("total"), F.explode("answer").alias("label", "raw"))
    return long.select("case_id", "label", F.when(F.col("total") > 1.5, F.col("raw") / 100).otherwise(F.col("raw")).alias("share"))


def share_sum_issues(long: DataFrame) -> DataFrame:
    """Cases whose shares miss 1 by more than a thousandth."""
    return long.groupBy("case_id").agg(F.sum("share").alias("total")).filter(F.abs(F.col("total") - 1) > 1e-3)
