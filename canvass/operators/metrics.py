"""Survey statistics in long form: one aggregate for each item, partial before the shuffle.

Share metrics take (item..., label, human, model) counts; paired metrics take
(item..., human, model) numbers. Null stands for a value that is not defined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def label_counts(rows: DataFrame, items: Sequence[str], label: str, is_human: Column, is_model: Column) -> DataFrame:
    """Counts of each label for both sides; the labels of an item are those seen on either side."""
    sides = rows.filter(is_human | is_model)
    return sides.groupBy(*items, F.col(label).alias("label")).agg(F.count_if(is_human).alias("human"), F.count_if(is_model).alias("model"))


def shares(counts: DataFrame, items: Sequence[str]) -> DataFrame:
    """counts with p (human) and q (model) as shares, for items with both sides."""
    totals = W.partitionBy(*items)
    out = counts.withColumns({"hn": F.sum("human").over(totals), "mn": F.sum("model").over(totals)})
    return out.filter("hn > 0 and mn > 0").withColumns({"p": F.col("human") / F.col("hn"), "q": F.col("model") / F.col("mn")})


def tvd_top1(counts: DataFrame, items: Sequence[str]) -> DataFrame:
    """Total variation, and whether the sets of commonest labels meet, on exact counts."""
    totals = W.partitionBy(*items)
    top = counts.withColumns({c + suffix: f(c).over(totals) for c in ("human", "model") for suffix, f in (("_max", F.max), ("_n", F.sum))})
    both = (F.col("human") == F.col("human_max")) & (F.col("model") == F.col("model_max"))
    gap = F.abs(F.col("human") / F.col("human_n") - F.col("model") / F.col("model_n"))
    return top.filter("human_n > 0 and model_n > 0").groupBy(*items).agg((F.sum(gap) / 2).alias("tvd"), F.max(both.cast("int")).alias("top1"))


def jensen_shannon(counts: DataFrame, items: Sequence[str]) -> DataFrame:
    """In bits, with 0 log 0 = 0."""
    s = shares(counts, items).withColumn("m", (F.col("p") + F.col("q")) / 2)
    part = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log2(F.col(c) / F.col("m"))).otherwise(0.0)
    return s.groupBy(*items).agg((F.sum(part("p") + part("q")) / 2).alias("jsd"))


def ordered_distances(counts: DataFrame, items: Sequence[str], levels: int | None = None) -> DataFrame:
    """Wasserstein-1, Kolmogorov-Smirnov and opinion alignment 1 - W / (N - 1) over labels in order.

    levels: N where labels are codes 0 to N - 1 that may be missing; else N is the labels there are.
    """
    run = W.partitionBy(*items).orderBy("label").rowsBetween(W.unboundedPreceding, 0)
    s = shares(counts, items).withColumn("gap", F.abs(F.sum("p").over(run) - F.sum("q").over(run)))
    n = F.lit(levels) if levels else F.count("*")
    out = s.groupBy(*items).agg(F.sum("gap").alias("wasserstein"), F.max("gap").alias("ks"), n.alias("n"))
    return out.withColumn("alignment", F.when(F.col("n") >= 2, 1 - F.col("wasserstein") / (F.col("n") - 1)))


def share_correlation(counts: DataFrame, items: Sequence[str]) -> DataFrame:
    return shares(counts, items).groupBy(*items).agg(pearson("p", "q").alias("r"))


def pearson(x: str, y: str) -> Column:
    """Null for fewer than two pairs or a side without spread."""
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when((F.count("*") >= 2) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), r)


def fisher_z(r: Column) -> Column:
    return F.atanh(F.least(F.greatest(r, F.lit(-1 + 1e-12)), F.lit(1 - 1e-12)))


def fisher_mean(r: Column) -> Column:
    """Pooled correlation: nulls, NaN and infinities are left out."""
    return F.tanh(F.avg(F.when(r.isNotNull() & ~F.isnan(r) & (F.abs(r) < float("inf")), fisher_z(r))))


def accuracy(a: Column, b: Column) -> Column:
    return F.avg((a == b).cast("double"))


def ordinal_mae(x: Column, y: Column) -> Column:
    return F.avg(F.abs(x - y))


def mean_squared_error(x: Column, y: Column) -> Column:
    return F.avg((x - y) * (x - y))


def ordinal_accuracy(x: Column, y: Column, span: Column) -> Column:
    """Mean of 1 - |d| / span, which may be negative."""
    return F.avg(1 - F.abs(x - y) / span)


def glass_delta(human: str, model: str) -> Column:
    return F.try_divide(F.avg(model) - F.avg(human), F.stddev_pop(human))


def sd_ratio(human: str, model: str) -> Column:
    return F.try_divide(F.stddev_pop(model), F.stddev_pop(human))


def closeness(observed: Column, perfect: Column, floor: Column) -> Column:
    """0 to 100 between a random floor and a perfect score; without a gap 100 only at it."""
    gap = F.abs(perfect - floor)
    inside = F.least(F.greatest(100 * (1 - F.try_divide(F.abs(observed - perfect), gap)), F.lit(0.0)), F.lit(100.0))
    return F.when(gap == 0, F.when(observed == perfect, 100.0).otherwise(0.0)).otherwise(inside)


def amplitude(rows: DataFrame, items: Sequence[str], value: str, is_human: Column) -> DataFrame:
    """Share of human codes (halves to even) that the model uses too, and the ratio of spans, at most 1."""
    coded = rows.withColumn("code", F.bround(value).cast("long"))
    code = coded.groupBy(*items, "code").agg(F.max(is_human.cast("int")).alias("h"), F.max((~is_human).cast("int")).alias("m"))
    cover = code.groupBy(*items).agg((F.sum(F.col("h") * F.col("m")) / F.nullif(F.sum("h"), F.lit(0))).alias("coverage"))
    side = lambda c, f: f(F.when(c, F.col(value)))
    spans = rows.groupBy(*items).agg((side(is_human, F.max) - side(is_human, F.min)).alias("hs"), (side(~is_human, F.max) - side(~is_human, F.min)).alias("ms"))
    ratio = F.when(F.col("hs") == 0, F.when(F.col("ms") == 0, 1.0).otherwise(0.0)).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("ms"), F.col("hs"))))
    return cover.join(spans.select(*items, ratio.alias("span_ratio")), list(items))


def cross_model_variance(values: DataFrame, position: str, value: str) -> DataFrame:
    """Mean variance, mean and largest deviation of models at each position (population form)."""
    per = values.groupBy(position).agg(F.var_pop(value).alias("v"), F.stddev_pop(value).alias("s"))
    return per.agg(F.avg("v").alias("mean_variance"), F.avg("s").alias("mean_std"), F.max("s").alias("max_std"))


def cronbach_alpha(grid: DataFrame, person: str, item: str, value: str) -> DataFrame:
    """k / (k - 1) (1 - sum of item variances / variance of totals) of a full grid, with n - 1."""
    items = grid.groupBy(item).agg(F.var_samp(value).alias("v")).agg(F.sum("v").alias("item_variance"), F.count("*").alias("k"))
    total = grid.groupBy(person).agg(F.sum(value).alias("t")).agg(F.var_samp("t").alias("total_variance"), F.count("*").alias("n"))
    k = F.col("k")
    alpha = k / (k - 1) * (1 - F.try_divide(F.col("item_variance"), F.col("total_variance")))
    # one row beside one row
    return items.join(total, F.lit(True)).select(F.when((k >= 2) & (F.col("n") >= 2), alpha).alias("alpha"), "k", "n")


def quadratic_weighted_kappa(pairs: DataFrame, model: str, human: str, categories: int) -> DataFrame:
    """Pairs outside 1..categories are dropped; null without pairs or expected disagreement.

    Sums are enough: the expected squared distance of independent margins is a
    function of their first two moments, so no margin is crossed with the other.
    """
    a, b = F.col(model).cast("double"), F.col(human).cast("double")
    inside = pairs.filter(a.between(1, categories) & b.between(1, categories))
    observed = F.avg((a - b) * (a - b))
    expected = F.avg(a * a) - 2 * F.avg(a) * F.avg(b) + F.avg(b * b)
    return inside.agg(F.count("*").alias("n"), (1 - F.try_divide(observed, F.nullif(expected, F.lit(0.0)))).alias("kappa"))


def coded_summary(codes: DataFrame, item: str = "item") -> DataFrame:
    """One pooled row of (item, human, model, span) codes: means over items of each metric that is defined.

    An item's span is the declared one if positive, else the range of both
    sides; items without span are left out altogether.
    """
    wide = codes.groupBy(item).agg(
        F.max("span").alias("declared"), F.greatest(F.max("human"), F.max("model")).alias("hi"), F.least(F.min("human"), F.min("model")).alias("lo"),
        F.count("*").alias("n"), ordinal_mae(F.col("human"), F.col("model")).alias("mae"), pearson("human", "model").alias("r"),
        glass_delta("human", "model").alias("glass"), sd_ratio("human", "model").alias("sd_ratio"), F.avg("human").alias("human_mean"), F.avg("model").alias("model_mean"),
    )
    span = F.when(F.col("declared") > 0, F.col("declared")).otherwise(F.col("hi") - F.col("lo"))
    kept = wide.withColumn("span", span).filter("span > 0").withColumn("acc", 1 - F.col("mae") / F.col("span"))
    return kept.agg(
        F.count("*").alias("items"), F.avg("acc").alias("ordinal_accuracy"), fisher_mean(F.col("r")).alias("pooled_r"),
        F.count_if(F.col("r").isNull() & (F.col("n") >= 2)).alias("skipped_zero_var_corr"), F.avg("glass").alias("glass_delta"),
        F.avg("sd_ratio").alias("sd_ratio"), F.avg("human_mean").alias("human_mean"), F.avg("model_mean").alias("model_mean"),
    )
