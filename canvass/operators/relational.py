"""Joins, dedup, reshaping and checks on respondents, questions and answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from canvass.errors import DataError


def made_once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once for each row, as what a generator gives.

    Spark infers for an explode that its array is there and not empty, and
    moves that filter and others below the projections, where it makes the
    array from its expression again, nested ones many times over. Filters on
    what a generator gives stay above it.
    """
    kept = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    bound = df.select(*kept, F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("__once"))
    return bound.select(*kept, *(F.col(f"__once.{n}").alias(n) for n in columns))


def last_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of rows with equal keys the last in order, by a mergeable maximum and not a window."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*keys, "__x.*").select(*df.columns)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("__x"))
    return best.select(*keys, "__x.*").select(*df.columns)


def attach(left: DataFrame, right: DataFrame, on: Sequence[str], replace: Sequence[str] = ()) -> DataFrame:
    """Left outer join; columns in `replace` take the right side's value where there is one."""
    renamed = right.select(*on, *(F.col(c).alias(f"__r_{c}") if c in replace else F.col(c) for c in right.columns if c not in on))
    joined = left.join(renamed, list(on), "left")
    return joined.withColumns({c: F.coalesce(f"__r_{c}", c) for c in replace}).drop(*(f"__r_{c}" for c in replace))


def keep_with(subjects: DataFrame, cases: DataFrame, key: str, keep: Column) -> tuple[DataFrame, DataFrame]:
    """Cases that satisfy a predicate, and the subjects that still have one."""
    kept = cases.filter(keep)
    return subjects.join(kept.select(key).distinct(), key, "left_semi"), kept


def key_difference(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of one side only, with the side; empty if the key sets are equal."""
    left = a.select(*keys).distinct().withColumn("in_a", F.lit(True))
    right = b.select(*keys).distinct().withColumn("in_b", F.lit(True))
    both = left.join(right, list(keys), "full_outer").filter("in_a is null or in_b is null")
    return both.select(*keys, F.when(F.col("in_a"), "a").otherwise("b").alias("side"))


def audit_equal(a: DataFrame, b: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Counts of equal and differing values of joined keys."""
    joined = a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(value).alias("y")), list(keys))
    same = F.col("x").eqNullSafe(F.col("y"))
    return joined.agg(F.count_if(same).alias("equal"), F.count_if(~same).alias("differ"))


def unpivot(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "item", value: str = "value", keep_blank: bool = False) -> DataFrame:
    """Wide to long; null and blank values are left out unless kept."""
    out = df.unpivot(list(ids), list(columns), name, value)
    return out if keep_blank else out.filter(F.col(value).isNotNull() & (F.trim(F.col(value).cast("string")) != ""))


def reasons(rules: Sequence[tuple[Column, str]], otherwise: str | None = None) -> Column:
    """The text of the first rule that holds."""
    out = F.lit(otherwise)
    for condition, text in reversed(rules):
        out = F.when(condition, F.lit(text)).otherwise(out)
    return out


def question_counts(subjects: DataFrame, cases: DataFrame, key: str) -> DataFrame:
    """Cases of each subject, zero included."""
    counts = cases.groupBy(key).agg(F.count("*").alias("n"))
    return subjects.select(key).join(counts, key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def unequal_counts(subjects: DataFrame, cases: DataFrame, key: str, expected: int) -> DataFrame:
    return question_counts(subjects, cases, key).filter(F.col("n") != expected)


def chunks(df: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """df with `chunk`, from 0, of `size` rows of each key in order."""
    return df.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1) / size).cast("int"))


def limited(cases: DataFrame, subjects: DataFrame, key: str, order: Sequence[str], n: int) -> tuple[DataFrame, DataFrame]:
    """The first n cases and the subjects that they touch."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise DataError("limit must be an integer of 1 at least")
    some = cases.orderBy(*order).limit(n)
    return some, subjects.join(some.select(key).distinct(), key, "left_semi")


def numeric_first(c: Column) -> list[Column]:
    """Sort keys: digits as numbers, then other ids as text."""
    digits = c.rlike("^[0-9]+$")
    return [F.when(digits, 0).otherwise(1), F.when(digits, c).try_cast("decimal(38,0)"), c]


#: Characters by which needles of under three words are known; shorter needles are known by all of theirs.
GRAM = 6


def contained(texts: DataFrame, needles: DataFrame, text: str, needle: str, words: int = 4) -> DataFrame:
    """Pairs of rows whose text contains the needle at any place, by an equi-join on word windows.

    The first and last word of a needle may go on in the text, so a needle is
    known by a window of words from its second on, or by one word where fewer
    lie inside it; a text offers all its windows of as many words. Needles of
    under three words are known by their first characters and meet all strings
    of as many characters. The substring is checked on pairs that meet; each
    pair meets once. Null and empty needles are in no text.
    """
    inner = F.size("__w") - 2
    keyed = needles.filter(F.col(needle) != "").withColumn("__w", _words(F.col(needle))).withColumn("__n", F.when(inner >= words, words).when(inner >= 1, 1).otherwise(-F.least(F.lit(GRAM), F.length(needle))))
    # only the windows that some needle has are built, all of them in one pass over the texts
    sizes = sorted(r["__n"] for r in keyed.select("__n").distinct().collect())
    if not sizes:
        return texts.sparkSession.createDataFrame([], T.StructType([*texts.schema.fields, *needles.schema.fields]))
    probe = keyed.withColumn("__k", F.when(F.col("__n") > 0, _window_key(F.slice("__w", 2, F.greatest("__n", F.lit(1))), F.col("__n"), " ")).otherwise(_window_key(F.split(F.substring(F.col(needle), F.lit(1), -F.col("__n")), ""), F.col("__n"), "")))
    units = F.struct(*(c.alias(k) for k, c in (("w", _words(F.col(text))), ("c", F.split(F.col(text), ""))) if any((n > 0) == (k == "w") for n in sizes)))
    # exploding an array of one keeps the units in a column: inside the windows' lambda they would be made anew for each window
    parted = texts.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__h"), F.explode(F.array(units)).alias("__u"))
    keys = F.concat(*(_windows(F.col("__u.w" if n > 0 else "__u.c"), n) for n in sizes))
    # a text's windows are sent without it; what meets fetches the text again by its hash
    offers = parted.select("__h", F.explode(F.array_distinct(keys)).alias("__k"))
    met = offers.join(probe.select("__k", needle).distinct(), "__k").select("__h", needle).distinct()
    found = texts.withColumn("__h", F.xxhash64(text)).join(met, "__h").filter(F.contains(F.col(text), F.col(needle))).drop("__h")
    return found.join(needles, needle).select(*texts.columns, *needles.columns)


def _words(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda w: w != "")


def _window_key(units: Column, n: Column, glue: str) -> Column:
    return F.xxhash64(n.cast("int"), F.array_join(units, glue))


def _windows(units: Column, n: int) -> Column:
    """Keys of all windows of |n| units: words if n is above 0, else characters."""
    at = F.when(F.size(units) >= abs(n), F.sequence(F.lit(1), F.size(units) - abs(n) + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: _window_key(F.slice(units, i, abs(n)), F.lit(n), " " if n > 0 else ""))
