"""How a sample stands to its population."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from canvass.errors import DataError
from canvass.functions.text import proportion8
from canvass.operators.relational import unpivot
from canvass.sources.readers import assert_unique


def field_report(rows: DataFrame, columns: Sequence[str], in_sample: str) -> DataFrame:
    """(field, value, population, sample, and their shares in units of 1e-8), one pass over all fields."""
    long = unpivot(rows.select(in_sample, *(F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("MISSING")).alias(c) for c in columns)), [in_sample], columns, "field", "value", keep_blank=True)
    counts = long.groupBy("field", "value").agg(F.count("*").alias("population"), F.count_if(in_sample).alias("sample"))
    every = W.partitionBy("field")
    totals = counts.withColumns({"pn": F.sum("population").over(every), "sn": F.sum("sample").over(every)})
    return totals.select("field", "value", "population", "sample", proportion8(F.col("population"), F.col("pn")).alias("population_share"), proportion8(F.col("sample"), F.col("sn")).alias("sample_share"))


def in_sample(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows with `sampled`; an id that repeats, or that no row has, is an error."""
    chosen = assert_unique(ids.select(key), [key])
    if strangers := [r[0] for r in chosen.join(rows, key, "left_anti").limit(5).collect()]:
        raise DataError(f"the sample has ids that the population lacks: {strangers}")
    return rows.join(chosen.withColumn("sampled", F.lit(True)), key, "left").withColumn("sampled", F.coalesce("sampled", F.lit(False)))


def field_distances(report: DataFrame) -> DataFrame:
    """Largest gap and total variation of each field, from exact counts."""
    every = W.partitionBy("field")
    gap = F.abs(F.col("population") / F.sum("population").over(every) - F.col("sample") / F.sum("sample").over(every))
    return report.withColumn("gap", gap).groupBy("field").agg(F.max("gap").alias("largest"), (F.sum("gap") / 2).alias("tvd"))


def decade(column: str):
    """floor(age / 10) * 10 and nine more; blanks stay MISSING, other text than digits is an error."""
    text = F.trim(F.col(column).cast("string"))
    low = (F.floor(text.try_cast("long") / 10) * 10).cast("long")
    return F.when(text.isNull() | (text == ""), "MISSING").when(~text.rlike("^[0-9]+$"), F.raise_error(F.lit("age is not a number"))).otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 9).cast("string")))


def with_older(table: DataFrame, older: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "older_") -> DataFrame:
    """A table of scores with columns of an older one beside, by its keys; rows that the older one lacks stay, and a key that it repeats is an error."""
    beside = assert_unique(older, list(keys)).select(*keys, *(F.col(c).alias(f"{prefix}{c}") for c in columns))
    return table.join(beside, list(keys), "left")
