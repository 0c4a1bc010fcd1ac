"""Writers: JSON lines, CSV with a header, partitioned tables, and manifests with hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canvass.functions.jsonx import canonical, sha256_text
from canvass.sources.readers import file_facts


def write_jsonl(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """One object a line with keys in order. Given an order, lines are sorted over all files (range-partitioned, never in one task)."""
    rows = df.orderBy(*order) if order else df
    rows.select(F.to_json(F.struct(*(F.col(c) for c in sorted(df.columns)))).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_partitioned(df: DataFrame, path: str, *keys: str) -> None:
    """A folder for each key. Adaptive execution deals the rows by key, cuts what is large into tasks of its advisory size and joins what is small, so a very common key is written by as many tasks as it needs."""
    df.hint("rebalance", *keys).write.mode("overwrite").partitionBy(*keys).parquet(path)


def manifest(df_path: str, spark, **facts: object) -> dict:
    """Names, sizes and hashes of the files of a result with a hash of the manifest itself."""
    files = {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in file_facts(spark, df_path).orderBy("name").collect() if not r["name"].rpartition("/")[2].startswith(("_", "."))}
    body = {"files": files, **facts}
    return body | {"manifest_sha256": sha256_text(canonical(body))}


def text_statistics(df: DataFrame, text: str) -> DataFrame:
    """(least, most, mean, texts): lengths of a text column, and how many different texts there are."""
    size = F.length(text)
    return df.agg(F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.countDistinct(text).alias("texts"))


def export_texts(df: DataFrame, key: str, text: str, path: str) -> dict[str, object]:
    """One object a line with the text of each key, as it was sent; returns the statistics of the texts."""
    write_jsonl(df.select(key, text), path, [key])
    return text_statistics(df, text).first().asDict()
