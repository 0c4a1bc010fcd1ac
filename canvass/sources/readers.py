"""Strict readers: no type is inferred, and what breaks a rule is an error that names the place."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from canvass.errors import DataError, EnvironmentFault
from canvass.functions import let
from canvass.functions.text import strip


def _within_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """`at`: the place of each line among those of its block, which a task reads one after the other."""
    last, n = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block, file = np.asarray(batch.column(2)), batch.column(1).dictionary_encode()
        code = np.asarray(file.indices)
        first = np.flatnonzero(np.concatenate([[True], (block[1:] != block[:-1]) | (code[1:] != code[:-1])]))
        at = np.arange(len(block)) - np.repeat(first, np.diff(np.append(first, len(block))))
        head, tail = ((file.dictionary[int(code[i])].as_py(), int(block[i])) for i in (0, -1))
        if head == last:
            at[: first[1] if len(first) > 1 else len(at)] += n
        last, n = tail, int(at[-1]) + 1
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], ["value", "file", "block", "at"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, line): lines of text files with their numbers from 1, the same however files are cut into tasks.

    A line's number is its place in its block, which its task knows, and the
    lines of the blocks before it; of these there is one count for each block.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = raw.mapInArrow(_within_blocks, "value string, file string, block long, at long")
    counts = lines.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("file", "block", before.alias("start"))
    return lines.join(starts, ["file", "block"]).select("value", "file", (F.col("start") + F.col("at") + 1).alias("line"))


def line_fault(value: Column) -> Column:
    """What is wrong with a line that is to hold a JSON object; null for a good one. Works in batches and streams alike."""
    return let(F.schema_of_variant(F.try_parse_json(value)), lambda kind: F.when(kind.isNull(), "not JSON").when(~F.startswith(kind, F.lit("OBJECT")), "not a JSON object"))


def sorted_out(lines: DataFrame, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good, bad) of lines (value and columns that name their place): objects read by the schema, and lines with the reason why they are none. Blank lines are neither."""
    judged = lines.filter(F.trim("value") != "").withColumn("reason", line_fault(F.col("value")))
    place = [c for c in lines.columns if c != "value"]
    good = judged.filter("reason is null").select(*place, F.from_json("value", schema).alias("x")).select(*place, "x.*")
    return good, judged.filter("reason is not null").select(*place, "reason", "value")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType, limit: int | None = None, place: str | None = None) -> DataFrame:
    """Objects of JSON-lines files; blank lines are skipped, other text than an object is an error that names file and line.

    limit takes the first by file and line, and nothing after them is looked
    at; place names a column struct<file, line> to keep.
    """
    lines = numbered_lines(spark, path).filter(F.trim("value") != "")
    if limit is not None:
        if isinstance(limit, bool) or not isinstance(limit, int) or limit < 1:
            raise DataError("limit must be an integer of 1 at least")
        lines = lines.orderBy("file", "line").limit(limit)
    where = F.concat("file", F.lit(":"), F.col("line"), F.lit(": "))
    checked = let(line_fault(F.col("value")), lambda fault: F.when(fault.isNull(), F.col("value")).otherwise(F.raise_error(F.concat(where, fault, F.lit(": "), F.substring("value", 1, 80)))))
    keep = [] if place is None else [F.struct("file", "line").alias(place)]
    return lines.select(*keep, F.from_json(checked, schema).alias("x")).select(*([place] if place else []), "x.*")


def read_lenient(spark: SparkSession, path: str, schema: str | T.StructType) -> tuple[DataFrame, DataFrame]:
    """(objects with file and line, bad lines with file, line and reason) of JSON-lines files: nothing is an error."""
    return sorted_out(numbered_lines(spark, path), schema)


def read_csv(spark: SparkSession, path: str, required: Sequence[str], key: str = "pid", trim: bool = True) -> DataFrame:
    """A CSV table of text cells. Missing columns fail at once, blank and repeated keys when rows are read.

    trim strips every cell and turns null to ''; else only the key is stripped.
    """
    head = spark.read.option("header", True).option("inferSchema", False).csv(path)
    if lacking := sorted(set(required) - set(head.columns)):
        raise DataError(f"{path} lacks the columns {lacking}")
    if len(set(head.columns)) < len(head.columns):
        raise DataError(f"{path} repeats a column")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in head.columns])
    rows = spark.read.option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").schema(schema).csv(path)
    cell = (lambda c: F.coalesce(strip(F.col(c)), F.lit(""))) if trim else (lambda c: strip(F.col(c)) if c == key else F.col(c))
    return rows.select(*(cell(c).alias(c) for c in rows.columns))


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """df, once it is known that no key is blank and none repeats."""
    blank = None
    for k in keys:
        c = F.col(k).isNull() | (F.trim(F.col(k).cast("string")) == "")
        blank = c if blank is None else blank | c
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).filter((F.col("n") > 1) | blank).limit(5).collect()
    if bad:
        raise DataError(f"blank or repeated keys {keys}: {[tuple(r)[:-1] for r in bad]}")
    return df


def check_columns(columns: Sequence[str], roles: Mapping[str, Sequence[str]]) -> dict[str, str]:
    """The role of each column of a closed header: unknown, missing and twice claimed columns fail."""
    claimed: dict[str, str] = {}
    for role, names in roles.items():
        for name in names:
            if claimed.setdefault(name, role) != role:
                raise DataError(f"column {name} is both {claimed[name]} and {role}")
    if unknown := sorted(set(columns) - set(claimed)):
        raise DataError(f"unknown columns {unknown}")
    if lacking := sorted(set(claimed) - set(columns)):
        raise DataError(f"missing columns {lacking}")
    return {c: claimed[c] for c in columns}


def expect_rows(df: DataFrame, n: int, name: str) -> DataFrame:
    found = df.count()
    if found != n:
        raise DataError(f"{name} has {found} rows, not {n}")
    return df


def read_parquet(spark: SparkSession, paths: Sequence[str], columns: Sequence[str], files: int | None = None) -> DataFrame:
    """Some columns of a given number of Parquet files; other columns are not read."""
    if files is not None and len(paths) != files:
        raise DataError(f"{len(paths)} files, not {files}")
    return spark.read.parquet(*paths).select(*columns)


def read_splits(spark: SparkSession, paths: Mapping[str, str], limit: int | None = None, order: str = "line") -> DataFrame:
    """Splits one after the other with their names; a limit counts through all of them."""
    parts = []
    for i, (name, path) in enumerate(paths.items()):
        parts.append(spark.read.parquet(path).withColumns({"split": F.lit(name), "split_ord": F.lit(i)}))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    if out.isEmpty():
        raise DataError(f"no rows in {sorted(paths)}")
    return out if limit is None else out.orderBy("split_ord", order).limit(limit)


def first_field(*names: str) -> Column:
    """The first of several fields that is not null."""
    return F.coalesce(*(F.col(n) for n in names))


def file_facts(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files below a path, hashed where they are read; a name is the path from there on."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = root.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(root).toString().rstrip("/")
    below = F.when(F.startswith("path", F.lit(f"{whole}/")), F.substring("path", len(whole) + 2, 1 << 20)).otherwise(F.element_at(F.split("path", "/"), -1))
    return files.select(below.alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(facts: DataFrame, lock: DataFrame) -> DataFrame:
    """(name, status) of files against a lock of (name, bytes, sha256): verified, changed, missing or extra."""
    a = facts.select("name", F.struct("bytes", "sha256").alias("here"))
    b = lock.select("name", F.struct("bytes", "sha256").alias("there"))
    both = a.join(b, "name", "full_outer")
    status = F.when(F.col("there").isNull(), "extra").when(F.col("here").isNull(), "missing").when(F.col("here") == F.col("there"), "verified").otherwise("changed")
    return both.select("name", status.alias("status"))


def verified(facts: DataFrame, lock: DataFrame, optional: Sequence[str] = ()) -> str:
    """"verified" if all files are as the lock says, "partial" if only optional ones are absent, "skipped_absent" if all are; anything else is an error."""
    bad = verify(facts, lock).filter("status <> 'verified'").orderBy("name").limit(20).collect()
    wrong = [f"{r['name']} is {r['status']}" for r in bad if r["status"] != "missing"]
    absent = [r["name"] for r in bad if r["status"] == "missing"]
    if absent and facts.isEmpty():
        return "skipped_absent"
    if wrong or (needed := [n for n in absent if n not in optional]):
        raise DataError("; ".join(wrong or [f"{n} is missing" for n in needed]))
    return "partial" if absent else "verified"


def require_cache(spark: SparkSession, paths: Sequence[str], command: str) -> Sequence[str]:
    """paths, if all of them exist; else an error that names the command that fetches them."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            raise EnvironmentFault(f"{path} is missing; run: {command}")
    return paths


def require_fields(**fields: Column) -> dict[str, Column]:
    """Columns whose null or blank values are errors that name the field."""

    def need(name: str, c: Column) -> Column:
        return let(c, lambda x: F.when(F.coalesce(strip(x.cast("string")), F.lit("")) == "", F.raise_error(F.lit(f"a record needs {name}"))).otherwise(x))

    return {k: need(k, c) for k, c in fields.items()}


def sampled_records(records: DataFrame, key: str, weight: Column | None, n: int, seed: int) -> DataFrame:
    """n records in two passes: the first reads ids and weights only, the second the chosen records whole."""
    from canvass.operators.sampling import weighted_draw

    ids = records.select(key, (F.lit(1.0) if weight is None else weight).alias("__w"))
    chosen = weighted_draw(ids, key, F.col("__w"), n, seed).select(key)
    return records.join(chosen, key, "left_semi")
