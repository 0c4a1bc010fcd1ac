"""Tables that are put in place at once, with a lock of their files; readers refuse what has none."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.errors import DataError, EnvironmentFault
from canvass.functions.jsonx import canonical, sha256_text
from canvass.sources.readers import file_facts, verified

LOCK = "lock.json"
VERSION = re.compile(r"v(\d{8})")


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file as text, None if there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, written under another name and moved over an older one."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, p = _fs(spark, path)
    part = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{uuid.uuid4().hex[:8]}")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    _rename(jvm, conf, fs.makeQualified(part), fs.makeQualified(p), over=True)


def _rename(jvm, conf, source, target, over: bool = False) -> None:
    """One rename; a target that is there is an error unless it is to be replaced."""
    kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = jvm.java.lang.reflect.Array.newInstance(kind.NONE.getClass(), 1)
    options[0] = kind.OVERWRITE if over else kind.NONE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(source.toUri(), conf).rename(source, target, options)


def versions(spark: SparkSession, path: str) -> list[int]:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    found = (VERSION.fullmatch(s.getPath().getName()) for s in fs.listStatus(p))
    return sorted(int(m[1]) for m in found if m)


def publish(tables: Mapping[str, DataFrame], path: str, **facts: object) -> int:
    """Write tables as the next version of a folder, and return its number.

    They are written aside, hashed where they lie by tasks, and named in a lock
    with a hash of itself; then one rename puts all of it in place. A writer
    that dies before leaves the version that was there, and one that comes
    second takes the number after.
    """
    spark = next(iter(tables.values())).sparkSession
    aside = f"{path}/_aside-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{aside}/{name}")
    body = {"files": lock_rows(file_facts(spark, aside)), "tables": sorted(tables), **facts}
    write_text(spark, f"{aside}/{LOCK}", canonical(body | {"lock_sha256": sha256_text(canonical(body))}))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    fs, source = _fs(spark, aside)
    while True:
        number = max(versions(spark, path), default=0) + 1
        target = jvm.org.apache.hadoop.fs.Path(f"{path}/v{number:08}")
        try:
            _rename(jvm, conf, fs.makeQualified(source), fs.makeQualified(target))
        except Exception:  # another writer has taken the number, or the move failed
            if not fs.exists(target):
                raise
            continue
        return number


def lock_rows(facts: DataFrame) -> dict[str, dict]:
    """Files with their sizes and hashes; Spark's own marks are none."""
    rows = facts.filter(~F.element_at(F.split("name", "/"), -1).rlike(r"^[._]")).orderBy("name").collect()
    return {r["name"]: {"bytes": r["bytes"], "sha256": r["sha256"]} for r in rows}


def lock_of(spark: SparkSession, path: str, version: int | None = None) -> tuple[str, dict]:
    """(folder, lock) of the newest version, or a given one. No version, no lock, or a lock that is not what it says are errors."""
    there = versions(spark, path)
    if not there or (version is not None and version not in there):
        raise EnvironmentFault(f"{path} has no version{'' if version is None else f' {version}'}")
    folder = f"{path}/v{version or there[-1]:08}"
    text = read_text(spark, f"{folder}/{LOCK}")
    if text is None:
        raise DataError(f"{folder} has no lock")
    lock = json.loads(text)
    said = lock.pop("lock_sha256", None)
    if said != sha256_text(canonical(lock)):
        raise DataError(f"{folder} has a lock that was changed")
    return folder, lock


def lock_frame(spark: SparkSession, lock: Mapping) -> DataFrame:
    return spark.createDataFrame([(k, v["bytes"], v["sha256"]) for k, v in lock["files"].items()], "name string, bytes long, sha256 string")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """(name, bytes, sha256) of the files of a version, less its lock and Spark's marks."""
    return file_facts(spark, folder).filter(~F.element_at(F.split("name", "/"), -1).rlike(r"^[._]") & (F.col("name") != LOCK))


def read_published(spark: SparkSession, path: str, name: str, version: int | None = None, check: bool = True) -> DataFrame:
    """A table of a published folder. With check every file is hashed first and must be what the lock says."""
    folder, lock = lock_of(spark, path, version)
    if name not in lock["tables"]:
        raise DataError(f"{folder} has no table {name}")
    if check and (state := verified(stored(spark, folder), lock_frame(spark, lock))) != "verified":
        raise DataError(f"{folder} is {state}")
    return spark.read.parquet(f"{folder}/{name}")
