"""A store of replies by key: jobs append side by side, and look-ups do not move what is stored.

The bulk lies in one bucketed, sorted table, a version after the other; what
jobs have added since lies beside it, a folder for each addition. Compaction
makes the next version of both.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from canvass.sources.publish import _fs, _rename, versions

REPLIES = "key string, raw string"


@dataclass(frozen=True)
class ReplyStore:
    """path: a shared folder; buckets: files of the bulk, fixed for the store, so that look-ups of any size meet it as it lies."""

    spark: SparkSession
    path: str
    buckets: int = 64

    def add(self, replies: DataFrame) -> None:
        """Append (key, raw). Every addition is a folder of its own: two jobs share no commit, so neither undoes the other's."""
        replies.select("key", "raw").write.parquet(f"{self.path}/added/{uuid.uuid4().hex}")

    def additions(self) -> list[str]:
        """Folders whose writers came to their end."""
        fs, p = _fs(self.spark, f"{self.path}/added")
        if not fs.exists(p):
            return []
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return sorted(s.getPath().toString() for s in fs.listStatus(p) if fs.exists(done(s.getPath(), "_SUCCESS")))

    def bulk(self) -> DataFrame | None:
        """The newest version, as a bucketed table of this session."""
        there = versions(self.spark, f"{self.path}/bulk")
        if not there:
            return None
        name = f"replies_{uuid.uuid5(uuid.NAMESPACE_URL, self.path).hex}_{there[-1]}"
        if not self.spark.catalog.tableExists(name):
            place = f"{self.path}/bulk/v{there[-1]:08}".replace("'", "\\'")
            self.spark.sql(f"CREATE TABLE {name} ({REPLIES}) USING parquet CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS LOCATION '{place}'")
        return self.spark.table(name)

    def added(self) -> DataFrame | None:
        folders = self.additions()
        return self.spark.read.schema(REPLIES).parquet(*folders).groupBy("key").agg(F.min("raw").alias("raw")) if folders else None

    def replies(self) -> DataFrame:
        """All that is stored, one reply for each key."""
        out = self.spark.createDataFrame([], REPLIES)
        for part in (self.bulk(), self.added()):
            out = out if part is None else out.union(part.select("key", "raw"))
        return out.groupBy("key").agg(F.min("raw").alias("raw"))

    def look_up(self, batches: DataFrame) -> DataFrame:
        """batches (with key) with `raw`, null where nothing is known; the bulk is read where it lies, without an exchange."""
        parts = [x for x in (self.bulk(), self.added()) if x is not None]
        out = batches.withColumn("raw", F.lit(None).cast("string"))
        for i, part in enumerate(parts):
            side = part.withColumnRenamed("raw", "__raw")
            out = out.join(side.hint("merge") if i == 0 and len(parts) == 2 else side, "key", "left").withColumn("raw", F.coalesce("raw", "__raw")).drop("__raw")
        return out.select(*batches.columns, "raw")

    def compact(self) -> int:
        """Make the next version of the bulk and all additions there are now, and return its number. Additions that come meanwhile stay."""
        taken, bulk = self.additions(), self.bulk()
        number = max(versions(self.spark, f"{self.path}/bulk"), default=0)
        if not taken:
            return number
        rows = self.spark.read.schema(REPLIES).parquet(*taken)
        rows = rows if bulk is None else rows.union(bulk)
        aside, name = f"{self.path}/bulk/_aside-{uuid.uuid4().hex[:12]}", f"aside_{uuid.uuid4().hex}"
        single = rows.groupBy("key").agg(F.min("raw").alias("raw")).repartition(self.buckets, "key")
        single.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", aside).saveAsTable(name)
        self.spark.sql(f"DROP TABLE {name}")  # its files stay, as they lie where they were asked for
        fs, source = _fs(self.spark, aside)
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bulk/v{number + 1:08}")
        _rename(self.spark._jvm, self.spark._jsc.hadoopConfiguration(), fs.makeQualified(source), fs.makeQualified(target))
        for folder in taken:
            fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        return number + 1
