"""Writing documents and snapshots."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that driver and executors share, spark.checkpoint.dir, gone when the application ends. Only a
    local[...] session that names none gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    path = f"{named.rstrip('/') if named else tempfile.gettempdir()}/{name}-{uuid.uuid4().hex}"
    path = path if ":" in path else f"file://{path}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def write_documents(rows: DataFrame, path: str) -> None:
    """One JSON object a row, as an endpoint or an audit file holds it."""
    rows.write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document over several lines, such as a contract with its lists, as one row."""
    return spark.read.option("multiLine", True).json(path)


def changed(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """The rows of after that are new or differ from those of before, by key; the columns are the same."""
    rest = [c for c in after.columns if c != key]
    old = before.select(F.col(key), F.struct(*rest).alias("__old"))
    both = after.join(old, key, "left")
    return both.where(~F.struct(*rest).eqNullSafe(F.col("__old"))).select(*after.columns)


def write_snapshot(before: DataFrame, after: DataFrame, key: str, path: str) -> bool:
    """Write after to a new path, only if it differs from before; says whether it did. A reader of the old
    path never sees half a snapshot."""
    if changed(before, after, key).isEmpty() and before.count() == after.count():
        return False
    after.write.mode("errorifexists").parquet(path)
    return True


class Published:
    """A table in versions under a folder: data/<n>-<id> holds a version's files, current/<n> names the one that is version n.

    The largest n is current. A version is written whole before it is named, and what is named never changes, so a reader
    sees one version or another; old versions stay. publish() is a compare-and-set: of writers that start from the same
    version only that which first claims the next number (an exclusive create) names its own; the others are told."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._hadoop(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at = self._hadoop(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in self._files.listStatus(at)] if self._files.exists(at) else []

    def version(self) -> int:
        """The current version's number; 0 if nothing is published."""
        return max((int(n.split("-")[0]) for n in self._names("current")), default=0)

    def publish(self, rows: DataFrame, expected: int) -> int | None:
        """Publish rows as the version after `expected`; its number, or None if another writer was first."""
        if self.version() != expected:
            return None
        name = f"{expected + 1}-{uuid.uuid4().hex}"
        rows.write.mode("errorifexists").parquet(f"{self.path}/data/{name}")
        try:
            self._files.create(self._hadoop(f"{self.path}/claims/{expected + 1}"), False).close()
        except Exception as error:  # the file system's own kind of "already exists"
            if "AlreadyExists" not in str(error) and "already exists" not in str(error):
                raise
            self._files.delete(self._hadoop(f"{self.path}/data/{name}"), True)
            return None
        self._files.mkdirs(self._hadoop(f"{self.path}/current/{name}"))  # a name appears at once
        return expected + 1

    def read(self, version: int | None = None) -> DataFrame | None:
        """A version, the current one without a number; None if there is none."""
        wanted = self.version() if version is None else version
        names = [n for n in self._names("current") if int(n.split("-")[0]) == wanted]
        return self.spark.read.parquet(f"{self.path}/data/{names[0]}") if names else None


def serve(published: Published, refresh: Callable[[DataFrame | None], DataFrame], now: datetime, keep: timedelta) -> DataFrame:
    """The current snapshot with its status. One that is younger than `keep` is served as it is: LIVE. Else refresh() is given the
    last one and its rows are published with the time `now`: LIVE; if it fails or another writer was first, the last one is
    served: FALLBACK_LAST_VERIFIED. Without any snapshot a failing refresh raises. The clock is a parameter; the rows' own column
    refreshed_at tells when they were made."""
    last = published.read()
    made = last.agg(F.max("refreshed_at")).first()[0] if last is not None else None
    live = lambda rows: rows.withColumn("status", F.lit("LIVE"))
    if made is not None and now - made < keep:
        return live(last)
    try:
        rows = refresh(None if last is None else last.drop("refreshed_at")).withColumn("refreshed_at", F.lit(now).cast("timestamp_ntz"))
        if published.publish(rows, published.version()) is not None:
            return live(published.read())
    except Exception:
        if last is None:
            raise
    return published.read().withColumn("status", F.lit("FALLBACK_LAST_VERIFIED"))
