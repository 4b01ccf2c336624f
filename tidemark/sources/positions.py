"""Positions in monthly Parquet files, as a Spark data source that takes filters on the date.

write_positions() lays rows out as month=yyyy-MM/*.parquet. The source lists the folders of the months that the pushed
filters leave, so files of other months are never opened; each file is a partition, and only the columns that are asked for
are read from it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import pyarrow as pa
import pyarrow.dataset as ds
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tidemark.functions.exprs import month_of

COLUMNS = {"date": "date", "market": "string", "oi": "double", "long": "double", "short": "double"}
FORMAT = "tidemark_positions"


class PositionSource(DataSource):
    """Options: path, and columns (comma-separated names of COLUMNS; all without it)."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        names = [c.strip() for c in self.options.get("columns", ",".join(COLUMNS)).split(",")]
        return ", ".join(f"{c} {COLUMNS[c]}" for c in names)

    def reader(self, schema: StructType) -> DataSourceReader:
        return PositionReader(self.options["path"], schema.names)


class PositionReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.low, self.high, self.only = path, names, None, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Keeps the dates' bounds; every filter is left to Spark too, as a month's file has more days than one."""
        for f in filters:
            if getattr(f, "attribute", None) == ("date",):
                if isinstance(f, EqualTo):
                    self.only = self._meet({f.value})
                elif isinstance(f, In):
                    self.only = self._meet(set(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.low = max(filter(None, (self.low, f.value)))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.high = min(filter(None, (self.high, f.value)))
            yield f

    def _meet(self, dates: set[date]) -> set[date]:
        return dates if self.only is None else self.only & dates

    def wanted(self, month: str) -> bool:
        inside = (self.low is None or month >= self.low.isoformat()[:7]) and (self.high is None or month <= self.high.isoformat()[:7])
        return inside and (self.only is None or month in {d.isoformat()[:7] for d in self.only})

    def partitions(self) -> Sequence[InputPartition]:
        files, base = pa.fs.FileSystem.from_uri(self.path)
        months = [x for x in files.get_file_info(pa.fs.FileSelector(base)) if x.type == pa.fs.FileType.Directory and x.base_name.startswith("month=")]
        months = [x for x in months if self.wanted(x.base_name.removeprefix("month="))]
        found = (x.path for m in months for x in files.get_file_info(pa.fs.FileSelector(m.path)) if x.base_name.endswith(".parquet"))
        return [InputPartition(p) for p in sorted(found)] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            files, _ = pa.fs.FileSystem.from_uri(self.path)
            yield from ds.dataset(partition.value, filesystem=files, format="parquet").to_batches(columns=self.names)


def write_positions(rows: DataFrame, path: str) -> None:
    """rows with COLUMNS into one file or a few for each month; rows without a date are left out."""
    kept = rows.where("date IS NOT NULL").select(*(F.col(c).cast(t).alias(c) for c, t in COLUMNS.items()))
    kept.withColumn("month", month_of(F.col("date"))).write.partitionBy("month").parquet(path)


def read_positions(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The positions under path; name columns to read no others. Filters on date reach the source, which needs the session's
    setting for it, made here."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PositionSource)
    reader = spark.read.format(FORMAT).option("path", path)
    return (reader.option("columns", ",".join(columns)) if columns else reader).load()
