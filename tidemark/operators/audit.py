"""Audits: release gate, required inputs, promotion, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.nowcast import missing_months


def release_gate(observations: DataFrame, first: str, least: int, expected: dict[str, float]) -> DataFrame:
    """One row for a release (date, value): months since `first` (yyyy-MM), how many of the expected month values are
    met, how many months are missing up to the last one, and whether all is as it must be."""
    months = observations.where(F.col("date") >= F.to_date(F.lit(f"{first}-01"))).withColumn("month", F.date_format("date", "yyyy-MM"))
    levels = months.groupBy("month").agg(F.max_by("value", "date").alias("value")).withColumn("series", F.lit("release"))
    gaps = missing_months(levels, "series", first).agg(F.count(F.lit(1)).alias("missing"))
    met = F.count_if(_expected(expected))
    seen = months.agg(F.count(F.lit(1)).alias("observations"), F.max("date").alias("latest"))
    right = levels.agg(met.alias("met"))
    one = seen.crossJoin(F.broadcast(gaps)).crossJoin(F.broadcast(right))  # a row each
    passed = (F.col("observations") >= least) & (F.col("missing") == 0) & (F.col("met") == len(expected))
    return one.withColumn("pass", passed)


def _expected(expected: dict[str, float]):
    """Whether a (month, value) row is one of the expected ones."""
    out = F.lit(False)
    for month, value in expected.items():
        out = out | ((F.col("month") == month) & (F.col("value") == value))
    return out


def inputs_present(required: DataFrame, have: DataFrame) -> DataFrame:
    """(path, present) for every required path; both sides have a column path."""
    seen = have.select("path").distinct().withColumn("present", F.lit(True))
    return required.select("path").join(seen, "path", "left").select("path", F.coalesce("present", F.lit(False)).alias("present"))


def promotion(present: DataFrame, gate: DataFrame) -> DataFrame:
    """One row: how many inputs are missing, the decision, and promote, which no decision here sets."""
    missing = present.agg(F.count_if(~F.col("present")).alias("missing_inputs"))
    both = missing.crossJoin(F.broadcast(gate.select(F.col("pass").alias("gate"))))  # a row each
    ready = (F.col("missing_inputs") == 0) & F.col("gate")
    decided = F.when(ready, "READY_FOR_EXACT_RERUN").otherwise("BLOCKED_MISSING_FROZEN_INPUT_BYTES")
    return both.select("missing_inputs", "gate", decided.alias("decision"), F.lit(False).alias("promote_to_core"))


def digests(rows: DataFrame, key: str, content: str) -> DataFrame:
    """(key, bytes, sha256) of a text or binary column; files come from the binaryFile reader."""
    return rows.select(key, F.octet_length(content).alias("bytes"), F.sha2(F.col(content).cast("binary"), 256).alias("sha256"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of every file under a folder, by its path in it. Marker and checksum files, whose names begin with
    "_" or ".", are no content. Each file is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    bare = lambda p: F.regexp_replace(p, r"^[A-Za-z]+:/*", "/")  # noqa: E731, file:/a and file:///a are the same folder
    inside = F.substr(bare(F.col("path")), F.length(bare(F.lit(path.rstrip("/")))) + 2)
    kept = files.where(~F.element_at(F.split("path", "/"), -1).rlike(r"^[_.]"))
    return digests(kept.select(inside.alias("path"), "content"), "path", "content")


def reconcile(contract: DataFrame, have: DataFrame) -> DataFrame:
    """(path, status, expected, found) for every path of the contract or of what is there, both (path, sha256): SAME, CHANGED,
    MISSING or EXTRA. A path that the contract names twice with different digests is CHANGED unless all agree."""
    one = lambda rows, name: rows.groupBy("path").agg(F.sort_array(F.collect_set("sha256")).alias(name))  # noqa: E731, a few digests a path
    both = one(contract, "expected").join(one(have, "found"), "path", "full_outer")
    status = F.when(F.col("expected").isNull(), "EXTRA").when(F.col("found").isNull(), "MISSING").when(F.col("expected") == F.col("found"), "SAME").otherwise("CHANGED")
    return both.select("path", status.alias("status"), F.array_join("expected", ",").alias("expected"), F.array_join("found", ",").alias("found"))
