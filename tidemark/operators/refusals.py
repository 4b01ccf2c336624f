"""What was not used, and why: refused inputs as rows, beside the rows that were.

A refusal is (source, stage, key, message): which kind of input, at which step it was refused, which file, asset or block,
and a message of at most MESSAGE characters. A reader here returns its rows and its refusals; one bad input never drops the
others. with_errors() joins refusals back to what they leave empty.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import month_key, number
from tidemark.sources import readers

MESSAGE = 500


def refused(rows: DataFrame, source: str, stage: str, key: str | Column, message: Column) -> DataFrame:
    """The refusals of the rows whose message is not null, one for each key and message."""
    key = F.col(key) if isinstance(key, str) else key
    out = rows.select(F.lit(source).alias("source"), F.lit(stage).alias("stage"), key.cast("string").alias("key"), F.left(message, F.lit(MESSAGE)).alias("message"))
    return out.where("message IS NOT NULL").distinct()


def together(*refusals: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, refusals)


def price_charts(texts: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The rows of readers.parse_price_chart(), and the charts that give none: no JSON chart, or too few completed months."""
    rows = readers.parse_price_chart(texts, as_of)
    chart = F.from_json("text", readers.CHART)["chart"]["result"]
    seen = texts.select("asset", (F.size(chart) > 0).alias("chart")).groupBy("asset").agg(F.bool_or(F.coalesce("chart", F.lit(False))).alias("chart"))
    counts = readers.price_months(texts, as_of).groupBy("asset").agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0))
    short = F.concat(F.lit("insufficient price history: "), n.cast("string"), F.lit(f" of {readers.LEAST_MONTHS} completed months"))
    message = F.when(~F.col("chart"), F.lit("no price chart in the text")).when(n < readers.LEAST_MONTHS, short)
    return rows, refused(seen.join(counts, "asset", "left"), "price", "parse", "asset", message)


def surveys(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of readers.parse_survey_json(), and: texts that are no survey, those of a status other than 200, results without
    a value, and single values that are no month and number."""
    rows, j = readers.parse_survey_json(texts), F.from_json("text", readers.SURVEY)
    one = texts.select("file", j.alias("j"))
    status = F.concat(F.lit("status "), F.col("j.STATUS").cast("string"), F.lit(": "), F.coalesce("j.MESSAGE", F.lit("no message")))
    head = F.when(F.col("j.STATUS").isNull(), F.lit("no survey in the text")).when(F.col("j.STATUS") != 200, status)
    bad = refused(one, "survey", "status", "file", head)
    values = F.get("j.RESULTSET", F.lit(0))["VALUES"]
    cells = one.where("j.STATUS = 200").select("file", F.explode_outer(F.arrays_zip(values["SURVEY_DATES"].alias("d"), values["VALUES"].alias("v"))).alias("x"))
    wrong = month_key(F.col("x.d")).isNull() | number(F.col("x.v")).isNull()
    shown = F.concat(F.lit("no month and number: "), F.coalesce("x.d", F.lit("null")), F.lit(", "), F.coalesce("x.v", F.lit("null")))
    cell = F.when(F.col("x").isNull(), F.lit("no values in the results")).when(wrong, shown)
    return rows, together(bad, refused(cells, "survey", "parse", "file", cell))


def period_files(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of readers.parse_period_csv(), and the files without one of its columns or without a usable row."""
    rows = readers.parse_period_csv(lines)
    head = lines.where("line_no = 0").select("file", F.split(F.trim("text"), ",").alias("names"))
    no_period = ~F.arrays_overlap("names", F.array(*map(F.lit, ("TIME_PERIOD", "TIME_PERIOD_START", "TIME_PERIOD_END"))))
    no_value = ~F.array_contains("names", "OBS_VALUE")
    columns = F.when(no_period, F.lit("no column TIME_PERIOD")).when(no_value, F.lit("no column OBS_VALUE"))
    used = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    whole = lines.select("file").distinct().join(head, "file", "left").join(used, "file", "left")
    message = F.when(F.col("names").isNull(), F.lit("no header")).otherwise(F.coalesce(columns, F.when(F.col("n").isNull(), F.lit("no row with a month and a number"))))
    return rows, refused(whole, "statistics", "parse", "file", message)


def positions(raw: DataFrame, kind: str, since: str) -> tuple[DataFrame, DataFrame]:
    """The rows of readers.positioning_rows(), and a refusal if a column is missing, in which case there are no rows."""
    spark = raw.sparkSession
    try:
        rows, message = readers.positioning_rows(raw, kind, since), None
    except ValueError as error:
        rows, message = spark.createDataFrame([], "date string, market string, commodity string, oi double, long double, short double"), str(error)
    one = spark.range(1).select(F.lit(message).cast("string").alias("text"))
    return rows, refused(one, "positions", "schema", F.lit(kind), F.col("text"))


def with_errors(rows: DataFrame, refusals: DataFrame, on: str, *sources: str) -> DataFrame:
    """rows with error: the messages of the sources' refusals of the row's key, in the order of stage and message, joined by
    "; "; of more than MESSAGE characters the first. Null if there are none. A key has at most a few refusals kept: the first 20."""
    mine = refusals.where(F.col("source").isin(*sources)) if sources else refusals
    first = mine.withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("stage", "message", "source"))).where("i <= 20")
    texts = first.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "message"))).alias("m"))
    errors = texts.select(F.col("key").alias("__key"), F.left(F.array_join(F.transform("m", lambda x: x["message"]), "; "), F.lit(MESSAGE)).alias("error"))
    return rows.join(errors, F.col(on).cast("string") == F.col("__key"), "left").drop("__key")
