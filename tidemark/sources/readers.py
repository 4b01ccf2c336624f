"""Readers that turn published files into canonical frames.

Each parse_* takes a frame of text (so tests and streams can feed it); each read_* loads files into one. Rows
that cannot be parsed are dropped, never guessed.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import any_date, finite, finite_or, last_completed_month, month_key, month_of, number

CHART = (
    "chart struct<result:array<struct<timestamp:array<bigint>,indicators:struct<"
    "adjclose:array<struct<adjclose:array<double>>>,quote:array<struct<close:array<double>>>>>>>"
)
SURVEY = "STATUS int, MESSAGE string, RESULTSET array<struct<VALUES:struct<SURVEY_DATES:array<string>,VALUES:array<string>>>>"
#: A price series of fewer completed months is no series.
LEAST_MONTHS = 12


def price_months(texts: DataFrame, as_of: str) -> DataFrame:
    """(asset, text of a chart in JSON) to (asset, month, value): the adjusted close, or the close where that is
    not finite, of the last entry of each completed month."""
    one = texts.select("asset", F.get(F.from_json("text", CHART)["chart"]["result"], F.lit(0)).alias("r"))
    values = lambda x: F.coalesce(x, F.array().cast("array<double>"))  # noqa: E731, a chart may lack one of the two
    cells = F.arrays_zip(
        F.col("r.timestamp").alias("t"), values(F.get(F.col("r.indicators.adjclose"), F.lit(0))["adjclose"]).alias("a"),
        values(F.get(F.col("r.indicators.quote"), F.lit(0))["close"]).alias("c"),
    )
    rows = one.select("asset", F.posexplode(cells).alias("pos", "x"))
    rows = rows.select("asset", "pos", month_of(F.timestamp_seconds("x.t")).alias("month"), finite_or(F.col("x.a"), F.col("x.c")).alias("value"))
    rows = rows.where(finite(F.col("value")) & (F.col("month") <= last_completed_month(as_of)))
    return rows.groupBy("asset", "month").agg(F.max_by("value", "pos").alias("value"))


def parse_price_chart(texts: DataFrame, as_of: str) -> DataFrame:
    """As price_months(); assets with fewer than LEAST_MONTHS are left out."""
    monthly = price_months(texts, as_of)
    enough = F.count(F.lit(1)).over(Window.partitionBy("asset")) >= LEAST_MONTHS
    return monthly.withColumn("__n", enough).where("__n").drop("__n")


def parse_csv_lines(lines: DataFrame, *columns: str) -> DataFrame:
    """(file, line_no, text) to (file, line_no, *columns) of the cells under those names in each file's line 0.
    Cells are not quoted. A file without one of the names gives nulls."""
    cells = lines.select("file", "line_no", F.split(F.trim("text"), ",").alias("cells"))
    head = cells.where("line_no = 0").select("file", F.col("cells").alias("head"))
    at = lambda c: F.array_position("head", F.lit(c)).cast("int")
    both = cells.where("line_no > 0").join(head, "file")
    return both.select("file", "line_no", *(F.when(at(c) > 0, F.get("cells", at(c) - 1)).alias(c) for c in columns))


def parse_macro_csv(lines: DataFrame, start: str | None = None) -> DataFrame:
    """(file, line_no, text), the file named for its series: first cell a date, the value in the column that is named for
    the series; to (series, month, value), the last finite value of each month, of dates from `start` on. Blank
    cells are no values; a file without that column has none."""
    cells = lines.select(F.col("file").alias("series"), "line_no", F.split(F.trim("text"), ",").alias("c"))
    head = cells.where("line_no = 0").select("series", F.array_position("c", F.col("series")).cast("int").alias("at"))
    return _monthly(cells.where("line_no > 0").join(head.where("at > 0"), "series"), F.col("at") - 1, start)


def parse_two_column_csv(lines: DataFrame) -> DataFrame:
    """As parse_macro_csv(), with the value in the second cell, whatever its name."""
    return _monthly(lines.select(F.col("file").alias("series"), "line_no", F.split(F.trim("text"), ",").alias("c")), F.lit(1), None)


def _monthly(cells: DataFrame, at: Column, start: str | None) -> DataFrame:
    date_of = F.get("c", F.lit(0)).try_cast("date")
    rows = cells.select("series", "line_no", date_of.alias("date"), number(F.get("c", at)).alias("value"))
    rows = rows.where("date is not null and value is not null")
    rows = rows if start is None else rows.where(F.col("date") >= F.lit(start).cast("date"))
    return rows.groupBy("series", month_of(F.col("date")).alias("month")).agg(F.max_by("value", "line_no").alias("value"))


def parse_period_csv(lines: DataFrame) -> DataFrame:
    """Statistical CSV with TIME_PERIOD (or its _START or _END) and OBS_VALUE, to (file, month, value)."""
    names = ("TIME_PERIOD", "TIME_PERIOD_START", "TIME_PERIOD_END")
    rows = parse_csv_lines(lines, *names, "OBS_VALUE")
    period = F.coalesce(*(F.when(F.col(c) != "", F.col(c)) for c in names))
    rows = rows.select("file", month_key(period).alias("month"), number(F.col("OBS_VALUE")).alias("value"))
    return rows.where("month is not null and value is not null")


def parse_survey_json(texts: DataFrame) -> DataFrame:
    """(file, text) of survey results in JSON with STATUS 200, to (file, month, value)."""
    one = texts.select("file", F.from_json("text", SURVEY).alias("j")).where("j.STATUS = 200")
    values = F.get("j.RESULTSET", F.lit(0))["VALUES"]
    rows = one.select("file", F.explode(F.arrays_zip(values["SURVEY_DATES"].alias("d"), values["VALUES"].alias("v"))).alias("x"))
    rows = rows.select("file", month_key(F.col("x.d")).alias("month"), number(F.col("x.v")).alias("value"))
    return rows.where("month is not null and value is not null")


#: What windows-1252 has in the place of the control characters 0x80 to 0x9F of ISO-8859-1.
_CP1252 = {chr(b): bytes([b]).decode("cp1252") for b in range(0x80, 0xA0) if b not in (0x81, 0x8D, 0x8F, 0x90, 0x9D)}


def decode_texts(files: DataFrame) -> DataFrame:
    """(file, content) of bytes to (file, text): UTF-8 without its byte order mark; else windows-1252; else, where that has no
    character for a byte, ISO-8859-1."""
    utf8 = F.try_validate_utf8(F.col("content").cast("string"))
    latin = F.decode("content", "ISO-8859-1")
    western = F.translate(latin, "".join(_CP1252), "".join(_CP1252.values()))
    other = F.when(latin.rlike("[\x81\x8d\x8f\x90\x9d]"), latin).otherwise(western)
    return files.select("file", F.regexp_replace(F.coalesce(utf8, other), "^\ufeff", "").alias("text"))


def lines_of(texts: DataFrame) -> DataFrame:
    """(file, text) to (file, line_no, text) of the lines that are not blank."""
    return texts.select("file", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "text")).where("trim(text) <> ''")


def read_release_lines(spark: SparkSession, path: str) -> DataFrame:
    """Release files of any of the encodings of decode_texts() as (file, line_no, text)."""
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    return lines_of(decode_texts(spark.read.format("binaryFile").load(path).select(name.alias("file"), "content")))


def parse_release_csv(lines: DataFrame, code: str) -> DataFrame:
    """A release with free text above its table: the first cell equal to `code` heads the column; below it, rows
    with a date in one of their first three cells and a positive value. Cells may be quoted, numbers may have
    thousands separators. To (file, date, value)."""
    bare = lambda c: F.trim(F.regexp_replace(F.trim(c), '^"|"$', ""))
    cells = lines.select("file", "line_no", F.transform(F.split("text", ',(?=(?:[^"]*"[^"]*")*[^"]*$)'), bare).alias("c"))
    hit = cells.where(F.array_contains("c", code)).select("file", F.struct("line_no", F.array_position("c", code).cast("int").alias("col")).alias("h"))
    hit = hit.groupBy("file").agg(F.min("h").alias("h"))
    rows = cells.join(hit, "file").where(F.col("line_no") > F.col("h.line_no"))
    date = F.coalesce(*(any_date(F.get("c", F.lit(i))) for i in range(3)))
    rows = rows.select("file", date.alias("date"), number(F.replace(F.get("c", F.col("h.col") - 1), F.lit(","), F.lit(""))).alias("value"))
    return rows.where("date is not null and value > 0")


def resolve_column(names: list[str], *candidates: str) -> str | None:
    """The column for a list of spellings: an equal name first, in the order of candidates, then a name that
    contains one. Letter case does not count."""
    lower = {}
    for n in names:
        lower.setdefault(n.lower(), n)
    for c in candidates:
        if c.lower() in lower:
            return lower[c.lower()]
    for c in candidates:
        for n in names:
            if c.lower() in n.lower():
                return n
    return None


#: Spellings of the position columns by kind of report.
POSITION_COLUMNS = {
    "financial": ("Lev_Money_Positions_Long", "Lev_Money_Positions_Short"),
    "commodity": ("M_Money_Positions_Long", "M_Money_Positions_Short"),
}


def positioning_rows(raw: DataFrame, kind: str, since: str) -> DataFrame:
    """Futures positions of one report to (date, market, commodity, oi, long, short): rows since a date with a
    positive open interest and finite positions. Columns are found by their names; a missing one is an error."""
    long, short = POSITION_COLUMNS[kind]
    wanted = {
        "date": ("Report_Date_as_YYYY_MM_DD",), "market": ("Market_and_Exchange_Names", "Contract_Market_Name"), "commodity": ("Commodity Name", "commodity_name"),
        "oi": ("Open_Interest_All",), "long": (f"{long}_All", long), "short": (f"{short}_All", short),
    }
    found = {k: resolve_column(raw.columns, *c) for k, c in wanted.items()}
    if missing := [k for k, c in found.items() if c is None and k != "commodity"]:
        raise ValueError(f"no column for {', '.join(missing)}")
    text = lambda k: F.col(f"`{found[k]}`").cast("string") if found[k] else F.lit("")
    rows = raw.select(
        F.substring(text("date"), 1, 10).alias("date"), text("market").alias("market"), F.coalesce(text("commodity"), F.lit("")).alias("commodity"),
        *(number(text(k)).alias(k) for k in ("oi", "long", "short")),
    )
    return rows.where((F.col("date") >= since) & (F.col("oi") > 0) & F.col("long").isNotNull() & F.col("short").isNotNull())


def look_back(as_of: str, years: int = 3, months: int = 1) -> str:
    """The ISO date `years` years and `months` months before; a day that the month lacks runs over into the next."""
    y, m, d = map(int, as_of[:10].split("-"))
    index = (y - years) * 12 + m - 1 - months
    return (date(index // 12, index % 12 + 1, 1) + timedelta(days=d - 1)).isoformat()


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text files as (file, line_no, text), each file whole, so lines keep their order."""
    whole = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return whole.select(F.regexp_replace("file", r"\.[^.]*$", "").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("line_no", "text")).where("trim(text) <> ''")


def read_json_texts(spark: SparkSession, path: str, key: str = "file") -> DataFrame:
    """JSON files as (key, text), keyed by file name."""
    whole = spark.read.text(path, wholetext=True)
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return whole.select(name.alias(key), F.col("value").alias("text"))
