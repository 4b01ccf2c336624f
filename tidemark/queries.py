"""The operators as queries over the driver's tables, each with the same result in DuckDB's SQL.

The tables hold no market data, so roles are dealt: a nation is an asset of the universe (by its key), an order's
price a price, line items are macro levels and futures positions, regions are money blocks.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import any_date, finite_or, month_key, month_of, number, score_of_z
from tidemark.operators import audit, econ, features, inference, nowcast, positioning, refusals, rules, vintages
from tidemark.plans import dims
from tidemark.plans import opportunity as plans
from tidemark.sources import positions as position_files
from tidemark.sources import readers, sinks
from tidemark.streaming import late

AS_OF = "2001-08-15"
NAMES = [a[0] for a in dims.ASSETS]
MARKET_TERMS = (
    ("SPY", ["RING", "BLUE RING"], False), ("QQQ", ["BOLT"], False), ("IWM", ["GEAR"], False), ("FXY", ["PROMO"], True), ("GLD", ["WIDGET"], True),
    ("SLV", ["PLATE"], True), ("USO", ["ANVIL"], True), ("CPER", ["GIZMO"], True), ("CORN", ["LARGE"], True), ("WHEAT", ["MEDIUM"], True), ("SOYBEAN", ["NOTHING"], True),
)

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- roles
# A panel is an aggregate of a few rows for each asset and month that several features read: it is cached, so the
# tables are scanned once a query. A lost executor's part is computed again.


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, month, value) of the universe, completed months only."""
    who = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n")).where(F.col("n") < len(NAMES))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    rows = orders.join(who, F.col("o_custkey") == F.col("c_custkey"))
    monthly = features.month_last(rows, "n", "o_orderdate", "o_totalprice", "o_orderkey", AS_OF)
    return monthly.select(F.get(F.array(*map(F.lit, NAMES)), F.col("asset")).alias("asset"), "month", "value").cache()


def cpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(month_of(F.col("l_shipdate")).alias("month")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("value")).cache()


def levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    series = F.get(F.array(*map(F.lit, plans.LEVELS.values())), F.col("l_linenumber") - 1)
    return lines.groupBy(series.alias("series"), month_of(F.col("l_shipdate")).alias("month")).agg(F.avg("l_extendedprice").alias("value")).cache()


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("market"), F.upper("p_type").alias("commodity"))


def market_rows(spark: SparkSession, sf_dir: str, parts: DataFrame) -> DataFrame:
    """Weekly positions by market: open interest is all quantity, long and short that of two return flags."""
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_returnflag", "l_shipdate")
    of = lambda flag: F.sum(F.when(F.col("l_returnflag") == flag, F.col("l_quantity")).otherwise(0.0))
    week = F.date_format(F.date_trunc("week", "l_shipdate"), "yyyy-MM-dd").alias("date")
    return (
        lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .groupBy(week, "market", "commodity")
        .agg(F.sum("l_quantity").alias("oi"), of("A").alias("long"), of("R").alias("short"))
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the whole universe."""
    parts = _summary(spark, sf_dir)
    basket = positioning.composite(parts, dims.baskets(spark))
    direct = parts.join(dims.assets(spark).select("asset"), "asset", "left_semi")
    return positioning.for_universe(dims.assets(spark), direct, basket)


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only lines of parts that name an asset are read into weeks."""
    parts = markets(spark, sf_dir)
    assets = positioning.named(parts, dims.terms(spark, MARKET_TERMS)).cache()
    mine = parts.join(assets.select("market", "commodity"), ["market", "commodity"], "left_semi")
    return positioning.series(positioning.matched(market_rows(spark, sf_dir, mine), assets)).cache()


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return positioning.summary(_series(spark, sf_dir))


def money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, month, value): order volume by region."""
    t = lambda n: table(spark, sf_dir, n)
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("series"))
    who = t("customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "series")  # nations are few
    rows = t("orders").join(who, F.col("o_custkey") == F.col("c_custkey"))
    return rows.groupBy("series", month_of(F.col("o_orderdate")).alias("month")).agg(F.sum("o_totalprice").alias("value")).cache()


def rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, month, rate): a currency for each region, but AMERICA has the dollar; none is published in June."""
    t = lambda n: table(spark, sf_dir, n)
    where = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("series"))
    who = t("supplier").join(F.broadcast(where), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "series")  # nations are few
    rows = t("lineitem").where(F.month("l_shipdate") != 6).join(who, F.col("l_suppkey") == F.col("s_suppkey"))
    mean = rows.groupBy("series", month_of(F.col("l_shipdate")).alias("month")).agg(F.avg(1 + F.col("l_tax") - F.col("l_discount")).alias("rate"))
    return mean.withColumn("rate", F.when(F.col("series") == "AMERICA", 1.0).otherwise(F.col("rate")))


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    tilt = nowcast.summary(dims.nowcast_blocks(spark))
    return plans.opportunity(dims.assets(spark), prices(spark, sf_dir), cpi(spark, sf_dir), levels(spark, sf_dir), positions(spark, sf_dir), tilt)


def radar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plans.radar(found(spark, sf_dir), prices(spark, sf_dir))


def r6(*names: str) -> list:
    return [F.round(n, 6).alias(n) for n in names]


def texts(c: str):
    return F.concat_ws("|", c).alias(c)


# ---- the roles in SQL

_LIST = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
P = f"""price AS (SELECT ({_LIST})[c_nationkey + 1] AS asset, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey < {len(NAMES)} AND strftime(o_orderdate, '%Y-%m') <= '2001-07' GROUP BY 1, 2)"""
C = "cpi AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, sum(l_extendedprice) / sum(l_quantity) AS value FROM lineitem GROUP BY 1)"
L = """level AS (SELECT (['real10', 'real5', 'hyoas'])[l_linenumber] AS series, strftime(l_shipdate, '%Y-%m') AS month, avg(l_extendedprice) AS value
  FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2)"""
REL = "rel AS (SELECT p.asset, p.month, p.value / b.value AS value FROM price p JOIN price b ON p.month = b.month AND b.asset = 'SPY' WHERE p.asset <> 'SPY' AND p.value > 0 AND b.value > 0)"
REAL = """realp AS (SELECT asset, p.month, p.value / c.value AS value FROM price p JOIN cpi c ON c.value > 0
  AND p.month = strftime((c.month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m'))"""


def turn_sql(name: str, source: str) -> str:
    return f"""{name}_w AS (SELECT *, row_number() OVER w AS n, avg(value) OVER (w ROWS 9 PRECEDING) AS ma, avg(value) OVER (w ROWS BETWEEN 12 PRECEDING AND 3 PRECEDING) AS mb,
    value / lag(value, 3) OVER w - 1 AS r3, value / lag(value, 6) OVER w - 1 AS r6 FROM {source} WINDOW w AS (PARTITION BY asset ORDER BY month)),
  {name} AS (SELECT asset, month, value, n, CASE WHEN n >= 13 THEN ma END AS ma10, CASE WHEN n >= 13 AND mb > 0 THEN ma / mb - 1 END AS slope, CASE WHEN n >= 13 THEN r3 END AS r3,
    CASE WHEN n >= 13 THEN r6 END AS r6, CASE WHEN n < 13 THEN NULL WHEN value > ma AND r3 > 0 AND mb > 0 AND ma / mb > 1 THEN 'CONFIRMED_UP' WHEN r3 > 0 THEN 'EARLY_UP'
      WHEN value < ma AND r3 < 0 AND mb > 0 AND ma / mb < 1 THEN 'CONFIRMED_DOWN' WHEN r3 < 0 THEN 'EARLY_DOWN' ELSE 'MIXED' END AS stage,
    CASE WHEN n >= 13 THEN coalesce(value > ma, false) OR coalesce(r3 > 0, false) END AS pass FROM {name}_w)"""


def z_sql(name: str, source: str, log: bool = True) -> str:
    x = "CASE WHEN value > 0 THEN ln(CASE WHEN value > 0 THEN value END) END" if log else "value"
    return f"""{name} AS (SELECT asset, month, value, CASE WHEN count(x) OVER w = 60 AND count(*) OVER w = 60 AND stddev_samp(x) OVER w > 0
    THEN (x - avg(x) OVER w) / stddev_samp(x) OVER w END AS z FROM (SELECT *, {x} AS x FROM {source}) WINDOW w AS (PARTITION BY asset ORDER BY month ROWS 59 PRECEDING))"""


def last_sql(source: str) -> str:
    return f"(SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY asset ORDER BY month DESC) = 1)"


# ---- sources

@query(
    """WITH p AS (SELECT o_custkey::VARCHAR AS asset, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_totalprice + CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 0 END, (o_orderdate, o_orderkey)) AS value
      FROM orders WHERE strftime(o_orderdate, '%Y-%m') <= '2001-07' GROUP BY 1, 2)
    SELECT asset, month, value FROM p QUALIFY count(*) OVER (PARTITION BY asset) >= 12"""
)
def s01_price_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chart JSON of each customer's orders: adjusted else close, the last entry of a month, completed months, at least twelve."""
    adjusted = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice"))
    entry = F.struct("o_orderdate", "o_orderkey", adjusted.alias("a"), (F.col("o_totalprice") + 1).alias("c"))
    points = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("asset")).agg(F.array_sort(F.collect_list(entry)).alias("p"))  # a customer's orders
    each = lambda f: F.transform("p", f)
    cells = F.struct(F.array(F.struct(each(lambda x: x["a"]).alias("adjclose"))).alias("adjclose"), F.array(F.struct(each(lambda x: x["c"]).alias("close"))).alias("quote"))
    result = F.struct(each(lambda x: F.unix_timestamp(x["o_orderdate"].cast("timestamp"))).alias("timestamp"), cells.alias("indicators"))
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")), {"ignoreNullFields": "false"})
    return readers.parse_price_chart(points.select("asset", text.alias("text")), AS_OF)


_BAD = "(l_orderkey % 11 = 0 OR l_orderkey % 13 = 0)"
_CSV = f"SELECT 'S' || l_linenumber AS series, strftime(l_shipdate, '%Y-%m') AS month, arg_max({{0}}, ((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey) AS value FROM lineitem WHERE NOT {_BAD}"


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, text): a CSV of dates and two numbers for each line number; some cells of the second are ".", some blank."""
    value = F.when(F.col("l_orderkey") % 11 == 0, ".").when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.col("l_extendedprice").cast("string"))
    first = F.when(F.col("l_orderkey") % 11 == 0, "bad").when(F.col("l_orderkey") % 13 == 0, "").otherwise(F.col("l_quantity").cast("string"))
    text = F.concat_ws(",", F.date_format("l_shipdate", "yyyy-MM-dd"), first, value)
    lines = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("S"), F.col("l_linenumber")).alias("file"), F.expr("((l_orderkey * 8 + l_linenumber) * 1000000 + l_partkey) * 1000 + l_suppkey").alias("line_no"), text.alias("text"))
    head = lines.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.concat(F.lit("DATE,OTHER,"), F.col("file")).alias("text"))
    return lines.union(head)


@query(f"{_CSV.format('l_extendedprice')} AND l_shipdate >= DATE '1996-03-10' GROUP BY 1, 2")
def s02_macro_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column named for the series, from a start date on: the last number of each month; ".", and blanks are no values."""
    return readers.parse_macro_csv(csv_lines(spark, sf_dir), "1996-03-10")


@query(f"{_CSV.format('l_quantity')} GROUP BY 1, 2")
def s06_two_column_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second column, whatever its name."""
    return readers.parse_two_column_csv(csv_lines(spark, sf_dir))


@query("SELECT o_orderstatus AS file, strftime(o_orderdate, '%Y-%m') AS month, o_totalprice AS value FROM orders WHERE o_orderdate >= DATE '2000-01-01' AND o_orderkey % 7 <> 0")
def s07_period_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns by name, the period from the first of three that is there; months of the last century and bad numbers are left out."""
    month, even = F.date_format("o_orderdate", "yyyy-MM"), F.col("o_orderkey") % 2 == 0
    value = F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise(F.col("o_totalprice").cast("string"))
    text = F.concat_ws(",", F.lit("k"), F.when(even, month).otherwise(""), F.when(even, "").otherwise(month), value)
    lines = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("file"), F.col("o_orderkey").alias("line_no"), text.alias("text"))
    head = lines.select("file").distinct().select("file", F.lit(0).cast("long").alias("line_no"), F.lit("KEY,TIME_PERIOD,TIME_PERIOD_START,OBS_VALUE").alias("text"))
    return readers.parse_period_csv(lines.where("line_no > 0").union(head))


@query("""SELECT n_regionkey::VARCHAR AS file, '2001-' || lpad((1 + c_nationkey % 12)::VARCHAR, 2, '0') AS month, round(sum(c_acctbal))::BIGINT::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey
    WHERE n_regionkey NOT IN (1, 4) AND NOT (n_regionkey = 3 AND c_nationkey % 2 = 0) GROUP BY n_regionkey, c_nationkey""")
def s08_survey_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zipped dates and values of results with status 200; a value that is no number is left out."""
    return readers.parse_survey_json(damaged_surveys(spark, sf_dir))


_RELEASED = """SELECT o_orderstatus AS file, last_day(o_orderdate)::DATE AS date, count(*)::DOUBLE + 1000.5 AS value FROM orders WHERE month(o_orderdate) <> 7 GROUP BY 1, 2"""


def release_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, line_no, text): a release for each order status with free text above its table, dates in three formats, numbers with
    thousands separators, and negative values in July."""
    monthly = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("file"), F.last_day("o_orderdate").alias("date")).agg((F.count(F.lit(1)) + 1000.5).alias("value"))
    form = F.month("date") % 3
    date = F.when(form == 0, F.date_format("date", "dd/MM/yyyy")).when(form == 1, F.date_format("date", "d-MMM-yyyy")).otherwise(F.date_format("date", "yyyy-MM-dd"))
    cell = F.concat(F.lit('"'), F.format_number(F.when(F.month("date") == 7, -F.col("value")).otherwise(F.col("value")), 1), F.lit('"'))
    rows = monthly.select("file", F.datediff("date", F.lit("1990-01-01")).alias("line_no"), F.concat_ws(",", date, cell, F.lit("x")).alias("text"))
    head = rows.select("file").distinct().select("file", F.posexplode(F.array(F.lit("Title,,"), F.lit("note,DMABMS,units"), F.lit("31/01/1990,"))).alias("line_no", "text"))
    return rows.union(head)


@query(_RELEASED)
def s09_release_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column under a code cell, dates in three formats, positive values."""
    return readers.parse_release_csv(release_lines(spark, sf_dir), "DMABMS")


@query(_RELEASED)
def s09_release_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same releases as bytes: with a byte order mark, with a character of windows-1252, and with a byte that only ISO-8859-1 has."""
    lines = F.array_sort(F.collect_list(F.struct("line_no", "text")))  # a row for each month
    whole = release_lines(spark, sf_dir).groupBy("file").agg(F.array_join(F.transform(lines, lambda x: x["text"]), "\r\n").alias("text"))
    mark = F.when(F.col("file") == "F", F.unhex(F.lit("EFBBBF"))).when(F.col("file") == "O", F.unhex(F.lit("96"))).otherwise(F.unhex(F.lit("81")))
    files = whole.select("file", F.concat(mark, F.col("text").cast("binary")).alias("content"))
    return readers.parse_release_csv(readers.lines_of(readers.decode_texts(files)), "DMABMS")


@query(
    """SELECT l_orderkey::VARCHAR AS market, strftime(l_shipdate, '%Y-%m-%d') AS date, l_quantity AS oi, l_extendedprice AS long, l_tax AS short
    FROM lineitem WHERE l_shipdate >= DATE '2001-10-01' AND l_quantity > 0"""
)
def s05_positioning_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position columns found by their spellings; rows of the look-back with open interest."""
    raw = table(spark, sf_dir, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("report_date_as_yyyy_mm_dd"), F.col("l_orderkey").cast("string").alias("market_and_exchange_names"),
        F.col("l_quantity").cast("string").alias("open_interest_all"), F.col("l_extendedprice").cast("string").alias("lev_money_positions_long"), F.col("l_tax").cast("string").alias("lev_money_positions_short"),
    )
    return readers.positioning_rows(raw, "financial", "2001-10-01").select("market", "date", "oi", "long", "short")


UNIVERSE = "SELECT * FROM (VALUES " + ", ".join(f"({i}, " + ", ".join(f"'{x}'" for x in a[:8]) + f", {a[8]})" for i, a in enumerate(dims.ASSETS)) + ") t(ordinal, asset, symbol, asset_class, money, tier, dislocation, strategic_mode, backtest, episodes)"


@query(f"WITH {P} SELECT u.*, coalesce(m, 0) AS months FROM ({UNIVERSE}) u LEFT JOIN (SELECT asset, count(*) AS m FROM price GROUP BY 1) USING (asset)")
def s10_asset_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe, and how many months of prices each asset has."""
    counts = prices(spark, sf_dir).groupBy("asset").agg(F.count(F.lit(1)).alias("months"))
    every = dims.assets(spark)
    return every.join(counts, "asset", "left").select(*every.columns, F.coalesce("months", F.lit(0)).alias("months"))


# ---- predicates and functions


@query(
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value ELSE event_id::DOUBLE END AS value, strftime(ts, '%Y-%m') AS month,
    contains(upper(event_type), 'CLICK') OR contains(upper(event_type), 'VIEW') AS hit FROM events"""
)
def p01_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Finite, coalesce on finiteness, month keys and any-of-terms."""
    from tidemark.functions.exprs import contains_any

    e = table(spark, sf_dir, "events")
    odd = F.when(F.col("event_id") % 3 != 0, F.col("value")).when(F.col("event_id") % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))
    terms = F.array(F.lit("CLICK"), F.lit("VIEW"))
    return e.select("event_id", finite_or(odd, F.col("event_id").cast("double")).alias("value"), month_of(F.col("ts")).alias("month"), contains_any(F.col("event_type"), terms).alias("hit"))


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 3 THEN o_orderdate::DATE END AS date, CASE WHEN o_orderkey % 6 IN (2, 3) AND year(o_orderdate) >= 2000 THEN strftime(o_orderdate, '%Y-%m') END AS month,
    CASE o_orderkey % 6 WHEN 3 THEN (year(o_orderdate) * 100 + month(o_orderdate))::DOUBLE WHEN 4 THEN o_orderkey + 1000.5 END AS number FROM orders"""
)
def f07_cell_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates in three formats, month keys, numbers with thousands separators, and a cell without a value."""
    date = lambda form: F.date_format("o_orderdate", form)
    cells = [date("dd/MM/yyyy"), date("d-MMM-yyyy"), date("yyyy-MM-dd"), date("yyyyMM"), F.format_number(F.col("o_orderkey") + 1000.5, 1), F.lit(".")]
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.get(F.array(*cells), (F.col("o_orderkey") % 6).cast("int")).alias("cell"))
    return rows.select("o_orderkey", any_date(F.col("cell")).alias("date"), month_key(F.col("cell")).alias("month"), number(F.col("cell")).alias("number"))


# ---- features


@query(f"WITH {P} SELECT asset, month, value FROM price")
def a01_month_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last price of each completed month."""
    return prices(spark, sf_dir)


@query(f"WITH {P}, {z_sql('z', 'price')} SELECT asset, month, round(z, 6) AS z FROM z")
def w01_zscore_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 60-month log z-score of every month."""
    return prices(spark, sf_dir).select("asset", "month", F.round(features.zscore(F.col("value"), True), 6).alias("z"))


_TURN = "round(ma10, 6) AS ma10, round(slope, 6) AS slope, round(r3, 6) AS r3, round(r6, 6) AS r6, stage, pass"


@query(f"WITH {P}, {turn_sql('t', 'price')} SELECT asset, month, n, {_TURN} FROM t")
def w02_price_turn_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages, returns, stage and pass of every month."""
    rows = features.with_turn(prices(spark, sf_dir))
    return rows.select("asset", "month", F.col("n").cast("long").alias("n"), *r6("ma10", "slope", "r3", "r6"), "stage", "pass")


@query(f"WITH {P}, {turn_sql('t', 'price')} SELECT asset, n >= 13 AS available, coalesce(pass, false) AS pass, stage, month AS as_of FROM {last_sql('t')}")
def w03_price_turn_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of each asset's last month."""
    return features.turn(prices(spark, sf_dir)).select("asset", "available", "pass", "stage", "as_of")


@query(f"WITH {P}, {REL}, {turn_sql('t', 'rel')} SELECT asset, n >= 13 AS available, coalesce(pass, false) AS pass, stage, month AS as_of FROM {last_sql('t')}")
def w04_relative_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turn of prices over the benchmark's."""
    return features.turn(features.relative_panel(prices(spark, sf_dir), "SPY")).select("asset", "available", "pass", "stage", "as_of")


_DIS = "SELECT asset, z IS NOT NULL AS available, coalesce(z {op}, false) AS pass, round(z, 6) AS z, month AS as_of FROM "


def _dis(rows: DataFrame) -> DataFrame:
    return rows.select("asset", "available", "pass", *r6("z"), "as_of")


@query(f"WITH {P}, {z_sql('z', 'price')} {_DIS.format(op='<= -1')} {last_sql('z')}")
def w05_absolute_dislocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapness by price."""
    return _dis(features.dislocation(prices(spark, sf_dir)))


@query(f"WITH {P}, {C}, {REAL}, {z_sql('z', 'realp')} {_DIS.format(op='<= -1')} {last_sql('z')}")
def w06_real_dislocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapness by price over the deflator of the month before."""
    return _dis(features.dislocation(features.real_panel(prices(spark, sf_dir), cpi(spark, sf_dir))))


@query(f"WITH {P}, {REL}, {z_sql('z', 'rel')} {_DIS.format(op='<= -1')} {last_sql('z')}")
def w07_relative_dislocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapness against the benchmark."""
    return _dis(features.dislocation(features.relative_panel(prices(spark, sf_dir), "SPY")))


_LEV = """lev AS (SELECT a.asset, l.month, l.value FROM (SELECT asset, max(month) AS as_of FROM price WHERE asset IN ('TLT', 'IEF', 'HYG') GROUP BY 1) a
  JOIN level l ON l.series = CASE a.asset WHEN 'TLT' THEN 'real10' WHEN 'IEF' THEN 'real5' ELSE 'hyoas' END AND l.month <= a.as_of)"""


@query(f"WITH {P}, {L}, {_LEV}, {z_sql('z', 'lev', False)} {_DIS.format(op='>= 1')} {last_sql('z')}")
def w08_level_high_dislocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapness by a high level, up to the price's month."""
    series = {"TLT": "real10", "IEF": "real5", "HYG": "hyoas"}
    chosen = spark.createDataFrame(list(series.items()), "asset string, series string")
    as_of = prices(spark, sf_dir).groupBy("asset").agg(F.max("month").alias("as_of")).join(F.broadcast(chosen), "asset")
    return _dis(features.dislocation(features.level_panel(levels(spark, sf_dir), as_of), log=False, high=True))


# ---- positioning

_TERMS = ", ".join(f"('{a}', {t}, {str(c).lower()})" for a, t, c in MARKET_TERMS)
M = f"""market AS (SELECT strftime(date_trunc('week', l_shipdate), '%Y-%m-%d') AS date, upper(p_name) AS market, upper(p_type) AS commodity, sum(l_quantity) AS oi,
    sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS long, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS short
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3),
  terms AS (SELECT * FROM (VALUES {_TERMS}) t(asset, terms, wide)),
  hit AS (SELECT asset, m.* FROM market m JOIN terms ON len(list_filter(terms, lambda x: contains(market || CASE WHEN wide THEN ' ' || commodity ELSE '' END, x))) > 0),
  pos AS (SELECT asset, date, sum(oi) AS oi, sum(long) AS long, sum(short) AS short, (sum(long) - sum(short)) / sum(oi) AS value FROM hit GROUP BY 1, 2 HAVING sum(oi) > 0),
  lastp AS (SELECT asset, max(date) AS as_of, arg_max(value, date) AS now FROM pos GROUP BY 1),
  summ AS (SELECT p.asset, any_value(as_of) AS as_of, any_value(now) AS now, avg(value) AS mean, stddev_samp(value) AS sd, 100.0 * count(*) FILTER (value <= now) / count(*) AS pct
    FROM pos p JOIN lastp USING (asset) GROUP BY 1)"""
_BASKETS = ", ".join(f"('{b}', '{c}', {n})" for b, (cs, n) in dims.BASKETS.items() for c in cs)
BK = f"""basket AS (SELECT basket AS asset, count(pct) >= any_value(least) AS available, count(pct) AS components, max(as_of) AS as_of, avg(round(pct, 1)) AS pct
  FROM (VALUES {_BASKETS}) b(basket, component, least) LEFT JOIN summ ON component = asset GROUP BY 1)"""
U = f"""universe AS (SELECT * FROM ({UNIVERSE})),
  held AS (SELECT u.asset, coalesce(s.pct IS NOT NULL OR b.available, false) AS p_known, coalesce(coalesce(s.pct, b.pct) <= 25, false) AS p_pass, coalesce(coalesce(s.pct, b.pct) >= 75, false) AS crowded,
      coalesce(s.as_of, b.as_of) AS p_as_of
    FROM universe u LEFT JOIN summ s USING (asset) LEFT JOIN basket b USING (asset))"""


@query(f"WITH {M} SELECT asset, date, round(oi, 6) AS oi, round(long, 6) AS long, round(short, 6) AS short, round(value, 9) AS value FROM pos")
def a02_positioning_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net positions over open interest by week; a row that two terms hit counts once."""
    return _series(spark, sf_dir).select("asset", "date", *r6("oi", "long", "short"), F.round("value", 9).alias("value"))


@query(f"WITH {M} SELECT asset, as_of, round(100 * now, 6) AS net, round(pct, 6) AS percentile, pct <= 25 AS pass, pct >= 75 AS crowded, round((now - mean) / sd, 2) AS z_3y FROM summ")
def a06_positioning_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile, z-score and flags of the last week."""
    last = _series(spark, sf_dir).groupBy("asset").agg(F.round(100 * F.max_by("value", "date"), 6).alias("net"))
    return _summary(spark, sf_dir).join(last, "asset").select("asset", "as_of", "net", *r6("percentile"), "pass", "crowded", "z_3y")


@query(f"WITH {M}, {BK} SELECT asset, available, components, as_of, round(pct, 6) >= 0 AS known, coalesce(pct <= 25, false) AS pass, coalesce(pct >= 75, false) AS crowded FROM basket")
def a08_positioning_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baskets of commodities, one of them without data."""
    rows = positioning.composite(_summary(spark, sf_dir), dims.baskets(spark))
    return rows.select("asset", "available", "components", "as_of", (F.col("percentile_3y") >= 0).alias("known"), "pass", "crowded")


@query(f"WITH {M}, {BK}, {U} SELECT asset, p_known AS available, p_pass AS pass, crowded FROM held")
def r27_positioning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of the whole universe."""
    return positions(spark, sf_dir).select("asset", "available", "pass", "crowded")


@query(f"WITH {M}, {BK}, {U} SELECT max(as_of) AS latest_report_date FROM (SELECT as_of FROM summ UNION ALL SELECT as_of FROM basket)")
def a11_latest_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last report date of the universe."""
    return positioning.latest_report(positions(spark, sf_dir))


# ---- money

MO = """money AS (SELECT r_name AS series, strftime(o_orderdate, '%Y-%m') AS month, sum(o_totalprice) AS value FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2),
  yoy AS (SELECT a.series, a.month, 100 * (a.value / b.value - 1) AS yoy FROM money a JOIN money b ON a.series = b.series AND a.month = strftime((b.month || '-01')::DATE + INTERVAL 12 MONTH, '%Y-%m'))"""


@query(f"WITH {MO} SELECT series, month, round(yoy, 6) AS yoy FROM yoy")
def n05_yoy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth over the same calendar month a year before."""
    return nowcast.yoy(money(spark, sf_dir)).select("series", "month", *r6("yoy"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    growth = nowcast.yoy(money(spark, sf_dir))
    at = lambda month, name: F.max(F.when(F.col("month") == month, F.col("yoy"))).alias(name)
    return growth.groupBy("series").agg(at("2001-06", "latest_yoy"), at("2001-02", "reference_yoy"))


BL = """blocks AS (SELECT series, max(yoy) FILTER (month = '2001-06') AS latest, max(yoy) FILTER (month = '2001-02') AS ref FROM yoy GROUP BY 1),
  way AS (SELECT *, CASE WHEN latest - ref > 0.25 THEN 'ACCELERATING' WHEN latest - ref < -0.25 THEN 'DECELERATING' WHEN latest - ref IS NOT NULL THEN 'STABLE' END AS way FROM blocks),
  counts AS (SELECT count(latest) AS usable, count(way) AS compared, count(*) FILTER (latest > 0) AS expanding, count(*) FILTER (way = 'ACCELERATING') AS accelerating,
    count(*) FILTER (way = 'DECELERATING') AS decelerating, count(*) FILTER (way = 'STABLE') AS stable FROM way)"""


@query(f"WITH {MO}, {BL} SELECT series, way AS direction, round(latest - ref, 6) AS delta FROM way")
def n06_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction against the reference month."""
    d = F.round(F.col("latest_yoy") - F.col("reference_yoy"), 6)
    return _blocks(spark, sf_dir).select("series", nowcast.direction(F.col("latest_yoy"), F.col("reference_yoy")).alias("direction"), d.alias("delta"))


@query(
    f"""WITH {MO}, {BL} SELECT usable, compared, expanding, accelerating, decelerating, stable,
    CASE WHEN accelerating >= 3 AND expanding = usable THEN 'SUPPORTIVE_MIXED' WHEN decelerating >= 3 THEN 'DETERIORATING' WHEN accelerating >= decelerating THEN 'NEUTRAL_TO_SUPPORTIVE' ELSE 'MIXED' END AS tilt,
    CASE WHEN accelerating >= 3 THEN 'BROADLY_EXPANDING_MIXED_ACCELERATION' WHEN decelerating >= 3 THEN 'BROADLY_DECELERATING' ELSE 'MIXED' END AS label, usable || '/5' AS coverage FROM counts"""
)
def n01_nowcast_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, tilt and label of the blocks."""
    return nowcast.summary(_blocks(spark, sf_dir), 5)


def _named_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks with names and dates, as a snapshot has them."""
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("series"), F.col("r_regionkey").alias("ordinal"))
    return _blocks(spark, sf_dir).join(region, "series").select("ordinal", F.lower("series").alias("block"), F.left("series", F.lit(2)).alias("short"), F.lit("2001-06").alias("latest_date"), "latest_yoy", "reference_yoy")


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An update for each block: one that holds, and one for each reason to refuse it."""
    rows, o = _named_blocks(spark, sf_dir), F.col("ordinal")
    date = F.when(o == 1, "2001-05").when(o == 3, "2001-06").when(o == 4, "2001-13").otherwise("2001-07")
    value = F.when(o == 2, 31.0).when(o == 3, F.col("latest_yoy") + 5.5).otherwise(F.col("latest_yoy") / 10 + 1)
    return rows.select("block", date.alias("new_date"), value.alias("new_yoy"))


_OLD = """old AS (SELECT r_regionkey AS ordinal, lower(series) AS block, '2001-06' AS d, latest AS y, ref FROM blocks JOIN region ON r_name = series),
    new AS (SELECT block, CASE ordinal WHEN 1 THEN '2001-05' WHEN 3 THEN '2001-06' WHEN 4 THEN '2001-13' ELSE '2001-07' END AS nd, CASE ordinal WHEN 2 THEN 31.0 WHEN 3 THEN y + 5.5 ELSE y / 10 + 1 END::DOUBLE AS ny FROM old),
    judged AS (SELECT *, CASE WHEN NOT regexp_full_match(nd, '20[0-9]{2}-(0[1-9]|1[0-2])') THEN 'invalid month' WHEN nd < d THEN 'date regression' WHEN ny < -20 OR ny > 30 THEN 'implausible growth'
      WHEN nd = d AND abs(ny - y) > 5 THEN 'same-month revision too large' END AS reason FROM old JOIN new USING (block)),
    done AS (SELECT *, CASE WHEN reason IS NULL THEN nd ELSE d END AS latest_date, CASE WHEN reason IS NULL THEN round(ny, 4) ELSE y END AS latest_yoy FROM judged)"""


@query(f"WITH {MO} SELECT string_agg(left(series, 2) || ' ' || m || '*', '; ' ORDER BY r_regionkey) AS freshness FROM (SELECT series, max(month) AS m FROM money GROUP BY 1) JOIN region ON r_name = series")
def n03_freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' months in one line."""
    last = money(spark, sf_dir).groupBy("series").agg(F.max("month").alias("latest_date"))
    region = table(spark, sf_dir, "region").select(F.col("r_name").alias("series"), F.col("r_regionkey").alias("ordinal"))
    return nowcast.freshness(last.join(region, "series").select("ordinal", F.left("series", F.lit(2)).alias("short"), "latest_date"))


@query(f"WITH {MO}, {BL} SELECT lower(series) AS block, round(latest, 6) AS latest_yoy, 'FALLBACK_LAST_VERIFIED' AS status, false AS live_attempted FROM blocks")
def n04_last_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks as served without a refresh."""
    return nowcast.last_verified(_named_blocks(spark, sf_dir)).select("block", *r6("latest_yoy"), "status", "live_attempted")


@query(
    f"""WITH {MO}, {BL}, {_OLD}
    SELECT block, latest_date, round(latest_yoy, 6) AS latest_yoy, CASE WHEN latest_yoy - ref > 0.25 THEN 'ACCELERATING' WHEN latest_yoy - ref < -0.25 THEN 'DECELERATING' ELSE 'STABLE' END AS direction,
      reason IS NULL AND (nd <> d OR round(ny, 4) <> round(y, 4)) AS changed, CASE WHEN reason IS NULL THEN 'PASS' ELSE 'PRESERVED_LAST_VERIFIED' END AS status, reason FROM done"""
)
def n07_refresh_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates applied where they pass validation, else the last verified values."""
    rows = nowcast.refresh(_named_blocks(spark, sf_dir), _updates(spark, sf_dir))
    return rows.select("block", "latest_date", *r6("latest_yoy"), "direction", "changed", "status", "reason")


@query(
    """WITH d AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, avg(o_totalprice) AS value FROM orders WHERE o_orderdate < DATE '2001-08-01' GROUP BY 1),
    e AS (SELECT max(date) AS latest, arg_max(value, date) AS now, arg_max(value, date) FILTER (date <= DATE '2001-02-28') AS base, max(date) FILTER (date <= DATE '2001-02-28') AS based FROM d)
    SELECT latest, based, round(100 * (now / base - 1), 2) AS pct_change, CASE WHEN round(100 * (now / base - 1), 2) < -1 THEN 'TAILWIND_WEAKER_USD' WHEN round(100 * (now / base - 1), 2) > 1
      THEN 'HEADWIND_STRONGER_USD' ELSE 'NEUTRAL' END AS translation FROM e WHERE abs(100 * (now / base - 1)) <= 30"""
)
def n08_translation_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The move since the last value on or before a date."""
    daily = table(spark, sf_dir, "orders").where("o_orderdate < '2001-08-01'").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.avg("o_totalprice").alias("value"))
    return nowcast.translation(daily, "2001-02-28")


@query(
    f"""WITH {P} SELECT asset, m AS month FROM (SELECT asset, max(month) AS e FROM price GROUP BY 1),
    (SELECT strftime(DATE '1995-01-01' + to_months(i::INT), '%Y-%m') AS m FROM range(79) r(i)) WHERE m <= e EXCEPT SELECT asset, month FROM price"""
)
def j08_missing_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calendar months that an asset lacks."""
    return nowcast.missing_months(prices(spark, sf_dir), "asset", "1995-01")


# ---- rules over all their inputs


def _dealt(spark: SparkSession, sf_dir: str, schema: str, *values) -> DataFrame:
    """Every event with one combination of the rule's inputs, dealt by its id, so that all of them occur."""
    out, step = table(spark, sf_dir, "events").select("event_id"), 1
    for (name, kind), own in zip((c.split() for c in schema.split(", ")), values, strict=True):
        own = list(own)
        at = (F.floor(F.col("event_id") / step) % len(own)).cast("int")
        out, step = out.withColumn(name, F.get(F.array(*(F.lit(v).cast(kind) for v in own)), at)), step * len(own)
    return out


def _dealt_sql(**lists) -> str:
    lit = lambda v: "NULL::BOOLEAN" if v is None else str(v).lower() if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    columns, step = [], 1
    for k, vs in lists.items():
        vs = list(vs)
        columns.append(f"([{', '.join(map(lit, vs))}])[(event_id // {step}) % {len(vs)} + 1] AS {k}")
        step *= len(vs)
    return f"SELECT event_id, {', '.join(columns)} FROM events"


FLAG = [True, False]
_SCORES = [0.0, 24.999, 25.0, 39.999, 40.0, 59.68584363312337, 60.0, 60.001, 74.999, 75.0, 100.0]
_REGIME = "CASE WHEN {0} < 25 THEN 'STRONG RISK-OFF' WHEN {0} < 40 THEN 'RISK-OFF' WHEN {0} < 60 THEN 'NEUTRAL' WHEN {0} < 75 THEN 'RISK-ON' ELSE 'STRONG RISK-ON' END"


@query(
    f"""SELECT event_id, s::DOUBLE AS s, round(50 + s * (50.0 / 3), 6)::DOUBLE AS score_of_z, {_REGIME.format('s')} AS regime, CASE WHEN s < 40 THEN 'RESTRICTIVE' WHEN s > 60 THEN 'SUPPORTIVE' ELSE 'NEUTRAL' END AS funding
    FROM ({_dealt_sql(s=_SCORES)})"""
)
def r01_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score regimes at and around their bounds."""
    s = F.col("s")
    return _dealt(spark, sf_dir, "s double", _SCORES).select("event_id", "s", F.round(score_of_z(s), 6).alias("score_of_z"), rules.regime(s).alias("regime"), rules.funding_regime(s).alias("funding"))


@query(
    f"""WITH x AS ({_dealt_sql(usd=[30, 50, 65], fxn=[30, 50, 65], funding=[30, 50, 65], stale=FLAG, candidate=FLAG, positive=[0, 1, 2, 3, 4], known=[0, 2, 3, 4])}),
    s AS (SELECT *, CASE WHEN NOT stale THEN 2 WHEN candidate THEN 1 ELSE 0 END + CASE WHEN {_REGIME.format('usd')} = {_REGIME.format('fxn')} THEN 2 ELSE 0 END + 2
      + CASE WHEN funding > 60 THEN 2 WHEN funding < 40 THEN 0 ELSE 1 END + CASE WHEN known < 3 THEN 1 WHEN positive >= 3 THEN 2 WHEN positive = 2 THEN 1 ELSE 0 END AS conviction FROM x)
    SELECT * REPLACE (conviction::INT AS conviction), conviction || '/10' AS label FROM s"""
)
def r05_conviction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conviction rubric."""
    x = _dealt(spark, sf_dir, "usd int, fxn int, funding int, stale boolean, candidate boolean, positive int, known int", [30, 50, 65], [30, 50, 65], [30, 50, 65], FLAG, FLAG, range(5), [0, 2, 3, 4])
    c = F.col
    parts = rules.conviction(c("stale"), c("candidate"), rules.agreement(c("usd"), c("fxn")), rules.funding_regime(c("funding")), rules.market_score(c("positive"), c("known")))
    return x.select("*", parts["conviction"].alias("conviction"), parts["conviction_label"].alias("label"))


TILTS = ["SUPPORTIVE_MIXED", "DETERIORATING", "NEUTRAL_TO_SUPPORTIVE", "MIXED"]


def transmission_sql(usd: str, fxn: str) -> str:
    score = f"CASE money WHEN 'usd' THEN {usd} WHEN 'fxn' THEN {fxn} END"
    return f"""tilt <> 'DETERIORATING' AND coalesce({score}, 50) >= 50 AS t_pass, {score} AS t_score, tier = 'CORE' AND money IN ('usd', 'fxn') AS t_promoted,
      CASE money WHEN 'usd' THEN 'USD Money' WHEN 'fxn' THEN 'FX-neutral Money' ELSE 'Broad Money context only' END AS t_basis, tilt AS t_turn,
      CASE money WHEN 'usd' THEN 'Uses USD Money only; no synthetic USD/FX-neutral blend.' WHEN 'fxn' THEN 'Uses FX-neutral Money only; no synthetic blend.'
        ELSE 'USD ' || printf('%.1f', {usd}) || ' / FX-neutral ' || printf('%.1f', {fxn}) || ' are shown separately; no composite is computed.' END AS t_note"""


@query(f"WITH x AS ({_dealt_sql(money=['usd', 'fxn', 'context'], tier=['CORE', 'RESEARCH'], usd=[49.5, 50.0, 66.0], fxn=[43.0, 50.0], tilt=TILTS)}) SELECT * REPLACE (usd::DOUBLE AS usd, fxn::DOUBLE AS fxn, t_score::DOUBLE AS t_score) FROM (SELECT *, {transmission_sql('usd', 'fxn')} FROM x)")
def r07_transmission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The money gate by basis, score and tilt."""
    x = _dealt(spark, sf_dir, "money string, tier string, usd double, fxn double, tilt string", ["usd", "fxn", "context"], ["CORE", "RESEARCH"], [49.5, 50.0, 66.0], [43.0, 50.0], TILTS)
    t = rules.transmission(*(F.col(c) for c in ("money", "tier", "usd", "fxn", "tilt")))
    return x.select("*", *(t[c].alias(c) for c in ("t_pass", "t_score", "t_promoted", "t_basis", "t_turn", "t_note")))


MODES = sorted({a[6] for a in dims.ASSETS})


_UNAVAILABLE = " ".join(f"WHEN NOT @k AND strategic_mode = '{m}' THEN '{v}'" for m, v in rules.UNAVAILABLE.items())
_REASON = " ".join(f"WHEN strategic_mode = '{m}' THEN '{v}'" for m, v in rules.REASONS.items())


def strategic_sql(t: str = "t", d: str = "d", k: str = "k") -> str:
    hard = "strategic_mode IN ('CORE_HARD_GATE', 'RESEARCH_PROXY_HARD_GATE')"
    return f"""CASE strategic_mode WHEN 'CORE_CONTEXT_ONLY' THEN CASE WHEN {t} AND {d} THEN 'ELIGIBLE + CHEAPNESS BONUS' WHEN {t} THEN 'ELIGIBLE' ELSE 'MONEY NOT SUPPORTIVE' END
    WHEN 'CORE_HARD_GATE' THEN CASE WHEN NOT {k} THEN 'DATA INCOMPLETE' WHEN {t} AND {d} THEN 'ACCUMULATION ZONE' WHEN {t} THEN 'WAIT FOR DISLOCATION' WHEN {d} THEN 'CHEAP, MONEY NOT CONFIRMED' ELSE 'NO STRATEGIC EDGE' END
    WHEN 'RESEARCH_DISLOCATION_PRIMARY' THEN CASE WHEN {d} THEN 'PROVISIONAL STRATEGIC ZONE' ELSE 'WAIT FOR YIELD DISLOCATION' END
    WHEN 'RESEARCH_PROXY_HARD_GATE' THEN CASE WHEN NOT {k} THEN 'DATA INCOMPLETE' WHEN {t} AND {d} THEN 'PROVISIONAL ACCUMULATION ZONE' WHEN {t} THEN 'WAIT FOR RELATIVE DISLOCATION'
      WHEN {d} THEN 'CHEAP, MONEY CONTEXT WEAK' ELSE 'NO RESEARCH EDGE' END
    WHEN 'RESEARCH_DATA_INCOMPLETE' THEN 'INSUFFICIENT HISTORY' WHEN 'RESEARCH_CONTEXT_ONLY' THEN 'WATCH ONLY' ELSE 'NO VALIDATED DISLOCATION MODEL' END AS s_label,
    CASE WHEN strategic_mode = 'CORE_CONTEXT_ONLY' THEN {t} WHEN {hard} THEN {k} AND {t} AND {d} WHEN strategic_mode = 'RESEARCH_DISLOCATION_PRIMARY' THEN {d} ELSE false END AS s_eligible,
    CASE strategic_mode WHEN 'CORE_CONTEXT_ONLY' THEN {t}::INT || '/1 core gate' WHEN 'RESEARCH_DISLOCATION_PRIMARY' THEN {d}::INT || '/1 research gate'
      WHEN 'RESEARCH_DATA_INCOMPLETE' THEN CASE WHEN {k} THEN 'research data available' ELSE 'data incomplete' END
      ELSE CASE WHEN NOT {hard} THEN 'context only' WHEN NOT {k} THEN {t}::INT || '/1 known' ELSE ({t}::INT + {d}::INT) || '/2' || CASE WHEN strategic_mode = 'RESEARCH_PROXY_HARD_GATE' THEN ' research' ELSE '' END END END AS s_score,
    CASE WHEN strategic_mode LIKE 'CORE%' THEN 'NORMAL' WHEN strategic_mode IN ('RESEARCH_DISLOCATION_PRIMARY', 'RESEARCH_PROXY_HARD_GATE') THEN 'PROVISIONAL' ELSE 'WATCH_ONLY' END AS s_cap,
    CASE {_UNAVAILABLE.replace('@k', k)} {_REASON} ELSE '{rules.OTHER_REASON}' END AS s_reason"""


@query(f"WITH x AS ({_dealt_sql(strategic_mode=MODES, t=FLAG, d=FLAG, k=FLAG)}) SELECT *, {strategic_sql()} FROM x")
def r09_strategic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility by mode and flags."""
    x = _dealt(spark, sf_dir, "strategic_mode string, t boolean, d boolean, k boolean", MODES, FLAG, FLAG, FLAG)
    return x.withColumns(rules.strategic(*(F.col(c) for c in ("strategic_mode", "t", "d", "k"))))


ENTRY = """CASE WHEN NOT p_known AND NOT turn_known THEN 'UNCONFIRMED' WHEN (p_known AND p_pass)::INT + (turn_known AND turn_pass)::INT = 2 THEN 'HIGH'
    WHEN (p_known AND p_pass) OR (turn_known AND turn_pass) THEN 'PARTIAL' ELSE 'LOW' END AS e_label,
    ((p_known AND p_pass)::INT + (turn_known AND turn_pass)::INT) || '/' || (p_known::INT + turn_known::INT) AS e_score"""


@query(f"WITH x AS ({_dealt_sql(p_known=FLAG, p_pass=FLAG, turn_known=FLAG, turn_pass=FLAG)}) SELECT *, {ENTRY} FROM x")
def r10_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry quality by flags."""
    names = ("p_known", "p_pass", "turn_known", "turn_pass")
    x = _dealt(spark, sf_dir, ", ".join(f"{c} boolean" for c in names), FLAG, FLAG, FLAG, FLAG)
    return x.withColumns(rules.entry(*(F.col(c) for c in names)))


ACTION = """CASE WHEN s_cap = 'WATCH_ONLY' THEN s_label WHEN NOT s_eligible THEN CASE WHEN contains(s_label, 'WAIT') THEN 'WAIT — DO NOT CHASE' ELSE 'WAIT' END
    WHEN s_cap = 'PROVISIONAL' OR backtest = 'INSUFFICIENT_SAMPLE' THEN CASE e_label WHEN 'HIGH' THEN 'PROVISIONAL SCALE-IN' WHEN 'PARTIAL' THEN 'PROVISIONAL START SMALL' ELSE 'PROVISIONAL WATCH' END
    ELSE CASE e_label WHEN 'HIGH' THEN 'ACCUMULATE' WHEN 'PARTIAL' THEN 'SCALE IN SMALL' WHEN 'LOW' THEN 'START SMALL / WAIT FOR BETTER ENTRY' ELSE 'ELIGIBLE, ENTRY UNCONFIRMED' END END"""
BUCKET = """CASE WHEN regexp_matches(action, 'ACCUMULATE|SCALE-IN|SCALE IN SMALL') THEN 'accumulate' WHEN contains(action, 'DO NOT CHASE') THEN 'dont_chase'
    WHEN regexp_matches(action, 'INSUFFICIENT|NO VALIDATED') THEN 'limited' ELSE 'watch' END"""
_CAPS, _ENTRIES = ["NORMAL", "PROVISIONAL", "WATCH_ONLY"], ["HIGH", "PARTIAL", "LOW", "UNCONFIRMED"]
_LABELS = ["ACCUMULATION ZONE", "WAIT FOR DISLOCATION", "WATCH ONLY", "INSUFFICIENT HISTORY", "NO VALIDATED DISLOCATION MODEL"]
_TESTS = ["INSUFFICIENT_SAMPLE", "NOT_YET_VALIDATED"]


@query(f"WITH x AS ({_dealt_sql(s_cap=_CAPS, s_label=_LABELS, s_eligible=FLAG, backtest=_TESTS, e_label=_ENTRIES)}), y AS (SELECT *, {ACTION} AS action FROM x) SELECT *, {BUCKET} AS bucket FROM y")
def r11_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Action and report bucket by cap, label, eligibility, back-test and entry."""
    names = ("s_cap", "s_label", "s_eligible", "backtest", "e_label")
    x = _dealt(spark, sf_dir, "s_cap string, s_label string, s_eligible boolean, backtest string, e_label string", _CAPS, _LABELS, FLAG, _TESTS, _ENTRIES)
    return x.withColumn("action", rules.action(*(F.col(c) for c in names))).withColumn("bucket", rules.report_bucket(F.col("action")))


_STATES = ["EARLY_UP", "CONFIRMED_UP", "EARLY_DOWN", "CONFIRMED_DOWN", "MIXED"]


def asymmetry_sql(macro: str, contrarian: str, turn: str, rs: str, adverse: str) -> tuple[str, str]:
    passes = f"({macro}::INT + {contrarian}::INT + {turn}::INT + coalesce({rs}, false)::INT)"
    core = f"({macro} AND {contrarian} AND {turn})"
    label = f"CASE WHEN {core} AND NOT {adverse} AND {rs} IS DISTINCT FROM false THEN 'HIGH' WHEN {core} OR {passes} >= 2 THEN 'MEDIUM' ELSE 'LOW' END"
    return label, f"{passes} || '/' || (3 + ({rs} IS NOT NULL)::INT)"


_A = asymmetry_sql("macro", "contrarian", "turn", "rs", "adverse")


@query(f"WITH x AS ({_dealt_sql(macro=FLAG, contrarian=FLAG, turn=FLAG, rs=[True, False, None], adverse=FLAG)}) SELECT *, {_A[0]} AS label, {_A[1]} AS evidence, adverse OR rs IS NOT DISTINCT FROM false AS capped FROM x")
def r17_asymmetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asymmetry by flags; relative strength may be unknown."""
    names = ("macro", "contrarian", "turn", "rs", "adverse")
    x = _dealt(spark, sf_dir, ", ".join(f"{c} boolean" for c in names), FLAG, FLAG, FLAG, [True, False, None], FLAG)
    return x.withColumns(rules.asymmetry(*(F.col(c) for c in names)))


def phase_sql(ml: str, ms: str, lc: str, sc: str, trend: str) -> str:
    return f"""CASE WHEN {ml} AND {lc} AND {trend} = 'EARLY_UP' THEN 'EARLY_LONG' WHEN {ms} AND {sc} AND {trend} = 'EARLY_DOWN' THEN 'EARLY_SHORT'
    WHEN {ml} AND {lc} AND {trend} = 'CONFIRMED_UP' THEN 'CONFIRMED_LONG' WHEN {ms} AND {sc} AND {trend} = 'CONFIRMED_DOWN' THEN 'CONFIRMED_SHORT'
    WHEN {ml} AND {lc} AND {trend} IN ('MIXED', 'EARLY_DOWN', 'CONFIRMED_DOWN') THEN 'SETUP_LONG' WHEN {ms} AND {sc} AND {trend} IN ('MIXED', 'EARLY_UP', 'CONFIRMED_UP') THEN 'SETUP_SHORT'
    WHEN {trend} = 'CONFIRMED_UP' AND {sc} THEN 'MATURE_LONG_DONT_CHASE' WHEN {trend} = 'CONFIRMED_DOWN' AND {lc} THEN 'MATURE_SHORT_DONT_CHASE'
    WHEN {trend} = 'CONFIRMED_UP' THEN 'TREND_UP_NO_CONTRARIAN_EDGE' WHEN {trend} = 'CONFIRMED_DOWN' THEN 'TREND_DOWN_NO_CONTRARIAN_EDGE' ELSE 'WATCH' END"""


@query(f"WITH x AS ({_dealt_sql(ml=FLAG, ms=FLAG, lc=FLAG, sc=FLAG, trend=_STATES)}) SELECT *, {phase_sql('ml', 'ms', 'lc', 'sc', 'trend')} AS phase FROM x")
def r18_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eleven phases."""
    names = ("ml", "ms", "lc", "sc", "trend")
    x = _dealt(spark, sf_dir, "ml boolean, ms boolean, lc boolean, sc boolean, trend string", FLAG, FLAG, FLAG, FLAG, _STATES)
    return x.withColumn("phase", rules.phase(*(F.col(c) for c in names)))


_LEVEL = ["HIGH", "MEDIUM", "LOW"]
SIDE = """CASE WHEN {l} AND NOT {s} THEN 'LONG' WHEN {s} AND NOT {l} THEN 'SHORT' WHEN NOT {l} THEN 'NONE' WHEN {ll} = 'HIGH' AND {sl} <> 'HIGH' THEN 'LONG'
    WHEN {sl} = 'HIGH' AND {ll} <> 'HIGH' THEN 'SHORT' ELSE 'NONE' END"""


@query(f"WITH x AS ({_dealt_sql(l=FLAG, s=FLAG, ll=_LEVEL, sl=_LEVEL)}) SELECT *, {SIDE.format(l='l', s='s', ll='ll', sl='sl')} AS side FROM x")
def r20_preferred_side(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The preferred side."""
    x = _dealt(spark, sf_dir, "l boolean, s boolean, ll string, sl string", FLAG, FLAG, _LEVEL, _LEVEL)
    return x.withColumn("side", rules.side(*(F.col(c) for c in ("l", "s", "ll", "sl"))))


# ---- from panels to reports

FOUND = f"""{P}, {C}, {L}, {REL}, {REAL}, {_LEV}, {M}, {BK}, {U}, {turn_sql('t', 'price')}, {turn_sql('rt', 'rel')},
  {z_sql('za', 'price')}, {z_sql('zr', 'realp')}, {z_sql('zb', 'rel')}, {z_sql('zl', 'lev', False)},
  dis AS (SELECT u.asset, z IS NOT NULL AS k, coalesce(CASE WHEN dislocation LIKE '%high' THEN z >= 1 ELSE z <= -1 END, false) AS d, round(z, 2) AS z60m FROM universe u JOIN (
    SELECT asset, z, 'absolute' AS kind FROM {last_sql('za')} UNION ALL SELECT asset, z, 'real' FROM {last_sql('zr')} UNION ALL SELECT asset, z, 'relative_spy' FROM {last_sql('zb')}
    UNION ALL SELECT asset, z, CASE asset WHEN 'TLT' THEN 'real_yield_10y_high' WHEN 'IEF' THEN 'real_yield_5y_high' ELSE 'hy_oas_high' END FROM {last_sql('zl')}) x ON x.asset = u.asset AND kind = dislocation),
  f0 AS (SELECT u.*, coalesce(n >= 13, false) AS turn_known, coalesce(pass, false) AS turn_pass, stage, t.month AS price_as_of, coalesce(k, false) AS k, coalesce(d, false) AS d, z60m, p_known, p_pass, p_as_of, crowded AS crowd, 'SUPPORTIVE_MIXED' AS tilt
    FROM universe u LEFT JOIN {last_sql('t')} t USING (asset) LEFT JOIN dis USING (asset) LEFT JOIN held USING (asset)),
  f1 AS (SELECT *, {transmission_sql(str(dims.STATE['usd_score']), str(dims.STATE['fxn_score']))} FROM f0),
  f2 AS (SELECT *, {strategic_sql('t_pass')}, {ENTRY} FROM f1),
  f3 AS (SELECT *, {ACTION} AS action FROM f2)"""

_UP = [
    ("strategic_mode = 'CORE_HARD_GATE' AND NOT d", "Asset-specific dislocation reaches its pre-specified cheapness threshold while promoted Money remains supportive."),
    ("asset = 'GLD' AND NOT s_eligible", "FX-neutral Money returns to a supportive regime."),
    ("asset IN ('TLT', 'IEF') AND d AND NOT turn_pass", "Duration price turn becomes positive while real-yield dislocation remains elevated."),
    ("asset IN ('TLT', 'IEF') AND NOT d", "Relevant real-yield 60M z-score rises back above +1."),
    ("asset = 'EEM' AND NOT d", "EEM/SPY relative-price dislocation reaches z <= -1 while broad Money context stays supportive."),
    ("asset IN ('VNQ', 'VEA', 'IWM', 'SLV', 'USO', 'CPER', 'DBA', 'FXY')", "Research dislocation/positioning aligns with an early price and relative-strength turn."),
    ("asset = 'HYG'", "A reproducible long-history credit-spread series becomes available and shows a genuinely wide-spread dislocation."),
    ("asset = 'BTC'", "A robust BTC-specific dislocation model is validated and price turn stabilizes."),
    ("p_known AND NOT p_pass", "Asset-specific CFTC positioning washes out toward the contrarian <=25th percentile zone."),
    ("turn_known AND NOT turn_pass", "Completed-month price turn turns positive."),
]
_DOWN = [
    ("tier = 'CORE' AND money = 'fxn'", "FX-neutral Money deteriorates materially."),
    ("tier = 'CORE' AND money <> 'fxn'", "USD Money deteriorates materially."),
    ("tier <> 'CORE'", "Broad Money freshness deteriorates across several major blocks."),
    ("crowd", "Positioning remains or becomes crowded while price loses confirmation."),
    ("turn_known AND turn_pass", "Completed-month price turn rolls over."),
]


def _messages(rows: list[tuple[str, str]], most: int) -> str:
    """The first texts whose condition holds, joined."""
    cases = ", ".join(f"CASE WHEN {c} THEN '{m}' END" for c, m in rows)
    return f"array_to_string(list_slice(list_filter([{cases}], lambda x: x IS NOT NULL), 1, {most}), '|')"


@query(f"WITH {FOUND} SELECT asset, k AS d_known, d AS d_pass, z60m FROM dis")
def r08_dislocation_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each asset's dislocation by its own model."""
    rows = plans.dislocations(prices(spark, sf_dir), cpi(spark, sf_dir), levels(spark, sf_dir), dims.assets(spark))
    return rows.select("asset", "d_known", "d_pass", "z60m")


@query(f"WITH {FOUND} SELECT asset, {_messages(_UP, 3)} AS upgrade, {_messages(_DOWN, 2)} AS downgrade FROM f3")
def r12_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would raise and lower each asset."""
    return found(spark, sf_dir).select("asset", texts("upgrade"), texts("downgrade"))


@query(f"WITH {FOUND} SELECT ordinal, asset, t_pass, k AS d_known, d AS d_pass, z60m, p_known, p_pass, turn_known, turn_pass, s_label, s_eligible, s_score, s_cap, e_label, e_score, action FROM f3")
def r13_opportunity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates, labels and action of the whole universe."""
    names = "ordinal asset t_pass d_known d_pass z60m p_known p_pass turn_known turn_pass s_label s_eligible s_score s_cap e_label e_score action"
    return found(spark, sf_dir).select(*names.split())


@query(
    f"""WITH {FOUND} SELECT {BUCKET} AS bucket, ordinal, asset, CASE WHEN tier = 'CORE' THEN 'RESEARCH_DECISION_OVERLAY_WITH_CORE_TRANSMISSION' ELSE 'RESEARCH_ONLY' END AS evidence_tier,
    s_label, e_label, action FROM f3"""
)
def r14_report_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report's buckets."""
    return plans.report(found(spark, sf_dir)).drop("asset_class")


@query(
    """SELECT * FROM (VALUES (0, 'MONEY_DIVERGENCE', 'Validated Core: USD 65.7 RISK-ON vs FX-neutral 43 NEUTRAL.'),
    (1, 'CORE_VINTAGE_LAG', 'Validated Core is 2026-02-28; production candidate is 2026-06-30 and is not yet CORE.'),
    (2, 'CORE_PROMOTION_AUDIT', 'RBA blocker passed, but the exact Aug-15 macro matrix, adjusted-price mirror, original v1.2 exact-ticker runner and full56 baseline bytes were not preserved. Promotion remains fail-closed.'),
    (3, 'POSITIONING_SOURCE', 'no column for oi')) t(ordinal, type, detail)"""
)
def r15_report_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The conflicts that a report states, with their details."""
    decided = plans.decision(found(spark, sf_dir), nowcast.summary(dims.nowcast_blocks(spark)))
    return plans.report_conflicts(decided, F.lit("no column for oi"))


@query(
    f"""WITH {FOUND}, m AS (SELECT count(*) FILTER (turn_pass) AS positive, count(*) AS known FROM f3 WHERE turn_known AND asset IN ('SPY', 'QQQ', 'GLD', 'DBC')),
    s AS (SELECT *, CASE WHEN known < 3 THEN 1 WHEN positive >= 3 THEN 2 WHEN positive = 2 THEN 1 ELSE 0 END AS score_market FROM m)
    SELECT positive, known, 'SUPPORTIVE_MIXED' AS tilt, '4/4' AS coverage, 'RISK-ON' AS usd_regime, 'NEUTRAL' AS fxn_regime, 'DIVERGENT' AS money_agreement, 'RESTRICTIVE' AS funding_regime,
      score_market, (3 + score_market)::INT AS conviction, 'NEUTRAL' AS regime_label, 'MILD_POSITIVE' AS regime_tilt, NULL::DOUBLE AS regime_score, 65.7::DOUBLE AS usd_score, 43.0::DOUBLE AS fxn_score,
      '2026-06-30' AS candidate_date, 59.7::DOUBLE AS candidate_usd_score, 45.3::DOUBLE AS candidate_fxn_score, 'NEUTRAL' AS candidate_usd_regime, 'NEUTRAL' AS candidate_fxn_regime,
      'BLOCKED_MISSING_FROZEN_INPUT_BYTES' AS promotion_gate, false AS core_replacement_allowed,
      'Validated Money Core is divergent: USD Risk-On, FX-neutral Neutral.|Newer production-source Money candidate is USD 59.7 / FX-neutral 45.3 as available 2026-06-30.|Freshness overlay is SUPPORTIVE_MIXED: 3/4 blocks accelerated and 4/4 are expanding YoY.|Funding remains restrictive, limiting conviction.|'
        || positive || '/' || CASE known WHEN 0 THEN 4 ELSE known END || ' primary market turns are currently positive.' AS key_reasons FROM s"""
)
def r06_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision: regimes, money and its candidate, the gate, conviction and reasons."""
    rows = plans.decision(found(spark, sf_dir), nowcast.summary(dims.nowcast_blocks(spark)))
    names = "positive known tilt coverage usd_regime fxn_regime money_agreement funding_regime score_market conviction regime_label regime_tilt regime_score usd_score fxn_score"
    names += " candidate_date candidate_usd_score candidate_fxn_score candidate_usd_regime candidate_fxn_regime promotion_gate core_replacement_allowed"
    return rows.select(*names.split(), texts("key_reasons"))


_LA = asymmetry_sql("ml", "lc", "tl", "rl", "sc")
_SA = asymmetry_sql("ms", "sc", "ts", "rs", "lc")
RADAR = f"""{FOUND}, g0 AS (SELECT f3.*, coalesce(f3.stage, 'MIXED') AS trend, t_pass AS ml, NOT t_pass AS ms,
    coalesce(k AND CASE WHEN strategic_mode IN ('RESEARCH_DISLOCATION_PRIMARY', 'RESEARCH_DATA_INCOMPLETE') THEN z60m <= -1 ELSE z60m >= 1 END, false) AS expensive,
    p_known AND p_pass AS washed, p_known AND crowd AS crowded, r.stage LIKE '%_UP' AS rl, r.stage LIKE '%_DOWN' AS rs
    FROM f3 LEFT JOIN (SELECT asset, stage FROM {last_sql('rt')} WHERE n >= 13) r ON r.asset = f3.asset),
  g1 AS (SELECT *, d OR washed AS lc, expensive OR crowded AS sc, trend LIKE '%_UP' AS tl, trend LIKE '%_DOWN' AS ts FROM g0),
  g2 AS (SELECT *, {_LA[0]} AS ll, {_LA[1]} AS le, {_SA[0]} AS sl, {_SA[1]} AS se, {phase_sql('ml', 'ms', 'lc', 'sc', 'trend')} AS phase, ml AND lc AS lel, ms AND sc AS sel FROM g1),
  g3 AS (SELECT *, {SIDE.format(l='lel', s='sel', ll='ll', sl='sl')} AS side FROM g2),
  g4 AS (SELECT *, CASE side WHEN 'LONG' THEN ll WHEN 'SHORT' THEN sl ELSE 'LOW' END AS best FROM g3),
  g5 AS (SELECT *, 10 * CASE best WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END + CASE WHEN phase LIKE 'EARLY_%' THEN 4 WHEN phase LIKE 'SETUP_%' THEN 3 WHEN phase LIKE 'CONFIRMED_%' THEN 2 ELSE 0 END AS rank FROM g4)"""
_CONFLICTS = [
    ("lel AND expensive", "Long contrarian evidence conflicts with an expensive/stretched price dislocation."),
    ("lel AND crowded", "Long case conflicts with crowded positioning."),
    ("lel AND NOT rl", "Long case conflicts with weakening relative strength versus SPY."),
    ("sel AND d", "Short case conflicts with a cheap long-side dislocation."),
    ("sel AND washed", "Short case conflicts with washed-out positioning."),
    ("sel AND NOT rs", "Short case conflicts with improving relative strength versus SPY."),
]
_REASONS = [
    ("ml", "Money/transmission context supports the long side."),
    ("ms", "Money/transmission context is not supportive and can support the short side."),
    ("d", "Contrarian long dislocation threshold is met."),
    ("expensive", "Opposite-side dislocation is stretched enough to support a contrarian short watch."),
    ("washed", "CFTC positioning is in the contrarian-friendly lower quartile."),
    ("crowded", "CFTC positioning is crowded in the upper quartile."),
    ("trend = 'EARLY_UP'", "Price is in an early upside turn rather than a mature confirmed trend."),
    ("trend = 'EARLY_DOWN'", "Price is in an early downside turn rather than a mature confirmed trend."),
    ("rl", "Relative strength versus SPY is improving."),
    ("rs", "Relative strength versus SPY is weakening."),
]


@query(f"WITH {RADAR} SELECT asset, expensive FROM g5")
def r16_short_dislocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretched on the short side."""
    return radar_rows(spark, sf_dir).select("asset", "expensive")


@query(f"WITH {RADAR} SELECT asset, {_messages(_CONFLICTS, 6)} AS conflicts, {_messages(_REASONS, 5)} AS reasons FROM g5")
def r21_radar_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conflicts and reasons."""
    return radar_rows(spark, sf_dir).select("asset", texts("conflicts"), texts("reasons"))


@query(
    f"""WITH {RADAR} SELECT CASE WHEN contains(phase, 'DONT_CHASE') THEN 'mature_dont_chase' WHEN phase LIKE 'EARLY_LONG' THEN 'early_longs' WHEN phase = 'EARLY_SHORT' THEN 'early_shorts'
    WHEN phase = 'SETUP_LONG' THEN 'setup_longs' WHEN phase = 'SETUP_SHORT' THEN 'setup_shorts' WHEN phase = 'CONFIRMED_LONG' THEN 'confirmed_longs' ELSE 'confirmed_shorts' END AS bucket,
    rank, ordinal, asset, best AS best_asymmetry FROM g5 WHERE contains(phase, 'DONT_CHASE') OR side <> 'NONE' AND regexp_matches(phase, '^(EARLY|SETUP|CONFIRMED)_')"""
)
def r23_radar_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar's buckets."""
    return plans.radar_buckets(radar_rows(spark, sf_dir)).select("bucket", "rank", "ordinal", "asset", "best_asymmetry")


_MATRIX = "ordinal asset asset_class trend macro_long cheap expensive washed crowded rs_long rs_short long_label long_evidence short_label short_evidence phase preferred_side best_asymmetry rank action"


@query(
    f"""WITH {RADAR} SELECT ordinal, asset, asset_class, trend, ml AS macro_long, d AS cheap, expensive, washed, crowded, rl AS rs_long, rs AS rs_short, ll AS long_label, le AS long_evidence,
    sl AS short_label, se AS short_evidence, phase, side AS preferred_side, best AS best_asymmetry, rank, action FROM g5"""
)
def r25_radar_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The radar over the whole universe."""
    return radar_rows(spark, sf_dir).select(*_MATRIX.split())


@query(f"WITH {RADAR} SELECT row_number() OVER (ORDER BY rank DESC, ordinal)::INT AS place, asset FROM g5")
def o03_radar_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ranking; ties keep the universe's order. The window is over the universe."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.orderBy(F.desc("rank"), "ordinal"))
    return radar_rows(spark, sf_dir).select(place.alias("place"), "asset")


@query(f"WITH {P} SELECT DISTINCT asset FROM price EXCEPT SELECT asset FROM ({UNIVERSE}) WHERE tier = 'CORE'")
def u03_research_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The assets with prices that are not of the core."""
    core = dims.assets(spark).where("tier = 'CORE'").select("asset")
    return prices(spark, sf_dir).select("asset").distinct().join(core, "asset", "left_anti")


_PCT = "round(100 * {0}, 1)"


@query(
    f"""WITH {RADAR} SELECT g5.asset, asset_class, tier = 'CORE' AS core_transmission, phase, side AS preferred_side, best AS best_asymmetry, ll AS long_label, le AS long_evidence, sl AS short_label, se AS short_evidence,
    ml AS long_support, money AS basis, round(t_score, 1)::DOUBLE AS score, d AS cheap_long, expensive AS expensive_short, washed, crowded, z60m AS dislocation_z, trend AS stage,
    CASE WHEN p.n >= 13 THEN round(p.value, 4) END AS price, round(p.ma10, 4) AS ma10, {_PCT.format('p.slope')} AS slope, {_PCT.format('p.r3')} AS r3, {_PCT.format('p.r6')} AS r6,
    {_messages(_CONFLICTS, 6)} AS conflicts, {_messages(_REASONS, 5)} AS reasons, {_messages(_DOWN, 2)} AS invalidation, p.month AS price_as_of, '2026-02-28' AS money_as_of, p_as_of AS positions_as_of, t_turn AS freshness_turn,
    'NEUTRAL' AS regime, 'MILD_POSITIVE' AS tilt, 'RESTRICTIVE' AS funding FROM g5 LEFT JOIN {last_sql('t')} p ON p.asset = g5.asset"""
)
def k01_json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Radar documents as an endpoint sends them, read back whole."""
    rows = radar_rows(spark, sf_dir)
    sent = plans.radar_document(rows, plans.decision(found(spark, sf_dir), nowcast.summary(dims.nowcast_blocks(spark))))
    side = "struct<label:string,evidence:string>"
    back = sent.select(F.from_json("document", f"""asset string, asset_class string, core_transmission boolean, phase string, preferred_side string, best_asymmetry string, long_asymmetry {side},
      short_asymmetry {side}, macro struct<long_support:boolean,basis:string,score:double,freshness_turn:string>, regime_context struct<label:string,tilt:string,funding:string>,
      contrarian struct<cheap_long:boolean,expensive_short:boolean,positioning_washed:boolean,positioning_crowded:boolean,dislocation_z:double>,
      trend struct<stage:string,price:double,ma10:double,ma10_slope_3m_pct:double,return_3m_pct:double,return_6m_pct:double>, conflicts array<string>, mechanical_reasons array<string>,
      invalidation array<string>, freshness struct<price:string,positioning:string,money:string>""").alias("j")).select("j.*")  # fmt: skip
    names = {
        "long_asymmetry.label": "long_label", "long_asymmetry.evidence": "long_evidence", "short_asymmetry.label": "short_label", "short_asymmetry.evidence": "short_evidence",
        "macro.long_support": "long_support", "macro.basis": "basis", "macro.score": "score", "contrarian.cheap_long": "cheap_long", "contrarian.expensive_short": "expensive_short",
        "contrarian.positioning_washed": "washed", "contrarian.positioning_crowded": "crowded", "contrarian.dislocation_z": "dislocation_z", "trend.stage": "stage", "trend.price": "price",
        "trend.ma10": "ma10", "trend.ma10_slope_3m_pct": "slope", "trend.return_3m_pct": "r3", "trend.return_6m_pct": "r6", "freshness.price": "price_as_of", "freshness.money": "money_as_of", "freshness.positioning": "positions_as_of", "macro.freshness_turn": "freshness_turn",
        "regime_context.label": "regime", "regime_context.tilt": "tilt", "regime_context.funding": "funding",
    }
    plain = ("asset", "asset_class", "core_transmission", "phase", "preferred_side", "best_asymmetry")
    return back.select(*plain, *(F.col(k).alias(v) for k, v in names.items()), texts("conflicts"), F.concat_ws("|", "mechanical_reasons").alias("reasons"), texts("invalidation"))


@query(
    f"""WITH {FOUND} SELECT asset, asset_class, CASE WHEN tier = 'CORE' THEN 'RESEARCH_DECISION_OVERLAY_WITH_CORE_TRANSMISSION' ELSE 'RESEARCH_ONLY' END AS evidence_tier, backtest, episodes, s_score, s_eligible, s_label, s_reason, s_cap,
    t_pass, round(t_score, 1)::DOUBLE AS t_score, t_basis, '2026-02-28' AS core_date, t_turn, t_note, k AS d_known, d AS d_pass, z60m, p_known, p_pass, crowd AS crowded, p_as_of, e_score, e_label, turn_known, turn_pass, stage, action, price_as_of,
    {_messages(_UP, 3)} AS upgrade, {_messages(_DOWN, 2)} AS downgrade, CASE WHEN price_as_of IS NULL THEN 'no price chart' END AS error FROM f3"""
)
def r13_opportunity_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opportunity documents as an endpoint sends them, read back whole; an asset without prices has an error."""
    rows = found(spark, sf_dir)
    errors = rows.where("price_as_of IS NULL").select("asset", F.lit("no price chart").alias("error"))
    back = plans.opportunity_document(rows, errors).select(F.from_json("document", """asset string, asset_class string, evidence_tier string, backtest struct<status:string,episode_starts:int,note:string>,
      strategic_eligibility struct<score:string,eligible:boolean,label:string,reason:string,cap:string>, strategic_inputs struct<transmission:struct<pass:boolean,score:double,money_basis:string,core_date:string,
      freshness_turn:string,note:string>,dislocation:struct<available:boolean,pass:boolean,z60m:double>>, entry_quality struct<score:string,label:string>,
      entry_inputs struct<positioning:struct<available:boolean,pass:boolean,crowded:boolean,as_of:string>,turn:struct<available:boolean,pass:boolean,stage:string>>, action string,
      triggers struct<upgrade:array<string>,downgrade:array<string>>, price_as_of string, error string""").alias("j")).select("j.*")  # fmt: skip
    names = {
        "backtest.status": "backtest", "backtest.episode_starts": "episodes", "strategic_eligibility.score": "s_score", "strategic_eligibility.eligible": "s_eligible", "strategic_eligibility.label": "s_label",
        "strategic_eligibility.reason": "s_reason", "strategic_eligibility.cap": "s_cap", "strategic_inputs.transmission.pass": "t_pass", "strategic_inputs.transmission.score": "t_score",
        "strategic_inputs.transmission.money_basis": "t_basis", "strategic_inputs.transmission.core_date": "core_date", "strategic_inputs.transmission.freshness_turn": "t_turn", "strategic_inputs.transmission.note": "t_note",
        "strategic_inputs.dislocation.available": "d_known", "strategic_inputs.dislocation.pass": "d_pass", "strategic_inputs.dislocation.z60m": "z60m", "entry_inputs.positioning.available": "p_known",
        "entry_inputs.positioning.pass": "p_pass", "entry_inputs.positioning.crowded": "crowded", "entry_inputs.positioning.as_of": "p_as_of", "entry_quality.score": "e_score", "entry_quality.label": "e_label",
        "entry_inputs.turn.available": "turn_known", "entry_inputs.turn.pass": "turn_pass", "entry_inputs.turn.stage": "stage",
    }
    lists = [F.concat_ws("|", f"triggers.{c}").alias(c) for c in ("upgrade", "downgrade")]
    return back.select("asset", "asset_class", "evidence_tier", "action", "price_as_of", "error", *(F.col(k).alias(v) for k, v in names.items()), *lists)


@query(f"WITH {MO}, {BL}, {_OLD} SELECT block, latest_date, round(latest_yoy, 6) AS latest_yoy FROM done WHERE latest_date <> d OR latest_yoy <> y")
def k03_changed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a refresh changes in the snapshot; a snapshot without such rows is not written again."""
    before = _named_blocks(spark, sf_dir)
    after = nowcast.refresh(before, _updates(spark, sf_dir)).select(*before.columns)
    return sinks.changed(before, after, "block").select("block", "latest_date", *r6("latest_yoy"))


# ---- audits


@query(
    """WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS date, count(*)::DOUBLE AS value FROM orders GROUP BY 1)
    SELECT count(*) AS observations, max(date) AS latest, 80 - count(*) AS missing, count(*) FILTER (date = DATE '1995-02-01' AND value > 0) - 1 AS met, false AS pass FROM m WHERE date >= DATE '1995-01-01'"""
)
def v02_release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Enough months, none missing, the expected values met; here the expected value is wrong."""
    monthly = table(spark, sf_dir, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("date").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return audit.release_gate(monthly, "1995-01", 80, {"1995-02": -1.0}).select("observations", "latest", "missing", "met", "pass")


@query("SELECT count(DISTINCT last_day(o_orderdate)) AS observations, max(last_day(o_orderdate))::DATE AS latest, 0::BIGINT AS missing, 0::BIGINT AS met, true AS pass FROM orders")
def v02_release_gate_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate of a release that is all it must be: 80 months, none missing."""
    release = table(spark, sf_dir, "orders").groupBy(F.last_day("o_orderdate").alias("date")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return audit.release_gate(release, "1995-01", 80, {}).select("observations", "latest", "missing", "met", "pass")


@query("SELECT 0::BIGINT AS missing_inputs, true AS gate, 'READY_FOR_EXACT_RERUN' AS decision, false AS promote_to_core")
def v03_promotion_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All inputs there and the gate passed: ready, and still not promoted."""
    path = table(spark, sf_dir, "nation").select(F.col("n_name").alias("path"))
    return audit.promotion(audit.inputs_present(path, path), v02_release_gate_passes(spark, sf_dir))


@query("SELECT n_name AS path, n_regionkey < 3 AS present FROM nation")
def j09_required_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which required inputs are there."""
    nation = table(spark, sf_dir, "nation")
    path = nation.select(F.col("n_name").alias("path"), "n_regionkey")
    return audit.inputs_present(path, path.where("n_regionkey < 3"))


@query("SELECT count(*) FILTER (n_regionkey >= 3) AS missing_inputs, true AS gate, 'BLOCKED_MISSING_FROZEN_INPUT_BYTES' AS decision, false AS promote_to_core FROM nation")
def v03_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The promotion decision fails closed."""
    return audit.promotion(j09_required_inputs(spark, sf_dir), spark.range(1).select(F.lit(True).alias("pass")))


@query("SELECT p_partkey AS key, strlen(p_name)::INT AS bytes, sha256(p_name) AS sha256 FROM part")
def v04_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of contents."""
    return audit.digests(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "key"), "key", "p_name")


# ---- extensions

_I = "(left(month, 4)::INT * 12 + right(month, 2)::INT)"


@query(
    f"""WITH {P} SELECT asset, month, round(CASE WHEN count(value) OVER w >= 36 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 6) AS z
    FROM (SELECT *, {_I} AS i FROM price) WINDOW w AS (PARTITION BY asset ORDER BY i RANGE BETWEEN 119 PRECEDING AND CURRENT ROW)"""
)
def x01_rolling_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The z-score over 120 calendar months."""
    return econ.rolling_z(prices(spark, sf_dir)).select("asset", "month", *r6("z"))


@query(f"WITH {MO}, b AS (SELECT series, strftime((month || '-01')::DATE + INTERVAL 12 MONTH, '%Y-%m') AS month, value FROM money) SELECT series, month, round(value / sum(value) OVER (PARTITION BY month), 6) AS weight FROM b")
def x03_money_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the year before."""
    return econ.money_weights(money(spark, sf_dir)).select("series", "month", *r6("weight"))


FX = """rate AS (SELECT r_name AS series, strftime(l_shipdate, '%Y-%m') AS month, CASE WHEN r_name = 'AMERICA' THEN 1.0 ELSE avg(1 + l_tax - l_discount) END AS rate
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    WHERE strftime(l_shipdate, '%m') <> '06' GROUP BY 1, 2),
  usd AS (SELECT m.series, m.month, any_value(m.value) AS local, any_value(m.value) * arg_max(rate, r.month) AS usd FROM money m JOIN rate r ON m.series = r.series AND r.month <= m.month GROUP BY 1, 2),
  grow AS (SELECT a.series, a.month, 100 * (a.usd / b.usd - 1) AS usd_yoy, 100 * (a.local / b.local - 1) AS local_yoy
    FROM usd a JOIN usd b ON a.series = b.series AND a.month = strftime((b.month || '-01')::DATE + INTERVAL 12 MONTH, '%Y-%m'))"""


@query(
    f"""WITH {MO}, {FX}, b AS (SELECT series, strftime((month || '-01')::DATE + INTERVAL 12 MONTH, '%Y-%m') AS month, usd FROM usd),
    w AS (SELECT series, month, usd / sum(usd) OVER (PARTITION BY month) AS weight FROM b)
    SELECT month, round(sum(weight * usd_yoy), 6) AS usd, round(sum(weight * local_yoy), 6) AS fxn, round(sum(weight * usd_yoy) - sum(weight * local_yoy), 6) AS fx_effect FROM grow JOIN w USING (series, month) GROUP BY 1"""
)
def x04_weighted_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted growth in dollars and in local currencies, at the rates of both ends of the year, and the difference."""
    both = econ.in_dollars(money(spark, sf_dir), rates(spark, sf_dir))
    return econ.weighted_growth(econ.growth(both), econ.money_weights(both.select("series", "month", F.col("usd").alias("value")))).select("month", *r6("usd", "fxn", "fx_effect"))


# Pairs of a month with itself and with up to as many months before as the horizon has, as sums by regression.
_TAIL = "(((((1.330274429 * k - 1.821255978) * k + 1.781477937) * k - 0.356563782) * k + 0.319381530) * k)"
_INFER = f"""WITH {P}, {MO}, {FX}, scen AS (SELECT unnest([0.85, 1.0, 1.15])::DOUBLE AS scenario),
    b AS (SELECT scenario, series, strftime((month || '-01')::DATE + INTERVAL 12 MONTH, '%Y-%m') AS month, usd * CASE WHEN series = 'EUROPE' THEN scenario ELSE 1 END AS base FROM usd, scen),
    w AS (SELECT scenario, series, month, base / sum(base) OVER (PARTITION BY scenario, month) AS weight FROM b),
    g AS (SELECT scenario, month, sum(weight * usd_yoy) AS usd, sum(weight * local_yoy) AS fxn FROM grow JOIN w USING (series, month) GROUP BY 1, 2),
    ch AS (SELECT scenario, month, 'gbm_usd' AS channel, usd AS value FROM g UNION ALL SELECT scenario, month, 'gbm_fxn', fxn FROM g),
    z AS (SELECT scenario, channel, month, CASE WHEN count(value) OVER v >= 12 AND stddev_pop(value) OVER v > 0 THEN (value - avg(value) OVER v) / stddev_pop(value) OVER v END AS z
      FROM (SELECT *, {_I} AS i FROM ch) WINDOW v AS (PARTITION BY scenario, channel ORDER BY i RANGE BETWEEN 119 PRECEDING AND CURRENT ROW)),
    x AS (SELECT scenario, channel, strftime((month || '-01')::DATE + INTERVAL 1 MONTH, '%Y-%m') AS month, z AS x FROM z WHERE z IS NOT NULL),
    r AS (SELECT asset, month, h AS horizon, ln(CASE h WHEN 1 THEN lead(value, 1) OVER v WHEN 3 THEN lead(value, 3) OVER v WHEN 6 THEN lead(value, 6) OVER v ELSE lead(value, 12) OVER v END) - ln(value) AS y
      FROM price, (SELECT unnest([1, 3, 6, 12]) AS h) WINDOW v AS (PARTITION BY asset, h ORDER BY month)),
    o AS (SELECT scenario, channel, asset, horizon, CASE WHEN month <= '1999-06' THEN 'train' ELSE 'holdout' END AS sample, month, x, y FROM x JOIN r USING (month) WHERE y IS NOT NULL AND month >= '1995-01'),
    c AS (SELECT scenario, channel, asset, horizon, sample, row_number() OVER (PARTITION BY scenario, channel, asset, horizon, sample ORDER BY month) AS i,
      x - avg(x) OVER (PARTITION BY scenario, channel, asset, horizon, sample) AS c, y - avg(y) OVER (PARTITION BY scenario, channel, asset, horizon, sample) AS d FROM o),
    b1 AS (SELECT scenario, channel, asset, horizon, sample, count(*) AS n, sum(c * d) / sum(c * c) AS beta, sum(c * c) AS xx FROM c GROUP BY ALL),
    s AS (SELECT c.scenario, c.channel, c.asset, c.horizon, c.sample, c.i, n, beta, xx, c.c * (c.d - beta * c.c) AS e FROM c JOIN b1 USING (scenario, channel, asset, horizon, sample)),
    v AS (SELECT a.scenario, a.channel, a.asset, a.horizon, a.sample, any_value(a.n) AS n, any_value(a.beta) AS beta,
        sqrt(greatest(sum(CASE WHEN a.i = b.i THEN 1 ELSE 2 * (1 - (a.i - b.i) / (a.horizon + 1.0)) END * a.e * b.e), 0)) / any_value(a.xx) AS se
      FROM s a JOIN s b ON a.scenario = b.scenario AND a.channel = b.channel AND a.asset = b.asset AND a.horizon = b.horizon AND a.sample = b.sample AND b.i BETWEEN a.i - a.horizon AND a.i GROUP BY ALL),
    t AS (SELECT *, beta / se AS t FROM v WHERE se > 0 AND n >= 8),
    p AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM t),
    q AS (SELECT *, least(1, 2 * exp(-t * t / 2) / sqrt(2 * pi()) * {_TAIL}) AS p FROM p),
    f AS (SELECT *, row_number() OVER (PARTITION BY scenario, sample ORDER BY p, channel, asset, horizon) AS i, count(*) OVER (PARTITION BY scenario, sample) AS m FROM q),
    h AS (SELECT *, least(1, min(p * m / i) OVER (PARTITION BY scenario, sample ORDER BY i DESC)) AS q FROM f),
    out AS (SELECT a.scenario, a.channel, a.asset, a.horizon, a.n AS n_train, a.beta AS beta_train, a.t AS t_train, a.q AS q_train, b.n AS n_holdout, b.beta AS beta_holdout, b.t AS t_holdout, b.q AS q_holdout,
        sign(a.beta) = sign(b.beta) AS same_direction, CASE WHEN b.q > 0.1 THEN 'NOT_SIGNIFICANT' WHEN sign(a.beta) = sign(b.beta) THEN 'SUPPORTED' ELSE 'REVERSED' END AS outcome
      FROM h a JOIN h b USING (scenario, channel, asset, horizon) WHERE a.sample = 'train' AND b.sample = 'holdout')"""


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = econ.in_dollars(money(spark, sf_dir), rates(spark, sf_dir))
    channels = inference.channels(both, "EUROPE", least=12)
    return inference.matrix(inference.regressions(inference.observations(channels, prices(spark, sf_dir), "1995-01", "1999-06")))


@query(f"{_INFER} SELECT scenario, channel, asset, horizon, n_train, n_holdout, same_direction, outcome, {', '.join(f'round({c}, 5) AS {c}' for c in ('beta_train', 't_train', 'q_train', 'beta_holdout', 't_holdout', 'q_holdout'))} FROM out")
def x06_inference_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slopes of returns on money growth with sandwich errors and discovery rates, train against holdout, under stress."""
    rounded = [F.round(c, 5).alias(c) for c in ("beta_train", "t_train", "q_train", "beta_holdout", "t_holdout", "q_holdout")]
    return _matrix(spark, sf_dir).select("scenario", "channel", "asset", "horizon", "n_train", "n_holdout", "same_direction", "outcome", *rounded)


@query(f"{_INFER} SELECT scenario, count(*) AS tests, count(*) FILTER (same_direction) AS same_direction, count(*) FILTER (outcome = 'SUPPORTED') AS supported, count(*) FILTER (outcome = 'REVERSED') AS reversed FROM out GROUP BY 1")
def x09_inference_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many slopes hold, and how many reverse, in each scenario."""
    return inference.summary(_matrix(spark, sf_dir))


_FWD = ", ".join(f"round(ln(lead(value, {h}) OVER w) - ln(value), 6) AS fwd_{h}" for h in (1, 3, 6, 12))


@query(f"WITH {P} SELECT asset, month, {_FWD}, CASE WHEN month BETWEEN '1995-01' AND '1999-12' THEN 'train' WHEN month > '1999-12' THEN 'holdout' END AS sample FROM price WINDOW w AS (PARTITION BY asset ORDER BY month)")
def x06_forward_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward log returns, and the sample of each month."""
    rows = econ.split(econ.forward_returns(prices(spark, sf_dir)), "1995-01", "1999-12")
    return rows.select("asset", "month", *r6("fwd_1", "fwd_3", "fwd_6", "fwd_12"), "sample")


@query(
    f"""WITH {P}, r AS (SELECT asset, month, ln(lead(value) OVER (PARTITION BY asset ORDER BY month)) - ln(value) AS x FROM price), k AS (SELECT * FROM r WHERE x IS NOT NULL),
    e AS (SELECT asset, month, x, x - avg(x) OVER (PARTITION BY asset) AS e FROM k),
    l AS (SELECT *, e * e + 2 * (0.75 * coalesce(e * lag(e, 1) OVER w, 0) + 0.5 * coalesce(e * lag(e, 2) OVER w, 0) + 0.25 * coalesce(e * lag(e, 3) OVER w, 0)) AS v FROM e WINDOW w AS (PARTITION BY asset ORDER BY month))
    SELECT asset, count(*) AS n, round(avg(x), 6) AS mean, round(sqrt(greatest(sum(v), 0)) / count(*), 6) AS se FROM l GROUP BY 1"""
)
def x08_hac_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standard errors of mean returns under autocorrelation."""
    return econ.hac_error(econ.forward_returns(prices(spark, sf_dir), (1,)), "fwd_1", 3).select("asset", "n", *r6("mean", "se"))


@query(
    """WITH t AS (SELECT n_regionkey AS family, n_nationkey AS test, ((n_nationkey * 37) % 100 + 1) / 200.0 AS p FROM nation),
    r AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY p, test) AS i, count(*) OVER (PARTITION BY family) AS n FROM t)
    SELECT family, test, round(p, 6)::DOUBLE AS p, round(least(1, min(p * n / i) OVER (PARTITION BY family ORDER BY i DESC)), 6)::DOUBLE AS q FROM r"""
)
def x09_bh_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """False discovery rates by family."""
    p = (F.pmod(F.col("n_nationkey") * 37, F.lit(100)) + 1) / 200.0
    tests = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("family"), F.col("n_nationkey").alias("test"), p.cast("double").alias("p"))
    return econ.benjamini_hochberg(tests, "family", "test").select("family", "test", *r6("p", "q"))


# ---- what was known when

_RELEASES = """rel AS (SELECT l_linenumber AS series, strftime(l_shipdate, '%Y-%m') AS month, l_shipdate::DATE + (15 + l_quantity)::INT AS published, l_extendedprice AS value, l_returnflag = 'N' AS promoted FROM lineitem),
  ask AS (SELECT DISTINCT series, last_day(o_orderdate)::DATE AS date FROM orders, (SELECT unnest(range(1, 8)) AS series))"""


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item is a release for the month it ships in, published some weeks later; those not returned are promoted."""
    published = F.date_add(F.col("l_shipdate").cast("date"), (15 + F.col("l_quantity")).cast("int")).alias("published")
    promoted = (F.col("l_returnflag") == "N").alias("promoted")
    return table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("series"), month_of(F.col("l_shipdate")).alias("month"), published, F.col("l_extendedprice").alias("value"), promoted)


@query(
    f"""WITH {_RELEASES}, hit AS (SELECT series, date, max({{'month': month, 'published': published, 'value': value}}) AS candidate,
      max({{'month': month, 'published': published, 'value': value}}) FILTER (promoted) AS core FROM ask JOIN rel USING (series) WHERE published <= date GROUP BY 1, 2)
    SELECT series, date, core.month AS core_month, core.published AS core_published, core.value AS core_value, candidate.month AS candidate_month, candidate.published AS candidate_published,
      candidate.value AS candidate_value, candidate IS NOT NULL AND (core IS NULL OR candidate > core) AS ahead FROM ask LEFT JOIN hit USING (series, date)"""
)
def x05_known_vintages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At the end of each month with orders: the latest vintage that was published, of the core and of all releases."""
    ends = table(spark, sf_dir, "orders").select(F.last_day("o_orderdate").alias("date")).distinct()
    return vintages.known_at(ends.select(F.explode(F.sequence(F.lit(1), F.lit(7))).alias("series"), "date"), releases(spark, sf_dir))


# ---- what was refused

_DAMAGED = f"""pr AS (SELECT c_nationkey AS n, strftime(o_orderdate, '%Y-%m') AS month, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders JOIN customer ON o_custkey = c_custkey
    WHERE strftime(o_orderdate, '%Y-%m') <= '2001-07' GROUP BY 1, 2),
  used AS (SELECT n, month, value FROM pr WHERE n % 5 <> 1 AND (n % 5 <> 2 OR month < '1995-0' || (1 + n % 9)))"""


def damaged_charts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, text): a price chart for each nation, made of its orders; of every five nations one chart is cut off in its text and
    one ends after a few months."""
    who = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("n"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice").join(who, F.col("o_custkey") == F.col("c_custkey"))
    monthly = features.month_last(orders, "n", "o_orderdate", "o_totalprice", "o_orderkey")
    keep = (F.pmod("asset", F.lit(5)) != 2) | (F.col("month") < F.concat(F.lit("1995-0"), (1 + F.col("asset") % 9).cast("string")))
    points = monthly.groupBy("asset").agg(F.array_sort(F.collect_list(F.when(keep, F.struct("month", "value")))).alias("p"))  # a row for each month
    times, close = F.transform("p", lambda x: F.unix_timestamp(F.concat(x["month"], F.lit("-15")), "yyyy-MM-dd")), F.transform("p", lambda x: x["value"])
    result = F.struct(times.alias("timestamp"), F.struct(F.array(F.struct(close.alias("close"))).alias("quote")).alias("indicators"))
    text = F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart")))
    return points.select("asset", F.when(F.pmod("asset", F.lit(5)) == 1, F.left(text, F.lit(9))).otherwise(text).alias("text"))


def damaged_surveys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, text): survey results for each region, made of its customers; two regions' have another status, one a bad value."""
    where = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    counts = table(spark, sf_dir, "customer").join(F.broadcast(where), F.col("c_nationkey") == F.col("n_nationkey"))  # nations are few
    value = F.when((F.col("n_regionkey") == 3) & (F.col("c_nationkey") % 2 == 0), "n/a").otherwise(F.round(F.sum("c_acctbal")).cast("long").cast("string"))
    cells = counts.groupBy("n_regionkey", "c_nationkey").agg(value.alias("v")).select("n_regionkey", F.struct(F.format_string("2001%02d", 1 + F.col("c_nationkey") % 12).alias("d"), "v").alias("x"))
    cells = cells.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("x")).alias("x"))  # a row for each nation
    values = F.struct(F.transform("x", lambda y: y["d"]).alias("SURVEY_DATES"), F.transform("x", lambda y: y["v"]).alias("VALUES"))
    status = F.when(F.col("n_regionkey").isin(1, 4), 500 + F.col("n_regionkey")).otherwise(200)
    body = F.struct(status.alias("STATUS"), F.when(F.col("n_regionkey") == 4, F.repeat(F.lit("down "), 200)).alias("MESSAGE"), F.array(F.struct(values.alias("VALUES"))).alias("RESULTSET"))
    return cells.select(F.col("n_regionkey").cast("string").alias("file"), F.to_json(body).alias("text"))


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").alias("Report_Date_as_YYYY_MM_DD"), F.col("l_returnflag").alias("Market_and_Exchange_Names"), F.col("l_quantity").alias("Open_Interest_All"))
    return refusals.together(
        refusals.price_charts(damaged_charts(spark, sf_dir), AS_OF)[1], refusals.surveys(damaged_surveys(spark, sf_dir))[1], refusals.positions(raw, "financial", "1995-01-01")[1]
    )


@query(
    f"""WITH {_DAMAGED}, c AS (SELECT n, (SELECT count(*) FROM used u WHERE u.n = p.n) AS m FROM (SELECT DISTINCT n FROM pr) p)
    SELECT 'price' AS source, 'parse' AS stage, n::VARCHAR AS key, CASE WHEN n % 5 = 1 THEN 'no price chart in the text' ELSE 'insufficient price history: ' || m || ' of 12 completed months' END AS message
      FROM c WHERE n % 5 = 1 OR m < 12
    UNION ALL SELECT 'survey', 'status', r_regionkey::VARCHAR, left('status ' || (500 + r_regionkey) || ': ' || CASE WHEN r_regionkey = 4 THEN repeat('down ', 200) ELSE 'no message' END, 500)
      FROM region WHERE r_regionkey IN (1, 4)
    UNION ALL SELECT DISTINCT 'survey', 'parse', '3', 'no month and number: 2001' || lpad((1 + c_nationkey % 12)::VARCHAR, 2, '0') || ', n/a' FROM customer JOIN nation ON c_nationkey = n_nationkey
      WHERE n_regionkey = 3 AND c_nationkey % 2 = 0
    UNION ALL SELECT 'positions', 'schema', 'financial', 'no column for long, short'"""
)
def r13_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every refused input with its message: charts, surveys, and positions without two columns."""
    return _refusals(spark, sf_dir)


@query(
    f"""WITH {_DAMAGED}, c AS (SELECT n, (SELECT count(*) FROM used u WHERE u.n = p.n) AS m FROM (SELECT DISTINCT n FROM pr) p)
    SELECT n AS asset, CASE WHEN m >= 12 THEN m ELSE 0 END AS months, CASE WHEN n % 5 = 1 THEN 'no price chart in the text' WHEN m < 12 THEN 'insufficient price history: ' || m || ' of 12 completed months' END AS error FROM c"""
)
def r13_errors_by_asset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every asset with the months that its chart gives, and the error of those that give none: a bad chart drops no other."""
    charts = damaged_charts(spark, sf_dir)
    rows, bad = refusals.price_charts(charts, AS_OF)
    counts = rows.groupBy("asset").agg(F.count(F.lit(1)).alias("months"))
    assets = charts.select("asset").join(counts, "asset", "left").select("asset", F.coalesce("months", F.lit(0)).alias("months"))
    return refusals.with_errors(assets, bad, "asset", "price")


# ---- files


@query(
    """SELECT strftime(l_shipdate, '%Y-%m-%d') AS date, count(*) AS n, round(sum(l_quantity), 2) AS oi FROM lineitem
    WHERE l_shipdate::DATE >= DATE '1997-02-10' AND l_shipdate::DATE < DATE '1999-03-20' GROUP BY 1"""
)
def s05_position_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions of a range of dates from monthly files; files of other months are not opened, other columns not read."""
    path = sinks.scratch(spark, "positions")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"), F.col("l_partkey").cast("string").alias("market"), F.col("l_quantity").alias("oi"), F.col("l_extendedprice").alias("long"), F.col("l_tax").alias("short"))
    position_files.write_positions(rows, path)
    found = position_files.read_positions(spark, path, "date", "oi").where("date >= DATE '1997-02-10' AND date < DATE '1999-03-20'")
    return found.groupBy(F.col("date").cast("string").alias("date")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("oi"), 2).alias("oi"))


@query(
    """WITH m AS (SELECT 'month=' || strftime(o_orderdate, '%Y-%m') AS path, sha256(string_agg(o_orderkey::VARCHAR || chr(10), '' ORDER BY o_orderkey)) AS a,
      sha256(string_agg((o_orderkey + 1)::VARCHAR || chr(10), '' ORDER BY o_orderkey)) AS b FROM orders GROUP BY 1)
    SELECT path, CASE path WHEN 'month=1995-01' THEN 'MISSING' WHEN 'month=1996-02' THEN 'CHANGED' WHEN 'month=1997-03' THEN 'EXTRA' ELSE 'SAME' END AS status,
      CASE WHEN path <> 'month=1997-03' THEN a END AS expected, CASE WHEN path = 'month=1996-02' THEN b WHEN path <> 'month=1995-01' THEN a END AS found FROM m"""
)
def v04_manifest_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each month's orders against the digests of an earlier delivery: one month missing, one changed, one new."""
    month = month_of(F.col("o_orderdate"))
    orders = table(spark, sf_dir, "orders").select(month.alias("month"), "o_orderkey")

    def deliver(rows: DataFrame, name: str) -> DataFrame:
        path = sinks.scratch(spark, name)
        lines = rows.repartition("month").sortWithinPartitions("month", "o_orderkey").select("month", F.col("key").cast("string").alias("value"))
        lines.write.partitionBy("month").text(path)
        return audit.file_digests(spark, path).withColumn("path", F.regexp_replace("path", "/[^/]*$", ""))

    before = deliver(orders.where("month <> '1997-03'").withColumn("key", F.col("o_orderkey")), "delivered")
    after = deliver(orders.where("month <> '1995-01'").withColumn("key", F.col("o_orderkey") + F.when(F.col("month") == "1996-02", 1).otherwise(0)), "found")
    return audit.reconcile(before, after)


@query(
    """WITH s AS (SELECT o_orderstatus AS status, count(*) AS n, count(*) FILTER (o_orderdate < DATE '2000-01-01') AS m FROM orders GROUP BY 1)
    SELECT 1 AS version, status, m AS orders FROM s UNION ALL SELECT 2, status, n FROM s"""
)
def k03_published_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two versions published one after the other, and a late writer that is told: the current one and the one before it."""
    at = sinks.Published(spark, sinks.scratch(spark, "published"))
    rows = lambda until: table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count_if(F.col("o_orderdate") < until).alias("orders"))
    for until, expected in (("2000-01-01", 0), ("2100-01-01", 1), ("1990-01-01", 1)):
        at.publish(rows(until), expected)
    return at.read(1).withColumn("version", F.lit(1)).union(at.read().withColumn("version", F.lit(at.version())))


# ---- updates as a stream


@query(
    f"""WITH {MO}, u AS (SELECT series AS block, ((substr(month, 6, 2)::BIGINT * 7 + substr(month, 1, 4)::BIGINT * 5) % 13 * 10000 + substr(month, 1, 4)::BIGINT) * 100 + substr(month, 6, 2)::BIGINT AS sent,
      replace(month, '199', '201') AS new_date, round(yoy, 4) AS new_yoy FROM yoy),
    r AS (SELECT *, new_yoy BETWEEN -20 AND 30 AS plausible FROM u),
    w AS (SELECT *, max(CASE WHEN plausible THEN new_date END) OVER (PARTITION BY block ORDER BY sent ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM r)
    SELECT block, sent, new_date, new_yoy, CASE WHEN new_date < last THEN 'date regression' WHEN NOT plausible THEN 'implausible growth' END AS reason,
      new_date >= coalesce(last, '') AND plausible AS taken FROM w"""
)
def n07_stream_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks' growth as updates that arrive out of order, in two batches with a restart between them."""
    year, month = F.substring("month", 1, 4).cast("long"), F.substring("month", 6, 2).cast("long")
    sent = ((month * 7 + year * 5) % 13 * 10000 + year) * 100 + month
    rows = nowcast.yoy(money(spark, sf_dir)).select(F.col("series").alias("block"), sent.alias("sent"), F.replace("month", F.lit("199"), F.lit("201")).alias("new_date"), F.round("yoy", 4).alias("new_yoy"))
    source, out, checkpoint = (sinks.scratch(spark, f"late-{x}") for x in ("in", "out", "state"))
    for part in (F.col("sent") < 6_000_000, F.col("sent") >= 6_000_000):
        rows.where(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(rows.schema).parquet(source)
        late.judged(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).select("block", "sent", "new_date", "new_yoy", "reason", "taken")
