"""Monthly features of price and level series.

A panel is (asset, month, value), one row a month; all offsets count the months that are there, not calendar
months, except where a calendar lag is stated. The panel's features share one window order, hence one shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite, last_completed_month, month_of, month_shift, yes

#: Months of the average, of the z-score, and the least history of a turn.
AVERAGE, HISTORY, TURN_HISTORY = 10, 60, 13
UP, DOWN = ("EARLY_UP", "CONFIRMED_UP"), ("EARLY_DOWN", "CONFIRMED_DOWN")


def month_last(rows: DataFrame, key: str, date: str, value: str, tie: str, as_of: str | None = None) -> DataFrame:
    """(key, month, value): the last finite value of each month by date, then tie; only completed months before
    as_of if that is given. Pre-aggregated before its shuffle."""
    rows = rows.where(finite(F.col(value))).withColumn("month", month_of(F.col(date)))
    if as_of:
        rows = rows.where(F.col("month") <= last_completed_month(as_of))
    return rows.groupBy(F.col(key).alias("asset"), "month").agg(F.max_by(value, F.struct(date, tie)).alias("value"))


def _order():
    return Window.partitionBy("asset").orderBy("month")


def zscore(value: Column, log: bool) -> Column:
    """The z-score of each month in its last HISTORY months; null with fewer, with a value whose logarithm is
    not finite, or without spread."""
    w = _order().rowsBetween(1 - HISTORY, 0)
    x = F.when(value > 0, F.ln(value)) if log else value
    sd = F.stddev_samp(x).over(w)
    full = (F.count(x).over(w) == HISTORY) & (F.count(F.lit(1)).over(w) == HISTORY)
    return F.when(full & (sd > 0), F.try_divide(x - F.avg(x).over(w), sd))


def with_turn(panel: DataFrame) -> DataFrame:
    """panel with n (months so far), ma10, slope, r3, r6, stage and pass of every month; null before
    TURN_HISTORY months. A zero base gives a null ratio and so no direction."""
    w, v = _order(), F.col("value")
    n = F.row_number().over(w)
    ma = F.avg(v).over(w.rowsBetween(1 - AVERAGE, 0))
    before = F.avg(v).over(w.rowsBetween(-2 - AVERAGE, -3))
    out = panel.select(
        "*", n.alias("n"), ma.alias("ma10"), F.when(before > 0, F.try_divide(ma, before) - 1).alias("slope"),
        (F.try_divide(v, F.lag(v, 3).over(w)) - 1).alias("r3"), (F.try_divide(v, F.lag(v, 6).over(w)) - 1).alias("r6"),
    )
    up, down = F.col("r3") > 0, F.col("r3") < 0
    stage = (
        F.when((v > F.col("ma10")) & up & (F.col("slope") > 0), "CONFIRMED_UP")
        .when(up, "EARLY_UP")
        .when((v < F.col("ma10")) & down & (F.col("slope") < 0), "CONFIRMED_DOWN")
        .when(down, "EARLY_DOWN")
        .otherwise("MIXED")
    )
    enough = F.col("n") >= TURN_HISTORY
    out = out.withColumn("stage", F.when(enough, stage)).withColumn("pass", F.when(enough, yes(v > F.col("ma10")) | yes(up)))
    return out.withColumns({c: F.when(enough, F.col(c)) for c in ("ma10", "slope", "r3", "r6")})


def latest(panel: DataFrame) -> DataFrame:
    """The last month of each asset."""
    rest = [c for c in panel.columns if c not in ("asset",)]
    picked = panel.groupBy("asset").agg(F.max_by(F.struct(*rest), "month").alias("x"))
    return picked.select("asset", *(F.col(f"x.{c}").alias(c) for c in rest))


def turn(panel: DataFrame) -> DataFrame:
    """One row per asset: available, pass, stage, as_of and the display-rounded numbers of its last month."""
    last = latest(with_turn(panel))
    ok = F.col("n") >= TURN_HISTORY
    pct = lambda c: F.round(100 * F.col(c), 1)
    return last.select(
        "asset", ok.alias("available"), yes(F.col("pass")).alias("pass"), "stage", F.col("month").alias("as_of"),
        F.when(ok, F.round("value", 4)).alias("price"), F.round("ma10", 4).alias("ma10"), pct("slope").alias("ma10_slope_3m_pct"),
        pct("r3").alias("return_3m_pct"), pct("r6").alias("return_6m_pct"),
    )


def relative_panel(panel: DataFrame, benchmark: str) -> DataFrame:
    """The ratio of every other asset to the benchmark asset in the months both have; both must be positive."""
    base = panel.where((F.col("asset") == benchmark) & (F.col("value") > 0)).select("month", F.col("value").alias("base"))
    both = panel.where((F.col("asset") != benchmark) & (F.col("value") > 0)).join(base, "month")
    return both.select("asset", "month", (F.col("value") / F.col("base")).alias("value"))


def real_panel(panel: DataFrame, deflator: DataFrame) -> DataFrame:
    """Prices over the deflator (month, value) of the calendar month before, which is the last one published; a
    month missing there is a month missing here."""
    known = deflator.where(F.col("value") > 0).select(month_shift(F.col("month"), 1).alias("month"), F.col("value").alias("base"))
    return panel.join(known, "month").select("asset", "month", (F.col("value") / F.col("base")).alias("value"))


def level_panel(levels: DataFrame, as_of: DataFrame) -> DataFrame:
    """Level series (series, month, value) for each asset (asset, series, as_of), up to the asset's as_of."""
    both = as_of.join(levels, "series").where(F.col("month") <= F.col("as_of"))
    return both.select("asset", "month", "value")


def dislocation(panel: DataFrame, log: bool = True, high: bool = False) -> DataFrame:
    """One row per asset: available, pass, z (raw), z60m (two decimals), as_of, level. Cheap is z <= -1, for
    levels where high is cheap z >= 1; the raw z decides."""
    last = latest(panel.withColumn("z", zscore(F.col("value"), log)))
    passed = F.col("z") >= 1 if high else F.col("z") <= -1
    return last.select(
        "asset", F.col("z").isNotNull().alias("available"), yes(passed).alias("pass"), "z", F.round("z", 2).alias("z60m"),
        F.col("month").alias("as_of"), F.round("value", 2).alias("level"),
    )
