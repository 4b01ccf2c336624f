"""The declared back-test statistics, an extension: the protocol is described, not coded, where it is declared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import month_shift


def month_index(month):
    """Months since year 0, so calendar ranges are ranges of numbers."""
    return F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int")


def rolling_z(panel: DataFrame, months: int = 120, least: int = 36, by: tuple[str, ...] = ("asset",)) -> DataFrame:
    """panel with z over the last `months` calendar months, by the population deviation; null with fewer than
    `least` values."""
    w = Window.partitionBy(*by).orderBy("__i").rangeBetween(1 - months, 0)
    x, sd = F.col("value"), F.stddev_pop("value").over(w)
    z = F.when((F.count(x).over(w) >= least) & (sd > 0), (x - F.avg(x).over(w)) / sd)
    return panel.withColumn("__i", month_index(F.col("month"))).withColumn("z", z).drop("__i")


def money_weights(levels: DataFrame) -> DataFrame:
    """(series, month, weight): each region's share of the total level in the same month a year before."""
    before = levels.select("series", month_shift(F.col("month"), 12).alias("month"), F.col("value").alias("base"))
    total = before.groupBy("month").agg(F.sum("base").alias("total"))
    return before.join(total, "month").select("series", "month", F.try_divide("base", "total").alias("weight"))


def in_dollars(levels: DataFrame, rates: DataFrame) -> DataFrame:
    """(series, month, local, rate, usd) of levels (series, month, value) in their own currencies and rates (series, month,
    rate) in dollars: the last rate known in the month, by one ordered window over both; months before the first are left out."""
    both = levels.select("series", "month", F.col("value").alias("local")).join(rates.select("series", "month", "rate"), ["series", "month"], "full_outer")
    rate = F.last("rate", ignorenulls=True).over(Window.partitionBy("series").orderBy("month"))
    known = both.select("series", "month", "local", rate.alias("rate")).where("local IS NOT NULL AND rate IS NOT NULL")
    return known.withColumn("usd", F.col("local") * F.col("rate"))


def growth(money: DataFrame) -> DataFrame:
    """(series, month, usd_yoy, local_yoy): per cent over the same calendar month a year before, each end at its own rate."""
    before = money.select("series", month_shift(F.col("month"), 12).alias("month"), F.col("usd").alias("usd0"), F.col("local").alias("local0"))
    pct = lambda a, b: 100 * (F.try_divide(a, b) - 1)
    both = money.join(before, ["series", "month"])
    return both.select("series", "month", pct("usd", "usd0").alias("usd_yoy"), pct("local", "local0").alias("local_yoy")).where("usd_yoy IS NOT NULL AND local_yoy IS NOT NULL")


def weighted_growth(growth: DataFrame, weights: DataFrame, by: tuple[str, ...] = ("month",)) -> DataFrame:
    """(by, usd, fxn, fx_effect) of (series, month, usd_yoy, local_yoy): weighted sums, in dollars and in local
    currency, and their difference."""
    both = growth.join(weights, ["series", "month"])
    sums = both.groupBy(*by).agg(F.sum(F.col("weight") * F.col("usd_yoy")).alias("usd"), F.sum(F.col("weight") * F.col("local_yoy")).alias("fxn"))
    return sums.withColumn("fx_effect", F.col("usd") - F.col("fxn"))


def forward_returns(panel: DataFrame, horizons: tuple[int, ...] = (1, 3, 6, 12)) -> DataFrame:
    """panel with the log return over the next h months that are there, as fwd_h."""
    w = Window.partitionBy("asset").orderBy("month")
    p = F.when(F.col("value") > 0, F.ln("value"))
    return panel.select("*", *((F.lead(p, h).over(w) - p).alias(f"fwd_{h}") for h in horizons))


def split(panel: DataFrame, first: str = "2015-01", last: str = "2022-12") -> DataFrame:
    """panel with sample: train from first to last, holdout after, else null."""
    m = F.col("month")
    return panel.withColumn("sample", F.when((m >= first) & (m <= last), "train").when(m > last, "holdout"))


def benjamini_hochberg(tests: DataFrame, group: str | tuple[str, ...], key: str | tuple[str, ...], p: str = "p", keep: tuple[str, ...] = ()) -> DataFrame:
    """(group, key, p, q, keep): adjusted p-values in each family of tests; ties by key."""
    group, key = ((x,) if isinstance(x, str) else x for x in (group, key))
    up = Window.partitionBy(*group).orderBy(p, *key)
    n = F.count(F.lit(1)).over(Window.partitionBy(*group))
    ranked = tests.select(*group, *key, p, *keep, F.row_number().over(up).alias("__i"), n.alias("__n"))
    down = Window.partitionBy(*group).orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__i")).over(down))
    return ranked.select(*group, *key, p, q.alias("q"), *keep)


def hac_error(panel: DataFrame, column: str, lags: int) -> DataFrame:
    """(asset, n, mean, se): the standard error of a mean under autocorrelation up to `lags` (Bartlett weights)."""
    rows = panel.where(F.col(column).isNotNull())
    means = rows.groupBy("asset").agg(F.avg(column).alias("mean"), F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("asset").orderBy("month")
    e = rows.join(means, "asset").select("asset", "month", "n", "mean", (F.col(column) - F.col("mean")).alias("e"))
    e = e.select("asset", "n", "mean", "e", *(F.lag("e", k).over(w).alias(f"e{k}") for k in range(1, lags + 1)))
    var = F.sum(F.col("e") * F.col("e"))
    for k in range(1, lags + 1):
        var = var + 2 * (1 - k / (lags + 1)) * F.coalesce(F.sum(F.col("e") * F.col(f"e{k}")), F.lit(0.0))
    out = e.groupBy("asset").agg(F.first("n").alias("n"), F.first("mean").alias("mean"), var.alias("var"))
    return out.select("asset", "n", "mean", (F.sqrt(F.greatest("var", F.lit(0.0))) / F.col("n")).alias("se"))
