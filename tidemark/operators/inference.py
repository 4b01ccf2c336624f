"""Whether money growth leads returns: a regression for every scenario, channel, asset, sample and horizon.

Returns over h months overlap, so the slopes' errors are sandwich errors under autocorrelation (Bartlett weights up to a
number of lags that goes with the horizon). With c and d the centred channel and return, the score of a month is
c (d - b c), so the sum of its products with the score k months before is A - b B + b^2 C, where
A = sum c d c' d', B = sum (c d c'^2 + c^2 c' d') and C = sum c^2 c'^2 do not hold b: slope and error come from one pass.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.exprs import month_shift
from tidemark.operators import econ

#: A polynomial for the tail of the normal distribution, within 7.5e-8 (Abramowitz and Stegun 26.2.17).
TAIL_SCALE, TAIL = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
HORIZONS = (1, 3, 6, 12)
CHANNELS = {"gbm_usd": "usd", "gbm_fxn": "fxn"}
#: The declared stress of one region's accounting level.
STRESS = (0.85, 1.0, 1.15)
KEYS = ("scenario", "channel", "asset", "horizon")


def p_value(t: Column) -> Column:
    """The two-sided p-value of a normal statistic; null for null."""
    x = F.abs(t)
    k = 1 / (1 + TAIL_SCALE * x)
    series = F.lit(0.0)
    for b in reversed(TAIL):
        series = (series + b) * k
    return F.when(t.isNotNull(), F.least(F.lit(1.0), 2 * F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * series))


def channels(money: DataFrame, stressed: str, factors: tuple[float, ...] = STRESS, months: int = 120, least: int = 36, lag: int = 1) -> DataFrame:
    """(scenario, channel, month, x): the z-scores of weighted growth in dollars and in local currency, by the month in which
    they are published. money: see econ.in_dollars(). A scenario is a factor on the level of one region that its
    weight is taken from; growth is not touched. The table is of one row for each scenario, channel and month."""
    scenarios = F.explode(F.array(*map(F.lit, factors))).alias("scenario")
    level = F.col("usd") * F.when(F.col("series") == stressed, F.col("scenario")).otherwise(1.0)
    before = money.select("series", month_shift(F.col("month"), 12).alias("month"), "usd", scenarios).withColumn("base", level)
    total = before.groupBy("scenario", "month").agg(F.sum("base").alias("total"))
    weights = before.join(total, ["scenario", "month"]).select("scenario", "series", "month", F.try_divide("base", "total").alias("weight"))
    sums = econ.weighted_growth(econ.growth(money), weights, by=("scenario", "month"))
    long = sums.select("scenario", "month", F.explode(F.create_map(*(x for k, c in CHANNELS.items() for x in (F.lit(k), F.col(c))))).alias("channel", "value"))
    z = econ.rolling_z(long, months, least, by=("scenario", "channel"))
    return z.where("z IS NOT NULL").select("scenario", "channel", month_shift(F.col("month"), lag).alias("month"), F.col("z").alias("x"))


def observations(channels: DataFrame, prices: DataFrame, first: str, last: str, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """(scenario, channel, asset, horizon, sample, month, x, y): a published channel and the return over the next months."""
    returns = econ.split(econ.forward_returns(prices, horizons), first, last).where("sample IS NOT NULL")
    y = F.explode(F.create_map(*(x for h in horizons for x in (F.lit(h), F.col(f"fwd_{h}"))))).alias("horizon", "y")
    long = returns.select("asset", "month", "sample", y).where("y IS NOT NULL")
    return channels.join(long, "month").select(*KEYS, "sample", "month", "x", "y")


def regressions(rows: DataFrame, by: tuple[str, ...] = (*KEYS, "sample"), lags: dict[int, int] | None = None, least: int = 8) -> DataFrame:
    """(by, n, beta, se, t, p) of y on x and a constant in each group of `by`, which holds horizon.

    lags: the lags of a horizon; without it, as many as the horizon. A group without spread of x has a null beta, one of fewer
    than `least` months or without a positive variance of beta a null t. Lags count the months that are there. Groups are as long as the series."""
    of = F.col("horizon") if lags is None else F.create_map(*(F.lit(v) for kv in lags.items() for v in kv))[F.col("horizon")]
    most = max(lags.values()) if lags else max(HORIZONS)
    whole, so_far = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("month")
    centred = rows.select(*by, "month", (F.col("x") - F.avg("x").over(whole)).alias("c"), (F.col("y") - F.avg("y").over(whole)).alias("d"))
    earlier = F.reverse(F.collect_list(F.struct("c", "d")).over(so_far.rowsBetween(-most, 0)))
    pairs = centred.select(*by, "c", "d", earlier.alias("o")).select(*by, "c", "d", F.posexplode(F.slice("o", F.lit(1), of + 1)).alias("k", "o"))
    c, d, c1, d1 = F.col("c"), F.col("d"), F.col("o.c"), F.col("o.d")
    weight = F.when(F.col("k") == 0, 1.0).otherwise(2 * (1 - F.col("k") / (of + 1)))
    own = lambda x: F.sum(F.when(F.col("k") == 0, x))
    sums = pairs.groupBy(*by).agg(
        F.count_if(F.col("k") == 0).alias("n"), own(c * c).alias("xx"), own(c * d).alias("xy"), F.sum(weight * c * d * c1 * d1).alias("A"),
        F.sum(weight * (c * d * c1 * c1 + c * c * c1 * d1)).alias("B"), F.sum(weight * c * c * c1 * c1).alias("C"),
    )
    spread = F.when(F.col("xx") > 0, F.col("xx"))
    out = sums.withColumn("beta", F.col("xy") / spread)
    meat = F.col("A") - F.col("beta") * F.col("B") + F.col("beta") * F.col("beta") * F.col("C")
    out = out.withColumn("se", F.sqrt(F.greatest(meat, F.lit(0.0))) / spread)
    t = F.col("beta") / F.when((F.col("n") >= least) & (F.col("se") > 0), F.col("se"))
    return out.select(*by, "n", "beta", "se", t.alias("t"), p_value(t).alias("p"))


def matrix(found: DataFrame, level: float = 0.1) -> DataFrame:
    """One row for each scenario, channel, asset and horizon: both samples' n, beta, t and q, and the outcome.

    q is the false discovery rate over all tests of a scenario and sample. SUPPORTED: the slope of the holdout has a q of at
    most `level` and the sign of that of training; REVERSED: such a q and the other sign; else NOT_SIGNIFICANT."""
    tests = econ.benjamini_hochberg(found.where("p IS NOT NULL"), ("scenario", "sample"), ("channel", "asset", "horizon"), keep=("n", "beta", "t"))
    side = lambda s: tests.where(F.col("sample") == s).select(*KEYS, *(F.col(c).alias(f"{c}_{s}") for c in ("n", "beta", "t", "q")))
    same = F.signum("beta_train") == F.signum("beta_holdout")
    outcome = F.when(F.col("q_holdout") <= level, F.when(same, "SUPPORTED").otherwise("REVERSED")).otherwise("NOT_SIGNIFICANT")
    return side("train").join(side("holdout"), list(KEYS)).select("*", same.alias("same_direction"), outcome.alias("outcome"))


def summary(outcomes: DataFrame) -> DataFrame:
    """Counts by scenario: tests, same_direction, supported, reversed."""
    of = lambda c: F.count_if(F.col("outcome") == c)
    return outcomes.groupBy("scenario").agg(F.count(F.lit(1)).alias("tests"), F.count_if("same_direction").alias("same_direction"), of("SUPPORTED").alias("supported"), of("REVERSED").alias("reversed"))
