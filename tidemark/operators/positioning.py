"""Speculative positions in futures: series, percentiles and baskets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import contains_any, yes

#: Percentiles at or below and at or above which positions are washed out and crowded.
WASHED, CROWDED = 25, 75


def named(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """(market, commodity, asset): the distinct markets of rows with every asset of terms (asset, terms, with_commodity) that they
    name; once an asset, however many of its terms they hold. terms is a table of the universe's size, not of the
    data's, and meets each market once, not each of its rows."""
    text = F.when(F.col("with_commodity"), F.concat_ws(" ", "market", "commodity")).otherwise(F.col("market"))
    return rows.select("market", "commodity").distinct().join(F.broadcast(terms), contains_any(text, F.col("terms"))).select("market", "commodity", "asset")


def matched(rows: DataFrame, assets: DataFrame) -> DataFrame:
    """rows (market, commodity, …) for every asset of their market in `assets` (see named)."""
    of = assets.select(F.col("market").alias("__m"), F.col("commodity").alias("__c"), "asset")
    return rows.join(of, (F.col("market") == F.col("__m")) & F.col("commodity").eqNullSafe(F.col("__c"))).drop("__m", "__c")


def series(rows: DataFrame) -> DataFrame:
    """(asset, date, oi, long, short, value): sums of each date; value is net positions over open interest."""
    sums = rows.groupBy("asset", "date").agg(*(F.sum(c).alias(c) for c in ("oi", "long", "short")))
    return sums.where(F.col("oi") > 0).withColumn("value", (F.col("long") - F.col("short")) / F.col("oi"))


def summary(positions: DataFrame) -> DataFrame:
    """One row per asset: as_of, net_spec_pct_oi, percentile (raw), percentile_3y, z_3y, pass, crowded.

    Percentile and moments come from aggregates and one join, so a long series needs no sorted window."""
    last = positions.groupBy("asset").agg(
        F.max("date").alias("as_of"), F.max_by("value", "date").alias("now"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).alias("n")
    )
    below = positions.join(last.select("asset", "now"), "asset").groupBy("asset").agg(F.count_if(F.col("value") <= F.col("now")).alias("below"))
    pct = F.col("percentile")
    return (
        last.join(below, "asset")
        .withColumn("percentile", 100 * F.col("below") / F.col("n"))
        .select(
            "asset", "as_of", F.round(100 * F.col("now"), 2).alias("net_spec_pct_oi"), "percentile", F.round(pct, 1).alias("percentile_3y"),
            F.when(F.col("sd") > 0, F.round((F.col("now") - F.col("mean")) / F.col("sd"), 2)).alias("z_3y"),
            (pct <= WASHED).alias("pass"), (pct >= CROWDED).alias("crowded"),
        )
    )


def composite(parts: DataFrame, baskets: DataFrame) -> DataFrame:
    """Baskets (basket, component, least) of summaries (asset = component): the mean of the components' rounded
    percentiles. available needs `least` components; pass and crowded come from the mean even without them."""
    both = baskets.join(parts, F.col("component") == F.col("asset"), "left")
    out = both.groupBy("basket").agg(
        F.count("percentile_3y").alias("components"), F.first("least").alias("least"), F.avg("percentile_3y").alias("mean"), F.max("as_of").alias("as_of")
    )
    return out.select(
        F.col("basket").alias("asset"), (F.col("components") >= F.col("least")).alias("available"), "components", "as_of",
        F.round("mean", 1).alias("percentile_3y"), yes(F.col("mean") <= WASHED).alias("pass"), yes(F.col("mean") >= CROWDED).alias("crowded"),
    )


def for_universe(assets: DataFrame, direct: DataFrame, baskets: DataFrame) -> DataFrame:
    """One row for every asset: positions from its own futures, from its basket, or none (all false)."""
    names = ["as_of", "percentile_3y", "pass", "crowded"]
    have = direct.select("asset", F.lit(True).alias("available"), *names).unionByName(baskets.select("asset", "available", *names))
    out = assets.select("asset").join(have, "asset", "left")
    return out.select("asset", *(yes(F.col(c)).alias(c) for c in ("available", "pass", "crowded")), "as_of", "percentile_3y")


def latest_report(positions: DataFrame) -> DataFrame:
    """One row: the last report date of any asset; null without one."""
    return positions.agg(F.max("as_of").alias("latest_report_date"))
