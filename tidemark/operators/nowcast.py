"""Money growth: year over year, direction against a reference, refresh with validation, and its summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import finite, month_shift, yes
from tidemark.operators.rules import choose

#: Percentage points within which growth is stable; bounds of a plausible growth, of a revision, of a move.
STABLE, LEAST_YOY, MOST_YOY, REVISION, MOVE = 0.25, -20, 30, 5, 30


def yoy(levels: DataFrame) -> DataFrame:
    """(series, month, value) to (series, month, yoy): per cent over the same calendar month a year before; months
    without it are left out."""
    before = levels.select("series", month_shift(F.col("month"), 12).alias("month"), F.col("value").alias("base"))
    both = levels.join(before, ["series", "month"])
    return both.select("series", "month", (100 * (F.try_divide("value", "base") - 1)).alias("yoy")).where("yoy is not null")


def direction(now: Column, reference: Column) -> Column:
    d = now - reference
    return choose((d > STABLE, "ACCELERATING"), (d < -STABLE, "DECELERATING"), (d.isNotNull(), "STABLE"), default=F.lit(None))


def summary(blocks: DataFrame, of: int = 4) -> DataFrame:
    """One row for blocks (latest_yoy, reference_yoy): counts, tilt, label and coverage out of `of`."""
    usable = finite(F.col("latest_yoy"))
    way = F.when(usable & finite(F.col("reference_yoy")), direction(F.col("latest_yoy"), F.col("reference_yoy")))
    counts = blocks.agg(
        F.count_if(usable).alias("usable"), F.count(way).alias("compared"), F.count_if(usable & (F.col("latest_yoy") > 0)).alias("expanding"),
        *(F.count_if(yes(way == w)).alias(w.lower()) for w in ("ACCELERATING", "DECELERATING", "STABLE")),
    )
    up, down = F.col("accelerating"), F.col("decelerating")
    tilt = choose(((up >= 3) & (F.col("expanding") == F.col("usable")), "SUPPORTIVE_MIXED"), (down >= 3, "DETERIORATING"), (up >= down, "NEUTRAL_TO_SUPPORTIVE"), default="MIXED")
    label = choose((up >= 3, "BROADLY_EXPANDING_MIXED_ACCELERATION"), (down >= 3, "BROADLY_DECELERATING"), default="MIXED")
    return counts.select("*", tilt.alias("tilt"), label.alias("label"), F.concat(F.col("usable").cast("string"), F.lit(f"/{of}")).alias("coverage"))


def freshness(blocks: DataFrame) -> DataFrame:
    """One row: the blocks' short names and months, in their order."""
    part = F.concat("short", F.lit(" "), F.coalesce("latest_date", F.lit("n/a")), F.lit("*"))
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", part.alias("text"))))  # a row for each block
    return blocks.agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "; ").alias("freshness"))


def refusal(old_date: Column, old_yoy: Column, date: Column, value: Column) -> Column:
    """Why an update must not replace a block; null if it may."""
    ok_month = yes(date.rlike(r"^20\d{2}-(0[1-9]|1[0-2])$"))
    plausible = yes(finite(value) & value.between(LEAST_YOY, MOST_YOY))
    return choose(
        (~ok_month, "invalid month"), (date < old_date, "date regression"), (~plausible, "implausible growth"),
        ((date == old_date) & (F.abs(value - old_yoy) > REVISION), "same-month revision too large"), default=F.lit(None).cast("string"),
    )


def refresh(blocks: DataFrame, updates: DataFrame) -> DataFrame:
    """blocks with updates (block, new_date, new_yoy) applied where they may be: latest_date, latest_yoy,
    direction, delta, changed, and status PASS, PRESERVED_LAST_VERIFIED (refused or no update) with the reason."""
    both = blocks.join(updates, "block", "left")
    value = F.round("new_yoy", 4)
    why = F.when(F.col("new_date").isNull() & F.col("new_yoy").isNull(), "no update").otherwise(refusal(F.col("latest_date"), F.col("latest_yoy"), F.col("new_date"), F.col("new_yoy")))
    both = both.withColumn("reason", why).withColumn("take", F.col("reason").isNull())
    changed = F.col("take") & ((F.col("new_date") != F.col("latest_date")) | (value != F.round("latest_yoy", 4)))
    date, now = F.when(F.col("take"), F.col("new_date")).otherwise(F.col("latest_date")), F.when(F.col("take"), value).otherwise(F.col("latest_yoy"))
    out = both.select("ordinal", "block", "short", date.alias("latest_date"), now.alias("latest_yoy"), "reference_yoy", changed.alias("changed"), "take", "reason")
    return out.select(
        "ordinal", "block", "short", "latest_date", "latest_yoy", "reference_yoy", direction(F.col("latest_yoy"), F.col("reference_yoy")).alias("direction"),
        F.round(F.col("latest_yoy") - F.col("reference_yoy"), 2).alias("delta"), "changed", F.when(F.col("take"), "PASS").otherwise("PRESERVED_LAST_VERIFIED").alias("status"), "reason",
    )


def translation(rates: DataFrame, reference: str) -> DataFrame:
    """One row for (date, value): the move in per cent, rounded to two decimals, of the last value over the last one
    up to the reference date; no row without either, or beyond MOVE. The rounded move decides the class."""
    ok = rates.where(finite(F.col("value")))
    ends = ok.agg(F.max("date").alias("latest"), F.max_by("value", "date").alias("now"), F.max_by("value", F.when(F.col("date") <= F.lit(reference).cast("date"), F.col("date"))).alias("base"),
                  F.max(F.when(F.col("date") <= F.lit(reference).cast("date"), F.col("date"))).alias("based"))
    move = ends.where("based is not null").withColumn("raw", 100 * (F.try_divide("now", "base") - 1)).where(F.abs("raw") <= MOVE)
    pct = F.round("raw", 2)
    return move.select("latest", "based", pct.alias("pct_change"), choose((pct < -1, "TAILWIND_WEAKER_USD"), (pct > 1, "HEADWIND_STRONGER_USD"), default="NEUTRAL").alias("translation"))


def missing_months(levels: DataFrame, key: str, first: str, last: str | None = None) -> DataFrame:
    """(key, month): calendar months from `first` (yyyy-MM) to `last`, or to the key's own last month, that a key
    does not have."""
    spans = levels.groupBy(key).agg(F.max("month").alias("end"))
    until = F.lit(last) if last else F.col("end")
    day = lambda m: F.to_date(F.concat(m, F.lit("-01")))
    some = spans.where(until >= F.lit(first))
    calendar = some.select(key, F.explode(F.sequence(day(F.lit(first)), day(until), F.expr("interval 1 month"))).alias("day"))
    calendar = calendar.select(key, F.date_format("day", "yyyy-MM").alias("month"))
    return calendar.join(levels.select(key, "month").distinct(), [key, "month"], "left_anti")


def latest_month(rows: DataFrame, key: str) -> DataFrame:
    """The value of each key's last month; of equal months the largest."""
    return rows.groupBy(key).agg(F.max(F.struct("month", "value")).alias("x")).select(key, "x.month", "x.value")




def last_verified(blocks: DataFrame) -> DataFrame:
    """blocks as they are served when no refresh ran: each with the status FALLBACK_LAST_VERIFIED, and live_attempted
    false."""
    return blocks.withColumn("status", F.lit("FALLBACK_LAST_VERIFIED")).withColumn("live_attempted", F.lit(False))
