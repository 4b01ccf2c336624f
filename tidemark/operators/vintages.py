"""What was known on a date: the latest vintage of the latest month among what had been published by then.

A release is (series, month, published, value, promoted): a value for a month, published on a date; months are revised by later
releases. Promoted releases form the core; all of them, promoted or not, the candidate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def known_at(decisions: DataFrame, releases: DataFrame) -> DataFrame:
    """decisions (series, date) with core_month, core_published, core_value, the same of the candidate, and ahead: whether the
    candidate is of a later month or vintage than the core.

    No release published after the date counts; one of the date itself does. Of a month's releases on one date the greatest
    value counts. A decision before the first release has nulls. Both tables are put in one order, in which a running maximum
    of (month, published, value) is what is known; no date range is joined. A series is cut at calendar years, so one with most
    of the rows is many tasks: the maxima of years before come from a table of a row for each series and year.
    Repeated decisions are answered each; rows with a null series, month or date are left out.
    """
    known = F.struct("month", "published", "value")
    empty = F.lit(None).cast(releases.select(known.alias("x")).schema["x"].dataType)
    told = releases.where("series IS NOT NULL AND month IS NOT NULL AND published IS NOT NULL").select(
        "series", F.col("published").cast("date").alias("date"), F.lit(0).alias("asks"), known.alias("candidate"), F.when(F.coalesce("promoted", F.lit(False)), known).alias("core")
    )
    asked = decisions.where("series IS NOT NULL AND date IS NOT NULL").select("series", F.col("date").cast("date").alias("date"), F.lit(1).alias("asks"), empty.alias("candidate"), empty.alias("core"))
    year = F.year("date").alias("year")
    rows = told.unionByName(asked).select("*", year)
    of_year = told.select("*", year).groupBy("series", "year").agg(F.max("candidate").alias("candidate0"), F.max("core").alias("core0"))
    years = rows.select("series", "year").distinct().join(of_year, ["series", "year"], "left")
    before = Window.partitionBy("series").orderBy("year").rowsBetween(Window.unboundedPreceding, -1)
    years = years.select("series", "year", F.max("candidate0").over(before).alias("candidate0"), F.max("core0").over(before).alias("core0"))
    so_far = Window.partitionBy("series", "year").orderBy("date", "asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    best = lambda c: F.greatest(F.max(c).over(so_far), F.col(f"{c}0"))
    found = rows.join(years, ["series", "year"]).select("series", "date", "asks", best("candidate").alias("candidate"), best("core").alias("core")).where("asks = 1")
    part = lambda c: (F.col(f"{c}.{f}").alias(f"{c}_{f}") for f in ("month", "published", "value"))
    ahead = F.col("candidate").isNotNull() & (F.col("core").isNull() | (F.col("candidate") > F.col("core")))
    return found.select("series", "date", *part("core"), *part("candidate"), ahead.alias("ahead"))
