"""Column functions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """Neither null nor NaN nor infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or(first: Column, second: Column) -> Column:
    """first where it is finite, else second: a coalesce on finiteness, not on null."""
    return F.when(finite(first), first).otherwise(second)


def month_of(when: Column) -> Column:
    """The month key yyyy-MM of a date or timestamp; its order is that of time."""
    return F.date_format(when, "yyyy-MM")


def month_shift(month: Column, by: int) -> Column:
    """The month key `by` calendar months later."""
    return month_of(F.add_months(F.to_date(F.concat(month, F.lit("-01"))), by))


def last_completed_month(as_of: str) -> Column:
    """The month before that of as_of, an ISO date. The clock is always a parameter."""
    return month_of(F.add_months(F.trunc(F.to_date(F.lit(as_of)), "MM"), -1))


def month_key(text: Column) -> Column:
    """The month key in texts like 202602, 2026-02 or 2026/02, in this century; else null."""
    found = F.regexp_extract(F.replace(F.trim(text), F.lit("/"), F.lit("-")), r"^(20\d{2})-?(0[1-9]|1[0-2])", 0)
    digits = F.replace(found, F.lit("-"), F.lit(""))
    return F.when(found != "", F.concat(F.substring(digits, 1, 4), F.lit("-"), F.substring(digits, 5, 2)))


def number(text: Column) -> Column:
    """A finite double of a cell, thousands commas allowed; blank, "." and other text are null."""
    value = F.replace(F.trim(text), F.lit(","), F.lit("")).try_cast("double")
    return F.when(finite(value), value)


def any_date(text: Column) -> Column:
    """The date of dd/MM/yyyy, dd-MMM-yyyy or yyyy-MM-dd; else null."""
    cell = F.trim(text)
    forms = ("d/M/yyyy", "d-MMM-yyyy", "yyyy-M-d")
    return F.coalesce(*(F.try_to_timestamp(cell, F.lit(f)) for f in forms)).cast("date")


def contains_any(text: Column, terms: Column) -> Column:
    """Whether the upper-cased text has any of the terms in it; a null text has none."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    return F.exists(terms, lambda t: F.contains(upper, t))


def yes(flag: Column) -> Column:
    """flag with null as false."""
    return F.coalesce(flag, F.lit(False))


def messages(*rows: tuple[Column, str]) -> Column:
    """The texts whose condition is true, in order and each once."""
    return F.array_distinct(F.array_compact(F.array(*(F.when(yes(c), F.lit(m)) for c, m in rows))))


def score_of_z(z: Column) -> Column:
    """50 plus 50/3 for each standard deviation."""
    return 50 + z * (50.0 / 3.0)
