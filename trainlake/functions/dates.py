"""Date and time expressions. Clock values are always arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trainlake.functions.columns import as_col

MICROS_PER_DAY = 86_400_000_000
# Accepted spellings of a time stamp, tried in this order after ISO 8601.
TIMESTAMP_FORMATS = ("d MMM yyyy, HH:mm", "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy")
BIRTH_DATE_FORMATS = ("yyyy-M-d", "d/M/yyyy")


def to_utc(col: Column | str) -> Column:
    """ISO 8601 text with offset to a zone-less UTC time; unreadable text gives NULL.

    Needs the session zone UTC, see ``session.apply_defaults``.
    """
    return as_col(col).try_cast("timestamp").cast("timestamp_ntz")


def to_local(col: Column | str, zone: str = "America/Sao_Paulo") -> Column:
    """UTC time to the wall clock of ``zone``."""
    return F.from_utc_timestamp(as_col(col), zone).cast("timestamp_ntz")


def parse_timestamp(col: Column | str, formats: tuple[str, ...] = TIMESTAMP_FORMATS) -> Column:
    """First spelling that fits each value, as zone-less UTC; else NULL."""
    text = as_col(col).cast("string")
    tries = [F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz") for fmt in formats]
    return F.coalesce(to_utc(text), *tries)


def parse_date(col: Column | str) -> Column:
    """``yyyy-MM-dd`` to a date, anything else to NULL."""
    return F.try_to_date(as_col(col).cast("string"), "yyyy-M-d")


def parse_birth_date(col: Column | str) -> Column:
    text = as_col(col).cast("string")
    return F.coalesce(*[F.try_to_date(text, fmt) for fmt in BIRTH_DATE_FORMATS])


def minutes_between(start: Column | str, end: Column | str) -> Column:
    return F.timestamp_diff("MICROSECOND", as_col(start), as_col(end)) / F.lit(60_000_000.0)


def sunday_week(col: Column | str) -> Column:
    """``YYYY-WW`` with weeks that start on Sunday; days before the first one are week 00."""
    day = as_col(col)
    week = F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("int")
    return F.concat(
        F.lpad(F.year(day).cast("string"), 4, "0"),
        F.lit("-"),
        F.lpad(week.cast("string"), 2, "0"),
    )


def monday_of(col: Column | str) -> Column:
    return F.date_trunc("week", as_col(col)).cast("date")


def month_of(col: Column | str) -> Column:
    return F.date_trunc("month", as_col(col)).cast("date")


def with_calendar(df: DataFrame, ts: str = "date") -> DataFrame:
    """Calendar columns of ``ts``; weekday 0 is Monday."""
    day = F.col(ts)
    return df.withColumns(
        {
            "date_only": day.cast("date"),
            "week": F.weekofyear(day),
            "year": F.year(day),
            "year_week": sunday_week(day),
            "month": month_of(day),
            "dow": F.date_format(day, "EEEE"),
            "weekday": F.weekday(day),
        }
    )


def age_years(born: Column | str, as_of: Column) -> Column:
    """Whole days between the two times, divided by 365.25."""
    start = as_col(born).cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, as_of.cast("timestamp_ntz"))
    return F.floor(micros / F.lit(MICROS_PER_DAY)) / F.lit(365.25)


def completed_age(born: Column | str, as_of: Column) -> Column:
    """Completed years at ``as_of``; unreadable birth dates give NULL."""
    dob = parse_birth_date(born)
    before_birthday = (F.month(as_of) * 100 + F.dayofmonth(as_of)) < (
        F.month(dob) * 100 + F.dayofmonth(dob)
    )
    return F.year(as_of) - F.year(dob) - before_birthday.cast("int")
