"""Dates: parsing, calendar arithmetic and serial numbers.

Two-digit years are read as 2000-2099.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Day zero of workbook serial numbers and the text layouts met in landed data.
SERIAL_DAY_ZERO = "1899-12-30"
DAY_SECONDS = 86400
DAY_FIRST_FORMATS = ("d/M/yyyy", "d-M-yyyy", "d/M/yy")
TIME_TAIL = r"^.{10}[ T]([01]\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"
LAST_SERIAL = 2958465  # 9999-12-31, the last day a workbook can hold


def _shape(fmt: str) -> str:
    """Regular expression of the texts a layout can read."""
    widths = {"yyyy": "{4}", "yy": "{2}", "MM": "{2}", "dd": "{2}", "M": "{1,2}", "d": "{1,2}"}
    widths |= {"HH": "{2}", "mm": "{2}", "ss": "{2}"}
    parts = re.findall(r"yyyy|yy|MM|dd|HH|mm|ss|M|d|.", fmt)
    return "^" + "".join(rf"\d{widths[p]}" if p in widths else re.escape(p) for p in parts) + "$"


def parse(col: Column, fmt: str) -> Column:
    """Date in one layout, null when the text does not fit.

    Text of another shape is told apart by a pattern first: a failing parse costs an
    exception per row, which dominates when several layouts are tried in turn.
    """
    return F.when(col.rlike(_shape(fmt)), F.try_to_date(col, fmt))


def parse_iso(col: Column) -> Column:
    """``yyyy-MM-dd``, with or without a valid time of day behind it.

    The time stands behind a blank or a ``T``; seconds, their fraction and a zone may follow. The day
    is taken as written.
    """
    dashed = (F.substring(col, 5, 1) == "-") & (F.substring(col, 8, 1) == "-")
    day = F.substring(col, 1, 10).try_cast("date")
    return F.when((F.length(col) == 10) & dashed, day).when(
        (F.length(col) > 10) & dashed & col.rlike(TIME_TAIL), day
    )


def parse_any(col: Column, formats: Sequence[str]) -> Column:
    """First layout that fits wins."""
    return F.coalesce(*(parse(col, fmt) for fmt in formats))


def parse_day_first(col: Column) -> Column:
    trimmed = F.trim(col)
    return F.coalesce(*(parse(trimmed, fmt) for fmt in DAY_FIRST_FORMATS), parse_iso(trimmed))


def from_serial(col: Column) -> Column:
    """Workbook day number to date; the fraction (time of day) is dropped.

    Numbers that no workbook uses for a day (such as 20240110) give null.
    """
    day = F.when(col.between(0, LAST_SERIAL + 0.999999999), F.floor(col)).try_cast("int")
    return F.date_add(F.lit(SERIAL_DAY_ZERO).cast("date"), day)


def from_serial_or_text(col: Column) -> Column:
    """A cell holding either a serial number or day-first text."""
    serial = col.try_cast("double")
    return F.when(serial.isNotNull(), from_serial(serial)).otherwise(parse_day_first(col))


def to_epoch_seconds(col: Column) -> Column:
    return F.unix_date(col).cast("bigint") * DAY_SECONDS


def from_epoch_seconds(col: Column) -> Column:
    """Calendar day of an instant, in UTC whatever the session's zone."""
    return from_epoch_days(F.floor(col / DAY_SECONDS))


def from_epoch_days(col: Column) -> Column:
    return F.date_from_unix_date(col.cast("int"))


def next_day(col: Column) -> Column:
    return F.date_add(col, 1)


def year_before(col: Column) -> Column:
    """One year earlier; 29 February falls back to the 28th."""
    return F.add_months(col, -12)


def first_of_year(col: Column) -> Column:
    return F.trunc(col, "year")


def last_of_year(col: Column) -> Column:
    return F.make_date(F.year(col), F.lit(12), F.lit(31))


def ordinal_month(base: str, ordinal: Column) -> Column:
    """The month ``ordinal`` steps after ``base`` (0 = base)."""
    return F.add_months(F.lit(base).cast("date"), ordinal.cast("int"))


def as_text(col: Column, fmt: str = "yyyy-MM-dd") -> Column:
    return F.date_format(col, fmt)


def time_of_day(col: Column) -> Column:
    """``HH:mm:ss`` if it is a valid time, else null."""
    return F.when(col.rlike(r"^([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]$"), col)


def seconds_of_day(col: Column) -> Column:
    valid = time_of_day(col)
    part = lambda i: F.split_part(valid, F.lit(":"), F.lit(i)).cast("int")
    return part(1) * 3600 + part(2) * 60 + part(3)


def vintage(col: Column, fmt: str = "MM_yy") -> Column:
    """Key of the release a file belongs to."""
    return F.date_format(col, fmt)


def days_between(start: Column, end: Column) -> Column:
    """Every day from start to end; empty when end lies before start."""
    return F.when(start <= end, F.sequence(start, end)).otherwise(
        F.array().cast("array<date>")
    )
