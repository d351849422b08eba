"""Number parsing and rate arithmetic.

ANSI mode stays on, so every conversion or division of landed data uses a ``try_``
form: bad input becomes null rather than a failed job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from serieslake.functions import text

DAYS_IN_YEAR = 365


def to_number(col: Column) -> Column:
    """Number or null. The model has neither NaN nor infinity, so their names count as missing, and so
    do the suffixed and hexadecimal forms (``1d``, ``2f``, ``0x1p3``) that a cast would take."""
    plain = F.translate(col.cast("string"), "dDfFxX", "") == col.cast("string")
    return F.when(plain, F.nanvl(col.try_cast("double"), F.lit(None).cast("double")))


def placeholder_to_zero(col: Column, marker: str = "s/o") -> Column:
    """A missing value or the exact marker is 0; other text is coerced."""
    return F.when(col.isNull() | (col == marker), F.lit(0.0)).otherwise(to_number(col))


def scaled(col: Column, divisor: float) -> Column:
    return to_number(col) / F.lit(float(divisor))


def point_thousands(col: Column) -> Column:
    """``1.234,56`` -> 1234.56: dots group thousands, the comma is the decimal mark."""
    return to_number(F.translate(col, ",$. ", "."))


def comma_thousands(col: Column) -> Column:
    """``1,234.5`` -> 1234.5."""
    return to_number(F.translate(col, ",", ""))


def whole_number(col: Column) -> Column:
    """``1.234`` -> 1234: dots group thousands and there are no decimals."""
    return to_number(F.translate(col, ".", ""))


def implied_cents(col: Column) -> Column:
    """``$1.234,56`` -> 1234.56 by dropping every mark and dividing by 100."""
    return scaled(F.translate(col, "$,.", ""), 100)


def digits_only(col: Column) -> Column:
    return to_number(text.remove(col, r"\D"))


def daily_effective_rate(rate: Column, tenor: Column, markup: float = 0.0) -> Column:
    """Simple annual rate over ``tenor`` days as an effective daily rate.

    A tenor of 0 gives a rate of 0 (the power is undefined there). A loss beyond the whole amount has no
    daily rate: null, never NaN.
    """
    days = tenor.cast("double")
    annual = rate + F.lit(float(markup)) if markup else rate
    growth = F.lit(1.0) + annual / F.lit(float(DAYS_IN_YEAR)) * days
    return F.when(tenor == 0, F.when(rate.isNotNull(), F.lit(0.0))).otherwise(
        F.when(growth >= 0, F.pow(growth, F.try_divide(F.lit(1.0), days)) - F.lit(1.0))
    )


def deflated(nominal: Column, price_index: Column) -> Column:
    return F.try_divide(nominal, price_index)


def change(current: Column, previous: Column) -> Column:
    """Relative change; a zero base gives null."""
    return F.try_divide(current, previous) - F.lit(1.0)
