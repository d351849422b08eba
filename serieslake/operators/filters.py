"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.functions import dates, text


def with_key(df: DataFrame, *columns: str) -> DataFrame:
    return df.dropna(subset=list(columns))


def complete(df: DataFrame) -> DataFrame:
    return df.dropna("any")


def parse_or_drop(df: DataFrame, column: str, parsed: Column) -> DataFrame:
    """Replace a text date by its parsed form and drop the rows that do not parse."""
    return df.withColumn(column, parsed).filter(F.col(column).isNotNull())


def trimmed_equals(column: str, value: str) -> Column:
    return text.strip(F.col(column)) == value


def any_contains(df: DataFrame, column: str, part: str) -> bool:
    """Does any row contain ``part``? Stops at the first hit."""
    return not df.filter(F.col(column).contains(part)).isEmpty()


def up_to_first_year(
    df: DataFrame, by: Sequence[str], order: str, date: str, current_year: int | None = None
) -> DataFrame:
    """Clamp each sheet to the year of its first row.

    Only sheets of past years are clamped when ``current_year`` is given. The first row
    is found with a merge-able aggregate, never by sorting a sheet.
    """
    first = (
        df.groupBy(*by)
        .agg(F.min_by(date, order).alias("_first"))
        .withColumnsRenamed({name: f"_key_{name}" for name in by})
    )
    on = [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in by]
    keep = F.col(date) <= dates.last_of_year(F.col("_first"))
    if current_year is not None:
        keep = keep | (F.year("_first") >= current_year)
    return df.join(first, on).filter(keep).select(*df.columns)


def after_floor(incoming: DataFrame, date: str, floor: str | None) -> DataFrame:
    """Dated rows, and with ``floor`` only later ones: what a first load may take."""
    dated = incoming.filter(F.col(date).isNotNull())
    return dated.filter(F.col(date) > F.lit(floor).cast("date")) if floor else dated


def newer_than(
    incoming: DataFrame,
    stored: DataFrame,
    date: str,
    by: Sequence[str] = (),
    floor: str | None = None,
) -> DataFrame:
    """Rows dated after the newest stored row (of the same key, when ``by`` is given).

    Strictly later: late and revised rows stay out. ``floor`` is the mark used where
    nothing is stored yet; without it every row is new there. Rows without a date never are.
    """
    mark = F.lit(floor).cast("date") if floor else F.lit(None).cast("date")
    if not by:
        newest = F.coalesce(stored.select(F.max(date).cast("date")).scalar(), mark)
        return incoming.filter(F.col(date).isNotNull() & (newest.isNull() | (F.col(date) > newest)))
    newest = (
        stored.groupBy(*by)
        .agg(F.max(date).cast("date").alias("_newest"))
        .withColumnsRenamed({name: f"_key_{name}" for name in by})
    )
    on = [F.col(name).eqNullSafe(F.col(f"_key_{name}")) for name in by]
    limit = F.coalesce(F.col("_newest"), mark)
    return (
        incoming.join(newest, on, "left")
        .filter(F.col(date).isNotNull() & (limit.isNull() | (F.col(date) > limit)))
        .select(*incoming.columns)
    )
