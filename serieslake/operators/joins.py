"""Joins. No side is forced to broadcast: Spark checks sizes and decides at run time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from serieslake.functions import dates


def on_date(left: DataFrame, right: DataFrame, date: str = "date") -> DataFrame:
    """Inner join on a shared date; null dates match nothing."""
    return left.join(right, date)


def with_year_ago(
    df: DataFrame, date: str, values: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """Each row next to the same series one year earlier; unmatched rows drop out.

    The rows of one calendar day of all years stand in one window, in the order of the years, and a range frame picks the
    year before: one shuffle, neither a self-join nor pairs, and no task gets more of a series than one row a
    year. 29 February looks back to the 28th and shares its window. A second row of a date fails the job.
    Rows without a date or with a null key match nothing.
    """
    leap = (F.month(date) == 2) & (F.dayofmonth(date) == 29)
    place = 2 * F.year(date) + leap.cast("int")  # 28 February at 2 * year, 29 February one later
    day = F.month(date) * 100 + F.least(F.dayofmonth(date), F.when(F.month(date) == 2, 28).otherwise(31))
    years = Window.partitionBy(*by, day).orderBy(place)

    def at(back: int):
        frame = years.rangeBetween(-back, -back)
        return F.max(F.struct(*values)).over(frame)

    ago = F.when(leap, at(3)).otherwise(at(2))
    once = F.when(F.count(F.lit(1)).over(years.rangeBetween(0, 0)) == 1, ago).otherwise(F.raise_error(F.lit("two rows for one date of a series")))
    known = df.dropna(subset=[*by, date])
    return known.select("*", once.alias("_ago")).filter("_ago is not null").select(
        *[F.col(f"`{c}`") for c in df.columns], *(F.col(f"_ago.`{v}`").alias(f"{v}_year_ago") for v in values)
    )


def combine_first(
    first: DataFrame, other: DataFrame, keys: Sequence[str], values: Sequence[str]
) -> DataFrame:
    """All keys of both frames; ``first`` wins wherever it has a value."""
    renamed = other.select(*keys, *(F.col(v).alias(f"_other_{v}") for v in values))
    return first.join(renamed, list(keys), "full").select(
        *keys, *(F.coalesce(v, f"_other_{v}").alias(v) for v in values)
    )


def calendar(
    df: DataFrame, date: str, by: Sequence[str], end: str | None = None
) -> DataFrame:
    """Every day from the first of each series to ``end`` (default: last of all data)."""
    last = F.lit(end).cast("date") if end else df.select(F.max(date)).scalar()
    return (
        df.groupBy(*by)
        .agg(F.min(date).alias("_first"))
        .select(*by, F.explode(dates.days_between(F.col("_first"), last)).alias(date))
    )


def on_calendar(
    df: DataFrame, date: str, by: Sequence[str], end: str | None = None
) -> DataFrame:
    """The calendar with the observed rows joined to it.

    ``series.densified`` gives the same rows without this join; use this form when a
    date may legitimately hold several rows.
    """
    return calendar(df, date, by, end).join(df, [*by, date], "left")
