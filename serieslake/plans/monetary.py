"""Monetary workbooks: multi-sheet loads, dashboard blocks, deposits, daily balance."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.operators import filters, load, series
from serieslake.sources import layouts, sheets


def monetary_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The six wide tables, by name."""
    return {one.table: sheets.read_rows(rows, one).drop("row") for one in layouts.MONETARY}


def monetary_observations(rows: DataFrame) -> DataFrame:
    """All six sheets in long form from a single scan."""
    return sheets.read_observations(rows, layouts.MONETARY)


def dashboard_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The twelve blocks of the dashboard sheet as wide tables."""
    return {
        one.table: sheets.read_rows(rows, one).drop("row") for one in layouts.DASHBOARD_BLOCKS
    }


def dashboard_observations(rows: DataFrame) -> DataFrame:
    return sheets.read_observations(rows, layouts.DASHBOARD_BLOCKS)


def dashboard_constraints(rows: DataFrame) -> DataFrame:
    """Key and not-null violations of the twelve tables, before they replace anything.

    All tables are checked in one scan and one pair of grouped counts.
    """
    return observation_constraints(dashboard_observations(rows))


def observation_constraints(observations: DataFrame) -> DataFrame:
    """Repeated dates and missing values per (table, series)."""
    per_date = observations.groupBy("table", "series_id", "obs_date").agg(
        F.count(F.lit(1)).alias("_rows"), F.count_if(F.col("value").isNull()).alias("_nulls")
    )
    counted = per_date.groupBy("table", "series_id").agg(
        F.count_if(F.col("_rows") > 1).alias("_repeated"), F.sum("_nulls").alias("_missing")
    )
    line = lambda name, count: F.struct(
        F.lit(name).alias("constraint_name"), F.col(count).alias("violations")
    )
    checks = F.array(line("primary key (date)", "_repeated"), line("not null", "_missing"))
    return counted.select(F.col("table").alias("table_name"), "series_id", F.inline(checks))


@dataclass(frozen=True)
class DepositLoad:
    """One line of the parameter table that drives the deposit loads."""

    table: str
    layout: sheets.SheetRange


def deposit_loads(
    rows: DataFrame, workbook: str, tables: Sequence[str] = tuple(layouts.DEPOSIT_SHEETS)
) -> list[DepositLoad]:
    """Parameters with the column names of the workbook's own header rows filled in."""
    headers = sheets.header_names(rows, [layouts.deposit_layout(table) for table in tables], workbook)
    return [DepositLoad(table, layouts.deposit_layout(table, headers[table])) for table in tables]


def deposit_observations(rows: DataFrame, loads: Sequence[DepositLoad]) -> DataFrame:
    """Every deposit table in one plan and one scan."""
    return sheets.read_observations(rows, [one.layout for one in loads])


def deposit_tables(rows: DataFrame, loads: Sequence[DepositLoad]) -> dict[str, DataFrame]:
    """Wide tables, to be stored with ``append_new``."""
    return {one.table: sheets.read_rows(rows, one.layout).drop("row") for one in loads}


def daily_balance(rows: DataFrame, current_year: int | None = None, workbook: str | None = None) -> DataFrame:
    """The daily balance; sheets of past years are cut at their 31 December."""
    table = sheets.read_rows(rows, layouts.SERIE_DIARIA.of(workbook))
    clamped = filters.up_to_first_year(table, ["workbook"], "row", "date", current_year)
    return clamped.drop("row")


def store_daily_balance(balance: DataFrame, path: str, year: int) -> load.LoadResult:
    """Replace the stored rows from the start of ``year`` on; rerunning changes nothing."""
    return load.replace_slice(balance, path, year)


def aggregates_yoy(
    aggregates: DataFrame, values: Sequence[str], date: str = "date", by: Sequence[str] = ()
) -> DataFrame:
    """Year-over-year growth of the monetary aggregates."""
    dated = filters.with_key(aggregates, date)
    return series.year_over_year(dated, date, values, by)


def adjusted_real_money(
    real: DataFrame, by: Sequence[str], month: str = "date", value: str = "M2Real"
) -> DataFrame:
    """Seasonally adjusted real money; months missing inside a series become null rows."""
    monthly = series.densified(real, by, month, [value], step="month", carry=False)
    return series.seasonally_adjusted(monthly, by, month, value)


def to_observations(
    wide: DataFrame, source: str, date: str = "date", vintage: str | None = None
) -> DataFrame:
    """A wide table in the canonical long form; ``vintage`` dates the release it was read from."""
    values = [f.name for f in wide.schema if f.dataType.simpleString() == "double"]
    return wide.unpivot([date], values, "series_id", "value").select(
        "series_id",
        F.col(date).alias("obs_date"),
        "value",
        F.lit(source).alias("source"),
        F.lit(vintage).cast("date").alias("vintage_date"),
    )
