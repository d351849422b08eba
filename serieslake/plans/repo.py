"""Repo market: rate payloads, the compounded index, the operations sheet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.operators import load, project, series, versions
from serieslake.sources import layouts, records, sheets

# The payload fields the index needs.
RATE_RECORD = "vwap double, daysToMaturity int"


def repo_rates(
    payloads: DataFrame, body: str, run_date: str, record: str = RATE_RECORD
) -> DataFrame:
    """Rates of one day's payloads, dated with the run date; unknown fields stay in ``raw``."""
    rates = records.record_array(payloads, body, record, field=None, with_raw=True)
    return project.with_run_date(rates, run_date)


def repo_index(
    rates: DataFrame,
    by: Sequence[str] = (),
    date: str = "date",
    rate: str = "vwap",
    tenor: str = "daysToMaturity",
    end: str | None = None,
) -> DataFrame:
    """Compounded index of every series up to ``end`` (default: last date of the data).

    Pass the maturity in ``by`` when a date has several. Without ``by`` the whole table
    is one series, which holds a row per day.
    """
    if by:
        return series.compounded_index(rates, by, date, rate, tenor, end)
    single = rates.withColumn("_series", F.lit(0))
    return series.compounded_index(single, ["_series"], date, rate, tenor, end).drop("_series")


STATE = "_state"


def extend_index(
    rates: DataFrame,
    path: str,
    by: Sequence[str],
    end: str,
    date: str = "date",
    rate: str = "vwap",
    tenor: str = "daysToMaturity",
    job: str | None = None,
) -> load.LoadResult:
    """Store the index days up to ``end`` that new rates add; the stored index is not read.

    The end of every series (last date, rates and indices) is kept beside the table and published with the rows, so a
    load that is lost or run again neither skips nor repeats a day. ``rates`` need hold new quotes only.
    """
    spark = rates.sparkSession
    base = versions.newest(spark, path)
    if base is None:
        fresh = series.compounded_index(rates.filter(F.col(date) <= F.lit(end).cast("date")), by, date, rate, tenor, end)
        state = None
    else:
        state = spark.read.schema(base.struct).parquet(*[f"{path}/{f}" for f in base.sides[STATE]])
        fresh = series.resumed_index(rates, state, by, date, rate, tenor, end)
    schema = fresh.schema

    def last(rows: DataFrame) -> DataFrame:
        rest = [c for c in schema.names if c not in by]
        return rows.groupBy(*by).agg(F.max(F.struct(date, *(c for c in rest if c != date))).alias("_last")).select(*by, "_last.*").select(*schema.names)

    def change(base, entries, rows):
        added = versions.read_entries(spark, path, entries, schema)
        ends = last(added if state is None else added.unionByName(state))
        place = load.keep_side(ends, path, STATE)
        return versions.Version(versions.following(base), "extend", rows, schema.json(), (base.entries if base else ()) + entries, {STATE: (place,)})

    return load.store(fresh, path, "extend", change, base=base, job=job)


def repo_operations(rows: DataFrame, workbook: str | None = None) -> DataFrame:
    """The operations sheet; rows without a date or a total stock are no observations."""
    return sheets.read_rows(rows, layouts.PASES.of(workbook))
