"""The complete jobs, run twice each: what they store is what their readers give, and a rerun adds nothing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.operators import filters, load
from serieslake.plans import jobs
from serieslake.session import scratch_path
from standins import markup_payloads, sheets
from standins.series import rounded

TRADES = {"run_date": "2024-06-03", "schemas": markup_payloads.ENDPOINTS}


def _stored(spark, job: str, landed: DataFrame, name: str, **given) -> DataFrame:
    """The stored table after two runs; the second one must add no row."""
    lake = scratch_path(spark, job)
    plan = jobs.JOBS[job]
    first = jobs.run(job, landed, lake, **given)[name]
    again = jobs.run(job, landed, lake, **given)[name]
    if plan.mode in ("append_new", "append_pages") and again.rows:
        raise ValueError(f"a rerun of {job} added {again.rows} of {first.rows} rows")
    return load.read(spark, f"{lake}/{name}")


def job_activity(spark, folder):
    return _stored(spark, "activity", sheets.activity_rows(spark, folder), "EMAE")


def job_real_exchange(spark, folder):
    return _stored(spark, "real_exchange", sheets.exchange_rows(spark, folder), "ITCRM")


def job_repo_sheet(spark, folder):
    return _stored(spark, "repo_sheet", sheets.repo_rows(spark, folder), "pases", workbook="pases")


def job_narrow_series(spark, folder):
    return _stored(spark, "narrow_series", sheets.narrow_rows(spark, folder), "narrow")


def job_forex(spark, folder):
    stored = _stored(spark, "forex", markup_payloads.forex_payloads(spark, folder), "forex", keep=("event_id",))
    return filters.with_key(stored, "date")


def job_trades(spark, folder):
    return _stored(spark, "trades", markup_payloads.dense_pages(spark, folder), "senebi", **TRADES)


def job_spot_rates(spark, folder):
    return _stored(spark, "spot_rates", markup_payloads.spot_payloads(spark, folder), "ccl", by=["user_id"])


def job_livestock(spark, folder):
    stored = _stored(spark, "livestock", markup_payloads.livestock_pages(spark, folder), "MAGPrices")
    return rounded(stored, {c: 3 for c in stored.columns if c.startswith("precio")})


def _totals(name: str, stored: DataFrame) -> DataFrame:
    """Rows, values and sum of every numeric column of a stored table."""
    values = [f.name for f in stored.schema if f.dataType.simpleString() == "double"]
    line = lambda c: F.struct(F.lit(c).alias("series_id"), F.count(c).alias("present"), F.sum(c).alias("total"))
    summed = stored.agg(
        F.array(*map(line, values)).alias("_lines"),
        F.count(F.lit(1)).alias("observations"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    found = summed.select("observations", "first_date", "last_date", F.inline("_lines"))
    return found.select(F.lit(name).alias("table"), "series_id", "observations", "present", "total", "first_date", "last_date")


def _all_stored(spark, job: str, landed: DataFrame, **given) -> DataFrame:
    """Totals of every table a job stores, after two runs; the second one must leave the tables as they are."""
    lake = scratch_path(spark, job)
    first = jobs.run(job, landed, lake, **given)
    again = jobs.run(job, landed, lake, **given)
    for name, result in again.items():
        if result.rows != (0 if jobs.JOBS[job].mode == "append_new" else first[name].rows):
            raise ValueError(f"a rerun of {job} wrote {result.rows} rows of {name} after {first[name].rows}")
    return reduce(DataFrame.unionByName, [_totals(name, load.read(spark, f"{lake}/{name}")) for name in first])


def job_deposits(spark, folder):
    """All eight deposit tables, named by the workbook's own headers."""
    return _all_stored(spark, "deposits", sheets.deposit_rows(spark, folder), workbook="dep")


def job_monetary(spark, folder):
    """All six monetary tables."""
    return _all_stored(spark, "monetary", sheets.six_sheets(spark, folder))


def job_dashboard(spark, folder):
    """All twelve dashboard tables, checked against their keys before they replace anything."""
    return _all_stored(spark, "dashboard", sheets.dashboard_days(spark, folder))


def _repaired(spark, job: str, landings: list[DataFrame], name: str, **given) -> DataFrame:
    """The stored table after one run per landing, with the rows that each run added."""
    lake = scratch_path(spark, job)
    added = [jobs.run(job, landed, lake, **given)[name].rows for landed in landings]
    counts = [F.lit(n).cast("bigint").alias(f"added_{k}") for k, n in enumerate(added, 1)]
    return load.read(spark, f"{lake}/{name}").select("*", *counts)


def job_trades_repair(spark, folder):
    """Some pages are cut off or missing at first; the next run adds just their rows, the third none."""
    whole = markup_payloads.dense_pages(spark, folder)
    return _repaired(spark, "trades", [markup_payloads.cut_pages(spark, folder), whole, whole], "senebi", **TRADES)


def job_trades_to_repair(spark, folder):
    """What the first run lists as not stored, and why."""
    lake = scratch_path(spark, "trades")
    jobs.run("trades", markup_payloads.cut_pages(spark, folder), lake, **TRADES)
    return load.to_repair(spark, f"{lake}/senebi")


def job_forex_repair(spark, folder):
    """Payloads of days that are partly stored still land: those cut off at first, and those that came late."""
    whole = markup_payloads.forex_payloads(spark, folder)
    body = F.when(F.col("event_id") % 5 == 0, F.left("body", F.length("body") - 9)).otherwise(F.col("body"))
    first = whole.filter("event_id % 9 != 0").withColumn("body", body)
    return _repaired(spark, "forex", [first, whole, whole], "forex", keep=("event_id",))


def job_price_index(spark, folder):
    """Levels and variations of the stored price table, in long form."""
    return sheets.price_entries(_stored(spark, "price_index", sheets.price_cells(spark, folder), "IPCIndec"))


_CUT = "(event_id // 50 + 1) % 3 = 2 OR (event_id // 50 + 1) % 7 = 0"
TRADES_REPAIR_SQL = f"""
SELECT t.*, (SELECT count(*) FROM events WHERE NOT ({_CUT})) AS added_1, (SELECT count(*) FROM events WHERE {_CUT}) AS added_2,
  CAST(0 AS BIGINT) AS added_3
FROM ({markup_payloads.Q16_SQL}) t
"""

TO_REPAIR_SQL = """
WITH landed AS (SELECT DISTINCT event_type AS endpoint, CAST(event_id // 50 + 1 AS INTEGER) AS page FROM events),
announced AS (
  SELECT endpoint, CAST(unnest(generate_series(1, (SELECT max(page) FROM landed))) AS INTEGER) AS page
  FROM (SELECT DISTINCT endpoint FROM landed))
SELECT DATE '2024-06-03' AS run_date, a.endpoint, a.page,
  CASE WHEN a.page % 7 = 0 OR l.page IS NULL THEN 'missing' ELSE 'no records' END AS status
FROM announced a LEFT JOIN landed l ON l.endpoint = a.endpoint AND l.page = a.page
WHERE a.page % 7 = 0 OR a.page % 3 = 2 OR l.page IS NULL
"""

FOREX_REPAIR_SQL = f"""
SELECT t.*, (SELECT count(*) FROM events WHERE event_id % 5 <> 0 AND event_id % 9 <> 0) AS added_1,
  (SELECT count(*) FROM events WHERE event_id % 5 = 0 OR event_id % 9 = 0) AS added_2, CAST(0 AS BIGINT) AS added_3
FROM ({markup_payloads.Q7_SQL}) t
"""

MONETARY_SQL = f"""
SELECT "table", series_id, CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(present) AS BIGINT) AS present,
  sum(total) AS total, min(first_date) AS first_date, max(last_date) AS last_date
FROM ({sheets.Q11_SQL}) GROUP BY 1, 2
"""

LIVESTOCK_SQL = f"SELECT * REPLACE (CAST(date AS DATE) AS date) FROM ({markup_payloads.Q6_SQL})"

QUERIES = {
    "job_spot_rates": (job_spot_rates, markup_payloads.Q1_SQL),
    "job_livestock": (job_livestock, LIVESTOCK_SQL),
    "job_deposits": (job_deposits, sheets.ALL_DEPOSITS_SQL),
    "job_monetary": (job_monetary, MONETARY_SQL),
    "job_dashboard": (job_dashboard, sheets.DASHBOARD_DAYS_SQL),
    "job_activity": (job_activity, sheets.Q10_SQL),
    "job_real_exchange": (job_real_exchange, sheets.Q18_SQL),
    "job_repo_sheet": (job_repo_sheet, sheets.QUERIES["q15_repo_sheet"][1]),
    "job_narrow_series": (job_narrow_series, sheets.Q19_SQL),
    "job_forex": (job_forex, markup_payloads.Q7_SQL),
    "job_trades": (job_trades, markup_payloads.Q16_SQL),
    "job_trades_repair": (job_trades_repair, TRADES_REPAIR_SQL),
    "job_trades_to_repair": (job_trades_to_repair, TO_REPAIR_SQL),
    "job_forex_repair": (job_forex_repair, FOREX_REPAIR_SQL),
    "job_price_index": (job_price_index, sheets.Q3_SQL),
}
