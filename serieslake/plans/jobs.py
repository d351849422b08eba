"""Complete jobs: landed rows or payloads to stored tables, each with its load mode.

``run`` is driven by the ``JOBS`` table. A job that restates its history replaces its tables, the others
add what is newer than the newest stored row, so a rerun over the same landing adds nothing. Jobs over payloads
(``pages``) keep a ledger of the pages they have stored: a page that was cut off or missing is taken by the next run that
finds it whole, whatever its rows are dated.
The dashboard's twelve tables are checked against their keys first; if one breaks a constraint, none is
replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.operators import load, quality
from serieslake.plans import activity, exchange, monetary, prices, repo, trades
from serieslake.sources import layouts, records

AT_ONCE = 4  # tables of a job that are stored at the same time
FOREX_BODY = TRADES_BODY = SPOT_BODY = "body"


@dataclass(frozen=True)
class Job:
    """How landed data become tables, how these are stored, and what must hold before that.

    ``report`` gives constraint violations (table_name, constraint_name, violations). ``pages`` gives the landed
    pages with their keys, and the options of ``append_pages``. With ``by_series`` the columns given as ``by`` tell
    the series of a table apart, each with a newest date of its own.
    """

    tables: Callable[..., Mapping[str, DataFrame]]
    mode: str
    options: Mapping[str, object] = field(default_factory=dict)
    report: Callable[[DataFrame], DataFrame] | None = None
    pages: Callable[..., tuple[DataFrame, Mapping[str, object]]] | None = None
    by_series: bool = False


def _spot_tables(payloads: DataFrame, by=()) -> Mapping[str, DataFrame]:
    spots = exchange.spot_records(payloads, SPOT_BODY, by)
    return {"ccl": exchange.consolidated_rate(spots, by=by)}


def _livestock_tables(pages: DataFrame) -> Mapping[str, DataFrame]:
    """The market tables of the pages, dated by their request."""
    clean = prices.livestock_prices(pages, "html", "date")
    return {"MAGPrices": clean.withColumn("date", F.col("date").cast("date"))}


def _deposit_tables(rows: DataFrame, workbook: str) -> Mapping[str, DataFrame]:
    """All deposit tables, named and headed by the parameter table and the header rows."""
    return monetary.deposit_tables(rows, monetary.deposit_loads(rows, workbook))


def _dashboard_violations(rows: DataFrame) -> DataFrame:
    return monetary.dashboard_constraints(rows).groupBy("table_name", "constraint_name").agg(F.sum("violations").alias("violations"))


def _forex_pages(payloads: DataFrame, keep=()) -> tuple[DataFrame, Mapping[str, object]]:
    """A payload is known by the columns that are kept of it, or by its content if there are none."""
    body = F.col(FOREX_BODY)
    found = payloads if keep else payloads.withColumn("payload", F.sha2(body, 256))
    return found, {"key": list(keep) or ["payload"], "status": records.status(body)}


def _trade_pages(pages: DataFrame, run_date: str, schemas) -> tuple[DataFrame, Mapping[str, object]]:
    wanted = pages.filter(F.col("endpoint").isin(list(schemas))).withColumn("run_date", F.lit(run_date).cast("date"))
    return wanted, {
        "key": ["run_date", "endpoint", "page"],
        "status": records.status(F.col(TRADES_BODY)),
        "announced": lambda found: trades.announced_keys(found, TRADES_BODY, ["run_date"]),
    }


JOBS = {
    "price_index": Job(lambda cells: {"IPCIndec": prices.price_index(cells)}, "overwrite"),
    "activity": Job(lambda rows, **of: {"EMAE": activity.activity_index(rows, **of)}, "overwrite"),
    "real_exchange": Job(lambda rows, **of: {"ITCRM": activity.real_exchange_rate(rows, **of)}, "overwrite"),
    "monetary": Job(monetary.monetary_tables, "overwrite"),
    "dashboard": Job(monetary.dashboard_tables, "overwrite", report=_dashboard_violations),
    "deposits": Job(_deposit_tables, "append_new", {"date": "date"}),
    "repo_sheet": Job(lambda rows, **of: {"pases": repo.repo_operations(rows, **of)}, "append_new", {"date": "date"}),
    "narrow_series": Job(
        lambda rows: {"narrow": exchange.narrow_series(rows, layouts.NARROW)}, "append_new", {"date": "obs_date", "by": ["series_id"]}
    ),
    "spot_rates": Job(_spot_tables, "append_new", {"date": "date"}, by_series=True),
    "livestock": Job(_livestock_tables, "append_new", {"date": "date"}),
    "forex": Job(lambda payloads, keep=(): {"forex": exchange.forex_quotes(payloads, FOREX_BODY, keep)}, "append_pages", pages=_forex_pages),
    "trades": Job(
        lambda pages, run_date, schemas: {"senebi": trades.trades(pages, TRADES_BODY, run_date, schemas)}, "append_pages", pages=_trade_pages
    ),
}


def run(job: str, landed: DataFrame, lake: str, **given) -> dict[str, load.LoadResult]:
    """Store the tables of a job below ``lake``; ``given`` goes to its reader."""
    plan = JOBS[job]
    if plan.report is not None:
        found = plan.report(landed).filter("violations > 0").collect()  # a row per table and constraint
        quality.refuse({f"{r.table_name}, {r.constraint_name}": r.violations for r in found})
    if plan.pages is not None:
        pages, how = plan.pages(landed, **given)
        names = list(plan.tables(pages, **given))
        return {
            name: load.append_pages(pages, f"{lake}/{name}", lambda p, name=name: plan.tables(p, **given)[name], job=job, **how) for name in names
        }
    tables = plan.tables(landed, **given)
    options = dict(plan.options) | ({"by": tuple(given.get("by", ()))} if plan.by_series else {})
    store = inheritable_thread_target(landed.sparkSession)(
        lambda name: load.load(tables[name], f"{lake}/{name}", plan.mode, job=job, **options)
    )
    with ThreadPoolExecutor(AT_ONCE) as pool:  # the tables of a job do not depend on each other
        return dict(zip(tables, pool.map(store, tables)))
