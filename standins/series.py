"""Ordered series, compounded index, growth, seasonal adjustment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.operators import filters, joins, reshape, series
from serieslake.plans import exchange, monetary, prices, repo
from serieslake.sources import layouts
from standins.common import DAILY_SQL, MONTHLY_SQL, daily, monthly, table


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(
        *(F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns)
    )


# --- compounded index ------------------------------------------------------------------


def w6_compound(spark: SparkSession, folder: str) -> DataFrame:
    rates = daily(spark, folder).select(
        "series_id",
        F.col("obs_date").alias("date"),
        (F.col("value") / 1000).alias("vwap"),
        (1 + F.col("series_id") % 7).cast("int").alias("daysToMaturity"),
    )
    index = repo.repo_index(rates, ["series_id"])
    digits = {c: 9 for c in (*series.RATE_COLUMNS, *series.FACTOR_COLUMNS)}
    return rounded(index, digits | {c: 6 for c in series.INDEX_COLUMNS})


def _compound_sql() -> str:
    teds, fills, factors, caps = [], [], [], []
    for markup, ted, factor, cap in zip(
        series.MARKUPS, series.RATE_COLUMNS, series.FACTOR_COLUMNS, series.INDEX_COLUMNS
    ):
        teds.append(
            f"CASE WHEN n = 0 THEN 0.0 ELSE pow(1 + (r + {markup}) / 365.0 * n, 1.0 / n) - 1 END AS {ted}"
        )
        fills.append(f"last_value({ted} IGNORE NULLS) OVER w AS {ted}")
        factors.append(f"round({ted}, 9) AS {ted}, round({ted} + 1, 9) AS {factor}")
        caps.append(f"round(product({ted} + 1) OVER w, 6) AS {cap}")
    return f"""
WITH {DAILY_SQL},
quotes AS (SELECT series_id, obs_date AS date, value / 1000 AS r, 1 + series_id % 7 AS n FROM daily),
rated AS (SELECT series_id, date, {", ".join(teds)} FROM quotes),
spine AS (
  SELECT series_id, CAST(unnest(generate_series(min(date), (SELECT max(date) FROM quotes),
         INTERVAL 1 DAY)) AS DATE) AS date FROM quotes GROUP BY series_id),
filled AS (
  SELECT s.series_id, s.date, {", ".join(fills)}
  FROM spine s LEFT JOIN rated r ON r.series_id = s.series_id AND r.date = s.date
  WINDOW w AS (PARTITION BY s.series_id ORDER BY s.date
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT series_id, date, {", ".join(factors)}, {", ".join(caps)}
FROM filled
WINDOW w AS (PARTITION BY series_id ORDER BY date
             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
"""


# --- forward fill, calendar --------------------------------------------------------------


def w2_ffill(spark, folder):
    dense = series.densified(daily(spark, folder), ["series_id"], "obs_date", ["value"])
    return rounded(dense, {"value": 6})


def j4_calendar_join(spark, folder):
    joined = joins.on_calendar(daily(spark, folder), "obs_date", ["series_id"])
    filled = series.forward_fill(joined, ["series_id"], ["obs_date"], ["value"])
    return rounded(filled.select("series_id", "obs_date", "value"), {"value": 6})


FFILL_SQL = f"""
WITH {DAILY_SQL},
spine AS (
  SELECT series_id, CAST(unnest(generate_series(min(obs_date), (SELECT max(obs_date) FROM daily),
         INTERVAL 1 DAY)) AS DATE) AS obs_date FROM daily GROUP BY series_id)
SELECT s.series_id, s.obs_date, round(last_value(d.value IGNORE NULLS) OVER (
         PARTITION BY s.series_id ORDER BY s.obs_date
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS value
FROM spine s LEFT JOIN daily d ON d.series_id = s.series_id AND d.obs_date = s.obs_date
"""


def d9_windows(spark, folder):
    days = joins.calendar(daily(spark, folder), "obs_date", ["series_id"])
    return days.select(
        "series_id", F.col("obs_date").alias("date_from"), F.col("obs_date").alias("date_to")
    )


D9_SQL = f"""
WITH {DAILY_SQL},
days AS (
  SELECT series_id, CAST(unnest(generate_series(min(obs_date), (SELECT max(obs_date) FROM daily),
         INTERVAL 1 DAY)) AS DATE) AS d FROM daily GROUP BY series_id)
SELECT series_id, d AS date_from, d AS date_to FROM days
"""


# --- long series: scanned in buckets ------------------------------------------------------


def w3_long_scan(spark, folder):
    """Raw events as five very long series, ordered by time; buckets of one hour."""
    quotes = table(spark, folder, "events").select(
        "event_type",
        "ts",
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("quote"),
        (1 + F.col("value") * 1e-6).alias("factor"),
    )
    scanned = series.running(
        quotes,
        ["event_type"],
        ["ts", "event_id"],
        fills={"filled": "quote"},
        previous={"before": "quote"},
        products={"growth": "factor"},
        bucket=F.date_trunc("hour", "ts"),
    )
    kept = scanned.select("event_type", "event_id", "filled", "before", "growth")
    return rounded(kept, {"growth": 6})


W3_LONG_SQL = """
WITH quotes AS (
  SELECT event_type, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS quote,
         1 + value * 1e-6 AS factor FROM events)
SELECT event_type, event_id,
  last_value(quote IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled,
  last_value(quote IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  round(product(factor) OVER (PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS growth
FROM quotes
"""


def w1_long_change(spark, folder):
    """Change between consecutive quotes of each event type, padding missing ones."""
    quotes = table(spark, folder, "events").select(
        "event_type",
        "ts",
        "event_id",
        F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("quote"),
    )
    changed = series.changes(
        quotes,
        ["event_type"],
        ["ts", "event_id"],
        {"variation": "quote"},
        bucket=F.date_trunc("hour", "ts"),
    )
    return rounded(changed.select("event_type", "event_id", "variation"), {"variation": 9})


W1_LONG_SQL = """
WITH quotes AS (
  SELECT event_type, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS quote FROM events),
padded AS (
  SELECT event_type, ts, event_id, last_value(quote IGNORE NULLS) OVER (
    PARTITION BY event_type ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q FROM quotes)
SELECT event_type, event_id,
  round(q / nullif(lag(q) OVER (PARTITION BY event_type ORDER BY ts, event_id), 0) - 1, 9) AS variation
FROM padded
"""


# --- change, growth ------------------------------------------------------------------------


def w1_pct_change(spark, folder):
    varied = prices.price_variations(monthly(spark, folder), ["series_id"], "obs_date", "value")
    return rounded(varied, {"value": 2, "variation": 9})


W1_SQL = f"""
WITH {MONTHLY_SQL}
SELECT series_id, obs_date, round(value, 2) AS value,
  round(value / nullif(lag(value) OVER (PARTITION BY series_id ORDER BY obs_date), 0) - 1, 9) AS variation
FROM monthly
"""

WIDE_ITEMS = {
    "1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium", "4-NOT SPECIFIED": "open", "5-LOW": "low"
}


def p8_named_variations(spark, folder):
    """Levels next to variations whose names are made from the level names."""
    totals = (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("status"),
            F.trunc("o_orderdate", "month").alias("date"),
            "o_orderpriority",
        )
        .agg(F.sum("o_totalprice").alias("total"))
    )
    wide = reshape.pivot_unique(
        totals, ["status", "date"], "o_orderpriority", list(WIDE_ITEMS), "total"
    ).withColumnsRenamed(WIDE_ITEMS)
    names = list(WIDE_ITEMS.values())
    varied = series.changes(
        wide, ["status"], ["date"], {layouts.variation_name(n): n for n in names}
    )
    digits = {n: 2 for n in names} | {layouts.variation_name(n): 9 for n in names}
    return rounded(varied, digits)


def _p8_sql() -> str:
    levels = ", ".join(
        f"sum(CASE WHEN o_orderpriority = '{k}' THEN o_totalprice END) AS {v}"
        for k, v in WIDE_ITEMS.items()
    )
    padded = ", ".join(
        f"{v}, last_value({v} IGNORE NULLS) OVER w AS p_{v}" for v in WIDE_ITEMS.values()
    )
    out = ", ".join(
        f"round({v}, 2) AS {v}, round(p_{v} / nullif(lag(p_{v}) OVER w, 0) - 1, 9) AS "
        f"{layouts.variation_name(v)}"
        for v in WIDE_ITEMS.values()
    )
    window = "WINDOW w AS (PARTITION BY status ORDER BY date {})"
    return f"""
WITH wide AS (
  SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {levels}
  FROM orders GROUP BY 1, 2),
padded AS (SELECT status, date, {padded} FROM wide
  {window.format("ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")})
SELECT status, date, {out} FROM padded {window.format("")}
"""


def w4_ordinal(spark, folder):
    numbered = series.ordinal(daily(spark, folder), ["series_id"], ["obs_date"], "position")
    before = series.running(
        numbered, ["series_id"], ["obs_date"], previous={"value_before": "value"}
    )
    return rounded(before, {"value": 6, "value_before": 6})


W4_SQL = f"""
WITH {DAILY_SQL}
SELECT series_id, obs_date, round(value, 6) AS value,
  CAST(row_number() OVER w AS INTEGER) AS position, round(lag(value) OVER w, 6) AS value_before
FROM daily WINDOW w AS (PARTITION BY series_id ORDER BY obs_date)
"""


def w5_yoy(spark, folder):
    grown = series.year_over_year(monthly(spark, folder), "obs_date", ["value"], ["series_id"])
    return rounded(grown, {"value": 9})


W5_SQL = f"""
WITH {MONTHLY_SQL}
SELECT a.series_id, a.obs_date, round(a.value / nullif(b.value, 0) - 1, 9) AS value
FROM monthly a JOIN monthly b
  ON b.series_id = a.series_id AND b.obs_date = CAST(a.obs_date - INTERVAL 1 YEAR AS DATE)
"""

AGGREGATES = {
    "billetes": "sum(o_totalprice)",
    "cuentas": "sum(o_totalprice * (o_custkey % 5 + 1))",
    "plazo": "max(o_totalprice)",
    "M2": "avg(o_totalprice)",
}


def q4_aggregates_yoy(spark, folder):
    aggregates = (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("status"), F.trunc("o_orderdate", "month").alias("date")
        )
        .agg(*(F.expr(e).alias(n) for n, e in AGGREGATES.items()))
    )
    grown = monetary.aggregates_yoy(aggregates, list(AGGREGATES), by=["status"])
    return rounded(grown, {n: 9 for n in AGGREGATES})


_q4_aggs = ", ".join(f"{e} AS {n}" for n, e in AGGREGATES.items())
_q4_out = ", ".join(f"round(a.{n} / nullif(b.{n}, 0) - 1, 9) AS {n}" for n in AGGREGATES)
Q4_SQL = f"""
WITH aggregates AS (
  SELECT o_orderstatus AS status, CAST(date_trunc('month', o_orderdate) AS DATE) AS date, {_q4_aggs}
  FROM orders GROUP BY 1, 2)
SELECT a.status, a.date, {_q4_out}
FROM aggregates a JOIN aggregates b
  ON b.status = a.status AND b.date = CAST(a.date - INTERVAL 1 YEAR AS DATE)
"""


# --- real money and its seasonal adjustment --------------------------------------------------


def _price_level(spark, folder):
    return (
        table(spark, folder, "lineitem")
        .groupBy(F.trunc("l_shipdate", "month").alias("date"))
        .agg((F.avg("l_extendedprice") / 1000).alias("nacionalNivelGeneral"))
    )


PRICE_LEVEL_SQL = """
level AS (
  SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS date,
         avg(l_extendedprice) / 1000 AS "nacionalNivelGeneral" FROM lineitem GROUP BY 1)
"""


def q5_real_money(spark, folder):
    money = (
        table(spark, folder, "orders")
        .groupBy(F.trunc("o_orderdate", "month").alias("date"))
        .agg((F.sum("o_totalprice") / 1e6).alias("M2"))
    )
    real = prices.real_money(money, _price_level(spark, folder))
    return rounded(real, {"M2": 6, "nacionalNivelGeneral": 6, "M2Real": 6})


Q5_SQL = f"""
WITH {PRICE_LEVEL_SQL},
money AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, sum(o_totalprice) / 1e6 AS "M2"
  FROM orders GROUP BY 1)
SELECT date, round("M2", 6) AS "M2", round("nacionalNivelGeneral", 6) AS "nacionalNivelGeneral",
       round("M2" / nullif("nacionalNivelGeneral", 0), 6) AS "M2Real"
FROM money JOIN level USING (date)
"""


def w7_seasonal(spark, folder):
    levels = _price_level(spark, folder)
    joined = joins.on_date(monthly(spark, folder).withColumnRenamed("obs_date", "date"), levels)
    real = joined.select(
        "series_id",
        "date",
        F.try_divide(F.col("value"), F.col("nacionalNivelGeneral") * 1000).alias("M2Real"),
    )
    adjusted = monetary.adjusted_real_money(real, ["series_id"])
    return rounded(adjusted, {"M2Real": 4, "trend": 4, "seasonal": 6, "adjusted": 4})


W7_SQL = f"""
WITH {MONTHLY_SQL}, {PRICE_LEVEL_SQL},
real AS (
  SELECT series_id, date, value / nullif("nacionalNivelGeneral" * 1000, 0) AS x
  FROM monthly m JOIN level l ON l.date = m.obs_date),
spine AS (
  SELECT series_id, CAST(unnest(generate_series(min(date), (SELECT max(date) FROM real),
         INTERVAL 1 MONTH)) AS DATE) AS date FROM real GROUP BY series_id),
dense AS (SELECT s.series_id, s.date, r.x FROM spine s LEFT JOIN real r
          ON r.series_id = s.series_id AND r.date = s.date),
trended AS (
  SELECT *, CASE WHEN count(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
    (avg(x) OVER (w ROWS BETWEEN 6 PRECEDING AND 5 FOLLOWING)
     + avg(x) OVER (w ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)) / 2 END AS trend
  FROM dense WINDOW w AS (PARTITION BY series_id ORDER BY date)),
factors AS (
  SELECT series_id, month(date) AS moy, avg(x / nullif(trend, 0)) AS f FROM trended GROUP BY 1, 2),
scaled AS (SELECT series_id, moy, f / avg(f) OVER (PARTITION BY series_id) AS seasonal FROM factors)
SELECT t.series_id, t.date, round(x, 4) AS "M2Real", round(trend, 4) AS trend,
       round(seasonal, 6) AS seasonal, round(x / nullif(seasonal, 0), 4) AS adjusted
FROM trended t JOIN scaled s ON s.series_id = t.series_id AND s.moy = month(t.date)
"""


def w7_filters(spark, folder):
    """Iterated seasonal filters over the monthly totals of each priority, with every part of the result."""
    found = series.filtered_adjustment(
        series.densified(monthly(spark, folder), ["series_id"], "obs_date", ["value"], step="month", carry=False), ["series_id"], "obs_date", "value"
    )
    return rounded(found, {"value": 2, "weight": 5, "seasonal": 6, "adjusted": 2, "trend": 2, "irregular": 6})


def _weighted_sql(value: str, window: str, weights, share: str = "1") -> str:
    counted = f"CASE WHEN {value} IS NOT NULL THEN ({share})::DOUBLE END"

    def at(column: str, j: int) -> str:
        return f"coalesce({column}, 0)" if j == 0 else f"coalesce({'lead' if j > 0 else 'lag'}({column}, {abs(j)}) OVER {window}, 0)"

    top = " + ".join(f"{at(f'{value} * {counted}', j)} * {w!r}::DOUBLE" for j, w in weights.items())
    held = " + ".join(f"{at(counted, j)} * {w!r}::DOUBLE" for j, w in weights.items())
    return f"({top}) / nullif({held}, 0)"


def _filters_sql() -> str:
    """The same steps, one table each."""
    year, along = "(PARTITION BY series_id, month(obs_date) ORDER BY obs_date)", "(PARTITION BY series_id ORDER BY obs_date)"
    # fixed values: the published weights of the four filters
    h13 = (-0.01935, -0.02786, 0.0, 0.06549, 0.14736, 0.21434, 0.24006)
    henderson = series.henderson_weights()
    if any(abs(henderson[j] - h13[6 - abs(j)]) > 6e-6 for j in henderson):
        raise ValueError("not the published Henderson weights")
    m212 = {j: (1 if abs(j) == 6 else 2) / 24 for j in range(-6, 7)}
    m33 = dict(zip(range(-2, 3), (1 / 9, 2 / 9, 3 / 9, 2 / 9, 1 / 9)))
    m35 = dict(zip(range(-3, 4), (1 / 15, 2 / 15, 3 / 15, 3 / 15, 3 / 15, 2 / 15, 1 / 15)))
    steps, last = [], "dense"

    def step(column: str, expression: str) -> None:
        nonlocal last
        name = f"s{len(steps)}"
        made = f"* REPLACE ({expression} AS {column})" if column in seen else f"*, {expression} AS {column}"
        steps.append(f"{name} AS (SELECT {made} FROM {last})")
        seen.add(column)
        last = name

    seen: set[str] = set()

    def factors(weights, name: str) -> None:
        step("smooth", f"coalesce({_weighted_sql('raw', year, weights, 'weight')}, {_weighted_sql('raw', year, weights)})" if weights
             else "median(raw) OVER (PARTITION BY series_id, month(obs_date))")
        step(name, f"smooth / nullif({_weighted_sql('smooth', along, m212)}, 0)")

    def graded() -> None:
        step("off", "abs(raw / nullif(factor, 0) - 1)")
        step("sigma", "1.4826 * median(off) OVER (PARTITION BY series_id)")
        step("weight", "coalesce(CASE WHEN sigma = 0 THEN 1 WHEN sigma > 0 AND off IS NOT NULL THEN greatest(0, least(1, (2.5 * sigma - off) / sigma)) END, 1)::DOUBLE")

    def first_ratios(source: str) -> None:
        step("plain", source)
        step("first", f"CASE WHEN count(value) OVER (PARTITION BY series_id ORDER BY obs_date ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN {_weighted_sql('plain', along, m212)} END")
        step("raw", "value / nullif(first, 0)")

    replaced = "coalesce(weight * value + (1 - weight) * first * factor, value)"
    first_ratios("value")
    factors(None, "factor")
    graded()
    first_ratios(replaced)
    factors(m33, "factor")
    graded()
    factors(m33, "factor")
    step("plain", f"({replaced}) / nullif(factor, 0)")
    step("second", _weighted_sql("plain", along, henderson))
    step("raw", "value / nullif(second, 0)")
    factors(m35, "factor")
    graded()
    factors(m35, "seasonal")
    step("adjusted", "value / nullif(seasonal, 0)")
    step("plain", "coalesce(weight * adjusted + (1 - weight) * second, adjusted)")
    step("trend", _weighted_sql("plain", along, henderson))
    return f"""
WITH {MONTHLY_SQL},
spine AS (
  SELECT series_id, CAST(unnest(generate_series(CAST(min(obs_date) AS TIMESTAMP), (SELECT CAST(max(obs_date) AS TIMESTAMP) FROM monthly),
         INTERVAL 1 MONTH)) AS DATE) AS obs_date FROM monthly GROUP BY series_id),
dense AS (SELECT s.series_id, s.obs_date, m.value FROM spine s LEFT JOIN monthly m ON m.series_id = s.series_id AND m.obs_date = s.obs_date),
{", ".join(steps)}
SELECT series_id, obs_date, round(value, 2) AS value, round(weight, 5) AS weight, round(seasonal, 6) AS seasonal,
  round(adjusted, 2) AS adjusted, round(trend, 2) AS trend, round(adjusted / nullif(trend, 0), 6) AS irregular FROM {last}
"""


W7_FILTERS_SQL = _filters_sql()


def x4_per_series(spark, folder):
    """Centred 13-month mean of each series."""
    found = series.centred_mean(monthly(spark, folder), ["series_id"], "obs_date", "value", "smooth")
    return rounded(found, {"value": 2, "smooth": 2})


X4_SQL = f"""
WITH {MONTHLY_SQL}
SELECT series_id, obs_date, round(value, 2) AS value,
  round(CASE WHEN count(*) OVER w = 13 THEN avg(value) OVER w END, 2) AS smooth
FROM monthly WINDOW w AS (PARTITION BY series_id ORDER BY obs_date
                          ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING)
"""



def d10_as_of(spark, folder):
    """Three releases of one history, as known in mid-March: the second restates most series, the third comes too late."""
    rows = monthly(spark, folder)
    release = lambda df, day, factor: df.select(
        "series_id", "obs_date", (F.col("value") * factor).alias("value"), F.lit(day).cast("date").alias("vintage_date")
    )
    landed = (
        release(rows, "2024-01-31", 1)
        .union(release(rows.filter("series_id <> '1-URGENT' AND month(obs_date) % 2 = 0"), "2024-02-29", 2))
        .union(release(rows, "2024-03-31", 3))
    )
    return rounded(series.as_of(landed, ["series_id"], "obs_date", "vintage_date", "2024-03-15", ["value"]), {"value": 2})


D10_SQL = f"""
WITH {MONTHLY_SQL},
landed AS (
  SELECT *, DATE '2024-01-31' AS vintage_date FROM monthly
  UNION ALL SELECT series_id, obs_date, value * 2, DATE '2024-02-29' FROM monthly WHERE series_id <> '1-URGENT' AND month(obs_date) % 2 = 0
  UNION ALL SELECT series_id, obs_date, value * 3, DATE '2024-03-31' FROM monthly)
SELECT series_id, obs_date, vintage_date, round(value, 2) AS value FROM landed WHERE vintage_date <= DATE '2024-03-15'
QUALIFY row_number() OVER (PARTITION BY series_id, obs_date ORDER BY vintage_date DESC) = 1
"""

# --- consolidated rate ------------------------------------------------------------------------

SPOT_OF = {"click": "CCL", "view": "CCL3", "purchase": "CCL2", "error": "CCL1", "signup": "MEP"}


def a5_consolidated(spark, folder):
    """Quotes per user and day, one per kind; ``signup`` plays a kind to be left out."""
    kind = F.coalesce(*(F.when(F.col("event_type") == e, s) for e, s in SPOT_OF.items()))
    spots = (
        table(spark, folder, "events")
        .groupBy("user_id", F.to_date("ts").alias("dateTime"), kind.alias("spot"))
        .agg(F.avg("value").alias("normalizedPrice"))
    )
    return rounded(exchange.consolidated_rate(spots, by=["user_id"]), {"ccl": 6, "ccl3": 6})


A5_SQL = """
WITH kinds AS (
  SELECT user_id, CAST(ts AS DATE) AS date,
    avg(CASE WHEN event_type = 'click' THEN value END) AS a,
    avg(CASE WHEN event_type = 'view' THEN value END) AS b,
    avg(CASE WHEN event_type = 'purchase' THEN value END) AS c,
    avg(CASE WHEN event_type = 'error' THEN value END) AS d
  FROM events WHERE event_type <> 'signup' GROUP BY 1, 2)
SELECT user_id, date, round(coalesce(a, b, c, d), 6) AS ccl, round(b, 6) AS ccl3 FROM kinds
"""


def f13_incremental(spark, folder):
    """New rows per priority; one priority has nothing stored yet and starts at a floor."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("date")
    )
    stored = orders.filter(
        (F.col("date") < "1998-07-01") & (F.col("o_orderpriority") != "5-LOW")
    )
    return filters.newer_than(orders, stored, "date", ["o_orderpriority"], floor="1997-01-01")


F13_SQL = """
WITH stored AS (
  SELECT o_orderpriority AS p, max(CAST(o_orderdate AS DATE)) AS newest FROM orders
  WHERE o_orderdate < DATE '1998-07-01' AND o_orderpriority <> '5-LOW' GROUP BY 1)
SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS date
FROM orders LEFT JOIN stored ON p = o_orderpriority
WHERE CAST(o_orderdate AS DATE) > coalesce(newest, DATE '1997-01-01')
"""


def j5_scalar_newer(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey", F.to_date("o_orderdate").alias("date")
    )
    stored = orders.filter(F.col("date") < "1999-03-01")
    return filters.newer_than(orders, stored, "date")


J5_SQL = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders
WHERE CAST(o_orderdate AS DATE) >
  (SELECT max(CAST(o_orderdate AS DATE)) FROM orders WHERE o_orderdate < DATE '1999-03-01')
"""


def j6_combine_tables(spark, folder):
    """Clicks first, the other events where a user has no click that day."""
    per_day = lambda clicks: (
        table(spark, folder, "events")
        .filter((F.col("event_type") == "click") == F.lit(clicks))
        .groupBy("user_id", F.to_date("ts").alias("date"))
        .agg(F.avg("value").alias("value"))
    )
    both = joins.combine_first(per_day(True), per_day(False), ["user_id", "date"], ["value"])
    return rounded(both, {"value": 6})


J6_SQL = """
WITH c AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS v FROM events
           WHERE event_type = 'click' GROUP BY 1, 2),
     v AS (SELECT user_id, CAST(ts AS DATE) AS date, avg(value) AS v FROM events
           WHERE event_type <> 'click' GROUP BY 1, 2)
SELECT coalesce(c.user_id, v.user_id) AS user_id, coalesce(c.date, v.date) AS date,
       round(coalesce(c.v, v.v), 6) AS value
FROM c FULL JOIN v ON c.user_id = v.user_id AND c.date = v.date
"""

QUERIES = {
    "w6_compound": (w6_compound, _compound_sql()),
    "w2_ffill": (w2_ffill, FFILL_SQL),
    "j4_calendar_join": (j4_calendar_join, FFILL_SQL),
    "d9_windows": (d9_windows, D9_SQL),
    "w3_long_scan": (w3_long_scan, W3_LONG_SQL),
    "w1_long_change": (w1_long_change, W1_LONG_SQL),
    "w1_pct_change": (w1_pct_change, W1_SQL),
    "p8_named_variations": (p8_named_variations, _p8_sql()),
    "w4_ordinal": (w4_ordinal, W4_SQL),
    "w5_yoy": (w5_yoy, W5_SQL),
    "q4_aggregates_yoy": (q4_aggregates_yoy, Q4_SQL),
    "q5_real_money": (q5_real_money, Q5_SQL),
    "w7_seasonal": (w7_seasonal, W7_SQL),
    "d10_as_of": (d10_as_of, D10_SQL),
    "w7_filters": (w7_filters, W7_FILTERS_SQL),
    "x4_per_series": (x4_per_series, X4_SQL),
    "a5_consolidated": (a5_consolidated, A5_SQL),
    "f13_incremental": (f13_incremental, F13_SQL),
    "j5_scalar_newer": (j5_scalar_newer, J5_SQL),
    "j6_combine_tables": (j6_combine_tables, J6_SQL),
}
