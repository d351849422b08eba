"""Projections, filters, small joins, aggregates, reshaping, unions, quality."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from serieslake.functions import dates, numbers
from serieslake.operators import filters, project, quality, reshape
from serieslake.plans import prices
from serieslake.sources import records, tables
from standins.common import table, whole

# --- projections --------------------------------------------------------------------------


def p1_positional(spark, folder):
    """Positional rename after dropping positions."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag"
    )
    kept = project.drop_positions(lines, [1, 2])
    return project.rename_all(kept, ["pedido", "renglon", "cantidad", "marca"])


P1_SQL = """
SELECT l_orderkey AS pedido, l_linenumber AS renglon, l_quantity AS cantidad, l_returnflag AS marca
FROM lineitem
"""


def p4_rename_move(spark, folder):
    """First column renamed, a late column moved to the front, labels dropped."""
    orders = table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("fecha"), "o_orderkey", "o_orderstatus", "o_totalprice"
    )
    renamed = project.rename_first(orders).drop("o_orderstatus")
    return project.with_leading(renamed, "o_totalprice", F.col("o_totalprice"))


P4_SQL = "SELECT o_totalprice, CAST(o_orderdate AS DATE) AS date, o_orderkey FROM orders"


def p5_run_date(spark, folder):
    accounts = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    return project.with_run_date(accounts, "2024-05-31")


P5_SQL = "SELECT DATE '2024-05-31' AS date, c_custkey, c_acctbal FROM customer"


def p10_declared_types(spark, folder):
    """Text columns cast to a declared schema; what does not fit becomes null."""
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"),
        F.when(F.col("o_orderkey") % 6 == 0, "n/a")
        .otherwise(whole("o_totalprice").cast("string"))
        .alias("monto"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"),
    )
    schema = T.StructType(
        [
            T.StructField("fecha", T.DateType()),
            T.StructField("id", T.LongType()),
            T.StructField("monto", T.DoubleType()),
        ]
    )
    return project.cast_to(raw, schema)


P10_SQL = """
SELECT CAST(o_orderdate AS DATE) AS fecha, o_orderkey AS id,
       CASE WHEN o_orderkey % 6 <> 0 THEN round(o_totalprice) END AS monto FROM orders
"""

# --- filters --------------------------------------------------------------------------------


def f1_key_present(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.when(F.col("l_suppkey") % 5 != 0, F.col("l_suppkey")).alias("clave"),
        "l_orderkey",
        "l_quantity",
    )
    return filters.with_key(lines, "clave")


F1_SQL = "SELECT l_suppkey AS clave, l_orderkey, l_quantity FROM lineitem WHERE l_suppkey % 5 <> 0"


def f2_complete_rows(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")).alias("cantidad"),
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_tax")).alias("tasa"),
    )
    return filters.complete(lines)


F2_SQL = """
SELECT l_orderkey, l_quantity AS cantidad, l_tax AS tasa FROM lineitem
WHERE l_partkey % 3 <> 0 AND l_suppkey % 4 <> 0
"""

RENDERED_DATE = """
CASE o_orderkey % 5 WHEN 0 THEN 'Fuente: x' WHEN 1 THEN NULL
     ELSE {date} END"""


def f3_parse_or_drop(spark, folder):
    """Dates and amounts rendered as text with junk, read back."""
    key = F.col("o_orderkey")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint").cast("string")
    raw = table(spark, folder, "orders").select(
        "o_orderkey",
        F.expr(RENDERED_DATE.format(date="date_format(o_orderdate, 'dd/MM/yyyy')")).alias("date"),
        F.when(key % 7 == 0, "s/o").when(key % 11 == 0, None).when(key % 13 == 0, "n.d.")
        .otherwise(cents).alias("amount"),
    )
    parsed = filters.parse_or_drop(raw, "date", dates.parse(F.col("date"), "dd/MM/yyyy"))
    return parsed.select(
        "o_orderkey",
        "date",
        numbers.to_number(F.col("amount")).alias("coerced"),
        numbers.placeholder_to_zero(F.col("amount")).alias("zeroed"),
    )


F3_SQL = f"""
WITH raw AS (
  SELECT o_orderkey, {RENDERED_DATE.format(date="strftime(o_orderdate, '%d/%m/%Y')")} AS d,
    CASE WHEN o_orderkey % 7 = 0 THEN 's/o' WHEN o_orderkey % 11 = 0 THEN NULL
         WHEN o_orderkey % 13 = 0 THEN 'n.d.'
         ELSE CAST(CAST(round(o_totalprice * 100) AS BIGINT) AS VARCHAR) END AS a FROM orders)
SELECT o_orderkey, CAST(try_strptime(d, '%d/%m/%Y') AS DATE) AS date,
  try_cast(a AS DOUBLE) AS coerced,
  CASE WHEN a IS NULL OR a = 's/o' THEN 0 ELSE try_cast(a AS DOUBLE) END AS zeroed
FROM raw WHERE try_strptime(d, '%d/%m/%Y') IS NOT NULL
"""


def f6_guard(spark, folder):
    """Does a user have any quote of a kind at all? The same test as data."""
    return (
        table(spark, folder, "events")
        .groupBy("user_id")
        .agg(
            F.bool_or(F.col("event_type").contains("ick")).alias("has_part"),
            F.bool_or(F.col("event_type").startswith("pur")).alias("has_prefix"),
        )
    )


F6_SQL = """
SELECT user_id, bool_or(contains(event_type, 'ick')) AS has_part,
       bool_or(starts_with(event_type, 'pur')) AS has_prefix FROM events GROUP BY 1
"""


def f10_year_clamp(spark, folder):
    """Each customer's orders up to the end of the year of the first order."""
    orders = table(spark, folder, "orders").select(
        "o_custkey", "o_orderkey", F.to_date("o_orderdate").alias("date")
    )
    return filters.up_to_first_year(orders, ["o_custkey"], "o_orderkey", "date")


F10_SQL = """
WITH firsts AS (
  SELECT o_custkey AS c, year(arg_min(o_orderdate, o_orderkey)) AS y FROM orders GROUP BY 1)
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS date
FROM orders JOIN firsts ON c = o_custkey
WHERE CAST(o_orderdate AS DATE) <= make_date(y, 12, 31)
"""


def f12_batch_gate(spark, folder):
    """Violations per rule over the whole batch, in one pass."""
    orders = table(spark, folder, "orders")
    return quality.rule_counts(
        orders,
        {
            "after 2001-01": F.col("o_orderdate") > F.lit("2001-01-31").cast("timestamp_ntz"),
            "cheap": F.col("o_totalprice") < 5000,
            "no priority": F.col("o_orderpriority").isNull(),
        },
        minimum_rows=1000,
    )


F12_SQL = """
WITH c AS (
  SELECT count(*) AS n, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '2001-01-31') AS a,
    count(*) FILTER (WHERE o_totalprice < 5000) AS b,
    count(*) FILTER (WHERE o_orderpriority IS NULL) AS d FROM orders)
SELECT 'too_few_rows' AS rule, CAST(CASE WHEN n < 1000 THEN 1 ELSE 0 END AS BIGINT) AS violations FROM c
UNION ALL SELECT 'after 2001-01', a FROM c UNION ALL SELECT 'cheap', b FROM c
UNION ALL SELECT 'no priority', d FROM c
"""

# --- joins and aggregates ---------------------------------------------------------------------


def j1_last_dates(spark, folder):
    """Every customer with the day after its last order, if it has any."""
    last = (
        table(spark, folder, "orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(dates.next_day(F.max(F.to_date("o_orderdate"))).alias("next_date"))
    )
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return customers.join(last, "c_custkey", "left")


J1_SQL = """
SELECT c_custkey, c_mktsegment, CAST(max(o_orderdate) + INTERVAL 1 DAY AS DATE) AS next_date
FROM customer LEFT JOIN orders ON o_custkey = c_custkey
GROUP BY 1, 2
"""


def a2_next_request(spark, folder):
    """Tickers of a group with the next date to ask for; errors play matured rows."""
    tickers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ticker"),
        F.col("c_name").alias("type"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "MACHINERY"), prices.TICKER_GROUP)
        .otherwise("otros")
        .alias("nombre"),
    )
    stored = table(spark, folder, "events").select(
        F.col("user_id").alias("ticker"),
        F.to_date("ts").alias("date"),
        (F.col("event_type") == "error").alias("matured"),
    )
    return prices.refresh_plan(tickers, stored)


A2_SQL = """
SELECT c_custkey AS ticker, c_name AS type, CAST(max(CAST(ts AS DATE)) + INTERVAL 1 DAY AS DATE) AS date
FROM customer JOIN events ON user_id = c_custkey
WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND event_type <> 'error'
GROUP BY 1, 2
"""


def a1_extremes(spark, folder):
    """Newest and oldest stored date and the row count, whole table."""
    return table(spark, folder, "events").agg(
        F.max(F.to_date("ts")).alias("newest"),
        F.min(F.to_date("ts")).alias("oldest"),
        F.count(F.lit(1)).alias("stored_rows"),
    )


A1_SQL = """
SELECT CAST(max(ts) AS DATE) AS newest, CAST(min(ts) AS DATE) AS oldest, count(*) AS stored_rows
FROM events
"""


def a3_request_window(spark, folder):
    """From the day after the newest stored date up to the run date, day by day."""
    stored = table(spark, folder, "orders").select(F.to_date("o_orderdate").alias("date"))
    return prices.daily_requests(stored, "2001-12-31")


A3_SQL = """
SELECT CAST(d AS DATE) AS date_from, CAST(d AS DATE) AS date_to FROM (
  SELECT unnest(generate_series(max(o_orderdate) + INTERVAL 1 DAY, TIMESTAMP '2001-12-31',
                                INTERVAL 1 DAY)) AS d FROM orders)
"""

# --- reshape and unions -------------------------------------------------------------------------

MEASURES = ["cantidad", "precio", "renglones"]


def a6_unpivot(spark, folder):
    wide = (
        table(spark, folder, "lineitem")
        .groupBy("l_returnflag", F.trunc("l_shipdate", "month").alias("obs_date"))
        .agg(
            F.sum(whole("l_quantity")).cast("double").alias("cantidad"),
            F.sum(whole("l_extendedprice")).cast("double").alias("precio"),
            F.count(F.lit(1)).cast("double").alias("renglones"),
        )
    )
    return reshape.unpivot(wide, ["l_returnflag", "obs_date"], MEASURES)


A6_SQL = """
WITH wide AS (
  SELECT l_returnflag, CAST(date_trunc('month', l_shipdate) AS DATE) AS obs_date,
    CAST(sum(CAST(round(l_quantity) AS BIGINT)) AS DOUBLE) AS cantidad,
    CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) AS DOUBLE) AS precio,
    CAST(count(*) AS DOUBLE) AS renglones
  FROM lineitem GROUP BY 1, 2)
SELECT l_returnflag, obs_date, 'cantidad' AS series_id, cantidad AS value FROM wide
UNION ALL SELECT l_returnflag, obs_date, 'precio', precio FROM wide
UNION ALL SELECT l_returnflag, obs_date, 'renglones', renglones FROM wide
"""


def u1_union_all(spark, folder):
    """Like frames put under each other, whatever the column order."""
    customers = table(spark, folder, "customer").select(
        F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("saldo")
    )
    suppliers = table(spark, folder, "supplier").select(
        F.col("s_acctbal").alias("saldo"), F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")
    )
    return reshape.union_all([customers, suppliers])


U1_SQL = """
SELECT 'customer' AS kind, c_custkey AS id, c_acctbal AS saldo FROM customer
UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier
"""


def s5_paged_union(spark, folder):
    """Three kinds of pages, each with a column the others lack."""
    events = table(spark, folder, "events")
    pages = [
        events.filter(F.col("event_type") == "click").select("event_id", "user_id", "value"),
        events.filter(F.col("event_type") == "view").select("event_id", "props"),
        events.filter(~F.col("event_type").isin("click", "view")).select("event_id", "event_type"),
    ]
    return records.union_pages(pages)


S5_SQL = """
SELECT event_id, user_id, value, NULL::VARCHAR AS props, NULL::VARCHAR AS event_type
FROM events WHERE event_type = 'click'
UNION ALL SELECT event_id, NULL, NULL, props, NULL FROM events WHERE event_type = 'view'
UNION ALL SELECT event_id, NULL, NULL, NULL, event_type FROM events
WHERE event_type NOT IN ('click', 'view')
"""


def s6_sql_read(spark, folder):
    return tables.read_sql(
        spark,
        """
        SELECT n_name, count(*) AS customers, round(max(c_acctbal), 2) AS richest
        FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
        GROUP BY n_name
        """,
        customer=table(spark, folder, "customer"),
        nation=table(spark, folder, "nation"),
    )


S6_SQL = """
SELECT n_name, count(*) AS customers, round(max(c_acctbal), 2) AS richest
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name
"""


def s14_constraints(spark, folder):
    """Key and not-null violations of four tables; some columns are given nulls."""
    orders = table(spark, folder, "orders").withColumn(
        "o_orderpriority",
        F.when(F.col("o_orderkey") % 50 != 0, F.col("o_orderpriority")),
    )
    return quality.constraint_report(
        {
            "orders": (orders, ["o_orderkey"], ["o_orderdate", "o_orderpriority"]),
            "lineitem": (
                table(spark, folder, "lineitem"),
                ["l_orderkey", "l_linenumber"],
                ["l_shipdate"],
            ),
            "events": (table(spark, folder, "events"), ["user_id", "event_type"], ["value"]),
            "customer": (table(spark, folder, "customer"), ["c_custkey"], ["c_name"]),
        }
    )


def _duplicates(name: str, keys: str, source: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, 'primary key ({keys})' AS constraint_name, "
        f"(SELECT count(*) FROM (SELECT 1 FROM {source} GROUP BY {keys} HAVING count(*) > 1)) AS violations"
    )


def _nulls(name: str, column: str, condition: str, source: str) -> str:
    return (
        f"SELECT '{name}', 'not null ({column})', "
        f"(SELECT count(*) FROM {source} WHERE {condition})"
    )


S14_SQL = " UNION ALL ".join(
    [
        _duplicates("orders", "o_orderkey", "orders"),
        _nulls("orders", "o_orderdate", "o_orderdate IS NULL", "orders"),
        _nulls(
            "orders", "o_orderpriority", "o_orderkey % 50 = 0 OR o_orderpriority IS NULL", "orders"
        ),
        _duplicates("lineitem", "l_orderkey, l_linenumber", "lineitem"),
        _nulls("lineitem", "l_shipdate", "l_shipdate IS NULL", "lineitem"),
        _duplicates("events", "user_id, event_type", "events"),
        _nulls("events", "value", "value IS NULL", "events"),
        _duplicates("customer", "c_custkey", "customer"),
        _nulls("customer", "c_name", "c_name IS NULL", "customer"),
    ]
)

QUERIES = {
    "p1_positional": (p1_positional, P1_SQL),
    "p4_rename_move": (p4_rename_move, P4_SQL),
    "p5_run_date": (p5_run_date, P5_SQL),
    "p10_declared_types": (p10_declared_types, P10_SQL),
    "f1_key_present": (f1_key_present, F1_SQL),
    "f2_complete_rows": (f2_complete_rows, F2_SQL),
    "f3_parse_or_drop": (f3_parse_or_drop, F3_SQL),
    "f6_guard": (f6_guard, F6_SQL),
    "f10_year_clamp": (f10_year_clamp, F10_SQL),
    "f12_batch_gate": (f12_batch_gate, F12_SQL),
    "j1_last_dates": (j1_last_dates, J1_SQL),
    "a2_next_request": (a2_next_request, A2_SQL),
    "a1_extremes": (a1_extremes, A1_SQL),
    "a3_request_window": (a3_request_window, A3_SQL),
    "a6_unpivot": (a6_unpivot, A6_SQL),
    "u1_union_all": (u1_union_all, U1_SQL),
    "s5_paged_union": (s5_paged_union, S5_SQL),
    "s6_sql_read": (s6_sql_read, S6_SQL),
    "s14_constraints": (s14_constraints, S14_SQL),
}
