"""Load modes, snapshots, catalog reads, text files, the incremental stream.

Each query writes to a fresh folder below the session's shared folder and returns the
stored table as read back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.functions import dates
from serieslake.operators import keys, load, series
from serieslake.plans import exchange, ledger, monetary, prices, repo
from serieslake.session import scratch_path
from serieslake.sources import delimited, tables
from serieslake.streaming import stream_append_new
from standins.common import DAILY_SQL, daily, table, whole
from standins.sheets import DAY, TOTAL, daily_balance_rows, ledger_rows


def _orders(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        F.to_date("o_orderdate").alias("date"),
        F.col("o_totalprice").alias("monto"),
        F.col("o_orderpriority").alias("prioridad"),
    )


_COLUMNS = f"o_orderkey, {DAY} AS date, o_totalprice AS monto, o_orderpriority AS prioridad"


def s7_append(spark, folder):
    """Two batches into one table, partitioned by priority."""
    orders, path = _orders(spark, folder), scratch_path(spark, "append")
    load.load(orders.filter("date < '1998-01-01'"), path, "append", partition_by=["prioridad"])
    load.load(orders.filter("date >= '1998-01-01'"), path, "append", partition_by=["prioridad"])
    return load.read(spark, path)


S7_SQL = f"SELECT {_COLUMNS} FROM orders"


def s8_overwrite(spark, folder):
    """A restated history takes the place of the first one."""
    orders, path = _orders(spark, folder), scratch_path(spark, "overwrite")
    load.load(orders, path, "overwrite")
    load.load(orders.filter("o_orderkey % 2 = 0").withColumn("monto", F.col("monto") * 2), path, "overwrite")
    return load.read(spark, path)


S8_SQL = f"""
SELECT o_orderkey, {DAY} AS date, o_totalprice * 2 AS monto, o_orderpriority AS prioridad
FROM orders WHERE o_orderkey % 2 = 0
"""


def s9_truncate_append(spark, folder):
    """The ledger job: a good batch, then a bad one that must change nothing."""
    path = scratch_path(spark, "ledger")
    balance = ledger.exchange_balance(ledger_rows(spark, folder)).select("mes", "anexo", "monto_usd")
    ledger.store_exchange_balance(balance, path)
    bad = balance.withColumn("mes", F.when(F.col("anexo") != "P", F.col("mes")))
    try:
        ledger.store_exchange_balance(bad, path)
    except ValueError:
        pass
    return load.read(spark, path)


S9_SQL = f"""
SELECT {DAY} AS mes, o_orderstatus AS anexo,
  CASE WHEN o_orderkey % 23 <> 0 THEN CAST({TOTAL} AS DOUBLE) END AS monto_usd FROM orders
"""


def s10_replace_slice(spark, folder):
    """Daily balances of all years, then 1999 on replaced by restated rows; the last year
    of the new batch is 2000, so the stored 2001 must go."""
    path = scratch_path(spark, "balance")
    balance = monetary.daily_balance(daily_balance_rows(spark, folder), current_year=1995).select(
        "workbook", "date", "tipoCambio"
    )
    monetary.store_daily_balance(balance, path, 1995)
    restated = (
        table(spark, folder, "orders")
        .filter(F.year("o_orderdate").between(1999, 2000))
        .select(
            F.col("o_custkey").cast("string").alias("workbook"),
            F.to_date("o_orderdate").alias("date"),
            (whole("o_totalprice") + 35).cast("double").alias("tipoCambio"),
        )
    )
    monetary.store_daily_balance(restated, path, 1999)
    monetary.store_daily_balance(restated, path, 1999)
    return load.read(spark, path)


S10_SQL = f"""
SELECT CAST(o_custkey AS VARCHAR) AS workbook, {DAY} AS date,
  CAST({TOTAL} + 34 + CASE WHEN year(o_orderdate) >= 1999 THEN 1 ELSE 0 END AS DOUBLE) AS "tipoCambio",
  CAST(year(o_orderdate) AS INTEGER) AS year
FROM orders WHERE year(o_orderdate) < 2001
"""


def s11_bulk_insert(spark, folder):
    """Insert, replace, insert again: the first rows are gone."""
    orders, path = _orders(spark, folder), scratch_path(spark, "bulk")
    load.insert_many(orders.withColumn("monto", F.lit(0.0)), path)
    load.insert_many(orders.filter("prioridad <= '2-HIGH'"), path, replace=True)
    load.insert_many(orders.filter("prioridad > '2-HIGH'"), path)
    return load.read(spark, path)


S11_SQL = f"SELECT {_COLUMNS} FROM orders"


def s10_replace_day(spark, folder):
    """All days are stored, one is restated twice; an empty batch changes nothing."""
    path = scratch_path(spark, "days")
    orders = table(spark, folder, "orders").groupBy(F.to_date("o_orderdate").alias("date")).agg(
        F.sum(whole("o_totalprice")).alias("monto")
    )
    load.append(orders, path, ["date"])
    restated = orders.filter("date = '1995-03-15'").withColumn("monto", F.col("monto") + 1)
    for _ in range(2):
        load.load(restated, path, "replace_day", day="1995-03-15")
    try:
        load.load(restated.limit(0), path, "replace_day", day="1995-03-16")
    except ValueError:
        pass
    return load.read(spark, path)


S10_DAY_SQL = f"""
SELECT {DAY} AS date, CAST(sum({TOTAL}) + CASE WHEN {DAY} = DATE '1995-03-15' THEN 1 ELSE 0 END AS BIGINT) AS monto
FROM orders GROUP BY 1
"""


def f13_first_load_floor(spark, folder):
    """The first load of a table obeys the floor and leaves rows without a date out."""
    path = scratch_path(spark, "floor")
    orders = _orders(spark, folder).withColumn("date", F.when(F.col("o_orderkey") % 5 != 0, F.col("date")))
    load.load(orders, path, "append_new", floor="1995-01-01")
    return load.read(spark, path)


F13_FLOOR_SQL = f"SELECT {_COLUMNS} FROM orders WHERE o_orderkey % 5 <> 0 AND {DAY} > DATE '1995-01-01'"


def s12_create_table(spark, folder):
    """An empty series table made from a frame's columns, then filled."""
    path = scratch_path(spark, "created")
    totals = (
        table(spark, folder, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.max("o_totalprice").alias("mayor"), F.min("o_totalprice").alias("menor"))
    )
    schema = load.table_schema(totals)
    created = load.create_if_absent(spark, path, schema)
    again = load.create_if_absent(spark, path, schema)
    load.append(totals, path)
    stored = load.read(spark, path)
    return stored.select("*", F.lit(created).alias("created"), F.lit(again).alias("created_again"))


S12_SQL = f"""
SELECT {DAY} AS date, max(o_totalprice) AS mayor, min(o_totalprice) AS menor, true AS created,
  false AS created_again FROM orders GROUP BY 1
"""


def s16_single_row(spark, folder):
    """One-row insert: the newest order joins the table of all others."""
    orders, path = _orders(spark, folder), scratch_path(spark, "single")
    newest = orders.agg(F.max_by(F.struct(*orders.columns), F.struct("date", "o_orderkey")).alias("r")).select("r.*")
    load.append(orders.join(newest.select("o_orderkey"), "o_orderkey", "left_anti").select(*orders.columns), path)
    load.append(newest, path)
    return load.read(spark, path)


S16_SQL = f"SELECT {_COLUMNS} FROM orders"


def s13_snapshot(spark, folder):
    """Dated CSV export, read back; an empty table gives none."""
    target = scratch_path(spark, "snapshot")
    orders = _orders(spark, folder)
    load.export_snapshot(orders, target, "2024-05-31")
    load.export_snapshot(orders.filter("monto < 0"), target, "2024-06-01")
    back = spark.read.schema(
        "o_orderkey bigint, date date, monto double, prioridad string, snapshot_date date"
    ).option("header", True).csv(target)
    return back


S13_SQL = f"SELECT {_COLUMNS}, DATE '2024-05-31' AS snapshot_date FROM orders"


def a4_load_counts(spark, folder):
    """Rows reported by each load, counted while writing; a rerun reports none."""
    orders, path = _orders(spark, folder), scratch_path(spark, "counts")
    early = orders.filter("date < '1998-01-01'")
    results = [
        load.load(early, path, "append_new"),
        load.load(orders, path, "append_new"),
        load.load(orders, path, "append_new"),
    ]
    stored = load.read(spark, path)
    return stored.agg(
        F.count(F.lit(1)).alias("stored_rows"),
        *(F.lit(r.rows).cast("bigint").alias(f"load_{i}") for i, r in enumerate(results, start=1)),
    )


A4_SQL = """
WITH c AS (SELECT count(*) FILTER (WHERE o_orderdate < DATE '1998-01-01') AS a, count(*) AS n,
  count(*) FILTER (WHERE o_orderdate >= DATE '1998-01-01') AS b FROM orders)
SELECT n AS stored_rows, a AS load_1, b AS load_2, CAST(0 AS BIGINT) AS load_3 FROM c
"""


def a4_load_log(spark, folder):
    """The log of two loads and a refused one."""
    orders, path = _orders(spark, folder), scratch_path(spark, "logged")
    load.load(orders.filter("date < '1998-01-01'"), path, "append_new", job="orders_daily")
    load.load(orders, path, "append_new", job="orders_daily")
    try:
        rules = {"early": F.col("date") < "1999-01-01", "no priority": F.col("prioridad").isNull()}
        load.load(orders, path, "truncate_append", rules=rules, job="orders_restated")
    except ValueError:
        pass
    log = load.load_log(spark, path)
    return log.select("job", "mode", "rows", "version", "refused", F.col("broken")["early"].alias("early"), F.get(F.map_keys("broken"), F.lit(0)).alias("rule"))


A4_LOG_SQL = """
WITH c AS (SELECT count(*) FILTER (WHERE o_orderdate < DATE '1998-01-01') AS a, count(*) AS n,
  count(*) FILTER (WHERE o_orderdate < DATE '1999-01-01') AS early FROM orders)
SELECT 'orders_daily' AS job, 'append_new' AS mode, a AS rows, CAST(1 AS BIGINT) AS version, false AS refused,
  CAST(NULL AS BIGINT) AS early, CAST(NULL AS VARCHAR) AS rule FROM c
UNION ALL SELECT 'orders_daily', 'append_new', n - a, 2, false, NULL, NULL FROM c
UNION ALL SELECT 'orders_restated', 'truncate_append', n, 2, true, early, 'early' FROM c
"""


def s14_new_keys(spark, folder):
    """A batch of one year, some of its keys stored already; only that year's folder is looked at."""
    orders, path = _orders(spark, folder).withColumn("year", F.year("date")), scratch_path(spark, "keyed")
    load.load(orders, path, "append", partition_by=["year"])
    repeated = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_orderkey")).otherwise(-1 - F.col("o_orderkey"))
    batch = orders.filter("year = 1997").withColumn("o_orderkey", repeated)
    return keys.stored_keys(batch, path, ["o_orderkey", "date"], "year")


S14_KEYS_SQL = f"SELECT o_orderkey, {DAY} AS date FROM orders WHERE year(o_orderdate) = 1997 AND o_orderkey % 97 = 0"


def s15_get_table(spark, folder):
    """A stored table found through the catalog, one frequency, dates as text."""
    path, name = scratch_path(spark, "eventos"), f"eventos_{uuid.uuid4().hex}"
    (
        table(spark, folder, "events")
        .select(
            (
                dates.to_epoch_seconds(F.to_date("ts")) + F.hour("ts") * 3600 + F.minute("ts") * 60
            ).alias("date"),
            "event_id",
            "value",
            F.when(F.col("event_type") == "click", "D").otherwise("M").alias("tipoSerie"),
        )
        .write.parquet(path)
    )
    spark.catalog.createTable(name, path=path, source="parquet")
    spark.createDataFrame([(name, spark.catalog.currentDatabase())], "name string, db string").createOrReplaceTempView(
        "series_tables"
    )
    return tables.get_table(spark, name, "D", catalog="series_tables")


S15_SQL = """
SELECT strftime(ts, '%Y-%m-%d') AS date, event_id, value, 'D' AS "tipoSerie"
FROM events WHERE event_type = 'click'
"""

# --- text files ------------------------------------------------------------------------------------


def s2_delimited(spark, folder):
    """Comma-separated file with a declared schema; a bad field is null, not an error."""
    path = scratch_path(spark, "comma")
    (
        table(spark, folder, "orders")
        .select(
            "o_orderkey",
            F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
            F.when(F.col("o_orderkey") % 9 == 0, "s/d")
            .otherwise(F.col("o_totalprice").cast("string"))
            .alias("monto"),
            F.concat(F.lit('con "comillas", y coma '), "o_orderstatus").alias("nota"),
        )
        .write.option("header", True).option("escape", '"').csv(path)
    )
    schema = "o_orderkey bigint, date date, monto double, nota string"
    return delimited.read(spark, path, schema, escape='"')


S2_SQL = f"""
SELECT o_orderkey, {DAY} AS date, CASE WHEN o_orderkey % 9 <> 0 THEN o_totalprice END AS monto,
  'con "comillas", y coma ' || o_orderstatus AS nota FROM orders
"""


def q20_csv_import(spark, folder):
    """Semicolon history with ``dd/MM/yy`` dates, into an overwritten table."""
    source, path = scratch_path(spark, "semicolon"), scratch_path(spark, "ccl")
    (
        table(spark, folder, "events")
        .select(
            F.date_format("ts", "dd/MM/yy").alias("date"),
            F.col("value").alias("ccl"),
            F.when(F.col("event_id") % 2 == 0, F.col("value") * 2).alias("ccl3"),
        )
        .write.option("header", True).option("sep", ";").csv(source)
    )
    history = exchange.rate_from_csv(spark, source, ["date", "ccl", "ccl3"])
    load.load(history, path, "overwrite")
    return load.read(spark, path)


Q20_SQL = """
SELECT CAST(ts AS DATE) AS date, value AS ccl, CASE WHEN event_id % 2 = 0 THEN value * 2 END AS ccl3
FROM events
"""


def q17_select_series(spark, folder):
    """A tab-separated price file with padded ids; one series is kept."""
    source, path = scratch_path(spark, "tabs"), scratch_path(spark, "uscpi")
    (
        table(spark, folder, "part")
        .select(
            F.rpad("p_brand", 17, " ").alias("series_id       "),
            (F.lit(1990) + F.col("p_size") % 30).alias("year"),
            F.concat(F.lit("M"), F.lpad((F.col("p_partkey") % 12 + 1).cast("string"), 2, "0")).alias("period"),
            F.col("p_retailprice").alias("value"),
            F.lit("").alias("footnote_codes"),
        )
        .write.option("header", True).option("sep", "\t")
        .option("ignoreTrailingWhiteSpace", False).option("ignoreLeadingWhiteSpace", False)
        .option("emptyValue", "").csv(source)
    )
    chosen = prices.us_prices(spark, source, "Brand#7")
    load.load(chosen, path, "overwrite", minimum_rows=1)
    return load.read(spark, path)


Q17_SQL = """
SELECT p_brand AS series_id, CAST(1990 + p_size % 30 AS INTEGER) AS year,
  'M' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') AS period, p_retailprice AS value,
  NULL::VARCHAR AS footnote_codes
FROM part WHERE p_brand = 'Brand#7'
"""

# --- stream ------------------------------------------------------------------------------------------


def x1_stream(spark, folder):
    """Two rounds of landed files; the second one holds everything again, and one series
    that the first did not have."""
    landing, path = scratch_path(spark, "landing"), scratch_path(spark, "stream")
    progress = scratch_path(spark, "progress")
    rows = daily(spark, folder).select("series_id", F.col("obs_date").alias("date"), "value")
    rows.filter("date < '2024-01-15' and series_id % 5 != 0").write.mode("append").parquet(landing)
    run = lambda: stream_append_new(
        spark, landing, rows.schema, path, progress, by=["series_id"]
    )
    run()
    rows.write.mode("append").parquet(landing)
    run()
    run()
    stored = load.read(spark, path)
    return stored.select("series_id", "date", F.round("value", 6).alias("value"))


X1_SQL = f"""
WITH {DAILY_SQL}
SELECT series_id, obs_date AS date, round(value, 6) AS value FROM daily
"""


def q2_store_index(spark, folder):
    """Rates appended in two loads, the index rebuilt from the stored table and replaced."""
    quotes_path, index_path = scratch_path(spark, "rates"), scratch_path(spark, "index")
    rates = daily(spark, folder).select(
        "series_id",
        F.col("obs_date").alias("date"),
        (F.col("value") / 1000).alias("vwap"),
        (F.col("series_id") % 4).cast("int").alias("daysToMaturity"),
    )
    load.append_new(rates.filter("date < '2024-01-20'"), quotes_path)
    load.append_new(rates, quotes_path)
    stored = load.read(spark, quotes_path)
    index = series.compounded_index(stored, ["series_id"], "date", "vwap", "daysToMaturity", end="2024-02-10")
    load.overwrite(index, index_path)
    back = load.read(spark, index_path)
    return back.select("series_id", "date", F.round("ted", 9).alias("ted"), F.round("cap", 6).alias("cap"))


Q2_STORE_SQL = f"""
WITH {DAILY_SQL},
rated AS (
  SELECT series_id, obs_date AS date, CASE WHEN series_id % 4 = 0 THEN 0.0
    ELSE pow(1 + value / 1000 / 365.0 * (series_id % 4), 1.0 / (series_id % 4)) - 1 END AS ted FROM daily),
spine AS (
  SELECT series_id, CAST(unnest(generate_series(CAST(min(date) AS TIMESTAMP), TIMESTAMP '2024-02-10',
         INTERVAL 1 DAY)) AS DATE) AS date FROM rated GROUP BY series_id),
filled AS (
  SELECT s.series_id, s.date, last_value(ted IGNORE NULLS) OVER (PARTITION BY s.series_id ORDER BY s.date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ted
  FROM spine s LEFT JOIN rated r ON r.series_id = s.series_id AND r.date = s.date)
SELECT series_id, date, round(ted, 9) AS ted, round(product(ted + 1) OVER (
  PARTITION BY series_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS cap
FROM filled
"""



def q2_index_goes_on(spark, folder):
    """The index stored in four loads, each going on from the stored end; the second one is run twice."""
    path = scratch_path(spark, "index")
    rates = daily(spark, folder).select(
        "series_id",
        F.col("obs_date").alias("date"),
        (F.col("value") / 1000).alias("vwap"),
        (F.col("series_id") % 4).cast("int").alias("daysToMaturity"),
    )
    first = "2024-01-01"
    for end in ("2024-01-10", "2024-01-20", "2024-01-20", "2024-01-28", "2024-02-10"):
        new = rates.filter((F.col("date") >= first) & (F.col("date") <= end))  # what landed since the load before
        repo.extend_index(new, path, ["series_id"], end)
        first = end
    return load.read(spark, path).select("series_id", "date", F.round("ted", 9).alias("ted"), F.round("cap", 6).alias("cap"))


QUERIES = {
    "s7_append": (s7_append, S7_SQL),
    "s8_overwrite": (s8_overwrite, S8_SQL),
    "s9_truncate_append": (s9_truncate_append, S9_SQL),
    "s10_replace_slice": (s10_replace_slice, S10_SQL),
    "s10_replace_day": (s10_replace_day, S10_DAY_SQL),
    "f13_first_load_floor": (f13_first_load_floor, F13_FLOOR_SQL),
    "s11_bulk_insert": (s11_bulk_insert, S11_SQL),
    "s12_create_table": (s12_create_table, S12_SQL),
    "s13_snapshot": (s13_snapshot, S13_SQL),
    "s15_get_table": (s15_get_table, S15_SQL),
    "s16_single_row": (s16_single_row, S16_SQL),
    "a4_load_counts": (a4_load_counts, A4_SQL),
    "s14_new_keys": (s14_new_keys, S14_KEYS_SQL),
    "a4_load_log": (a4_load_log, A4_LOG_SQL),
    "s2_delimited": (s2_delimited, S2_SQL),
    "q20_csv_import": (q20_csv_import, Q20_SQL),
    "q17_select_series": (q17_select_series, Q17_SQL),
    "q2_store_index": (q2_store_index, Q2_STORE_SQL),
    "q2_index_goes_on": (q2_index_goes_on, Q2_STORE_SQL),
    "x1_stream": (x1_stream, X1_SQL),
}
