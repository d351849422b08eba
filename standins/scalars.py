"""Scalar functions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from serieslake.functions import dates, numbers, text
from serieslake.operators import project
from serieslake.plans import prices
from standins.common import table

# --- text -------------------------------------------------------------------------------------


def t1_strip(spark, folder):
    padded = table(spark, folder, "part").select(
        "p_partkey",
        F.concat(F.lit("\t  "), "p_name", F.lit(" \n")).alias("p_name"),
        F.when(F.col("p_partkey") % 9 != 0, F.concat(F.lit("  "), "p_type")).alias("p_type"),
    )
    return project.map_columns(padded, text.strip, ["p_name", "p_type"])


T1_SQL = """
SELECT p_partkey, trim(p_name) AS p_name, CASE WHEN p_partkey % 9 <> 0 THEN trim(p_type) END AS p_type
FROM part
"""


def t2_float_tail(spark, folder):
    """Numeric-looking dates, some with a ``.0`` tail, some ending in a zero."""
    rendered = F.date_format("o_orderdate", "yyyyMMdd")
    tailed = F.when(F.col("o_orderkey") % 2 == 1, F.concat(rendered, F.lit(".0"))).otherwise(rendered)
    return table(spark, folder, "orders").select(
        "o_orderkey", dates.parse(text.strip_float_tail(tailed), "yyyyMMdd").alias("date")
    )


T2_SQL = "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS date FROM orders"


def t3_clean_numbers(spark, folder):
    """Amounts rendered in both local styles and read back."""
    us_style = F.format_number("o_totalprice", 2)
    local_style = F.translate(us_style, ",.", ".,")
    key_style = F.translate(F.format_number(F.col("o_orderkey") * 977, 0), ",", ".")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        numbers.point_thousands(F.concat(F.lit("$"), local_style)).alias("by_marks"),
        numbers.implied_cents(F.concat(F.lit("$"), local_style)).alias("by_cents"),
        numbers.comma_thousands(us_style).alias("us_style"),
        numbers.whole_number(key_style).alias("whole_number"),
        numbers.digits_only(F.concat(key_style, F.lit(" kg."))).alias("digits"),
    )


T3_SQL = """
SELECT o_orderkey, o_totalprice AS by_marks, o_totalprice AS by_cents, o_totalprice AS us_style,
       CAST(o_orderkey * 977 AS DOUBLE) AS whole_number, CAST(o_orderkey * 977 AS DOUBLE) AS digits
FROM orders
"""

# --- dates --------------------------------------------------------------------------------------


def d1_formats(spark, folder):
    """One date written in every layout; the leap day and two-digit years included."""
    day = F.date_add(F.lit("2000-01-01").cast("date"), (F.col("o_orderkey") % 20000).cast("int"))
    write = lambda fmt: F.date_format(day, fmt)
    return table(spark, folder, "orders").select(
        "o_orderkey",
        dates.parse(write("dd/MM/yyyy"), "dd/MM/yyyy").alias("long_slash"),
        dates.parse(write("dd/MM/yy"), "dd/MM/yy").alias("short_slash"),
        dates.parse(write("yyyyMMdd"), "yyyyMMdd").alias("compact"),
        dates.parse(write("yyMMdd"), "yyMMdd").alias("short_compact"),
        dates.parse(write("ddMMyy"), "ddMMyy").alias("day_compact"),
        dates.parse(write("yyyy-MM-dd HH:mm:ss"), "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        dates.parse_day_first(
            F.when(F.col("o_orderkey") % 2 == 0, write("d/M/yyyy")).otherwise(write("yyyy-MM-dd"))
        ).alias("permissive"),
    )


_day = "CAST(DATE '2000-01-01' + CAST(o_orderkey % 20000 AS INTEGER) AS DATE)"
D1_SQL = "SELECT o_orderkey, " + ", ".join(
    f"{_day} AS {name}"
    for name in (
        "long_slash short_slash compact short_compact day_compact stamp permissive".split()
    )
) + " FROM orders"


def d3_serials(spark, folder):
    """Epoch seconds, epoch days and workbook serials, there and back."""
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit(dates.SERIAL_DAY_ZERO).cast("date"))
    cell = F.when(F.col("o_orderkey") % 2 == 0, serial.cast("string")).otherwise(
        F.date_format(day, "dd/MM/yyyy")
    )
    return table(spark, folder, "orders").select(
        "o_orderkey",
        dates.to_epoch_seconds(day).alias("epoch_seconds"),
        dates.from_epoch_seconds(dates.to_epoch_seconds(day) + 86399).alias("from_seconds"),
        dates.from_epoch_days(F.unix_date(day)).alias("from_days"),
        dates.from_serial(serial + 0.75).alias("from_serial"),
        dates.from_serial_or_text(cell).alias("from_cell"),
    )


D3_SQL = """
SELECT o_orderkey, CAST(epoch(o_orderdate) AS BIGINT) AS epoch_seconds,
  CAST(o_orderdate AS DATE) AS from_seconds, CAST(o_orderdate AS DATE) AS from_days,
  CAST(o_orderdate AS DATE) AS from_serial, CAST(o_orderdate AS DATE) AS from_cell
FROM orders
"""


def d6_calendar(spark, folder):
    day = F.to_date("o_orderdate")
    return table(spark, folder, "orders").select(
        "o_orderkey",
        dates.next_day(day).alias("next_day"),
        dates.year_before(day).alias("year_before"),
        dates.first_of_year(day).alias("first_of_year"),
        dates.last_of_year(day).alias("last_of_year"),
        dates.as_text(day).alias("as_text"),
        dates.vintage(day).alias("vintage"),
        dates.vintage(day, "yyyy").alias("year_vintage"),
    )


D6_SQL = """
SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 DAY AS DATE) AS next_day,
  CAST(o_orderdate - INTERVAL 1 YEAR AS DATE) AS year_before,
  CAST(date_trunc('year', o_orderdate) AS DATE) AS first_of_year,
  make_date(year(o_orderdate), 12, 31) AS last_of_year,
  strftime(o_orderdate, '%Y-%m-%d') AS as_text, strftime(o_orderdate, '%m_%y') AS vintage,
  strftime(o_orderdate, '%Y') AS year_vintage
FROM orders
"""


def d8_time_of_day(spark, folder):
    shown = F.when(F.col("event_id") % 10 == 0, "25:61:00").otherwise(
        F.date_format("ts", "HH:mm:ss")
    )
    return table(spark, folder, "events").select(
        "event_id",
        dates.time_of_day(shown).alias("hora"),
        dates.seconds_of_day(shown).alias("segundos"),
    )


D8_SQL = """
SELECT event_id, CASE WHEN event_id % 10 <> 0 THEN strftime(ts, '%H:%M:%S') END AS hora,
  CAST(CASE WHEN event_id % 10 <> 0 THEN hour(ts) * 3600 + minute(ts) * 60 + second(ts) END AS INTEGER)
    AS segundos
FROM events
"""

# --- numbers ------------------------------------------------------------------------------------


def m3_rates(spark, folder):
    """Daily effective rates (a tenor of 0 gives 0), ratios, first non-null, zero fill."""
    rate, tenor = F.col("value") / 1000, (F.col("user_id") % 8).cast("int")
    odd = F.when(F.col("event_id") % 2 == 1, F.col("value"))
    third = F.when(F.col("event_id") % 3 == 0, F.col("value") * 2)
    return table(spark, folder, "events").select(
        "event_id",
        F.round(numbers.daily_effective_rate(rate, tenor), 10).alias("ted"),
        F.round(numbers.daily_effective_rate(rate, tenor, 0.03), 10).alias("ted2"),
        F.round(numbers.deflated(F.col("value"), tenor.cast("double")), 9).alias("deflated"),
        F.round(numbers.scaled(F.col("value").cast("string"), 1000), 9).alias("scaled"),
        F.coalesce(odd, third).alias("first_present"),
        F.coalesce(odd, F.lit(0.0)).alias("zero_filled"),
        text.json_number(F.col("props"), "$.k", 0).alias("k"),
        text.json_number(F.col("props"), "$.missing", 1).alias("missing"),
        text.json_text(F.col("props"), "$.k").alias("k_text"),
    )


M3_SQL = """
WITH e AS (SELECT *, value / 1000 AS r, user_id % 8 AS n FROM events)
SELECT event_id,
  round(CASE WHEN n = 0 THEN 0.0 ELSE pow(1 + r / 365.0 * n, 1.0 / n) - 1 END, 10) AS ted,
  round(CASE WHEN n = 0 THEN 0.0 ELSE pow(1 + (r + 0.03) / 365.0 * n, 1.0 / n) - 1 END, 10) AS ted2,
  round(value / nullif(n, 0), 9) AS deflated, round(value / 1000, 9) AS scaled,
  CASE WHEN event_id % 2 = 1 THEN value WHEN event_id % 3 = 0 THEN value * 2 END AS first_present,
  CASE WHEN event_id % 2 = 1 THEN value ELSE 0 END AS zero_filled,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, 1.0::DOUBLE AS missing,
  json_extract_string(props, '$.k') AS k_text
FROM e
"""


def x5_failed_keys(spark, folder):
    """Responses that did not parse, counted per key."""
    body = F.when(F.col("event_id") % 9 == 0, "error 500").otherwise(F.col("props"))
    responses = table(spark, folder, "events").select(
        "user_id", F.from_json(body, "k int")["k"].alias("parsed")
    )
    return prices.split_failures(responses, "user_id", "parsed")[1]


X5_SQL = """
SELECT user_id, count(*) AS failures FROM events WHERE event_id % 9 = 0 GROUP BY 1
"""

QUERIES = {
    "t1_strip": (t1_strip, T1_SQL),
    "t2_float_tail": (t2_float_tail, T2_SQL),
    "t3_clean_numbers": (t3_clean_numbers, T3_SQL),
    "d1_formats": (d1_formats, D1_SQL),
    "d3_serials": (d3_serials, D3_SQL),
    "d6_calendar": (d6_calendar, D6_SQL),
    "d8_time_of_day": (d8_time_of_day, D8_SQL),
    "m3_rates": (m3_rates, M3_SQL),
    "x5_failed_keys": (x5_failed_keys, X5_SQL),
}
