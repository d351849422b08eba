"""Rendered pages and JSON payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.plans import exchange, prices, repo, trades
from serieslake.sources import markup, records
from standins.common import table

ANCHOR = r'<a\s+href="([^"]*)"[^>]*>([^<]*)</a>'


def s3_html_items(spark, folder):
    """Every link of every page, whole pages."""
    return markup.repeated_items(
        table(spark, folder, "pages"), "html", ["page_id"], ANCHOR, ["href", "label"]
    )


def _decoded(expression: str) -> str:
    for entity, character in markup.ENTITIES.items():
        expression = f"replace({expression}, '{entity}', '{character}')"
    return f"trim({expression})"


S3_ITEMS_SQL = f"""
WITH found AS (
  SELECT page_id, regexp_extract_all(html, '{ANCHOR}', 1) AS hrefs,
         regexp_extract_all(html, '{ANCHOR}', 2) AS labels FROM pages),
items AS (
  SELECT page_id, unnest(range(len(hrefs))) AS i, unnest(hrefs) AS href, unnest(labels) AS label
  FROM found)
SELECT page_id, CAST(i AS INTEGER) AS item, {_decoded("href")} AS href, {_decoded("label")} AS label
FROM items
"""

# --- tables in pages made from orders ---------------------------------------------------------


def _td(*cells: Column, end: str = "</td>") -> Column:
    return F.concat(*(part for c in cells for part in (F.lit("<td>"), c, F.lit(end))))


def _page(rows: list[Column], css_class: str, heads: list[str], row_end: str = "</tr>") -> Column:
    """A page with a decoy table, the wanted table and some prose."""
    head = "<tr>" + "".join(f"<th>{h}</th>" for h in heads) + row_end
    body = [part for row in rows for part in (F.lit('<tr class="r">\n'), row, F.lit(row_end))]
    return F.concat(
        F.lit('<html><body><p>1 < 2</p><table id="x"><tr><td>decoy</td></tr></table>'),
        F.lit(f'<table class="big {css_class}" width=1>{head}'),
        *body,
        F.lit("</table><p>end</p></body></html>"),
    )


LIVESTOCK_HEADS = ["Categoria", "Minimo", "Maximo"]


def _local(amount: Column, digits: int) -> Column:
    return F.translate(F.format_number(amount, digits), ",.", ".,")


def livestock_pages(spark, folder) -> DataFrame:
    price, key = F.col("o_totalprice"), F.col("o_orderkey")
    cells = lambda name, extra: _td(
        name,
        _local(price, 3),
        _local(price + 1, 3),
        _local(price + 2, 3),
        _local(price + 3, 3),
        _local(key * 3 + extra, 0),
        F.concat(F.lit("<b>$"), _local(price, 2), F.lit("</b>")),
        _local(key * 41 + extra, 0),
        F.concat(_local(key + extra, 0), F.lit(" kg")),
    )
    blank = F.when(key % 6 == 0, "").otherwise("VACAS &amp; TOROS")
    rows = [cells(F.col("o_orderpriority"), 0), cells(blank, 1)]
    return table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"),
        _page(rows, "table-custom", LIVESTOCK_HEADS).alias("html"),
    )


def q6_livestock(spark, folder):
    """Market pages: rows with an empty cell go, local number styles become numbers."""
    clean = prices.livestock_prices(livestock_pages(spark, folder), "html", "date")
    return clean.select(
        *(
            F.round(c, 3).alias(c) if c.startswith("precio") else F.col(c)
            for c in clean.columns
        )
    )


def _livestock_sql(name: str, extra: int, where: str) -> str:
    return f"""
SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, {name} AS categoria,
  round(o_totalprice, 3) AS "precioMinimo", round(o_totalprice + 1, 3) AS "precioMaximo",
  round(o_totalprice + 2, 3) AS "precioPromedio", round(o_totalprice + 3, 3) AS "precioMediana",
  CAST(o_orderkey * 3 + {extra} AS DOUBLE) AS "totalCabezas", o_totalprice AS importe,
  CAST(o_orderkey * 41 + {extra} AS DOUBLE) AS kgs, CAST(o_orderkey + {extra} AS DOUBLE) AS "promKgs"
FROM orders {where}"""


Q6_SQL = (
    _livestock_sql("o_orderpriority", 0, "")
    + " UNION ALL "
    + _livestock_sql("'VACAS & TOROS'", 1, "WHERE o_orderkey % 6 <> 0")
)


def s3_html_tables(spark, folder):
    """The table with the wanted headings, cell by cell."""
    pages = table(spark, folder, "orders").select(
        "o_orderkey",
        _page(
            [_td(F.col("o_orderstatus"), F.concat(F.lit("<i> "), "o_orderpriority", F.lit(" </i>")))],
            "plain",
            ["Estado", "Prioridad"],
        ).alias("html"),
    )
    lines = markup.table_rows(pages, "html", ["o_orderkey"], headers=["Prioridad", "Estado"])
    return lines.select(
        "o_orderkey", "line", F.get("cells", F.lit(0)).alias("estado"), F.get("cells", F.lit(1)).alias("prioridad")
    )


S3_TABLES_SQL = """
SELECT o_orderkey, CAST(1 AS INTEGER) AS line, o_orderstatus AS estado, o_orderpriority AS prioridad
FROM orders
"""


def s3_unclosed_tables(spark, folder):
    """Markup without end tags of cells and lines."""
    pages = _unclosed_pages(spark, folder)
    return _two_cells(markup.table_rows(pages, "html", ["c_custkey"]))


def s3_parsed_tables(spark, folder):
    """Pages with tags in scripts and attributes, which only a parser can tell from markup."""
    rows = [
        F.concat(F.lit('<td title="<td>no</td>">'), "c_name", F.lit("<td>a &lt; b")),
        F.concat(F.lit("<td>"), "c_mktsegment", F.lit("<script>'<tr><td>no'</script><td>"), F.col("c_nationkey").cast("string")),
    ]
    page = F.concat(F.lit("<script>var t = '<table><tr><td>no</td></tr></table>';</script>"), _page(rows, "plain", ["uno", "dos"], row_end=""))
    return _two_cells(markup.parsed_tables(table(spark, folder, "customer").select("c_custkey", page.alias("html")), "html", "c_custkey"))


def s3_row_spans(spark, folder):
    """A table whose first column covers two lines and whose heading covers two columns; the class has no quotes."""
    page = F.concat(
        F.lit("<table class=otra><tr><td rowspan=2>no<td>no<tr><td>no</table>"),
        F.lit("<table border=0 class=precios><tr><th rowspan=2>Nombre</th><th colspan=2>Valores</th></tr><tr><th>a</th><th>b</th></tr>"),
        F.lit('<tr><td rowspan="2">'), "c_name", F.lit("</td><td>"), "c_mktsegment", F.lit("</td><td>1</td></tr>"),
        F.lit("<tr><td colspan='2'>"), F.col("c_nationkey").cast("string"), F.lit("</td></tr>"),
        F.lit("<tr><td>total<td>x<td rowspan=9>&lt;"), "c_name", F.lit("</table>"),
    )
    # a small file makes many pages, so they are dealt out before the work on them
    customers = table(spark, folder, "customer").repartition(spark.sparkContext.defaultParallelism)
    pages = customers.select("c_custkey", page.alias("html"))
    lines = markup.table_rows(pages, "html", ["c_custkey"], css_class="precios")
    return lines.select("c_custkey", "line", *markup.named_cells(["nombre", "uno", "dos"]))


S3_SPANS_SQL = """
SELECT c_custkey, CAST(2 AS INTEGER) AS line, c_name AS nombre, c_mktsegment AS uno, '1' AS dos FROM customer
UNION ALL SELECT c_custkey, 3, c_name, CAST(c_nationkey AS VARCHAR), CAST(c_nationkey AS VARCHAR) FROM customer
UNION ALL SELECT c_custkey, 4, 'total', 'x', '<' || c_name FROM customer
"""


def _unclosed_pages(spark, folder) -> DataFrame:
    rows = [
        _td(F.col("c_name"), F.lit("a &lt; b"), end=""),
        _td(F.col("c_mktsegment"), F.col("c_nationkey").cast("string"), end=""),
    ]
    page = _page(rows, "plain", ["uno", "dos"], row_end="")
    return table(spark, folder, "customer").select("c_custkey", page.alias("html"))


def _two_cells(lines: DataFrame) -> DataFrame:
    return lines.select(
        "c_custkey",
        "table",
        "line",
        F.get("cells", F.lit(0)).alias("uno"),
        F.get("cells", F.lit(1)).alias("dos"),
    )


S3_UNCLOSED_SQL = """
SELECT c_custkey, CAST(0 AS INTEGER) AS "table", CAST(0 AS INTEGER) AS line, 'decoy' AS uno,
       NULL::VARCHAR AS dos FROM customer
UNION ALL SELECT c_custkey, 1, 1, c_name, 'a < b' FROM customer
UNION ALL SELECT c_custkey, 1, 2, c_mktsegment, CAST(c_nationkey AS VARCHAR) FROM customer
"""

# --- payloads -------------------------------------------------------------------------------------


def s4_json_records(spark, folder):
    """Two records per payload; a field the schema does not know survives in ``raw``."""
    record = lambda extra: F.struct(
        (F.col("event_id") + extra).alias("id"),
        F.col("event_type").alias("tipo"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.lit("x").alias("nuevo"),
    )
    payloads = table(spark, folder, "events").select(
        "event_id",
        F.to_json(F.struct(F.array(record(0), record(1)).alias("data"))).alias("body"),
    )
    rows = records.record_array(
        payloads, "body", "id bigint, tipo string, k int", ["event_id"], with_raw=True
    )
    return rows.select("event_id", "id", "tipo", "k", F.get_json_object("raw", "$.nuevo").alias("nuevo"))


S4_SQL = """
SELECT event_id, event_id + d AS id, event_type AS tipo,
  CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, 'x' AS nuevo
FROM events, (VALUES (0), (1)) v(d)
"""


def spot_payloads(spark, folder) -> DataFrame:
    """A body per user and day."""
    events = table(spark, folder, "events")
    per_day = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(
        F.avg(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"),
        F.avg(F.when(F.col("event_type") == "view", F.col("value"))).alias("b"),
        F.max("value").alias("c"),
    )
    quote = lambda kind, price: F.struct(
        F.date_format("day", "yyyy-MM-dd").alias("dateTime"),
        F.lit(kind).alias("spot"),
        F.round(price, 4).alias("normalizedPrice"),
        F.lit(1).alias("representativity"),
    )
    return per_day.select(
        "user_id",
        F.to_json(
            F.struct(F.array(quote("CCL", "a"), quote("CCL3", "b"), quote("MEP", "c")).alias("data"))
        ).alias("body"),
    )


def q1_spot_payloads(spark, folder):
    """Spot payloads of a user to the consolidated rate, end to end."""
    spots = exchange.spot_records(spot_payloads(spark, folder), "body", ["user_id"])
    return exchange.consolidated_rate(spots, by=["user_id"])


Q1_SQL = """
WITH d AS (
  SELECT user_id, CAST(ts AS DATE) AS date,
    round(avg(value) FILTER (WHERE event_type = 'click'), 4) AS a,
    round(avg(value) FILTER (WHERE event_type = 'view'), 4) AS b FROM events GROUP BY 1, 2)
SELECT user_id, date, coalesce(a, b) AS ccl, b AS ccl3 FROM d
"""


def _instrument() -> Column:
    odd = F.when(F.col("event_id") % 13 == 0, "sin formato")
    settle = F.lpad((F.col("event_id") % 4).cast("string"), 3, "0")
    return odd.otherwise(
        F.concat(F.lit("USD / ARS "), settle, F.lit(" "), F.date_format("ts", "ddMMyy"))
    )


def forex_payloads(spark, folder) -> DataFrame:
    record = F.struct(
        F.date_format("ts", "yyMMdd").alias("Fecha"),
        _instrument().alias("Titulo"),
        F.col("event_type").alias("Rueda"),
        F.format_number(F.col("value") * 1000, 1).alias("Monto"),
        F.col("value").cast("string").alias("Cotizacion"),
        F.date_format("ts", "HH:mm:ss").alias("Hora"),
    )
    return table(spark, folder, "events").select(
        "event_id", F.to_json(F.struct(F.array(record).alias("data"))).alias("body")
    )


def q7_forex(spark, folder):
    """Forex payloads, titles taken apart; some titles do not match."""
    return exchange.forex_quotes(forex_payloads(spark, folder), "body", ["event_id"])


_TITLE = (
    "CASE WHEN event_id % 13 = 0 THEN 'sin formato' ELSE 'USD / ARS ' || "
    "lpad(CAST(event_id % 4 AS VARCHAR), 3, '0') || ' ' || strftime(ts, '%d%m%y') END"
)
_MATCHED = "CASE WHEN event_id % 13 <> 0 THEN {} END"
Q7_SQL = f"""
SELECT event_id, CAST(ts AS DATE) AS date, event_type AS rueda, {_TITLE} AS instrumento,
  {_MATCHED.format("'USD'")} AS currency_out, {_MATCHED.format("'ARS'")} AS currency_in,
  {_MATCHED.format("lpad(CAST(event_id % 4 AS VARCHAR), 3, '0')")} AS settle,
  {_MATCHED.format("strftime(ts, '%d%m%y')")} AS settle_date,
  round(value * 1000, 1) AS monto, value AS cotizacion, strftime(ts, '%H:%M:%S') AS hora
FROM events
"""


def t4_instrument(spark, folder):
    """Rendered forex tables, with the looser form of titles."""
    pages = table(spark, folder, "events").select(
        "event_id", _page([_td(_instrument(), F.col("event_type"))], "forex", ["Instrumento"]).alias("html")
    )
    return exchange.forex_screen(pages, "html", ["event_id"], ["Instrumento", "rueda"], "forex")


T4_SQL = f"""
SELECT event_id, {_TITLE} AS "Instrumento", event_type AS rueda,
  {_MATCHED.format("'USD'")} AS "currencyOut", {_MATCHED.format("'ARS'")} AS "currencyIn",
  {_MATCHED.format("lpad(CAST(event_id % 4 AS VARCHAR), 3, '0')")} AS settle,
  {_MATCHED.format("CAST(ts AS DATE)")} AS "settleDate"
FROM events
"""

# --- paged endpoints ----------------------------------------------------------------------------

ENDPOINTS = {
    "click": "id bigint, precio double",
    "view": "id bigint, precio double, plazo int",
    "purchase": "id bigint, moneda string",
    "error": "id bigint, precio double, moneda string",
    "signup": "id bigint",
}


def trade_pages(spark, folder) -> DataFrame:
    """A page per event; each endpoint has fields of its own."""
    record = F.struct(
        F.col("event_id").alias("id"),
        F.col("value").alias("precio"),
        (F.col("user_id") % 3).cast("int").alias("plazo"),
        F.lit("ARS").alias("moneda"),
    )
    envelope = F.struct(
        F.when(
            F.col("event_type") != "purchase", F.struct((F.lit(4)).alias("page_count"))
        ).alias("content"),
        F.array(record).alias("data"),
    )
    return table(spark, folder, "events").select(
        F.col("event_type").alias("endpoint"),
        (F.col("event_id") % 4 + 1).cast("int").alias("page"),
        F.to_json(envelope).alias("body"),
    )


PAGE = 50  # events of a landed page, over all endpoints


def dense_pages(spark, folder) -> DataFrame:
    """Pages as an endpoint answers them: the records of up to ``PAGE`` events, and the number of pages."""
    events = table(spark, folder, "events").withColumn("page", (F.col("event_id") / PAGE).cast("int") + 1)
    record = F.struct(
        F.col("event_id").alias("id"),
        F.col("value").alias("precio"),
        (F.col("user_id") % 3).cast("int").alias("plazo"),
        F.lit("ARS").alias("moneda"),
    )
    pages = events.groupBy(F.col("event_type").alias("endpoint"), "page").agg(F.collect_list(record).alias("data"))
    count = events.select(F.max("page")).scalar()
    body = F.to_json(F.struct(F.struct(count.alias("page_count")).alias("content"), "data"))
    return pages.select("endpoint", "page", body.alias("body"))


def cut_pages(spark, folder) -> DataFrame:
    """A first landing: every third page cut off, every seventh not there."""
    body = F.when(F.col("page") % 3 == 2, F.left("body", F.length("body") - 9)).otherwise(F.col("body"))
    return dense_pages(spark, folder).filter("page % 7 != 0").withColumn("body", body)


def q16_trades(spark, folder):
    return trades.trades(trade_pages(spark, folder), "body", "2024-06-03", ENDPOINTS)


Q16_SQL = """
SELECT DATE '2024-06-03' AS date, event_type AS endpoint, event_id AS id,
  CASE WHEN event_type IN ('click', 'view', 'error') THEN value END AS precio,
  CASE WHEN event_type = 'view' THEN CAST(user_id % 3 AS INTEGER) END AS plazo,
  CASE WHEN event_type IN ('purchase', 'error') THEN 'ARS' END AS moneda
FROM events
"""


def s5_page_gaps(spark, folder):
    """Endpoints whose landed pages differ from the announced count (1 when silent)."""
    return trades.page_gaps(trade_pages(spark, folder), "body")


S5_GAPS_SQL = """
SELECT event_type AS endpoint, count(DISTINCT event_id % 4) AS pages_landed,
  CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 4 END AS BIGINT) AS pages_expected
FROM events GROUP BY 1
HAVING count(DISTINCT event_id % 4) <> CASE WHEN event_type = 'purchase' THEN 1 ELSE 4 END
"""


def _cut_pages(spark, folder) -> DataFrame:
    """Landed pages of two run dates; every seventh body was cut off, some are missing."""
    pages = trade_pages(spark, folder).withColumn("run_date", F.lit("2024-06-03").cast("date"))
    key = F.get_json_object("body", "$.data[0].id").cast("bigint")
    cut = F.when(key % 7 == 0, F.left("body", F.length("body") - 9)).when(key % 11 == 0, F.lit(None)).otherwise(F.col("body"))
    return pages.select("endpoint", "page", "run_date", key.alias("id"), cut.alias("body"))


def q16_unreadable_pages(spark, folder):
    """The pages whose records are lost, and why; the others give all their records."""
    return records.unreadable(_cut_pages(spark, folder), "body", ["endpoint", "page", "id"])


Q16_UNREADABLE_SQL = """
SELECT event_type AS endpoint, CAST(event_id % 4 + 1 AS INTEGER) AS page, event_id AS id,
  CASE WHEN event_id % 7 = 0 THEN 'no records' ELSE 'missing' END AS reason
FROM events WHERE event_id % 7 = 0 OR event_id % 11 = 0
"""


def q2_rate_payloads(spark, folder):
    """Rate payloads whose body is the record array, dated with the run date."""
    record = F.struct(
        F.col("value").alias("vwap"),
        (F.col("user_id") % 30).cast("int").alias("daysToMaturity"),
        F.col("event_id").alias("id"),
    )
    payloads = table(spark, folder, "events").select(F.to_json(F.array(record)).alias("body"))
    rates = repo.repo_rates(payloads, "body", "2024-06-03")
    return rates.select(
        "date", "vwap", "daysToMaturity", F.get_json_object("raw", "$.id").cast("bigint").alias("id")
    )


Q2_SQL = """
SELECT DATE '2024-06-03' AS date, value AS vwap, CAST(user_id % 30 AS INTEGER) AS "daysToMaturity",
  event_id AS id FROM events
"""

QUERIES = {
    "s3_html_items": (s3_html_items, S3_ITEMS_SQL),
    "s3_html_tables": (s3_html_tables, S3_TABLES_SQL),
    "s3_unclosed_tables": (s3_unclosed_tables, S3_UNCLOSED_SQL),
    "s3_row_spans": (s3_row_spans, S3_SPANS_SQL),
    "s3_parsed_tables": (s3_parsed_tables, S3_UNCLOSED_SQL),
    "q6_livestock": (q6_livestock, Q6_SQL),
    "s4_json_records": (s4_json_records, S4_SQL),
    "q1_spot_payloads": (q1_spot_payloads, Q1_SQL),
    "q2_rate_payloads": (q2_rate_payloads, Q2_SQL),
    "q7_forex": (q7_forex, Q7_SQL),
    "t4_instrument": (t4_instrument, T4_SQL),
    "q16_trades": (q16_trades, Q16_SQL),
    "s5_page_gaps": (s5_page_gaps, S5_GAPS_SQL),
    "q16_unreadable_pages": (q16_unreadable_pages, Q16_UNREADABLE_SQL),
}
