"""Landed sheets: ranges, take-while, transposed blocks, multi-sheet jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.operators import quality
from serieslake.plans import activity, exchange, ledger, monetary, prices, repo
from serieslake.sources import layouts, sheets
from standins.common import table, whole

# --- landed sheets made from orders ---------------------------------------------------------


def cell_numbers(width: int, **special: Column) -> Column:
    """Cells holding ``total + position``; ``special`` overrides positions (``p3=...``)."""
    base = whole("o_totalprice")
    cells = [(base + i).cast("string") for i in range(width)]
    for position, value in special.items():
        cells[int(position[1:])] = value
    return F.array(*cells)


def landed(orders: DataFrame, workbook: Column, sheet: Column, first: int, cells: Column) -> DataFrame:
    """One sheet row per order; the order key gives the row number."""
    return orders.select(
        workbook.cast("string").alias("workbook"),
        sheet.alias("sheet"),
        (F.col("o_orderkey") + first).alias("row"),
        cells.alias("cells"),
    )


def iso_day() -> Column:
    return F.date_format("o_orderdate", "yyyy-MM-dd")


TOTAL = "CAST(round(o_totalprice) AS BIGINT)"
DAY = "CAST(o_orderdate AS DATE)"

RANGE = sheets.SheetRange(
    table="rango",
    sheet="P",
    first_col="B",
    last_col="F",
    first_row=1000,
    names=("cliente", "date", "monto", "prioridad"),
    drop=(1,),
    text_columns=("prioridad",),
)


def _range_rows(spark, folder) -> DataFrame:
    """Sheets named by order status; columns A to G, C is dropped by the layout."""
    cells = F.array(
        F.lit("margin"),
        F.col("o_custkey").cast("string"),
        F.lit("dropped"),
        iso_day(),
        whole("o_totalprice").cast("string"),
        F.col("o_orderpriority"),
        F.lit("outside"),
    )
    orders = table(spark, folder, "orders")
    return landed(orders, F.col("o_custkey") % 10, F.col("o_orderstatus"), 0, cells)


def s1_sheet_rows(spark, folder):
    return sheets.read_rows(_range_rows(spark, folder), RANGE)


def s1_sheet_range(spark, folder):
    """The same range out of one record per cell."""
    cells = sheets.rows_to_cells(_range_rows(spark, folder))
    return sheets.read_cells(cells, RANGE)


S1_SQL = f"""
SELECT CAST(o_custkey % 10 AS VARCHAR) AS workbook, o_orderkey AS row,
  CAST(o_custkey AS DOUBLE) AS cliente, {DAY} AS date, CAST({TOTAL} AS DOUBLE) AS monto,
  o_orderpriority AS prioridad
FROM orders WHERE o_orderstatus = 'P' AND o_orderkey >= 1000
"""


def f9_take_while(spark, folder):
    """Rows of each workbook above its first blank key."""
    rows = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("workbook"),
        F.col("o_orderkey").alias("row"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_orderstatus")).alias("clave"),
    )
    return sheets.until_blank(rows, ["workbook"], "row", F.col("clave"))


F9_SQL = """
WITH cuts AS (SELECT o_custkey AS c, min(o_orderkey) AS cut FROM orders
              WHERE o_orderkey % 17 = 0 GROUP BY 1)
SELECT o_custkey AS workbook, o_orderkey AS row, o_orderstatus AS clave
FROM orders LEFT JOIN cuts ON c = o_custkey WHERE cut IS NULL OR o_orderkey < cut
"""


def p7_transpose(spark, folder):
    """Segments stand in sheet rows, nations in columns; read sideways."""
    segments = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
    counted = (
        table(spark, folder, "customer")
        .groupBy("c_mktsegment", "c_nationkey")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    cells = counted.select(
        F.lit("clientes").alias("workbook"),
        F.lit("0").alias("sheet"),
        F.array_position(F.array(*map(F.lit, segments)), F.col("c_mktsegment")).alias("row"),
        F.col("c_nationkey").alias("col"),
        F.col("n").cast("string").alias("value"),
    )
    sideways = sheets.SheetRange(
        table="clientes", sheet="0", first_col="A", last_col="E", first_row=1,
        names=tuple(s.lower() for s in segments), date_column=None,
    )
    wide = sheets.read_cells(sheets.transposed(cells), sideways)
    return wide.select((F.col("row") - 1).alias("nation"), *sideways.names)


P7_SQL = """
SELECT CAST(c_nationkey AS BIGINT) AS nation,
  CAST(nullif(count(*) FILTER (WHERE c_mktsegment = 'AUTOMOBILE'), 0) AS DOUBLE) AS automobile,
  CAST(nullif(count(*) FILTER (WHERE c_mktsegment = 'BUILDING'), 0) AS DOUBLE) AS building,
  CAST(nullif(count(*) FILTER (WHERE c_mktsegment = 'FURNITURE'), 0) AS DOUBLE) AS furniture,
  CAST(nullif(count(*) FILTER (WHERE c_mktsegment = 'HOUSEHOLD'), 0) AS DOUBLE) AS household,
  CAST(nullif(count(*) FILTER (WHERE c_mktsegment = 'MACHINERY'), 0) AS DOUBLE) AS machinery
FROM customer GROUP BY 1
"""

# --- price index -----------------------------------------------------------------------------


def price_cells(spark, folder) -> DataFrame:
    """A price workbook per order status: 126 item rows, a column per month."""
    items = len(layouts.price_columns())
    totals = (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderstatus").alias("workbook"),
            F.trunc("o_orderdate", "month").alias("month"),
            (F.col("o_custkey") % items).cast("int").alias("item"),
        )
        .agg(F.sum(whole("o_totalprice")).alias("total"))
    )
    column = F.months_between("month", F.lit("1995-01-01").cast("date")).cast("int") + 1
    place = lambda df, row, value: df.select(
        "workbook",
        F.lit(layouts.PRICE_SHEET).alias("sheet"),
        row.cast("long").alias("row"),
        column.alias("col"),
        value.alias("value"),
    )
    rows_of_items = F.array(*(F.lit(r) for r in layouts.PRICE_ROWS[1:]))
    levels = place(totals, F.get(rows_of_items, F.col("item")), F.col("total").cast("string"))
    months = totals.groupBy("workbook", "month").agg(F.count(F.lit(1)).alias("n"))
    headings = place(
        months, F.lit(layouts.PRICE_FIRST_ROW), F.date_format("month", "yyyy-MM-dd")
    )
    notes = place(months, F.lit(layouts.PRICE_FIRST_ROW + 17), F.lit("x"))
    return levels.unionByName(headings).unionByName(notes)


def q3_price_index(spark, folder):
    """The wide price table, shown in long form: level and variation of every item."""
    return price_entries(prices.price_index(price_cells(spark, folder)))


def price_entries(wide: DataFrame) -> DataFrame:
    names = layouts.price_columns()
    entry = lambda n: F.struct(
        F.lit(n).alias("series_id"),
        F.col(n).alias("level"),
        F.round(layouts.variation_name(n), 9).alias("variation"),
    )
    return wide.select("workbook", "date", F.inline(F.array(*map(entry, names))))


_names = ", ".join(f"'{n}'" for n in layouts.price_columns())
Q3_SQL = f"""
WITH totals AS (
  SELECT o_orderstatus AS workbook, CAST(date_trunc('month', o_orderdate) AS DATE) AS date,
    o_custkey % 126 AS item, CAST(sum({TOTAL}) AS DOUBLE) AS total FROM orders GROUP BY 1, 2, 3),
months AS (SELECT DISTINCT workbook, date FROM totals),
items AS (SELECT unnest(range(126)) AS item, unnest([{_names}]) AS series_id),
grid AS (
  SELECT m.workbook, m.date, i.series_id, t.total AS level
  FROM months m CROSS JOIN items i
  LEFT JOIN totals t ON t.workbook = m.workbook AND t.date = m.date AND t.item = i.item),
padded AS (
  SELECT *, last_value(level IGNORE NULLS) OVER (PARTITION BY workbook, series_id ORDER BY date
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM grid)
SELECT workbook, date, series_id, level,
  round(p / nullif(lag(p) OVER (PARTITION BY workbook, series_id ORDER BY date), 0) - 1, 9) AS variation
FROM padded
"""



def q3_price_observations(spark, folder):
    """The same workbooks without the wide step; only the cells that exist."""
    long = prices.price_observations(price_cells(spark, folder))
    return long.select(
        "workbook", "series_id", "obs_date", "level", F.round("variation", 9).alias("variation")
    )


Q3_LONG_SQL = f"""
WITH totals AS (
  SELECT o_orderstatus AS workbook, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date,
    o_custkey % 126 AS item, CAST(sum({TOTAL}) AS DOUBLE) AS level FROM orders GROUP BY 1, 2, 3)
SELECT workbook, [{_names}][item + 1] AS series_id, obs_date, level,
  round(level / nullif(lag(level) OVER (PARTITION BY workbook, item ORDER BY obs_date), 0) - 1, 9)
    AS variation
FROM totals
"""

# --- activity index, real exchange rate, narrow series ----------------------------------------


def activity_rows(spark, folder) -> DataFrame:
    """Rows without dates: the line number of an order gives the month."""
    lines = table(spark, folder, "lineitem")
    measures = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    first = F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity").cast("string"))
    cells = F.array(
        F.lit("margin"), F.lit("margin"), first, *(F.col(m).cast("string") for m in measures[1:])
    )
    return lines.select(
        F.col("l_orderkey").cast("string").alias("workbook"),
        F.lit("0").alias("sheet"),
        (F.col("l_linenumber") + 4).cast("long").alias("row"),
        cells.alias("cells"),
    )


def q10_activity_index(spark, folder):
    return activity.activity_index(activity_rows(spark, folder))


_emae = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
_emae_out = ", ".join(
    f'CAST({m} AS DOUBLE) AS "{n}"' for m, n in zip(_emae, layouts.EMAE.names)
)
Q10_SQL = f"""
SELECT CAST(l_orderkey AS VARCHAR) AS workbook,
  CAST(DATE '2004-01-01' + to_months(l_linenumber - 1) AS DATE) AS date, {_emae_out}
FROM lineitem WHERE l_partkey % 9 <> 0
"""

def exchange_rows(spark, folder) -> DataFrame:
    """Rate rows; every 40th row is blank, every 33rd a footer text, some numbers are bad."""
    key = F.col("o_orderkey")
    day = F.when(key % 40 == 0, None).when(key % 33 == 0, "Fuente: x").otherwise(iso_day())
    bad = F.when(key % 8 == 0, "n.d.").otherwise((whole("o_totalprice") + 5).cast("string"))
    orders = table(spark, folder, "orders")
    cells = cell_numbers(16, p0=day, p5=bad)
    return landed(orders, F.col("o_custkey"), F.lit("0"), 3, cells)


def q18_real_exchange(spark, folder):
    return activity.real_exchange_rate(exchange_rows(spark, folder))


def q18_until_blank(spark, folder):
    return activity.real_exchange_rate(exchange_rows(spark, folder), stop_at_blank=True)


def _q18_columns() -> str:
    out = [f"{DAY} AS date"]
    for i, name in enumerate(layouts.ITCRM.names[1:], start=1):
        value = f"CAST({TOTAL} + {i} AS DOUBLE)"
        if i == 5:
            value = f"CASE WHEN o_orderkey % 8 <> 0 THEN {value} END"
        out.append(f'{value} AS "{name}"')
    return ", ".join(out)


Q18_SQL = f"""
SELECT CAST(o_custkey AS VARCHAR) AS workbook, {_q18_columns()}
FROM orders WHERE o_orderkey % 40 <> 0 AND o_orderkey % 33 <> 0
"""
Q18_BLANK_SQL = f"""
WITH cuts AS (SELECT o_custkey AS c, min(o_orderkey) AS cut FROM orders
              WHERE o_orderkey % 40 = 0 GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS workbook, {_q18_columns()}
FROM orders LEFT JOIN cuts ON c = o_custkey
WHERE (cut IS NULL OR o_orderkey < cut) AND o_orderkey % 33 <> 0
"""


def narrow_rows(spark, folder) -> DataFrame:
    """Three two-column workbooks, each with its own range and first row."""
    key = F.col("o_orderkey")
    day = F.when(key % 10 == 0, "sin dato").otherwise(F.date_format("o_orderdate", "dd/MM/yyyy"))
    amount = whole("o_totalprice").cast("string")
    book = F.when(key % 3 == 0, "A3500").when(key % 3 == 1, "CER").otherwise("UVA")
    cells = F.when(key % 3 == 0, F.array(F.lit("a"), F.lit("b"), day, amount)).otherwise(
        F.array(day, amount)
    )
    return landed(table(spark, folder, "orders"), book, F.lit("0"), 0, cells)


def q19_narrow_series(spark, folder):
    return exchange.narrow_series(narrow_rows(spark, folder), layouts.NARROW)


Q19_SQL = f"""
SELECT CASE o_orderkey % 3 WHEN 0 THEN 'A3500' WHEN 1 THEN 'CER' ELSE 'UVA' END AS series_id,
  {DAY} AS obs_date, CAST({TOTAL} AS DOUBLE) AS value
FROM orders
WHERE o_orderkey % 10 <> 0 AND o_orderkey >= CASE o_orderkey % 3 WHEN 0 THEN 5 ELSE 28 END
"""

# --- monetary workbook, dashboard, deposits ------------------------------------------------------


def _summary(observations: DataFrame, *by: str) -> DataFrame:
    """Every observation counts: rows, days and totals per series."""
    return observations.groupBy("table", "series_id", *by).agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("value").alias("present"),
        F.sum("value").alias("total"),
        F.min("obs_date").alias("first_date"),
        F.max("obs_date").alias("last_date"),
    )


_TAGS = {"bmBCRA": 32, "reservas": 16, "depositos": 30, "prestamos": 21}


def six_sheets(spark, folder) -> DataFrame:
    """All six monetary sheets in one landing table."""
    key = F.col("o_orderkey")
    names = F.array(*(F.lit(one.sheet) for one in layouts.MONETARY))
    tag = F.when(F.col("o_custkey") % 2 == 0, "D").otherwise("M")
    tagged = F.array(*(F.lit(_TAGS.get(one.table, -1)) for one in layouts.MONETARY))
    at = F.get(tagged, (key % 6).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(46)),
        lambda i: F.when(i == 0, iso_day())
        .when(i == at, tag)
        .otherwise((whole("o_totalprice") + i).cast("string")),
    )
    sheet = F.get(names, (key % 6).cast("int"))
    return landed(table(spark, folder, "orders"), F.lit("series"), sheet, 0, cells)


def q11_monetary_sheets(spark, folder):
    """Six sheets in one landing table, all read in one scan."""
    return _summary(monetary.monetary_observations(six_sheets(spark, folder)), "freq")


def _item_rows(blocks) -> str:
    """(group, table, series_id, position) of every numeric column."""
    return ", ".join(
        f"({n}, '{one.table}', '{name}', {pos})"
        for n, one in enumerate(blocks)
        for name, pos in one.columns()
        if name != "date" and name not in one.text_columns
    )


Q11_SQL = f"""
WITH items(g, "table", series_id, pos) AS (VALUES {_item_rows(layouts.MONETARY)})
SELECT "table", series_id,
  CASE WHEN g < 4 THEN CASE WHEN o_custkey % 2 = 0 THEN 'D' ELSE 'M' END END AS freq,
  count(*) AS observations, count(*) AS present, CAST(sum({TOTAL} + pos) AS DOUBLE) AS total,
  min({DAY}) AS first_date, max({DAY}) AS last_date
FROM orders JOIN items ON g = o_orderkey % 6
WHERE o_orderkey >= 10 GROUP BY 1, 2, 3
"""


def monetary_rows(spark, folder) -> DataFrame:
    """Two of the six sheets."""
    key = F.col("o_orderkey")
    sheet = F.when(key % 2 == 0, "RESERVAS").otherwise("PRESTAMOS")
    cells = cell_numbers(17, p0=iso_day(), p16=F.lit("D"))
    return landed(table(spark, folder, "orders"), F.lit("series"), sheet, 0, cells)


def q11_wide_table(spark, folder):
    """One of the six as the wide table users query."""
    return monetary.monetary_tables(monetary_rows(spark, folder))["reservas"]


def _q11_wide_sql() -> str:
    kept = [p for p in range(17) if p not in (1, 5, 12, 14)]
    names = [n for n in layouts.RESERVES.split()]
    out = [f"{DAY} AS date"]
    out += [f'CAST({TOTAL} + {p} AS DOUBLE) AS "{n}"' for n, p in zip(names[1:-1], kept[1:-1])]
    return (
        f"SELECT 'series' AS workbook, {', '.join(out)}, 'D' AS \"tipoSerie\" FROM orders "
        "WHERE o_orderkey % 2 = 0 AND o_orderkey >= 10"
    )


def _dashboard_rows(spark, folder) -> DataFrame:
    return dashboard_lines(table(spark, folder, "orders"))


def dashboard_days(spark, folder) -> DataFrame:
    """One line per day, as the dashboard has it."""
    days = table(spark, folder, "orders").groupBy("o_orderdate").agg(
        F.min("o_orderkey").alias("o_orderkey"), F.max("o_totalprice").alias("o_totalprice")
    )
    return dashboard_lines(days)


def dashboard_lines(orders: DataFrame) -> DataFrame:
    """Every block has its date column; the interest block has placeholders and gaps."""
    key = F.col("o_orderkey")
    special = {f"p{dict(b.columns())['date']}": iso_day() for b in layouts.DASHBOARD_BLOCKS}
    placeholder = F.when(key % 7 == 0, "s/o").when(key % 11 == 0, None)
    position = sheets.column_index("J")
    special[f"p{position}"] = placeholder.otherwise((whole("o_totalprice") + position).cast("string"))
    special[f"p{sheets.column_index('V')}"] = F.when(key % 4 != 0, iso_day())
    cells = cell_numbers(sheets.column_index("BE") + 1, **special)
    sheet = F.when(key % 50 == 49, "OTRA").otherwise("DATOS | DATA")
    return landed(orders, F.lit("panel"), sheet, 0, cells)


def q12_dashboard_blocks(spark, folder):
    return _summary(monetary.dashboard_observations(_dashboard_rows(spark, folder)))


def _q12_sql(lines: str) -> str:
    return f"""
WITH items(g, "table", series_id, pos) AS (VALUES {_item_rows(layouts.DASHBOARD_BLOCKS)})
SELECT "table", series_id, count(*) AS observations, count(*) AS present,
  CAST(sum(CASE WHEN series_id = 'pase_pasivo' AND (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)
           THEN 0 ELSE {TOTAL} + pos END) AS DOUBLE) AS total,
  min({DAY}) AS first_date, max({DAY}) AS last_date
FROM {lines} CROSS JOIN items
WHERE o_orderkey >= 27 AND o_orderkey % 50 <> 49
  AND (o_orderkey % 4 <> 0 OR "table" <> 'infomond_liquidez_entidades')
GROUP BY 1, 2
"""


Q12_SQL = _q12_sql("orders")
DASHBOARD_DAYS_SQL = _q12_sql(
    "(SELECT o_orderdate, min(o_orderkey) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY 1) days"
)


def s14_dashboard_constraints(spark, folder):
    """Only the even orders' last cell is missing, so one series has nulls; dates repeat."""
    rows = _dashboard_rows(spark, folder).withColumn(
        "cells",
        F.when(F.col("row") % 2 == 0, F.slice("cells", 1, sheets.column_index("BE"))).otherwise(
            F.col("cells")
        ),
    )
    return monetary.dashboard_constraints(rows)


S14_DASHBOARD_SQL = f"""
WITH items(g, "table", series_id, pos) AS (VALUES {_item_rows(layouts.DASHBOARD_BLOCKS)}),
cells AS (
  SELECT "table", series_id, {DAY} AS d, count(*) AS n,
    count(*) FILTER (WHERE pos = 56 AND o_orderkey % 2 = 0) AS nulls
  FROM orders CROSS JOIN items
  WHERE o_orderkey >= 27 AND o_orderkey % 50 <> 49
    AND (o_orderkey % 4 <> 0 OR "table" <> 'infomond_liquidez_entidades')
  GROUP BY 1, 2, 3)
SELECT "table" AS table_name, series_id, 'primary key (date)' AS constraint_name,
  count(*) FILTER (WHERE n > 1) AS violations FROM cells GROUP BY 1, 2
UNION ALL
SELECT "table", series_id, 'not null', CAST(sum(nulls) AS BIGINT) FROM cells GROUP BY 1, 2
"""


def m2_placeholder_block(spark, folder):
    """The interest block as a wide table: null and the marker are 0, in that column only."""
    return monetary.dashboard_tables(_dashboard_rows(spark, folder))["infomond_tasa_interes"]


M2_SQL = f"""
SELECT 'panel' AS workbook, {DAY} AS date,
  CAST(CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 11 = 0 THEN 0 ELSE {TOTAL} + 9 END AS DOUBLE)
    AS pase_pasivo,
  CAST({TOTAL} + 10 AS DOUBLE) AS pase_activo, CAST({TOTAL} + 11 AS DOUBLE) AS tasa
FROM orders WHERE o_orderkey >= 27 AND o_orderkey % 50 <> 49
"""

_DEPOSITS = ("depUVA", "depTotalSectoresEntidadesNoInformantes", "depDM20TotalSectores")


def q14_param_loads(spark, folder):
    """A parameter table drives three loads; names come from the header rows."""
    key = F.col("o_orderkey")
    orders = table(spark, folder, "orders")
    width = sheets.column_index("EV") + 1
    day = F.date_format("o_orderdate", "yyyyMMdd")
    day = F.when(key % 2 == 1, F.concat(day, F.lit(".0"))).otherwise(day)
    sheet = F.when(key % 3 == 0, "UVAs").when(key % 3 == 1, "Total_sectores").otherwise(
        "DM20_total_sectores"
    )
    start = F.when(key % 3 == 1, sheets.column_index("EP")).otherwise(0)
    second = F.when(key % 3 == 0, 3).when(key % 3 == 1, sheets.column_index("EQ")).otherwise(3)
    last = F.when(key % 3 == 0, 11).when(key % 3 == 1, width - 1).otherwise(34)
    cells = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.when(i == start, day)
        .when((i == second) & (key % 10 == 0), None)
        .otherwise((whole("o_totalprice") + i).cast("string")),
    )
    rows = landed(orders, F.lit("dep"), sheet, 27, cells)
    # The header row of each sheet: one record, made from the newest order of that sheet.
    headers = orders.groupBy(sheet.alias("sheet")).agg(F.max(key).alias("k")).select(
        F.lit("dep").alias("workbook"),
        "sheet",
        F.lit(26).cast("long").alias("row"),
        F.transform(
            F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.concat(F.lit("h"), i.cast("string"))
        ).alias("cells"),
    )
    loads = monetary.deposit_loads(headers, "dep", _DEPOSITS)
    return _summary(monetary.deposit_observations(rows, loads))


def _deposit_items() -> str:
    spans = {
        "depUVA": (0, [p for p in range(12) if p not in (1, 2)]),
        "depTotalSectoresEntidadesNoInformantes": (1, list(range(145, 152))),
        "depDM20TotalSectores": (2, [p for p in range(35) if p not in (1, 2, 33)]),
    }
    return ", ".join(
        f"({g}, '{name}', 'h{p}', {p})" for name, (g, kept) in spans.items() for p in kept[1:]
    )


Q14_SQL = f"""
WITH items(g, "table", series_id, pos) AS (VALUES {_deposit_items()})
SELECT "table", series_id, count(*) AS observations, count(*) AS present,
  CAST(sum({TOTAL} + pos) AS DOUBLE) AS total, min({DAY}) AS first_date, max({DAY}) AS last_date
FROM orders JOIN items ON g = o_orderkey % 3 WHERE o_orderkey % 10 <> 0
GROUP BY 1, 2
"""


def deposit_rows(spark, folder) -> DataFrame:
    """All seven sheets, with their header rows; the second series of a table is blank here and there."""
    key, orders = F.col("o_orderkey"), table(spark, folder, "orders")
    names = list(dict.fromkeys(sheet for sheet, _, _ in layouts.DEPOSIT_SHEETS.values()))
    sheet = F.get(F.array(*map(F.lit, names)), (key % len(names)).cast("int"))
    width = sheets.column_index("EV") + 1
    right, aside = sheets.column_index("EP"), sheet == "Total_sectores"
    second = F.when((key % 10 == 0), F.lit(3)).when((key % 15 == 1), F.lit(right + 1))
    day, total = F.date_format("o_orderdate", "yyyyMMdd"), whole("o_totalprice")

    def cell(i: int) -> Column:
        value = (total + i).cast("string")
        if i in (3, right + 1):
            return F.when(~F.lit(i).eqNullSafe(second), value)
        return day if i == 0 else F.when(aside, day).otherwise(value) if i == right else value

    # an array of expressions: a filter on one cell makes that cell alone, not the whole row of every sheet
    cells = F.array(*map(cell, range(width)))
    rows = landed(orders, F.lit("dep"), sheet, 27, cells)
    header = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.concat(F.lit("h"), i.cast("string")))
    heads = rows.select("workbook", "sheet").distinct().withColumns({"row": F.lit(26).cast("long"), "cells": header})
    return rows.unionByName(heads)


def _all_deposits_sql() -> str:
    """Every column of every deposit table: the sums of its sheet, moved by the column's place."""
    names = list(dict.fromkeys(sheet for sheet, _, _ in layouts.DEPOSIT_SHEETS.values()))
    right = sheets.column_index("EP")
    items = []
    for name, (sheet, span, drop) in layouts.DEPOSIT_SHEETS.items():
        left, last = (sheets.column_index(letters) for letters in span.split(":"))
        kept = [p for n, p in enumerate(range(left, last + 1)) if n not in drop]
        items += [(names.index(sheet), name, pos, left) for pos in kept[1:]]
    values = ", ".join(f"({g}, '{name}', {pos}, {left})" for g, name, pos, left in items)
    return f"""
WITH items(g, "table", pos, lft) AS (VALUES {values}),
lines AS (
  SELECT o_orderkey % {len(names)} AS g, {TOTAL} AS total, {DAY} AS d,
    o_orderkey % 10 = 0 AS blank_left, o_orderkey % 10 <> 0 AND o_orderkey % 15 = 1 AS blank_right FROM orders),
sums AS (
  SELECT g, 0 AS lft, count(*) AS n, sum(total) AS total, min(d) AS first_date, max(d) AS last_date
  FROM lines WHERE NOT blank_left GROUP BY 1
  UNION ALL
  SELECT g, {right}, count(*), sum(total), min(d), max(d) FROM lines WHERE NOT blank_right GROUP BY 1)
SELECT "table", 'h' || pos AS series_id, n AS observations, n AS present,
  CAST(total + n * pos AS DOUBLE) AS total, first_date, last_date
FROM items JOIN sums USING (g, lft)
"""


ALL_DEPOSITS_SQL = _all_deposits_sql()

# --- daily balance, repo operations, ledger ----------------------------------------------------------


def daily_balance_rows(spark, folder) -> DataFrame:
    """A workbook per customer; dates sit in column C, A and B and G are dropped."""
    cells = cell_numbers(35, p2=F.date_format("o_orderdate", "yyyyMMdd"))
    orders = table(spark, folder, "orders")
    return landed(orders, F.col("o_custkey"), F.lit("Serie_diaria"), 27, cells)


def q13_daily_balance(spark, folder):
    return monetary.daily_balance(daily_balance_rows(spark, folder), current_year=2000)


def _q13_sql() -> str:
    kept = [p for p in range(35) if p not in (0, 1, 6)]
    out = ", ".join(
        f'CAST({TOTAL} + {p} AS DOUBLE) AS "{n}"'
        for n, p in zip(layouts.DAILY_BALANCE.split()[1:], kept[1:])
    )
    return f"""
WITH firsts AS (
  SELECT o_custkey AS c, year(arg_min(o_orderdate, o_orderkey)) AS y FROM orders GROUP BY 1)
SELECT CAST(o_custkey AS VARCHAR) AS workbook, {DAY} AS date, {out}
FROM orders JOIN firsts ON c = o_custkey
WHERE y >= 2000 OR {DAY} <= make_date(y, 12, 31)
"""


def repo_rows(spark, folder) -> DataFrame:
    key = F.col("o_orderkey")
    day = F.when(key % 12 == 0, "Nota").otherwise(
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    )
    stock = F.when(key % 5 != 0, (whole("o_totalprice") + 9).cast("string"))
    cells = cell_numbers(
        22, p0=day, p1=F.col("o_orderpriority"), p9=stock, p10=F.col("o_orderstatus")
    )
    return landed(table(spark, folder, "orders"), F.lit("pases"), F.lit("0"), 5, cells)


def q15_repo_sheet(spark, folder):
    return repo.repo_operations(repo_rows(spark, folder))


def _q15_sql() -> str:
    out = []
    for i, name in enumerate(layouts.PASES.names):
        value = {0: DAY, 1: "o_orderpriority", 10: "o_orderstatus"}.get(
            i, f"CAST({TOTAL} + {i} AS DOUBLE)"
        )
        out.append(f'{value} AS "{name}"')
    return (
        f"SELECT 'pases' AS workbook, o_orderkey + 5 AS row, {', '.join(out)} FROM orders "
        "WHERE o_orderkey % 12 <> 0 AND o_orderkey % 5 <> 0"
    )


def ledger_rows(spark, folder) -> DataFrame:
    """Months as serials or day-first text, padded labels, a missing sector, bad amounts."""
    key = F.col("o_orderkey")
    day = F.to_date("o_orderdate")
    serial = F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string")
    cells = F.array(
        F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ")),
        F.when(key % 2 == 0, serial).otherwise(F.date_format(day, "dd/MM/yyyy")),
        F.when(key % 19 != 0, F.concat("o_orderpriority", F.lit("  "))),
        F.lit("concepto"),
        F.when(key % 23 == 0, "-").otherwise(whole("o_totalprice").cast("string")),
        *(F.lit(c) for c in ("cuenta", "categoria", "subcategoria", "detalle", "extra")),
    )
    return landed(table(spark, folder, "orders"), F.lit("balance"), F.lit("1"), 2, cells)


def q8_ledger(spark, folder):
    """Dollars per month, annex and sector."""
    balance = ledger.exchange_balance(ledger_rows(spark, folder))
    return balance.groupBy(F.trunc("mes", "month").alias("mes"), "anexo", "sector").agg(
        F.count(F.lit(1)).alias("lineas"), F.sum("monto_usd").alias("monto_usd")
    )


Q8_SQL = f"""
SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS mes, o_orderstatus AS anexo,
  CASE WHEN o_orderkey % 19 <> 0 THEN o_orderpriority END AS sector, count(*) AS lineas,
  CAST(sum(CASE WHEN o_orderkey % 23 <> 0 THEN {TOTAL} END) AS DOUBLE) AS monto_usd
FROM orders GROUP BY 1, 2, 3
"""


def q8_ledger_gate(spark, folder):
    balance = ledger.exchange_balance(ledger_rows(spark, folder))
    return quality.rule_counts(
        balance, ledger.rules() | {"no amount": F.col("monto_usd").isNull()}
    )


Q8_GATE_SQL = """
SELECT 'too_few_rows' AS rule, CAST(0 AS BIGINT) AS violations
UNION ALL SELECT 'invalid mes', CAST(0 AS BIGINT)
UNION ALL SELECT 'no amount', count(*) FROM orders WHERE o_orderkey % 23 = 0
"""

QUERIES = {
    "s1_sheet_range": (s1_sheet_range, S1_SQL),
    "s1_sheet_rows": (s1_sheet_rows, S1_SQL),
    "f9_take_while": (f9_take_while, F9_SQL),
    "p7_transpose": (p7_transpose, P7_SQL),
    "q3_price_index": (q3_price_index, Q3_SQL),
    "q3_price_observations": (q3_price_observations, Q3_LONG_SQL),
    "p6_ordinal_month": (q10_activity_index, Q10_SQL),
    "q18_real_exchange": (q18_real_exchange, Q18_SQL),
    "q18_until_blank": (q18_until_blank, Q18_BLANK_SQL),
    "q19_narrow_series": (q19_narrow_series, Q19_SQL),
    "q11_monetary_sheets": (q11_monetary_sheets, Q11_SQL),
    "q11_wide_table": (q11_wide_table, _q11_wide_sql()),
    "q12_dashboard_blocks": (q12_dashboard_blocks, Q12_SQL),
    "s14_dashboard_constraints": (s14_dashboard_constraints, S14_DASHBOARD_SQL),
    "m2_placeholder_block": (m2_placeholder_block, M2_SQL),
    "q14_param_loads": (q14_param_loads, Q14_SQL),
    "q13_daily_balance": (q13_daily_balance, _q13_sql()),
    "q15_repo_sheet": (q15_repo_sheet, _q15_sql()),
    "q8_ledger": (q8_ledger, Q8_SQL),
    "q8_ledger_gate": (q8_ledger_gate, Q8_GATE_SQL),
}
