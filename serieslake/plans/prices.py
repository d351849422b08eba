"""Prices: consumer price index, livestock market, US prices, ticker refresh plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.functions import dates, numbers
from serieslake.operators import filters, joins, series
from serieslake.sources import delimited, layouts, markup, sheets

# Livestock columns, US price file columns and series, ticker group.
LIVESTOCK_CLASS = "table-custom"
LIVESTOCK_COLUMNS = (
    "categoria precioMinimo precioMaximo precioPromedio precioMediana totalCabezas importe kgs "
    "promKgs"
).split()
US_PRICE_SCHEMA = (
    "series_id string, year int, period string, value double, footnote_codes string"
)
US_PRICE_SERIES = "CUUR0000SA0"
TICKER_GROUP = "pricesArg"


def price_layout(names: Sequence[str], sheet_rows: Sequence[int]) -> sheets.SheetRange:
    """The price sheet read sideways: its rows become columns."""
    last = max(sheet_rows)
    dropped = tuple(i for i in range(last) if i + 1 not in set(sheet_rows))
    return sheets.SheetRange(
        table="IPCIndec",
        sheet=layouts.PRICE_SHEET,
        first_col="A",
        last_col=_letters(last - 1),
        first_row=2,
        names=tuple(names),
        drop=dropped,
        required=("date",),
    )


def _letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(ord("A") + rest) + out
    return out


def price_levels(cells: DataFrame) -> DataFrame:
    """Index levels: date plus the 126 region-by-item columns, one row per month."""
    layout = price_layout(["date", *layouts.price_columns()], layouts.PRICE_ROWS)
    return sheets.read_cells(sheets.transposed(cells), layout)


def price_index(cells: DataFrame) -> DataFrame:
    """Levels and monthly variations side by side, in one ordered scan per workbook."""
    levels = price_levels(cells).drop("row")
    names = layouts.price_columns()
    varied = series.changes(
        levels, ["workbook"], ["date"], {layouts.variation_name(n): n for n in names}
    )
    return varied.select("workbook", "date", *names, *(layouts.variation_name(n) for n in names))


def price_observations(cells: DataFrame) -> DataFrame:
    """Levels and variations in long form, without a 126-column intermediate.

    Item rows meet the date heading of their column, then one scan per series.
    """
    spark = cells.sparkSession
    names = list(zip(layouts.PRICE_ROWS[1:], layouts.price_columns()))
    items = F.broadcast(spark.createDataFrame(names, "row bigint, series_id string"))
    block = cells.filter(F.col("sheet") == layouts.PRICE_SHEET)
    months = block.filter(F.col("row") == layouts.PRICE_FIRST_ROW).select(
        "workbook", "col", sheets.DATE_READERS["iso_or_serial"](F.col("value")).alias("obs_date")
    )
    levels = block.join(items, "row").select(
        "workbook", "col", "series_id", numbers.to_number(F.col("value")).alias("level")
    )
    dated = levels.join(months, ["workbook", "col"]).filter(F.col("obs_date").isNotNull())
    varied = price_variations(dated, ["workbook", "series_id"], "obs_date", "level")
    return varied.select("workbook", "series_id", "obs_date", "level", "variation")


def price_variations(levels: DataFrame, by: Sequence[str], date: str, value: str) -> DataFrame:
    """Monthly variation in long form: one column, however many series there are."""
    return series.changes(levels, by, [date], {"variation": value})


def livestock_prices(
    pages: DataFrame, html: str, date: str, css_class: str = LIVESTOCK_CLASS
) -> DataFrame:
    """Cleaned market table of every page; ``date`` is the ``dd/MM/yyyy`` request date."""
    lines = markup.table_rows(pages, html, [date], css_class)
    cells = lines.select(
        date,
        *(F.nullif(cell, F.lit("")).alias(name) for name, cell in zip(LIVESTOCK_COLUMNS, markup.named_cells(LIVESTOCK_COLUMNS))),
    )
    price = [c for c in LIVESTOCK_COLUMNS if c.startswith("precio")]
    return filters.complete(cells).select(
        dates.as_text(dates.parse(F.col(date), "dd/MM/yyyy")).alias("date"),
        "categoria",
        *(numbers.point_thousands(F.col(c)).alias(c) for c in price),
        numbers.whole_number(F.col("totalCabezas")).alias("totalCabezas"),
        numbers.implied_cents(F.col("importe")).alias("importe"),
        numbers.whole_number(F.col("kgs")).alias("kgs"),
        numbers.digits_only(F.col("promKgs")).alias("promKgs"),
    )


def daily_requests(
    stored: DataFrame, run_date: str, date: str = "date", floor: str = "2018-01-01"
) -> DataFrame:
    """One request per missing day: pairs with the same start and end."""
    newest = F.coalesce(F.max(date).cast("date"), F.lit(floor).cast("date"))
    span = stored.agg(dates.next_day(newest).alias("_from"))
    days = dates.days_between(F.col("_from"), F.lit(run_date).cast("date"))
    return span.select(F.explode(days).alias("date_from")).withColumn(
        "date_to", F.col("date_from")
    )


def us_prices(spark: SparkSession, path: str, series_id: str = US_PRICE_SERIES) -> DataFrame:
    """One series of the tab-separated price file; its ids are padded with blanks."""
    return select_series(delimited.read(spark, path, US_PRICE_SCHEMA, sep="\t"), series_id)


def select_series(df: DataFrame, series_id: str) -> DataFrame:
    return df.filter(filters.trimmed_equals("series_id", series_id)).withColumn(
        "series_id", F.lit(series_id)
    )


def refresh_plan(
    tickers: DataFrame, stored: DataFrame, group: str = TICKER_GROUP
) -> DataFrame:
    """Next date to request per ticker of a group that has live stored prices."""
    wanted = tickers.filter(F.col("nombre") == group).select("ticker", "type")
    newest = (
        stored.filter(~F.col("matured"))
        .join(wanted.select("ticker").distinct(), "ticker", "left_semi")  # the history is cut before it is grouped
        .groupBy("ticker")
        .agg(dates.next_day(F.max("date")).alias("date"))
    )
    return wanted.join(newest, "ticker", "left").filter(F.col("date").isNotNull())


def split_failures(responses: DataFrame, key: str, parsed: str) -> tuple[DataFrame, DataFrame]:
    """Rows that parsed, and the keys (with counts) of those that did not."""
    good = responses.filter(F.col(parsed).isNotNull())
    failed = (
        responses.filter(F.col(parsed).isNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("failures"))
    )
    return good, failed


def real_money(
    money: DataFrame, price_table: DataFrame, amount: str = "M2",
    level: str = "nacionalNivelGeneral", real: str = "M2Real",
) -> DataFrame:
    """A nominal amount divided by the price level of the same date."""
    joined = joins.on_date(money.select("date", amount), price_table.select("date", level))
    return joined.withColumn(real, numbers.deflated(F.col(amount), F.col(level)))
