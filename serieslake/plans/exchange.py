"""Exchange rates: consolidated rate, forex quotes, narrow daily series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.functions import dates, numbers
from serieslake.operators import filters, reshape
from serieslake.sources import delimited, markup, records, sheets

# Quote kinds in order of preference and payload fields.
SPOT_PREFIX = "CCL"
SPOT_PRIORITY = ("CCL", "CCL3", "CCL2", "CCL1")
SPOT_RECORD = "dateTime string, spot string, normalizedPrice double"
FOREX_RECORD = (
    "Fecha string, Titulo string, Rueda string, Monto string, Cotizacion string, Hora string"
)
_DIGITS, _CAPITALS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
TITLE_FIELDS = ("currency_out", "currency_in", "settle", "settle_date")
SCREEN_FIELDS = ("currencyOut", "currencyIn", "settle", "settleDate")


def spot_records(
    payloads: DataFrame, body: str, keep: Sequence[str] = (), field: str | None = "data"
) -> DataFrame:
    """Quotes of spot-price payloads; the record array stands under ``field`` of the envelope
    (``None``: the body itself is the array)."""
    return records.record_array(payloads, body, SPOT_RECORD, keep, field)


def _all_of(col: Column, letters: str) -> Column:
    """Whether a text consists of the given letters and is not empty."""
    return (col != "") & (F.translate(col, letters, "") == "")


def _title_end(title: Column) -> tuple[Column, Column]:
    """The six-digit date that ends an instrument title, and what stands before it."""
    trimmed = F.rtrim(title)
    return F.right(trimmed, F.lit(6)), F.rtrim(F.left(trimmed, F.length(trimmed) - 6))


def title_parts(title: Column, names: Sequence[str] = TITLE_FIELDS) -> list[Column]:
    """Currencies, settlement code and date of a title such as ``USD / ARS 000 150324``.

    The digits at the end are the date and, before it, the settlement code; blanks are optional. A title
    of another form gives nulls.
    """
    date, before = _title_end(title)
    before = F.translate(before, " ", "")
    pair = F.rtrim(before, F.lit(_DIGITS))
    parts = [F.substring_index(pair, "/", 1), F.substring_index(pair, "/", -1), F.substr(before, F.length(pair) + 1), date]
    fits = (
        _all_of(date, _DIGITS) & _all_of(parts[2], _DIGITS) & (F.length(pair) - F.length(F.translate(pair, "/", "")) == 1)
        & _all_of(parts[0], _CAPITALS) & _all_of(parts[1], _CAPITALS)
    )
    return [F.when(fits, part).alias(name) for part, name in zip(parts, names)]


def screen_parts(title: Column, names: Sequence[str] = SCREEN_FIELDS) -> list[Column]:
    """The same of a title on screen, where a currency may have a second word, the slash may be missing
    (the first word is then the one currency, the rest the other) and the code may hold letters."""
    date, before = _title_end(title)
    code = F.substring_index(before, " ", -1)
    pair = F.trim(F.left(before, F.length(before) - F.length(code)))
    slash = pair.contains("/")
    first = F.trim(F.when(slash, F.substring_index(pair, "/", 1)).otherwise(F.substring_index(pair, " ", 1)))
    second = F.trim(
        F.when(slash, F.substring_index(pair, "/", -1)).otherwise(F.substr(pair, F.length(first) + 1, F.length(pair)))
    )
    parts = [first, second, code, date]
    fits = _all_of(date, _DIGITS) & (first != "") & (second != "") & (code != "")
    return [F.when(fits, part).alias(name) for part, name in zip(parts, names)]


def consolidated_rate(
    spots: DataFrame,
    date: str = "dateTime",
    kind: str = "spot",
    price: str = "normalizedPrice",
    by: Sequence[str] = (),
    priority: Sequence[str] = SPOT_PRIORITY,
    prefix: str = SPOT_PREFIX,
) -> DataFrame:
    """One rate per date: the first quote kind that has a price.

    Also gives the second kind on its own (``ccl3``). Two prices for one date and kind
    fail the job. A kind that never occurs is simply null.
    """
    # other kinds under the prefix play no part
    quotes = spots.filter(F.col(kind).startswith(prefix) & F.col(kind).isin(list(priority))).select(
        *by, F.to_date(date).alias("date"), kind, F.col(price).cast("double").alias("_price")
    )
    wide = reshape.pivot_unique(quotes, [*by, "date"], kind, priority, "_price", prefix="_kind_")
    return wide.select(
        *by,
        "date",
        F.coalesce(*(f"_kind_{k}" for k in priority)).alias("ccl"),
        F.col(f"_kind_{priority[1]}").alias("ccl3"),
    )


def has_quotes(spots: DataFrame, kind: str = "spot", part: str = SPOT_PREFIX) -> bool:
    return filters.any_contains(spots, kind, part)


def request_window(
    stored: DataFrame, run_date: str, date: str = "date", floor: str = "2000-01-01"
) -> DataFrame:
    """The dates still to be requested: day after the newest stored one to run date."""
    newest = F.coalesce(F.max(date).cast("date"), F.lit(floor).cast("date"))
    return stored.agg(
        dates.next_day(newest).alias("date_from"), F.lit(run_date).cast("date").alias("date_to")
    )


def forex_quotes(payloads: DataFrame, body: str, keep: Sequence[str] = ()) -> DataFrame:
    """Quotes of forex payloads with the instrument title taken apart."""
    raw = records.record_array(payloads, body, FOREX_RECORD, keep)
    return raw.select(
        *keep,
        dates.parse(F.col("Fecha"), "yyMMdd").alias("date"),
        F.col("Rueda").alias("rueda"),
        F.col("Titulo").alias("instrumento"),
        *title_parts(F.col("Titulo")),
        numbers.comma_thousands(F.col("Monto")).alias("monto"),
        numbers.to_number(F.col("Cotizacion")).alias("cotizacion"),
        dates.time_of_day(F.col("Hora")).alias("hora"),
    )


def forex_screen(
    pages: DataFrame,
    html: str,
    keep: Sequence[str],
    columns: Sequence[str],
    css_class: str | None = None,
) -> DataFrame:
    """Quotes of a rendered forex table; ``columns`` names its cells, Instrumento included. A line with
    more cells than names fails the job."""
    lines = markup.table_rows(pages, html, keep, css_class)
    cells = lines.select(*keep, *markup.named_cells(columns))
    return cells.select("*", *screen_parts(F.col("Instrumento"))).withColumn(
        "settleDate", dates.parse(F.col("settleDate"), "ddMMyy")
    )


def narrow_series(rows: DataFrame, layouts: Sequence[sheets.SheetRange]) -> DataFrame:
    """Two-column sheets (a date and a value) as observations, any number of them.

    Sheets of these workbooks carry no telling name, so the workbook says which series
    it is: rows are matched on ``workbook = table``, all in one scan.
    """

    def cell(one: sheets.SheetRange, name: str) -> Column:
        inside = (
            (F.col("workbook") == one.table)
            & (F.col("sheet") == one.sheet)
            & (F.col("row") >= one.first_row)
        )
        position = dict(one.columns())[name]
        return F.when(inside, one.typed(name, F.get("cells", F.lit(position))))

    found = rows.filter(F.col("workbook").isin([one.table for one in layouts])).select(
        F.col("workbook").alias("series_id"),
        F.coalesce(*(cell(one, "date") for one in layouts)).alias("obs_date"),
        F.coalesce(*(cell(one, one.names[1]) for one in layouts)).alias("value"),
    )
    return filters.with_key(found, "obs_date")


def rate_from_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    """Semicolon-separated history: a ``dd/MM/yy`` date and numbers."""
    schema = ", ".join(f"`{n}` string" if n == "date" else f"`{n}` double" for n in names)
    df = delimited.read(spark, path, schema, sep=";")
    return df.withColumn("date", dates.parse(F.col("date"), "dd/MM/yy"))
