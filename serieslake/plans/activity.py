"""Activity index and multilateral real exchange rate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.functions import dates
from serieslake.operators import filters
from serieslake.sources import layouts, sheets


def activity_index(
    rows: DataFrame, first_month: str = layouts.EMAE_FIRST_MONTH, workbook: str | None = None
) -> DataFrame:
    """The sheet has no dates: row i of the range is month i.

    ``workbook`` names the workbook (or its beginning, before a vintage) where the landing table
    holds others, too.

    Months are given out before rows without a value are dropped, so a gap does not
    shift later months.
    """
    table = sheets.read_rows(rows, layouts.EMAE.of(workbook))
    month = dates.ordinal_month(first_month, F.col("row") - layouts.EMAE.first_row)
    dated = table.select("workbook", month.alias("date"), *layouts.EMAE.names)
    return filters.with_key(dated, layouts.EMAE.names[0])


def real_exchange_rate(rows: DataFrame, stop_at_blank: bool = False, workbook: str | None = None) -> DataFrame:
    """Rows whose date parses; with ``stop_at_blank`` only those above the first blank."""
    if stop_at_blank:
        layout = layouts.ITCRM
        inside = sheets.of_workbook(rows, workbook).filter(
            (F.col("sheet") == layout.sheet) & (F.col("row") >= layout.first_row)
        )
        first_cell = F.get("cells", F.lit(layout.positions()[0]))
        rows = sheets.until_blank(inside, ["workbook"], "row", first_cell)
    return sheets.read_rows(rows, layouts.ITCRM.of(workbook)).drop("row")
