"""Exchange balance ledger: typed, gated, and replaced as a whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.functions import text
from serieslake.operators import load, project, quality
from serieslake.sources import layouts, sheets

# Fixed value: a landed file smaller than this is an error page, not a workbook.
MINIMUM_BYTES = 1000


def rules() -> dict[str, Column]:
    """Conditions that mark a bad row."""
    return {"invalid mes": F.col("mes").isNull()}


def exchange_balance(rows: DataFrame, workbook: str | None = None) -> DataFrame:
    """The ledger sheet with dates, trimmed labels and amounts; missing text stays null."""
    table = sheets.read_rows(rows, layouts.BALANCE_CAMBIARIO.of(workbook)).drop("row")
    return project.map_columns(table, text.strip, ["anexo", "sector"])


def store_exchange_balance(balance: DataFrame, path: str, landed: DataFrame | None = None) -> load.LoadResult:
    """All or nothing: an empty batch or any invalid month leaves the table untouched.

    ``landed`` lists the batch's files with their ``length`` (as Spark's ``binaryFile`` source does); one too
    small to be a workbook refuses the batch, too.
    """
    if landed is not None:
        quality.require(landed, {"file too small": file_too_small(F.col("length"))})
    return load.truncate_append(balance, path, rules())


def file_too_small(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) < MINIMUM_BYTES
