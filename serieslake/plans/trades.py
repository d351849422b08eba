"""Fixed-income trades over several endpoints and pages."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from serieslake.functions import text
from serieslake.operators import project
from serieslake.sources import records


def announced_pages(pages: DataFrame, body: str) -> DataFrame:
    """Landed pages with the page count their envelope announces (1 when it is silent)."""
    count = text.json_number(F.col(body), "$.content.page_count", 1)
    return pages.withColumn("page_count", count.cast("int"))


def page_gaps(pages: DataFrame, body: str, by: Sequence[str] = ()) -> DataFrame:
    """Endpoints (per ``by``, such as the run date) whose readable pages are not all there."""
    announced = announced_pages(pages, body)
    return records.missing_pages(announced, "endpoint", "page", "page_count", by, records.readable(F.col(body)))


def announced_keys(pages: DataFrame, body: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, endpoint, page) of all pages that the envelopes of each endpoint announce."""
    count = announced_pages(pages, body).groupBy(*by, "endpoint").agg(F.max("page_count").alias("n"))
    numbers = F.sequence(F.lit(1), F.greatest("n", F.lit(1))).cast(ArrayType(pages.schema["page"].dataType))
    return count.select(*by, "endpoint", F.explode(numbers).alias("page"))


def unreadable_pages(pages: DataFrame, body: str) -> DataFrame:
    """The pages that gave no records because their body could not be read."""
    return records.unreadable(pages, body, ["endpoint", "page"])


def trades(
    pages: DataFrame, body: str, run_date: str, schemas: Mapping[str, str]
) -> DataFrame:
    """All pages of all endpoints in one scan, dated with the run date.

    ``schemas`` gives the declared record fields per endpoint; a field one endpoint
    lacks is null there. Pages are read once with the fields of all endpoints together.
    """
    fields: dict[str, str] = {}
    owners: dict[str, list[str]] = {}
    for endpoint, record in schemas.items():
        for field in StructType.fromDDL(record):
            kind = fields.setdefault(field.name, field.dataType.simpleString())
            if kind != field.dataType.simpleString():
                raise ValueError(f"field {field.name} has two types")
            owners.setdefault(field.name, []).append(endpoint)
    merged = ", ".join(f"`{name}` {kind}" for name, kind in fields.items())
    wanted = pages.filter(F.col("endpoint").isin(list(schemas)))
    found = records.record_array(wanted, body, merged, ["endpoint"])
    named = found.select(
        "endpoint",
        *(F.when(F.col("endpoint").isin(owners[f]), F.col(f)).alias(f) for f in fields),
    )
    return project.with_run_date(named, run_date)
