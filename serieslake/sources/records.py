"""JSON payloads holding an array of records."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def record_array(
    payloads: DataFrame,
    body: str,
    record: str,
    keep: Sequence[str] = (),
    field: str | None = "data",
    with_raw: bool = False,
) -> DataFrame:
    """One row per record of a payload.

    ``record`` is the declared record schema (DDL). ``field`` names the array inside
    the body; ``None`` means the body itself is the array. ``with_raw`` keeps each
    record's text, so fields outside the declared schema are not lost.
    """
    if with_raw:
        wrapped = "array<string>" if field is None else f"struct<{field}:array<string>>"
    else:
        wrapped = (
            f"array<struct<{record}>>"
            if field is None
            else f"struct<{field}:array<struct<{record}>>>"
        )
    parsed = F.from_json(F.col(body), wrapped)
    items = parsed if field is None else parsed[field]
    if with_raw:
        return (
            payloads.select(*keep, F.explode(items).alias("raw"))
            .withColumn("_r", F.from_json("raw", f"struct<{record}>"))
            .select(*keep, "_r.*", "raw")
        )
    return payloads.select(*keep, F.inline(items))


def status(body: Column, field: str | None = "data") -> Column:
    """"stored" for a body that holds its records, else why it does not."""
    return (
        F.when(readable(body, field), "stored").when(body.isNull(), "missing").when(F.trim(body) == "", "empty").otherwise("no records")
    )


def unreadable(payloads: DataFrame, body: str, keep: Sequence[str] = (), field: str | None = "data") -> DataFrame:
    """``keep`` of the payloads that hold no readable record array, with the reason.

    A body that was cut off, or an error page in the place of an answer, gives no records; this is the
    list to report or to refuse the batch by.
    """
    return payloads.select(*keep, status(F.col(body), field).alias("reason")).filter("reason != 'stored'")


def readable(body: Column, field: str | None = "data") -> Column:
    """Whether a body is whole JSON with the array of records in its place."""
    whole = F.try_parse_json(body)
    items = F.try_variant_get(whole, "$" if field is None else f"$.{field}", "array<variant>")
    return items.isNotNull()


def union_pages(pages: Sequence[DataFrame]) -> DataFrame:
    """All pages of all endpoints; columns one endpoint lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def missing_pages(
    pages: DataFrame, endpoint: str, page: str, page_count: str, by: Sequence[str] = (), readable: Column | None = None
) -> DataFrame:
    """Endpoints whose landed pages do not add up to the announced count.

    ``by`` adds to the key (the run date, so that yesterday's page does not stand in for today's);
    only ``readable`` pages count as landed.
    """
    landed = F.col(page) if readable is None else F.when(readable, F.col(page))
    return (
        pages.groupBy(endpoint, *by)
        .agg(
            F.count_distinct(landed).alias("pages_landed"),
            F.max(page_count).cast("long").alias("pages_expected"),
        )
        .filter(F.col("pages_landed") != F.col("pages_expected"))
    )
