"""Long to wide, wide to long, unions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot_unique(
    df: DataFrame,
    index: Sequence[str],
    column: str,
    items: Sequence[str],
    value: str,
    prefix: str = "",
) -> DataFrame:
    """Wide form with exactly one value per cell; a second one, or an item not listed, fails the job.

    The items are given, so no extra pass looks for them, and the checks ride on the
    same aggregation: one shuffle in all. They stand on the first index column, so no later
    projection can drop them. Rows of other items are to be filtered out beforehand.
    """
    is_item = {item: F.col(column) == item for item in items}
    wide = df.groupBy(*index).agg(
        F.count_if(~F.coalesce(F.col(column).isin(list(items)), F.lit(False))).alias("_others"),
        *(F.max(F.when(is_item[i], F.col(value))).alias(f"_v{n}") for n, i in enumerate(items)),
        *(F.count(F.when(is_item[i], F.lit(1))).alias(f"_n{n}") for n, i in enumerate(items)),
    )
    checked = F.when(F.col("_others") > 0, F.raise_error(F.lit("pivot item that is not listed")).cast(df.schema[index[0]].dataType))
    for n, item in enumerate(items):
        checked = checked.when(
            F.col(f"_n{n}") > 1,
            F.raise_error(F.lit(f"duplicate pivot cell for {item}")).cast(df.schema[index[0]].dataType),
        )
    return wide.select(
        checked.otherwise(F.col(index[0])).alias(index[0]),
        *index[1:],
        *(F.col(f"_v{n}").alias(f"{prefix}{item}") for n, item in enumerate(items)),
    )


def unpivot(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str],
    name: str = "series_id",
    value: str = "value",
) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)
