"""Column lists: positional renames and drops, constants, name rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def rename_all(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """New names by position; the count must match."""
    if len(names) != len(df.columns):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names)


def drop_positions(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    return df.select(*(c for i, c in enumerate(df.columns) if i not in set(positions)))


def rename_first(df: DataFrame, name: str = "date") -> DataFrame:
    return df.withColumnRenamed(df.columns[0], name)


def with_leading(df: DataFrame, name: str, value: Column) -> DataFrame:
    """A new (or moved) column in front of the others."""
    return df.select(value.alias(name), *(c for c in df.columns if c != name))


def with_run_date(df: DataFrame, run_date: str) -> DataFrame:
    """The load date is a job parameter, so a rerun gives the same rows."""
    return with_leading(df, "date", F.lit(run_date).cast("date"))


def rename_by(df: DataFrame, rule: Callable[[str], str], keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*(F.col(c) if c in keep else F.col(c).alias(rule(c)) for c in df.columns))


def map_columns(
    df: DataFrame, expression: Callable[[Column], Column], columns: Sequence[str]
) -> DataFrame:
    """The same expression applied to each listed column, in one projection."""
    chosen = set(columns)
    return df.select(
        *(expression(F.col(c)).alias(c) if c in chosen else F.col(c) for c in df.columns)
    )


def cast_to(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns of a declared schema, in its order; bad values become null."""
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema))
