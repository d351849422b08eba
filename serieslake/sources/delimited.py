"""Delimited text with a declared schema (never inferred)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read(
    spark: SparkSession,
    path: str,
    schema: StructType | str,
    sep: str = ",",
    header: bool = True,
    **options: str,
) -> DataFrame:
    """Bad fields become null; the columns follow ``schema`` by position."""
    return (
        spark.read.schema(schema)
        .option("sep", sep)
        .option("header", header)
        .option("enforceSchema", True)
        .option("mode", "PERMISSIVE")
        .options(**options)
        .csv(path)
    )
