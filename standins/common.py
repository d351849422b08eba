"""Shared stand-in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    """A sparse daily series per user."""
    return (
        table(spark, folder, "events")
        .groupBy(F.col("user_id").alias("series_id"), F.to_date("ts").alias("obs_date"))
        .agg(F.avg("value").alias("value"))
    )


DAILY_SQL = """
daily AS (
  SELECT user_id AS series_id, CAST(ts AS DATE) AS obs_date, avg(value) AS value
  FROM events GROUP BY 1, 2)
"""


def monthly(spark: SparkSession, folder: str) -> DataFrame:
    """A monthly total per order priority."""
    return (
        table(spark, folder, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("series_id"),
            F.trunc("o_orderdate", "month").alias("obs_date"),
        )
        .agg(F.sum("o_totalprice").alias("value"))
    )


MONTHLY_SQL = """
monthly AS (
  SELECT o_orderpriority AS series_id, CAST(date_trunc('month', o_orderdate) AS DATE) AS obs_date,
         sum(o_totalprice) AS value
  FROM orders GROUP BY 1, 2)
"""


def whole(column: str):
    """A positive amount as a whole number, so sums are exact in any order."""
    return F.floor(F.col(column) + 0.5)
