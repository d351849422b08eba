"""Reading stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.functions import dates


def read_sql(spark: SparkSession, query: str, **frames: DataFrame) -> DataFrame:
    """Run a SELECT; frames passed by name are usable as ``{name}`` in the text."""
    return spark.sql(query, **frames)


def read_jdbc(
    spark: SparkSession,
    url: str,
    table: str,
    column: str,
    lower: str,
    upper: str,
    partitions: int,
    **options: str,
) -> DataFrame:
    """Parallel read of a database table, split on a numeric or date column."""
    return (
        spark.read.format("jdbc")
        .options(
            url=url,
            dbtable=table,
            partitionColumn=column,
            lowerBound=lower,
            upperBound=upper,
            numPartitions=str(partitions),
            **options,
        )
        .load()
    )


def get_table(
    spark: SparkSession, name: str, freq: str | None = None, catalog: str = "tables"
) -> DataFrame | None:
    """A stored table found through the table catalog, dates as ``yyyy-MM-dd`` text.

    ``catalog`` holds (name, db). ``freq`` keeps one frequency tag. Dates stored as
    epoch seconds are converted. An unknown name gives ``None``.
    """
    owner = spark.table(catalog).filter(F.col("name") == name).select("db").head()
    if owner is None:
        return None
    df = spark.table(f"`{owner.db}`.`{name}`")
    if freq is not None:
        df = df.filter(F.col("tipoSerie") == freq)
    return with_text_date(df)


def with_text_date(df: DataFrame) -> DataFrame:
    if "date" not in df.columns:
        return df
    stored = dict(df.dtypes)["date"]
    day = dates.from_epoch_seconds(F.col("date")) if stored in ("int", "bigint") else F.col("date")
    return df.withColumn("date", dates.as_text(day))
