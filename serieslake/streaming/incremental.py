"""The recurring incremental load.

Each run picks up the files landed since the last one and appends the rows dated after
the newest stored row, then stops. Progress is kept in the checkpoint; a batch replayed
after a failure adds nothing, because its rows are no longer newer than the table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from serieslake.operators import load


def stream_append_new(
    spark: SparkSession,
    landing: str,
    schema: StructType,
    path: str,
    checkpoint: str,
    shape: Callable[[DataFrame], DataFrame] = lambda df: df,
    date: str = "date",
    by: Sequence[str] = (),
    floor: str | None = None,
    file_format: str = "parquet",
    job: str | None = None,
) -> int:
    """Run one round over the landing folder; returns the number of rows added.

    Everything landed since the last round forms one batch, so rows of one date that
    arrive in several files are loaded together. Each round leaves a line in the table's load log under ``job``.
    """
    added: list[int] = []

    def write(batch: DataFrame, _: int) -> None:
        result = load.append_new(shape(batch), path, date, by, floor, job=job)
        added.append(result.rows)

    query = (
        spark.readStream.format(file_format)
        .schema(schema)
        .load(landing)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return sum(added)
