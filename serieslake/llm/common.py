"""Helpers shared by the operators: settled tables, row identity, connected components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from serieslake.session import scratch_path, ship

SLICE = 500  # rows of an Arrow batch whose texts are Python objects at once

_settled: list[str] = []
_kept: dict[str, Callable[[], object]] = {}  # by operator, in each Python worker


def keep(operator: str, drop: Callable[[], object]) -> None:
    """Tell this worker how to drop what tasks of an operator keep for later ones."""
    _kept[operator] = drop


def begin(operator: str = "") -> None:
    """A task of an operator begins: what tasks of other operators kept in this worker is dropped."""
    for other in [name for name in _kept if name != operator]:
        _kept.pop(other)()


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def with_columns_of_text(
    df: DataFrame,
    columns: Sequence[str] | None,
    extra: str,
    compute: Callable[[list[str]], Iterable],
    text: str = "text",
    operator: str = "",
) -> DataFrame:
    """``columns`` of a table (all by default) and the ``extra`` columns made from its texts.

    ``compute`` gets the whole texts of ``SLICE`` rows at most and returns one array per extra column.
    A column of the table with the name of an extra one is replaced. A text that is one of the columns travels once.
    ``operator`` names who keeps something in the workers (see ``keep``).
    """
    ship(df.sparkSession)
    made = T.StructType.fromDDL(extra)
    kept = [c for c in (df.columns if columns is None else columns) if c not in made.names]
    kept_fields = [df.select(F.col(f"`{c}`")).schema[0] for c in kept]
    schema = T.StructType(kept_fields + made.fields)
    arrow = to_arrow_schema(schema)
    own = [F.col(f"`{c}`") for c in kept]
    if text in kept and isinstance(kept_fields[kept.index(text)].dataType, T.StringType):
        place = kept.index(text)
    else:
        place = len(kept)
        own.append(text_of(text).alias("__text"))

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(operator)
        for batch in sliced(batches):
            found = compute([t or "" for t in batch.column(place).to_pylist()])
            arrays = list(batch.columns[: len(kept)])
            for value, field in zip(found, list(arrow)[len(kept) :]):
                arrays.append(value if isinstance(value, pa.Array) else pa.array(value, field.type, from_pandas=False))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return df.select(*own).mapInArrow(mapped, schema)


def labelled_sample(documents: DataFrame, labels: DataFrame, label: str, per_class: tuple[int, int]) -> DataFrame:
    """(doc_id, text, label) of at most so many ids of class 0 and class 1, in one partition.

    The ids with the least hash are taken, and of several texts of an id the one with the least hash. Null ids and labels, and
    ids labelled both ways, are left out.
    """
    ship(documents.sparkSession)
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1))
        .groupBy("doc_id")
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other")
    )
    zero, one = (
        marked.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select("doc_id", "label")
        for value, most in enumerate(per_class)
    )
    ids = F.broadcast(zero.union(one))  # at most sum(per_class) rows
    texts = documents.select("doc_id", text_of().alias("text")).join(ids, "doc_id")
    least = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text")))
    return texts.groupBy("doc_id", "label").agg(least.alias("text")).select("doc_id", "text", "label").repartition(1)


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    _settled.append(path)
    return spark.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Where a ``sweep`` of what is settled from now on has to stop."""
    return len(_settled)


def sweep(spark: SparkSession, since: int = 0) -> None:
    """Remove the tables settled since a ``mark``; call it only when every result made from them is stored."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    while len(_settled) > since:
        path = jvm.org.apache.hadoop.fs.Path(_settled.pop())
        path.getFileSystem(conf).delete(path, True)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (src, dst): the least node it can reach.

    Alternating star steps: each pulls the larger neighbours of a node, then the smaller ones,
    to the least neighbour, until nothing moves. Least neighbours are partial aggregates, so a
    node with very many links is merged before the shuffle. Rounds grow with the logarithm of
    the longest chain; each one ends in a settled table. Nulls and self-links are ignored.
    """

    def state_of(table: DataFrame) -> tuple:
        return tuple(table.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    stars = settle(
        edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(),
        "stars",
    )
    seen = state_of(stars)
    while seen[0]:
        both = stars.select("u", "v").union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = (
            small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        stars = settle(small, "stars")
        state = state_of(stars)
        if state == seen:
            break
        seen = state
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return nodes.union(roots).groupBy("node").agg(F.min("component").alias("component"))
