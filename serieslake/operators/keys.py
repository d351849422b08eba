"""Keys of a batch against the keys that a stored table holds already.

Every folder of a stored table gets Bloom filters of its keys, kept beside the table and named by its versions. Folders never
change once written, so a filter is built once, from the key columns of its own folder. A batch meets only the folders of
the partition values it has rows for; its keys go to their filters, and only the folders with a key that passes are read for
the exact join. Large folders have several filters, by the hash of the key, so no task gets a folder whole.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.operators import load, quality, versions
from serieslake.session import ship

FILTERS = "_filters"
SLICE = 1 << 20  # keys of one filter, or of a batch that meet one filter at a time, on average, at most
BITS = 10  # of a filter per key: one other key in a hundred passes
PROBES = 7
SCHEMA = "entry string, slice bigint, slices bigint, bits binary"


def _places(hashes: np.ndarray, size: int) -> np.ndarray:
    """The ``PROBES`` places of each hash among ``size`` bits, one row per hash."""
    low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
    steps = np.arange(PROBES, dtype=np.uint64)
    return ((low[:, None] + high[:, None] * steps) % np.uint64(size)).astype(np.int64)


def _built(rows: pa.Table) -> pa.Table:
    hashes = rows["h"].to_numpy().view(np.uint64)
    bits = np.zeros(max(64, -(-len(hashes) * BITS // 8) * 8), bool)
    bits[_places(hashes, len(bits)).ravel()] = True
    one = rows.slice(0, 1).select(["entry", "slice", "slices"])
    return one.append_column("bits", pa.array([np.packbits(bits).tobytes()], pa.binary()))


def _passing(keys: pa.Table, filters: pa.Table) -> pa.Table:
    names = [n for n in keys.column_names if n not in ("_slice", "_part", "h")]
    if not (len(keys) and len(filters)):
        return keys.select(names).slice(0, 0)
    bits = np.unpackbits(np.frombuffer(filters["bits"][0].as_py(), np.uint8)).astype(bool)
    hashes = keys["h"].to_numpy().view(np.uint64)
    return keys.select(names).filter(pa.array(bits[_places(hashes, len(bits))].all(axis=1)))


def _entry(path: str):
    """The folder of the table that a row was read from."""
    inner = F.substring_index(F.input_file_name(), f"{path.rstrip('/').rpartition('/')[2]}/{versions.LOAD}=", -1)
    return F.concat(F.lit(f"{versions.LOAD}="), F.regexp_replace(inner, "/[^/]*$", ""))


def filters(spark: SparkSession, path: str, key: Sequence[str]) -> DataFrame:
    """(entry, slice, slices, bits) of all folders of the newest version; those without one are built and published."""
    ship(spark)
    version, key = versions.newest(spark, path), tuple(key)
    folders = version.sides.get(FILTERS, ()) if version.keys.get(FILTERS) == key else ()
    held = spark.read.schema(SCHEMA).parquet(*[f"{path}/{f}" for f in folders]) if folders else spark.createDataFrame([], SCHEMA)
    known = {r.entry for r in held.select("entry").distinct().collect()}  # one short row per folder of the table
    missing = [e for e in version.entries if e not in known]
    if missing:
        rows = versions.read_entries(spark, path, missing, version.struct).select(_entry(path).alias("entry"), F.xxhash64(*key).alias("h"))
        sizes = rows.groupBy("entry").agg(F.ceil(F.count("*") / SLICE).cast("long").alias("slices"))
        sliced = rows.join(sizes, "entry").withColumn("slice", F.pmod(F.xxhash64("h"), "slices"))
        place = load.keep_side(sliced.groupBy("entry", "slice").applyInArrow(_built, SCHEMA), path, FILTERS)
        folders = (*folders, place)
        versions.publish(
            spark, path,
            replace(version, number=version.number + 1, mode="filters", rows=0,
                    sides={**version.sides, FILTERS: folders}, keys={**version.keys, FILTERS: key}),
        )
    found = spark.read.schema(SCHEMA).parquet(*[f"{path}/{f}" for f in folders]) if folders else held
    return found.join(spark.createDataFrame([(e,) for e in version.entries], "entry string"), "entry", "left_semi")


def stored_keys(batch: DataFrame, path: str, key: Sequence[str], partition: str | None = None) -> DataFrame:
    """The keys of the batch that the stored table holds, each once. Null keys are keys like any other.

    ``partition`` names a partition column that a key determines: then only the folders of the batch's own values are
    looked at. The batch must have that column.
    """
    spark, key = batch.sparkSession, list(key)
    own = batch.select(*key, *([F.col(partition).cast("string").alias("_value")] if partition else [F.lit("").alias("_value")])).distinct()
    version = versions.newest(spark, path)
    if version is None:
        return own.select(*key).limit(0)
    found = filters(spark, path, key)
    value = F.regexp_extract("entry", f"(?:^|/){partition}=([^/]*)", 1) if partition else F.lit("")
    slices = found.groupBy("entry").agg(F.max("slices").alias("_slices")).select(F.col("entry").alias("_entry"), "_slices", value.alias("_value"))
    parts = -(-own.count() // SLICE) or 1
    probes = own.join(slices, "_value").withColumn("h", F.xxhash64(*key)).select(
        *key, "_entry", F.pmod(F.xxhash64("h"), "_slices").alias("_slice"), F.pmod(F.xxhash64("h", F.lit(1)), F.lit(parts)).alias("_part"), "h"
    )
    dealt = found.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    schema = ", ".join([f"`{k}` {batch.schema[k].dataType.simpleString()}" for k in key] + ["_entry string"])
    place = load.keep_side(
        probes.groupBy("_entry", "_slice", "_part").cogroup(dealt.groupBy("entry", "slice", "part")).applyInArrow(_passing, schema), path, "_passing"
    )
    passing = spark.read.schema(schema).parquet(f"{path}/{place}")
    entries = [r._entry for r in passing.select("_entry").distinct().collect()]  # folders to read
    exact = versions.read_entries(spark, path, entries, version.struct).select(*[F.col(k).alias(f"_key_{k}") for k in key])
    candidates = passing.select(*key).distinct()
    same = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key]
    return candidates.join(exact, same, "left_semi")


def append_unique(df: DataFrame, path: str, key: Sequence[str], partition_by: Sequence[str] = (), job: str | None = None) -> load.LoadResult:
    """Add a batch whose keys repeat neither among themselves nor what is stored; else it is refused."""
    partition = partition_by[0] if partition_by else None
    quality.refuse(
        {
            f"primary key ({', '.join(key)})": quality.duplicate_keys(df, key).count(),
            f"stored key ({', '.join(key)})": stored_keys(df, path, key, partition).count(),
        }
    )
    return load.append(df, path, partition_by, job)
