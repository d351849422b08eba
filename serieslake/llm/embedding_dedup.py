"""Embedding near-dedup on a pivot-permutation index.

Reference vectors (pivots) are drawn from the table by the hash of their ids. Every vector is described
by its nearest pivots; inverted lists hold, for each ``SHARED`` pivots, the vectors that have them all among their
nearest ones, so two vectors meet in a list once they share that many. A pair is taken from the list
of its first shared pivots only. Signs against fixed random planes then drop pairs that are far apart, and
the rest is verified by cosine in double precision. Equal vectors are one node throughout.

Vectors of each length have an index of their own, with their own pivots. The number of pivots follows the square
root of the vectors up to ``MOST_PIVOTS``; beyond that, lists grow with the table. Pivots are the only thing
fitted, all vectors are indexed. Retrieval is approximate (see the README for measured recall); links found are exact.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, and vectors of
different lengths do not link with each other. Rows with a null id are vectors like any other, but name no
component unless all ids are null. Rows that repeat are copies and link with each other.
Extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslake.llm.common import components, settle
from serieslake.session import ship

COSINE = 0.9
MOST_PIVOTS = 2048  # of each length
SHARED = 3
PLANES = 64
# signs that differ at the most: 4.5 deviations above the mean at the threshold's angle
_TURN = math.acos(COSINE) / math.pi
MOST_SIGNS = math.ceil(PLANES * _TURN + 4.5 * math.sqrt(PLANES * _TURN * (1 - _TURN)))
_BASE = 4096  # pivots of a list are the digits of its key


def _unit(batch: pa.Array) -> np.ndarray:
    """Rows of equal length as vectors of length 1."""
    flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(len(batch), -1)
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < math.inf), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _alike(batches: Iterator[pa.RecordBatch], column: int, rows: int) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Slices of the batches whose vectors have one length, with that length."""
    for whole in batches:
        for start in range(0, whole.num_rows, rows):
            batch = whole.slice(start, rows)
            lengths = pc.list_value_length(batch.column(column))
            found = lengths.unique().to_pylist()
            for length in found:
                yield length, batch if len(found) == 1 else batch.filter(pc.equal(lengths, length))


def _n_pivots(n: int) -> int:
    """Pivots for n vectors."""
    return min(MOST_PIVOTS, max(math.isqrt(n), min(n, 9)))


def _indexed(pivots) -> callable:
    """(node, length, signs, nearest pivots in ascending order, how many must be shared, keys of its lists)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = {}
        for length, batch in _alike(batches, 1, 2000):
            near = pivots.value[length]
            nearest = min(len(near), 9 + max(0, math.ceil(math.log2(len(near) / 256))))
            shared = min(SHARED, nearest)
            sets = np.array(list(itertools.combinations(range(nearest), shared)))
            if length not in planes:
                planes[length] = np.random.default_rng(20).standard_normal((length, PLANES))
            unit = _unit(batch.column(1))
            signs = np.packbits(unit @ planes[length] > 0, axis=1).view(np.int64)[:, 0]
            closest = np.sort(np.argsort(-(unit @ near.T), axis=1, kind="stable")[:, :nearest], axis=1)
            keys = np.zeros((len(unit), len(sets)), np.int64)
            for column in sets.T:
                keys = keys * _BASE + closest[:, column]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(np.full(len(unit), length, np.int32)),
                    pa.array(signs),
                    pa.array(list(closest.astype(np.int32)), pa.list_(pa.int32())),
                    pa.array(np.full(len(unit), shared, np.int32)),
                    pa.array(list(keys), pa.list_(pa.int64())),
                ],
                names=["node", "length", "signs", "pivots", "shared", "keys"],
            )

    return mapped


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, batch in _alike(batches, 2, 4000):
        cosine = np.einsum("ij,ij->i", _unit(batch.column(2)), _unit(batch.column(3)))
        yield batch.select([0, 1]).filter(pa.array(cosine >= COSINE))


def _drawn(nodes: DataFrame) -> dict[int, np.ndarray]:
    """length -> pivots: the vectors with the least hashes, of every length that two or more vectors have.

    Only vectors whose hash is below a bound that leaves enough of them are numbered.
    """
    counts = [(length, n, _n_pivots(n)) for length, n in nodes.groupBy("length").count().where("count > 1").collect()]
    wanted = F.broadcast(nodes.sparkSession.createDataFrame(counts, "length int, n long, pivots int"))  # a row per length
    chance = F.col("hash") / F.lit(2.0**64) + F.lit(0.5)
    rows = (
        nodes.withColumn("hash", F.xxhash64("least", "vec")).join(wanted, "length").where(chance * F.col("n") <= 2 * F.col("pivots") + 64)
        .withColumn("place", F.row_number().over(Window.partitionBy("length").orderBy("hash", "node"))).where("place <= pivots")
        .select("length", "vec").toArrow()
    )
    lengths = rows["length"].to_numpy()
    return {length: _unit(rows["vec"].filter(pa.array(lengths == length)).combine_chunks()) for length, _, _ in counts}


def near_duplicates(embeddings: DataFrame, vector: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, n_links, component_id, kept), one row per row of the table."""
    spark = embeddings.sparkSession
    ship(spark)
    rows = embeddings.select(F.col(f"`{key}`").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("vec"))
    usable = rows.where(_usable(F.col("vec")))
    nodes = settle(
        usable.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("copies"))
        .select(F.monotonically_increasing_id().alias("node"), F.size("vec").alias("length"), "vec", "least", "copies"),
        "vectors",
    )
    drawn = _drawn(nodes)
    pivots = spark.sparkContext.broadcast(drawn)  # MOST_PIVOTS vectors of each length at most
    index = settle(
        nodes.where(F.col("length").isin(*drawn)).select("node", "vec").mapInArrow(
            _indexed(pivots), "node bigint, length int, signs bigint, pivots array<int>, shared int, keys array<bigint>"
        ),
        "pivot-index",
    )
    lists = index.select("length", "shared", F.explode("keys").alias("key"), "node", "signs", "pivots")
    other = lists.select("length", "key", *[F.col(c).alias(f"{c}_b") for c in ("node", "signs", "pivots")])
    both = F.array_intersect("pivots", "pivots_b")  # in ascending order, like the digits of a key
    first = F.aggregate(F.slice(both, F.lit(1), F.col("shared")), F.lit(0).cast("long"), lambda k, p: k * _BASE + p)
    pairs = (
        lists.join(other, ["length", "key"])
        .where("node < node_b")
        .where(F.bit_count(F.col("signs").bitwiseXOR(F.col("signs_b"))) <= MOST_SIGNS)
        .where(first == F.col("key"))  # the list of its first shared pivots, so each pair comes once
        .select(F.col("node").alias("src"), F.col("node_b").alias("dst"))
    )
    one = nodes.select(F.col("node").alias("src"), F.col("vec").alias("src_vec"))
    two = nodes.select(F.col("node").alias("dst"), F.col("vec").alias("dst_vec"))
    compared = pairs.join(one, "src").join(two, "dst").select("src", "dst", "src_vec", "dst_vec")
    links = settle(compared.mapInArrow(_verified, "src bigint, dst bigint"), "vector-links")

    copies = nodes.select(F.col("node").alias("dst"), "copies")
    both_ways = links.union(links.select("dst", "src"))
    degree = both_ways.join(copies, "dst").groupBy(F.col("src").alias("node")).agg(F.sum("copies").alias("near"))
    root = components(links).select("node", F.col("component").alias("root"))
    named = (
        nodes.join(degree, "node", "left").join(root, "node", "left")
        .select("vec", "least", F.coalesce("root", "node").alias("root"), (F.coalesce("near", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    )
    leasts = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(leasts, "root").select(F.xxhash64("vec").alias("h"), F.col("vec").alias("__vec"), "n_links", "component_id")
    marked = rows.withColumn("h", F.when(_usable(F.col("vec")), F.xxhash64("vec")))
    out = marked.join(named, (marked["h"] == named["h"]) & (marked["vec"] == named["__vec"]), "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias(key),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.col("id").eqNullSafe(component).alias("kept"),
    )
