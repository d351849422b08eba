"""Exact dedup: batches of documents screened by static filters of immutable snapshots.

Texts are equal when they agree after white space (``[\\x20\\x09-\\x0D]``) is taken out. A snapshot is a table of
distinct normalised texts, bucketed by a 64-bit digest, and one static binary-fuse filter per bucket; neither changes once
written. A batch is handled in these steps:

* its own copies are grouped first, by digest and text, with copies merged before the shuffle;
* one digest per group goes to the filters of every snapshot. A digest that no filter holds is new for certain;
* the others join the exact buckets on digest *and* text, which is the byte check: a false alarm of a filter, or another text
  with the same digest, finds no partner and is new, too;
* what is new becomes a snapshot of its own.

Of equal texts the row with the most code points in its original text stays, then the one with the smallest doc_id;
a null doc_id is smaller than any other. Null texts count as empty, and empty texts are equal. Rows that repeat
doc_id and text count each in ``group_size`` and are marked alike; ``deduplicated`` keeps one of them. Texts of any length are
handled whole. Extra columns are ignored by ``exact_duplicates`` and kept by ``deduplicated``. An empty table gives none.

Groups are named by the SHA-256 of their normalised text, and named groups are joined back to the rows by it. Names
that hold a thousandth of all rows or more, at most a thousand of them, are joined by broadcast, so that no task gets all rows of one text.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.llm import binary_fuse
from serieslake.llm.common import settle, text_of
from serieslake.session import ship

SPACES = r"[\x20\x09-\x0D]+"
BATCHES = 2
BUCKETS = 256  # at least
KEYS = 1 << 18  # digests of one filter, on average, at most
PROBES = 1 << 20  # digests of a batch that meet one filter at a time, on average, at most
HOT = 1000  # a name with one of so many rows is joined by broadcast

FILTERS = "bucket bigint, seed bigint, segment bigint, segments bigint, slots binary"


class Snapshot(NamedTuple):
    """Immutable: (h, norm, name, size, best) of every distinct text, and the filters of its buckets."""

    exact: DataFrame
    filters: DataFrame
    buckets: int


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_of(text), SPACES, "")


def digest(norm: Column) -> Column:
    """What filters and buckets know of a text."""
    return F.xxhash64(norm)


def _bucket(buckets: int) -> Column:
    return F.pmod(F.col("h"), F.lit(buckets))


def grouped(rows: DataFrame) -> DataFrame:
    """(h, norm, name, size, best) of the distinct texts among (doc_id, text); ``best`` is the row that stays."""
    best = F.struct((-F.char_length("text")).alias("shorter"), F.col("doc_id").alias("keep_id"))
    return (
        rows.select(normalised().alias("norm"), best.alias("best"))
        .groupBy(digest(F.col("norm")).alias("h"), "norm")
        .agg(F.count("*").alias("size"), F.min("best").alias("best"))
        .select("h", "norm", F.sha2("norm", 256).alias("name"), "size", "best")
    )


def _built(keys: pa.Table) -> pa.Table:
    fuse = binary_fuse.build(keys["h"].to_numpy())
    row = (keys["bucket"][0].as_py(), fuse.seed, fuse.segment, fuse.segments, fuse.slots.tobytes())
    return pa.table({n: pa.array([v], t) for v, n, t in zip(row, ("bucket", "seed", "segment", "segments", "slots"), [*[pa.int64()] * 4, pa.binary()])})


def _probed(keys: pa.Table, filters: pa.Table) -> pa.Table:
    """The digests that the filter of their bucket may hold; a bucket without a filter holds none."""
    if not (len(keys) and len(filters)):
        return pa.table({"h": pa.array([], pa.int64())})
    row = filters.slice(0, 1).to_pylist()[0]
    fuse = binary_fuse.Fuse(row["seed"], row["segment"], row["segments"], np.frombuffer(row["slots"], np.uint8))
    found = keys["h"].to_numpy()
    return pa.table({"h": found[binary_fuse.holds(fuse, found)]})


def take_snapshot(groups: DataFrame) -> Snapshot:
    """Store distinct texts for good, with a filter for each bucket of digests."""
    ship(groups.sparkSession)
    exact = settle(groups, "snapshot")
    buckets = max(BUCKETS, -(-exact.count() // KEYS))
    keys = exact.select(_bucket(buckets).alias("bucket"), "h")
    return Snapshot(exact, settle(keys.groupBy("bucket").applyInArrow(_built, FILTERS), "filters"), buckets)


def screened(groups: DataFrame, snapshot: Snapshot) -> DataFrame:
    """(h) of the groups' digests that the snapshot's filters may hold."""
    parts = -(-groups.count() // (snapshot.buckets * PROBES)) or 1
    part = F.pmod(F.xxhash64("h"), F.lit(parts))
    keys = groups.select("h").distinct().select(_bucket(snapshot.buckets).alias("bucket"), part.alias("part"), "h")
    filters = snapshot.filters.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return keys.groupBy("bucket", "part").cogroup(filters.groupBy("bucket", "part")).applyInArrow(_probed, "h bigint")


def matched(groups: DataFrame, snapshots: Sequence[Snapshot]) -> tuple[DataFrame, DataFrame]:
    """(known, new) of the distinct texts of a batch, against all snapshots.

    ``known`` has (name, size, best) of texts that a snapshot holds, ``new`` all columns of the others.
    """
    hits = screened(groups, snapshots[0])
    exact = snapshots[0].exact.select("h", "norm")
    for more in snapshots[1:]:
        hits = hits.union(screened(groups, more))
        exact = exact.union(more.exact.select("h", "norm"))  # no text is in two snapshots
    hits = settle(hits.distinct(), "positives")
    positive = groups.join(hits, "h", "left_semi")
    known = settle(positive.join(exact, ["h", "norm"]).select("h", "name", "size", "best"), "known")
    new = groups.join(known.select("h", "name"), ["h", "name"], "left_anti")
    return known.drop("h"), new


def exact_duplicates(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) per row.

    The rows are dealt to ``batches`` by their ids; the first batch becomes a snapshot, each later one is screened against all
    before it. The result does not depend on the number of batches.
    """
    rows = documents.select("doc_id", text_of().alias("text"))
    snapshots, tallies = [], []
    for number in range(batches):
        batch = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == number) if batches > 1 else rows
        groups, last = grouped(batch), number == batches - 1
        if snapshots:
            groups = settle(groups, "batch")
            known, groups = matched(groups, snapshots)
            tallies.append(known)
        if not (snapshots and last):  # nothing is screened against the last batch
            snapshots.append(take_snapshot(groups))
            groups = snapshots[-1].exact
        tallies.append(groups.select("name", "size", "best"))
    tally = tallies[0]
    for more in tallies[1:]:
        tally = tally.union(more)
    tally = settle(
        tally.groupBy("name").agg(F.sum("size").alias("group_size"), F.min("best").alias("best")).select("name", "group_size", "best.*"), "tally"
    )
    named = settle(rows.select("doc_id", (-F.char_length("text")).alias("own"), F.sha2(normalised(), 256).alias("name")), "named-rows")
    least = F.lit(named.count() / HOT)
    hot = F.broadcast(tally.where(F.col("group_size") >= least))  # at most HOT rows
    cool = named.join(hot.select("name"), "name", "left_anti").join(tally.where(F.col("group_size") < least), "name")
    return named.join(hot, "name").unionByName(cool).select(
        "doc_id", "keep_id", "group_size",
        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("shorter"))).alias("kept"),
        F.col("name").alias("text_sha256"),
    )


def deduplicated(documents: DataFrame, batches: int = BATCHES) -> DataFrame:
    """The documents without the copies, all columns as they were."""
    found = exact_duplicates(documents, batches).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("name")).distinct()
    rows = documents.select(F.struct("*").alias("row"), F.col("doc_id").alias("id"), F.sha2(normalised(), 256).alias("name"), (-F.char_length(text_of())).alias("own"))
    # of rows with one id and one normalised text the one with the most code points stays
    first = rows.groupBy("id", "name").agg(F.min_by("row", F.struct("own", F.xxhash64("row"))).alias("row"))
    same = first["id"].eqNullSafe(found["id"]) & (first["name"] == found["name"])
    return first.join(found, same, "left_semi").select("row.*")


# normalised texts and their digests; the rest is the rule of which row stays
ORACLE_SQL = r"""
WITH t AS (
    SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
    SELECT doc_id, norm,
        first_value(doc_id) OVER (PARTITION BY norm ORDER BY points DESC, doc_id) AS keep_id,
        count(*) OVER (PARTITION BY norm) AS group_size
    FROM t
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
