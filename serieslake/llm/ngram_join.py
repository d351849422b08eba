"""N-gram Jaccard join by grouped prefixes.

A text is the set of its distinct shingles of ``SHINGLE`` words, or as many as the caller names (words
``[^\\x20\\x09-\\x0D]+``, A-Z lowered; a text of fewer words is one shingle, a text without words none). All
sets share one order of shingles: by hash, those most frequent in prefixes last. Neighbours in that order make a
key, so texts that have single shingles in common by chance, as more and more texts of a larger table do, do not
meet. Two sets whose Jaccard similarity reaches the threshold (``PERCENT``, or what the caller names) share
``OVERLAP`` or more keys of their prefixes (see ``Rule``). Texts with the same prefix and size form a group; group
pairs are filtered by size, by the places of the shared key and by the number
of shared keys, and only then expanded into their members and verified on whole sets.

Candidates come in rounds. The first ones pair each group with a few hubs per key, the most central
one among them; that settles most large groups of near copies in linear work and names, for each group, the
cluster of its heaviest hub. The last round takes all groups that share a key but still lie
in different components, so no link between components is missed: members of one cluster are compared in
blocks, once those are left out that share too little with other components, and all others by pairs.
Copies (equal sets) are one node throughout.

Null texts count as empty; sets without shingles are linked with nothing. Rows that
repeat are copies. A null doc_id never becomes a component_id unless all ids of the
component are null. Extra columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslake.llm import words
from serieslake.llm.common import components, settle, text_of
from serieslake.session import ship

SHINGLE = 4
PERCENT = 85
OVERLAP = 4
FREQUENT = 1 << 18  # shingles moved to the end of the order, at most: 2 MB
FREQUENT_FROM = 32
ALIKE = 3  # percent of its keys that members of a cluster share with its hub
JUMPS = 3  # from hub to heavier hub
ROUNDS = 1  # rounds that pair groups with hubs only, before all pairs across components
HUBS = 8
BLOCK = 64  # copies of a neighbourhood that are verified together
MAP_BITS = 24  # bits of the map that picks texts to verify: 2 MB
KEY_BITS = 25  # bits of the map that picks keys of several texts: 4 MB
SLICE = 500  # rows of an Arrow batch that are Python objects at once


class Rule(NamedTuple):
    """When two texts are linked: 100 * intersection >= percent * union of their shingles.

    A key is made of ``span`` neighbours. Let the prefix of set X end no later than that of Y, let X have a and Y
    have b shingles up to there that the other lacks. Each of them parts one couple of neighbours at most, so of
    the keys of X, span * a + (span - 1) * b at most are no keys of Y. With n, m, o for the sizes of X, Y and their
    intersection that is span * n + (span - 1) * m - (2 * span - 1) * o at most, and for linked sets never over
    span * n * (100 - percent) / 100, as long as couples are only taken above 50 percent.
    """

    shingle: int
    percent: int

    @property
    def span(self) -> int:
        return 2 if self.percent > 50 else 1

    @property
    def apart(self) -> int:
        """Percent of its size that a set's prefix may lose in keys to a linked one."""
        return self.span * (100 - self.percent)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def _shingle_sets(texts: list[str], shingle: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    factors = [np.uint64((2 * 0x51ED270B7A2F1D3 * k + 1) % (1 << 64)) for k in range(1, shingle + 1)]
    for _, run in words.runs(texts):
        found = words.Words(run, words.SPACED)
        h = found.hash
        with np.errstate(over="ignore"):
            shingles = words.mixed(sum(h[k : len(h) - shingle + 1 + k] * factors[k] for k in range(shingle))) if len(h) >= shingle else h[:0]
            for a, b in zip(found.bounds[:-1], found.bounds[1:]):
                if b - a >= shingle:
                    yield np.unique(shingles[a : b - shingle + 1])
                else:
                    yield words.mixed(np.sum(h[a:b] * factors[: b - a], keepdims=True) + np.uint64(b - a)) if b > a else h[:0]


def _prefix_length(n: int, rule: Rule) -> int:
    return min(n, n * rule.apart // 100 + rule.span - 1 + OVERLAP)


def _keys(prefix: np.ndarray, span: int) -> np.ndarray:
    if span == 1:
        return prefix
    with np.errstate(over="ignore"):
        return words.mixed(prefix[:-1] * np.uint64(0x9E3779B97F4A7C15) + prefix[1:])


def _prefix_counts(rule: Rule) -> callable:
    """(hash, texts) of the shingles near the front of hash order, each once per batch."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = (s for part in _sliced([batch]) for s in _shingle_sets(part.column(0).to_pylist(), rule.shingle))
            fronts = [s[: _prefix_length(len(s), rule) * 5 // 4 + 4].copy() for s in sets]
            value, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *fronts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(count.astype(np.int64))], names=["hash", "texts"])

    return mapped


def _members(frequent, rule: Rule) -> callable:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in _sliced(batches):
            sizes, copies, groups, prefixes = [], [], [], []
            for found in _shingle_sets(batch.column(2).to_pylist(), rule.shingle):
                n = len(found)
                sizes.append(n)
                if not n:
                    copies.append(None)
                    groups.append(None)
                    prefixes.append(None)
                    continue
                length = _prefix_length(n, rule)
                if len(late):
                    at = np.minimum(np.searchsorted(late, found), len(late) - 1)
                    is_late = late[at] == found
                    ordered = np.concatenate((found[~is_late], found[is_late]))[:length]
                else:
                    ordered = found[:length]
                copies.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                groups.append(xxhash.xxh3_64_intdigest(ordered.tobytes(), seed=n) - (1 << 63))
                prefixes.append(_keys(ordered, rule.span).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int32()), pa.array(copies, pa.string())]
                + [pa.array(groups, pa.int64()), pa.array(prefixes, pa.list_(pa.int64()))],
                names=["doc_id", "th", "n", "copy", "grp", "keys"],
            )

    return mapped


def _repeated_keys(bits) -> callable:
    """The keys of each text that are on the map, with its size and their place as one long."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, ends = batch.column(2).flatten().to_numpy(), np.cumsum(batch.column(2).value_lengths().to_numpy())
            text = np.repeat(np.arange(batch.num_rows), np.diff(ends, prepend=0))
            place = np.arange(len(keys)) - np.concatenate(([0], ends))[text]
            on = np.flatnonzero(_are_on(keys.view(np.uint64), bits.value, KEY_BITS))
            at = (batch.column(1).to_numpy().astype(np.int64)[text[on]] << 32) + place[on]
            bounds = pa.array(np.searchsorted(text[on], np.arange(batch.num_rows + 1)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(keys[on])), pa.ListArray.from_arrays(bounds, pa.array(at))],
                names=["grp", "hash", "at"],
            )

    return mapped


def _are_on(hashes: np.ndarray, bits: np.ndarray, width: int) -> np.ndarray:
    low = hashes & np.uint64((1 << width) - 1)
    return ((bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63))) & np.uint64(1)).astype(bool)


def _on_map(batches: Iterator[pa.RecordBatch], bits, shingle: int) -> Iterator[np.ndarray]:
    """The sets of the texts whose hash is on the map, copies within the task once."""
    seen = set()
    for batch in _sliced(batches):
        on = _are_on(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, MAP_BITS)
        for k in np.flatnonzero(on):
            th = batch.column(0)[int(k)].as_py()
            on[k] = th not in seen
            seen.add(th)
        yield from _shingle_sets(batch.column(1).filter(pa.array(on)).to_pylist(), shingle)


def _in_runs(sets: Iterator[np.ndarray], size: int = 500) -> Iterator[list[np.ndarray]]:
    while run := list(itertools.islice(sets, size)):
        yield run


def _wanted_sets(bits, shingle: int) -> callable:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _in_runs(_on_map(batches, bits.value, shingle)):
            data = [s.tobytes() for s in run]
            yield pa.RecordBatch.from_arrays(
                [pa.array(map(xxhash.xxh3_128_hexdigest, data), pa.string()), pa.array(data, pa.binary())], names=["copy", "items"]
            )

    return mapped


def _wanted_items(bits, shingle: int) -> callable:
    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in _in_runs(_on_map(batches, bits.value, shingle)):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([xxhash.xxh3_128_hexdigest(s.tobytes()) for s in run], pa.string()),
                    pa.array(map(len, run), pa.int32()),
                    pa.array([s.view(np.int64) for s in run], pa.list_(pa.int64())),
                ],
                names=["copy", "size", "items"],
            )

    return mapped


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _compared(percent: int) -> callable:
    """The links between components within each pair of blocks, whose copies stand together."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in _sliced(batches) for row in zip(*(column.to_pylist() for column in batch.columns)))
        for _, block in itertools.groupby(rows, key=lambda row: row[0]):
            sides = {-1: [], 0: [], 1: []}
            for _, copy, root, side, items in block:
                sides[side].append((copy, root, np.frombuffer(items, np.uint64)))
            pairs = itertools.chain(itertools.combinations(sides[0], 2), itertools.product(sides[-1], sides[1]))
            found = [(one[0], two[0]) for one, two in pairs if one[1] != two[1] and _linked(one[2], two[2], percent)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string()) for k in (0, 1)], names=["src", "dst"])

    return mapped


def _verified(percent: int) -> callable:
    """The pairs that reach the threshold. Rows come by block, each block's sets before its pairs."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in _sliced(batches):
            src, dst = [], []
            for key, one, two, items in zip(*(column.to_pylist() for column in batch.columns)):
                if key != block:
                    block, sets = key, {}
                if items is not None:
                    sets[one] = np.frombuffer(items, np.uint64)
                    continue
                if _linked(sets[one], sets[two], percent):
                    src.append(one)
                    dst.append(two)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(dst, pa.string())], names=["src", "dst"])

    return mapped


def _can_link(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    """Whether sets of sizes n and m that share the shingle at places i and j can reach the threshold."""
    most = F.least(i, j) + 1 + F.least(n - i, m - j) - 1
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _enough(shared: Column, n: Column, m: Column, rule: Rule) -> Column:
    """Whether sets that share so many keys can reach the threshold, whichever's prefix ends first."""

    def lost(one: Column, two: Column) -> Column:
        length = F.least(one, F.floor(one * rule.apart / 100) + rule.span - 1 + OVERLAP)
        return rule.span * one + (rule.span - 1) * two - length

    most = shared + rule.span - 1 + F.greatest(lost(n, m), lost(m, n))
    return (100 + rule.percent) * most >= (2 * rule.span - 1) * rule.percent * (n + m)


def _sets(wanted: DataFrame, texts: DataFrame, shingle: int) -> DataFrame:
    """(copy, items) of at least the wanted copies (copy, th), made again from the texts."""
    bits = texts.sparkSession.sparkContext.broadcast(_map_of(wanted.select("th")))
    sets = texts.select("th", "text").mapInArrow(_wanted_sets(bits, shingle), "copy string, items binary")
    return sets.groupBy("copy").agg(F.first("items").alias("items"))


def _link(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The (src, dst) pairs of copies whose whole sets reach the threshold.

    Pairs are dealt out by the blocks of their two ends, about ``BLOCK`` copies of a neighbourhood each, so
    a set travels once per pair of blocks and not once per pair.
    """
    ends = pairs.select(F.explode(F.array("src", "dst")).alias("copy")).distinct().join(nodes, "copy")
    ends = settle(ends.groupBy("copy").agg(F.min("th").alias("th"), F.min("home").alias("home")), "verified-copies")
    sizes = ends.groupBy("home").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    ends = ends.join(sizes, "home").select("copy", "th", F.xxhash64("home", F.pmod(F.xxhash64("copy"), "blocks")).alias("block"))
    one = ends.select(F.col("copy").alias("src"), F.col("block").alias("src_block"))
    two = ends.select(F.col("copy").alias("dst"), F.col("block").alias("dst_block"))
    least, most = F.least("src_block", "dst_block"), F.greatest("src_block", "dst_block")
    dealt = pairs.join(one, "src").join(two, "dst").select(F.xxhash64(least, most).alias("block"), "src", "dst")
    dealt = settle(dealt, "dealt-pairs")
    places = dealt.select("block", F.explode(F.array("src", "dst")).alias("copy")).distinct()
    rows = (
        places.join(_sets(ends, texts, rule.shingle), "copy").select("block", F.col("copy").alias("one"), F.lit(None).cast("string").alias("two"), "items")
        .union(dealt.select("block", "src", "dst", F.lit(None).cast("binary")))
    )
    rows = rows.repartition("block").sortWithinPartitions("block", F.col("items").isNull())
    return settle(rows.mapInArrow(_verified(rule.percent), "src string, dst string"), "links")


def _cluster_links(nodes: DataFrame, root: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """The (src, dst) links between different components of one cluster.

    A copy of which too few shingles occur in other components of its cluster cannot link to them and
    is left out first; that takes linear work. The others are compared, block by block.
    """
    held = nodes.where("cluster is not null").join(root, "copy").select("cluster", "copy", "th", "root")
    held = settle(_open_clusters(held), "clustered-copies")
    if held.isEmpty():
        return held.select(F.col("copy").alias("src"), F.col("copy").alias("dst"))
    by_number = held.select(F.col("copy"), "cluster", F.xxhash64("copy").alias("node"), F.xxhash64("root").alias("root"))
    bits = texts.sparkSession.sparkContext.broadcast(_map_of(held.select("th")))
    items = texts.select("th", "text").mapInArrow(_wanted_items(bits, rule.shingle), "copy string, size int, items array<bigint>")
    items = items.dropDuplicates(["copy"]).join(by_number, "copy").select("cluster", "node", "root", "size", F.explode("items").alias("item"))
    spot = Window.partitionBy("cluster", "item")
    elsewhere = (
        items.withColumns({"low": F.min("root").over(spot), "high": F.max("root").over(spot)}).where("low != high")
        .groupBy("node").agg(F.count("*").alias("met"), F.min("size").alias("size"))
        .where(100 * F.col("met") >= rule.percent * F.col("size")).select("node")
    )
    held = held.join(elsewhere, F.xxhash64("copy") == F.col("node"), "left_semi")
    held = settle(_open_clusters(held), "open-copies")
    blocks = held.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    places = (
        held.join(blocks, "cluster").withColumn("own", F.pmod(F.xxhash64("copy"), "blocks"))
        .select("cluster", "copy", "root", "own", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("other"))
        .select(
            F.xxhash64("cluster", F.least("own", "other"), F.greatest("own", "other")).alias("block"),
            "copy", "root", F.signum(F.col("own") - F.col("other")).cast("int").alias("side"),
        )
    )
    rows = places.join(_sets(held, texts, rule.shingle), "copy").select("block", "copy", "root", "side", "items")
    rows = rows.repartition("block").sortWithinPartitions("block")
    return settle(rows.mapInArrow(_compared(rule.percent), "src string, dst string"), "cluster-links")


def _open_clusters(held: DataFrame) -> DataFrame:
    """The copies of clusters that fall into several components."""
    several = held.groupBy("cluster").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return held.join(several.select("cluster"), "cluster", "left_semi")


def _expanded(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs of copies (src < dst) from pairs of groups (a, b)."""
    one = nodes.select(F.col("grp").alias("a"), F.col("copy").alias("one"))
    two = nodes.select(F.col("grp").alias("b"), F.col("copy").alias("two"))
    both = groups.join(one, "a").join(two, "b")
    return both.select(F.least("one", "two").alias("src"), F.greatest("one", "two").alias("dst"))


def _size(at: str) -> Column:
    return F.shiftright(at, 32)


def _place(at: str) -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << 32) - 1))


def _counted(met: DataFrame, rule: Rule) -> DataFrame:
    """(a, b, linkable, alike) of groups that meet; one row of (a, at, b, b_at) per meeting.

    ``linkable`` pairs meet under enough keys to be linked, ``alike`` ones under a good part of theirs.
    """
    shorter = F.least("n", "m")
    return (
        met.where(_can_link(_size("at"), _place("at"), _size("b_at"), _place("b_at"), rule.percent))
        .groupBy("a", "b")
        .agg(F.count("*").alias("shared"), F.min(_size("at")).alias("n"), F.min(_size("b_at")).alias("m"))
        .select(
            "a", "b",
            _enough(F.col("shared"), F.col("n"), F.col("m"), rule).alias("linkable"),
            (100 * F.col("shared") >= ALIKE * (shorter * rule.apart / 100 + OVERLAP)).alias("alike"),
        )
        .where("linkable or alike")
    )


def _star_pairs(rows: DataFrame, number: int, rule: Rule) -> DataFrame:
    """Each group with the first group of its keys in each of ``HUBS`` orders: by weight, and random but fixed ones.

    A pair whose meetings are spread over several hubs may be missed here; the last round has it.
    """
    by_weight = -F.col("weight") if number == 0 else F.lit(0.0)
    firsts = [
        F.min(F.struct((by_weight if k == 0 else F.lit(0.0)).alias("first"), F.xxhash64("grp", F.lit(number * HUBS + k)).alias("order"), F.col("grp").alias("b"), F.col("at").alias("b_at"), F.col("root").alias("b_root")))
        for k in range(HUBS)
    ]
    hubs = rows.groupBy("hash").agg(*[f.alias(f"hub{k}") for k, f in enumerate(firsts)])
    hubs = hubs.select("hash", F.array_distinct(F.transform(F.array(*[f"hub{k}" for k in range(HUBS)]), lambda h: h.dropFields("first", "order"))).alias("hubs"))
    met = rows.join(hubs, "hash").select(F.col("grp").alias("a"), "at", "root", "split", F.explode("hubs").alias("hub"))
    met = met.select("a", "at", "root", "split", "hub.b", "hub.b_at", "hub.b_root").where("a != b and (root != b_root or split)")
    return _counted(met.select("a", "at", "b", "b_at"), rule)


def _clustered(nodes: DataFrame, stars: DataFrame, of_group: DataFrame) -> DataFrame:
    """The nodes with the heaviest hub that their group is alike to, or that this hub is alike to in
    turn: their cluster."""
    ends = stars.select(F.col("a").alias("grp"), "b").union(stars.select(F.col("b").alias("grp"), "b"))
    weights = of_group.select(F.col("grp").alias("b"), "weight")
    heaviest = ends.join(weights, "b").groupBy("grp").agg(F.max(F.struct("weight", "b")).alias("hub"))
    cluster = settle(heaviest.select("grp", F.col("hub.b").alias("cluster")), "clusters")
    for _ in range(JUMPS):
        further = cluster.select(F.col("grp").alias("cluster"), F.col("cluster").alias("heavier"))
        cluster = cluster.join(further, "cluster", "left").select("grp", F.coalesce("heavier", "cluster").alias("cluster"))
    return nodes.drop("cluster").join(cluster, "grp", "left")


def _meeting_enough(rows: DataFrame, rule: Rule) -> DataFrame:
    """The rows of groups that hold as many open keys as any link takes; the others cannot link any more."""
    least = F.ceil(F.min(_size("at")) * rule.percent / 100)  # size of the smallest linked set, which takes the fewest
    need = F.least(F.lit(OVERLAP), least - F.floor(least * rule.apart / 100) - (rule.span - 1))
    enough = rows.groupBy("grp").agg(F.count("*").alias("open"), need.alias("need")).where("open >= need")
    return rows.join(enough.select("grp"), "grp", "left_semi")


def _across_clusters(rows: DataFrame, rule: Rule) -> DataFrame:
    """All groups of different components that meet under enough keys, but for those of one cluster."""
    other = rows.select(
        "hash", F.col("grp").alias("b"), F.col("at").alias("b_at"), F.col("root").alias("b_root"),
        F.col("split").alias("b_split"), F.col("cluster").alias("b_cluster"),
    )
    met = (
        rows.withColumnRenamed("grp", "a").join(other, "hash").where("a < b and (root != b_root or split or b_split)")
        .where("cluster is null or b_cluster is null or cluster != b_cluster")
    )
    return _counted(met.select("a", "at", "b", "b_at"), rule)


def _within_groups(nodes: DataFrame, root: DataFrame, last: bool) -> DataFrame:
    """Pairs of members of one group that lie apart: with its first member, or, in the last round, all."""
    held = nodes.join(root, "copy").select("grp", "copy", "root")
    apart = held.groupBy("grp").agg(F.min(F.struct("copy", "root")).alias("first"), F.count_distinct("root").alias("roots")).where("roots > 1")
    if not last:
        found = held.join(apart, "grp").where("root != first.root").select(F.col("copy").alias("src"), F.col("first.copy").alias("dst"))
    else:
        held = held.join(apart.select("grp"), "grp")
        other = held.select("grp", F.col("copy").alias("other"), F.col("root").alias("other_root"))
        found = held.join(other, "grp").where("copy < other and root != other_root").select(F.col("copy").alias("src"), F.col("other").alias("dst"))
    return found.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))


def similar(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """(doc_id, th, n_shingles, component_id, root) per row; th is the hash of the text, root names the
    component even where ids repeat and is null for texts without words.

    Texts are linked whose sets of ``shingle`` words reach ``percent`` of Jaccard similarity.
    """
    rule = Rule(shingle, percent)
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()

    counted = texts.select("text").mapInArrow(_prefix_counts(rule), "hash bigint, texts bigint")
    frequent = (
        counted.groupBy("hash").agg(F.sum("texts").alias("texts")).where(F.col("texts") >= FREQUENT_FROM)
        .orderBy(F.desc("texts"), "hash").limit(FREQUENT).select("hash").toArrow()["hash"]
    )
    late = spark.sparkContext.broadcast(np.sort(frequent.to_numpy().view(np.uint64)))
    members = settle(
        texts.mapInArrow(_members(late, rule), f"doc_id {id_type}, th bigint, n int, copy string, grp bigint, keys array<bigint>"),
        "members",
    )
    nodes = (
        members.where("n > 0").groupBy("grp", "copy").agg(F.min("th").alias("th"))  # any text of the set
    )
    with_keys = members.where("n > 0").select("grp", "n", "keys")
    # most keys are of one text; only the others, and a few on the same bits, meet their groups
    again = with_keys.select(F.explode("keys").alias("hash")).groupBy("hash").count().where("count > 1")
    bits = spark.sparkContext.broadcast(_map_of(again.select("hash"), KEY_BITS))
    groups = with_keys.mapInArrow(_repeated_keys(bits), "grp bigint, hash array<bigint>, at array<bigint>").where(F.size("hash") > 0)
    groups = groups.groupBy("grp").agg(F.first(F.arrays_zip("hash", "at")).alias("keys"))
    entries = groups.select("grp", F.explode("keys").alias("key")).select("key.hash", "grp", "key.at")
    # counted with partial sums, so that a key which very many groups hold gathers in no task
    held = entries.groupBy("hash").agg(F.count("*").alias("held"), F.min("grp").alias("home")).where("held > 1")
    shared = settle(entries.join(held, "hash"), "shared-prefixes")
    # the least group that a group meets anywhere marks its neighbourhood
    # and how often its keys are held shows how central it is: a text that others were edited from comes first
    home = shared.groupBy("grp").agg(F.min("home").alias("home"), (F.sum("held") / F.min(_size("at"))).alias("weight"))
    nodes = settle(nodes.join(home, "grp", "left").withColumn("home", F.coalesce("home", "grp")), "nodes")
    shared = shared.select("hash", "grp", "at")
    root = nodes.select("copy", F.col("copy").alias("root"))  # every copy by itself at first
    nodes = nodes.withColumn("cluster", F.lit(None).cast("long"))
    for number in range(ROUNDS + 1):
        of_group = nodes.join(root, "copy").groupBy("grp").agg(
            F.min("root").alias("root"),
            (F.count_distinct("root") > 1).alias("split"),
            F.max("weight").alias("weight"),
            F.max("cluster").alias("cluster"),
        )
        rows = shared.join(of_group, "grp")
        mixed = (
            rows.groupBy("hash").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max("split").alias("split"))
            .where("low != high or split").select("hash")
        )
        last = number == ROUNDS
        rows = rows.join(mixed, "hash", "left_semi")
        rows = settle(_meeting_enough(rows, rule) if last else rows, "open-prefixes")
        groups = _across_clusters(rows, rule) if last else settle(_star_pairs(rows, number, rule), "group-pairs")
        pairs = settle(_expanded(groups.where("linkable").select("a", "b"), nodes).union(_within_groups(nodes, root, last)).distinct(), "pairs")
        links = pairs if pairs.isEmpty() else _link(pairs, nodes, texts, rule)
        if number == 0:
            nodes = settle(_clustered(nodes, groups, of_group), "clustered-nodes")
        if last:
            links = links.union(_cluster_links(nodes, root, texts, rule))
        if links.isEmpty():
            continue  # nothing to merge
        merged = components(links.union(root.where("copy != root").select("copy", "root")))
        root = nodes.select("copy").distinct().join(merged.withColumnRenamed("node", "copy"), "copy", "left")
        root = settle(root.select("copy", F.coalesce("component", "copy").alias("root")), "roots")

    named = members.select("doc_id", "th", "n", "copy").join(root, "copy", "left")
    least = named.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return named.join(least, "root", "left").select(
        "doc_id",
        "th",
        F.col("n").cast("long").alias("n_shingles"),
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"),
        "root",
    )


def _map_of(hashes: DataFrame, width: int = MAP_BITS) -> np.ndarray:
    """A bit map of fixed size with the low bits of a column of hashes."""
    h = F.col(hashes.columns[0])
    low = h.bitwiseAND(F.lit((1 << width) - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), low.bitwiseAND(F.lit(63)).cast("int"))
    cells = hashes.groupBy(F.shiftright(low, 6).alias("cell")).agg(F.bit_or(bit).alias("held"))
    cells = cells.toArrow()  # at most 2 ** (width - 6) rows
    out = np.zeros(1 << (width - 6), np.uint64)
    out[cells["cell"].to_numpy()] = cells["held"].to_numpy().view(np.uint64)
    return out


def one_of_each(documents: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One document of each component: the one with the least id, then the least text hash.

    Rows that agree in doc_id and text are one document; texts without words all stay.
    """
    found = similar(documents, shingle, percent).withColumn("key", _row_key(F.col("th")))
    keep = (
        found.groupBy("root", F.when(F.col("root").isNull(), F.col("key")).alias("wordless"))
        .agg(F.min(F.struct("doc_id", "th", "key")).alias("first"))
        .select("first.key")
    )
    rows = documents.select(_row_key(F.xxhash64(text_of())).alias("key"), F.struct("*").alias("row"))
    return rows.dropDuplicates(["key"]).join(keep, "key", "left_semi").select("row.*")


def _row_key(text_hash: Column) -> Column:
    """doc_id and text as one string, never null."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(text_hash))
