"""Phrase collocations by relational mining of occurrence relations, length by length.

Texts are lowered (A-Z), split at ``[.,;:!?]`` and line ends into pieces and those into words ``[^\\x20\\x09]+``; everything is
counted per language (null: ``und``). The relation of a length holds every occurrence of a phrase of that
length as (chunk, at, group). A chunk holds the occurrences of many whole texts of one task; ``at`` numbers its words in reading
order and skips a number where a piece ends, so it stands for piece and position in one, and two
words follow each other in a piece if their numbers do. Relations are stored sorted by (chunk, at), a row of packed arrays
per chunk. For each length

* groups are counted: every chunk counts its own, one row per chunk and group goes to the shuffle, where the rows of
  a group are summed. Groups with fewer than ``least`` occurrences end there;
* the relation is semi-joined, chunk by chunk, with the groups that are left, and stored;
* it is merge-joined with itself by adjacent places: a phrase and the one that starts a word later make the phrase
  that is one word longer.

Groups are named by the least (chunk, number in it) that holds them, so all keys and counts are exact integers. A group has
one row per chunk at most, however common it is. The score of a phrase is that of its weakest cut, with a = f(phrase), l and r
the counts of both sides: floor(10^6 a a / (l r)), in decimals of 38 digits. A phrase is dropped if one that is one word longer
holds it and has at least ``percent`` of its occurrences; as counts only fall with length, longer ones need no look.

Null texts count as empty; empty texts hold nothing; rows that repeat count each. Texts of any length are read whole; one text is never
split between chunks. Extra columns are ignored; no ids are read. An empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from serieslake.llm.common import settle, text_of
from serieslake.session import ship

LONGEST = 3
LEAST = 10
PERCENT = 50
TOP = 2000
CHUNK = 1 << 21  # words of a chunk, one text's more at most
PARTS = 64  # of a language, ranked on their own first
ROWS = 1 << 17  # rows of one Arrow batch
NUMBER_BITS = 31  # of a group's name; above them the chunk, of which the low SEQUENCE_BITS count chunks of one task
SEQUENCE_BITS = 12

WORDS = "chunk bigint, at binary, held binary, lang array<string>, word array<string>, n array<bigint>"
RELATION = "chunk bigint, at binary, held binary, ids array<bigint>, lasts array<bigint>"
COUNTS = "place bigint, `left` bigint, `right` bigint, n bigint"

# byte -> byte: A-Z lowered, marks that end a piece and line ends a full stop, tab a space
_PLAIN = bytearray(range(256))
_PLAIN[65:91] = bytes(range(97, 123))
for _mark in b",;:!?\n\x0b\x0c\r":
    _PLAIN[_mark] = 46
_PLAIN[9] = 32
_PLAIN = bytes(_PLAIN)


def words_of(text: bytes) -> list[bytes]:
    """The words of a text in UTF-8; a full stop stands where a piece ends."""
    return text.translate(_PLAIN).replace(b".", b" . ").split()


class _Chunk:
    """The words of many texts, numbered per language as they come."""

    def __init__(self):
        self.size = 0
        self._runs: list[np.ndarray] = []
        self._next = itertools.count(1)
        self._numbers: dict[str, dict[bytes, int]] = {}

    def add(self, lang: str, text: bytes) -> None:
        if lang not in self._numbers:
            self._numbers[lang] = defaultdict(self._next.__next__, {b".": 0})
        words = words_of(text)
        words.append(b".")
        self._runs.append(np.fromiter(map(self._numbers[lang].__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def batch(self, chunk: int) -> pa.RecordBatch:
        run = np.concatenate(self._runs)
        at = np.flatnonzero(run)
        held = run[at] - 1
        named = [(n, lang, word) for lang, words in self._numbers.items() for word, n in words.items() if n]
        named.sort()
        row = [chunk, _packed(at), held.astype(np.int32).tobytes()]
        lists = [[x[1] for x in named], [x[2] for x in named], np.bincount(held, minlength=len(named))]
        arrays = [pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.binary(), pa.binary()))]
        for values, kind in zip(lists, (pa.string(), pa.binary(), pa.int64())):
            flat = pa.array(values, kind)
            flat = flat.cast(pa.string()) if kind == pa.binary() else flat
            arrays.append(pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), flat))
        return pa.RecordBatch.from_arrays(arrays, names=["chunk", "at", "held", "lang", "word", "n"])


def _packed(at: np.ndarray) -> bytes:
    """Sorted places as steps of one byte: 1 to the next place, 2 to any other."""
    return np.minimum(np.diff(at, prepend=at[:1] - 2), 2).astype(np.uint8).tobytes()


def _places(packed: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(packed, np.uint8), dtype=np.int64)


def _word_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, chunk = TaskContext.get().partitionId() << SEQUENCE_BITS, _Chunk()
    numbers = iter(range(first, first + (1 << SEQUENCE_BITS)))
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            chunk.add(lang, text)
            if chunk.size >= CHUNK:
                yield chunk.batch(next(numbers))
                chunk = _Chunk()
    if chunk.size:
        yield chunk.batch(next(numbers))


def _extended(at: np.ndarray, held: np.ndarray, ids: np.ndarray, lasts: np.ndarray) -> tuple:
    """The relation merge-joined with itself by adjacent places: (at, key of the group of each occurrence, left, right of a key)."""
    joined = np.flatnonzero(at[1:] == at[:-1] + 1)
    words, last = np.unique(lasts, return_inverse=True)
    keys = held[joined].astype(np.int64) * max(len(words), 1) + last[held[joined + 1]]

    def ends(groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ids[groups // max(len(words), 1)], words[groups % max(len(words), 1)]

    return at[joined], keys, ends


def _relation_of(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return _places(row["at"]), np.frombuffer(row["held"], np.int32), np.array(row["ids"], np.int64), np.array(row["lasts"], np.int64)


def _group_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk's groups of the next length, numbered by their order, with their occurrences."""
    for batch in batches:
        for k in range(batch.num_rows):
            row = batch.slice(k, 1).to_pylist()[0]
            _, keys, ends = _extended(*_relation_of(row))
            groups, n = np.unique(keys, return_counts=True)
            left, right = ends(groups)
            place = (row["chunk"] << NUMBER_BITS) + np.arange(len(groups))
            for a in range(0, len(groups), ROWS):
                columns = [pa.array(x[a : a + ROWS].astype(np.int64)) for x in (place, left, right, n)]
                yield pa.RecordBatch.from_arrays(columns, names=["place", "left", "right", "n"])


def _kept(chunk: int, at: np.ndarray, held: np.ndarray, groups: int, frequent: pa.Table) -> pa.Table:
    """The occurrences of frequent groups as a row; ``held`` numbers the chunk's groups."""
    found = frequent.sort_by("number")
    number = np.full(groups, -1, np.int32)
    number[found["number"].to_numpy()] = np.arange(len(found), dtype=np.int32)
    held = number[held]
    keep = held >= 0
    row = (chunk, _packed(at[keep]), held[keep].tobytes(), found["id"].to_numpy(), found["last"].to_numpy())
    types = (pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    return pa.table({n: pa.array([v], t) for v, n, t in zip(row, ("chunk", "at", "held", "ids", "lasts"), types)})


_NOTHING = pa.table({n: pa.array([], t) for n, t in (("chunk", pa.int64()), ("at", pa.binary()), ("held", pa.binary()), ("ids", pa.list_(pa.int64())), ("lasts", pa.list_(pa.int64())))})


def _kept_words(chunks: pa.Table, frequent: pa.Table) -> pa.Table:
    if not (len(chunks) and len(frequent)):
        return _NOTHING
    row = chunks.to_pylist()[0]
    held = np.frombuffer(row["held"], np.int32)
    return _kept(row["chunk"], _places(row["at"]), held, int(held.max()) + 1, frequent)


def _kept_phrases(chunks: pa.Table, frequent: pa.Table) -> pa.Table:
    if not (len(chunks) and len(frequent)):
        return _NOTHING
    row = chunks.to_pylist()[0]
    at, keys, _ = _extended(*_relation_of(row))
    groups, held = np.unique(keys, return_inverse=True)  # numbered as when they were counted
    return _kept(row["chunk"], at, held, len(groups), frequent)


def _frequent(counted: DataFrame, keys: list[str], least: int, name: str) -> DataFrame:
    """(place, keys, f, id) of the groups with ``least`` occurrences or more: one row per chunk that holds one, settled."""
    group = Window.partitionBy("key", *keys)  # the hash first: rows of one shuffle partition are sorted by it almost alone
    dealt = counted.repartition(*keys).withColumn("key", F.xxhash64(*keys))
    found = dealt.select("place", *keys, F.sum("n").over(group).alias("f"), F.min("place").over(group).alias("id"))
    return settle(found.where(F.col("f") >= least), name)


def _semi_joined(relation: DataFrame, frequent: DataFrame, last: str, kept, name: str) -> DataFrame:
    """The relation's occurrences of frequent groups, settled; groups go to the chunks that hold them."""
    groups = frequent.select(
        F.shiftright("place", NUMBER_BITS).alias("chunk"), F.col("place").bitwiseAND(F.lit((1 << NUMBER_BITS) - 1)).alias("number"), "id", F.col(last).alias("last")
    )
    return settle(relation.groupBy("chunk").cogroup(groups.groupBy("chunk")).applyInArrow(kept, RELATION), name)


def _named(frequent: DataFrame) -> DataFrame:
    """One row per group."""
    return frequent.where("place = id")


def phrases(documents: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, f) of all phrases of up to ``longest`` words with ``least`` occurrences or more, ``words`` being the
    ids of their words; and (lang, n) with the number of all words."""
    ship(documents.sparkSession)
    rows = documents.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), text_of().cast("binary").alias("text"))
    chunks = settle(rows.mapInArrow(_word_chunks, WORDS), "word-chunks")
    held = chunks.select("chunk", F.posexplode(F.arrays_zip("lang", "word", "n")).alias("number", "w"))
    held = held.select((F.shiftleft("chunk", NUMBER_BITS) + F.col("number")).alias("place"), "w.lang", "w.word", "w.n")
    totals = held.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = _frequent(held, ["lang", "word"], least, "frequent-words")
    words = settle(_named(frequent).select("id", "lang", F.array("id").alias("words"), F.col("word").alias("phrase"), "f"), "phrases")
    relation = _semi_joined(chunks.select("chunk", "at", "held"), frequent, "id", _kept_words, "occurrences")
    found = shorter = words
    for length in range(2, longest + 1):
        counted = relation.mapInArrow(_group_counts, COUNTS)
        frequent = _frequent(counted, ["left", "right"], least, "frequent-phrases")
        last = words.select(F.col("id").alias("right"), F.col("phrase").alias("word"))
        first = shorter.select(F.col("id").alias("left"), "lang", "words", "phrase")
        shorter = _named(frequent).join(first, "left").join(last, "right").select(
            "id", "lang", F.concat("words", F.array("right")).alias("words"), F.concat_ws(" ", "phrase", "word").alias("phrase"), "f"
        )
        shorter = settle(shorter, "phrases")
        found = found.union(shorter)
        if length < longest:
            relation = _semi_joined(relation, frequent, "right", _kept_phrases, "occurrences")
    return found.drop("id"), totals


def _score(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    wide = [c.cast("decimal(19,0)") for c in (a, l, r)]
    product = (F.lit(1_000_000).cast("decimal(7,0)") * wide[0]).cast("decimal(26,0)") * wide[0]
    return F.call_function("div", product.cast("decimal(38,0)"), (wide[1] * wide[2]).cast("decimal(38,0)"))


def collocations(documents: DataFrame, longest: int = LONGEST, least: int = LEAST, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases by score, occurrences and bytes."""
    every, totals = phrases(documents, longest, least)
    size = F.size("words")
    candidates = every.where(size > 1).withColumnRenamed("f", "a")
    cuts = candidates.select("words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("first"), F.slice("words", F.col("k") + 1, size - F.col("k")).alias("rest"))
    one = every.select(F.col("words").alias("first"), F.col("f").alias("l"))
    two = every.select(F.col("words").alias("rest"), F.col("f").alias("r"))
    weakest = (
        cuts.join(one, "first").join(two, "rest")
        .groupBy("words").agg(F.min(F.struct(_score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")).alias("cut"))
    )
    inner = F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))
    longer = every.where(size > 2).select(F.explode(inner).alias("words"), "f").groupBy("words").agg(F.max("f").alias("longer"))
    kept = (
        candidates.join(weakest, "words").join(longer, "words", "left")
        .where(F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a")))
        .select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    )
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    # the first of each part of a language are enough, so its last task gets at most PARTS * top rows
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
    kept = kept.withColumn("in_part", F.row_number().over(part)).where(F.col("in_part") <= top).drop("in_part")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*order))
    ranked = kept.select("*", place.alias("rank")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


ORACLE_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), w AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
    SELECT lang, 1 AS size, unnest(w) AS phrase FROM w
    UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM w
    UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM w
), f AS (
    SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), candidates AS (
    SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE size > 1 AND f >= 10
), cuts AS (
    SELECT c.lang, c.phrase, k, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
    FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
    JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(p[1:k], ' ')
    JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(p[k + 1:c.size], ' ')
), weakest AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
    SELECT lang, unnest([p[1] || ' ' || p[2], p[2] || ' ' || p[3]]) AS phrase, a AS longer FROM candidates WHERE size = 3
), held AS (
    SELECT lang, phrase, max(longer) AS longer FROM longer GROUP BY ALL
), ranked AS (
    SELECT c.lang, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, c.phrase) AS rank, c.phrase, a, l, r, n, score::BIGINT AS score
    FROM candidates c JOIN weakest w ON w.lang = c.lang AND w.phrase = c.phrase JOIN totals t ON t.lang = c.lang
    LEFT JOIN held h ON h.lang = c.lang AND h.phrase = c.phrase
    WHERE c.size = 3 OR h.longer IS NULL OR 100 * h.longer < 50 * a
)
SELECT * FROM ranked WHERE rank <= 2000
"""
