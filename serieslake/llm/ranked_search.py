"""Ranked lexical search over inverted segments, in a hybrid of term-at-a-time and document-at-a-time.

Terms are runs of ASCII letters, digits and all characters beyond ASCII, with A-Z lowered. A term that df of the N
documents with terms hold weighs floor(1000 * ln((2N + 2) / (2 df + 1))); a document of n terms scores the sum over the
item's terms, repeats included, of weight * (10^9 tf div (1000 tf + 8 m)) with m = 25 + (75 n N) div L, where L counts
the terms of all documents. All but the logarithm is 64-bit integers.

``index`` makes one pass over the texts: every task turns its documents into segments, each at most ``SEGMENT`` documents
(in doc_id order) and their postings of the terms that are asked for. No text is shuffled. Statistics are sums over all
segments. ``search`` then answers every item in every segment:

* lists that hold at most one document of ``SHORT`` in the segment are summed into accumulators, term at a time;
* the accumulators become one more iterator, with the largest sum as its bound, beside the long lists;
* these are walked document at a time, in windows of ``WINDOW`` documents with skip places and largest impacts per
  list: a window whose bounds cannot beat the score of the last of the best so far is skipped whole; within
  a window the iterators that together cannot beat it give no candidates and are only probed for those of the others.

So each segment gives its best documents exactly, and the best of those are the best of all.

Items come in blocks of about ``BLOCK`` terms (an item is never split), so what goes to the tasks is bounded; each block
reads the texts once. Rows of one item_id are one item; a null item_id is an item like any other. Null and empty texts
have no terms. Rows that repeat a doc_id are documents of their own; a null doc_id is ranked behind equal scores. Texts of any
length are read whole. Extra columns are ignored. Items without terms, and empty tables, give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from serieslake.llm.common import settle, text_of
from serieslake.session import ship

TOP = 10
BLOCK = 200_000
SEGMENT = 1 << 16
POSTINGS = 1 << 23  # of a segment, at most one document's more
SHORT = 16
WINDOW = 1024

SEGMENTS = "n_docs bigint, n_terms bigint, docs binary, known binary, lengths binary, terms array<int>, counts array<bigint>, places binary, tf binary"
# byte -> byte: A-Z lowered, whatever is no part of a term a space
_TERMS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(_TERMS).split()


class Segment(NamedTuple):
    """Documents in id order, and per term the places of the documents that hold it."""

    docs: np.ndarray
    known: np.ndarray  # whether the doc_id is not null
    lengths: np.ndarray
    lists: dict[int, tuple[int, int]]  # term -> where its postings stand
    places: np.ndarray
    tf: np.ndarray


class Builder:
    """Gathers the documents of one segment."""

    def __init__(self, numbers: dict[bytes, int]):
        self._numbers = numbers
        self.clear()

    def clear(self) -> None:
        self.n_docs = self.n_terms = self.postings = 0
        self._docs, self._lengths, self._found, self._tf = [], [], [], []

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = terms_of(text)
        self.n_docs += bool(terms)
        self.n_terms += len(terms)
        counts = Counter(filter(self._numbers.__contains__, terms))
        if counts:
            self._docs.append(doc_id)
            self._lengths.append(len(terms))
            self._found.append(np.fromiter(map(self._numbers.__getitem__, counts), np.int32, len(counts)))
            self._tf.append(np.fromiter(counts.values(), np.int64, len(counts)))
            self.postings += len(counts)

    def full(self) -> bool:
        return len(self._docs) >= SEGMENT or self.postings >= POSTINGS

    def batch(self) -> pa.RecordBatch:
        """The segment as one row."""
        known = np.array([d is not None for d in self._docs], bool)
        docs = np.array([0 if d is None else d for d in self._docs], np.int64)
        order = np.lexsort((docs, ~known))
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        sizes = np.array([len(f) for f in self._found], np.int64)
        places = np.repeat(place, sizes)
        found = np.concatenate([np.zeros(0, np.int32), *self._found])
        tf = np.concatenate([np.zeros(0, np.int64), *self._tf])
        by_term = np.lexsort((places, found))
        terms, counts = np.unique(found, return_counts=True)
        lengths = np.array(self._lengths, np.int64)
        row = (
            self.n_docs, self.n_terms, docs[order].tobytes(), known[order].tobytes(), lengths[order].tobytes(),
            terms.tolist(), counts.tolist(), places[by_term].tobytes(), tf[by_term].tobytes(),
        )
        types = [pa.int64()] * 2 + [pa.binary()] * 3 + [pa.list_(pa.int32()), pa.list_(pa.int64())] + [pa.binary()] * 2
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types)], names=names)


def index(documents: DataFrame, terms: list[bytes]) -> DataFrame:
    """The segments of all documents with the postings of the given terms, settled; a term is named by its place in the list."""
    ship(documents.sparkSession)
    numbers = documents.sparkSession.sparkContext.broadcast({t: n for n, t in enumerate(terms)})

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder = Builder(numbers.value)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                builder.add(doc_id, text)
                if builder.full():
                    yield builder.batch()
                    builder.clear()
        if builder.n_docs:
            yield builder.batch()

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("text"))
    return settle(rows.mapInArrow(indexed, SEGMENTS), "segments")


def _segment(row: dict) -> Segment:
    ends = np.cumsum(np.array(row["counts"], np.int64)).tolist()
    return Segment(
        np.frombuffer(row["docs"], np.int64), np.frombuffer(row["known"], bool), np.frombuffer(row["lengths"], np.int64),
        {t: (b - n, b) for t, n, b in zip(row["terms"], row["counts"], ends)},
        np.frombuffer(row["places"], np.int32), np.frombuffer(row["tf"], np.int64),
    )


class _List(NamedTuple):
    """An iterator: places, what each adds to a score, and per window where it begins and the most it adds there."""

    places: np.ndarray
    adds: np.ndarray
    begins: np.ndarray
    most: np.ndarray


def _iterator(places: np.ndarray, adds: np.ndarray, edges: np.ndarray) -> _List:
    begins = np.searchsorted(places, edges)
    most = np.zeros(len(edges) - 1, np.int64)
    filled = begins[:-1] < begins[1:]
    if len(adds):
        most[filled] = np.maximum.reduceat(adds, begins[:-1][filled])
    return _List(places, adds, begins, most)


def _summed(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Accumulators of short lists: (places, sums), by place."""
    places, adds = (np.concatenate(x) for x in zip(*lists))
    order = np.argsort(places, kind="stable")
    places, adds = places[order], adds[order]
    firsts = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    return places[firsts], np.add.reduceat(adds, firsts)


class Searcher:
    """Answers items in one segment."""

    def __init__(self, segment: Segment, n_docs: int, n_terms: int):
        self._segment, self._size = segment, len(segment.docs)
        m = 25 + (75 * segment.lengths * n_docs) // max(n_terms, 1)
        self._impacts = (1_000_000_000 * segment.tf) // (1000 * segment.tf + 8 * m[segment.places])
        self._edges = np.append(np.arange(0, self._size, WINDOW), self._size)
        self._long: dict[int, _List] = {}
        self.windows = self.skipped = 0

    def _of_term(self, term: int) -> _List:
        """A long list by impacts alone; every item's factor scales it."""
        if term not in self._long:
            a, b = self._segment.lists[term]
            self._long[term] = _iterator(self._segment.places[a:b], self._impacts[a:b], self._edges)
        return self._long[term]

    def best(self, factors: dict[int, int], top: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the best documents for term -> weight * repeats; higher scores first, then lower places."""
        lists = self._segment.lists
        held = [(t, f) for t, f in factors.items() if f > 0 and t in lists]
        short = [(t, f) for t, f in held if (lists[t][1] - lists[t][0]) * SHORT <= self._size]
        walked = [(self._of_term(t), f) for t, f in held if (lists[t][1] - lists[t][0]) * SHORT > self._size]
        if short:
            parts = [(self._segment.places[slice(*lists[t])], self._impacts[slice(*lists[t])] * f) for t, f in short]
            walked.append((_iterator(*_summed(parts), self._edges), 1))
        places, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if not walked:
            return places, scores
        bounds = np.array([x.most * f for x, f in walked])
        total = bounds.sum(axis=0)
        for window in range(len(self._edges) - 1):
            floor = scores[-1] if len(scores) == top else 0
            self.windows += 1
            if total[window] <= floor:
                self.skipped += 1
                continue
            more = self._walk(walked, bounds[:, window], window, floor)
            if len(more[0]):
                places, scores = np.concatenate((places, more[0])), np.concatenate((scores, more[1]))
                first = np.lexsort((places, -scores))[:top]
                places, scores = places[first], scores[first]
        return places, scores

    def _walk(self, walked: list[tuple[_List, int]], bounds: np.ndarray, window: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents of a window that beat ``floor``."""
        order = np.argsort(bounds, kind="stable")
        reach = np.cumsum(bounds[order])
        idle = int(np.searchsorted(reach, floor, side="right"))  # so many iterators cannot beat it together
        start = int(self._edges[window])
        sums = np.zeros(int(self._edges[window + 1]) - start, np.int64)
        for number in order[idle:]:
            x, factor = walked[number]
            a, b = x.begins[window], x.begins[window + 1]
            sums[x.places[a:b] - start] += x.adds[a:b] * factor
        found = np.flatnonzero(sums)
        for k in range(idle - 1, -1, -1):
            found = found[sums[found] + reach[k] > floor]
            if not len(found):
                break
            x, factor = walked[order[k]]
            a, b = x.begins[window], x.begins[window + 1]
            if a < b:
                at = np.minimum(np.searchsorted(x.places[a:b], found + start), b - a - 1) + a
                hit = x.places[at] == found + start
                sums[found[hit]] += x.adds[at[hit]] * factor
        found = found[sums[found] > floor]
        return found + start, sums[found]


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, terms, repeats = [], [], []
        for row, text in enumerate(batch.column(1).to_pylist()):
            counts = Counter(terms_of(text))
            at += [row] * len(counts)
            terms += counts
            repeats += counts.values()
        columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.binary()), pa.array(repeats, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["item_id", "term", "repeats"])


def search(documents: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score) of the ``top`` documents of each item with a score above 0."""
    ship(documents.sparkSession)
    id_type = items.schema["item_id"].dataType
    asked = items.select("item_id", text_of().cast("binary").alias("text"))
    asked = asked.mapInArrow(_item_terms, f"item_id {id_type.simpleString()}, term binary, repeats bigint")
    asked = settle(asked.groupBy("item_id", "term").agg(F.sum("repeats").alias("repeats")), "item-terms")
    blocks = -(-asked.count() // BLOCK) or 1
    found = None
    for number in range(blocks):
        block = asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == number).collect()  # about BLOCK rows
        more = _answers(documents, [tuple(row) for row in block], id_type, top)
        found = more if found is None else found.union(more)
    # each task's best of an item are taken before the shuffle
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.select("item_id", place.alias("rank"), "doc_id", "score").where(F.col("rank") <= top)


def _answers(documents: DataFrame, block: list[tuple], id_type, top: int) -> DataFrame:
    """(item_id, doc_id, score): the best documents of every segment for the items of a block."""
    terms = sorted({bytes(term) for _, term, _ in block})
    segments = index(documents, terms)
    n_docs, n_terms = (x or 0 for x in segments.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    held = segments.select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy("t.terms").agg(F.sum("t.counts").alias("df"))
    weights = {term: weight(n_docs, df) for term, df in held.collect()}  # at most one row per term of the block
    numbers = {term: number for number, term in enumerate(terms)}
    factors: dict = {}
    for item, term, repeats in block:
        factors.setdefault(item, {})[numbers[bytes(term)]] = repeats * weights.get(numbers[bytes(term)], 0)
    arrow = to_arrow_type(id_type)
    asked = documents.sparkSession.sparkContext.broadcast(factors)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                segment = _segment(batch.slice(k, 1).to_pylist()[0])
                searcher = Searcher(segment, n_docs, n_terms)
                items, docs, known, scores = [], [], [], []
                for item, of_terms in asked.value.items():
                    at, score = searcher.best(of_terms, top)
                    items += [item] * len(at)
                    docs.append(segment.docs[at])
                    known.append(segment.known[at])
                    scores.append(score)
                ids = pa.array(np.concatenate(docs), mask=~np.concatenate(known)) if docs else pa.array([], pa.int64())
                columns = [pa.array(items, arrow), ids, pa.array(np.concatenate(scores) if scores else [], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "doc_id", "score"])

    return segments.drop("n_docs", "n_terms").mapInArrow(answered, f"item_id {id_type.simpleString()}, doc_id bigint, score bigint")


ORACLE_SQL = r"""
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), s AS (
    SELECT count(*) AS n_docs, sum(len(terms))::BIGINT AS n_terms FROM d WHERE len(terms) > 0
), p AS (
    SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL
), w AS (
    SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM p, s GROUP BY term, n_docs
), q AS (
    SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
    FROM benchmark
), scored AS (
    SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
    FROM q JOIN w USING (term) JOIN p USING (term), s GROUP BY item_id, doc_id
), ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 10
"""
