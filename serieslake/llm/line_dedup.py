"""Line dedup over content-defined chunks of lines.

A line of ``LONG_WORDS`` words or more is a chunk of its own. Shorter lines form chunks of several, whose boundaries
are chosen by a hash that rolls over the hashes of ``ROLLED`` lines: of every run of lines with ``WINDOW_WORDS`` words the
line with the least rolling hash begins a chunk (all of them, if several are least), and so does the first line of a text or after
a long line. A chunk closes at the line that brings it to ``LEAST_WORDS`` words; a long line ends it without one.
So chunks depend on nearby lines alone, wherever they stand, and every repeat of ``WINDOW_WORDS`` and
``LEAST_WORDS`` words, rounded up to whole lines each, holds one. Chunks are compared over the whole corpus: the first occurrence (least doc_id, then position) stays, every later
one is removed once its bytes equal the first one's, unless both overlap. A removed chunk takes along the short
lines next to it that equal, byte for byte, those next to the first occurrence; as a chunk begins in every window,
fewer than ``REACH`` words are left there.

Words are runs between white space of any kind; in scripts written without spaces two letters count as a word.
Texts of any length are read whole, line by line. Null texts count as empty; an emptied text stays as an empty text, no row is dropped. Rows that
agree in doc_id and text are one document; a null doc_id is an id like any other and comes first.
Extra columns are kept; ``n_chars``, if present, follows the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from serieslake.llm.common import settle, text_of
from serieslake.session import ship

LONG_WORDS = 10
LEAST_WORDS = 10
WINDOW_WORDS = 5
ROLLED = 2
REACH = 25
_BASE, _BITS = 0x9E3779B97F4A7C15, (1 << 64) - 1
# Thai, Lao, Tibetan, Burmese, Khmer, kana, Chinese characters
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def _n_words(line: str) -> int:
    spaced = len(line.split())
    return spaced if line.isascii() else spaced + len(_UNSPACED.findall(line)) // 2


def _rolling(lines: list[str]) -> list[int]:
    """At each line the polynomial hash of ``ROLLED`` line hashes, as far as there are lines."""
    hashes = [xxhash.xxh3_64_intdigest(line) for line in lines]
    lead = pow(_BASE, ROLLED, 1 << 64)
    out, rolled = [0] * len(lines), 0
    for i in range(len(lines) - 1, -1, -1):
        left = hashes[i + ROLLED] if i + ROLLED < len(lines) else 0
        # the new line enters with the least power, the one that leaves has the highest
        rolled = (rolled * _BASE + hashes[i] - left * lead) & _BITS
        out[i] = rolled
    return out


def _starts(lines: list[str], words: list[int], run: list[int]) -> list[int]:
    """Which lines of a run of short ones begin chunks, counted within the run."""
    rolling = _rolling([lines[i] for i in run])
    chosen = {0} if run else set()
    end = held = 0
    for first in range(len(run)):
        while end < len(run) and held < WINDOW_WORDS:
            held += words[run[end]]
            end += 1
        if held < WINDOW_WORDS:
            break
        least = min(rolling[first:end])
        chosen.update(k for k in range(first, end) if rolling[k] == least)
        held -= words[run[first]]
    return sorted(chosen)


def _layout(text: str) -> tuple[list[str], list[int], list[tuple[int, int]]]:
    """Lines, the words of each, and the (first, end) of each chunk."""
    lines = text.split("\n")
    words = [_n_words(line) for line in lines]
    chunks, run = [], []
    for i, n in enumerate([*words, LONG_WORDS]):
        if 0 < n < LONG_WORDS:
            run.append(i)
        if n < LONG_WORDS:
            continue
        before = end = held = 0
        for start in _starts(lines, words, run):
            held -= sum(words[k] for k in run[before : min(start, end)])
            before, end = start, max(start, end)
            while end < len(run) and held < LEAST_WORDS:
                held += words[run[end]]
                end += 1
            if held < LEAST_WORDS:
                break
            chunks.append((run[start], run[end - 1] + 1))
        run = []
        if i < len(lines):
            chunks.append((i, i + 1))
    return lines, words, chunks


def _next_to(lines: list[str], words: list[int], places: range) -> list[str]:
    """Short lines at the places, up to the one that brings them to ``REACH`` words."""
    out, held = [], 0
    for i in places:
        held += words[i]
        if held >= REACH or words[i] >= LONG_WORDS:
            break
        out.append(lines[i])
    return out


def _chunk_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, first, end, high, low = [], [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            lines, _, chunks = _layout(text)
            for a, b in chunks:
                digest = xxhash.xxh3_128_intdigest("\n".join(lines[a:b]))
                at.append(row)
                first.append(a)
                end.append(b)
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & ((1 << 64) - 1)) - (1 << 63))
        at = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), batch.column(1).take(at)]
            + [pa.array(first, pa.int32()), pa.array(end, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())],
            names=["doc_id", "th", "first", "end", "high", "low"],
        )


def _chunk_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The text of the wanted chunks and the short lines around them, nearest first."""
    for batch in batches:
        at, out = [], []
        for row, (text, spans) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            lines, words, _ = _layout(text)
            for span in spans:
                a, b = span["first"], span["end"]
                before = _next_to(lines, words, range(a - 1, -1, -1))
                after = _next_to(lines, words, range(b, len(lines)))
                at.append(row)
                out.append((a, b, span["high"], span["low"], span["kept"], "\n".join(lines[a:b]), before, after))
        cells = list(zip(*out)) or [()] * 8
        types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string())]
        taken = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(taken), batch.column(1).take(taken)] + [pa.array(c, t) for c, t in zip(cells, types)],
            names=["doc_id", "th", "first", "end", "high", "low", "kept", "chunk", "before", "after"],
        )


def _equal_run(left, right):
    """How many leading items of two arrays are equal."""
    same = F.zip_with(left, right, lambda a, b: F.coalesce(a == b, F.lit(False)))
    stop = F.array_position(same, False).cast("int")
    return F.when(stop > 0, stop - 1).otherwise(F.size(same))


def _same_document(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "__doc_id", "th": "__th"})
    joined = left.join(right, left["doc_id"].eqNullSafe(right["__doc_id"]) & (left["th"] == right["__th"]), how)
    return joined.drop("__doc_id", "__th")


def repeated_spans(documents: DataFrame) -> DataFrame:
    """(doc_id, th, spans) of the documents with removable lines; th is the hash of the text."""
    ship(documents.sparkSession)
    texts = documents.select("doc_id", text_of().alias("text")).select("doc_id", F.xxhash64("text").alias("th"), "text")
    id_type = texts.schema["doc_id"].dataType.simpleString()
    keys = f"doc_id {id_type}, th bigint, first int, `end` int, high bigint, low bigint"
    chunks = settle(texts.mapInArrow(_chunk_rows, keys), "chunks")

    place = F.struct(F.col("doc_id").alias("doc_id"), F.col("th").alias("th"), F.col("first").alias("first"), F.col("end").alias("end"))
    repeated = (
        chunks.groupBy("high", "low").agg(F.count("*").alias("n"), F.min(place).alias("keeper")).where("n > 1").drop("n")
    )
    # a keeper's row says so itself, so one list per document serves both sides
    own = F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("keeper.th") == F.col("th"))
    wanted = (
        chunks.join(repeated, ["high", "low"])
        .withColumn("kept", place.eqNullSafe(F.col("keeper")))
        .where(F.col("kept") | ~own | (F.col("first") >= F.col("keeper.end")))
        .groupBy("doc_id", "th")
        .agg(F.collect_set(F.struct("first", "end", "high", "low", "kept")).alias("spans"))
    )
    found = settle(
        _same_document(texts, wanted, "inner").select("doc_id", "th", "text", "spans")
        .mapInArrow(_chunk_bytes, f"{keys}, kept boolean, chunk string, before array<string>, after array<string>"),
        "repeated-chunks",
    )
    keepers = found.where("kept").groupBy("high", "low").agg(
        F.min(F.struct("chunk", "before", "after", "doc_id", "th", "end")).alias("k")  # equal rows of one document
    )
    own = F.col("k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k.th") == F.col("th"))
    first = F.col("first") - _equal_run(F.col("before"), F.col("k.before"))
    return (
        found.where("not kept")
        .join(keepers, ["high", "low"])
        .where("chunk = k.chunk")
        .select(
            "doc_id",
            "th",
            F.struct(
                F.when(own, F.greatest(first, F.col("k.end"))).otherwise(first).alias("first"),
                (F.col("end") + _equal_run(F.col("after"), F.col("k.after"))).alias("end"),
            ).alias("span"),
        )
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set("span")).alias("spans"))
    )


def dedup_lines(documents: DataFrame) -> DataFrame:
    """The documents without repeated chunks; ``lines_removed`` counts the lines taken out."""
    spans = repeated_spans(documents)
    kept = [c for c in documents.columns if c != "lines_removed"]
    rows = documents.select(
        "doc_id", F.xxhash64(text_of()).alias("th"), text_of().alias("whole"), F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row")
    )
    joined = _same_document(rows, spans, "left")
    lines = F.split("whole", "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.exists("spans", lambda s: (s["first"] <= i) & (i < s["end"])))
    untouched = F.col("spans").isNull()
    out = joined.select(
        "row",
        F.when(untouched, F.col("whole")).otherwise(F.array_join(left, "\n")).alias("text"),
        F.when(untouched, 0).otherwise(F.size(lines) - F.size(left)).cast("int").alias("lines_removed"),
    )
    made = {"text": F.col("text")}
    if "n_chars" in kept:
        made["n_chars"] = F.length("text").cast(documents.schema["n_chars"].dataType)
    return out.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept], "lines_removed")
