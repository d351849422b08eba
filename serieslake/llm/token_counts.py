"""Token counts per document without token ids.

Byte-level BPE splits a text into pre-tokens and encodes each on its own, so a document's count is the sum,
over its distinct pre-tokens, of how often it has them times their number of pieces. Pieces
are counted once per distinct pre-token of the corpus and joined to the documents' pre-token
frequencies: the most frequent pre-tokens, ``FREQUENT`` of at most ``SHORT`` bytes, through a
broadcast of that bounded size; all others meet their frequencies in the partition that their
hash names, where a pre-token's rows stand together and its pieces are counted once.

Null texts count as empty and have no tokens; rows that repeat are counted each; a null doc_id
stays null. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from serieslake.llm.bpe import RARE, WHITE, byte_letters, vocabulary_path
from serieslake.llm.common import text_of
from serieslake.session import ship

VOCABULARY = "byte_bpe_50k.json"
FREQUENT = 1 << 19
SHORT = 32
CACHED = 200_000  # chunks kept by each worker at most
# fixed values: the pattern that the vocabulary was made with
PRETOKEN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# a run of other characters with at most one space before it: pre-tokens never cross its ends
_CHUNK = re.compile(f" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


class Pieces:
    """Pre-tokens of texts and their numbers of pieces, for one vocabulary file."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self._model, self._pre_tokenizer = tokenizer.model, tokenizer.pre_tokenizer
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        self._special = re.compile("|".join(map(re.escape, special)))
        self._marks = special
        self._pattern = regex.compile(PRETOKEN_PATTERN)
        self._letters = {b: letter for b, letter in enumerate(byte_letters()) if chr(b) != letter}

    def chunks(self, text: str) -> tuple[Counter, int]:
        """How often each chunk occurs, and the number of special tokens among them."""
        if not any(mark in text for mark in self._marks):
            return Counter(_CHUNK.findall(text)), 0
        parts = self._special.split(text)
        return Counter(c for part in parts for c in _CHUNK.findall(part)), len(parts) - 1

    def pretokens(self, chunk: str) -> list[str]:
        if chunk.isascii() and chunk[1:].isalpha() and (chunk[0] == " " or chunk[0].isalpha()):
            return [chunk]
        if RARE.search(chunk):
            return [chunk[a:b] for _, (a, b) in self._pre_tokenizer.pre_tokenize_str(chunk)]
        return self._pattern.findall(chunk)

    def count(self, pretoken: str) -> int:
        return len(self._model.tokenize(pretoken.encode().decode("latin-1").translate(self._letters)))


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _seen(vocabulary: str) -> callable:
    """(pretoken, texts) of pre-tokens that several texts of a batch hold."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary_path(vocabulary))
        for batch in batches:
            found: Counter = Counter()
            for text in batch.column(0).to_pylist():
                found.update(own.chunks(text)[0].keys())
            by_pretoken: Counter = Counter()
            for chunk, n in found.items():
                if n > 1:
                    for p in own.pretokens(chunk):
                        by_pretoken[p] += n
            short = [(p, n) for p, n in by_pretoken.items() if len(p) <= SHORT // 4 or len(p.encode()) <= SHORT]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in short], pa.string()), pa.array([n for _, n in short], pa.int64())], names=["pretoken", "texts"]
            )

    return mapped


def _counted(vocabulary: str) -> callable:
    """Adds the number of pieces; equal pre-tokens stand together and are counted once."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(vocabulary_path(vocabulary))
        last, n = None, 0
        for batch in batches:
            out = []
            for pretoken in batch.column("pretoken").to_pylist():
                if pretoken != last:
                    last, n = pretoken, own.count(pretoken) if pretoken is not None else 0
                out.append(n)
            kept = [name for name in batch.schema.names if name != "pretoken"]
            yield pa.RecordBatch.from_arrays(
                [batch.column(name) for name in kept] + [pa.array(out, pa.int64())], names=[*kept, "pieces"]
            )

    return mapped


def _frequencies(vocabulary: str, frequent) -> callable:
    """Per text: bytes, tokens from frequent pre-tokens, and the other pre-tokens with their frequency."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, known = pieces(vocabulary_path(vocabulary)), frequent.value
        split: dict[str, tuple[int, list[str]]] = {}
        for batch in batches:
            n_bytes, tokens, others, times = [], [], [], []
            for text in batch.column(2).to_pylist():
                chunks, total = own.chunks(text)
                rest: Counter = Counter()
                for chunk, n in chunks.items():
                    found = split.get(chunk)
                    if found is None:
                        pre = own.pretokens(chunk)
                        found = (sum(known.get(p, 0) for p in pre), [p for p in pre if p not in known])
                        if len(split) >= CACHED:
                            split.clear()
                        split[chunk] = found
                    total += n * found[0]
                    for p in found[1]:
                        rest[p] += n
                n_bytes.append(len(text.encode()))
                tokens.append(total)
                others.append(list(rest.keys()))
                times.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())]
                + [pa.array(others, pa.list_(pa.string())), pa.array(times, pa.list_(pa.int64()))],
                names=["row", "doc_id", "n_bytes", "known", "pretokens", "times"],
            )

    return mapped


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens), one row per document."""
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", text_of().alias("text"))
    id_type = texts.schema["doc_id"].dataType.simpleString()

    top = (
        texts.select("text").mapInArrow(_seen(vocabulary), "pretoken string, texts bigint")
        .groupBy("pretoken").agg(F.sum("texts").alias("texts"))
        .orderBy(F.desc("texts"), "pretoken").limit(FREQUENT)
    )
    counted = top.withColumn("name", F.col("pretoken")).mapInArrow(_counted(vocabulary), "texts bigint, name string, pieces bigint").toPandas()
    known = dict(zip(counted["name"], map(int, counted["pieces"])))
    frequent = spark.sparkContext.broadcast(known)  # FREQUENT pre-tokens of SHORT bytes at most

    rows = texts.mapInArrow(
        _frequencies(vocabulary, frequent),
        f"row bigint, doc_id {id_type}, n_bytes bigint, known bigint, pretokens array<string>, times array<bigint>",
    )
    rows = rows.select("row", "doc_id", "n_bytes", "known", F.explode_outer(F.arrays_zip("pretokens", "times")).alias("p")).select(
        "row", "doc_id", "n_bytes", "known", F.col("p.times").alias("times"), F.col("p.pretokens").alias("pretoken")
    )
    # texts without other pre-tokens have one row with none; they go anywhere
    dealt = rows.repartition(F.when(F.col("pretoken").isNull(), F.col("row")).otherwise(F.xxhash64("pretoken"))).sortWithinPartitions("pretoken")
    joined = dealt.mapInArrow(_counted(vocabulary), f"row bigint, doc_id {id_type}, n_bytes bigint, known bigint, times bigint, pieces bigint")
    return (
        joined.groupBy("row", "doc_id", "n_bytes", "known")
        .agg(F.sum(F.coalesce(F.col("times") * F.col("pieces"), F.lit(0))).alias("other"))
        .select("doc_id", "n_bytes", (F.col("known") + F.col("other")).alias("n_tokens"))
    )
