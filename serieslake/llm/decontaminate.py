"""Benchmark decontamination by spaced seeds, in DataFrame operations alone.

Words are runs of letters and digits of the lower-cased text. A seed is a fixed mask over
neighbouring words; words under a 0 are ignored, so a seed still matches where single words were
replaced. Every mask begins with two words in a row. Bit maps of fixed size, made from the
benchmark, first pass over each text: one holds the benchmark's word pairs, one its seeds. What
passes is joined to the benchmark's seeds by hash. Around each hit the words of both texts are
then compared place by place: ``RUN`` places in a row (the whole item, if shorter) of which
``SHARE`` or more agree make a leak. Items shorter than ``RUN`` have shorter masks of their own, so that no
choice of replaced words escapes all masks; items shorter than ``LEAST`` are their own mask and must
agree as a whole.

Null and empty texts match nothing. Rows that repeat give one result. A null doc_id
or item_id is an id like any other. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from serieslake.llm.common import text_of

# places compared (1) and ignored (0)
SEEDS = ("111111", "11011011", "11101011", "1101111011", "110100111")
RUN = 13
SHARE = 0.8
LEAST = 6  # words of the shortest item that may differ
# for items of fewer than RUN words, and for items of 1, 2, ... words
SHORT_SEEDS = ("110111", "11111", "111011", "1111")
WHOLE_SEEDS = tuple("1" * n for n in range(1, LEAST))
PAIR_BITS = 18
SEED_BITS = 20
LONGEST = max(map(len, SEEDS))
ALL_SEEDS = SEEDS + SHORT_SEEDS + WHOLE_SEEDS


def _words(text: Column) -> Column:
    """The hashes of a text's words, in order."""
    parts = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.transform(F.filter(parts, lambda w: w != ""), lambda w: F.xxhash64(w))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _pair(words: Column, i: Column) -> Column:
    return F.get(words, i).bitwiseXOR(F.shiftrightunsigned(F.get(words, i + 1), 1))


def _seed(words: Column, i: Column, number: int) -> Column:
    places = [F.get(words, i + k) for k, bit in enumerate(ALL_SEEDS[number]) if bit == "1"]
    return F.xxhash64(F.lit(number), *places)


def _starts(words: Column, span: int) -> Column:
    """0 .. size - span, or nothing."""
    last = F.size(words) - span
    return F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))


def _bitmap(hashes: DataFrame, bits: int) -> Column:
    """A map of 2 ** bits bits as one constant array; its size does not depend on the data."""
    mask = (1 << bits) - 1
    cells = (
        hashes.select(F.col("h").bitwiseAND(F.lit(mask)).alias("b"))
        .groupBy(F.shiftright("b", 6).alias("cell"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(b & 63 as int))")).alias("held"))
        .toArrow()  # at most 2 ** (bits - 6) rows
    )
    held = [0] * (1 << (bits - 6))
    for cell, value in zip(cells["cell"].to_pylist(), cells["held"].to_pylist()):
        held[cell] = value
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<bigint>")


def _held(bitmap: Column, h: Column, bits: int) -> Column:
    low = h.bitwiseAND(F.lit((1 << bits) - 1))
    cell = F.get(bitmap, F.shiftright(low, 6).cast("int"))
    return F.call_function("getbit", cell, low.bitwiseAND(F.lit(63)).cast("int")) == 1


def _benchmark_seeds(benchmark: DataFrame) -> DataFrame:
    """(h, item_id, words before the seed reversed, words from it on, length), one row per seed of an item."""
    items = benchmark.select("item_id", _words(text_of()).alias("w"))
    size = F.size("w")
    searched = [size >= LEAST] * len(SEEDS) + [size.between(LEAST, RUN - 1)] * len(SHORT_SEEDS) + [size == len(s) for s in WHOLE_SEEDS]
    rows = [
        items.where(wanted).withColumn("i", F.explode(_starts(F.col("w"), len(seed)))).select(
            _seed(F.col("w"), F.col("i"), number).alias("h"), "item_id", "w", "i"
        )
        for number, (seed, wanted) in enumerate(zip(ALL_SEEDS, searched))
    ]
    out = rows[0]
    for more in rows[1:]:
        out = out.union(more)
    return out.select("h", "item_id", *_around(F.col("w"), F.col("i")), F.size("w").alias("n_words"))


def _numbers(benchmark: DataFrame) -> list[int]:
    """The seeds that some item has use for; the others would find nothing."""
    size = F.size(_words(text_of()))
    short, *whole = benchmark.agg(
        F.count_if(size.between(LEAST, RUN - 1)), *[F.count_if(size == len(seed)) for seed in WHOLE_SEEDS]
    ).first()
    used = [1] * len(SEEDS) + [short] * len(SHORT_SEEDS) + whole
    return [number for number, items in enumerate(used) if items]


def _around(words: Column, i: Column) -> list[Column]:
    low = F.greatest(i - (RUN - 1), F.lit(0))
    return [
        F.reverse(F.slice(words, low + 1, i - low)).alias("before"),
        F.slice(words, i + 1, F.lit(LONGEST + RUN - 1)).alias("after"),
    ]


def leaks(documents: DataFrame, benchmark: DataFrame, *keys: str) -> DataFrame:
    """(keys, item_id, agreeing) of documents that hold a benchmark passage, and the most
    agreeing words in a row of ``RUN`` places; ``keys`` is doc_id unless named."""
    keys = keys or ("doc_id",)
    seeds = _benchmark_seeds(benchmark)
    numbers = _numbers(benchmark)
    pairs = benchmark.select(_words(text_of()).alias("w")).select("w", F.explode(_starts(F.col("w"), 2)).alias("i"))
    pair_map = _bitmap(pairs.select(_pair(F.col("w"), F.col("i")).alias("h")), PAIR_BITS)
    seed_map = _bitmap(seeds.select("h"), SEED_BITS)

    def seeded(words: Column, starts: Column, number: int) -> Column:
        return F.transform(starts, lambda i: F.struct(i.alias("i"), _seed(words, i, number).alias("h")))

    def hits_of(words: Column, starts: Column) -> Column:
        # one filter for all seeds, so the plan holds the map once
        every = F.flatten(F.array(*[seeded(words, starts, n) for n in numbers]))
        return F.filter(every, lambda s: _held(seed_map, s["h"], SEED_BITS))

    def hits(words: Column) -> Column:
        starts = _starts(words, 1)
        if ALL_SEEDS.index("1") not in numbers:  # single words have no pair
            starts = F.filter(_starts(words, 2), lambda i: _held(pair_map, _pair(words, i), PAIR_BITS))
        found = _let(starts, lambda i: hits_of(words, i))
        return F.transform(found, lambda s: F.struct(s["h"].alias("h"), *_around(words, s["i"])))

    found = (
        documents.select(*keys, F.explode(_let(_words(text_of()), hits)).alias("hit"))
        .select(*keys, "hit.h", F.col("hit.before").alias("d_before"), F.col("hit.after").alias("d_after"))
        .join(seeds.hint("merge"), "h")  # the benchmark has no bound, so it is never broadcast
    )
    def same(a: str, b: str) -> Column:
        return F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)).cast("int"))

    def most(places: Column, length: Column) -> Column:
        last = F.greatest(F.size(places) - length, F.lit(0))
        runs = F.transform(F.sequence(F.lit(0), last), lambda s: F.aggregate(F.slice(places, s + 1, length), F.lit(0), lambda a, x: a + x))
        return F.array_max(runs)

    length = F.least(F.lit(RUN), F.col("n_words"))
    places = F.concat(F.reverse(same("d_before", "before")), same("d_after", "after"))
    return (
        found.select(*keys, "item_id", length.alias("length"), _let(places, lambda p: most(p, length)).alias("agreeing"))
        .groupBy(*keys, "item_id", "length")
        .agg(F.max("agreeing").alias("agreeing"))
        .where(F.col("agreeing") >= F.when(F.col("length") < LEAST, F.col("length")).otherwise(F.ceil(F.col("length") * F.lit(SHARE))))
        .drop("length")
    )


def without_leaks(documents: DataFrame, benchmark: DataFrame, *keys: str) -> DataFrame:
    """The documents that hold no benchmark passage; rows that agree in the ``keys`` (doc_id unless
    named) are one document."""
    keys = keys or ("doc_id",)
    found = leaks(documents, benchmark, *keys).select(*[F.col(k).alias(f"__leaked_{k}") for k in keys]).distinct()
    same = [documents[k].eqNullSafe(found[f"__leaked_{k}"]) for k in keys]
    return documents.join(found, reduce(Column.__and__, same), "left_anti")
