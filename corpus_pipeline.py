"""The corpus pipeline: documents through the operators of the subpackage, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns the columns of ``documents``, the last one the
token counts and digests per document. Null texts count as empty; empty and very long texts, null ids, repeated
rows and extra columns of any name go through every stage, and an empty table gives an empty one. Rows that agree in
doc_id and text are one document to the third stage and one verdict to the others. ``run`` writes every stage's result as Parquet and reads
it back as the next stage's documents. Tables that a stage settled are removed once its
result is stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.llm import bpe, decontaminate, line_dedup, ngram_join, quality
from serieslake.llm.common import mark, sweep, table, text_of
from serieslake.session import scratch_path

# near copies; op7_ngram_jaccard_join has a stricter contract of its own
SHINGLE = 5
PERCENT = 80


def _packed(docs: DataFrame, *columns: str) -> DataFrame:
    """doc_id, text and named columns, with the whole row in one column: no name of a user's column clashes with a stage's."""
    return docs.select(*dict.fromkeys(["doc_id", "text", *columns]), F.struct("*").alias("row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    weights, bias = quality.fit(docs, table(spark, sf_dir, "labels"))
    # numbered names clash with none that the classifier adds, and the text travels once
    numbered = {f"c{k}": c for k, c in enumerate(docs.columns)}
    text = next(own for own, c in numbered.items() if c.lower() == "text")
    scored = quality.score(docs.toDF(*numbered), weights, bias, text=text)
    return scored.where("quality_label = 1").select(*[F.col(own).alias(c) for own, c in numbered.items()])


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks of lines go; the documents stay, with what is left of their text."""
    made = [c for c in ("text", "n_chars") if c in docs.columns]
    found = line_dedup.dedup_lines(_packed(docs, *made))
    return found.select(*[F.col(c if c in made else f"row.`{c}`").alias(c) for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: Jaccard similarity of 5-word shingles from 0.8 on."""
    return ngram_join.one_of_each(docs, SHINGLE, PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go; others with the same id but another text stay."""
    marked = _packed(docs, "text").withColumn("th", F.xxhash64(text_of()))
    return decontaminate.without_leaks(marked, table(spark, sf_dir, "benchmark"), "doc_id", "th").select("row.*")


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded: token counts and digests."""
    return bpe.digests(docs, ["doc_id"])


STAGES = [
    ("quality classifier", keep_good),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("BPE encoding and decoding", tokenize),
]

# SQL can express neither the trained classifier nor the tokenizer
ORACLE_SQL = None


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; what earlier stages stored is removed as soon as the next one has read it."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        since = mark()
        path, found = scratch_path(spark, name.replace(" ", "-")), stage(spark, docs, sf_dir)
        found.write.parquet(path)
        docs = spark.read.schema(found.schema).parquet(path)
        sweep(spark, since)
        if before:
            _remove(spark, before)
        before = path
    return docs
