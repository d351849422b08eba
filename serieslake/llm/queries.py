"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from serieslake.llm import bpe, collocations, decontaminate, embedding_dedup, exact_dedup, html_text, line_dedup, ngram_join, quality, ranked_search, token_counts, token_files, toxicity
from serieslake.llm.common import table


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, folder, "documents"))


def op2_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, folder, "embeddings"))


def op3_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.main_text(table(spark, folder, "pages"), ["page_id", "url"])


def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    return toxicity.grade(documents, toxicity.fit(documents, table(spark, folder, "labels")), ["doc_id"])


def op5_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.digests(table(spark, folder, "documents"), ["doc_id"])


def op6_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, folder, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op7_ngram_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.similar(table(spark, folder, "documents")).drop("th", "root")


def op8_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.checksums(token_files.write(table(spark, folder, "documents"), end_id=2))


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    weights, bias = quality.fit(documents, table(spark, folder, "labels"))
    return quality.score(documents, weights, bias, ["doc_id"]).select(
        "doc_id",
        quality.held_out().alias("held_out"),
        F.col("quality_score").alias("score"),
        F.col("quality_label").alias("predicted"),
    )


def op10_benchmark_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.collocations(table(spark, folder, "documents"))


def op12_ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return ranked_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op13_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, folder, "documents"))


# name -> (query, SQL or None)
QUERIES = {
    "op1_line_dedup": (op1_line_dedup, None),
    "op2_embedding_near_dedup": (op2_embedding_near_dedup, None),
    "op3_html_text": (op3_html_text, None),
    "op4_toxicity": (op4_toxicity, None),
    "op5_bpe": (op5_bpe, None),
    "op6_token_counts": (op6_token_counts, None),
    "op7_ngram_jaccard_join": (op7_ngram_jaccard_join, None),
    "op8_token_files": (op8_token_files, None),
    "op9_quality": (op9_quality, None),
    "op10_benchmark_leaks": (op10_benchmark_leaks, None),
    "op11_collocations": (op11_collocations, collocations.ORACLE_SQL),
    "op12_ranked_search": (op12_ranked_search, ranked_search.ORACLE_SQL),
    "op13_exact_dedup": (op13_exact_dedup, exact_dedup.ORACLE_SQL),
}
