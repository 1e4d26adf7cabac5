"""A training corpus from the table `documents`, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Each row is decided by its own text, whatever its doc_id, but in
near deduplication, where rows that share a doc_id are one document and rows with a null one are linked with nothing. Null and
empty texts have no letters and go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runeloom.llm import byte_bpe, decontaminate, exact_dedup, language_id, near_dup
from runeloom.llm.shared import cut, shared_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that their own labels teach."""
    return language_id.accepted(docs, language_id.learn(docs))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, that with the longest original."""
    return exact_dedup.distinct_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates: five words, a similarity of 0.8."""
    dropped = cut(near_dup.near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_dropped")).distinct())
    return docs.join(dropped, F.col("doc_id") == F.col("_dropped"), "left_anti")  # broadcast if the table's size allows it


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that hold no passage of the table `benchmark`."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, token_ids, text): the tokens, and the text that they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    both = byte_bpe.encode(docs, path, public_tokenizers.PATTERN, decoded=True)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", F.col("content").cast("string").alias("text"))


STAGES = [("language identification", language), ("exact deduplication", exact), ("near deduplication", near), ("decontamination", benchmark), ("byte-level BPE", tokens)]

#: No stage but the second can be said in SQL; tests/llm compares the whole with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        path = shared_path(spark, f"stage{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
