"""From raw documents to token ids: language, near-duplicates, repeated passages, benchmark items, encoding.

Every stage takes what the one before kept and returns the columns of its input,
the last one token ids. Stages are joined by written tables, so a lost executor costs
the tasks of one stage at most.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeq.llm import bpe, decontaminate, language_id, near_dedup, suffix_dedup
from tradeq.session import settle

TOKENIZER = "word_bpe_49k.json"
#: Similarity in hundredths from which documents are near-duplicates here; op7 alone asks for 85.
SIMILAR = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, and those between two languages, go."""
    return language_id.identified(docs, language_id.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: the one with the smallest id."""
    return near_dedup.without_copies(docs, threshold=SIMILAR)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document are cut out; every document stays."""
    return suffix_dedup.without_repeats(docs, length="n_chars" if "n_chars" in docs.columns else None)


def benchmark_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and a digest of what they decode to."""
    done = bpe.encode(docs, public_tokenizers.path(TOKENIZER), outputs=("ids", "decoded"))
    return done.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_items", benchmark_items),
    ("token_ids", token_ids),
]

#: Learned languages and token ids are beyond SQL; tests compare every stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = settle(docs, name)
    return docs
