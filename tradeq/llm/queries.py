"""Registered queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradeq.llm import bpe, check_sql, decontaminate, hard_negatives, html_text, language_id, lm_score, near_dedup, phrases, quality_rules, suffix_dedup, token_counts, token_shards, toxicity
from tradeq.llm.common import held_out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op4_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of words that repeat across documents."""
    return suffix_dedup.spans(table(spark, sf_dir, "documents")).drop("v")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded text."""
    docs = table(spark, sf_dir, "documents")
    done = bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), outputs=("ids_text", "decoded"))
    return done.select(
        "doc_id",
        "n_tokens",
        F.sha2(F.col("ids_text"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-duplicates of every document."""
    found = near_dedup.groups(table(spark, sf_dir, "documents"))
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document, learned from four fifths of them."""
    docs = table(spark, sf_dir, "documents")
    done = lm_score.score(docs, ~held_out("doc_id", 5, 1))
    return done.select(
        "doc_id", held_out("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    docs = table(spark, sf_dir, "documents")
    done = token_counts.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of the labelled ones."""
    docs = table(spark, sf_dir, "documents")
    model = language_id.learn(docs.filter(~held_out("doc_id", 3, 1)))
    done = language_id.identify(docs, model)
    return done.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "lang_pred", "score", "ambiguous")


def op2_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, one row per document and item."""
    done = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "item_id", "n_shared", "n_runs")


def op3_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of line-first cleaning for every document."""
    return quality_rules.clean(table(spark, sf_dir, "documents"), with_text=False)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from three quarters of the labels."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.learn(docs, labels.filter(~held_out("doc_id", 4, 2)))
    done = toxicity.score(docs, model)
    return done.select(
        "doc_id",
        held_out("doc_id", 4, 2).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, after some labels are made wrong on purpose."""
    return hard_negatives.mine(
        table(spark, sf_dir, "embeddings"),
        anchors=lambda i: i % 100 == 0,
        new_label=lambda i, label: F.when(i % 7 == 0, (label + 1) % 10).otherwise(label),
    )


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


#: Follows every document in the files of op13.
END_ID = 2


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to wavelet-matrix files and read back from them."""
    shards = token_shards.write(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), END_ID)
    return token_shards.read(spark, shards)


QUERIES = {
    "op1_language": op1_language,
    "op2_contamination": op2_contamination,
    "op3_html": op3_html,
    "op4_repeats": op4_repeats,
    "op5_bpe": op5_bpe,
    "op6_quality": op6_quality,
    "op7_near_dedup": op7_near_dedup,
    "op8_lm": op8_lm,
    "op9_token_counts": op9_token_counts,
    "op10_toxicity": op10_toxicity,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_phrases": op12_phrases,
    "op13_token_files": op13_token_files,
}

ORACLE_SQL: dict[str, str] = {
    "op2_contamination": check_sql.OP2_SQL.strip(),
    "op4_repeats": check_sql.OP4_SQL.strip(),
    "op6_quality": check_sql.OP6_SQL.strip(),
    "op7_near_dedup": check_sql.OP7_SQL.strip(),
    "op11_hard_negatives": check_sql.OP11_SQL.strip(),
    "op12_phrases": check_sql.OP12_SQL.strip(),
}
