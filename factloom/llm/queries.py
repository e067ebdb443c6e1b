"""The queries of this subpackage and, where SQL can express them, their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, conversations, language, lines, media, neardup, packing, personal, pieces, quality, secrets, substrings, toxicity
from .common import documents, small_batches


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_repeated_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_substrings(documents(spark, sf_dir))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "class_id", "represents")


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.media_table(documents(spark, sf_dir)))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.predict(docs, language.train(docs))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source is an owner; its documents in one language are a repository."""
    docs = documents(spark, sf_dir)
    return secrets.secret_scan(docs, owner=F.col("source"), repository=F.concat_ws("/", "source", "lang")).drop("_id", "_h", "live_spans")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(documents(spark, sf_dir), tokenizer_file("piece_bpe_32k.model"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(documents(spark, sf_dir))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.quality_verdicts(docs, quality.train(*quality.labelled_sample(docs, labels)))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_spans(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return conversations.grafted_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    prices = toxicity.language_model(docs)
    return toxicity.scores(docs, prices, toxicity.train(docs, labels, prices))


QUERIES = {f.__name__: f for f in (op1_repeated_substrings, op2_near_duplicates, op3_media_columns, op4_language_id, op5_secret_scan, op6_sentencepiece, op7_line_dedup, op8_quality_rules, op9_packing, op10_personal_data, op11_prefix_trie, op12_centroid_clusters, op13_toxicity)}
#: The other queries train models, use tokenizers or rewrite texts, which SQL cannot express; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_secret_scan": secrets.scan_sql(), "op11_prefix_trie": conversations.trie_sql(), "op12_centroid_clusters": centroids.cluster_sql()}
