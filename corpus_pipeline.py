"""The corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language, lines, neardup, packing, secrets
from factloom.llm.common import documents, scratch, small_batches
from factloom.llm.queries import tokenizer_file
from factloom.plans import lineage


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or without a clear language go. Needs a column lang to learn from."""
    small_batches(spark)
    return language.keep_identified(docs, language.train(docs))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated runs of lines stay only where they occur first."""
    small_batches(spark)
    return with_size(lines.line_dedup(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays."""
    small_batches(spark)
    return neardup.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are replaced by a mark; the documents stay. Without a column source all have one owner, without lang one repository each."""
    small_batches(spark)
    owner = F.col("source") if "source" in docs.columns else F.lit("")
    repository = F.concat_ws("/", owner, "lang") if "lang" in docs.columns else owner
    return with_size(secrets.mask_live(docs, owner=owner, repository=repository))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, placed in sequences."""
    small_batches(spark)
    return packing.pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


def with_size(docs: DataFrame) -> DataFrame:
    """n_chars, where documents have it, follows the text."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("packing", pack),
]

#: No stage can be expressed in DuckDB SQL as a whole; tests hold line_dedup and near_dedup against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents of sf_dir. What a stage wrote on its way goes once its result is written."""
    folder = scratch(spark)
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        path, before = f"{folder}/{name}", lineage.mark()
        stage(spark, docs, sf_dir).write.parquet(path)
        lineage.discard(spark, before)
        docs = spark.read.parquet(path)
    return docs
