"""The driver's tables as the library's entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as t


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with their source and language as metadata."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("id"),
        F.lit("").alias("source_uri"),
        F.lit("").alias("title"),
        "text",
        t.digest("text").alias("content_digest"),
        F.create_map(F.lit("source_role"), "source", F.lit("lang"), "lang").alias("metadata"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as Markdown documents: a title and a section for each turn."""
    turns = table(spark, sf_dir, "conversations")
    part = F.struct("turn", F.concat(F.lit("## "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit(""))).alias("body"))
    text = F.concat(F.lit("# Conversation "), F.col("conv_id").cast("string"), F.lit("\n"), F.array_join("parts.body", "\n"))
    return turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("parts")).select(
        F.col("conv_id").cast("string").alias("id"),
        F.lit("").alias("source_uri"),
        F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")).alias("title"),
        text.alias("text"),
        t.digest(text).alias("content_digest"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's passages as queries."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("query_id"), "text")


def records(chunks: DataFrame) -> DataFrame:
    """Raw representations of chunks with what a hit carries; the id is the chunk's, one for one."""
    return chunks.select(t.raw_representation_id(F.col("id"), F.col("content_digest")).alias("representation_id"), F.col("id").alias("chunk_id"), "document_id", "text", F.lit("raw").alias("kind"))
