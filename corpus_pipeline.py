"""The corpus pipeline: stages that clean, deduplicate, redact, mix and pack documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

In every stage an empty table gives an empty result, repeated rows are rows, columns beyond those of documents
pass through whatever they are called, and texts are read whole however long. What null ids, null or empty
texts and ties become is said at each stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestack.llm import mixing, near_dups, packing, quality_rules, secrets
from lodestack.llm.common import Workspace, documents, small_batches
from lodestack.llm.queries import vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior rejects go.

    A null or empty text has no words, so its document goes; ids are not read; a posterior of exactly 0.5 is kept."""
    small_batches(spark)
    return quality_rules.keep_good(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, similarity 0.8): that of the least id.

    Documents without words or without id are no one's copy and stay; rows of one id are one document."""
    return near_dups.keep_first(docs, size=5, percent=80)


def redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays.

    Null texts stay null; spans that overlap are one mark; n_chars follows the new text."""
    return secrets.redact(docs, secrets.train_from(docs))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled by raked probabilities.

    Null sources and languages count as ''; null or empty texts hold no tokens and stay unless their source is given no
    share; rows of one id are drawn alike, rows without id by their text."""
    columns = docs.columns
    return mixing.mix(docs).where("sampled").select(*columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences; a null text is its end id only, and a null id stays null. Workers have served all stages before and share the executor's memory."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), pool=1_000_000, memo_pieces=200_000, batch_bytes=4_000_000)


STAGES = [("quality", quality), ("near_dups", dedup), ("secrets", redaction), ("mixing", mixture), ("packing", packed)]

#: Several stages are models and samples that SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    # a codec's native buffers would add to the executors' memory, stage by stage
    ws = Workspace(spark, "pipeline", codec="none")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = ws.save(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
