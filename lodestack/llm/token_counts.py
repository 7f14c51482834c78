"""Token counts behind a digest cache.

Normalised content and tokenizer version are digested; the digests are joined to stored counts;
only distinct misses are encoded, and their counts are appended to the cache. The cache is a
Parquet folder of (content, tokenizer, n_tokens) in the shared folder.

Copies are counted by digest, so that digests which hold many rows are known: their counts are
broadcast (there are few, whatever the input holds) and their rows stay spread.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows and equal texts share
one encoding; null ids and extra columns pass through, those called like results are replaced; an empty
table gives an empty result; very long texts are encoded whole, in a batch of their own. A cache row
written twice (two jobs at once) is the same row and is read once.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import Workspace, regroup, spread_join, text_or_empty, token_memo

CACHE = "content binary, tokenizer string, n_tokens long"


def tokenizer_version(vocabulary: str) -> str:
    """SHA-256 of the vocabulary file: another file is another version."""
    with open(vocabulary, "rb") as file:
        return hashlib.file_digest(file, "sha256").hexdigest()


def content_digest(blanks_matter: bool):
    """SHA-256 of the text; where the tokenizer drops white space, of the text with runs of it made one blank."""
    text = text_or_empty()
    return F.unhex(F.sha2(text if blanks_matter else F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " ")), 256))


def count_tokens(docs: DataFrame, vocabulary: str, cache: str | None = None, limit: int = 2048, blanks_matter: bool = True) -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit).

    cache: the folder of stored counts (kept between calls); None: a new one for this call.
    blanks_matter: False only for vocabularies that drop white space; more texts are then equal.
    """
    spark = docs.sparkSession
    version = tokenizer_version(vocabulary)
    ws = Workspace(spark, "token-counts")
    cache = cache or ws.path("cache")
    own = "__content"
    keyed = docs.withColumn(own, content_digest(blanks_matter))
    # first() is combined map-side: a group of copies sends one text from each task
    distinct = keyed.select(F.col(own).alias("content"), text_or_empty().alias("text")).groupBy("content").agg(F.first("text").alias("text"))
    if _exists(spark, cache):
        stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
        distinct = distinct.join(stored, "content", "left_anti")

    def encode(batches):
        memo = token_memo(vocabulary)
        for batch in regroup(batches, 4096, 8_000_000):
            _, starts = memo.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("content"), pa.array(np.diff(starts), pa.int64())], ["content", "n_tokens"])

    counted = distinct.mapInArrow(encode, "content binary, n_tokens long")
    counted.select("content", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    stored = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    counts = stored.groupBy(F.col("content").alias(own)).agg(F.max("n_tokens").alias("n_tokens"))
    copies = ws.save(keyed.groupBy(own).agg(F.count("*").alias("__copies")).join(counts, own, "left"), "counts")
    kept = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", "over_limit")]
    sized = keyed.withColumn("n_bytes", F.octet_length(text_or_empty()).cast("long")).select(*[F.col(f"`{c}`") for c in kept], "n_bytes", own)
    return spread_join(sized, copies, own, "__copies").select(*[F.col(f"`{c}`") for c in kept], "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _exists(spark, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)

