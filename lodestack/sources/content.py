"""The content store: documents and chunks by id, written once and opened without reading them."""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import validation as val
from lodestack.operators.common import ContractError, require, saved
from lodestack.sources.bundle import exists, publish, read_json, remove, write_json
from lodestack.sources.corpus import table_tree

VERSION = 1


@dataclass(frozen=True)
class Identity:
    """What a store holds: digests of its tables in order of id, and how many rows they have."""

    document_digest: str
    chunk_digest: str
    documents: int
    chunks: int

    @property
    def id(self) -> str:
        named = json.dumps([self.document_digest, self.chunk_digest], separators=(",", ":"))
        return "content-" + hashlib.sha256(named.encode()).hexdigest()[:32]


@dataclass
class Content:
    path: str
    identity: Identity
    documents: DataFrame
    chunks: DataFrame

    def lookup(self, ids: DataFrame) -> DataFrame:
        """Chunks of a table of ids (id), each id once, with an error for one that is unknown."""
        asked = ids.select("id").distinct().withColumn("asked", F.lit(True))
        found = asked.join(self.chunks, "id", "left")
        known = F.when(F.col("document_id").isNull(), F.raise_error(F.concat(F.lit("unknown chunk "), F.col("id"))).cast("string")).otherwise(F.col("document_id"))
        return found.withColumn("document_id", known).select(*self.chunks.columns)


def identity_of(documents: DataFrame, chunks: DataFrame) -> Identity:
    docs, cut = table_tree(documents, "id"), table_tree(chunks, "id")
    return Identity(docs.root, cut.root, docs.rows, cut.rows)


def build_content(documents: DataFrame, chunks: DataFrame, path: str) -> Content:
    """Write a store where there is none; documents and chunks meet their contracts, and neither is empty."""
    spark = documents.sparkSession
    if exists(spark, path):
        raise ContractError(f"{path} exists")
    part = f"{path.rstrip('/')}.building-{uuid.uuid4().hex}"
    try:
        docs = saved(documents.repartitionByRange("id").sortWithinPartitions("id"), f"{part}/documents")
        cut = saved(chunks.repartitionByRange("id").sortWithinPartitions("id"), f"{part}/chunks")
        require(val.corpus_problems(docs, cut), "content")
        found = identity_of(docs, cut)
        if found.documents < 1 or found.chunks < 1:
            raise ContractError("a content store needs documents and chunks")
        write_json(spark, f"{part}/manifest.json", {"version": VERSION, "id": found.id, **found.__dict__})
        publish(spark, part, path)
    finally:
        remove(spark, part)
    return open_content(spark, path)


def open_content(spark: SparkSession, path: str, expected: str | None = None, check: bool = False) -> Content:
    """Table handles and identity from the manifest; expected: the identity's id that a bundle names; check reads all of it."""
    m = read_json(spark, f"{path}/manifest.json")
    found = Identity(m["document_digest"], m["chunk_digest"], m["documents"], m["chunks"])
    if m.get("version") != VERSION or m.get("id") != found.id:
        raise ContractError("the store's manifest does not agree with itself")
    if expected is not None and expected != found.id:
        raise ContractError(f"the store is {found.id}, not {expected}")
    out = Content(path, found, spark.read.parquet(f"{path}/documents"), spark.read.parquet(f"{path}/chunks"))
    if check and identity_of(out.documents, out.chunks) != found:
        raise ContractError("the store differs from its identity")
    return out
