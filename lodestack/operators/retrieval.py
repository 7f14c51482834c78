"""What happens to hits: collapse, fusion, filters, hydration, target ids."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.common import SCORE_DECIMALS, ContractError, hit_order, top_k

RRF_CONSTANT = 60.0
LOOKUP_LIMIT = 256


def collapse(hits: DataFrame, target: str) -> DataFrame:
    """The best-ranked hit of each chunk or document; ranks are numbered anew, scores stay."""
    if target not in ("chunk", "document"):
        raise ContractError(f"cannot collapse to {target!r}")
    key, order = f"{target}_id", ["rank", "chunk_id", "representation_id"]
    best = hits.withColumn("n", F.row_number().over(Window.partitionBy("query_id", key).orderBy(*order))).where("n = 1").drop("n")
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))


def fuse(hits: DataFrame, constant: float = RRF_CONSTANT, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted reciprocal rank fusion of the channels in hits.

    A missing or zero weight counts as 1; a channel named a:b takes the weight of a where it has none of
    its own. A chunk that a channel lists twice contributes twice. Values are added in channel order.
    """
    if not (math.isfinite(constant) and constant > 0):
        raise ContractError("the rank constant must be finite and positive")
    for channel, w in (weights or {}).items():
        if not math.isfinite(w) or w < 0:
            raise ContractError(f"the weight of channel {channel!r} must be finite and not negative")
    table = F.create_map(*[F.lit(x) for kv in (weights or {}).items() for x in (kv[0], float(kv[1]))]) if weights else None
    given = F.coalesce(F.try_element_at(table, F.col("channel")), F.try_element_at(table, F.split("channel", ":")[0])) if weights else F.lit(None).cast("double")
    weight = F.when(given.isNull() | (given == 0), 1.0).otherwise(given)
    valued = hits.withColumn("weight", weight).withColumn("value", F.col("weight") / (constant + F.col("rank")))
    part = F.struct("channel", "rank", "weight", "value")
    fused = valued.groupBy("query_id", "chunk_id").agg(F.min("document_id").alias("document_id"), F.max("document_id").alias("other"), F.array_sort(F.collect_list(part)).alias("contributions"))
    clash = F.when(F.col("document_id") != F.col("other"), F.raise_error(F.concat(F.lit("conflicting documents of chunk "), "chunk_id"))).otherwise(F.col("document_id"))
    scored = fused.select("query_id", "chunk_id", clash.alias("document_id"), F.aggregate("contributions", F.lit(0.0), lambda s, c: s + c["value"]).alias("score"), "contributions")
    w = Window.partitionBy("query_id").orderBy(F.round("score", 15).desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).select("query_id", "chunk_id", "document_id", "rank", "score", "contributions")


def from_hits(hits: DataFrame) -> DataFrame:
    """One channel as a fused ranking: weight 1, value its score."""
    part = F.struct("channel", "rank", F.lit(1.0).alias("weight"), F.col("score").alias("value"))
    return hits.select("query_id", "chunk_id", "document_id", "rank", "score", F.array(part).alias("contributions"))


def hydrate(fused: DataFrame, chunks: DataFrame, limit: int = 0) -> DataFrame:
    """Evidence: the first `limit` of each query (below 1: all) with chunk texts; a missing chunk is an error."""
    first = fused.where(F.col("rank") <= limit) if limit >= 1 else fused
    texts = chunks.select(F.col("id").alias("chunk_id"), "text", "content_digest", F.col("document_id").alias("__document"))
    found = first.join(texts, "chunk_id", "left")
    digest = F.when(F.col("content_digest").isNull(), F.raise_error(F.concat(F.lit("unknown chunk "), F.col("chunk_id")))).otherwise(F.col("content_digest"))
    return found.withColumn("content_digest", digest).drop("__document")


def filter_kinds(scores: DataFrame, kinds: list[str], k: int) -> DataFrame:
    """Hits of some representation kinds: filtered before the cut, so k rows remain where there are k."""
    if not kinds:
        raise ContractError("at least one kind is needed")
    return top_k(scores.where(F.col("kind").isin(kinds)), k)


def filter_roles(hits: DataFrame, documents: DataFrame, roles: list[str], depth: int, k: int) -> DataFrame:
    """Hits whose document has one of the source roles, out of the first `depth`: fewer than k may remain."""
    if depth < k:
        raise ContractError("the depth must be at least k")
    roles_of = documents.select(F.col("id").alias("document_id"), F.try_element_at("metadata", F.lit("source_role")).alias("role"))
    kept = hits.where(F.col("rank") <= depth).join(roles_of.where(F.col("role").isin(roles)), "document_id", "left_semi")
    w = Window.partitionBy("query_id").orderBy("rank")
    return kept.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lookup(ids: list[str], table: DataFrame, key: str = "id") -> DataFrame:
    """Rows of given ids in the caller's order; too many, repeated or missing ids are errors."""
    if len(ids) > LOOKUP_LIMIT:
        raise ContractError(f"at most {LOOKUP_LIMIT} ids at once")
    if len(set(ids)) != len(ids) or not all(ids):
        raise ContractError("ids must be distinct and not empty")
    spark = table.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), f"pos int, {key} string")
    found = F.broadcast(wanted).join(table.withColumn("__found", F.lit(True)).where(F.col(key).isin(ids)), key, "left")
    name = F.when(F.col("__found").isNull(), F.raise_error(F.concat(F.lit("missing id "), F.col(key)))).otherwise(F.col(key))
    return found.withColumn(key, name).drop("__found").orderBy("pos")


def candidate_metadata(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What candidates are chosen by, without their texts."""
    return chunks.select(F.col("id").alias("chunk_id"), "document_id").join(documents.select(F.col("id").alias("document_id"), "metadata"), "document_id")


def target_ids(hits: DataFrame, target: str, documents: DataFrame | None = None) -> DataFrame:
    """hits with target_id at a level; a document without a unit id counts as its own unit."""
    if target in ("representation", "chunk", "document"):
        return hits.withColumn("target_id", F.col(f"{target}_id"))
    if target != "unit" or documents is None:
        raise ContractError(f"unknown target {target!r}")
    units = documents.select(F.col("id").alias("document_id"), F.try_element_at("metadata", F.lit("evaluation_unit_id")).alias("unit"))
    return hits.join(units, "document_id", "left").withColumn("target_id", F.coalesce(F.nullif("unit", F.lit("")), "document_id")).drop("unit")


def hit_problems(hits: DataFrame) -> DataFrame:
    """Hits with a bad rank, a score that is not finite or an empty id."""
    score = F.isnan("score") | (F.abs("score") == float("inf")) | F.col("score").isNull()
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    problem: Column = F.when(F.col("rank") < 1, "rank below 1").when(score, "score not finite").when(empty("chunk_id") | empty("document_id") | empty("representation_id"), "empty id")
    return hits.withColumn("problem", problem).where("problem is not null")


def first_hits(scores: DataFrame, k: int) -> DataFrame:
    return top_k(scores, k, hit_order())


__all__ = ["SCORE_DECIMALS", "candidate_metadata", "collapse", "filter_kinds", "filter_roles", "first_hits", "from_hits", "fuse", "hit_problems", "hydrate", "lookup", "target_ids"]
