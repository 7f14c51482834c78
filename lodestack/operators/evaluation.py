"""Ranking metrics: precision, recall, hit rate and nDCG at cutoffs, and reciprocal rank."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.functions.vectors import log_gain
from lodestack.operators.common import ContractError


def check_cutoffs(cutoffs: list[int]) -> None:
    if any(k < 1 for k in cutoffs):
        raise ContractError("cutoffs must be positive")
    if len(set(cutoffs)) != len(cutoffs):
        raise ContractError("cutoffs must be distinct")


def metrics(rankings: DataFrame, judgments: DataFrame, cutoffs: list[int]) -> DataFrame:
    """query_id, target, k, precision, recall, hit_rate, ndcg and mrr of each ranked and judged query.

    rankings: query_id and ranked (array of target ids, best first; an empty one scores 0). Queries
    without judgments, or without a ranking, are left out. Repeated and empty ids count once or never.
    """
    check_cutoffs(cutoffs)
    w = Window.partitionBy("query_id").orderBy(F.col("grade").desc())
    judged = judgments.withColumns({"top": F.max("grade").over(Window.partitionBy("query_id")), "place": F.row_number().over(w) - 1})
    listed = rankings.select("query_id", F.array_distinct(F.filter("ranked", lambda x: x.isNotNull() & (x != ""))).alias("ids"))
    per_query = judged.groupBy("query_id").agg(
        F.min("target").alias("target"),
        F.count_if(F.col("grade") > 0).alias("relevant"),
        *[F.sum(F.when(F.col("place") < k, log_gain(F.col("grade"), F.col("top"), F.col("place"))).otherwise(0.0)).alias(f"ideal_{k}") for k in cutoffs],
    )
    placed = listed.select("query_id", F.posexplode("ids").alias("at", "target_id")).join(judged.select("query_id", "target_id", "grade", "top"), ["query_id", "target_id"])
    good = F.col("grade") > 0
    found = placed.groupBy("query_id").agg(
        F.min(F.when(good, F.col("at"))).alias("first"),
        *[F.count_if(good & (F.col("at") < k)).alias(f"hits_{k}") for k in cutoffs],
        *[F.sum(F.when(F.col("at") < k, log_gain(F.col("grade"), F.col("top"), F.col("at"))).otherwise(0.0)).alias(f"gain_{k}") for k in cutoffs],
    )
    joined = listed.select("query_id").join(per_query, "query_id").join(found, "query_id", "left")

    def at(k: int):
        hits = F.coalesce(f"hits_{k}", F.lit(0))
        return F.struct(
            F.lit(k).alias("k"),
            (hits / k).alias("precision"),
            F.when(F.col("relevant") > 0, hits / F.col("relevant")).otherwise(0.0).alias("recall"),
            F.when(hits > 0, 1.0).otherwise(0.0).alias("hit_rate"),
            F.when(F.col(f"ideal_{k}") > 0, F.coalesce(f"gain_{k}", F.lit(0.0)) / F.col(f"ideal_{k}")).otherwise(0.0).alias("ndcg"),
        )

    rows = joined.select("query_id", "target", F.coalesce(1 / (F.col("first") + 1), F.lit(0.0)).alias("mrr"), F.explode(F.array(*[at(k) for k in cutoffs])).alias("m"))
    return rows.select("query_id", "target", "m.*", "mrr")


def report(per_query: DataFrame, cutoffs: list[int], n_queries: int | None = None) -> DataFrame:
    """Means over evaluated queries at each cutoff, with counts; every cutoff is a row even of no queries."""
    check_cutoffs(cutoffs)
    all_k = per_query.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in cutoffs])).alias("k"))
    means = per_query.groupBy("k").agg(F.count("*").alias("evaluated"), *[F.avg(c).alias(c) for c in ("precision", "recall", "hit_rate", "ndcg", "mrr")])
    out = F.broadcast(all_k).join(means, "k", "left").withColumn("evaluated", F.coalesce("evaluated", F.lit(0)))
    return out if n_queries is None else out.withColumn("skipped", F.lit(n_queries) - F.col("evaluated"))


def target_levels(judgments: DataFrame) -> DataFrame:
    """query_id, first target (by pos), n_judgments, n_relevant and mixed of each judged query."""
    return judgments.groupBy("query_id").agg(
        F.min_by("target", "pos").alias("target"),
        F.count("*").alias("n_judgments"),
        F.count_if(F.col("grade") > 0).alias("n_relevant"),
        (F.min("target") != F.max("target")).alias("mixed"),
    )


def mixed_targets(judgments: DataFrame) -> DataFrame:
    """Queries judged at more than one level."""
    return judgments.groupBy("query_id").agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a <> b").select("query_id").orderBy("query_id")


def judgment_target_problems(judgments: DataFrame) -> DataFrame:
    return judgments.where(~F.coalesce(F.col("target").isin(*s.TARGETS), F.lit(False)))
