"""Reranking of evidence: term overlap as an expression, other rerankers as a grouped function."""

from __future__ import annotations

import json
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.operators.common import ContractError, wider


def term_overlap(candidates: DataFrame, queries: DataFrame, results: int) -> DataFrame:
    """Candidates by the number of distinct query terms in their text, ties by rank; the first `results`."""
    if results < 1:
        raise ContractError("the number of results must be positive")
    terms = queries.select("query_id", t.term_set("text").alias("__terms"))
    scored = candidates.join(terms, "query_id").withColumn("reranker_score", F.size(F.array_intersect(t.term_set("text"), "__terms")).cast("double")).drop("__terms")
    return _cut(scored, results)


def _cut(scored: DataFrame, results: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("reranker_score").desc(), "rank")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= results)


def rerank(candidates: DataFrame, queries: DataFrame, score: Callable[[str, list[str]], list[float]], results: int) -> DataFrame:
    """Candidates by a scorer of (query text, candidate texts); all are scored, then cut.

    A query's candidates are a cut list, so its group is small. The scorer must return one finite score each.
    """
    if results < 1:
        raise ContractError("the number of results must be positive")
    joined = candidates.join(queries.select("query_id", F.col("text").alias("__query")), "query_id")
    names = candidates.columns
    schema = wider(candidates, reranker_score="double")

    def task(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        values = list(score(group["__query"].iloc[0], group["text"].tolist()))
        if len(values) != len(group) or not all(isinstance(x, (int, float)) and x == x and abs(x) != float("inf") for x in values):
            raise ContractError("the reranker must return one finite score for each candidate")
        return group.assign(reranker_score=[float(x) for x in values])[[*names, "reranker_score"]]

    return _cut(joined.groupBy("query_id").applyInPandas(task, schema), results)


def scores_of(answer: list[dict], n: int) -> list[float]:
    """Scores of n candidates from a provider's results: index (from 0), score and, where it is given, rank (from 1).

    Each candidate has one finite score; ranks, if any, are of all and follow the scores. Anything else is an error."""
    indexes = [r.get("index") for r in answer]
    if sorted(i if type(i) is int else -1 for i in indexes) != list(range(n)):
        raise ContractError(f"the reranker's indexes are not those of {n} candidates")
    if not all(isinstance(r.get("score"), (int, float)) and not isinstance(r["score"], bool) and math.isfinite(r["score"]) for r in answer):
        raise ContractError("the reranker must return one finite score for each candidate")
    ranks = [r.get("rank") for r in answer]
    if any(x is not None for x in ranks):
        by_rank = sorted(answer, key=lambda r: (r.get("rank") is None, r.get("rank")))
        if sorted(x if type(x) is int else 0 for x in ranks) != list(range(1, n + 1)) or any(a["score"] < b["score"] for a, b in zip(by_rank[:-1], by_rank[1:], strict=True)):
            raise ContractError("the reranker's ranks do not follow its scores")
    return [float(r["score"]) for r in sorted(answer, key=lambda r: r["index"])]


def rerank_items(candidates: DataFrame, queries: DataFrame, call: Callable[[str, list[str]], dict], model: str, results: int, path: str, policy=None, **options) -> tuple[DataFrame, dict]:
    """Candidates by a provider that is called once for each distinct query and candidates (`calls.called`), and its report.

    call: query text and candidate texts in order of rank -> results (as scores_of takes them) and any usage. Answers that break
    the contract are data errors: they are not tried again, their usage counts, and the query is left out of the result.
    """
    from lodestack.operators.caching import rerank_key
    from lodestack.operators.calls import Policy, called

    if results < 1:
        raise ContractError("the number of results must be positive")
    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content_digest", "text"))).alias("candidates"))
    rows = listed.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")

    def ask(items: list[dict]) -> list[dict]:
        out = []
        for item in items:
            texts = [c["text"] for c in item["candidates"]]
            answer = call(item["query_text"], texts)
            usage = {k: v for k, v in answer.items() if k != "results"}
            try:
                scores = scores_of(answer["results"], len(texts))
            except ContractError as error:
                error.usage = usage
                raise
            out.append({"output": json.dumps(scores), **usage})
        return out

    found, report = called(rows, rerank_key(model, results), ask, path, policy or Policy(), **options)
    scored = found.where("output is not null").select("query_id", "candidates", F.from_json("output", "array<double>").alias("scores"))
    flat = scored.select("query_id", F.explode(F.arrays_zip("candidates", "scores")).alias("c")).select("query_id", F.col("c.candidates.chunk_id").alias("chunk_id"), F.col("c.scores").alias("reranker_score"))
    return _cut(candidates.join(flat, ["query_id", "chunk_id"]), results), report


def rerank_problems(candidates: DataFrame, reranked: DataFrame, results: int) -> DataFrame:
    """(query_id, problem): another count than due, foreign or repeated chunks, scores not finite."""
    due = candidates.groupBy("query_id").agg(F.least(F.count("*"), F.lit(results)).alias("due"))
    got = reranked.groupBy("query_id").agg(F.count("*").alias("got"), F.countDistinct("chunk_id").alias("distinct"))
    counts = due.join(got, "query_id", "full").where("coalesce(due, 0) <> coalesce(got, 0) OR coalesce(got, 0) <> coalesce(distinct, 0)")
    foreign = reranked.join(candidates, ["query_id", "chunk_id"], "left_anti").select("query_id", F.lit("foreign chunk").alias("problem"))
    score = F.col("reranker_score")
    bad = reranked.where(score.isNull() | F.isnan(score) | (F.abs(score) == float("inf"))).select("query_id", F.lit("score not finite").alias("problem"))
    return counts.select("query_id", F.lit("count differs").alias("problem")).unionByName(foreign).unionByName(bad)
