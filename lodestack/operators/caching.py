"""Content-addressed caches: a Parquet table keyed by digest, read by join and written by append.

A cache never changes inside a function: what is missing is found by an anti-join, made once for each
distinct key, and appended. Equal keys hold equal values, so a key written twice is read once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.functions import text as t
from lodestack.operators.common import ContractError, saved, scratch
from lodestack.operators.generation import with_retries


def cache_key(**fields: Column) -> Column:
    """Digest of named fields, in the given order."""
    return t.json_digest(F.struct(*[v.alias(k) for k, v in fields.items()]))


def generation_key(step: str, version: str, model: str, prompt: str, text: str = "text") -> Column:
    return cache_key(step=F.lit(step), version=F.lit(version), model=F.lit(model), prompt_digest=F.sha2(F.lit(prompt), 256), text_digest=t.digest(text))


def rerank_key(model: str, results: int) -> Column:
    """Query and candidates by identity; scores of candidates are no part of it. rows: query_text, candidates."""
    ids = F.transform("candidates", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["content_digest"].alias("content_digest")))
    return cache_key(model=F.lit(model), results=F.lit(results), query=F.col("query_text"), candidates=ids)


def cached(
    rows: DataFrame, key: Column, work: Callable[[DataFrame], DataFrame], values: list[str], path: str, waves: int = 1, budget: int | None = None, attempts: int = 1
) -> tuple[DataFrame, dict[str, int]]:
    """rows with the columns of values, and a report of hits, misses and distinct work.

    work takes rows (with column key) and returns key and values; it sees each missing key once, with the
    columns of one of its rows, so what it returns must follow from what the key is made of. It is done in
    `waves` by key, each written when it ends: what fails later does not lose them. A wave that fails for a reason
    that may pass is tried again, `attempts` times in all. More work than budget is an error before any is done.
    """
    if waves < 1 or attempts < 1:
        raise ContractError("waves and attempts must be positive")
    spark = rows.sparkSession
    keyed = rows.withColumn("key", key)
    stored = _read(spark, path, keyed, work, values)
    missing = keyed.join(stored.select("key"), "key", "left_anti")
    # one row of each missing key, written: what is counted, made and read again is the same
    first = saved(missing.groupBy("key").agg(F.count("*").alias("__rows"), F.any_value(F.struct(*rows.columns)).alias("r")).select("key", "__rows", "r.*"), scratch(spark, "missing"))
    n_work, n_missing = first.agg(F.count("*"), F.coalesce(F.sum("__rows"), F.lit(0))).first()
    if budget is not None and n_work > budget:
        raise ContractError(f"{n_work} calls are needed; the budget is {budget}")

    def wave(n: int) -> None:
        part = first.drop("__rows").where(F.pmod(F.xxhash64("key"), F.lit(waves)) == n)
        work(part).select("key", *values).write.mode("append").parquet(path)

    for n in range(waves if n_work else 0):
        with_retries(wave, attempts)(n)
    stored = _read(spark, path, keyed, work, values).dropDuplicates(["key"])
    out = keyed.join(stored, "key").drop("key")
    n_rows = rows.count()
    return out, {"rows": n_rows, "hits": n_rows - n_missing, "misses": n_missing, "writes": n_work}


def _read(spark, path: str, keyed: DataFrame, work, values: list[str]) -> DataFrame:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.parquet(path).select("key", *values)
    return work(keyed.limit(0)).select("key", *values)


def cached_embeddings(representations: DataFrame, embed: Callable[[DataFrame], DataFrame], model: str, path: str, **options) -> tuple[DataFrame, dict[str, int]]:
    """Vectors of representations through a cache on (model, text); content digests are checked first. options: as cached() takes."""
    ok = t.digest("text") == F.col("content_digest")
    checked = representations.withColumn("text", F.when(ok, F.col("text")).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("id")))))
    work = lambda df: embed(df.select(F.col("key").alias("id"), "text")).select(F.col("representation_id").alias("key"), "values")
    found, report = cached(checked.select("id", "text"), cache_key(model=F.lit(model), text_digest=t.digest("text")), work, ["values"], path, **options)
    return found.select(F.col("id").alias("representation_id"), "values", F.lit(model).alias("model")), report


def cached_generate(
    requests: DataFrame, call: Callable[[DataFrame], DataFrame], model: str, path: str, adapter_version: str, context_policy: str = "", kind: str = "generate", schema: str = "", **options
) -> tuple[DataFrame, dict]:
    """requests with output and usage through a cache, and a report with the usage of this call's own work.

    requests: prompt, input and, where the answer rests on it, evidence (array of chunk_id and content_digest).
    call adds output and any of the usage columns. A key is made of the model, the kind of call, the input's, the
    prompt's and the schema's digest, the evidence, the adapter's version and the context policy. Usage of an
    answer that is replayed was spent by the call that stored it, and is null here. options: as cached() takes.
    """
    if not adapter_version.strip():
        raise ContractError("an adapter version is required")
    types = {c: "double" if c == "cost_usd" else "bigint" for c in s.USAGE_COLUMNS}
    evidence = F.col("evidence") if "evidence" in requests.columns else F.array().cast("array<struct<chunk_id:string,content_digest:string>>")
    key = cache_key(
        model=F.lit(model),
        kind=F.lit(kind),
        query_digest=t.digest("input"),
        evidence=evidence,
        prompt_digest=t.digest("prompt"),
        schema_digest=F.sha2(F.lit(schema), 256),
        adapter_version=F.lit(adapter_version),
        context_policy=F.lit(context_policy),
    )
    run = uuid.uuid4().hex

    def work(missing: DataFrame) -> DataFrame:
        made = call(missing)
        spent = [(F.col(c) if c in made.columns else F.lit(None)).cast(x).alias(c) for c, x in types.items()]
        return made.select("key", "output", *spent, F.lit(run).alias("run"))

    found, report = cached(requests, key, work, ["output", *types, "run"], path, **options)
    own = _read(requests.sparkSession, path, requests.withColumn("key", key), work, [*types, "run"]).where(F.col("run") == run)
    return found.drop(*types, "run"), report | {"usage": own.agg(*[F.sum(c).alias(c) for c in types]).first().asDict()}


def cached_rerank(candidates: DataFrame, queries: DataFrame, score: Callable[[str, list[str]], list[float]], model: str, results: int, path: str) -> tuple[DataFrame, dict[str, int]]:
    """Reranked candidates through a cache on the query's text and the candidates' identities."""
    from lodestack.operators.reranking import rerank

    listed = candidates.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content_digest", "text"))).alias("candidates"))
    rows = listed.join(queries.select("query_id", F.col("text").alias("query_text")), "query_id")

    def work(missing: DataFrame) -> DataFrame:
        flat = missing.select("query_id", F.explode("candidates").alias("c")).select("query_id", "c.*")
        asked = missing.select("query_id", F.col("query_text").alias("text"))
        done = rerank(flat, asked, score, results).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "reranker_score"))).alias("ranked"))
        return missing.select("query_id", "key").join(done, "query_id").select("key", "ranked")

    found, report = cached(rows, rerank_key(model, results), work, ["ranked"], path)
    flat = found.select("query_id", F.explode("ranked").alias("r")).select("query_id", F.col("r.chunk_id").alias("chunk_id"), F.col("r.rank").alias("new_rank"), F.col("r.reranker_score").alias("reranker_score"))
    return candidates.join(flat, ["query_id", "chunk_id"]).drop("rank").withColumnRenamed("new_rank", "rank"), report
