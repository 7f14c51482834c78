"""Answering over all queries at once: strategies, context packing, grounded-answer contracts.

The stages are DataFrames that compose into one plan: search channels, collapse, fuse, hydrate, rerank,
augment, pack, then (after a generator) parse and check.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import dataclass, field
from time import perf_counter, time

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import text as t
from lodestack.operators import retrieval as r
from lodestack.operators.common import ContractError, require, saved, scratch

STRATEGIES = ("bm25", "vector", "rrf", "rrf-reranked", "multi-query", "hyde")
FUSED = STRATEGIES[2:]
VARIANTS = 3


@dataclass(frozen=True)
class Config:
    strategy: str = "rrf"
    retrieve_k: int = 10
    evidence_k: int = 5
    rerank_candidates: int = 0
    rrf_constant: float = 60.0
    rrf_weights: dict[str, float] = field(default_factory=dict)
    maximum_context_runes: int = 4000
    query_variants: int = 0


@dataclass
class Service:
    """What retrieval uses. Channels take (queries, k) and return hits; generate takes queries (with text)
    and returns query_id and output; rerank takes (candidates, queries, n)."""

    chunks: DataFrame
    lexical: Callable[[DataFrame, int], DataFrame] | None = None
    vector: Callable[[DataFrame, int], DataFrame] | None = None
    rerank: Callable[[DataFrame, DataFrame, int], DataFrame] | None = None
    generate: Callable[[DataFrame, str], DataFrame] | None = None
    augment: Callable[[DataFrame], DataFrame] | None = None
    observe: Callable[[dict], None] | None = None
    citation_style: str = "chunk-id"


def check_request(service: Service, config: Config) -> None:
    """Raise for a configuration that the service cannot run."""
    c = config
    if service.citation_style not in ("", "chunk-id", "ordinal"):
        raise ContractError(f"unsupported citation style {service.citation_style!r}")
    if c.strategy not in STRATEGIES:
        raise ContractError(f"unknown strategy {c.strategy!r}")
    needs = {"lexical": c.strategy != "vector", "vector": c.strategy != "bm25", "rerank": c.strategy == "rrf-reranked", "generate": c.strategy in ("multi-query", "hyde")}
    for what, needed in needs.items():
        if needed and getattr(service, what) is None:
            raise ContractError(f"strategy {c.strategy} needs {what}")
    for name in ("retrieve_k", "evidence_k", "maximum_context_runes"):
        if getattr(c, name) <= 0:
            raise ContractError(f"{name} must be positive")
    if c.query_variants < 0:
        raise ContractError("query_variants must not be negative")
    if c.strategy in FUSED:
        if not (math.isfinite(c.rrf_constant) and c.rrf_constant > 0):
            raise ContractError("the rank constant must be finite and positive")
        for channel, w in c.rrf_weights.items():
            if channel not in ("bm25", "vector"):
                raise ContractError(f"unknown channel {channel!r}")
            if not (math.isfinite(w) and w > 0):
                raise ContractError(f"the weight of {channel!r} must be finite and positive")
    if c.strategy == "rrf-reranked" and c.rerank_candidates < c.evidence_k:
        raise ContractError("rerank_candidates must be at least evidence_k")


def query_problems(queries: DataFrame) -> DataFrame:
    """Queries with a blank id or text, or an id used twice."""
    blank = lambda c: t.trimmed(F.coalesce(F.col(c), F.lit(""))) == ""
    bad = queries.where(blank("query_id") | blank("text")).select("query_id", F.lit("blank").alias("problem"))
    return bad.unionByName(queries.groupBy("query_id").count().where("count > 1").select("query_id", F.lit("repeated").alias("problem")))


def parse_variants(raw: str | None, query: str, n: int) -> tuple[list[str], str | None]:
    """(n distinct variants, None), or ([], why there are none)."""
    try:
        listed = json.loads((raw or "").strip())["variants"]
        if not isinstance(listed, list) or not all(isinstance(x, str) for x in listed):
            raise ValueError("variants must be strings")
    except (ValueError, KeyError, TypeError) as error:
        return [], f"decode variants: {error}"
    seen, out = {query.strip()}, []
    for x in map(str.strip, listed):
        if x and x not in seen and len(out) < n:
            seen.add(x)
            out.append(x)
    return (out, None) if len(out) == n else ([], f"{len(out)} distinct usable variants; expected {n}")


def _variants(n: int):
    """parse_variants of each row, as an Arrow function of (output, text)."""

    @F.pandas_udf("variants array<string>, error string")
    def parse(raw: pd.Series, query: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse_variants(x, y, n) for x, y in zip(raw, query, strict=True)], columns=["variants", "error"])

    return parse


def _channel(search, queries: DataFrame, k: int, name: str) -> DataFrame:
    return r.collapse(search(queries, k), "chunk").withColumn("channel", F.lit(name))


@dataclass
class Retrieved:
    hits: DataFrame
    fused: DataFrame
    evidence: DataFrame
    variants: DataFrame | None = None


def retrieve(service: Service, queries: DataFrame, config: Config) -> Retrieved:
    """Evidence (query_id, chunk_id, document_id, rank, score, text, content_digest) of every query.

    queries: query_id, text and, where another text is to be searched, retrieval_text.
    """
    check_request(service, config)
    c = config
    if "retrieval_text" in queries.columns:
        own = F.coalesce(F.nullif(t.trimmed("retrieval_text"), F.lit("")), F.col("text"))
        searched = queries.withColumn("text", own)
    else:
        searched = queries
    searched = searched.select("query_id", "text")
    variants = None
    if c.strategy == "bm25":
        hits = _channel(service.lexical, searched, c.retrieve_k, "bm25")
    elif c.strategy == "vector":
        hits = _channel(service.vector, searched, c.retrieve_k, "vector")
    else:
        hits = _channel(service.lexical, searched, c.retrieve_k, "bm25")
        by_vector = searched
        if c.strategy == "hyde":
            written = service.generate(searched, "hyde").select("query_id", t.trimmed("output").alias("output"))
            by_vector = searched.join(written, "query_id", "left").select("query_id", F.coalesce(F.nullif("output", F.lit("")), "text").alias("text"))
        hits = hits.unionByName(_channel(service.vector, by_vector, c.retrieve_k, "vector"))
        if c.strategy == "multi-query":
            n = c.query_variants or VARIANTS
            parse = _variants(n)
            variants = service.generate(searched, "multi-query").select("query_id", "output").join(searched, "query_id").select("query_id", parse("output", "text").alias("v")).select("query_id", "v.*")
            for place in range(1, n + 1):
                more = variants.where(F.size("variants") >= place).select("query_id", F.element_at("variants", place).alias("text"))
                for search, name in ((service.lexical, "bm25"), (service.vector, "vector")):
                    hits = hits.unionByName(_channel(search, more, c.retrieve_k, f"{name}:q{place + 1}"))
    fused = r.fuse(hits, c.rrf_constant, c.rrf_weights) if c.strategy in FUSED else r.from_hits(hits)
    if c.strategy == "rrf-reranked":
        candidates = r.hydrate(fused, service.chunks, c.rerank_candidates)
        evidence = service.rerank(candidates, searched, c.evidence_k)
    else:
        evidence = r.hydrate(fused, service.chunks, c.evidence_k)
    if service.augment is not None:
        evidence = service.augment(evidence)
    return Retrieved(hits, fused, evidence, variants)


def pack_context(evidence: DataFrame, most: int, runes: int) -> DataFrame:
    """query_id, admitted and omitted chunk ids, used runes: whole texts by rank, those that do not fit skipped."""
    part = F.struct("rank", "chunk_id", F.char_length("text").alias("n"))
    start = F.struct(F.array().cast("array<string>").alias("admitted"), F.array().cast("array<string>").alias("omitted"), F.lit(0).alias("used"))

    def step(acc: Column, e: Column) -> Column:
        full = (F.size(acc["admitted"]) >= most) | (acc["used"] + e["n"] > runes)
        return F.struct(
            F.when(full, acc["admitted"]).otherwise(F.concat(acc["admitted"], F.array(e["chunk_id"]))).alias("admitted"),
            F.when(full, F.concat(acc["omitted"], F.array(e["chunk_id"]))).otherwise(acc["omitted"]).alias("omitted"),
            F.when(full, acc["used"]).otherwise(acc["used"] + e["n"]).alias("used"),
        )

    folded = F.aggregate(F.array_sort(F.collect_list(part)), start, step)
    return evidence.groupBy("query_id").agg(folded.alias("c")).select("query_id", "c.*")


def prepare(evidence: DataFrame, config: Config, citation_style: str = "chunk-id") -> DataFrame:
    """Admitted evidence of each query with the label (chunk id, or E1, E2 ... by rank) it is cited by."""
    packed = pack_context(evidence, config.evidence_k, config.maximum_context_runes)
    used = packed.select("query_id", F.posexplode("admitted").alias("pos", "chunk_id")).join(evidence, ["query_id", "chunk_id"])
    label = F.concat(F.lit("E"), (F.col("pos") + 1).cast("string")) if citation_style == "ordinal" else F.col("chunk_id")
    return used.withColumn("label", label).drop("pos")


def augmented_problems(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, problem) of augmented evidence: unknown or repeated chunks, texts that are not the stored ones, bad ranks."""
    stored = chunks.select(F.col("id").alias("chunk_id"), F.col("content_digest").alias("own"))
    found = evidence.join(stored, "chunk_id", "left")
    tests = F.array_compact(F.array(
        F.when(F.col("own").isNull(), "unknown chunk"),
        F.when(F.col("own") != t.digest("text"), "text differs"),
        F.when(F.col("rank") < 1, "rank below 1"),
    ))
    twice = evidence.groupBy("query_id", "chunk_id").count().where("count > 1").select("query_id", F.lit("repeated chunk").alias("problem"))
    ranks = evidence.groupBy("query_id", "rank").count().where("count > 1").select("query_id", F.lit("repeated rank").alias("problem"))
    return found.select("query_id", F.explode(tests).alias("problem")).unionByName(twice).unionByName(ranks)


def prepared_problems(prepared: DataFrame, config: Config, citation_style: str = "chunk-id") -> DataFrame:
    """(query_id, problem) of prepared evidence: too much of it, labels that repeat or are not the style's."""
    totals = prepared.groupBy("query_id").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("runes"), F.countDistinct("label").alias("labels"), F.collect_set("label").alias("got"), F.collect_set("chunk_id").alias("ids"))
    due = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.concat(F.lit("E"), i.cast("string"))) if citation_style == "ordinal" else F.col("ids")
    tests = F.array_compact(F.array(
        F.when(F.col("n") > config.evidence_k, "too many texts"),
        F.when(F.col("runes") > config.maximum_context_runes, "too many code points"),
        F.when(F.col("labels") < F.col("n"), "repeated label"),
        F.when(F.size(F.array_except("got", due)) > 0, "label of another style"),
    ))
    return totals.select("query_id", F.explode(tests).alias("problem"))


_TEXTS = T.ArrayType(T.StringType())
_ANSWER = T.StructType([T.StructField(k, x) for k, x in (("answer", T.StringType()), ("citations", _TEXTS), ("abstained", T.BooleanType()), ("failure_category", T.StringType()), ("failures", _TEXTS))])


def parse_answer(raw: str | None) -> tuple[str, list[str], bool, str | None, list[str]]:
    """A strictly decoded answer, or a safe abstention with what failed."""
    safe = ("", [], True, "parse")
    text = (raw or "").strip()
    if text.startswith("```") and text.endswith("```") and "\n" in text:
        text = text[text.index("\n") + 1 : -3].strip()
    fields = {"answer": str, "citation_chunk_ids": list, "abstained": bool}
    try:
        decoded = json.loads(text)
        if not isinstance(decoded, dict):
            raise ValueError("not an object")
        if extra := [k for k in decoded if k not in fields]:
            raise ValueError(f"unknown field {extra[0]}")
        for k, kind in fields.items():
            if decoded.get(k) is not None and not isinstance(decoded[k], kind):
                raise ValueError(f"field {k} has another type")
        if not all(isinstance(x, str) for x in decoded.get("citation_chunk_ids") or []):
            raise ValueError("citations must be strings")
    except ValueError as error:
        return (*safe, [f"decode grounded answer: {error}"])
    if missing := [k for k in fields if decoded.get(k) is None]:
        return (*safe, ["missing required fields: " + ", ".join(missing)])
    return decoded["answer"], decoded["citation_chunk_ids"], decoded["abstained"], None, []


@F.pandas_udf(_ANSWER)
def parsed_answers(raw: pd.Series) -> pd.DataFrame:
    """parse_answer of each row."""
    return pd.DataFrame([parse_answer(x) for x in raw], columns=_ANSWER.names)


def contract_failures(answer: Column, citations: Column, abstained: Column, allowed: Column) -> Column:
    """What an answer breaks: texts and citations exactly when not abstaining, each citation once and known."""
    twice = F.filter(F.transform(citations, lambda c, i: F.when(F.array_position(citations, c) < i + 1, F.concat(F.lit("duplicate citation "), c))), lambda x: x.isNotNull())
    unknown = F.transform(F.array_distinct(F.array_except(citations, allowed)), lambda c: F.concat(F.lit("unknown citation "), c))
    shape = F.array_compact(F.array(
        F.when(abstained & (F.size(citations) > 0), "abstained with citations"),
        F.when(~abstained & (t.trimmed(answer) == ""), "answered without text"),
        F.when(~abstained & (F.size(citations) == 0), "answered without citations"),
    ))
    return F.concat(shape, twice, unknown)


def interpret(responses: DataFrame, prepared: DataFrame) -> DataFrame:
    """query_id, answer, citations (chunk ids), abstained, valid, failure_category and failures.

    responses: query_id and output; labels map to chunk ids; anything invalid becomes an abstention.
    """
    allowed = prepared.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("label", "chunk_id"))).alias("labels"))
    parsed = responses.withColumn("p", parsed_answers("output")).select("query_id", "p.*").join(allowed, "query_id", "left")
    labels = F.coalesce("labels", F.create_map().cast("map<string,string>"))
    broken = F.when(F.col("failure_category").isNull(), contract_failures(F.col("answer"), F.col("citations"), F.col("abstained"), F.map_keys(labels))).otherwise(F.col("failures"))
    checked = parsed.withColumns({"failures": broken, "labels": labels})
    valid = F.size("failures") == 0
    empty = F.array().cast("array<string>")
    return checked.select(
        "query_id",
        F.when(valid, F.col("answer")).otherwise("").alias("answer"),
        F.when(valid, F.transform("citations", lambda c: F.try_element_at("labels", c))).otherwise(empty).alias("citations"),
        F.when(valid, F.col("abstained")).otherwise(True).alias("abstained"),
        valid.alias("valid"),
        F.when(~valid, F.coalesce("failure_category", F.lit("contract"))).alias("failure_category"),
        "failures",
    )


def answer(service: Service, queries: DataFrame, config: Config) -> DataFrame:
    """Retrieve, pack, generate and check; the generator's raw output is kept beside the contract.

    Each stage is run and written to the shared folder before it is noted as completed, with its rows and seconds;
    a stage that fails is noted as failed. The generator is run once.
    """
    require(query_problems(queries), "queries")
    folder = scratch(queries.sparkSession, "answers")
    notes = 0

    def note(stage: str, status: str, **more) -> None:
        nonlocal notes
        if service.observe is not None:
            service.observe({"sequence": notes, "stage": stage, "status": status, "at": time(), **more})
        notes += 1

    def run(stage: str, make: Callable[[], DataFrame]) -> DataFrame:
        note(stage, "started")
        began = perf_counter()
        try:
            out = saved(make(), f"{folder}/{stage}")
            rows = out.count()
        except Exception as error:
            note(stage, "failed", error=type(error).__name__, seconds=perf_counter() - began)
            raise
        note(stage, "completed", rows=rows, seconds=perf_counter() - began)
        return out

    evidence = run("retrieve", lambda: retrieve(service, queries, config).evidence)
    prepared = run("prepare", lambda: prepare(evidence, config, service.citation_style))
    context = prepared.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "label", "text"))), lambda e: F.concat(F.lit("["), e["label"], F.lit("] "), e["text"])), "\n\n").alias("context"))
    raw = run("generate", lambda: service.generate(queries.join(context, "query_id", "left"), "answer").select("query_id", "output"))
    return run("check", lambda: interpret(raw, prepared).join(raw, "query_id"))
