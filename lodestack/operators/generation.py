"""Generation: the extractive generator, cached and checked model calls, usage and error classes."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from time import perf_counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.functions import text as t
from lodestack.operators.common import ContractError, saved, scratch, wider

ABSTAIN = "I do not have enough evidence."

#: Parts of messages that tell a failure worth trying again.
TRANSIENT_MARKERS = (
    "status=429",
    "status=408",
    "status=5",
    "CONCURRENT_REQUEST_LIMIT",
    "rate limit",
    "Rate limit",
    "connection reset",
    "connection refused",
    "broken pipe",
    "unexpected EOF",
    "EOF",
    "stream receive",
    "timeout",
    "Timeout",
    "timed out",
    "network is unreachable",
    "no route to host",
    "stream error",
    "INTERNAL_ERROR",
    "temporarily unavailable",
    "TLS handshake",
    "tls: bad record MAC",
    "generation response is empty",
)
#: Messages of a call that its own caller ended.
ENDED_MARKERS = ("context canceled", "context deadline exceeded")


def extractive(evidence: DataFrame, queries: DataFrame, most: int = 0) -> DataFrame:
    """query_id, answer, citations, finish_reason, input_tokens, output_tokens: the evidence itself, cited.

    evidence: query_id, chunk_id, rank, text; queries without evidence abstain.
    """
    used = evidence.where(F.col("rank") <= most) if most >= 1 else evidence
    part = F.struct("rank", "chunk_id", F.concat(F.lit("["), "chunk_id", F.lit("] "), t.trimmed("text")).alias("line"))
    joined = used.groupBy("query_id").agg(F.array_sort(F.collect_list(part)).alias("e"))
    found = queries.select("query_id", F.col("text").alias("question")).join(joined, "query_id", "left")
    text = F.array_join("e.line", "\n\n")
    some = F.col("e").isNotNull()
    quarter = lambda x: F.floor(F.octet_length(x) / 4).cast("long")
    return found.select(
        "query_id",
        F.when(some, text).otherwise(ABSTAIN).alias("answer"),
        F.coalesce(F.col("e.chunk_id"), F.array().cast("array<string>")).alias("citations"),
        F.when(some, "stop").otherwise("abstain").alias("finish_reason"),
        F.when(some, quarter(F.col("question"))).alias("input_tokens"),
        F.when(some, quarter(text)).alias("output_tokens"),
    )


def generate(requests: DataFrame, model: Callable[[list[str], list[str]], list[str]], batch: int = 16) -> DataFrame:
    """requests (with prompt and input) with output, by a model of (prompts, inputs), in batches of rows."""
    names = requests.columns

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                out = list(model(part["prompt"].tolist(), part["input"].tolist()))
                if len(out) != len(part):
                    raise ValueError("the model returned another number of answers")
                yield part.assign(output=out)[[*names, "output"]]

    return requests.mapInPandas(task, wider(requests, output="string"))


def observed(call: Callable[[DataFrame], DataFrame], observe: Callable[[dict], None], disclose: bool = False) -> Callable[[DataFrame], DataFrame]:
    """call, with a note before it and one after it has run; texts are part of a note only where they may be disclosed.

    The answers are written to the shared folder before the call counts as completed, so that a failure inside
    a task is noted as one and nothing is generated again by whatever reads the answers.
    """

    def noted(requests: DataFrame) -> DataFrame:
        note: dict = {"requests": requests.count()}
        if disclose:
            note["inputs"] = [r[0] for r in requests.select("input").limit(10).collect()]
        observe({"status": "started", **note})
        began = perf_counter()
        try:
            out = saved(call(requests), scratch(requests.sparkSession, "observed"))
        except Exception as error:
            observe({"status": "failed", "error": str(error) if disclose else type(error).__name__, "seconds": perf_counter() - began, **note})
            raise
        observe({"status": "completed", "answers": out.count(), "seconds": perf_counter() - began, **note})
        return out

    return noted


def total_usage(rows: DataFrame, *by: str) -> DataFrame:
    """Sums that stay null where no row reports a value: unreported is not zero."""
    present = [c for c in s.USAGE_COLUMNS if c in rows.columns]
    return rows.groupBy(*by).agg(*[F.sum(c).alias(c) for c in present])


def error_class(message: Column, status: Column | None = None, data_error: Column | None = None) -> Column:
    """'data', 'transient' or 'fatal' of a failed call: a status decides where there is one, else the message."""
    has = lambda marks: F.greatest(*[F.contains(message, F.lit(m)) for m in marks])
    by_text = F.when(message.isNull() | has(ENDED_MARKERS), "fatal").when(has(TRANSIENT_MARKERS), "transient").otherwise("fatal")
    out = by_text
    if status is not None:
        again = status.isin(429, 408) | status.between(500, 599)
        out = F.when(status.isNotNull(), F.when(again, "transient").otherwise("fatal")).otherwise(by_text)
    return out if data_error is None else F.when(data_error, "data").otherwise(out)


def failure_kind(error: Exception) -> str:
    """'transient' or 'fatal': a status decides where there is one, else the message."""
    status = getattr(error, "status", None)
    if status is not None:
        return "transient" if status in (429, 408) or 500 <= status < 600 else "fatal"
    text = str(error)
    if any(m in text for m in ENDED_MARKERS):
        return "fatal"
    return "transient" if any(m in text for m in TRANSIENT_MARKERS) else "fatal"


def with_retries(call: Callable, attempts: int = 3, classify: Callable[[Exception], str] | None = None) -> Callable:
    """call, tried again after failures that are transient; the caller's own classifier goes first."""
    kind = classify or failure_kind

    def tried(*args, **kwargs):
        for n in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception as error:
                if n + 1 == attempts or kind(error) != "transient":
                    raise

    return tried


@dataclass(frozen=True)
class Step:
    """One step of a flow: call adds output (and usage columns) to rows with prompt and input."""

    name: str
    call: Callable[[DataFrame], DataFrame]
    model: str
    prompt: str
    adapter_version: str
    context_policy: str = ""


def flow(requests: DataFrame, steps: list[Step], path: str, **options) -> tuple[DataFrame, dict[str, dict]]:
    """requests (input) through steps, each over the whole batch and through its own cache under path.

    A step's output is the next one's input; the result has the last output, the reports are by step. options: as
    caching.cached() takes.
    """
    from lodestack.operators.caching import cached_generate

    if not steps or len({x.name for x in steps}) < len(steps) or not all(x.name.strip() for x in steps):
        raise ContractError("a flow needs steps with names of their own")
    now, reports = requests, {}
    for step in steps:
        asked = now.withColumn("prompt", F.lit(step.prompt))
        found, reports[step.name] = cached_generate(asked, step.call, step.model, f"{path}/{step.name}", step.adapter_version, step.context_policy, step.name, **options)
        now = found.withColumn("input", F.col("output")).drop("output", "prompt")
    return now.withColumnRenamed("input", "output"), reports
