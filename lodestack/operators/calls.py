"""Calls to models by item: bounded numbers in flight, retries, dead letters, usage that is never lost.

Distinct keys that are neither stored nor given up are called once. A task deals its items to calls of a few items
each, some of which are in flight at a time. A call that fails for a reason that may pass is tried again after
a growing pause; one that fails for good, or answers another number of items than it was given, is cut in two until single
items are left, so that one bad item costs its neighbours nothing. What failed is a row like any other: the dead-letter
table holds why, how often it was tried, and what that spent.

Items are called in waves of bounded size. A wave is a Spark job whose rows are committed when it ends: a lost executor
costs the calls of its own unfinished tasks, no more.
"""

from __future__ import annotations

import random
import time
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.operators.common import ContractError, saved, scratch
from lodestack.operators.generation import failure_kind

USAGE = {c: "double" if c == "cost_usd" else "bigint" for c in s.USAGE_COLUMNS}
#: What is stored of an item: output is null for a failed one, failure for one that is answered.
ROW = "key string, output string, attempts int, failure string, failure_class string, " + ", ".join(f"{c} {x}" for c, x in USAGE.items())
NAMES = [x.split()[0] for x in ROW.split(", ")]


@dataclass(frozen=True)
class Policy:
    """batch: items of a call; in_flight: calls of a task at a time; pauses are delay, twice that and so on, longest at most."""

    batch: int = 1
    in_flight: int = 8
    attempts: int = 3
    delay: float = 0.5
    longest: float = 30.0
    #: Items of a wave, at most.
    wave: int = 100_000
    classify: Callable[[Exception], str] = failure_kind

    def __post_init__(self):
        if min(self.batch, self.in_flight, self.attempts, self.wave) < 1 or self.delay < 0 or self.longest < 0:
            raise ContractError("batch, in_flight, attempts and wave must be positive, pauses not negative")


Call = Callable[[list[dict]], list[dict]]


def _ask(call: Call, policy: Policy, items: list[dict], tried: int = 0, spent: dict | None = None) -> list[dict]:
    """Rows of some items. tried and spent: what calls that held them with others have cost before."""
    spent = dict(spent or {})
    for n in range(policy.attempts):
        tried += 1
        try:
            answers = call(items)
            if len(answers) != len(items):
                raise ContractError(f"a call of {len(items)} items was answered by {len(answers)}")
            rows = [{"key": i["key"], "output": a["output"], "attempts": tried, **{c: a.get(c) for c in USAGE}} for i, a in zip(items, answers, strict=True)]
            return [_add(rows[0], spent), *rows[1:]]
        except Exception as error:  # noqa: BLE001 - whatever a provider raises becomes the item's row
            kind, text = policy.classify(error), f"{type(error).__name__}: {error}"
            spent = _add(spent, getattr(error, "usage", None) or {})
            if kind != "transient":
                break
            if n + 1 < policy.attempts:
                time.sleep(min(policy.longest, policy.delay * 2**n) * random.uniform(0.5, 1.0))
    if len(items) > 1:
        middle = len(items) // 2
        return _ask(call, policy, items[:middle], tried, spent) + _ask(call, policy, items[middle:], tried)
    return [_add({"key": items[0]["key"], "attempts": tried, "failure": text, "failure_class": kind}, spent)]


def _add(row: dict, spent: dict) -> dict:
    """row with the usage of spent added; what neither reports stays null."""
    return row | {c: (row.get(c) or 0) + (spent.get(c) or 0) for c in USAGE if row.get(c) is not None or spent.get(c) is not None}


def call_items(items: DataFrame, call: Call, policy: Policy = Policy()) -> DataFrame:
    """One row (key, output, attempts, failure, failure_class, usage) for each row of items (key, which is distinct, and others).

    call gets items as dictionaries and returns a dictionary for each, in their order: output and any of the usage columns.
    Its exceptions may carry usage. Reading the result twice calls twice: save it first.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(policy.in_flight) as pool:
            flying = set()
            for frame in frames:
                rows = frame.to_dict("records")
                for at in range(0, len(rows), policy.batch):
                    if len(flying) >= policy.in_flight:
                        done, flying = wait(flying, return_when=FIRST_COMPLETED)
                        yield _frame(done)
                    flying.add(pool.submit(_ask, call, policy, rows[at : at + policy.batch]))
            yield _frame(flying)

    return items.mapInPandas(task, ROW)


def _frame(done) -> pd.DataFrame:
    rows = [r for f in done for r in f.result()]
    out = pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in NAMES})
    for c, x in USAGE.items():
        out[c] = out[c].astype("Float64" if x == "double" else "Int64")
    return out.astype({"attempts": "Int32"})


def _stored(spark, path: str, ddl: str) -> DataFrame:
    from lodestack.sources.bundle import exists

    return spark.read.schema(ddl).parquet(path) if exists(spark, path) else spark.createDataFrame([], ddl)


def called(rows: DataFrame, key: Column, call: Call, path: str, policy: Policy = Policy(), budget: int | None = None, again: bool = False) -> tuple[DataFrame, dict]:
    """rows with output, failure and failure_class through a store of answers under path, and a report.

    Keys that are stored are not called. Keys in the dead-letter table that failed for good are given up, unless again is set;
    those whose reason may pass are called anew. budget: keys that are called at most, those of least hash; the rest is
    left without output or failure. Rows without a key (null) are left as well.
    Report: rows, hits, and of distinct keys: called, answered, failed, left, given_up; attempts and the usage of this run.
    """
    spark = rows.sparkSession
    clash = {"key", "output", "failure", "failure_class"} & set(rows.columns)
    if clash:
        raise ContractError(f"rows must not have columns {', '.join(sorted(clash))}")
    answers, dead, run = f"{path}/answers", f"{path}/dead", uuid.uuid4().hex
    ddl = f"{ROW}, run string"
    keyed = rows.withColumn("key", key)
    known = _stored(spark, answers, ddl).select("key").distinct()
    dead_before = _stored(spark, dead, ddl)
    gone = dead_before.where("failure_class <> 'transient'").select("key").distinct() if not again else None
    missing = keyed.where("key is not null").join(known, "key", "left_anti")
    asked = missing if gone is None else missing.join(gone, "key", "left_anti")
    # one row of each key, written: what is called and what is counted are the same
    order = F.xxhash64("key")
    items = saved(asked.groupBy("key").agg(F.any_value(F.struct(*rows.columns)).alias("r")).select("key", "r.*", order.alias("__order")), scratch(spark, "items"))
    n_items, n_hits = items.count(), keyed.join(known, "key", "left_semi").count()
    n_given_up = missing.select("key").distinct().join(gone, "key", "left_semi").count() if gone is not None else 0
    n_called = n_items if budget is None else min(n_items, budget)
    chosen = items if n_called == n_items else saved(items.orderBy("__order", "key").limit(n_called), scratch(spark, "chosen"))
    waves = -(-n_called // policy.wave)
    for n in range(waves):
        part = chosen.where(F.pmod("__order", F.lit(waves)) == n).drop("__order")
        done = saved(call_items(part, call, policy).withColumn("run", F.lit(run)), scratch(spark, "called"))
        done.where("failure is null").write.mode("append").parquet(answers)
        done.where("failure is not null").write.mode("append").parquet(dead)
    stored = _stored(spark, answers, ddl)
    failed = _stored(spark, dead, ddl)
    mine = stored.where(F.col("run") == run).unionByName(failed.where(F.col("run") == run))
    seen = mine.agg(F.count("*").alias("n"), F.count("failure").alias("failed"), F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts"), *[F.sum(c).alias(c) for c in USAGE]).first()
    latest = failed.groupBy("key").agg(F.max_by(F.struct("failure", "failure_class"), F.col("run") == run).alias("f")).select("key", "f.failure", "f.failure_class")
    answered = stored.groupBy("key").agg(F.any_value("output").alias("output"))
    out = keyed.join(answered, "key", "left").join(latest.join(answered, "key", "left_anti"), "key", "left")
    report = {"rows": rows.count(), "hits": n_hits, "called": seen["n"], "answered": seen["n"] - seen["failed"], "failed": seen["failed"], "left": n_items - n_called, "given_up": n_given_up, "attempts": seen["attempts"]}
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], "output", "failure", "failure_class"), report | {"usage": {c: seen[c] for c in USAGE}}
