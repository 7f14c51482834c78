"""Calls by item: failures that stay with their item, retries, budgets, dead letters, usage."""

import hashlib
import time

import pytest
from pyspark.sql import functions as F

from lodestack.operators import calls, reranking
from lodestack.operators.common import ContractError

FAST = calls.Policy(batch=4, in_flight=3, attempts=3, delay=0.0, wave=30)


def rows(spark, n=100, copies=2):
    return spark.createDataFrame([(i, f"text {i % (n // copies)}") for i in range(n)], "id long, text string")


def bad(text):
    return hashlib.sha256(text.encode()).digest()[0] % 20 == 0


class Busy(Exception):
    status = 503

    def __init__(self, usage=None):
        super().__init__("try later")
        self.usage = usage


def answer(text):
    return {"output": text.upper(), "input_tokens": len(text), "output_tokens": 1}


def test_one_bad_item_costs_its_neighbours_nothing(spark, tmp_path):
    texts = rows(spark, 400)

    def call(items):
        if any(bad(i["text"]) for i in items):
            raise ContractError("refused")
        return [answer(i["text"]) for i in items]

    out, report = calls.called(texts, F.sha2("text", 256), call, str(tmp_path / "s"), FAST)
    got = {r["id"]: r for r in out.collect()}
    distinct = {f"text {i}" for i in range(200)}
    lost = {x for x in distinct if bad(x)}
    assert len(got) == 400 and 3 < len(lost) < 30
    for i, r in got.items():
        assert (r["output"], r["failure_class"]) == ((None, "fatal") if bad(r["text"]) else (r["text"].upper(), None))
        assert (r["failure"] is None) == (not bad(r["text"]))
    assert (report["rows"], report["hits"], report["called"], report["answered"], report["failed"]) == (400, 0, 200, 200 - len(lost), len(lost))
    assert report["usage"]["input_tokens"] == sum(len(x) for x in distinct - lost)
    _, second = calls.called(texts, F.sha2("text", 256), call, str(tmp_path / "s"), FAST)
    assert (second["called"], second["given_up"], second["hits"]) == (0, len(lost), 400 - 2 * len(lost)) and second["usage"]["input_tokens"] is None
    healed, third = calls.called(texts, F.sha2("text", 256), lambda items: [answer(i["text"]) for i in items], str(tmp_path / "s"), FAST, again=True)
    assert third["called"] == len(lost) and healed.where("output is null or failure is not null").count() == 0


def test_retries_dead_letters_and_usage_of_failures(spark, tmp_path):
    texts = rows(spark, 40, 1)

    def call(items):
        met = call.__dict__.setdefault("met", {})
        for i in items:
            n = met[i["key"]] = met.get(i["key"], 0) + 1
            if i["text"].endswith("7") or n < 2:  # those with a 7 never come through
                raise Busy({"input_tokens": 100})
        return [answer(i["text"]) for i in items]

    one = calls.Policy(batch=1, attempts=3, delay=0.0)
    out, report = calls.called(texts, F.col("text"), call, str(tmp_path / "s"), one)
    assert {r["text"] for r in out.where("failure_class = 'transient'").collect()} == {f"text {i}" for i in (7, 17, 27, 37)}
    # two attempts for those that came through at the second, three for those that did not
    assert report["attempts"] == 36 * 2 + 4 * 3
    assert report["usage"]["input_tokens"] == 36 * 100 + 4 * 300 + sum(len(f"text {i}") for i in range(40) if i % 10 != 7)
    dead = spark.read.parquet(str(tmp_path / "s" / "dead"))
    assert dead.count() == 4 and {r["attempts"] for r in dead.collect()} == {3} and "Busy: try later" in dead.first()["failure"]
    # a reason that may pass is tried anew by the next run, without being asked
    again, second = calls.called(texts, F.col("text"), lambda items: [answer(i["text"]) for i in items], str(tmp_path / "s"), one)
    assert second["called"] == 4 and again.where("output is null").count() == 0


def test_budget_null_keys_and_misaligned_answers(spark, tmp_path):
    texts = rows(spark, 60, 1).unionByName(spark.createDataFrame([(99, None)], "id long, text string"))
    call = lambda items: [answer(i["text"]) for i in items]
    out, report = calls.called(texts, F.col("text"), call, str(tmp_path / "s"), FAST, budget=25)
    assert (report["called"], report["left"]) == (25, 35) and out.where("output is not null").count() == 25 and out.count() == 61
    _, second = calls.called(texts, F.col("text"), call, str(tmp_path / "s"), FAST, budget=100)
    assert (second["called"], second["left"], second["hits"]) == (35, 0, 25)
    short = lambda items: [answer(i["text"]) for i in items][: 1 if len(items) > 1 else 2]
    whole, third = calls.called(texts.where("id < 8"), F.col("text"), short, str(tmp_path / "t"), FAST)
    assert third["answered"] == 8 and third["attempts"] > 8 and whole.where("output is null").count() == 0
    assert calls.called(texts.limit(0), F.col("text"), call, str(tmp_path / "u"), FAST)[1]["called"] == 0
    with pytest.raises(ContractError, match="columns"):
        calls.called(texts.withColumn("output", F.lit(1)), F.col("text"), call, str(tmp_path / "v"))
    with pytest.raises(ContractError, match="positive"):
        calls.Policy(in_flight=0)


def test_calls_are_in_flight_together(spark):
    items = spark.createDataFrame([(str(i), i) for i in range(24)], "key string, n int").coalesce(1)

    def slow(batch):
        time.sleep(0.2)
        return [{"output": "x"} for _ in batch]

    items.mapInPandas(lambda frames: frames, items.schema).count()  # workers are up
    began = time.perf_counter()
    assert calls.call_items(items, slow, calls.Policy(batch=1, in_flight=8)).collect()
    assert time.perf_counter() - began < 0.2 * 24 * 0.6


def test_provider_rerank_contract(spark, tmp_path):
    good = [{"index": 1, "score": 0.9, "rank": 1}, {"index": 0, "score": 0.2, "rank": 2}]
    assert reranking.scores_of(good, 2) == [0.2, 0.9] and reranking.scores_of([], 0) == []
    for broken in ([{"index": 0, "score": 1.0}], [{"index": 0, "score": 1.0}] * 2, [{"index": 0, "score": 1.0}, {"index": 2, "score": 1.0}], [{"index": 0, "score": 1.0}, {"index": 1, "score": float("nan")}], [{"index": 0, "score": 1.0}, {"index": True, "score": 1.0}], [{**good[0], "rank": 2}, {**good[1], "rank": 1}], [good[0], {"index": 0, "score": 0.1}]):
        with pytest.raises(ContractError):
            reranking.scores_of(broken, 2)
    candidates = spark.createDataFrame([(q, f"c{i}", i + 1, f"d{i}", "x" * (i + 1)) for q in ("a", "b") for i in range(4)], "query_id string, chunk_id string, rank int, content_digest string, text string")
    queries = spark.createDataFrame([("a", "fine"), ("b", "broken")], "query_id string, text string")

    def call(query, texts):
        found = [{"index": i, "score": len(x)} for i, x in enumerate(texts)]
        return {"results": found[:-1] if query == "broken" else found, "input_tokens": 10}

    out, report = reranking.rerank_items(candidates, queries, call, "m", 2, str(tmp_path / "r"))
    assert [(r["query_id"], r["chunk_id"], r["rank"], r["reranker_score"]) for r in out.orderBy("rank").collect()] == [("a", "c3", 1, 4.0), ("a", "c2", 2, 3.0)]
    assert (report["answered"], report["failed"], report["usage"]["input_tokens"]) == (1, 1, 20)
