"""Search, fusion, filters, answering, metrics and statistics on small fixtures."""

import hashlib
import math
import shutil

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lodestack.operators import answering as ans
from lodestack.operators import caching, chunking, embedding, generation, lexical, reranking, statistics, vector_search
from lodestack.operators import evaluation as ev
from lodestack.operators import retrieval as r
from lodestack.operators import validation as val
from lodestack.operators.best import Best
from lodestack.operators.common import ContractError

HIT = "query_id string, representation_id string, chunk_id string, document_id string, channel string, rank int, score double"


def records(spark, **texts):
    return spark.createDataFrame([(f"r-{k}", k, f"d-{k}", x) for k, x in texts.items()], "representation_id string, chunk_id string, document_id string, text string")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(texts)], "query_id string, text string")


def terms(x):
    import re

    return [w for w in re.split(r"[^\w]+|_", x.lower()) if w]


def bm25(texts, query, k1=1.2, b=0.75):
    bags = {k: terms(x) for k, x in texts.items()}
    n, avg = len(bags), sum(map(len, bags.values())) / len(bags)
    out = {}
    for k, bag in bags.items():
        score = 0.0
        for term in terms(query):
            tf, df = bag.count(term), sum(term in x for x in bags.values())
            if tf:
                score += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(bag) / avg))
        if score:
            out[k] = score
    return out


def test_bm25_scores(spark):
    texts = {"oak": "Oak trees grow in oak soil", "pine": "Pine trees", "none": "", "soil": "soil soil soil and oak"}
    for query in ("oak soil", "oak oak trees", "zzz", ""):
        for config in (lexical.BM25Config(), lexical.BM25Config(b=0.0), lexical.BM25Config(k1=0.4, b=1.0)):
            got = {h["chunk_id"]: h["score"] for h in lexical.search(records(spark, **texts), asked(spark, query), 10, config).collect()}
            want = bm25(texts, query, config.k1, config.b)
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_ties_go_by_document(spark):
    hits = lexical.search(records(spark, b="same words", a="same words"), asked(spark, "words"), 5).collect()
    assert [(h["rank"], h["chunk_id"]) for h in sorted(hits, key=lambda h: h["rank"])] == [(1, "a"), (2, "b")]
    with pytest.raises(ContractError):
        lexical.search(records(spark, a="x"), asked(spark, "x"), 0)


def test_hash_embedding_golden(spark):
    row = embedding.hash_embed(spark.createDataFrame([("a", "oak tree"), ("b", "")], "id string, text string"), 16).orderBy("id").collect()
    assert {i: round(x, 6) for i, x in enumerate(row[0]["values"]) if x} == {11: -0.707107, 14: 0.707107} and row[0]["n_terms"] == 2
    assert not any(row[1]["values"]) and row[1]["n_terms"] == 0


def vectors(spark, n=60, dims=8, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"r{i}", f"c{i}", f"d{i % 7}", [float(x) for x in rng.standard_normal(dims)]) for i in range(n)] + [("zero", "cz", "dz", [0.0] * dims), ("r0x", "c0x", "d00", None)]
    rows[-1] = ("r0x", "c0x", "d00", rows[0][3])
    return spark.createDataFrame(rows, "representation_id string, chunk_id string, document_id string, values array<float>")


def test_exact_search_agrees_with_expressions(spark, monkeypatch):
    index = vectors(spark)
    queries = index.limit(9).select(F.col("representation_id").alias("query_id"), "values")
    want = sorted((h["query_id"], h["rank"], h["representation_id"], round(h["score"], 6)) for h in vector_search.exact_expression(index, queries, 6).collect())
    for block in (4096, 3):
        monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
        got = sorted((h["query_id"], h["rank"], h["representation_id"], round(h["score"], 6)) for h in vector_search.exact(index.repartition(5), queries, 6).collect())
        assert got == want
    assert vector_search.exact(index, queries.limit(0), 3).count() == 0


def test_ties_do_not_depend_on_partitions(spark, monkeypatch):
    """Scores 1e-10 apart are ties, and the smaller ids win however rows are dealt into tasks, batches and blocks."""
    rows = [(f"r{i:02}", f"c{i:02}", f"d{i:02}", [1.0, 1e-5 * (i % 3), 0.0]) for i in range(40)] + [("x", "x", "x", [0.0, 0.0, 1.0])] * 3
    index = spark.createDataFrame(rows, "representation_id string, chunk_id string, document_id string, values array<double>")
    queries = spark.createDataFrame([("q", [1.0, 0.0, 0.0]), ("p", [2.0, 0.0, 0.0]), ("o", [0.0, 0.0, 1.0])], "query_id string, values array<double>")
    want = sorted((h["query_id"], h["rank"], h["representation_id"]) for h in vector_search.exact_expression(index, queries, 4).collect())
    assert [x[2] for x in want if x[0] == "q"] == ["r00", "r01", "r02", "r03"]
    for parts, block, cells in ((1, 4096, 10**6), (2, 4096, 7), (16, 4096, 10**6), (2, 2, 10**6)):
        monkeypatch.setattr(vector_search, "QUERY_BLOCK", block)
        monkeypatch.setattr(vector_search, "CELLS", cells)
        monkeypatch.setattr(vector_search, "INDEX_BLOCK", 10)
        got = sorted((h["query_id"], h["rank"], h["representation_id"]) for h in vector_search.exact(index.repartition(parts), queries, 4).collect())
        assert got == want, (parts, block)


def test_best_rows_are_bounded_and_those_of_the_whole_order():
    rng = np.random.default_rng(2)
    scores = rng.integers(0, 4, (500, 3)).astype(float)
    keys = pd.DataFrame({c: [f"{c[0]}{i:03}" for i in rng.permutation(500)] for c in ("document_id", "chunk_id", "representation_id")})
    found = Best(["a", "b", "c"], 5)
    for start in range(0, 500, 20):
        found.add(scores[start : start + 20], keys.iloc[start : start + 20], scores[start : start + 20] > 0)
        assert sum(len(x) for x in found.held) <= 3 * 5 * (Best.WAITING + 1)
    got = found.rows()
    for q, name in enumerate("abc"):
        whole = keys.assign(score=scores[:, q]).query("score > 0").sort_values(["score", "document_id", "chunk_id", "representation_id"], ascending=[False, True, True, True])
        assert got[got["query_id"] == name]["document_id"].tolist() == whole["document_id"].tolist()[:5]


def test_best_documents_are_those_of_all_chunks(spark, monkeypatch):
    """A document with many good chunks takes one place, and the places after it are filled."""
    texts = {f"big{i:02}": "oak oak oak" for i in range(40)} | {f"one{i}": "oak " + "filler " * (i + 1) for i in range(5)}
    rows = records(spark, **texts).withColumn("document_id", F.when(F.startswith("chunk_id", F.lit("big")), "big").otherwise(F.col("chunk_id")))
    for parts, cells in ((1, 10**6), (5, 10**6), (2, 3)):
        monkeypatch.setattr(lexical, "CELLS", cells)
        found = lexical.search(rows.repartition(parts), asked(spark, "oak"), 4, by_document=True).orderBy("rank").collect()
        assert [(h["document_id"], h["chunk_id"]) for h in found] == [("big", "big00"), ("one0", "one0"), ("one1", "one1"), ("one2", "one2")]


def test_persisted_index(spark, tmp_path, monkeypatch):
    texts = {"oak": "Oak trees grow in oak soil", "pine": "Pine trees", "none": "", "soil": "soil soil soil and oak"}
    rows = records(spark, **texts).withColumn("title", F.lit("oak title"))
    queries = spark.createDataFrame([("1", "oak soil"), ("2", "trees trees zzz"), ("3", "")], "query_id string, text string")
    path = str(tmp_path / "index")
    lexical.build_index(rows, path, {"title": F.col("title"), "text": F.col("text")})
    with pytest.raises(ContractError):
        lexical.build_index(rows, path)
    stored = lexical.open_index(spark, path, check=True)
    plain = lambda df: sorted((h["query_id"], h["rank"], h["chunk_id"], round(h["score"], 9)) for h in df.collect())
    for block, cells in ((4096, 10**6), (1, 10**6), (4096, 2)):
        monkeypatch.setattr(lexical, "QUERY_BLOCK", block)
        monkeypatch.setattr(lexical, "CELLS", cells)
        assert plain(lexical.search(stored, queries, 3)) == plain(lexical.search(rows, queries, 3))
        assert plain(lexical.search_fields(stored, queries, 3)) == plain(lexical.search_fields(rows, queries, 3))
    for q, query in (("1", "oak soil"), ("2", "trees trees zzz")):
        assert {h["chunk_id"]: round(h["score"], 9) for h in lexical.search(stored, queries, 9).collect() if h["query_id"] == q} == {k: round(x, 9) for k, x in bm25(texts, query).items()}
    spark.read.parquet(f"{path}/entries").limit(2).write.parquet(str(tmp_path / "cut"))
    shutil.rmtree(f"{path}/entries")
    shutil.move(tmp_path / "cut", f"{path}/entries")
    with pytest.raises(ContractError):
        lexical.open_index(spark, path, check=True)


def test_approximate_recall(spark):
    index = vectors(spark, 400, 16)
    queries = index.limit(20).select(F.col("representation_id").alias("query_id"), "values")
    exact = {(h["query_id"], h["representation_id"]) for h in vector_search.exact(index, queries, 5).collect()}
    near = {(h["query_id"], h["representation_id"]) for h in vector_search.approximate(index, queries, 5).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def test_approximate_search_of_clusters_scores_little(spark, monkeypatch):
    """Vectors in clusters: the recall that is asked for, while a query meets less than a tenth of the index."""
    rng = np.random.default_rng(4)
    centers = rng.standard_normal((60, 24))
    points = centers[rng.integers(0, 60, 6000)] + 0.25 * rng.standard_normal((6000, 24))
    index = spark.createDataFrame([(f"r{i}", f"c{i}", f"d{i}", [float(x) for x in v]) for i, v in enumerate(points)], "representation_id string, chunk_id string, document_id string, values array<float>")
    queries = index.limit(100).select(F.col("representation_id").alias("query_id"), "values")
    m = vector_search.sampled(index)
    found = vector_search.centroids(m, 300)
    probes = vector_search.probes_for(m, found, 10, 0.95)
    size = np.bincount(vector_search._nearest(m, found, 1)[:, 0], minlength=300)
    share = size[vector_search._nearest(m[:100], found, probes)].sum(axis=1).mean() / len(m)
    assert share < 0.1
    exact = {(h["query_id"], h["representation_id"]) for h in vector_search.exact(index, queries, 10).collect()}
    monkeypatch.setattr(vector_search, "INDEX_BLOCK", 7)
    near = {(h["query_id"], h["representation_id"]) for h in vector_search.approximate(index, queries, 10, cells=300).collect()}
    assert len(exact & near) / len(exact) >= 0.9


def hits(spark):
    rows = [("q", "r1", "a", "d1", "bm25", 1, 3.0), ("q", "r2", "a", "d1", "bm25", 2, 2.5), ("q", "r3", "b", "d1", "bm25", 3, 2.0), ("q", "r3", "b", "d1", "vector", 1, 0.9), ("q", "r4", "c", "d2", "vector", 2, 0.8)]
    return spark.createDataFrame(rows, HIT)


def test_collapse(spark):
    one = hits(spark).where("channel = 'bm25'")
    assert [(h["chunk_id"], h["rank"]) for h in r.collapse(one, "chunk").orderBy("rank").collect()] == [("a", 1), ("b", 2)]
    assert [(h["chunk_id"], h["rank"], h["score"]) for h in r.collapse(one, "document").collect()] == [("a", 1, 3.0)]
    with pytest.raises(ContractError):
        r.collapse(one, "unit")


def test_fusion(spark):
    collapsed = r.collapse(hits(spark).where("channel = 'bm25'"), "chunk").unionByName(hits(spark).where("channel = 'vector'"))
    rows = r.fuse(collapsed, 60, {"bm25": 2.0, "vector": 0.0}).orderBy("rank").collect()
    assert [h["chunk_id"] for h in rows] == ["b", "a", "c"]
    assert rows[0]["score"] == pytest.approx(2 / 62 + 1 / 61) and [c["channel"] for c in rows[0]["contributions"]] == ["bm25", "vector"]
    prefixed = r.fuse(collapsed.withColumn("channel", F.concat("channel", F.lit(":q2"))), 60, {"bm25": 3.0}).where("chunk_id = 'a'").first()
    assert prefixed["score"] == pytest.approx(3 / 61)
    twice = r.fuse(hits(spark).where("channel = 'bm25'"), 60).where("chunk_id = 'a'").first()
    assert len(twice["contributions"]) == 2
    for bad in ({"constant": 0}, {"constant": float("nan")}, {"weights": {"x": -1.0}}):
        with pytest.raises(ContractError):
            r.fuse(hits(spark), **bad)
    clash = hits(spark).unionByName(spark.createDataFrame([("q", "r9", "a", "other", "x", 1, 1.0)], HIT))
    with pytest.raises(Exception, match="conflicting"):
        r.fuse(clash).collect()


def chunk_table(spark, **texts):
    return spark.createDataFrame([(k, "d", x, hashlib.sha256(x.encode()).hexdigest()) for k, x in texts.items()], "id string, document_id string, text string, content_digest string")


def test_hydrate_lookup_and_targets(spark):
    fused = r.from_hits(hits(spark).where("channel = 'vector'"))
    chunks = chunk_table(spark, b="bee", c="sea")
    assert [h["text"] for h in r.hydrate(fused, chunks, 1).collect()] == ["bee"] and r.hydrate(fused, chunks).count() == 2
    with pytest.raises(Exception, match="unknown chunk"):
        r.hydrate(fused, chunk_table(spark, b="bee")).collect()
    assert [x["text"] for x in r.lookup(["c", "b"], chunks).collect()] == ["sea", "bee"]
    for bad in (["b", "b"], [""], [str(i) for i in range(300)]):
        with pytest.raises(ContractError):
            r.lookup(bad, chunks)
    docs = spark.createDataFrame([("d1", {"evaluation_unit_id": "u", "source_role": "x"}), ("d2", {})], "id string, metadata map<string,string>")
    assert {h["target_id"] for h in r.target_ids(hits(spark), "unit", docs).collect()} == {"u", "d2"}
    kept = r.filter_roles(hits(spark).where("channel = 'vector'"), docs, ["x"], 2, 2).collect()
    assert [(h["chunk_id"], h["rank"]) for h in kept] == [("b", 1)]


def test_rerank(spark):
    queries, chunks = asked(spark, "red oak leaf"), chunk_table(spark, a="pine", b="oak leaf", c="red oak leaf leaf")
    fused = spark.createDataFrame([("q0", "a", "d", 1, 9.0), ("q0", "b", "d", 2, 8.0), ("q0", "c", "d", 3, 7.0)], "query_id string, chunk_id string, document_id string, rank int, score double")
    candidates = r.hydrate(fused, chunks)
    out = reranking.term_overlap(candidates, queries, 2).orderBy("rank").collect()
    assert [(x["chunk_id"], x["reranker_score"]) for x in out] == [("c", 3.0), ("b", 2.0)]
    own = reranking.rerank(candidates, queries, lambda q, texts: [len(x) for x in texts], 3)
    assert [x["chunk_id"] for x in own.orderBy("rank").collect()] == ["c", "b", "a"] and reranking.rerank_problems(candidates, own, 3).count() == 0
    assert reranking.rerank_problems(candidates, own, 2).count() == 1
    with pytest.raises(Exception):
        reranking.rerank(candidates, queries, lambda q, texts: [float("nan")] * 3, 3).collect()


def evidence(spark, *texts):
    rows = [("q0", f"c{i}", "d", i + 1, 1.0, x, hashlib.sha256(x.encode()).hexdigest()) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id string, chunk_id string, document_id string, rank int, score double, text string, content_digest string")


def test_packing_skips_what_does_not_fit(spark):
    row = ans.pack_context(evidence(spark, "x" * 50, "y" * 60, "z" * 40, "w" * 10), 3, 100).first()
    assert row["admitted"] == ["c0", "c2", "c3"] and row["omitted"] == ["c1"] and row["used"] == 100


@pytest.mark.parametrize(
    "raw,valid,category",
    [
        ('{"answer":"a","citation_chunk_ids":["E1"],"abstained":false}', True, None),
        ('```json\n{"answer":"a","citation_chunk_ids":["E2"],"abstained":false}\n```', True, None),
        ('{"answer":"","citation_chunk_ids":[],"abstained":true}', True, None),
        ('{"answer":"a","citation_chunk_ids":["E1","E1"],"abstained":false}', False, "contract"),
        ('{"answer":"a","citation_chunk_ids":["E7"],"abstained":false}', False, "contract"),
        ('{"answer":"a","citation_chunk_ids":[],"abstained":false}', False, "contract"),
        ('{"answer":" ","citation_chunk_ids":["E1"],"abstained":false}', False, "contract"),
        ('{"answer":"a","citation_chunk_ids":["E1"],"abstained":true}', False, "contract"),
        ('{"answer":"a","abstained":false}', False, "parse"),
        ('{"answer":"a","citation_chunk_ids":["E1"],"abstained":false,"x":1}', False, "parse"),
        ('{"answer":"a","citation_chunk_ids":["E1"],"abstained":false} more', False, "parse"),
        ("not json", False, "parse"),
    ],
)
def test_answer_contract(spark, raw, valid, category):
    prepared = ans.prepare(evidence(spark, "one", "two"), ans.Config(evidence_k=5), "ordinal")
    row = ans.interpret(spark.createDataFrame([("q0", raw)], "query_id string, output string"), prepared).first()
    assert (row["valid"], row["failure_category"]) == (valid, category)
    if valid and not row["abstained"]:
        assert row["citations"][0] in ("c0", "c1")
    if not valid:
        assert row["abstained"] and row["answer"] == "" and row["citations"] == [] and row["failures"]


def service(spark):
    texts = {"a": "oak trees and soil", "b": "pine trees", "c": "soil and water"}
    index = records(spark, **texts)
    chunks = chunk_table(spark, **texts).withColumn("document_id", F.concat(F.lit("d-"), "id"))
    embed = lambda df, key: embedding.hash_embed(df, 32, key)
    vec = index.join(embed(index, "chunk_id").select("chunk_id", "values"), "chunk_id")

    def generate(df, kind):
        if kind == "multi-query":
            return df.withColumn("output", F.when(F.col("query_id") == "q0", '{"variants":["oak", "soil","water"]}').otherwise("broken"))
        if kind == "hyde":
            return df.withColumn("output", F.when(F.col("query_id") == "q0", "water soil").otherwise(" "))
        return df.withColumn("output", F.lit('{"answer":"yes","citation_chunk_ids":["a"],"abstained":false}'))

    return ans.Service(chunks, lambda q, k: lexical.search(index, q, k), lambda q, k: vector_search.exact(vec, embed(q, "query_id").select("query_id", "values"), k), lambda c, q, n: reranking.term_overlap(c, q, n), generate)


@pytest.mark.parametrize("strategy", ans.STRATEGIES)
def test_strategies(spark, strategy):
    config = ans.Config(strategy, retrieve_k=3, evidence_k=2, rerank_candidates=3)
    found = ans.retrieve(service(spark), asked(spark, "oak soil", "pine"), config)
    rows = found.evidence.collect()
    assert {x["query_id"] for x in rows} == {"q0", "q1"} and max(x["rank"] for x in rows) <= 2
    assert [x["chunk_id"] for x in rows if x["query_id"] == "q0" and x["rank"] == 1] == ["a" if strategy != "hyde" else next(x["chunk_id"] for x in rows if x["query_id"] == "q0" and x["rank"] == 1)]
    if strategy == "multi-query":
        got = {x["query_id"]: x for x in found.variants.collect()}
        assert got["q0"]["variants"] == ["oak", "soil", "water"] and got["q1"]["error"]
        assert {x["channel"] for x in found.hits.collect()} == {"bm25", "vector", *[f"{c}:q{n}" for c in ("bm25", "vector") for n in (2, 3, 4)]}


def test_answer_end_to_end_and_request_checks(spark):
    stages = []
    s = service(spark)
    s.observe = stages.append
    (row,) = ans.answer(s, asked(spark, "oak soil"), ans.Config(evidence_k=2, retrieve_k=3)).collect()
    assert row["valid"] and row["citations"] == ["a"] and [(x["sequence"], x["status"]) for x in stages] == list(enumerate(["started", "completed"] * 4))
    bad = [ans.Config("nope"), ans.Config(retrieve_k=0), ans.Config(evidence_k=0), ans.Config(rrf_constant=0.0), ans.Config(rrf_weights={"bm25": 0.0}), ans.Config(rrf_weights={"x": 1.0}), ans.Config("rrf-reranked", rerank_candidates=1), ans.Config(query_variants=-1)]
    for config in bad:
        with pytest.raises(ContractError):
            ans.check_request(s, config)
    with pytest.raises(ContractError):
        ans.check_request(ans.Service(s.chunks), ans.Config("bm25"))
    with pytest.raises(ContractError):
        ans.answer(s, asked(spark, " "), ans.Config())
    assert ans.parse_variants('{"variants":["a","a","q"," b "]}', "q", 2) == (["a", "b"], None) and ans.parse_variants("[]", "q", 1)[1]


def test_metrics(spark):
    judged = spark.createDataFrame([("q", "chunk", "a", 3.0), ("q", "chunk", "b", 0.0), ("q", "chunk", "c", 1.0), ("big", "chunk", "a", 1024.0), ("tiny", "chunk", "a", 1e-20), ("none", "chunk", "a", 0.0)], "query_id string, target string, target_id string, grade double")
    ranked = spark.createDataFrame([("q", ["b", "a", "a", "", "c"]), ("big", ["a"]), ("tiny", ["x", "a"]), ("none", ["a"]), ("unjudged", ["a"]), ("q2", [])], "query_id string, ranked array<string>")
    rows = {(m["query_id"], m["k"]): m for m in ev.metrics(ranked, judged, [1, 2, 10]).collect()}
    q = rows["q", 10]
    gain = lambda g, i: (2**g - 1) / math.log2(i + 2)
    assert q["precision"] == pytest.approx(0.2) and q["recall"] == 1.0 and q["mrr"] == 0.5
    assert q["ndcg"] == pytest.approx((gain(3, 1) + gain(1, 2)) / (gain(3, 0) + gain(1, 1)))
    assert rows["q", 1]["hit_rate"] == 0.0 and rows["big", 1]["ndcg"] == 1.0 and rows["tiny", 2]["ndcg"] == pytest.approx(1 / math.log2(3))
    assert rows["none", 1]["recall"] == 0.0 and ("unjudged", 1) not in rows
    report = {m["k"]: m for m in ev.report(ev.metrics(ranked, judged, [1, 2]), [1, 2], 6).collect()}
    assert report[1]["evaluated"] == 4 and report[1]["skipped"] == 2
    empty = ev.report(ev.metrics(ranked.limit(0), judged, [3]), [3]).first()
    assert empty["k"] == 3 and empty["evaluated"] == 0
    for bad in ([0], [1, 1]):
        with pytest.raises(ContractError):
            ev.metrics(ranked, judged, bad)


def test_statistics(spark):
    rows = [("a0", "a", 0, 0, 100), ("a1", "a", 1, 100, 200), ("a2", "a", 2, 199, 300), ("a3", "a", 3, 301, 1500), ("b0", "b", 0, 0, 50)]
    chunks = spark.createDataFrame([(i, d, o, s, e, "x" * (e - s)) for i, d, o, s, e in rows], "id string, document_id string, ordinal int, byte_start int, byte_end int, text string")
    got = {m["id"]: m for m in statistics.measured(chunks, statistics.Options(1200)).collect()}
    assert got["a1"]["signals"] == ["short", "no-overlap", "heading-cut"] and got["a2"]["overlap_bytes"] == 1 and got["a3"]["signals"] == ["at-limit", "no-overlap"] and got["b0"]["signals"] == ["short"]
    bars = statistics.histogram(statistics.overlaps(chunks)).orderBy("bucket").collect()
    assert [b["n"] for b in bars] == [1, 3, 0, 0, 0, 0, 0, 1] and sum(b["share"] for b in bars) == pytest.approx(100)
    summary = {x["signal"]: (x["chunks"], x["documents"]) for x in statistics.signal_summary(statistics.measured(chunks, statistics.Options(1200))).collect()}
    assert summary == {"at-limit": (1, 1), "short": (4, 2), "no-overlap": (2, 1), "heading-cut": (1, 1), "furniture": (0, 0)}
    ten = spark.createDataFrame([("x" * (100 * i),) for i in range(1, 11)], "text string").select(F.char_length("text").alias("runes"))
    assert {p["percentile"]: p["runes"] for p in statistics.percentiles(ten).collect()} == {25: 300, 50: 500, 75: 800, 95: 1000}
    found = spark.createDataFrame([("603-555-0101 x 603-555-0102 603.555.0103 603 555 0104",), (" Login ",), ("stock_status: instock",), ("603-555-0101",)], "text string").select(statistics.furniture(F.col("text")).alias("f")).collect()
    assert [x["f"] and (x["f"]["pattern"], x["f"]["matches"]) for x in found] == [("address directory", 4), ("navigation", 1), ("product data", 1), None]


def test_errors_usage_and_retries(spark):
    rows = [("status=503", None, "transient"), ("EOF", 404, "fatal"), ("x", 429, "transient"), ("context canceled: EOF", None, "fatal"), ("no", None, "fatal"), (None, None, "fatal")]
    got = spark.createDataFrame([(m, s) for m, s, _ in rows], "m string, s int").select(generation.error_class(F.col("m"), F.col("s")).alias("c")).collect()
    assert [x["c"] for x in got] == [c for _, _, c in rows]
    usage = generation.total_usage(spark.createDataFrame([(None, 1), (None, 2)], "input_tokens long, output_tokens long")).first()
    assert usage["input_tokens"] is None and usage["output_tokens"] == 3
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("timed out")
        return "ok"

    assert generation.with_retries(flaky)() == "ok" and len(calls) == 3
    with pytest.raises(RuntimeError):
        generation.with_retries(lambda: (_ for _ in ()).throw(RuntimeError("bad key")))()


def test_extractive(spark):
    rows = {x["query_id"]: x for x in generation.extractive(evidence(spark, " one ", "two", "three"), asked(spark, "what", "nothing"), 2).collect()}
    assert rows["q0"]["answer"] == "[c0] one\n\n[c1] two" and rows["q0"]["citations"] == ["c0", "c1"] and rows["q0"]["output_tokens"] == len(rows["q0"]["answer"]) // 4
    assert rows["q1"]["finish_reason"] == "abstain" and rows["q1"]["citations"] == []


def test_cache(spark, tmp_path):
    made = []

    def work(df):
        made.append(1)
        return df.select("key", F.upper("text").alias("big"))

    rows = spark.createDataFrame([("1", "a"), ("2", "a"), ("3", "b")], "id string, text string")
    key = caching.generation_key("s", "1", "m", "p")
    out, first = caching.cached(rows, key, work, ["big"], str(tmp_path / "c"))
    assert {x["id"]: x["big"] for x in out.collect()} == {"1": "A", "2": "A", "3": "B"} and first == {"rows": 3, "hits": 0, "misses": 3, "writes": 2}
    _, second = caching.cached(rows, key, work, ["big"], str(tmp_path / "c"))
    assert second == {"rows": 3, "hits": 3, "misses": 0, "writes": 0}


def test_cache_waves_budget_and_retries(spark, tmp_path):
    rows = spark.createDataFrame([(str(i), f"t{i % 7}") for i in range(20)], "id string, text string")
    key, path, calls = caching.generation_key("s", "1", "m", "p"), str(tmp_path / "c"), []

    def work(df):
        calls.append(1)
        if len(calls) == 4:  # the first call only tells the schema
            raise ValueError("status=503")
        return df.select("key", F.upper("text").alias("big"))

    with pytest.raises(ContractError, match="budget"):
        caching.cached(rows, key, work, ["big"], path, budget=6)
    calls.clear()
    with pytest.raises(ValueError):
        caching.cached(rows, key, work, ["big"], path, waves=4)
    kept = spark.read.parquet(path).count()
    assert 0 < kept < 7  # waves that were written before the failure stay
    out, report = caching.cached(rows, key, work, ["big"], path, waves=4, attempts=2)
    assert report["writes"] == 7 - kept and {r["id"]: r["big"] for r in out.collect()} == {str(i): f"T{i % 7}" for i in range(20)}


def test_cached_generation_and_flow(spark, tmp_path):
    asked_ = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "bb")], "prompt string, input string")
    call = lambda df: df.withColumns({"output": F.upper("input"), "input_tokens": F.length("input").cast("long")})
    made = [caching.cached_generate(asked_, call, m, str(tmp_path / "g"), v) for m, v in (("m", "1"), ("m", "1"), ("n", "1"), ("m", "2"))]
    assert [x[1]["writes"] for x in made] == [2, 0, 2, 2] and [x[1]["usage"]["input_tokens"] for x in made] == [3, None, 3, 3]
    assert made[0][0].columns == ["prompt", "input", "output"] and made[0][1]["usage"]["output_tokens"] is None
    with pytest.raises(ContractError):
        caching.cached_generate(asked_, call, "m", str(tmp_path / "g"), " ")
    steps = [generation.Step("a", call, "m", "p", "1"), generation.Step("b", lambda df: df.withColumn("output", F.concat("input", F.lit("!"))), "m", "p", "1")]
    out, reports = generation.flow(asked_.select("input"), steps, str(tmp_path / "f"))
    assert sorted(r["output"] for r in out.collect()) == ["A!", "A!", "BB!"] and [x["writes"] for x in reports.values()] == [2, 2]
    with pytest.raises(ContractError):
        generation.flow(asked_, steps[:1] * 2, str(tmp_path / "f"))


def test_counts_of_signals(spark):
    rows = spark.createDataFrame([("d", ["short", "furniture"]), ("d", ["short"]), ("e", ["short"]), ("e", [])], "document_id string, signals array<string>")
    assert (statistics.count(rows, "short"), statistics.document_count(rows, "short"), statistics.count(rows, "no-overlap")) == (3, 2, 0)
    assert {(r["document_id"], r["signal"]): r["n"] for r in statistics.count_by_document(rows).collect()} == {("d", "short"): 2, ("d", "furniture"): 1, ("e", "short"): 1}
    with pytest.raises(ContractError):
        statistics.count(rows, "other")


def test_cached_rerank_and_observed_calls(spark, tmp_path):
    queries, calls = asked(spark, "red oak leaf"), tmp_path / "calls"
    candidates = evidence(spark, "pine", "oak leaf", "red oak leaf leaf")

    def score(q, texts):
        with calls.open("a") as f:
            f.write("x")
        return [len(x) for x in texts]

    for n in (0, 1):
        out, report = caching.cached_rerank(candidates, queries, score, "m", 2, str(tmp_path / "c"))
        assert [x["chunk_id"] for x in out.orderBy("rank").collect()] == ["c2", "c1"] and report["hits"] == n
    notes = []
    requests = spark.createDataFrame([("p", "secret")], "prompt string, input string")
    out = generation.observed(lambda df: generation.generate(df, lambda p, x: [y.upper() for y in x]), notes.append)(requests)
    assert out.first()["output"] == "SECRET" and [x["status"] for x in notes] == ["started", "completed"] and "secret" not in str(notes)
    with pytest.raises(ZeroDivisionError):
        generation.observed(lambda df: 1 / 0, notes.append, disclose=True)(requests)
    assert notes[-1]["status"] == "failed" and notes[-1]["inputs"] == ["secret"]


def test_a_call_that_fails_in_its_tasks_is_noted_as_failed(spark):
    notes = []

    def broken(prompts, inputs):
        raise RuntimeError("no model")

    requests = spark.createDataFrame([("p", "x")], "prompt string, input string")
    with pytest.raises(Exception):
        generation.observed(lambda df: generation.generate(df, broken), notes.append)(requests)
    assert [x["status"] for x in notes] == ["started", "failed"]


def test_augmented_and_prepared_problems(spark):
    good = evidence(spark, "one", "two")
    chunks = chunk_table(spark, c0="one", c1="two")
    assert ans.augmented_problems(good, chunks).count() == 0
    bad = good.withColumn("text", F.when(F.col("rank") == 1, "changed").otherwise(F.col("text"))).withColumn("chunk_id", F.when(F.col("rank") == 2, "zz").otherwise(F.col("chunk_id"))).withColumn("rank", F.lit(1))
    assert {x["problem"] for x in ans.augmented_problems(bad, chunks).collect()} == {"unknown chunk", "text differs", "repeated rank"}
    config = ans.Config(evidence_k=2, maximum_context_runes=10)
    prepared = ans.prepare(good, config, "ordinal")
    assert ans.prepared_problems(prepared, config, "ordinal").count() == 0
    assert {x["problem"] for x in ans.prepared_problems(prepared, ans.Config(evidence_k=1, maximum_context_runes=3)).collect()} == {"too many texts", "too many code points", "label of another style"}


def test_violations(spark):
    text = "añb"
    docs = spark.createDataFrame([("d", text, hashlib.sha256(text.encode()).hexdigest()), ("d", text, "bad"), ("", "x", "")], "id string, text string, content_digest string")
    assert {(p["key"], p["problem"]) for p in val.document_problems(docs).collect()} == {("d", "digest differs"), ("d", "repeated id"), ("", "empty id"), ("", "empty digest")}
    good = docs.limit(1)
    chunks = chunking.Fixed(2).chunk(good)
    assert val.corpus_problems(good, chunks).count() == 0
    broken = chunks.withColumn("byte_end", F.col("byte_end") + F.when(F.col("ordinal") == 0, 1).otherwise(0)).withColumn("document_id", F.when(F.col("ordinal") == 1, "zz").otherwise("d"))
    assert {p["problem"] for p in val.chunk_problems(broken, good).collect()} == {"length differs", "not an exact slice", "unknown document"}
    judged = spark.createDataFrame([("q", "chunk", "a", 1.0), ("q", "document", "b", -1.0), ("q", "chunk", "a", 1.0), ("z", "planet", "", float("nan"))], "query_id string, target string, target_id string, grade double")
    problems = {p["problem"] for p in val.judgment_problems(judged, spark.createDataFrame([("q",)], "id string")).collect()}
    assert problems == {"mixed targets", "bad grade", "repeated", "unknown target", "empty target id", "unknown query"}
    with pytest.raises(ContractError):
        val.require(val.document_problems(docs), "documents")
