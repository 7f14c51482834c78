"""The inverted index against scoring every row: ties, fields, kinds, blocks that bounds leave out, stored content."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestack.operators import lexical, postings
from lodestack.operators.common import ContractError

RECORD = "representation_id string, chunk_id string, document_id string, kind string, title string, text string"


def corpus(spark, n=900, seed=1):
    rng = random.Random(seed)
    common, rare = [f"w{i}" for i in range(30)], [f"x{i}" for i in range(400)]
    rows = []
    for i in range(n):
        body = rng.choices(common, k=rng.randrange(0, 40)) + rng.choices(rare, k=rng.randrange(0, 5))
        rows.append((f"r{i:04d}", f"c{i % 700:04d}", f"d{i % 97:03d}", rng.choice(["raw", "summary", None]), " ".join(rng.choices(common, k=2)), " ".join(body)))
    rows += [(f"t{i:02d}", "c", f"d{i % 3}", "raw", "same title", "tied words here") for i in range(40)]
    rows += [("e0", "c", "d", "raw", None, None), ("e1", "c", "d", "raw", "", ""), ("e2", "c", "d", "raw", "long", "long " * 20_000 + "w1")]
    return spark.createDataFrame(rows, RECORD)


def asked(spark):
    texts = ["w1 w2 x3", "x7 x8 x9 w0", "tied words", "w1 w1 w5", "zzz", "", "x11", "here long", " ".join(f"w{i}" for i in range(30))]
    return spark.createDataFrame([(f"q{i}", x) for i, x in enumerate(texts)], "query_id string, text string")


def rows(df):
    return sorted((r["query_id"], r["rank"], r["representation_id"], round(r["score"], 8)) for r in df.collect())


@pytest.fixture(scope="module")
def records(spark):
    return corpus(spark).repartition(3, "representation_id").cache()


@pytest.fixture(scope="module")
def index(spark, records, tmp_path_factory):
    return postings.build_postings(records, f"file://{tmp_path_factory.mktemp('postings')}/index")


@pytest.mark.parametrize("k", [1, 10, 60, 500])
def test_equals_the_scan(spark, records, index, k):
    assert rows(postings.search_postings(index, asked(spark), k)) == rows(lexical.search(records, asked(spark), k))


def test_kinds(spark, records, index):
    got = postings.search_postings(index, asked(spark), 10, kinds=["summary"])
    assert rows(got) == rows(lexical.search(records, asked(spark), 10, keep=F.col("kind") == "summary"))


def test_fields_and_configuration(spark, records, tmp_path):
    fields = {"title": F.col("title"), "text": F.col("text")}
    index = postings.build_postings(records, f"file://{tmp_path}/two", fields, lexical.BM25Config(0.4, 0.9))
    for boosts in ({"title": 2.0, "text": 1.0}, {"title": 1.0}, {"title": 0.0, "text": 3.0}):
        want = lexical.search_index(lexical.analysed(records, fields), asked(spark), 10, boosts, lexical.BM25Config(0.4, 0.9))
        assert rows(postings.search_postings(index, asked(spark), 10, boosts)) == rows(want)
    with pytest.raises(ContractError, match="does not hold"):
        postings.search_postings(index, asked(spark), 10, {"body": 1.0})


@pytest.mark.parametrize("rows_of_a_batch", [10_000, 100])
def test_bounds_leave_blocks_out(spark, tmp_path, rows_of_a_batch):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows_of_a_batch)
    try:
        _left_out(spark, tmp_path)
    finally:
        spark.conf.set(key, before)


def _left_out(spark, tmp_path):
    # three terms that every row holds once, and a few rows that hold them often
    filler = [f"f{i}" for i in range(50)]
    rng = random.Random(4)
    made = [(f"r{i:05d}", "c", "d", None, None, " ".join(["alpha", "beta", "gamma"] * (8 if i % 1000 == 7 else 1) + rng.choices(filler, k=20))) for i in range(12_000)]
    records = spark.createDataFrame(made, RECORD)
    index = postings.build_postings(records, f"file://{tmp_path}/skip")
    queries = spark.createDataFrame([("q", "alpha beta gamma"), ("one", "alpha")], "query_id string, text string")
    read = {r["query_id"]: (r["blocks"], r["read"]) for r in postings.blocks_read(index, queries, 10).collect()}
    assert 3 * 12_000 // 64 <= read["q"][0] <= 3 * (12_000 // 64 + 10)
    assert read["q"][1] <= read["q"][0] / 10 and read["one"][1] <= read["one"][0] / 10
    assert sum(index.manifest["postings"].values()) > 12_000 * 15
    assert rows(postings.search_postings(index, queries, 10)) == rows(lexical.search(records, queries, 10))


def test_shards_are_not_cut_by_batches():
    bits = postings.SHARD_BITS
    rows = np.concatenate([np.arange(0, 20_000), np.arange(1 << 33, (1 << 33) + 9000)])
    batches = [pa.RecordBatch.from_arrays([pa.array(part)], ["row"]) for part in np.array_split(rows, 13)]
    got = [np.asarray(b.column(0)) for b in postings._whole_shards(iter(batches))]
    assert np.concatenate(got).tolist() == rows.tolist()
    seen = [w for b in got for w in np.unique(b >> bits).tolist()]
    assert len(seen) == len(set(seen))


def test_many_queries_go_in_blocks(spark, records, index, monkeypatch):
    want = rows(postings.search_postings(index, asked(spark), 5))
    monkeypatch.setattr(postings, "QUERY_BLOCK", 2)
    assert rows(postings.search_postings(index, asked(spark), 5)) == want


def test_only_the_terms_slots_are_read(spark, index):
    blocks = index.blocks.where(F.col("slot").isin([r[0] for r in spark.createDataFrame([("x7",)], "term string").select(postings.slot_of(F.col("term"))).collect()]))
    plan = blocks._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(slot" in plan or "PartitionFilters: [(slot" in plan


def test_empty_index_and_changed_content(spark, records, tmp_path):
    empty = postings.build_postings(records.limit(0), f"file://{tmp_path}/none")
    assert postings.search_postings(empty, asked(spark), 5).count() == 0
    path = f"file://{tmp_path}/some"
    made = postings.build_postings(records.limit(50), path)
    with pytest.raises(ContractError, match="holds an index"):
        postings.build_postings(records, path)
    assert postings.open_postings(spark, path, check=True).manifest == made.manifest
    spark.read.schema(postings.STORED).parquet(f"{path}/blocks").limit(1).write.mode("append").partitionBy("slot").parquet(f"{path}/blocks")
    with pytest.raises(ContractError, match="blocks of the index differ"):
        postings.open_postings(spark, path, check=True)
