"""The stored vector index: recall, exactness with all cells, pruned folders, identity, ties, hot cells and changed content."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.operators import cells, vector_search
from lodestack.operators.common import ContractError

ENTRY = "representation_id string, chunk_id string, document_id string, values array<float>"


def clustered(n=6000, dims=32, centers=60, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(centers, dims))
    return (middle[rng.integers(0, centers, n)] + 0.35 * rng.normal(size=(n, dims))).astype(np.float32)


def entries(spark, m):
    return spark.createDataFrame([(f"r{i:05d}", f"c{i:05d}", f"d{i % 50:02d}", x.tolist()) for i, x in enumerate(m)], ENTRY)


def hits(df):
    return sorted((r["query_id"], r["rank"], r["representation_id"], round(r["score"], 6)) for r in df.collect())


@pytest.fixture(scope="module")
def table(spark):
    m = clustered()
    m[3000:5000] = m[17]  # a cell that a third of the rows is in
    return entries(spark, m).cache()


@pytest.fixture(scope="module")
def asked(spark, table):
    return table.where("representation_id like '%00'").select(F.col("representation_id").alias("query_id"), "values")


@pytest.fixture(scope="module")
def index(spark, table, tmp_path_factory):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables too are dealt over tasks
    yield cells.build_cells(table, f"file://{tmp_path_factory.mktemp('cells')}/index", "m")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_recall_and_share(spark, table, asked, index):
    want = {h[:3:2] for h in hits(vector_search.exact(table.where("representation_id < 'r03000' or representation_id >= 'r05000'"), asked, 10)) if not "r03000" <= h[0] < "r05000"}
    got = {h[:3:2] for h in hits(cells.search_cells(index, asked, 10, "m"))}
    few = {h for h in got if not "r03000" <= h[1] < "r05000"}
    assert len(want & few) / len(want) >= 0.9
    assert index.manifest["probes"] <= 0.15 * index.manifest["cells"]


def test_all_cells_and_a_long_list_are_exact(spark, table, asked, index):
    got = cells.search_cells(index, asked, 10, "m", probes=10_000, shortlist=6000)
    assert hits(got) == hits(vector_search.exact(table, asked, 10))


def test_codes_stand_for_their_vectors(index):
    rows = index.rows.limit(500).collect()
    unit = vector_search._unit(np.array([r["values"] for r in rows]))
    codes = np.array([list(r["codes"]) for r in rows])
    back = index.centers[[r["cell"] for r in rows]] + np.concatenate([index.books[p][codes[:, p]] for p in range(codes.shape[1])], axis=1)
    assert codes.shape[1] == index.manifest["parts"] and ((unit - back) ** 2).sum(axis=1).mean() < 0.05


def test_only_probed_folders_are_read(spark, index):
    one = index.rows.where(F.col("cell").isin([3])).select("representation_id", "codes")
    plan = one._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "values" not in plan.split("ReadSchema")[1]
    assert {p.split("cell=")[1].split("/")[0] for p in one.inputFiles()} >= {"3"}
    files = index.rows.select("cell", F.input_file_name().alias("file")).distinct().groupBy("cell").count()
    assert files.agg(F.max("count")).first()[0] > 1  # the hot cell lies in several files


def test_identity_and_bad_input(spark, table, asked, index, tmp_path):
    for bad in (lambda: cells.open_cells(spark, index.path, "other"), lambda: cells.open_cells(spark, index.path, "m", 31), lambda: cells.search_cells(index, asked, 10, "other"), lambda: cells.build_cells(table, index.path, "m")):
        with pytest.raises(ContractError):
            bad()
    short = asked.limit(1).withColumn("values", F.slice("values", 1, 5))
    with pytest.raises(ContractError, match="another length"):
        cells.search_cells(index, short, 10, "m")
    mixed = table.limit(3).withColumn("values", F.when(F.col("representation_id") == "r00001", F.slice("values", 1, 16)).otherwise(F.col("values")))
    with pytest.raises(ContractError, match="one length"):
        cells.build_cells(mixed, f"file://{tmp_path}/mixed", "m")
    assert np.allclose(cells.open_cells(spark, index.path, "m", 32, check=True).centers, index.centers)


def test_zero_vectors_empty_tables_and_changed_rows(spark, tmp_path):
    m = np.zeros((5, 16), dtype=np.float32)
    m[1:3, 0] = 1
    small = cells.build_cells(entries(spark, m), f"file://{tmp_path}/small", "m")
    asked = spark.createDataFrame([("q", m[1].tolist()), ("zero", m[0].tolist())], "query_id string, values array<float>")
    assert hits(cells.search_cells(small, asked, 3, "m", probes=99)) == hits(vector_search.exact(entries(spark, m), asked, 3))
    assert cells.search_cells(small, asked.limit(0), 3, "m").count() == 0
    empty = cells.build_cells(entries(spark, m).limit(0), f"file://{tmp_path}/empty", "m")
    assert empty.rows.count() == 0
    small.rows.limit(1).write.mode("append").partitionBy("cell").parquet(f"{small.path}/rows")
    with pytest.raises(ContractError, match="digest"):
        cells.open_cells(spark, small.path, "m", check=True)
