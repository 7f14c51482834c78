"""Queries with SQL against DuckDB, and all queries' columns on the small tables."""

import os

import pytest

from lodestack.llm import queries as q

SF = os.environ.get("CATALOG_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

CONTRACT = {
    "op1": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op2": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op3": {"doc_id", "n_shingles", "component_id", "kept"},
    "op4": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op5": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"},
    "op6": {"page_id", "host", "path", "rule", "verdict"},
    "op7": {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
    "op8": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9": {"doc_id", "held_out", "score", "predicted"},
    "op10": {"doc_id", "weight", "probability", "sampled"},
    "op11": {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"},
    "op12": {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"},
    "op13": {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"},
}


def test_one_query_for_each_operator():
    assert sorted(k.split("_")[0] for k in q.queries()) == sorted(CONTRACT)


@pytest.mark.parametrize("name", sorted(q.queries()))
def test_columns_and_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    df = q.queries()[name](spark, SF)
    assert CONTRACT[name.split("_")[0]] <= set(df.columns)
    rows = df.collect()
    table = {"op6": "pages", "op11": "embeddings"}.get(name.split("_")[0], "documents")
    of = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert len(rows) >= of if name.startswith("op7") else len(rows) == of
    if name in q.oracle_sql():
        db = duckdb.connect()
        for t in ("documents", "pages", "embeddings"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = db.execute(q.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(want.fetchall(), key=str) == sorted((tuple(r[c] for c in columns) for r in rows), key=str)
