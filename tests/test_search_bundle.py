"""One manifest for tables, content, lexical and vector index; a change of any part is an error that names it."""

import hashlib
import json
import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from lodestack.operators import chunking, embedding, lexical, vector_search
from lodestack.operators import representations as rep
from lodestack.operators.common import ContractError
from lodestack.sources import bundle, search_bundle

CUT = chunking.Fixed(60, 10)


def given(spark, n=40, vectors=True):
    texts = [f"Document {i} tells of oak {i % 7} and pine {i % 5}, at some length. " * (1 + i % 4) for i in range(n)]
    docs = spark.createDataFrame([(f"d{i}", "u", f"t{i}", x, hashlib.sha256(x.encode()).hexdigest(), {"k": "v"}) for i, x in enumerate(texts)], "id string, source_uri string, title string, text string, content_digest string, metadata map<string,string>")
    chunks = CUT.chunk(docs)
    reps = rep.raw(chunks)
    if not vectors:
        return bundle.BuildInput(docs, chunks, reps, CUT.name)
    made = embedding.hash_embed(reps, 32).select(F.col("id").alias("representation_id"), "values", F.lit("hash-32").alias("model"))
    return bundle.BuildInput(docs, chunks, reps, CUT.name, made, "hash-32", 32)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("search")
    return root, search_bundle.build_search(given(spark), str(root))


def asked(spark):
    return spark.createDataFrame([("q", "oak 3 pine"), ("r", "document 7")], "query_id string, text string")


def test_search_through_the_bundle(spark, built):
    _, found = built
    words = found.search_text(asked(spark), 5)
    want = lexical.search(lexical.lexical_records(found.tables.representations, found.tables.chunks), asked(spark), 5)
    plain = lambda df: sorted((r["query_id"], r["rank"], r["representation_id"], round(r["score"], 8)) for r in df.collect())
    assert plain(words) == plain(want)
    vectors = embedding.hash_embed(asked(spark), 32, key="query_id").select("query_id", "values")
    near = found.search_vectors(vectors, 3, "hash-32", probes=10_000, shortlist=10_000)
    entries = vector_search.entries(found.tables.vectors, found.tables.representations, found.tables.chunks)
    assert [r[:3] for r in plain(near)] == [r[:3] for r in plain(vector_search.exact(entries, vectors, 3))]
    texts = {r["chunk_id"]: r["text"] for r in found.hydrate(words).collect()}
    assert len(texts) >= 5 and all("ocument" in x or "oak" in x or "pine" in x for x in texts.values())
    assert found.content.lookup(found.tables.chunks.select("id").limit(3)).count() == 3
    with pytest.raises(ContractError, match="embedded by"):
        search_bundle.open_search(spark, found.path, "other")


def test_equal_content_is_built_once_and_settings_count(spark, built):
    root, found = built
    seen = []
    again = search_bundle.build_search(given(spark), str(root), stage=seen.append)
    assert again.path == found.path and seen.count("reuse") == 2 and "publish" not in seen and seen[-2:] == ["lexical", "vectors"]
    other = search_bundle.build_search(given(spark), str(root), search_bundle.Settings(k1=0.9))
    assert other.path != found.path and other.tables.path == found.tables.path
    bare = search_bundle.build_search(given(spark, 5, vectors=False), str(root))
    assert bare.cells is None
    with pytest.raises(ContractError, match="no vectors"):
        bare.search_vectors(asked(spark), 1, "hash-32")


def test_a_change_of_any_part_is_named(spark, built, tmp_path):
    root, found = built
    name = found.path.rpartition("/")[2]
    table = found.manifest["tables"]

    def changed(part, change):
        at = tmp_path / part.replace("/", "-")
        shutil.copytree(root, at)
        change(str(at))
        with pytest.raises(ContractError) as error:
            search_bundle.verify_search(spark, str(at / name))
        return str(error.value)

    def doubled(where, by=None):
        def change(at):
            path = f"{at}/{where}"
            row = spark.read.parquet(path).limit(1)
            (row.write.mode("append").partitionBy(by) if by else row.write.mode("append")).parquet(path)

        return change

    def edited(where, key, value):
        def change(at):
            path = Path(at) / where / "manifest.json"
            path.write_text(json.dumps(json.loads(path.read_text()) | {key: value}))
            (path.parent / ".manifest.json.crc").unlink(missing_ok=True)

        return change

    for part in ("documents", "chunks", "representations", "vectors"):
        assert changed(part, doubled(f"tables/{table}/{part}")).startswith(f"{part}: ")
    assert changed("lexical-rows", doubled(f"{name}/lexical/analysed")).startswith("lexical: rows")
    assert changed("lexical-blocks", doubled(f"{name}/lexical/blocks", "slot")).startswith("lexical: blocks")
    assert changed("lexical-terms", doubled(f"{name}/lexical/terms")).startswith("lexical: terms")
    assert changed("cells", doubled(f"{name}/vectors/rows", "cell")).startswith("vectors: ")
    assert changed("quantiser", doubled(f"{name}/vectors/quantiser")).startswith("vectors: ")
    assert changed("lexical-manifest", edited(f"{name}/lexical", "k1", 3.0)).startswith("lexical: ")
    assert changed("vector-manifest", edited(f"{name}/vectors", "probes", 1)).startswith("vectors: ")
    assert "id" in changed("manifest", edited(name, "settings", {"k1": 5.0}))
