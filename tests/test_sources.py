"""Files, bundles, code sources, streaming and the catalogue."""

import hashlib
import json
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.operators import chunking, code_chunks, embedding
from lodestack.operators import representations as rep
from lodestack.operators import validation as val
from lodestack.operators.common import ContractError, saved
from lodestack.sources import bundle, content, corpus, git_sources
from lodestack.streaming import ingest

TEXT = "# Oak\nOak trees have lobed leaves."


def doc(i="doc-oak", text=TEXT, **more):
    return {"id": i, "source_uri": "u", "title": "Oak", "text": text, "content_digest": hashlib.sha256(text.encode()).hexdigest(), **more}


def write(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value))
    return str(path)


def test_load_documents(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "x")]))
    assert docs.count() == 2 and docs.select("metadata").first()[0] is not None
    for bad in ([], [doc(), doc()], [doc(surprise=1)], [doc(content_digest="x")]):
        with pytest.raises(ContractError):
            corpus.load_documents(spark, write(tmp_path / "bad.json", bad))


def test_load_evaluation(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc()]))
    value = {"id": "e", "corpus_digest": corpus.table_digest(docs, "id"), "queries": [{"id": "q", "text": "t"}], "judgments": [{"query_id": "q", "target": "document", "target_id": "doc-oak", "grade": 2}]}
    queries, judgments, digest = corpus.load_evaluation(spark, write(tmp_path / "e.json", value))
    assert queries.count() == 1 and judgments.first()["grade"] == 2.0
    corpus.check_corpus(docs, digest)
    corpus.check_corpus(docs, "")
    with pytest.raises(ContractError):
        corpus.check_corpus(docs.withColumn("title", F.lit("other")), digest)
    unknown = {**value, "judgments": [{"query_id": "zz", "target": "document", "target_id": "d", "grade": 1}]}
    for bad in (unknown, {**value, "queries": []}):
        with pytest.raises(ContractError):
            corpus.load_evaluation(spark, write(tmp_path / "bad.json", bad))


def test_strict_values_and_paths(tmp_path):
    assert corpus.decode_strict('{"a": 1}', {"a": int}) == {"a": 1}
    for bad in ('{"b": 1}', '{"a": "x"}', '{"a": 1} 2'):
        with pytest.raises(ContractError):
            corpus.decode_strict(bad, {"a": int})
    (tmp_path / "link").symlink_to("/")
    with pytest.raises(ContractError):
        corpus.contained_path(str(tmp_path), "link/etc")
    assert corpus.contained_path(str(tmp_path), "x/../y").name == "y"


def build_input(spark, docs, dims=0):
    chunks = chunking.Markdown(1200, 120).chunk(docs)
    reps = rep.compose(rep.raw(chunks), rep.breadcrumbs(chunks, docs))
    vectors = embedding.hash_embed(reps, dims).select(F.col("id").alias("representation_id"), "values", F.lit(f"hash-{dims}").alias("model")) if dims else None
    return bundle.BuildInput(docs, chunks, reps, "markdown-1200-120", vectors, f"hash-{dims}" if dims else "", dims)


def test_bundle_is_built_reused_and_verified(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "# B\nother text")]))
    stages = []
    one = bundle.build(build_input(spark, docs, 16), str(tmp_path / "out"), stages.append)
    two = bundle.build(build_input(spark, docs.repartition(3), 16), str(tmp_path / "out"), stages.append)
    assert one.manifest["id"] == two.manifest["id"] and stages[-1] == "reuse"
    assert bundle.open_bundle(spark, one.path, "hash-16").vectors.count() == one.representations.count()
    with pytest.raises(ContractError):
        bundle.open_bundle(spark, one.path, "other")
    assert bundle.build(build_input(spark, docs), str(tmp_path / "out")).manifest["id"] != one.manifest["id"]
    seen = bundle.inspect(spark, one.path, docs)
    assert seen["corpus"] == "matches" and {r["name"] for r in seen["chunks"].collect()} == {"Oak"}
    assert bundle.inspect(spark, one.path)["corpus"] == "matches" and bundle.inspect(spark, one.path, docs.limit(1))["corpus"] == "differs"
    keys = [r["representation_id"] for r in bundle.vector_entries(one, "hash-16").collect()]
    assert keys == sorted(keys) and len(keys) == one.vectors.count() and bundle.vector_entries(one, "other").count() == 0
    one.chunks.withColumn("text", F.concat("text", F.lit("!"))).write.parquet(str(tmp_path / "tampered"))
    import shutil

    shutil.rmtree(f"{one.path}/chunks")
    shutil.copytree(tmp_path / "tampered", f"{one.path}/chunks")
    with pytest.raises(ContractError):
        bundle.verify(spark, one.path)


def test_a_plan_that_differs_each_time_is_evaluated_once(spark, tmp_path):
    """Texts of a random generator: manifest, files and contracts agree, and nothing is left beside the bundle."""
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "second text")]))
    chunks = chunking.Fixed(10).chunk(docs)
    reps = rep.compose(rep.raw(chunks), rep.derived(chunks, "summary", F.concat(F.lit("random "), F.uuid()), "m", "p"))
    made = bundle.build(bundle.BuildInput(docs, chunks, reps, "fixed-10-0"), str(tmp_path / "out"))
    assert bundle.verify(spark, made.path).representations.count() == 2 * chunks.count()
    assert [x.name for x in (tmp_path / "out").iterdir()] == [made.manifest["id"]]
    with pytest.raises(ContractError):
        bundle.build(bundle.BuildInput(docs, chunks.withColumn("byte_end", F.lit(99)), reps, "fixed-10-0"), str(tmp_path / "out"))
    assert [x.name for x in (tmp_path / "out").iterdir()] == [made.manifest["id"]]


def test_content_store(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "second text")]))
    chunks = chunking.Fixed(10).chunk(docs)
    store = content.build_content(docs, chunks, str(tmp_path / "store"))
    again = content.build_content(docs.repartition(3), chunks, str(tmp_path / "other"))
    assert store.identity == again.identity and content.open_content(spark, store.path, again.identity.id, check=True).chunks.count() == chunks.count()
    some = chunks.limit(2).select("id")
    assert {r["id"] for r in store.lookup(some.union(some)).collect()} == {r["id"] for r in some.collect()}
    for bad in (lambda: content.build_content(docs, chunks, store.path), lambda: content.open_content(spark, store.path, "content-0"), lambda: content.build_content(docs, chunks.limit(0), str(tmp_path / "e"))):
        with pytest.raises(ContractError):
            bad()
    with pytest.raises(Exception, match="unknown chunk"):
        store.lookup(spark.createDataFrame([("zz",)], "id string")).collect()


def test_stager_keeps_the_order_of_phases_and_lineage(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "second text")]))
    chunks = chunking.Fixed(10).chunk(docs)
    reps = rep.raw(chunks)
    vectors = embedding.hash_embed(reps, 8).select(F.col("id").alias("representation_id"), "values", F.lit("hash-8").alias("model"))
    stager = ingest.Stager(spark, str(tmp_path / "stage"), 100)
    fails = lambda f, x: pytest.raises(ContractError, f, x)
    fails(stager.add_chunks, chunks)
    stager.add_documents(docs.where("id = 'b'"))
    fails(stager.add_documents, docs)  # one of them is there already
    stager.add_documents(docs.where("id <> 'b'"))
    fails(stager.add_chunks, chunks.withColumn("document_id", F.lit("zz")))
    fails(stager.add_chunks, chunks.limit(0))
    stager.add_chunks(chunks)
    fails(stager.add_documents, docs.withColumn("id", F.concat("id", F.lit("2"))))
    fails(stager.add_vectors, vectors)
    stager.add_representations(reps)
    fails(stager.add_vectors, vectors.withColumn("representation_id", F.lit("zz")))
    stager.add_vectors(vectors)
    made = bundle.build_staged(spark, str(tmp_path / "stage"), str(tmp_path / "out"), "fixed-10-0", model="hash-8", dimensions=8)
    assert made.vectors.count() == made.representations.count() == chunks.count()


def test_stager_deals_large_phases_into_pieces(spark, tmp_path):
    """Any number of rows is one batch: what was an error beyond batch_size is dealt into pieces by key."""
    texts = [f"Document {i} has a text of its own. " * 3 for i in range(1000)]
    docs = spark.createDataFrame([(f"d{i}", "u", "", x, hashlib.sha256(x.encode()).hexdigest(), {}) for i, x in enumerate(texts)], "id string, source_uri string, title string, text string, content_digest string, metadata map<string,string>")
    chunks, root = chunking.Fixed(40).chunk(docs), str(tmp_path / "stage")
    stager = ingest.Stager(spark, root, 100)
    stager.add_documents(docs)
    stager.add_chunks(chunks)
    stager.add_representations(rep.raw(chunks))
    held = spark.read.parquet(f"{root}/documents").groupBy("piece").count().collect()
    assert len(held) == 10 and sum(r["count"] for r in held) == 1000 and max(r["count"] for r in held) < 200
    assert not [p.name for p in (tmp_path / "stage").iterdir() if p.name.startswith(("part-", "given-"))]
    other = ingest.Stager(spark, str(tmp_path / "again"), 100)
    other.add_documents(docs)
    with pytest.raises(ContractError, match="staged already"):
        other.add_documents(docs.where("id = 'd7'"))
    made = bundle.build_staged(spark, root, str(tmp_path / "out"), "fixed-40-0")
    assert made.documents.count() == 1000 and made.chunks.count() == chunks.count()


def test_a_stage_becomes_the_bundle_without_a_copy(spark, tmp_path):
    """Files of the bundle are those that were staged, also in several pieces; what breaks a contract stays staged."""
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(f"d{i}", f"{i} has a text of its own, and more") for i in range(40)]))
    chunks, root, out = chunking.Fixed(10).chunk(docs), tmp_path / "stage", str(tmp_path / "out")

    def filled(at):
        stager = ingest.Stager(spark, str(at), 10)
        stager.add_documents(docs)
        for half in (0, 1):
            stager.add_chunks(chunks.where(F.col("ordinal") % 2 == half))
        with pytest.raises(ContractError, match="no representations"):
            bundle.publish_staged(spark, str(at), out, "fixed-10-0")
        stager.add_representations(rep.raw(chunks))
        return {p.name: p.stat().st_size for p in at.rglob("*.parquet")}

    files = filled(root)
    assert len({p.parent.name for p in (root / "documents").rglob("*.parquet")}) == 4 and all(x.endswith(".zstd.parquet") for x in files)
    again = bundle.build_staged(spark, str(root), str(tmp_path / "copied"), "fixed-10-0")
    made = bundle.publish_staged(spark, str(root), out, "fixed-10-0")
    assert not root.exists() and [p.name for p in (tmp_path / "out").iterdir()] == [made.manifest["id"]]
    assert {p.name: p.stat().st_size for p in (tmp_path / "out").rglob("*.parquet")} == files
    assert made.manifest == again.manifest and made.documents.columns == docs.columns and made.chunks.count() == chunks.count()
    assert bundle.verify(spark, made.path).manifest == made.manifest
    filled(tmp_path / "second")
    assert bundle.publish_staged(spark, str(tmp_path / "second"), out, "fixed-10-0").path == made.path and (tmp_path / "second").exists()
    stage = tmp_path / "broken"
    stager = ingest.Stager(spark, str(stage), 10)
    stager.add_documents(docs.where("id <= 'd2'"))
    stager.add_chunks(chunks.where("document_id <= 'd2' and ordinal = 0"))
    stager.add_chunks(chunks.where("document_id <= 'd2' and ordinal = 1").withColumn("ordinal", F.lit(0)))
    stager.add_representations(rep.raw(chunks.where("document_id <= 'd2' and ordinal < 2")))
    before = {str(p): p.stat().st_size for p in stage.rglob("*.parquet")}
    with pytest.raises(ContractError, match="repeated ordinal"):
        bundle.publish_staged(spark, str(stage), out, "fixed-10-0")
    assert {str(p): p.stat().st_size for p in stage.rglob("*.parquet")} == before


def test_checks_move_no_texts_of_chunks(spark):
    """Chunks and representations meet what they are checked against by digests."""
    docs = spark.createDataFrame([("d", "first text", "x", None)], "id string, text string, content_digest string, metadata string")
    chunks = spark.createDataFrame([("c", "d", 0, 0, 5, "first", hashlib.sha256(b"first").hexdigest(), "k")], s.CHUNK_DDL)
    for found, problems in ((val.representation_problems(rep.raw(chunks), chunks), 0), (val.chunk_problems(chunks, docs), 0), (val.chunk_problems(chunks.withColumn("text", F.lit("other")), docs), 2)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "chunk_text" not in plan and "text, text" not in plan
        assert found.count() == problems


def test_chunks_meet_large_tables_in_turns(spark, monkeypatch, tmp_path):
    """All turns together find what one check finds; each moves a part of the documents."""
    docs = spark.createDataFrame([(f"d{i}", f"{i} has a text of its own, and more", "x") for i in range(40)], "id string, text string, content_digest string")
    docs = saved(docs, str(tmp_path / "docs"))
    chunks = chunking.Fixed(10).chunk(docs)
    broken = chunks.withColumn("byte_end", F.col("byte_end") + F.when(F.col("ordinal") == 1, 1).otherwise(0)).withColumn("document_id", F.when(F.col("ordinal") == 2, "zz").when(F.col("ordinal") == 3, None).otherwise(F.col("document_id")))
    rows = lambda found: sorted(map(str, (r for df in found for r in df.collect())))
    whole = val.chunk_checks(broken, docs)
    monkeypatch.setattr(val, "TURN_BYTES", 1)
    turns = val.chunk_checks(broken, docs)
    assert len(whole) == 2 and len(turns) == 1 + val.MOST_TURNS
    assert rows(turns) == rows(whole) == rows([val.chunk_problems(broken, docs)])
    assert sum(df.count() > 0 for df in turns[1:]) == val.MOST_TURNS and not any(rows([df]) for df in val.chunk_checks(chunks, docs))


def test_bundle_input_contracts(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc()]))
    x = build_input(spark, docs, 8)
    for bad in (bundle.BuildInput(x.documents, x.chunks, x.representations, ""), bundle.BuildInput(x.documents, x.chunks, x.representations, "c", x.vectors), bundle.BuildInput(x.documents, x.chunks, x.representations, "c", x.vectors.withColumn("values", F.array(F.lit(float("nan")).cast("float"))), "hash-8", 8)):
        with pytest.raises(ContractError):
            bundle.check_input(bad)


GO = '''// Package oak grows.
package oak

import "fmt"

// Tree is one.
type Tree struct {
	Name string // }
}

const x = "func no() {"

// Grow adds
// rings.
func (t *Tree) Grow(n int) error {
	fmt.Println("}")
	return nil
}

func TestIt() {}
'''


def test_declarations():
    found, problems = code_chunks.declarations(GO, "oak_test.go")
    assert not problems and [(d["kind"], d["name"]) for d in found] == [("package", "oak"), ("type", "Tree"), ("const", "x"), ("method", "Grow"), ("test", "TestIt")]
    grow = found[3]
    assert grow["receiver"] == "*Tree" and grow["signature"] == "func(n int) error" and grow["documentation"] == "Grow adds\nrings." and GO[grow["start"] : grow["end"]].startswith("// Grow adds") and GO[grow["end"] - 1] == "}"
    assert code_chunks.declarations("func {", "a.go")[1]


def test_generated_and_admission(spark):
    assert code_chunks.is_generated("// x\n\n// Code generated by y. DO NOT EDIT.\npackage a") and not code_chunks.is_generated("package a\n// Code generated by y. DO NOT EDIT.")
    assert code_chunks.is_generated("/* a\nb */\n// Code generated z DO NOT EDIT.") and not code_chunks.is_generated("/* a */ x\n// Code generated z DO NOT EDIT.")
    files = spark.createDataFrame([("a/vendor/x.go", "package x"), ("testdata/y.go", "y" * 30), ("z.go", "z" * 60), ("g.go", "// Code generated by y. DO NOT EDIT."), ("ok.go", "package ok")], "path string, text string")
    got = {r["path"]: r["reason"] for r in code_chunks.admit(files, code_chunks.Policy(50, 20)).collect()}
    assert list(got.values()) == ["vendor", "testdata-too-large", "file-too-large", "generated", "admitted"]


def test_git_sources_and_symbols(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    (repo / "go.mod").write_text("module example.com/oak\n")
    (repo / "pkg").mkdir()
    (repo / "pkg/oak.go").write_text(GO)
    for args in (["init", "-q"], ["add", "."], ["-c", "user.name=a", "-c", "user.email=a@b.c", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", str(repo), *args], check=True)
    (repo / "pkg/late.go").write_text("package late")
    docs, admitted = git_sources.load_committed(spark, write(tmp_path / "m.json", [{"name": "oak", "path": str(repo)}]))
    assert admitted.count() == 1 and docs.first()["metadata"]["package_path"] == "example.com/oak/pkg"
    records = code_chunks.extract(docs)
    row = records.where("kind = 'method'").first()
    assert row["qualified_name"] == "example.com/oak/pkg.(*Tree).Grow" and row["text"].encode() == GO.encode()[row["byte_start"] : row["byte_end"]] and row["line_start"] == 13
    lines = code_chunks.symbols(records, "oak").where("text like '%method%'").first()["text"].split("\n")
    assert lines[0] == "Go method example.com/oak/pkg.(*Tree).Grow." and "Signature: func(n int) error." in lines
    assert lines[1] == "Package: example.com/oak/pkg." and code_chunks.symbols(records, "oak").select("id").distinct().count() == records.count()
    assert code_chunks.record_problems(records, docs).count() == 0
    broken = records.withColumns({"line_end": F.lit(0), "kind": F.lit(" ")})
    bare = docs.withColumn("metadata", F.create_map().cast("map<string,string>"))
    assert {r["problem"] for r in code_chunks.record_problems(broken, bare).collect()} == {"no repository, commit or path", "bad lines", "no kind or package"}
    assert code_chunks.fixed_with_lines(docs, 60, 0).select("package_name").distinct().collect()[0][0] == "oak"


def test_streaming_ingest(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "second text")]))
    docs.write.parquet(str(tmp_path / "in"))
    for more in (None, [doc("c", "third")]):
        if more:
            corpus.load_documents(spark, write(tmp_path / "d.json", more)).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), chunking.Fixed(10), str(tmp_path / "stage")).awaitTermination()
    staged = {name: ingest.staged(spark, str(tmp_path / "stage"), name) for name in ingest.STAGES}
    assert {r["id"] for r in staged["documents"].collect()} == {"doc-oak", "b", "c"}
    assert staged["chunks"].count() == staged["representations"].count() == chunking.Fixed(10).chunk(staged["documents"]).count()


def test_stateful_ingestion_equals_the_batch(spark, tmp_path):
    """Three runs with repeats, conflicts and a replay: what is staged is what the first contents alone would give."""
    source, root = tmp_path / "in", str(tmp_path / "stage")
    runs = [
        [("a", "first a"), ("b", "first b"), ("a", "first a")],
        [("b", "other b"), ("c", "first c"), ("b", "first b"), ("d", "one of two"), ("d", "one of 2"), ("d", "one of two")],
        [("a", "first a"), ("b", "first b"), ("c", "later c"), ("c", "later c"), ("e", "first e")],
    ]
    for rows in runs:
        whole = [(i, "u", "", x, hashlib.sha256(x.encode()).hexdigest(), {"k": i}) for i, x in rows]
        spark.createDataFrame(whole, "id string, source_uri string, title string, text string, content_digest string, metadata map<string,string>").write.mode("append").parquet(str(source))
        ingest.ingest_once(spark, str(source), chunking.Fixed(6), root).awaitTermination()
    got = {r["id"]: (r["text"], r["metadata"]) for r in ingest.staged(spark, root, "documents").collect()}
    pair = sorted(("one of two", "one of 2"), key=lambda x: hashlib.sha256(x.encode()).hexdigest())
    first = {"a": "first a", "b": "first b", "c": "first c", "d": pair[0], "e": "first e"}
    assert got == {i: (x, {"k": i}) for i, x in first.items()}
    conflicts = sorted((r["id"], r["text"], r["n"]) for r in ingest.staged(spark, root, "conflicts").collect())
    assert conflicts == sorted([("b", "other b", 1), ("c", "later c", 2), ("d", pair[1], 2 if pair[1] == "one of two" else 1)])
    repeats = {r["id"]: r["n"] for r in ingest.staged(spark, root, "repeats").groupBy("id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
    assert repeats == {"a": 2, "b": 2} | ({"d": 1} if pair[0] == "one of two" else {})
    want = chunking.Fixed(6).chunk(ingest.staged(spark, root, "documents"))
    assert sorted(r["id"] for r in ingest.staged(spark, root, "chunks").collect()) == sorted(r["id"] for r in want.collect())
    # a replayed batch replaces what it wrote
    ingest._stage_outcomes(ingest.staged(spark, root, "documents").where("id = 'e'").selectExpr("*", "'new' AS outcome", "1L AS n"), 2, chunking.Fixed(6), root)
    assert ingest.staged(spark, root, "documents").count() == 5
    made = bundle.build_staged(spark, root, str(tmp_path / "out"), "fixed-6-0")
    assert made.documents.count() == 5
    assert "RocksDB" not in (spark.conf.get("spark.sql.streaming.stateStore.providerClass") or "")


def test_outcomes_are_told_by_plans_and_without_python(spark, tmp_path):
    """A batch against the ids known so far; one that is tried again does not meet what it has staged itself."""
    digest, root = lambda x: hashlib.sha256(x.encode()).hexdigest(), str(tmp_path / "stage")
    table = lambda rows: spark.createDataFrame([(i, "u", "", x, digest(x), {"k": x}) for i, x in rows], s.DOCUMENT_DDL)
    low, high = sorted(("one", "other"), key=digest)
    batches = [table([("a", low)] * 3 + [("a", high)] * 2 + [("b", "b")]), table([("a", high), ("a", low), ("a", "x"), ("b", "b"), ("c", low)])]
    want = [
        {("a", low, "new", 1), ("a", None, "repeat", 2), ("a", high, "conflict", 2), ("b", "b", "new", 1)},
        {("a", high, "conflict", 1), ("a", "x", "conflict", 1), ("a", None, "repeat", 1), ("b", None, "repeat", 1), ("c", low, "new", 1)},
    ]
    for n in (0, 0, 1, 1):
        told = ingest.outcomes(batches[n], ingest.known(spark, root, n))
        plan = told._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan and "BroadcastHashJoin" not in plan.split("Generate")[0]
        rows = told.collect()
        assert {(r["id"], r["text"], r["outcome"], r["n"]) for r in rows} == want[n] and len(rows) == len(want[n])
        assert all(r["metadata"] == (r["text"] and {"k": r["text"]}) for r in rows)
        ingest._stage_outcomes(told, n, chunking.Fixed(10), root)
    staged = {name: ingest.staged(spark, root, name).collect() for name in ("documents", "conflicts", "repeats")}
    assert {(r["id"], r["text"]) for r in staged["documents"]} == {("a", low), ("b", "b"), ("c", low)} and len(staged["documents"]) == 3
    assert sum(r["n"] for r in staged["conflicts"]) == 4 and sum(r["n"] for r in staged["repeats"]) == 4
    nameless = table([("d", "d"), (None, "e")])
    with pytest.raises(ContractError, match="empty id"):
        ingest._stage_outcomes(ingest.outcomes(nameless, ingest.known(spark, root, 2)), 2, chunking.Fixed(10), root)
    assert ingest.staged(spark, root, "documents").count() == 3 and not list((tmp_path / "stage/_arriving").iterdir())


def test_staged_build_and_verified_corpus(spark, tmp_path):
    docs = corpus.load_documents(spark, write(tmp_path / "c.json", [doc(), doc("b", "second text")]))
    docs.write.parquet(str(tmp_path / "in"))
    ingest.ingest(spark, str(tmp_path / "in"), chunking.Fixed(10), str(tmp_path / "stage")).awaitTermination()
    bundle.preflight(spark, str(tmp_path))
    made = bundle.build_staged(spark, str(tmp_path / "stage"), str(tmp_path / "out"), "fixed-10-0")
    assert made.chunks.count() > 2 and bundle.size_of(spark, made.path) > 0
    assert bundle.load_verified_documents(spark, made.path, str(tmp_path), "c.json").count() == 2
    write(tmp_path / "other.json", [doc()])
    for name in ("other.json", "../c.json"):
        with pytest.raises(ContractError):
            bundle.load_verified_documents(spark, made.path, str(tmp_path), name)


def test_entry_works_without_the_optional_part():
    code = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name.startswith(("lodestack.llm", "corpus_pipeline")):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Gone())
import __spark_entry__ as e
assert "bm25_topk" in e.queries() and not any(k.startswith("op") for k in e.queries() if k[2:3].isdigit()) and e.oracle_sql()
"""
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0


def test_library_does_not_import_the_optional_part():
    code = "import sys, lodestack.plans.catalog, lodestack.sources.bundle, lodestack.streaming.ingest; assert not any(m.startswith('lodestack.llm') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/", 2)[0]).returncode == 0


def test_digest_trees(spark):
    rows = spark.createDataFrame([(str(i), i % 7, None if i % 5 == 0 else f"t{i}") for i in range(3000)], "id string, n int, text string")
    sums = corpus.checksum_tree(rows, "id")
    assert sums.rows == 3000 and len(sums.leaves) == 256 and corpus.checksum_tree(rows.repartition(5), "id") == sums
    assert len(sums.differing(corpus.checksum_tree(rows.withColumn("n", F.when(F.col("id") == "7", 9).otherwise(F.col("n"))), "id"))) == 1
    assert corpus.checksum_tree(rows.limit(0), "id") == corpus.Tree(0, {})
    tree = corpus.table_tree(rows, "id")
    assert tree.rows == 3000 and len(tree.leaves) == 256
    assert corpus.table_tree(rows.repartition(7).orderBy(F.desc("id")), "id") == tree
    changed = rows.withColumn("text", F.when(F.col("id") == "1234", "other").otherwise(F.col("text")))
    (leaf,) = tree.differing(corpus.table_tree(changed, "id"))
    assert [r["id"] for r in corpus.leaf_rows(changed, [leaf], "id").exceptAll(corpus.leaf_rows(rows, [leaf], "id")).collect()] == ["1234"]
    twice = corpus.table_tree(rows.unionByName(rows.limit(1)), "id")
    assert twice.rows == 3001 and len(tree.differing(twice)) == 1 and twice.root != tree.root
    assert corpus.table_tree(rows.limit(0), "id") == corpus.Tree(0, {}) and corpus.table_digest(rows.limit(0), "id") == ""
