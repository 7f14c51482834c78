"""Index bundles: immutable, content-addressed folders of Parquet tables with a manifest.

A bundle's tables are written to a folder beside its place and read back; what was written is checked, counted
and digested, gets its manifest, and is published by one rename. A plan that gives other rows each time it is
run is so evaluated once, and manifest and files always agree. A bundle of equal content has an equal id
and is verified and reused. Counts and digests are grouped aggregates over the tables.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import embedding
from lodestack.operators import validation as val
from lodestack.operators.common import STORED, ContractError, require, saved, tidy
from lodestack.sources.corpus import Tree, table_digest, table_tree

VERSION = 1
KEYS = {"documents": ("id",), "chunks": ("id",), "representations": ("id",), "vectors": ("representation_id",)}


@dataclass(frozen=True)
class BuildInput:
    documents: DataFrame
    chunks: DataFrame
    representations: DataFrame
    chunker: str
    vectors: DataFrame | None = None
    model: str = ""
    dimensions: int = 0


@dataclass
class Bundle:
    path: str
    manifest: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.tables[name]
        except KeyError:
            raise AttributeError(name) from None


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of the cluster's own file API."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = hadoop_path(spark, path)
    return fs.exists(at)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """Written under another name and renamed, so that a reader sees all of it or nothing."""
    fs, part = hadoop_path(spark, path + ".part")
    out = fs.create(part, True)
    out.write(json.dumps(value, indent=2, sort_keys=True).encode())
    out.close()
    if not fs.rename(part, hadoop_path(spark, path)[1]):
        raise ContractError(f"{path} exists")


def read_json(spark: SparkSession, path: str) -> dict:
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0])


def check_input(x: BuildInput) -> None:
    if not x.chunker:
        raise ContractError("a chunker name is required")
    if (x.vectors is None) != (not x.model) or bool(x.model) != (x.dimensions > 0):
        raise ContractError("vectors, model and dimensions go together")
    for found in (val.document_problems(x.documents), *val.chunk_checks(x.chunks, x.documents)):
        require(found, "corpus")
    require(val.representation_problems(x.representations, x.chunks), "representations")
    if x.vectors is not None:
        require(embedding.vector_problems(x.vectors, x.representations), "vectors")


def _trees(tables: dict[str, DataFrame]) -> dict[str, Tree]:
    """Rows and digests of tables, one pass for each."""
    return {name: table_tree(df, *KEYS[name]) for name, df in tables.items()}


def bundle_id(identity: dict) -> str:
    return "bundle-" + hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def _identity(content: dict, kinds: list[str], chunker: str, model: str, dimensions: int) -> dict:
    return {"version": VERSION, "content": content, "kinds": kinds, "chunker": chunker, "model": model, "dimensions": dimensions}


def kinds_of(representations: DataFrame) -> list[str]:
    return [r[0] for r in representations.select("kind").distinct().orderBy("kind").collect()]


def build(x: BuildInput, root: str, stage: Callable[[str], None] | None = None) -> Bundle:
    """Validate, write and publish; an identical bundle that exists is verified and returned."""
    note = stage or (lambda _: None)
    spark = x.documents.sparkSession
    part = f"{root.rstrip('/')}/building-{uuid.uuid4().hex}"
    with tidy(spark):
        try:
            note("write")
            written = replace(x, **{name: saved(df, f"{part}/{name}", **STORED) for name, df in _given(x).items()})
            return _published(written, part, root, note)
        finally:
            remove(spark, part)


def _given(x: BuildInput) -> dict[str, DataFrame]:
    given = {"documents": x.documents, "chunks": x.chunks, "representations": x.representations}
    return given if x.vectors is None else given | {"vectors": x.vectors}


def _published(x: BuildInput, part: str, root: str, note: Callable[[str], None], finish: Callable[[], None] = lambda: None) -> Bundle:
    """Check and digest tables that lie under part, and give that folder its place; finish: called before anything of it is changed."""
    spark = x.documents.sparkSession
    note("validate")
    check_input(x)
    note("digest")
    trees, kinds = _trees(_given(x)), kinds_of(x.representations)
    content = {name: {"rows": tree.rows, "digest": tree.root} for name, tree in trees.items()}
    if x.vectors is not None and content["vectors"]["rows"] != content["representations"]["rows"]:
        raise ContractError("each representation needs one vector")
    identity = _identity(content, kinds, x.chunker, x.model, x.dimensions)
    key = bundle_id(identity)
    path = f"{root.rstrip('/')}/{key}"
    if exists(spark, f"{path}/manifest.json"):
        note("reuse")
        return verify(spark, path)
    note("publish")
    finish()
    write_json(spark, f"{part}/leaves.json", {name: tree.leaves for name, tree in trees.items()})
    write_json(spark, f"{part}/manifest.json", {"id": key, **identity})
    remove(spark, path)  # what is there without a manifest is no bundle
    publish(spark, part, path)
    return open_bundle(spark, path, check=False)


def publish(spark: SparkSession, part: str, path: str) -> None:
    """Give a finished folder its place, by one rename."""
    fs, at = hadoop_path(spark, part)
    if fs.exists(hadoop_path(spark, path)[1]) or not fs.rename(at, hadoop_path(spark, path)[1]):
        raise ContractError(f"{path} cannot be published")


def remove(spark: SparkSession, path: str) -> None:
    fs, at = hadoop_path(spark, path)
    if fs.exists(at):
        fs.delete(at, True)


def load_manifest(spark: SparkSession, path: str) -> dict:
    m = read_json(spark, f"{path}/manifest.json")
    if m.get("version") != VERSION:
        raise ContractError("unknown manifest version")
    if m.get("id") != bundle_id({k: v for k, v in m.items() if k != "id"}):
        raise ContractError("the manifest's id does not match its content")
    if any(c["rows"] < 1 for c in m["content"].values()):
        raise ContractError("a table is empty")
    return m


def open_bundle(spark: SparkSession, path: str, model: str | None = None, check: bool = True) -> Bundle:
    """Table handles of a bundle; model: the embedder that queries will use, None for lexical search only."""
    if check:
        verify(spark, path)
    m = load_manifest(spark, path)
    if model is not None and model != m["model"]:
        raise ContractError(f"the bundle was embedded by {m['model']!r}, not {model!r}")
    return Bundle(path, m, {name: spark.read.parquet(f"{path}/{name}") for name in m["content"]})


def verify(spark: SparkSession, path: str, stage: Callable[[str], None] | None = None) -> Bundle:
    """Every table against the manifest and the contracts; the first difference is an error."""
    note = stage or (lambda _: None)
    with tidy(spark):
        return _verified(spark, path, note)


def _verified(spark: SparkSession, path: str, note: Callable[[str], None]) -> Bundle:
    note("manifest")
    m = load_manifest(spark, path)
    found = Bundle(path, m, {name: spark.read.parquet(f"{path}/{name}") for name in m["content"]})
    leaves = read_json(spark, f"{path}/leaves.json")
    for name, df in found.tables.items():
        note(name)
        want, seen = Tree(m["content"][name]["rows"], leaves.get(name, {})), table_tree(df, *KEYS[name])
        if want.root != m["content"][name]["digest"]:
            raise ContractError(f"{name}: the leaves are not those of the manifest")
        if seen.rows != want.rows:
            raise ContractError(f"{name}: the number of rows differs")
        if seen.root != want.root:
            raise ContractError(f"{name}: the content differs in leaves {', '.join(want.differing(seen)[:5])}")
    note("contracts")
    require(val.corpus_problems(found.documents, found.chunks), "corpus")
    require(val.representation_problems(found.representations, found.chunks), "representations")
    if kinds_of(found.representations) != m["kinds"]:
        raise ContractError("kinds differ")
    if "vectors" in found.tables:
        require(embedding.vector_problems(found.vectors, found.representations), "vectors")
    return found


def inspect(spark: SparkSession, path: str, corpus: DataFrame | None = None) -> dict:
    """Manifest and per-document chunk counts, read without texts of the bundle's documents, and whether the source corpus
    (the bundle's own documents where none is given) is still the one that it was built from: matches, differs or absent.

    A corpus that differs still names documents; without one the names are ids.
    """
    m = load_manifest(spark, path)
    chunks = spark.read.parquet(f"{path}/chunks")
    if corpus is None and exists(spark, f"{path}/documents"):
        corpus = spark.read.parquet(f"{path}/documents")
    state = "absent" if corpus is None else "matches" if table_digest(corpus, "id") == m["content"]["documents"]["digest"] else "differs"
    rows = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))
    named = rows.withColumn("name", F.col("document_id"))
    if corpus is not None:
        titles = corpus.select(F.col("id").alias("document_id"), F.nullif("title", F.lit("")).alias("title"))
        named = rows.join(titles, "document_id", "left").select(*rows.columns, F.coalesce("title", "document_id").alias("name"))
    return {"manifest": m, "chunks": named, "corpus": state}


def vector_entries(found: Bundle, model: str | None = None) -> DataFrame:
    """Stored vectors in order of representation, of one model where it is named."""
    rows = found.vectors if model is None else found.vectors.where(F.col("model") == model)
    return rows.orderBy("representation_id")


def build_staged(spark: SparkSession, root: str, out: str, chunker: str, stage: Callable[[str], None] | None = None, model: str = "", dimensions: int = 0) -> Bundle:
    """Publish what streaming ingestion, or a Stager, has staged under root; with vectors where a model is named."""
    from lodestack.streaming.ingest import staged

    tables = [staged(spark, root, name) for name in ("documents", "chunks", "representations")]
    vectors = staged(spark, root, "vectors") if model else None
    return build(BuildInput(*tables, chunker, vectors, model, dimensions), out, stage)


def publish_staged(spark: SparkSession, root: str, out: str, chunker: str, stage: Callable[[str], None] | None = None, model: str = "", dimensions: int = 0) -> Bundle:
    """The folder of a Stager becomes the bundle, by one rename: its tables are checked and digested where they lie and not
    written again, so that it takes no second copy. Nothing can be added afterwards.

    The stage stays as it was if it breaks a contract, and as a copy if a bundle of equal content is there already. root and out
    are on one file system.
    """
    from lodestack.streaming.ingest import staged

    root = root.rstrip("/")
    fs, at = hadoop_path(spark, root)
    names = ("documents", "chunks", "representations", "vectors")[: 4 if model else 3]
    own = ("manifest.json", "manifest.json.part", "leaves.json", "leaves.json.part")  # of an attempt that was ended
    held = [x.getPath().getName() for x in fs.listStatus(at)]
    if missing := [x for x in names if x not in held]:
        raise ContractError(f"the stage has no {', '.join(missing)}")
    if more := [x for x in held if x not in (*names, *own) and not x.startswith("part-")]:
        raise ContractError(f"the stage also holds {', '.join(sorted(more))}")

    def clean() -> None:
        for x in held:
            if x not in names:
                remove(spark, f"{root}/{x}")

    def finish() -> None:
        clean()
        for name in names:
            _flattened(spark, f"{root}/{name}")
        fs.mkdirs(hadoop_path(spark, out)[1])

    tables = {name: staged(spark, root, name) for name in names}
    x = BuildInput(tables["documents"], tables["chunks"], tables["representations"], chunker, tables.get("vectors"), model, dimensions)
    with tidy(spark):
        try:
            return _published(x, root, out, stage or (lambda _: None), finish)
        except BaseException:
            for name in own:
                remove(spark, f"{root}/{name}")
            raise


def _flattened(spark: SparkSession, folder: str) -> None:
    """Files of batches and pieces become files of the table; after each move all of it can still be read."""
    fs, top = hadoop_path(spark, folder)
    listed, files = fs.listFiles(top, True), []
    while listed.hasNext():
        files.append(listed.next().getPath())
    for at in files:
        if at.getName().endswith(".parquet") and at.getParent().getName() != top.getName():
            if not fs.rename(at, hadoop_path(spark, f"{folder}/{at.getName()}")[1]):
                raise ContractError(f"{at} cannot be moved")
    for x in fs.listStatus(top):
        if x.isDirectory():
            fs.delete(x.getPath(), True)


def load_verified_documents(spark: SparkSession, path: str, corpus_root: str, name: str) -> DataFrame:
    """The corpus file that a bundle was built from: inside the given root, of equal count and digest."""
    from lodestack.sources.corpus import contained_path, load_documents

    docs = load_documents(spark, str(contained_path(corpus_root, name)))
    want, seen = load_manifest(spark, path)["content"]["documents"], table_tree(docs, *KEYS["documents"])
    if seen.rows != want["rows"] or seen.root != want["digest"]:
        raise ContractError("the corpus is not the one that the bundle was built from")
    return docs


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a folder."""
    fs, at = hadoop_path(spark, path)
    return fs.getContentSummary(at).getLength()


def preflight(spark: SparkSession, path: str) -> None:
    """Whether a folder can be written, before a long build."""
    fs, probe = hadoop_path(spark, f"{path.rstrip('/')}/.probe-{uuid.uuid4().hex}")
    fs.create(probe, True).close()
    fs.delete(probe, False)
