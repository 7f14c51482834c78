"""Search bundles: a bundle's tables, its lexical index and its vector index under one manifest.

The tables are a content-addressed bundle (`bundle`), whose documents and chunks are the content store as well. Indexes are
made of what was written there, beside it. The manifest binds them: the bundle's id, the content's identity, the indexes'
settings and digests, and the digest of the representations that each index holds. Its id is made of the
bundle's id and the settings: equal content under equal settings is built once.

Verification goes from what is given to what is made of it: content, representations, lexical index, vector index. The first
part that differs from the manifest, or from the part that it was made of, is an error that names it.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from lodestack.operators import cells, lexical, postings, retrieval, vector_search
from lodestack.operators.common import ContractError
from lodestack.sources import bundle
from lodestack.sources.content import VERSION as CONTENT_VERSION
from lodestack.sources.content import Content, Identity
from lodestack.sources.corpus import table_tree

VERSION = 1


@dataclass(frozen=True)
class Settings:
    """k1 and b of the lexical index; parts, cells (0: by size) and recall of the vector index."""

    k1: float = 1.2
    b: float = 0.75
    parts: int = 16
    cells: int = 0
    recall: float = 0.95


@dataclass
class SearchBundle:
    path: str
    manifest: dict
    tables: bundle.Bundle
    content: Content
    postings: postings.Postings
    cells: cells.Cells | None

    def search_text(self, queries: DataFrame, k: int, kinds: list[str] | None = None) -> DataFrame:
        return postings.search_postings(self.postings, queries, k, kinds=kinds)

    def search_vectors(self, queries: DataFrame, k: int, model: str, **options) -> DataFrame:
        if self.cells is None:
            raise ContractError("the bundle has no vectors")
        return cells.search_cells(self.cells, queries, k, model, **options)

    def hydrate(self, hits: DataFrame) -> DataFrame:
        return retrieval.hydrate(retrieval.from_hits(hits), self.content.chunks)


def bundle_id(tables: str, settings: Settings) -> str:
    return "search-" + hashlib.sha256(json.dumps([VERSION, tables, asdict(settings)], sort_keys=True, separators=(",", ":")).encode()).hexdigest()[:32]


def _held(rows: DataFrame, name: str) -> str:
    """A digest of the representations that a table holds, each as often as it does."""
    return table_tree(rows.select(rows[name].alias("id")), "id").root


def _content(tables: bundle.Bundle) -> Content:
    docs, chunks = (tables.manifest["content"][name] for name in ("documents", "chunks"))
    return Content(tables.path, Identity(docs["digest"], chunks["digest"], docs["rows"], chunks["rows"]), tables.documents, tables.chunks)


def build_search(x: bundle.BuildInput, root: str, settings: Settings = Settings(), stage: Callable[[str], None] | None = None) -> SearchBundle:
    """Build and publish; a search bundle of equal content and settings that exists is verified and returned."""
    note, root = stage or (lambda _: None), root.rstrip("/")
    spark = x.documents.sparkSession
    tables = bundle.build(x, f"{root}/tables", stage)
    key = bundle_id(tables.manifest["id"], settings)
    path, part = f"{root}/{key}", f"{root}/building-{uuid.uuid4().hex}"
    if bundle.exists(spark, f"{path}/manifest.json"):
        note("reuse")
        return verify_search(spark, path, stage)
    try:
        note("lexical")
        words = postings.build_postings(lexical.lexical_records(tables.representations, tables.chunks), f"{part}/lexical", config=lexical.BM25Config(settings.k1, settings.b))
        manifest = {
            "version": VERSION,
            "id": key,
            "tables": tables.manifest["id"],
            "settings": asdict(settings),
            "content": {"version": CONTENT_VERSION, "id": _content(tables).identity.id},
            "held": _held(tables.representations, "id"),
            "lexical": words.manifest,
        }
        if x.vectors is not None:
            note("vectors")
            entries = vector_search.entries(tables.vectors, tables.representations, tables.chunks)
            manifest["vectors"] = cells.build_cells(entries, f"{part}/vectors", x.model, settings.parts, settings.cells, settings.recall).manifest
        note("publish")
        bundle.write_json(spark, f"{part}/manifest.json", manifest)
        bundle.remove(spark, path)  # what is there without a manifest is no bundle
        bundle.publish(spark, part, path)
    finally:
        bundle.remove(spark, part)
    return open_search(spark, path)


def open_search(spark: SparkSession, path: str, model: str | None = None) -> SearchBundle:
    """Handles of all parts, from manifests only; model: the embedder that queries will use, None for lexical search only."""
    path = path.rstrip("/")
    m = bundle.read_json(spark, f"{path}/manifest.json")
    if m.get("version") != VERSION:
        raise ContractError("unknown manifest version")
    if m.get("id") != bundle_id(m["tables"], Settings(**m["settings"])):
        raise ContractError("the manifest's id does not match its content")
    tables = bundle.open_bundle(spark, f"{path.rpartition('/')[0]}/tables/{m['tables']}", model, check=False)
    content = _content(tables)
    if content.identity.id != m["content"]["id"]:
        raise ContractError("content: the store is not the one of the manifest")
    words = postings.open_postings(spark, f"{path}/lexical")
    if words.manifest != m["lexical"]:
        raise ContractError("lexical: the index is not the one of the manifest")
    found = None
    if bool(tables.manifest["model"]) != ("vectors" in m):
        raise ContractError("vectors: the tables and the manifest do not agree")
    if "vectors" in m:
        found = cells.open_cells(spark, f"{path}/vectors", tables.manifest["model"], tables.manifest["dimensions"])
        if found.manifest != m["vectors"]:
            raise ContractError("vectors: the index is not the one of the manifest")
    return SearchBundle(path, m, tables, content, words, found)


def verify_search(spark: SparkSession, path: str, stage: Callable[[str], None] | None = None) -> SearchBundle:
    """Every part against the manifest and against the part that it was made of."""
    note = stage or (lambda _: None)
    found = open_search(spark, path)
    bundle.verify(spark, found.tables.path, stage)
    held = _held(found.tables.representations, "id")
    if held != found.manifest["held"]:
        raise ContractError("representations: they are not those of the manifest")
    note("lexical")
    try:
        words = postings.open_postings(spark, f"{found.path}/lexical", check=True)
    except ContractError as error:
        raise ContractError(f"lexical: {error}") from error
    if _held(words.rows, "representation_id") != held:
        raise ContractError("lexical: the index holds other representations")
    if found.cells is not None:
        note("vectors")
        try:
            cells.open_cells(spark, f"{found.path}/vectors", found.cells.manifest["model"], check=True)
        except ContractError as error:
            raise ContractError(f"vectors: {error}") from error
        if _held(found.cells.rows, "representation_id") != held:
            raise ContractError("vectors: the index holds other representations")
    return found
