"""Representations: searchable texts that stand for chunks.

Chunks are evidence, representations retrieval material. Builders are joins and expressions; texts that a
model writes come from a generator (see operators.generation) through the same identity rule.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack import schemas as s
from lodestack.functions import text as t
from lodestack.operators.chunking import heading_paths
from lodestack.operators.common import ContractError, require, saved, scratch

COLUMNS = ("id", "chunk_id", "kind", "text", "content_digest", "model", "prompt_digest")
GROUP_SIZE = 12
LEAD_RUNES = 500


def _none() -> Column:
    return F.lit(None).cast("string")


def raw(chunks: DataFrame) -> DataFrame:
    """One representation for each chunk: its own text."""
    return chunks.select(
        t.raw_representation_id(F.col("id"), F.col("content_digest")).alias("id"),
        F.col("id").alias("chunk_id"),
        F.lit(s.KIND_RAW).alias("kind"),
        "text",
        "content_digest",
        _none().alias("model"),
        _none().alias("prompt_digest"),
    )


def derived(chunks: DataFrame, kind: str, text: Column, model: str | None = None, prompt_digest: str | None = None) -> DataFrame:
    """A representation of another kind for each chunk whose text is not blank."""
    if kind == s.KIND_RAW:
        raise ContractError("raw representations are the chunks' own texts")
    made = chunks.select(F.col("id").alias("chunk_id"), F.col("content_digest").alias("chunk_digest"), t.trimmed(text).alias("text")).where("text <> ''")
    return _named(made, kind, model, prompt_digest)


def _named(made: DataFrame, kind: str, model: str | None = None, prompt_digest: str | None = None) -> DataFrame:
    """made: chunk_id, chunk_digest, text."""
    m, p = (F.lit(x).cast("string") for x in (model, prompt_digest))
    key = t.derived_representation_id(F.col("chunk_id"), F.col("chunk_digest"), F.lit(kind), t.digest("text"), m, p)
    return made.select(key.alias("id"), "chunk_id", F.lit(kind).alias("kind"), "text", t.digest("text").alias("content_digest"), m.alias("model"), p.alias("prompt_digest"))


def lead_summaries(chunks: DataFrame, most: int = 300) -> DataFrame:
    """Lead sentences as summaries: deterministic and free."""
    return derived(chunks, s.KIND_SUMMARY, t.lead_sentence("text", most))


def exploded(chunks: DataFrame, kind: str, lines: Column, model: str | None = None, prompt_digest: str | None = None) -> DataFrame:
    """Several representations a chunk, one for each distinct line."""
    made = chunks.select(F.col("id").alias("chunk_id"), F.col("content_digest").alias("chunk_digest"), F.explode(t.unique_lines(lines)).alias("text"))
    return _named(made, kind, model, prompt_digest)


def compose(*sets: DataFrame) -> DataFrame:
    """Representations of several sets; of equal ids the earliest set's stays."""
    if not sets:
        raise ContractError("nothing to compose")
    tagged = [x.select(*COLUMNS).withColumn("set_no", F.lit(n)) for n, x in enumerate(sets)]
    whole = tagged[0]
    for x in tagged[1:]:
        whole = whole.unionByName(x)
    first = F.min_by(F.struct(*COLUMNS), F.struct("set_no", "chunk_id", "text"))
    return whole.groupBy(F.col("id").alias("key")).agg(first.alias("r")).select("r.*")


def ensure_raw(representations: DataFrame, chunks: DataFrame) -> DataFrame:
    """representations, with a raw one for each chunk that has none."""
    have = representations.where(F.col("kind") == s.KIND_RAW).select(F.col("chunk_id").alias("id"))
    return representations.select(*COLUMNS).unionByName(raw(chunks.join(have, "id", "left_anti")))


def with_heading_path(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """chunks with path: the headings that govern them. A document meets all its chunks in one row and is read once."""
    names = chunks.columns

    @F.pandas_udf("array<string>")
    def paths(text: pd.Series, title: pd.Series, starts: pd.Series) -> pd.Series:
        return pd.Series([heading_paths(x, y, list(z)) for x, y, z in zip(text, title, starts, strict=True)])

    docs = documents.select(F.col("id").alias("document_id"), F.col("text").alias("__text"), F.col("title").alias("__title"))
    listed = chunks.groupBy("document_id").agg(F.collect_list(F.struct(*names)).alias("c")).join(docs, "document_id")
    placed = listed.select("c", paths("__text", "__title", "c.byte_start").alias("p"))
    return placed.select(F.explode(F.arrays_zip("c", "p")).alias("x")).select("x.c.*", F.col("x.p").alias("path"))


def breadcrumbs(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Heading path, line end, chunk text."""
    return derived(with_heading_path(chunks, documents), s.KIND_BREADCRUMB, F.concat("path", F.lit("\n"), "text"))


def best_parents(small: DataFrame, parents: DataFrame, width: int | None = None) -> DataFrame:
    """small with parent_id: the parent chunk of most shared bytes, ties by position and id; null if none.

    Parents are dealt into buckets of bytes and joined on document and bucket, so a long document does
    not pair all of its small chunks with all of its parents.
    """
    width = width or 4096
    start = lambda c: F.floor(F.col(c) / width)
    buckets = lambda: F.explode(F.sequence(start("byte_start"), F.floor((F.col("byte_end") - 1) / width)))
    left = small.where("byte_end > byte_start").select("document_id", F.col("id").alias("small_id"), "byte_start", "byte_end", buckets().alias("bucket"))
    right = parents.where("byte_end > byte_start").select("document_id", F.struct("ordinal", "byte_start", "byte_end", "id").alias("p"), buckets().alias("bucket"))
    shared = F.least("byte_end", F.col("p.byte_end")) - F.greatest("byte_start", F.col("p.byte_start"))
    pairs = left.join(right, ["document_id", "bucket"]).withColumn("shared", shared).where("shared > 0")
    best = pairs.groupBy("small_id").agg(F.min(F.struct(-F.col("shared"), "p")).alias("m")).select(F.col("small_id").alias("id"), F.col("m.p.id").alias("parent_id"))
    return small.join(best, "id", "left")


def small_to_big(small: DataFrame, parents: DataFrame) -> DataFrame:
    """Small chunks' texts, indexed under the parents they hydrate to."""
    found = best_parents(small, parents)
    require(found.where("parent_id is null").select("id", "document_id", "byte_start", "byte_end"), "small chunks without a parent")
    return small_to_big_plan(found, parents)


def small_to_big_plan(found: DataFrame, parents: DataFrame) -> DataFrame:
    digests = parents.select(F.col("id").alias("parent_id"), F.col("content_digest").alias("chunk_digest"))
    made = found.select("parent_id", "text").join(digests, "parent_id").select(F.col("parent_id").alias("chunk_id"), "chunk_digest", "text")
    return _named(made, s.KIND_SMALL).dropDuplicates(["id"])


def first_chunks(chunks: DataFrame) -> DataFrame:
    """The first chunk of each document by (ordinal, start, end, id): what document summaries hydrate to."""
    return chunks.groupBy("document_id").agg(F.min(F.struct("ordinal", "byte_start", "byte_end", "id")).alias("m")).select("document_id", F.col("m.id").alias("chunk_id"), F.col("m.ordinal").alias("ordinal"))


def document_summaries(documents: DataFrame, chunks: DataFrame, summary: Column, model: str | None = None, prompt_digest: str | None = None) -> DataFrame:
    """One representation a document, hung on its first chunk; summary is an expression over documents."""
    texts = documents.select(F.col("id").alias("document_id"), t.collapse_line(summary).alias("text")).where("text <> ''")
    made = first_chunks(chunks).join(chunks.select(F.col("id").alias("chunk_id"), F.col("content_digest").alias("chunk_digest")), "chunk_id").join(texts, "document_id")
    return _named(made.select("chunk_id", "chunk_digest", "text"), s.KIND_DOCUMENT_SUMMARY, model, prompt_digest)


def grouped(chunks: DataFrame, size: int = GROUP_SIZE) -> DataFrame:
    """chunks with group_no and place in the group (from 1): runs of at most size of one document."""
    w = Window.partitionBy("document_id").orderBy("ordinal", "id")
    at = F.row_number().over(w) - 1
    return chunks.withColumns({"group_no": F.floor(at / size).cast("int"), "place": (at % size + 1).cast("int")})


def contextual_input(title: Column, path: Column, document_text: Column, chunk_text: Column, n: int = LEAD_RUNES) -> Column:
    return F.concat(F.lit("Document title: "), F.coalesce(title, F.lit("")), F.lit("\nSection path: "), path, F.lit("\nDocument lead:\n"), t.lead(document_text, n), F.lit("\n\nChunk:\n"), chunk_text)


def group_inputs(chunks: DataFrame, documents: DataFrame, size: int = GROUP_SIZE, with_lead: bool = False, n: int = LEAD_RUNES) -> DataFrame:
    """One prompt input for each group: document_id, group_no, n_chunks, chunk_ids, input."""
    placed = grouped(with_heading_path(chunks, documents), size)
    entry = F.struct("place", "id", F.concat(F.lit("\n["), F.col("place").cast("string"), F.lit("] Section: "), "path", F.lit("\n"), "text", F.lit("\n")).alias("part"))
    groups = placed.groupBy("document_id", "group_no").agg(F.array_sort(F.collect_list(entry)).alias("e"))
    docs = documents.select(F.col("id").alias("document_id"), F.coalesce("title", F.lit("")).alias("title"), F.col("text").alias("whole"))
    lead = F.concat(F.lit("Document lead:\n"), t.lead("whole", n), F.lit("\n")) if with_lead else F.lit("")
    text = F.concat(F.lit("Document title: "), "title", F.lit("\n"), lead, F.array_join("e.part", ""))
    return groups.join(docs, "document_id").select("document_id", "group_no", F.size("e").alias("n_chunks"), F.col("e.id").alias("chunk_ids"), text.alias("input"))


def parse_numbered(response: str, n: int) -> dict[int, str]:
    """Texts by number from the first JSON array in a response that holds any; prose around it is ignored."""
    decoder, out = json.JSONDecoder(), {}
    text = response.strip()
    for found in re.finditer(r"\[", text):
        try:
            entries, _ = decoder.raw_decode(text, found.start())
        except ValueError:
            continue
        rows = entries if isinstance(entries, list) and all(isinstance(e, dict) for e in entries) else []
        for e in rows:
            number, value = e.get("chunk", 0), e.get("text", "")
            if isinstance(number, int) and isinstance(value, str) and 1 <= number <= n and value.strip():
                out.setdefault(number, value.strip())
        if out:
            break
    return out


@F.pandas_udf(T.MapType(T.IntegerType(), T.StringType()))
def numbered_texts(response: pd.Series, n: pd.Series) -> pd.Series:
    """parse_numbered of each response."""
    return pd.Series([parse_numbered(r or "", int(k)) for r, k in zip(response, n, strict=True)])


def call_ceiling(chunks: int) -> int:
    """Most generator calls of a grouped build: a group may miss every chunk, and each is then repaired."""
    return 2 * chunks


@dataclass(frozen=True)
class Prompts:
    """Prompts are part of a representation's identity, as are how a call is put together and what context it gets."""

    adapter_version: str = "1"
    context_policy: str = "title-path-lead"
    contextual: str = "Situate the chunk within its document in one or two sentences."
    summary: str = "Summarise the text in one or two sentences."
    questions: str = "Write up to three questions that the text answers, one a line."
    entities: str = "List the entities and terms that the text is about, one a line."
    statement: str = "State the text's claims as one short statement."
    keywords: str = "List the text's key phrases on one line."
    document_summary: str = "Summarise the document in a short paragraph."
    cut_points: str = "Name where the document's topic changes by quoting the first words of each part."
    group_rule: str = 'The input holds numbered chunks. Do this for each and answer with one JSON array of {"chunk": number, "text": string}.'

    def text(self, name: str, grouped: bool = False) -> str:
        """A prompt by name, as it is put for one text or for a group of chunks."""
        one = getattr(self, name)
        return f"{one} {self.group_rule}" if grouped else one

    def digest(self, name: str, grouped: bool = False) -> str:
        whole = "\x00".join([self.adapter_version, self.context_policy, self.text(name, grouped)])
        return hashlib.sha256(whole.encode()).hexdigest()


Generate = Callable[[DataFrame], DataFrame]  # adds column output to rows with column input


def generated(
    chunks: DataFrame, documents: DataFrame, kind: str, generate: Generate, model: str, prompt: str, prompt_digest: str, group_size: int = 1, answers: str | None = None
) -> DataFrame:
    """Model-written representations: in groups first, then each chunk that a group left out on its own.

    generate takes rows with (prompt, input) and returns them with output. It is run once for each group and
    once for each missing chunk: what it says is written under the folder `answers` (a new one by default) before
    it is read, so that the chunks that a group answered and those it left out are told from the same answers.
    Kinds questions and entities give a representation a line, others one a chunk; contextual ones are
    followed by the chunk.
    """
    spark = chunks.sparkSession
    answers = answers or scratch(spark, "answers")
    paths = with_heading_path(chunks, documents).join(documents.select(F.col("id").alias("document_id"), "title", F.col("text").alias("whole")), "document_id")
    missing, parts = paths, []
    if group_size > 1:
        inputs = group_inputs(chunks, documents, group_size, with_lead=kind == s.KIND_CONTEXTUAL).withColumn("prompt", F.lit(prompt))
        answered = saved(generate(inputs).select("chunk_ids", "n_chunks", "output"), f"{answers}/groups")
        texts = answered.select(F.posexplode("chunk_ids").alias("pos", "id"), numbered_texts(F.col("output"), F.col("n_chunks")).alias("texts"))
        found = texts.select("id", F.try_element_at("texts", F.col("pos") + 1).alias("output")).where("output is not null")
        parts.append(found)
        missing = paths.join(found, "id", "left_anti")
    single = missing.withColumns({"prompt": F.lit(prompt), "input": contextual_input(F.col("title"), F.col("path"), F.col("whole"), F.col("text")) if kind == s.KIND_CONTEXTUAL else F.col("text")})
    parts.append(saved(generate(single.select("id", "prompt", "input")).select("id", "output"), f"{answers}/chunks"))
    outputs = parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]
    whole = chunks.join(outputs, "id")
    if kind == s.KIND_QUESTION:
        return exploded(whole, kind, t.question_lines("output"), model, prompt_digest)
    if kind == s.KIND_ENTITIES:
        return exploded(whole, kind, F.split("output", "\\n"), model, prompt_digest)
    line = t.collapse_line("output")
    body = F.concat(line, F.lit("\n"), "text") if kind == s.KIND_CONTEXTUAL else line
    return derived(whole.where(line != ""), kind, body, model, prompt_digest)


def hydrate(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks; an unknown chunk is an error."""
    named = chunks.select(F.col("id").alias("chunk_id"), "text", "content_digest", "ordinal", "byte_start", "byte_end")
    joined = hits.join(named, "chunk_id", "left")
    checked = F.when(F.col("content_digest").isNull(), F.raise_error(F.concat(F.lit("unknown chunk "), F.col("chunk_id")))).otherwise(F.col("content_digest"))
    return joined.withColumn("content_digest", checked)
