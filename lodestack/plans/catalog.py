"""The query catalogue: one entry for each operator, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.functions import vectors as v
from lodestack.operators import answering, calls, cells, chunking, embedding, evaluation, generation, lexical, markers, postings, reranking, retrieval, statistics, validation, vector_search
from lodestack.operators import representations as rep
from lodestack.operators import caching
from lodestack.operators.common import STORED, ContractError, scratch
from lodestack.plans import corpora as c
from lodestack.plans import sql
from lodestack.sources import bundle, content, search_bundle
from lodestack.streaming import ingest

LARGE, SMALL = chunking.Fixed(1200, 120), chunking.Fixed(300, 0)
CUTOFFS = [1, 5, 10]

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: x for k, x in sql.queries().items() if k in _QUERIES}


def large(spark, sf) -> DataFrame:
    return LARGE.chunk(c.documents(spark, sf))


def bm25(spark, sf, k: int) -> DataFrame:
    return lexical.search(c.records(large(spark, sf)), c.queries(spark, sf), k)


def scores(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumn("score", F.round("score", digits))


# text, digests, chunks --------------------------------------------------------------------------
@query
def tokenize_terms(spark, sf):
    docs = c.table(spark, sf, "documents")
    return docs.select("doc_id", F.size(t.terms("text")).cast("long").alias("n_terms"), F.size(t.term_set("text")).cast("long").alias("n_distinct"), F.sha2(F.array_join(t.terms("text"), " "), 256).alias("terms_sha256"))


@query
def content_digest(spark, sf):
    return c.documents(spark, sf).select("id", "content_digest")


@query
def text_shapes(spark, sf):
    docs = c.table(spark, sf, "documents")
    return docs.select("doc_id", t.runes("text").cast("long").alias("runes"), F.octet_length("text").cast("long").alias("bytes"), t.lead("text", 20).alias("lead"), F.sha2(t.collapse_line("text"), 256).alias("collapsed_sha256"))


@query
def fixed_chunks(spark, sf):
    return large(spark, sf).select("id", "document_id", F.col("ordinal").cast("long"), F.col("byte_start").cast("long"), F.col("byte_end").cast("long"), "content_digest")


@query
def range_chunks(spark, sf):
    docs = c.documents(spark, sf)
    ranges = SMALL.chunk(docs).select("document_id", "byte_start", "byte_end")
    return chunking.from_ranges(docs, ranges, "ranges").select("id", "document_id", F.col("ordinal").cast("long"), F.col("byte_start").cast("long"), "content_digest")


@query
def quoted_cuts(spark, sf):
    """A stand-in for a model's answer: 24 characters at every 500th, and a quote of nothing after each third of them."""
    docs = c.documents(spark, sf).where("text is not null")
    steps = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 500).cast("int"))
    quotes = docs.where("text <> ''").select(F.col("id").alias("document_id"), "text", F.explode(steps).alias("i"))
    both = F.array(F.struct((2 * F.col("i")).alias("n"), F.substr("text", 500 * F.col("i") + 1, F.lit(24)).alias("marker")), F.struct((2 * F.col("i") + 1).alias("n"), F.when(F.col("i") % 3 == 2, "~ not a quote ~").alias("marker")))
    asked = quotes.select("document_id", F.inline(both)).where("marker is not null")
    found = markers.align_markers(docs, asked)
    cuts = markers.marker_chunks(docs, found).groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("byte_end").alias("ends"))
    seen = found.groupBy("document_id").agg(F.count("*").alias("quotes"), F.count("match").alias("matched"))
    return seen.join(cuts, "document_id").select("document_id", "quotes", "matched", "chunks", "ends")


def placed(chunks: DataFrame) -> DataFrame:
    return chunks.select("id", "document_id", *[F.col(x).cast("long") for x in ("ordinal", "byte_start", "byte_end")], "content_digest")


@query
def markdown_chunks(spark, sf):
    return placed(chunking.Markdown(400, 40).chunk(c.conversations(spark, sf)))


@query
def markdown_heading_chunks(spark, sf):
    return placed(chunking.MarkdownHeading(600, 120, 60).chunk(c.conversations(spark, sf)))


@query
def sentence_snap_chunks(spark, sf):
    return placed(chunking.SnappedFixed(1200, 120, 200).chunk(c.documents(spark, sf)))


# representations --------------------------------------------------------------------------------
@query
def raw_representations(spark, sf):
    return rep.raw(large(spark, sf)).select("id", "chunk_id", "kind", "content_digest")


@query
def lead_summaries(spark, sf):
    return rep.lead_summaries(large(spark, sf)).select("id", "chunk_id", "kind", "text")


@query
def breadcrumbs(spark, sf):
    docs = c.conversations(spark, sf)
    return rep.breadcrumbs(chunking.Markdown(400, 40).chunk(docs), docs).select("id", "chunk_id", "kind", "text")


@query
def small_to_big(spark, sf):
    docs = c.documents(spark, sf)
    found = rep.best_parents(SMALL.chunk(docs), LARGE.chunk(docs))
    return found.select("id", "document_id", F.col("ordinal").cast("long"), "parent_id")


@query
def compose_dedupe(spark, sf):
    chunks = large(spark, sf)
    both = rep.compose(rep.raw(chunks), rep.lead_summaries(chunks), rep.raw(chunks.where("ordinal = 0")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))


@query
def ensure_raw(spark, sf):
    chunks = large(spark, sf)
    some = rep.raw(chunks.where("ordinal % 2 = 0"))
    return rep.ensure_raw(some, chunks).select("id", "chunk_id", "kind")


@query
def first_chunk(spark, sf):
    return rep.first_chunks(large(spark, sf)).select("document_id", "chunk_id", F.col("ordinal").cast("long"))


@query
def batch_groups(spark, sf):
    placed = rep.grouped(SMALL.chunk(c.documents(spark, sf)))
    return placed.select("id", F.col("group_no").cast("long"), F.col("place").cast("long"))


@query
def hash_embedding(spark, sf):
    found = embedding.hash_embed(c.documents(spark, sf), 16)
    return found.select("id", "n_terms", F.posexplode("values").alias("d", "x")).select("id", "n_terms", F.col("d").cast("long"), F.round(F.col("x").cast("double"), 5).alias("x"))


# search -----------------------------------------------------------------------------------------
@query
def bm25_topk(spark, sf):
    hits = lexical.search(c.records(large(spark, sf)), c.queries(spark, sf), 10, by_document=True)
    return scores(hits).select("query_id", "document_id", "chunk_id", F.col("rank").cast("long"), "score")


@query
def two_field_bm25(spark, sf):
    chunks = large(spark, sf)
    records = c.records(chunks).withColumn("title", F.substring("text", 1, 60))
    hits = lexical.search_fields(records, c.queries(spark, sf), 10)
    return scores(hits).select("query_id", "chunk_id", F.col("rank").cast("long"), "score")


def vector_index(spark, sf) -> DataFrame:
    key = F.col("vec_id").cast("string")
    return c.table(spark, sf, "embeddings").select(key.alias("representation_id"), key.alias("chunk_id"), key.alias("document_id"), F.col("embedding").alias("values"), "label")


def vector_queries(spark, sf) -> DataFrame:
    return c.table(spark, sf, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").cast("string").alias("query_id"), F.col("embedding").alias("values"), F.col("label").alias("query_label"))


@query
def exact_cosine_topk(spark, sf):
    hits = vector_search.exact(vector_index(spark, sf), vector_queries(spark, sf), 10)
    return scores(hits).select("query_id", "representation_id", F.col("rank").cast("long"), "score")


@query
def approximate_topk(spark, sf):
    hits = vector_search.approximate(vector_index(spark, sf), vector_queries(spark, sf), 10)
    return scores(hits).select("query_id", "representation_id", F.col("rank").cast("long"), "score")


@query
def stored_cells_topk(spark, sf):
    index = cells.build_cells(vector_index(spark, sf), scratch(spark, "cells"), "given")
    hits = cells.search_cells(index, vector_queries(spark, sf), 10, "given")
    return scores(hits).select("query_id", "representation_id", F.col("rank").cast("long"), "score")


@query
def vector_identity(spark, sf):
    vectors = c.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("representation_id"), F.col("embedding").alias("values"), F.lit("given").alias("model"))
    return vector_search.identity(vectors).select("model", F.col("dims").cast("long"), "n")


@query
def vector_norms(spark, sf):
    rows = c.table(spark, sf, "embeddings")
    return rows.select("vec_id", F.round(v.norm("embedding"), 5).alias("norm"), v.is_finite("embedding").alias("finite"))


# hits -------------------------------------------------------------------------------------------
@query
def collapse_document(spark, sf):
    return retrieval.collapse(bm25(spark, sf, 30), "document").select("query_id", "document_id", "chunk_id", F.col("rank").cast("long"))


def both_channels(spark, sf) -> DataFrame:
    chunks = large(spark, sf)
    records, asked = c.records(chunks), c.queries(spark, sf)
    words = lexical.search(records, asked, 20)
    embedded = embedding.hash_embed(chunks, 64).select(F.col("id").alias("chunk_id"), "values")
    index = records.drop("text").join(embedded, "chunk_id")
    asked_vectors = embedding.hash_embed(asked, 64, key="query_id").select("query_id", "values")
    return words.unionByName(vector_search.exact(index, asked_vectors, 20))


@query
def rrf_fusion(spark, sf):
    fused = retrieval.fuse(both_channels(spark, sf), 60.0, {"bm25": 1.0, "vector": 0.5})
    return scores(fused.where("rank <= 10"), 9).select("query_id", "chunk_id", "document_id", F.col("rank").cast("long"), "score", F.size("contributions").cast("long").alias("n_channels"))


def asking_service(spark, sf, generate) -> answering.Service:
    """Both channels over all chunks, and a generator of expressions in place of a model."""
    chunks = large(spark, sf)
    records = c.records(chunks)
    index = records.drop("text").join(embedding.hash_embed(chunks, 64).select(F.col("id").alias("chunk_id"), "values"), "chunk_id")
    near = lambda asked, k: vector_search.exact(index, embedding.hash_embed(asked, 64, key="query_id").select("query_id", "values"), k)
    return answering.Service(chunks, lambda asked, k: lexical.search(records, asked, k), near, generate=lambda asked, _: asked.select("query_id", generate.alias("output")))


def asked_with(spark, sf, strategy: str, generate) -> DataFrame:
    config = answering.Config(strategy, retrieve_k=20, evidence_k=10, rrf_weights={"bm25": 1.0, "vector": 0.5}, query_variants=2)
    evidence = answering.retrieve(asking_service(spark, sf, generate), c.queries(spark, sf), config).evidence
    return scores(evidence, 9).select("query_id", "chunk_id", "document_id", F.col("rank").cast("long"), "score")


@query
def hyde_topk(spark, sf):
    """The written answer is the passage twice: its vector has the passage's direction."""
    return asked_with(spark, sf, "hyde", F.concat("text", F.lit("\n"), "text"))


@query
def multi_query_topk(spark, sf):
    """Two variants of each passage, which differ from it in marks only: each channel counts three times."""
    variants = F.array(F.concat("text", F.lit(" .")), F.concat("text", F.lit(" ;")))
    return asked_with(spark, sf, "multi-query", F.to_json(F.struct(variants.alias("variants"))))


@query
def written_representations(spark, sf):
    """Representations of every kind that a model writes, by a generator of expressions that answers from the chunk's length and digest."""
    docs = c.documents(spark, sf)
    chunks = LARGE.chunk(docs)
    about = F.substring(F.sha2("input", 256), 1, 6)
    says = {
        "question": F.concat(F.lit("- What of "), about, F.lit("?\n2. Why "), about, F.lit("?\n\n- What of "), about, F.lit("?")),
        "entities": F.concat(about, F.lit("\n "), F.reverse(about), F.lit(" \n"), about),
        "statement": F.concat(F.lit("```\n"), about, F.lit(" is so.\n\n and so on \n```")),
        "contextual": F.lit("Part of it."),
    }
    sets = []
    for kind, output in says.items():
        write = lambda df, output=output: df.withColumn("output", output)
        sets.append(rep.generated(chunks, docs, kind, write, "expressions", "p", "d").select("chunk_id", "kind", F.sha2("text", 256).alias("text_sha256")))
    return sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(sets[3])


@query
def hydrate(spark, sf):
    fused = retrieval.from_hits(bm25(spark, sf, 10))
    found = retrieval.hydrate(fused, large(spark, sf), 5)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long"), "content_digest")


@query
def kind_filter_topk(spark, sf):
    chunks = large(spark, sf)
    reps = rep.compose(rep.raw(chunks), rep.lead_summaries(chunks))
    records = lexical.lexical_records(reps, chunks)
    hits = lexical.search(records, c.queries(spark, sf), 10, keep=F.col("kind") == "summary")
    return scores(hits).select("query_id", "representation_id", F.col("rank").cast("long"), "score")


@query
def role_filter_topk(spark, sf):
    hits = retrieval.filter_roles(bm25(spark, sf, 50), c.documents(spark, sf), ["src0", "src1", "src2"], 50, 5)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long"))


@query
def term_overlap_rerank(spark, sf):
    candidates = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 20)), large(spark, sf))
    out = reranking.term_overlap(candidates, c.queries(spark, sf), 10)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long"), F.col("reranker_score").cast("long").alias("overlap"))


@query
def context_pack(spark, sf):
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 10)), large(spark, sf))
    packed = answering.pack_context(evidence, 5, 3000)
    return packed.select("query_id", F.size("admitted").cast("long").alias("n_admitted"), F.size("omitted").cast("long").alias("n_omitted"), F.col("used").cast("long"), F.array_join("admitted", ",").alias("admitted"))


@query
def extractive_answers(spark, sf):
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 3)), large(spark, sf))
    out = generation.extractive(evidence, c.queries(spark, sf), 2)
    return out.select("query_id", F.sha2("answer", 256).alias("answer_sha256"), F.array_join("citations", ",").alias("citations"), "finish_reason", "input_tokens", "output_tokens")


# evaluation -------------------------------------------------------------------------------------
def label_rankings(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Vector rankings, judged by equal labels (grade 1)."""
    index, asked = vector_index(spark, sf), vector_queries(spark, sf)
    hits = vector_search.exact(index.drop("label"), asked.drop("query_label"), 20)
    ranked = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "representation_id"))).alias("x")).select("query_id", F.col("x.representation_id").alias("ranked"))
    judged = asked.join(index, F.col("query_label") == F.col("label")).select("query_id", F.lit("representation").alias("target"), F.col("representation_id").alias("target_id"), F.lit(1.0).alias("grade"))
    return ranked, judged


@query
def retrieval_metrics(spark, sf):
    out = evaluation.metrics(*label_rankings(spark, sf), CUTOFFS)
    return out.select("query_id", F.col("k").cast("long"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "hit_rate", "ndcg", "mrr")])


@query
def metrics_macro(spark, sf):
    out = evaluation.report(evaluation.metrics(*label_rankings(spark, sf), CUTOFFS), CUTOFFS)
    return out.select(F.col("k").cast("long"), F.col("evaluated").cast("long"), *[F.round(x, 6).alias(x) for x in ("precision", "recall", "hit_rate", "ndcg", "mrr")])


def judgments(spark, sf) -> DataFrame:
    """Quality labels as graded judgments: the query is the document's source, its level follows the id."""
    docs = c.table(spark, sf, "documents").select("doc_id", "source")
    rows = c.table(spark, sf, "labels").join(docs, "doc_id")
    target = F.when((F.col("source") == "src3") & (F.col("doc_id") % 7 == 0), "chunk").otherwise("document")
    return rows.select(F.col("source").alias("query_id"), target.alias("target"), F.col("doc_id").cast("string").alias("target_id"), F.col("quality").cast("double").alias("grade"), F.col("doc_id").alias("pos"))


@query
def mixed_targets(spark, sf):
    return evaluation.mixed_targets(judgments(spark, sf))


@query
def target_levels(spark, sf):
    return evaluation.target_levels(judgments(spark, sf))


@query
def judgment_violations(spark, sf):
    found = validation.judgment_problems(judgments(spark, sf).withColumn("grade", F.col("grade") - F.when(F.col("pos") % 50 == 0, 2.0).otherwise(0.0)))
    return found.groupBy("entity", "problem").agg(F.count("*").alias("n"))


# statistics -------------------------------------------------------------------------------------
OPTIONS = statistics.Options(1200, furniture=statistics.FURNITURE)


@query
def chunk_overlap(spark, sf):
    return statistics.overlaps(large(spark, sf)).select("id", F.col("runes").cast("long"), "has_predecessor", F.col("overlap_bytes").cast("long"))


@query
def chunk_signals(spark, sf):
    return statistics.measured(large(spark, sf), OPTIONS).select("id", F.array_join("signals", ",").alias("signals"))


@query
def furniture(spark, sf):
    pages = c.table(spark, sf, "pages").withColumn("f", statistics.furniture(F.col("html")))
    docs = c.table(spark, sf, "documents").withColumn("f", statistics.furniture(F.col("text")))
    rows = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), "f").unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "f"))
    return rows.where("f is not null").select("kind", "id", F.col("f.pattern").alias("pattern"), F.col("f.matches").cast("long").alias("matches"))


@query
def size_histogram(spark, sf):
    bars = statistics.histogram(statistics.overlaps(large(spark, sf)))
    return bars.select(F.col("bucket").cast("long"), F.col("low").cast("long"), F.col("high").cast("long"), "n", F.round("share", 6).alias("share"))


@query
def size_percentiles(spark, sf):
    return statistics.percentiles(statistics.overlaps(large(spark, sf))).select(F.col("percentile").cast("long"), F.col("runes").cast("long"))


@query
def signal_summary(spark, sf):
    return statistics.signal_summary(statistics.measured(large(spark, sf), OPTIONS)).select("signal", "chunks", "documents")


@query
def document_rollup(spark, sf):
    out = statistics.document_rollup(large(spark, sf), c.documents(spark, sf))
    return out.select("document_id", "name", *[F.col(x).cast("long") for x in ("chunks", "total_runes", "min_runes", "max_runes", "first_ordinal", "last_ordinal")])


@query
def signals_by_document(spark, sf):
    rows = statistics.signals_by_document(statistics.measured(large(spark, sf), OPTIONS))
    return rows.select("document_id", F.array_join("signals", ",").alias("signals"), F.array_join("patterns", ",").alias("patterns"))


# more of evidence and answers -------------------------------------------------------------------
@query
def evidence_identities(spark, sf):
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 3)), large(spark, sf))
    found = validation.evidence_identities(evidence)
    return found.select("query_id", F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["chunk_id"], e["content_digest"])), ",").alias("evidence"))


@query
def unit_targets(spark, sf):
    docs = c.documents(spark, sf)
    units = docs.withColumn("metadata", F.when(F.col("metadata")["lang"] == "en", F.create_map(F.lit("evaluation_unit_id"), F.col("metadata")["source_role"])).otherwise(F.col("metadata")))
    found = retrieval.target_ids(bm25(spark, sf, 10), "unit", units)
    return found.select("query_id", "chunk_id", F.col("rank").cast("long"), "target_id")


@query
def candidate_metadata(spark, sf):
    found = retrieval.candidate_metadata(large(spark, sf), c.documents(spark, sf))
    return found.select("chunk_id", "document_id", F.col("metadata")["source_role"].alias("source_role"), F.col("metadata")["lang"].alias("lang"))


@query
def prefixed_fusion(spark, sf):
    hits = bm25(spark, sf, 20)
    varied = hits.unionByName(hits.where("rank % 2 = 0").withColumn("channel", F.lit("bm25:q2")).withColumn("rank", (F.col("rank") / 2).cast("int")))
    fused = retrieval.fuse(varied, 60.0, {"bm25": 2.0})
    return scores(fused, 9).select("query_id", "chunk_id", F.col("rank").cast("long"), "score")


@query
def ordinal_labels(spark, sf):
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 8)), large(spark, sf))
    prepared = answering.prepare(evidence, answering.Config(evidence_k=4, maximum_context_runes=1_000_000), "ordinal")
    return prepared.select("query_id", "chunk_id", "label")


@query
def answer_contract(spark, sf):
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 2)), large(spark, sf))
    prepared = answering.prepare(evidence, answering.Config(evidence_k=2, maximum_context_runes=1_000_000), "ordinal")
    asked = c.queries(spark, sf)
    texts = (
        '{"answer":"a","citation_chunk_ids":["E1"],"abstained":false}',
        '{"answer":"a","citation_chunk_ids":["E9"],"abstained":false}',
        '{"answer":"","citation_chunk_ids":[],"abstained":true}',
        '{"answer":"a","citation_chunk_ids":["E1","E1"],"abstained":false}',
        "no json",
    )
    kind = (F.col("query_id").cast("long") % len(texts) + 1).cast("int")
    raw = asked.join(evidence.select("query_id").distinct(), "query_id", "left_semi").select("query_id", F.element_at(F.array(*[F.lit(x) for x in texts]), kind).alias("output"))
    return answering.interpret(raw, prepared).groupBy("valid", "abstained", "failure_category").agg(F.count("*").alias("n"))


@query
def document_summaries(spark, sf):
    docs = c.documents(spark, sf)
    found = rep.document_summaries(docs, LARGE.chunk(docs), F.substring("text", 1, 80))
    return found.select("id", "chunk_id", "kind", "text")


@query
def line_functions(spark, sf):
    turns = c.table(spark, sf, "conversations").where("text is not null")
    return turns.select("conv_id", "turn", F.array_join(t.question_lines("text"), "|").alias("questions"), t.excerpt("text").alias("excerpt"))


@query
def representation_violations(spark, sf):
    chunks = large(spark, sf)
    reps, number = rep.raw(chunks).withColumn("n", F.length("text") % 5), F.col("n")
    broken = reps.withColumn("text", F.when(number == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("chunk_id", F.when(number == 2, "none").otherwise(F.col("chunk_id")))
    return validation.representation_problems(broken, chunks).groupBy("entity", "problem").agg(F.count("*").alias("n"))


@query
def normalized_vectors(spark, sf):
    rows = c.table(spark, sf, "embeddings").select("vec_id", v.normalized(F.transform("embedding", lambda x: (x * 3).cast("float"))).alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0].cast("double"), 5).alias("first"), F.round(v.norm("u"), 5).alias("norm"))


# contracts, usage, errors -----------------------------------------------------------------------
@query
def corpus_violations(spark, sf):
    docs = c.documents(spark, sf)
    number = F.col("id").cast("long")
    broken = docs.withColumn("content_digest", F.when(number % 97 == 0, "bad").otherwise(F.col("content_digest")))
    chunks = LARGE.chunk(docs).withColumn("byte_end", F.col("byte_end") + F.when((F.col("document_id").cast("long") % 89 == 0) & (F.col("ordinal") == 0), 1).otherwise(0))
    found = validation.corpus_problems(broken.where(number % 101 != 0), chunks)
    return found.groupBy("entity", "problem").agg(F.count("*").alias("n"))


@query
def usage_sum(spark, sf):
    events = c.table(spark, sf, "events")
    rows = events.select(F.col("event_type"), F.when(F.col("event_type") != "view", F.floor("value").cast("long")).alias("input_tokens"), F.when(F.col("event_id") % 2 == 0, F.floor("value").cast("long")).alias("output_tokens"))
    return generation.total_usage(rows, "event_type")


@query
def transient_errors(spark, sf):
    events = c.table(spark, sf, "events")
    kinds = F.array(*[F.lit(x) for x in ("status=503 upstream", "Rate limit reached", "invalid key", "context canceled: EOF", "read timed out", "status=404")])
    status = F.when(F.col("event_id") % 4 == 0, F.element_at(F.array(*[F.lit(x) for x in (200, 404, 408, 429, 500, 599, 600)]), (F.col("event_id") % 7 + 1).cast("int")))
    message = F.element_at(kinds, (F.col("event_id") % 6 + 1).cast("int"))
    return events.select(generation.error_class(message, status).alias("class")).groupBy("class").agg(F.count("*").alias("n"))


@query
def query_contract(spark, sf):
    asked = c.queries(spark, sf)
    doubled = asked.unionByName(asked.where(F.col("query_id").cast("long") % 10 == 0)).withColumn("text", F.when(F.col("query_id").cast("long") % 9 == 0, " ").otherwise(F.col("text")))
    return answering.query_problems(doubled).groupBy("problem").agg(F.count("*").alias("n"))


@query
def neighbours_in_document(spark, sf):
    chunks = large(spark, sf)
    w = Window.partitionBy("document_id").orderBy("ordinal")
    return chunks.select("id", F.lag("id").over(w).alias("before"), F.lead("id").over(w).alias("after"))


# stores, caches and generation ------------------------------------------------------------------
@query
def grouped_generation(spark, sf):
    """A generator of expressions that leaves out every third chunk of a group; those are asked for alone."""
    docs = c.documents(spark, sf)
    entry = lambda i: F.when(i % 3 != 0, F.format_string('{"chunk":%d,"text":"group %d"}', i, i))

    def generate(df: DataFrame) -> DataFrame:
        if "chunk_ids" not in df.columns:
            return df.withColumn("output", F.lit("own"))
        return df.withColumn("output", F.concat(F.lit("["), F.array_join(F.array_compact(F.transform(F.sequence(F.lit(1), "n_chunks"), entry)), ","), F.lit("]")))

    prompts = rep.Prompts()
    return rep.generated(LARGE.chunk(docs), docs, "summary", generate, "expressions", prompts.text("summary", True), prompts.digest("summary", True), rep.GROUP_SIZE).select("chunk_id", "kind", "text")


@query
def tied_vectors(spark, sf):
    """Vectors of signs: most scores are equal, and ids decide."""
    signs = F.transform(F.slice("values", 1, 4), lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))
    index, asked = (df.withColumn("values", signs) for df in (vector_index(spark, sf), vector_queries(spark, sf)))
    return scores(vector_search.exact(index, asked, 10)).select("query_id", "representation_id", F.col("rank").cast("long"), "score")


@query
def stored_index_topk(spark, sf):
    index = postings.build_postings(c.records(large(spark, sf)), scratch(spark, "postings"))
    return scores(postings.search_postings(index, c.queries(spark, sf), 10)).select("query_id", "chunk_id", F.col("rank").cast("long"), "score")


@query
def forward_index_topk(spark, sf):
    index = lexical.build_index(c.records(large(spark, sf)), scratch(spark, "lexical"))
    return scores(lexical.search(index, c.queries(spark, sf), 10)).select("query_id", "chunk_id", F.col("rank").cast("long"), "score")


def keywords(spark, sf) -> DataFrame:
    """The four longest terms of each passage."""
    ordered = F.array_sort(F.transform(t.term_set("text"), lambda x: F.concat(F.lpad((1000 - F.length(x)).cast("string"), 4, "0"), x)))
    return c.queries(spark, sf).select("query_id", F.array_join(F.transform(F.slice(ordered, 1, 4), lambda x: F.substring(x, 5, 1000)), " ").alias("text"))


@query
def keyword_topk(spark, sf):
    index = postings.build_postings(c.records(large(spark, sf)), scratch(spark, "postings"))
    return scores(postings.search_postings(index, keywords(spark, sf), 10)).select("query_id", "chunk_id", F.col("rank").cast("long"), "score")


@query
def kind_index_topk(spark, sf):
    chunks = large(spark, sf)
    records = lexical.lexical_records(rep.compose(rep.raw(chunks), rep.lead_summaries(chunks)), chunks)
    index = postings.build_postings(records, scratch(spark, "postings"))
    hits = postings.search_postings(index, c.queries(spark, sf), 10, kinds=["summary"])
    return scores(hits).select("query_id", "representation_id", F.col("rank").cast("long"), "score")


@query
def vector_violations(spark, sf):
    key = F.col("vec_id")
    rows = c.table(spark, sf, "embeddings")
    doubled = rows.unionByName(rows.where(key % 97 == 0))
    values = F.when(key % 50 == 0, F.transform("embedding", lambda x, i: F.when(i == 0, float("nan")).otherwise(x).cast("float"))).otherwise(F.col("embedding"))
    values = F.when(key % 61 == 0, F.slice(values, 1, F.size("embedding") - 1)).otherwise(values)
    vectors = doubled.select(key.cast("string").alias("representation_id"), values.alias("values"), F.when(key % 73 == 0, "other").otherwise("given").alias("model"))
    known = rows.where(key % 89 != 0).select(key.cast("string").alias("id"))
    return embedding.vector_problems(vectors, known).groupBy("problem").agg(F.count("*").alias("n"))


@query
def signal_counts(spark, sf):
    return statistics.count_by_document(statistics.measured(large(spark, sf), OPTIONS))


@query
def uncounted_sizes(spark, sf):
    return statistics.uncounted(statistics.overlaps(large(spark, sf)), ((0, 99), (200, 1100)))


def built(spark, sf) -> bundle.Bundle:
    docs = c.documents(spark, sf)
    chunks = LARGE.chunk(docs)
    reps = rep.raw(chunks)
    vectors = embedding.hash_embed(reps, 16).select(F.col("id").alias("representation_id"), "values", F.lit("hash-16").alias("model"))
    return bundle.build(bundle.BuildInput(docs, chunks, reps, LARGE.name, vectors, "hash-16", 16), scratch(spark, "bundles"))


@query
def bundle_inspection(spark, sf):
    made = built(spark, sf)
    seen = bundle.inspect(spark, bundle.verify(spark, made.path).path, c.documents(spark, sf))
    return seen["chunks"].select("document_id", "name", "chunks", F.col("first").cast("long"), F.col("last").cast("long"), F.lit(seen["corpus"]).alias("corpus"))


@query
def search_bundle_topk(spark, sf):
    """Keywords through the lexical index of a search bundle, hydrated from its content store."""
    docs = c.documents(spark, sf)
    chunks = LARGE.chunk(docs)
    found = search_bundle.build_search(bundle.BuildInput(docs, chunks, rep.raw(chunks), LARGE.name), scratch(spark, "search"))
    hits = found.hydrate(found.search_text(keywords(spark, sf), 10))
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long"), "content_digest")


@query
def ordered_vectors(spark, sf):
    rows = bundle.vector_entries(built(spark, sf), "hash-16")
    return rows.select("representation_id", "model", F.size("values").cast("long").alias("dims"))


@query
def content_lookup(spark, sf):
    docs = c.documents(spark, sf)
    store = content.build_content(docs, LARGE.chunk(docs), scratch(spark, "content"))
    found = content.open_content(spark, store.path, store.identity.id).lookup(store.chunks.where("ordinal = 0"))
    return found.select("id", "document_id", "content_digest")


@query
def staged_bundle(spark, sf):
    root = scratch(spark, "stage")
    stager, docs = ingest.Stager(spark, root), c.documents(spark, sf)
    chunks = LARGE.chunk(docs)
    stager.add_documents(docs)
    for half in (0, 1):
        stager.add_chunks(chunks.where(F.col("ordinal") % 2 == half))
    stager.add_representations(rep.raw(chunks))
    made = bundle.publish_staged(spark, root, scratch(spark, "bundles"), LARGE.name)
    counts = [made.tables[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name in ("documents", "chunks", "representations")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def report_rows(spark, reports: list[dict]) -> DataFrame:
    fields = ", ".join(f"{k} long" for k in reports[0])
    return spark.createDataFrame([tuple(x.values()) for x in reports], fields)


@query
def cached_generation(spark, sf):
    path = scratch(spark, "generated")
    asked = c.table(spark, sf, "documents").select(F.lit("p").alias("prompt"), F.concat("source", "lang").alias("input"))
    call = lambda df: df.withColumns({"output": F.upper("input"), "input_tokens": F.length("input").cast("long")})
    found = [caching.cached_generate(asked, call, "expressions", path, "1", waves=2)[1] for _ in range(2)]
    return report_rows(spark, [{"run": n, **{k: x[k] for k in ("rows", "hits", "misses", "writes")}, "input_tokens": x["usage"]["input_tokens"]} for n, x in enumerate(found)])


@query
def embedding_cache(spark, sf):
    path = scratch(spark, "embedded")
    turns = c.table(spark, sf, "conversations").where("text is not null").select(F.concat_ws("-", "conv_id", "turn").alias("id"), "text", t.digest("text").alias("content_digest"))
    embed = lambda df: embedding.hash_embed(df, 8).withColumnRenamed("id", "representation_id")
    found = [caching.cached_embeddings(turns, embed, "hash-8", path, waves=2)[1] for _ in range(2)]
    return report_rows(spark, [{"run": n, **{k: x[k] for k in ("rows", "hits", "writes")}} for n, x in enumerate(found)])


@query
def generation_flow(spark, sf):
    asked = c.table(spark, sf, "documents").select("doc_id", F.concat_ws("-", "source", "lang").alias("input"))
    steps = [generation.Step("upper", lambda df: df.withColumn("output", F.upper("input")), "m", "p", "1"), generation.Step("reverse", lambda df: df.withColumn("output", F.reverse("input")), "m", "p", "1")]
    return generation.flow(asked, steps, scratch(spark, "flow"))[0].select("doc_id", "output")


def told_apart(items: list[dict]) -> list[dict]:
    """A stand-in for a model: the text's digest; texts whose digest begins with 0 are refused, as are the calls that hold them."""
    digests = [hashlib.sha256(i["text"].encode()).hexdigest() for i in items]
    if any(x.startswith("0") for x in digests):
        raise ContractError("refused")
    return [{"output": x, "input_tokens": len(i["text"])} for i, x in zip(items, digests, strict=True)]


@query
def called_generation(spark, sf):
    """Every text by calls of 16 items; the second run finds what the first has stored and given up."""
    docs, path = c.table(spark, sf, "documents").where("text is not null").select("doc_id", "text"), scratch(spark, "calls")
    policy = calls.Policy(batch=16, attempts=1)
    calls.called(docs, t.digest("text"), told_apart, path, policy)
    out, report = calls.called(docs, t.digest("text"), told_apart, path, policy)
    return out.select("doc_id", "output", "failure_class", F.lit(report["called"]).cast("long").alias("called_again"))


@query
def called_rerank(spark, sf):
    candidates = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 20)), large(spark, sf))
    call = lambda _, texts: {"results": [{"index": i, "score": float(len(x))} for i, x in reversed(list(enumerate(texts)))]}
    out, _ = reranking.rerank_items(candidates, c.queries(spark, sf), call, "length", 10, scratch(spark, "reranked"))
    return out.select("query_id", "chunk_id", F.col("rank").cast("long"), F.col("reranker_score").cast("long").alias("n"))


@query
def ingested_documents(spark, sf):
    """Four runs of a stream: three thirds of the documents, each with some that came before, then others under known ids."""
    source, root, fixed = scratch(spark, "arriving"), scratch(spark, "ingested"), chunking.Fixed(1200, 120)
    docs, key = c.documents(spark, sf).where("text is not null"), F.col("id").cast("long")
    changed = docs.where(key % 7 == 0).withColumn("text", F.concat("text", F.lit("!"))).withColumn("content_digest", t.digest("text"))
    runs = [docs.where((key % 3 == n) | ((key % 5 == 0) & (key % 3 < n))) for n in range(3)] + [changed]
    for rows in runs:
        rows.write.mode("append").options(**STORED).parquet(source)
        ingest.ingest_once(spark, source, fixed, root).awaitTermination()
    staged = lambda name: ingest.staged(spark, root, name)
    counts = {name: staged(name).agg(F.count("*").alias("n")) for name in ("documents", "chunks")} | {name: staged(name).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")) for name in ("conflicts", "repeats")}
    parts = [df.select(F.lit(name).alias("name"), "n") for name, df in counts.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query
def scored_rerank(spark, sf):
    candidates = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 20)), large(spark, sf))
    out = reranking.rerank(candidates, c.queries(spark, sf), lambda _, texts: [float(len(x)) for x in texts], 10)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long"), F.col("reranker_score").cast("long").alias("n"))


@query
def evidence_violations(spark, sf):
    chunks, rank = large(spark, sf), F.col("rank")
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 3)), chunks)
    broken = evidence.withColumns({"text": F.when(rank == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text")), "chunk_id": F.when(rank == 2, "none").otherwise(F.col("chunk_id")), "rank": F.when(rank == 3, 0).otherwise(rank)})
    return answering.augmented_problems(broken, chunks).groupBy("problem").agg(F.count("*").alias("n"))


def by_problem(df: DataFrame) -> DataFrame:
    return df.groupBy("problem").agg(F.count("*").alias("n"))


@query
def hit_violations(spark, sf):
    """Of three hits a query the first gets rank 0, the second a score that is no number, the third no chunk."""
    rank = F.col("rank")
    broken = bm25(spark, sf, 3).withColumns({"score": F.when(rank == 2, float("nan")).otherwise(F.col("score")), "chunk_id": F.when(rank == 3, "").otherwise(F.col("chunk_id")), "rank": F.when(rank == 1, 0).otherwise(rank)})
    return by_problem(retrieval.hit_problems(broken))


@query
def rerank_violations(spark, sf):
    """The first result of a query is missing, of another chunk or without a finite score, in turn."""
    hits = bm25(spark, sf, 5)
    candidates = retrieval.hydrate(retrieval.from_hits(hits), large(spark, sf))
    done = reranking.term_overlap(candidates, c.queries(spark, sf), 3)
    turn, first = F.col("query_id").cast("long") % 3, F.col("rank") == 1
    broken = done.where(~(first & (turn == 0))).withColumns({"chunk_id": F.when(first & (turn == 1), "none").otherwise(F.col("chunk_id")), "reranker_score": F.when(first & (turn == 2), float("inf")).otherwise(F.col("reranker_score"))})
    return by_problem(reranking.rerank_problems(candidates, broken, 3))


@query
def prepared_violations(spark, sf):
    """Ten texts a query, prepared for ten and checked for five of 3,000 code points; labels are another's or one for all, in turn."""
    evidence = retrieval.hydrate(retrieval.from_hits(bm25(spark, sf, 10)), large(spark, sf))
    made = answering.prepare(evidence, answering.Config(evidence_k=10, maximum_context_runes=1_000_000))
    turn = F.col("query_id").cast("long") % 4
    least = F.min("chunk_id").over(Window.partitionBy("query_id"))
    broken = made.withColumn("label", F.when((turn == 0) & (F.col("rank") == 1), "E1").when(turn == 1, least).otherwise(F.col("label")))
    return by_problem(answering.prepared_problems(broken, answering.Config(evidence_k=5, maximum_context_runes=3000)))


@query
def judgment_targets(spark, sf):
    key = F.col("item_id")
    judged = c.table(spark, sf, "benchmark").select(key.cast("string").alias("query_id"), F.when(key % 5 == 0, "page").when(key % 7 == 0, None).otherwise("chunk").alias("target"), F.lit("x").alias("target_id"), F.lit(1.0).alias("grade"))
    return evaluation.judgment_target_problems(judged).select("query_id", "target")
