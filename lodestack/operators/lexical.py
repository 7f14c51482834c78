"""BM25 over all queries at once, and the persisted index that searches read.

An index is one row a representation with the terms of each field, the fields' totals and the document
frequency of each term. A search reads the frequencies of the queries' terms, sends those terms' weights to the
tasks and scores each row where it lies: no posting is shuffled, only the k best rows of a task and query.
Queries beyond QUERY_BLOCK are weighed and scored a block at a time.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.operators.best import BEST, KEYS, Best
from lodestack.operators.common import ContractError, require, saved, top_k

VERSION = 1
#: Queries whose weights are sent to every task at once, at most.
QUERY_BLOCK = 4096
#: Scores that are held at once: rows are taken in slices.
CELLS = 2_000_000


@dataclass(frozen=True)
class BM25Config:
    k1: float = 1.2
    b: float = 0.75
    channel: str = "bm25"


def lexical_records(representations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Representations with the chunk and document they belong to."""
    return representations.select(F.col("id").alias("representation_id"), "chunk_id", "kind", "text").join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")


def check_records(representations: DataFrame, chunks: DataFrame) -> None:
    require(representations.groupBy("id").count().where("count > 1").select("id"), "repeated representations")
    require(representations.join(chunks.select(F.col("id").alias("chunk_id")), "chunk_id", "left_anti").select("id", "chunk_id"), "representations of unknown chunks")


def query_terms(queries: DataFrame, text: str = "text") -> DataFrame:
    """(query_id, term, qtf): a term that a query repeats counts as often."""
    return queries.select("query_id", F.explode(t.terms(text)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


@dataclass
class Index:
    """entries: representation_id, chunk_id, document_id, any others, and terms_<field> of each field.
    frequencies (field, term, df) and totals (field -> (rows, mean length)): None where they are not stored."""

    entries: DataFrame
    fields: tuple[str, ...]
    frequencies: DataFrame | None = None
    totals: dict[str, tuple[float, float]] | None = None
    manifest: dict = field(default_factory=dict)


def analysed(records: DataFrame, fields: dict[str, Column] | None = None) -> Index:
    """An index that is not stored: what a search needs of it is counted as it runs.

    records: representation_id, chunk_id, document_id and what the fields are made of; null fields are empty."""
    fields = fields or {"text": F.col("text")}
    return Index(records.select("*", *[t.terms(F.coalesce(x, F.lit(""))).alias(f"terms_{f}") for f, x in fields.items()]), tuple(fields))


def build_index(records: DataFrame, path: str, fields: dict[str, Column] | None = None) -> Index:
    """Write an index: entries, document frequencies, and last the manifest (version, fields, totals, content digest)."""
    from lodestack.sources.bundle import exists, write_json
    from lodestack.sources.corpus import table_digest

    spark = records.sparkSession
    if exists(spark, f"{path}/manifest.json"):
        raise ContractError(f"{path} holds an index")
    made = analysed(records, fields)
    kept = [c for c in ("representation_id", "chunk_id", "document_id", "kind") if c in records.columns]
    stored = saved(made.entries.select(*kept, *[f"terms_{f}" for f in made.fields]), f"{path}/entries")
    terms = None
    for f in made.fields:
        part = stored.select(F.explode(F.array_distinct(f"terms_{f}")).alias("term")).groupBy("term").agg(F.count("*").alias("df")).select(F.lit(f).alias("field"), "term", "df")
        terms = part if terms is None else terms.unionByName(part)
    terms.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").parquet(f"{path}/terms")
    totals = stored.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(F.size(f"terms_{f}")), F.lit(0.0)).alias(f) for f in made.fields]).first()
    manifest = {"version": VERSION, "fields": list(made.fields), "totals": {f: [float(totals["n"]), totals[f]] for f in made.fields}, "digest": table_digest(stored, "representation_id")}
    write_json(spark, f"{path}/manifest.json", manifest)
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str, check: bool = False) -> Index:
    """The index under path; its content is only read and digested with check."""
    from lodestack.sources.bundle import read_json
    from lodestack.sources.corpus import table_digest

    m = read_json(spark, f"{path}/manifest.json")
    if m.get("version") != VERSION:
        raise ContractError("unknown index version")
    entries = spark.read.parquet(f"{path}/entries")
    if check and table_digest(entries, "representation_id") != m["digest"]:
        raise ContractError("the index differs from its digest")
    return Index(entries, tuple(m["fields"]), spark.read.parquet(f"{path}/terms"), {f: tuple(x) for f, x in m["totals"].items()}, m)


def _statistics(index: Index, vocabulary: DataFrame) -> tuple[dict[str, tuple[float, float]], dict[str, dict[str, float]]]:
    """Totals of each field and document frequencies of the vocabulary's terms; one pass where none are stored.

    vocabulary: the terms of at most QUERY_BLOCK queries."""
    if index.frequencies is not None:
        rows = index.frequencies.join(F.broadcast(vocabulary), "term", "left_semi").collect()
        totals = index.totals
    else:
        # a term is counted once a row; the null term counts rows and terms
        parts = F.array(*[F.struct(F.lit(f).alias("field"), F.array_append(F.array_distinct(f"terms_{f}"), F.lit(None).cast("string")).alias("terms"), F.size(f"terms_{f}").alias("n")) for f in index.fields])
        flat = index.entries.select(F.explode(parts).alias("p")).select("p.field", F.explode("p.terms").alias("term"), F.col("p.n").alias("n"))
        wanted = flat.join(F.broadcast(vocabulary.withColumnRenamed("term", "asked")), F.col("term") == F.col("asked"), "left").where("asked is not null or term is null")
        rows = wanted.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("n").alias("length")).collect()
        totals = {f: (0.0, 0.0) for f in index.fields} | {r["field"]: (float(r["df"]), r["length"] / r["df"]) for r in rows if r["term"] is None}
    frequency: dict[str, dict[str, float]] = defaultdict(dict)
    for r in rows:
        if r["term"] is not None:
            frequency[r["field"]][r["term"]] = float(r["df"])
    return totals, frequency


class Weights:
    """Of one field: terms by number, and for each term the queries that hold it with idf times its count there."""

    def __init__(self, terms: dict[str, list[tuple[int, float]]], frequency: dict[str, float], total: tuple[float, float], boost: float, config: BM25Config):
        known = sorted(x for x in terms if x in frequency)
        n = total[0]
        idf = [float(np.log(1 + (n - frequency[x] + 0.5) / (frequency[x] + 0.5))) for x in known]
        self.terms = pa.array(known, pa.string())
        self.starts = np.concatenate([[0], np.cumsum([len(terms[x]) for x in known])]).astype(np.int64)
        self.queries = np.array([q for x in known for q, _ in terms[x]], dtype=np.int64)
        self.weights = np.array([boost * qtf * w for x, w in zip(known, idf, strict=True) for _, qtf in terms[x]])
        self.mean, self.config = total[1], config

    def add(self, scores: np.ndarray, terms: pa.ListArray) -> None:
        """Add the scores of rows (their terms) to rows by queries. Sums run in order of a row's terms: equal rows, equal scores."""
        c, n_terms = self.config, len(self.terms)
        if not n_terms:
            return
        size = np.diff(np.asarray(terms.offsets, dtype=np.int64))
        row = np.repeat(np.arange(len(size)), size)
        which = pc.index_in(terms.flatten(), self.terms)
        found = np.asarray(pc.is_valid(which))
        key, tf = np.unique(row[found] * n_terms + np.asarray(pc.drop_null(which), dtype=np.int64), return_counts=True)
        row, term = key // n_terms, key % n_terms
        norm = (1 - c.b) + (c.b * size[row] / self.mean if self.mean > 0 else 0.0)
        part = tf * (c.k1 + 1) / (tf + c.k1 * norm)
        held = self.starts[term + 1] - self.starts[term]
        at = np.repeat(self.starts[term] - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
        cells = np.repeat(row, held) * scores.shape[1] + self.queries[at]
        scores += np.bincount(cells, weights=np.repeat(part, held) * self.weights[at], minlength=scores.size).reshape(scores.shape)


def search_index(index: Index, queries: DataFrame, k: int, boosts: dict[str, float] | None = None, config: BM25Config = BM25Config(), keep: Column | None = None, by_document: bool = False) -> DataFrame:
    """The k best hits of each query by the sum of the fields' boosted scores; by_document: of the best hit of each document.

    keep filters entries before they are scored; statistics stay those of all."""
    boosts = {f: b for f, b in (boosts or {f: 1.0 for f in index.fields}).items() if b > 0}
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select("query_id", "text").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = _search_block(index, numbered.where(F.col("block") == b), k, boosts, config, keep, by_document)
        out = part if out is None else out.unionByName(part)
    order = [F.col("cut").desc(), *[F.col(c) for c in KEYS]]
    if by_document:
        out = top_k(out, 1, order, ("query_id", "document_id")).drop("rank")
    return as_hits(top_k(out, k, order), config.channel)


def _search_block(index: Index, queries: DataFrame, k: int, boosts: dict[str, float], config: BM25Config, keep: Column | None, by_document: bool) -> DataFrame:
    asked = query_terms(queries).collect()
    spark = index.entries.sparkSession
    vocabulary = spark.createDataFrame(pd.DataFrame({"term": pd.Series(sorted({r["term"] for r in asked}), dtype=str)}), "term string")
    totals, frequency = _statistics(index, vocabulary)
    ids = sorted({r["query_id"] for r in asked})
    number = {q: n for n, q in enumerate(ids)}
    terms: dict[str, list[tuple[int, float]]] = defaultdict(list)
    for r in asked:
        terms[r["term"]].append((number[r["query_id"]], float(r["qtf"])))
    weights = {f: Weights(terms, frequency[f], totals[f], boost, config) for f, boost in boosts.items()}
    entries = index.entries if keep is None else index.entries.where(keep)
    columns = [f"terms_{f}" for f in weights]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(ids, k, by_document)
        step = max(1, CELLS // max(1, len(ids)))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                scores = np.zeros((part.num_rows, len(ids)))
                for c, w in zip(columns, weights.values(), strict=True):
                    w.add(scores, part.column(c))
                best.add(scores, part.select(KEYS).to_pandas(), scores > 0)
        if (found := best.rows()) is not None:
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    return entries.select(*KEYS, *columns).mapInArrow(task, BEST)


def search(records: DataFrame | Index, queries: DataFrame, k: int, config: BM25Config = BM25Config(), keep: Column | None = None, by_document: bool = False) -> DataFrame:
    """The k best hits of each query over the text field. keep filters representations; statistics stay those of all."""
    return search_index(records if isinstance(records, Index) else analysed(records), queries, k, {"text": 1.0}, config, keep, by_document)


def search_fields(records: DataFrame | Index, queries: DataFrame, k: int, title_boost: float = 2.0, body_boost: float = 1.0, config: BM25Config = BM25Config(channel="lexical")) -> DataFrame:
    """A disjunction of two fields: boosted scores of title and text are summed, in one pass."""
    if title_boost < 0 or body_boost < 0:
        raise ContractError("boosts must not be negative")
    index = records if isinstance(records, Index) else analysed(records, {"title": F.col("title"), "text": F.col("text")})
    return search_index(index, queries, k, {"title": title_boost, "text": body_boost}, config)


def as_hits(ranked: DataFrame, channel: str) -> DataFrame:
    return ranked.select("query_id", "representation_id", "chunk_id", "document_id", F.lit(channel).alias("channel"), "rank", "score")
