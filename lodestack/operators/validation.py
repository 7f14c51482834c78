"""Data contracts: each check is a DataFrame of violations (entity, key, problem); require() raises for any."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.functions import text as t
from lodestack.operators.common import ContractError, let, require


#: Files of a documents table of which texts are moved at once to check chunks, and the most turns that it takes.
TURN_BYTES, MOST_TURNS = 1 << 27, 4


def _empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def _hash(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _problems(df: DataFrame, entity: str, key: Column, tests: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in tests.items()]))
    return df.select(F.lit(entity).alias("entity"), key.cast("string").alias("key"), F.explode(found).alias("problem"))


def _repeated(df: DataFrame, entity: str, keys: list[str], problem: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return twice.select(F.lit(entity).alias("entity"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("key"), F.lit(problem).alias("problem"))


def _unknown(df: DataFrame, entity: str, key: str, ref: str, known: DataFrame, known_key: str, problem: str) -> DataFrame:
    missing = df.join(known.select(F.col(known_key).alias(ref)), ref, "left_anti")
    return missing.select(F.lit(entity).alias("entity"), F.col(key).cast("string").alias("key"), F.lit(problem).alias("problem"))


def union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def document_problems(documents: DataFrame) -> DataFrame:
    tests = {"empty id": _empty("id"), "text not UTF-8": ~F.is_valid_utf8("text"), "empty digest": _empty("content_digest"), "digest differs": ~_empty("content_digest") & (F.col("content_digest") != t.digest("text"))}
    return union(_problems(documents, "document", F.col("id"), tests), _repeated(documents, "document", ["id"], "repeated id"))


def chunk_problems(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Against their documents: known, in range, exact slices, digests, order."""
    return union(_chunk_rows(chunks, documents), _placed(chunks, documents))


def chunk_checks(chunks: DataFrame, documents: DataFrame) -> list[DataFrame]:
    """The parts of chunk_problems, to be run one after the other: texts of large documents tables meet their chunks in
    turns, by hash of the document, so that a shuffle holds a part of them only."""
    size = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    turns = max(1, min(MOST_TURNS, -(-size // TURN_BYTES)))
    part = lambda df, key, k: df.where(F.pmod(F.xxhash64(key), F.lit(turns)) == k) if turns > 1 else df
    return [_chunk_rows(chunks, documents), *[_placed(part(chunks, "document_id", k), part(documents, "id", k)) for k in range(turns)]]


def _chunk_rows(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """What shows without the documents' texts."""
    own = {"empty id": _empty("id"), "empty chunker": _empty("chunker"), "negative ordinal": F.col("ordinal") < 0, "text not UTF-8": ~F.is_valid_utf8("text"), "digest differs": F.col("content_digest") != t.digest("text"), "length differs": F.octet_length("text") != F.col("byte_end") - F.col("byte_start")}
    return union(
        _problems(chunks, "chunk", F.col("id"), own),
        _unknown(chunks, "chunk", "id", "document_id", documents, "id", "unknown document"),
        _repeated(chunks, "chunk", ["id"], "repeated id"),
        _repeated(chunks, "chunk", ["document_id", "ordinal"], "repeated ordinal"),
    )


def _placed(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks meet their document as ranges and SHA-256 of texts: only the documents' texts are moved."""
    docs = documents.select(F.col("id").alias("document_id"), F.col("text").alias("whole"))
    listed = chunks.groupBy("document_id").agg(F.collect_list(F.struct("id", "byte_start", "byte_end", _hash(F.col("text")).alias("hash"))).alias("c"))

    def compared(whole: Column) -> Column:
        """Out of bounds and differing, of each chunk: a document meets all its chunks in one row."""

        def one(x: Column) -> Column:
            start, end = x["byte_start"], x["byte_end"]
            outside = (start < 0) | (end < start) | (end > F.octet_length(whole))
            return F.struct(x["id"].alias("id"), outside.alias("outside"), (~outside & (_hash(F.substring(whole, start + 1, end - start)) != x["hash"])).alias("differs"))

        return F.transform("c", one)

    placed = listed.join(docs, "document_id").select(F.inline(let(F.col("whole").cast("binary"), compared)))
    source = {"range out of bounds": F.col("outside"), "not an exact slice": F.col("differs")}
    return _problems(placed, "chunk", F.col("id"), source)


def corpus_problems(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    return union(document_problems(documents), chunk_problems(chunks, documents))


def representation_problems(representations: DataFrame, chunks: DataFrame) -> DataFrame:
    own = {"empty id": _empty("id"), "empty kind": _empty("kind"), "text not UTF-8": ~F.is_valid_utf8("text"), "digest differs": F.col("content_digest") != t.digest("text")}
    # texts are as large as both tables, and SHA-256 of them tell as much
    texts = chunks.select(F.col("id").alias("chunk_id"), _hash(F.col("text")).alias("chunk_hash"))
    raw = representations.where(F.col("kind") == s.KIND_RAW).select("id", "chunk_id", _hash(F.col("text")).alias("hash")).join(texts, "chunk_id")
    return union(
        _problems(representations, "representation", F.col("id"), own),
        _problems(raw, "representation", F.col("id"), {"raw text differs": F.col("hash") != F.col("chunk_hash")}),
        _unknown(representations, "representation", "id", "chunk_id", chunks, "id", "unknown chunk"),
        _repeated(representations, "representation", ["id"], "repeated id"),
    )


def query_problems(queries: DataFrame) -> DataFrame:
    blank = t.trimmed(F.coalesce("id", F.lit(""))) == ""
    return union(_problems(queries, "query", F.col("id"), {"blank id": blank}), _repeated(queries, "query", ["id"], "repeated id"))


def judgment_problems(judgments: DataFrame, queries: DataFrame | None = None) -> DataFrame:
    grade = F.col("grade")
    tests = {"empty query": _empty("query_id"), "empty target id": _empty("target_id"), "unknown target": ~F.col("target").isin(*s.TARGETS), "bad grade": F.isnan(grade) | (F.abs(grade) == float("inf")) | (grade < 0)}
    mixed = judgments.groupBy("query_id").agg(F.min("target").alias("a"), F.max("target").alias("b")).where("a <> b")
    parts = [
        _problems(judgments, "judgment", F.concat_ws("/", "query_id", "target_id"), tests),
        mixed.select(F.lit("judgment").alias("entity"), F.col("query_id").alias("key"), F.lit("mixed targets").alias("problem")),
        _repeated(judgments, "judgment", ["query_id", "target", "target_id"], "repeated"),
    ]
    if queries is not None:
        parts.append(_unknown(judgments, "judgment", "query_id", "query_id", queries, "id", "unknown query"))
    return union(*parts)


def evidence_identities(evidence: DataFrame) -> DataFrame:
    """query_id and the ordered (chunk_id, content_digest) of its evidence; a missing digest is derived, a wrong one an error."""
    own = t.digest("text")
    given = F.nullif("content_digest", F.lit(""))
    digest = F.when(given.isNull(), own).when(given == own, given).otherwise(F.raise_error(F.concat(F.lit("digest differs: "), F.col("chunk_id"))))
    part = F.struct("rank", "chunk_id", digest.alias("content_digest"))
    sorted_ = F.array_sort(F.collect_list(part))
    return evidence.groupBy("query_id").agg(F.transform(sorted_, lambda e: F.struct(e["chunk_id"].alias("chunk_id"), e["content_digest"].alias("content_digest"))).alias("evidence"))


__all__ = ["ContractError", "chunk_checks", "chunk_problems", "corpus_problems", "document_problems", "evidence_identities", "judgment_problems", "query_problems", "representation_problems", "require", "union"]
