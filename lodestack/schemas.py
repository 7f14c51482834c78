"""Schemas of the data model. Collections that have an order carry it in a column."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)  # a DDL string reads better than nested constructors


DOCUMENT_DDL = "id string, source_uri string, title string, text string, content_digest string, metadata map<string,string>"
CHUNK_DDL = "id string, document_id string, ordinal int, byte_start int, byte_end int, text string, content_digest string, chunker string"
REPRESENTATION_DDL = "id string, chunk_id string, kind string, text string, content_digest string, model string, prompt_digest string"
VECTOR_DDL = "representation_id string, values array<float>, model string"
QUERY_DDL = "id string, text string, split string, category string"
JUDGMENT_DDL = "query_id string, target string, target_id string, grade double"
HIT_DDL = "query_id string, representation_id string, chunk_id string, document_id string, channel string, rank int, score double"
CONTRIBUTION_DDL = "struct<channel:string,rank:int,weight:double,value:double>"
FUSED_DDL = f"query_id string, chunk_id string, document_id string, rank int, score double, contributions array<{CONTRIBUTION_DDL}>"
EVALUATION_DDL = f"id string, corpus_digest string, queries array<struct<{QUERY_DDL.replace(' string', ':string')}>>, judgments array<struct<query_id:string,target:string,target_id:string,grade:double>>"
USAGE_COLUMNS = ("input_tokens", "output_tokens", "cached_tokens", "reasoning_tokens", "total_tokens", "cost_usd")

#: Levels that a judgment or ranking may be about, and kinds of representation.
TARGETS = ("representation", "chunk", "document", "unit")
KIND_RAW, KIND_SUMMARY, KIND_QUESTION = "raw", "summary", "question"
KIND_BREADCRUMB, KIND_SMALL, KIND_CONTEXTUAL, KIND_ENTITIES = "breadcrumb", "small", "contextual", "entities"
KIND_STATEMENT, KIND_DOCUMENT_SUMMARY, KIND_SYMBOL = "statement", "document-summary", "symbol"
