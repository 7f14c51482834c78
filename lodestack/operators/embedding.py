"""Embeddings: signed feature hashing as expressions, and a protocol for other embedders."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import text as t
from lodestack.functions import vectors as v
from lodestack.operators.common import ContractError


#: Sums that are held at once, and terms whose hashes a task remembers.
CELLS = 4_000_000
KNOWN = 200_000


class Embedder(Protocol):
    """Texts in, one row of floats for each out; sent to executors."""

    model: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


def hash_slot(term: Column, dims: int) -> Column:
    """The dimension of a term: the first 64 bits of its SHA-256, modulo dims, in two halves that a long holds."""
    half = lambda at: F.conv(F.substring(F.sha2(term, 256), at, 8), 16, 10).cast("long")
    return (((half(1) % dims) * ((1 << 32) % dims) + half(9)) % dims).cast("int")


def hash_sign(term: Column) -> Column:
    """1 or -1 by the lowest bit of the 64."""
    return F.when(F.conv(F.substring(F.sha2(term, 256), 16, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)


def hash_embed(texts: DataFrame, dims: int, key: str = "id", text: str = "text") -> DataFrame:
    """key, values (unit length, or zeros without terms) and n_terms of each text.

    A vector follows from one row: distinct terms of an Arrow batch are hashed once, nothing is shuffled.
    """
    if dims < 1:
        raise ContractError("dimensions must be positive")
    listed = texts.select(key, F.coalesce(t.terms(text), F.array().cast("array<string>")).alias("terms"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[int, float]] = {}
        step = max(1, CELLS // dims)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                terms = batch.column(1)
                size = np.diff(np.asarray(terms.offsets, dtype=np.int64))
                coded = terms.flatten().dictionary_encode()
                if len(known) > KNOWN:
                    known.clear()
                hashed = [known.get(x) or known.setdefault(x, hashed_term(x, dims)) for x in coded.dictionary.to_pylist()]
                slot, sign = np.array([h[0] for h in hashed], dtype=np.int64), np.array([h[1] for h in hashed])
                which = np.asarray(coded.indices, dtype=np.int64)
                row = np.repeat(np.arange(len(size)), size)
                sums = np.bincount(row * dims + slot[which], weights=sign[which], minlength=len(size) * dims).astype(np.float64).reshape(len(size), dims)
                norm = np.sqrt((sums**2).sum(axis=1, keepdims=True))
                unit = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).astype(np.float32)
                values = pa.ListArray.from_arrays(pa.array(np.arange(len(size) + 1, dtype=np.int32) * dims), pa.array(unit.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), values, pa.array(size)], [key, "values", "n_terms"])

    schema = T.StructType([listed.schema[key], T.StructField("values", T.ArrayType(T.FloatType())), T.StructField("n_terms", T.LongType())])
    return listed.mapInArrow(task, schema)


def hashed_term(term: str, dims: int) -> tuple[int, float]:
    """What hash_slot and hash_sign say of a term."""
    first = int.from_bytes(hashlib.sha256(term.encode()).digest()[:8], "big")
    return first % dims, 1.0 if first % 2 == 0 else -1.0


def embed_representations(representations: DataFrame, embedder: Embedder, batch: int = 64) -> DataFrame:
    """representation_id, values and model from an embedder, in batches of Arrow rows; checked on the way."""

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for start in range(0, len(frame), batch):
                part = frame.iloc[start : start + batch]
                values = np.asarray(embedder.embed(part["text"].tolist()), dtype=np.float32)
                if values.ndim != 2 or len(values) != len(part):
                    raise ContractError("the embedder returned another number of vectors")
                if not np.isfinite(values).all():
                    raise ContractError("the embedder returned a value that is not finite")
                yield pd.DataFrame({"representation_id": part["id"].tolist(), "values": list(values), "model": embedder.model})

    return representations.select("id", "text").mapInPandas(task, "representation_id string, values array<float>, model string")


def vector_problems(vectors: DataFrame, representations: DataFrame | None = None) -> DataFrame:
    """(representation_id, problem): values not finite, sizes or models that differ, ids repeated or unknown."""
    size, n = F.size("values"), F.count("*")
    most = vectors.groupBy("model", size.alias("dims")).agg(n.alias("n")).agg(F.max_by(F.struct("model", "dims"), F.struct("n", "model", "dims")).alias("usual"))
    checked = vectors.crossJoin(F.broadcast(most))
    rows = checked.select("representation_id", F.explode(F.array_compact(F.array(
        F.when(~v.is_finite("values"), "value not finite"),
        F.when(size != F.col("usual.dims"), "dimensions differ"),
        F.when(F.col("model") != F.col("usual.model"), "model differs"),
    ))).alias("problem"))
    twice = vectors.groupBy("representation_id").count().where("count > 1").select("representation_id", F.lit("repeated").alias("problem"))
    out = rows.unionByName(twice)
    if representations is not None:
        unknown = vectors.join(representations.select(F.col("id").alias("representation_id")), "representation_id", "left_anti")
        out = out.unionByName(unknown.select("representation_id", F.lit("unknown representation").alias("problem")))
    return out
