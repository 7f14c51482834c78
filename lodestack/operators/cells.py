"""A stored vector index: cells around centroids, short codes by product quantisation, exact rescoring.

Centroids and codebooks are fitted once, on a bounded sample, and stored with the index: opening it fits nothing. A
vector lies in the cell of its nearest centroid; what is left of it is cut into parts, each replaced by the number
of its nearest codeword. Rows are Parquet partitioned by cell, so that a search reads the folders of the cells that its
queries look into. There it reads codes (a byte a part), keeps the best of each query by the cosine that they
stand for, and reads the vectors of that shortlist only, for their exact cosines.

An index is of one model and one number of dimensions, which a search must name. How many cells a query looks into
is measured when the index is made: as few as give the wanted recall on the sample.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators import vector_search as vs
from lodestack.operators.best import BEST, KEYS, Best
from lodestack.operators.common import ContractError, saved, scratch, top_k
from lodestack.operators.lexical import as_hits

VERSION = 1
#: Codewords of a part, at most: their number is a byte.
CODEWORDS = 256
#: Rows of a query's shortlist for each hit that is wanted, and at least.
SHORTLIST, LEAST_SHORTLIST = 10, 100


#: Stored tables.
QUANTISER = "kind string, number int, word int, values array<double>"
FITTED = ("kind", "number", "word")
ROW = "document_id string, chunk_id string, representation_id string, values array<double>, codes binary, cell int"


@dataclass
class Cells:
    """rows: ids, values, codes and cell, as stored; centers and books (part, codeword, value): the quantiser."""

    path: str
    rows: DataFrame
    centers: np.ndarray
    books: np.ndarray
    manifest: dict


def codebooks(residuals: np.ndarray, parts: int, rounds: int = 8) -> np.ndarray:
    """Codewords of each part by k-means over a sample's residuals; codewords that none is nearest to stay as they were."""
    rng = np.random.default_rng(7)
    out = []
    for x in np.split(residuals, parts, axis=1):
        x = np.ascontiguousarray(x)
        found = x[rng.choice(len(x), min(CODEWORDS, len(x)), replace=False)]
        for _ in range(rounds):
            own = _nearest_word(x, found)
            n = np.bincount(own, minlength=len(found))
            sums = np.zeros_like(found)
            np.add.at(sums, own, x)
            found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
        out.append(found)
    return np.stack(out)


def _nearest_word(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.concatenate([np.argmin((words**2).sum(axis=1) - 2 * part @ words.T, axis=1) for part in np.array_split(x, max(1, len(x) // 4096))]) if len(x) else np.zeros(0, dtype=np.int64)


def encoded(unit: np.ndarray, centers: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cells of unit vectors, and their codes (a byte a part)."""
    cell = vs._nearest(unit, centers, 1)[:, 0]
    rest = np.split(unit - centers[cell], len(books), axis=1)
    return cell, np.stack([_nearest_word(x, words) for x, words in zip(rest, books, strict=True)], axis=1).astype(np.uint8)


def build_cells(vectors: DataFrame, path: str, model: str, parts: int = 16, cells: int = 0, recall: float = 0.95, k: int = 10, sample: int = vs.SAMPLE) -> Cells:
    """Write an index of vectors (representation_id, chunk_id, document_id, values), all of one length.

    cells: about four times the square root of the index by default. recall and k: what a search is to reach where it
    does not name how many cells it looks into."""
    from lodestack.sources.bundle import exists, write_json
    from lodestack.sources.corpus import table_tree

    spark = vectors.sparkSession
    if exists(spark, f"{path}/manifest.json"):
        raise ContractError(f"{path} holds an index")
    lengths = [r[0] for r in vectors.select(F.size("values").alias("n")).distinct().limit(2).collect()]
    if len(lengths) > 1 or (lengths and (lengths[0] < 1 or lengths[0] % parts)):
        raise ContractError(f"vectors need one length, a multiple of {parts}")
    dims = lengths[0] if lengths else parts
    m = vs.sampled(vectors, sample)
    m = m if len(m) else np.zeros((1, dims))
    centers = vs.centroids(m, cells or max(1, min(vs.CENTROIDS, int(4 * vectors.count() ** 0.5))))
    books = codebooks(m - centers[vs._nearest(m, centers, 1)[:, 0]], parts)
    probes = vs.probes_for(m, centers, k, recall)
    names = [c.split()[0] for c in ROW.split(", ")]

    def task(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = vs._unit(_dense(batch.column(3), dims))
            cell, codes = encoded(unit, centers, books)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(cell, pa.int32())], names)

    placed = vectors.select(*[F.col(c).cast("string").alias(c) for c in KEYS], F.col("values").cast("array<double>").alias("values")).mapInArrow(task, ROW)
    # by range: a cell that holds a large share of the rows is dealt over several tasks
    placed.repartitionByRange("cell", F.xxhash64("representation_id")).sortWithinPartitions("cell").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    quantiser = [("center", i, 0, x.tolist()) for i, x in enumerate(centers)] + [("word", i, j, x.tolist()) for i, words in enumerate(books) for j, x in enumerate(words)]
    fitted = table_tree(saved(spark.createDataFrame(quantiser, QUANTISER).coalesce(1), f"{path}/quantiser"), *FITTED)
    tree = table_tree(spark.read.schema(ROW).parquet(f"{path}/rows"), "representation_id")
    manifest = {"version": VERSION, "model": model, "dimensions": dims, "cells": len(centers), "parts": parts, "probes": probes, "recall": recall, "rows": tree.rows, "digest": tree.root, "quantiser": fitted.root}
    write_json(spark, f"{path}/manifest.json", manifest)
    return open_cells(spark, path, model, dims if lengths else None)


def _dense(values: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(values.flatten(), dtype=np.float64).reshape(len(values), dims)


def open_cells(spark: SparkSession, path: str, model: str, dimensions: int | None = None, check: bool = False) -> Cells:
    """The index under path, of that model and number of dimensions; its rows are only read and digested with check."""
    from lodestack.sources.bundle import read_json
    from lodestack.sources.corpus import table_tree

    m = read_json(spark, f"{path}/manifest.json")
    if m.get("version") != VERSION:
        raise ContractError("unknown index version")
    if m["model"] != model:
        raise ContractError(f"the index was embedded by {m['model']!r}, not {model!r}")
    if dimensions is not None and m["dimensions"] != dimensions:
        raise ContractError(f"the index has {m['dimensions']} dimensions, not {dimensions}")
    rows = spark.read.schema(ROW).parquet(f"{path}/rows")
    quantiser = spark.read.schema(QUANTISER).parquet(f"{path}/quantiser")
    if check and (table_tree(rows, "representation_id").root != m["digest"] or table_tree(quantiser, *FITTED).root != m["quantiser"]):
        raise ContractError("the index differs from its digest")
    # at most CENTROIDS centers and CODEWORDS words a part
    read = quantiser.collect()
    centers = np.array([r["values"] for r in sorted((r for r in read if r["kind"] == "center"), key=lambda r: r["number"])])
    words = sorted((r for r in read if r["kind"] == "word"), key=lambda r: (r["number"], r["word"]))
    books = np.array([r["values"] for r in words]).reshape(m["parts"], -1, m["dimensions"] // m["parts"])
    return Cells(path, rows, centers, books, m)


def probed(index: Cells, queries: np.ndarray, probes: int = 0) -> np.ndarray:
    """The cells that each query (a row of numbers) looks into."""
    return vs._nearest(vs._unit(queries), index.centers, min(probes or index.manifest["probes"], len(index.centers)))


def search_cells(index: Cells, queries: DataFrame, k: int, model: str, probes: int = 0, shortlist: int = 0, channel: str = "vector") -> DataFrame:
    """Approximate neighbours of queries (query_id, values). probes: cells that a query looks into, instead of the measured number.

    All cells and a shortlist of all rows would give the exact result. Queries beyond QUERY_BLOCK go in blocks."""
    if model != index.manifest["model"]:
        raise ContractError(f"the index was embedded by {index.manifest['model']!r}, not {model!r}")
    blocks = max(1, -(-queries.count() // vs.QUERY_BLOCK))
    numbered = queries.select("query_id", F.col("values").cast("array<double>").alias("values")).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = _search_block(index, numbered.where(F.col("block") == b).select("query_id", "values").collect(), probes, shortlist or max(LEAST_SHORTLIST, SHORTLIST * k))
        out = part if out is None else out.unionByName(part)
    return as_hits(top_k(out, k, [F.col("cut").desc(), *[F.col(c) for c in KEYS]]), channel)


def _search_block(index: Cells, asked: list, probes: int, shortlist: int) -> DataFrame:
    spark = index.rows.sparkSession
    dims = index.manifest["dimensions"]
    if wrong := [r["query_id"] for r in asked if len(r["values"]) != dims]:
        raise ContractError(f"queries of another length than {dims}: {', '.join(map(str, wrong[:5]))}")
    if not asked:
        return spark.createDataFrame([], BEST)
    ids = [str(r["query_id"]) for r in asked]
    unit = vs._unit(np.array([r["values"] for r in asked], dtype=np.float64))
    cells = probed(index, unit, probes)
    looks = np.zeros((len(index.centers), len(ids)), dtype=bool)
    looks[cells.ravel(), np.repeat(np.arange(len(ids)), cells.shape[1])] = True
    wanted = np.flatnonzero(looks.any(axis=1)).tolist()
    near = index.centers @ unit.T
    # for each part, codeword and query: what the codeword adds to the cosine
    adds = np.stack([words @ q.T for words, q in zip(index.books, np.split(unit, len(index.books), axis=1), strict=True)])

    def coarse(batches):
        best = Best(ids, shortlist)
        step = max(1, vs.CELLS // len(ids))
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                part = batch.slice(start, step)
                cell = np.asarray(part.column(4))
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), dtype=np.uint8).reshape(part.num_rows, -1)
                scores = np.full((part.num_rows, len(ids)), -np.inf)
                for c in np.unique(cell).tolist():
                    at, who = np.flatnonzero(cell == c), np.flatnonzero(looks[c])
                    own = np.repeat(near[c, who][None, :], len(at), axis=0)
                    for p in range(codes.shape[1]):
                        own += adds[p][codes[at, p]][:, who]
                    scores[np.ix_(at, who)] = own
                best.add(scores, part.select(KEYS).to_pandas(), np.isfinite(scores))
        if (found := best.rows()) is not None:
            yield pa.RecordBatch.from_pandas(found, preserve_index=False)

    codes = index.rows.where(F.col("cell").isin(wanted)).select(*KEYS, "codes", "cell")
    best = top_k(codes.mapInArrow(coarse, BEST), shortlist, [F.col("cut").desc(), *[F.col(c) for c in KEYS]]).select("query_id", *KEYS)
    # written, so that the planner knows its size: vectors are shuffled only where the shortlists are large too
    listed = saved(best, scratch(spark, "shortlist"))
    number = {q: i for i, q in enumerate(ids)}

    def exact(frames):
        for frame in frames:
            if len(frame):
                x = vs._unit(vs._matrix(frame["values"]))
                score = np.round((x * unit[[number[q] for q in frame["query_id"]]]).sum(axis=1), 12)
                yield pd.DataFrame({"query_id": frame["query_id"], **{c: frame[c] for c in ("representation_id", "chunk_id", "document_id")}, "score": score, "cut": np.round(score, 9) + 0.0})

    vectors = index.rows.where(F.col("cell").isin(wanted)).select(*KEYS, "values")
    return listed.join(vectors, KEYS).select("query_id", *KEYS, "values").mapInPandas(exact, BEST)
