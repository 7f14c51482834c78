"""Vector search over all queries at once: exact, and by cells around centroids with exact rescoring."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.functions import vectors as v
from lodestack.operators.best import BEST, KEYS, Best
from lodestack.operators.common import top_k
from lodestack.operators.lexical import as_hits

#: Queries that are sent to every task at once, at most; more are dealt into blocks and meet the vectors there.
QUERY_BLOCK = 4096
#: Vectors that meet one block of queries in one group, on average and at most about twice.
INDEX_BLOCK = 50_000
#: Scores that are held at once: vectors are taken in slices.
CELLS = 4_000_000
#: Vectors that centroids are fitted on, at most (those of least hash), and centroids, at most.
SAMPLE = 40_000
CENTROIDS = 4_096


def entries(vectors: DataFrame, representations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Vectors with the chunk and document they stand for."""
    reps = representations.select(F.col("id").alias("representation_id"), "chunk_id")
    return vectors.join(reps, "representation_id").join(chunks.select(F.col("id").alias("chunk_id"), "document_id"), "chunk_id")


def _matrix(values) -> np.ndarray:
    return np.stack(list(values)).astype(np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m**2).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _add(best: Best, frame: pd.DataFrame, unit: np.ndarray) -> None:
    """Cosines of a frame's vectors to unit queries, a slice of the frame at a time."""
    step = max(1, CELLS // max(1, len(unit)))
    for start in range(0, len(frame), step):
        part = frame.iloc[start : start + step]
        best.add(np.round(_unit(_matrix(part["values"])) @ unit.T, 12), part[KEYS])


def _ranked(rows: DataFrame, k: int, channel: str) -> DataFrame:
    order = [F.col("cut").desc(), *[F.col(c) for c in KEYS]]
    return as_hits(top_k(rows, k, order), channel)


def exact(index: DataFrame, queries: DataFrame, k: int, channel: str = "vector") -> DataFrame:
    """The k nearest of each query by cosine, zero and negative scores kept.

    index: representation_id, chunk_id, document_id, values; queries: query_id, values. Each task scores
    its vectors against the queries by one matrix product and keeps its own k best, so what is
    shuffled is k rows a task and query, whatever the index holds. Up to QUERY_BLOCK queries are sent to the
    tasks; more are dealt into blocks, and each block meets a copy of the index, in groups of bounded size.
    """
    n = queries.count()
    queries = queries.select("query_id", "values")
    index = index.select("representation_id", "chunk_id", "document_id", "values")
    if n > QUERY_BLOCK:
        blocks, salts = -(-n // QUERY_BLOCK), max(1, -(-index.count() // INDEX_BLOCK))
        left = index.withColumn("salt", F.pmod(F.xxhash64("representation_id"), F.lit(salts))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        right = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        return _ranked(_met(left, right, ["block", "salt"], k), k, channel)
    rows = queries.collect()
    ids, unit = [r[0] for r in rows], _unit(_matrix([r[1] for r in rows])) if rows else np.zeros((0, 0))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = Best(ids, k)
        for frame in frames:
            if len(frame) and ids:
                _add(best, frame, unit)
        if (found := best.rows()) is not None:
            yield found

    return _ranked(index.mapInPandas(task, BEST), k, channel)


def _met(index: DataFrame, queries: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of the index rows and queries that share the columns of by; both sides of a group are bounded."""

    def task(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        best = Best(asked["query_id"].tolist(), k)
        if len(rows) and len(asked):
            _add(best, rows, _unit(_matrix(asked["values"])))
        found = best.rows()
        return pd.DataFrame(columns=[c.split()[0] for c in BEST.split(", ")]) if found is None else found

    return index.groupBy(*by).cogroup(queries.groupBy(*by)).applyInPandas(task, BEST)


def exact_expression(index: DataFrame, queries: DataFrame, k: int, channel: str = "vector") -> DataFrame:
    """The same without Python, for few queries: each is compared with every vector. More than QUERY_BLOCK are an error."""
    if queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        raise ValueError(f"more than {QUERY_BLOCK} queries: use exact")
    pairs = index.join(F.broadcast(queries.select("query_id", F.col("values").alias("q"))), how="cross")
    scored = pairs.select("query_id", "representation_id", "chunk_id", "document_id", v.cosine("values", "q").alias("score"))
    return as_hits(top_k(scored, k), channel)


def sampled(index: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Unit vectors of the `sample` rows of least hash, each direction once."""
    # as Arrow: rows of Python numbers would hold many times the driver's memory
    rows = index.select("values").orderBy(F.xxhash64("representation_id"), "representation_id").limit(sample).toArrow().column(0).combine_chunks()
    return np.unique(_unit(np.asarray(rows.flatten(), dtype=np.float64).reshape(len(rows), -1)), axis=0) if len(rows) else np.zeros((0, 0))


def centroids(m: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids by spherical k-means over a sample."""
    rng = np.random.default_rng(3)
    found = m[rng.choice(len(m), min(n, len(m)), replace=False)]
    for _ in range(rounds):
        own = _nearest(m, found, 1)[:, 0]
        sums = np.zeros_like(found)
        np.add.at(sums, own, m)
        found = np.where((np.bincount(own, minlength=len(found)) > 0)[:, None], _unit(sums), found)
    return found


def probes_for(m: np.ndarray, centers: np.ndarray, k: int, recall: float, tried: int = 200) -> int:
    """The fewest nearest cells that hold the share `recall` of the k nearest of some of the sample's own vectors.

    Neighbours in a sample lie further apart than in the whole index, so the whole asks for no more cells."""
    asked = m[np.random.default_rng(5).choice(len(m), min(tried, len(m)), replace=False)]
    scores = asked @ m.T
    near = np.argpartition(-scores, min(k, len(m) - 1), axis=1)[:, : k + 1]  # itself and k others
    order = np.argsort(_nearest(asked, centers, len(centers)), axis=1)  # cell -> how manieth nearest
    place = np.sort(np.take_along_axis(order, _nearest(m, centers, 1)[:, 0][near], axis=1), axis=None)
    return int(place[min(len(place) - 1, int(np.ceil(recall * len(place))))]) + 1


def _nearest(m: np.ndarray, found: np.ndarray, n: int) -> np.ndarray:
    """Numbers of the n nearest centroids of each row, nearest first, equal ones by number."""
    out = []
    step = max(1, CELLS // len(found))
    for start in range(0, len(m), step):
        score = np.round(m[start : start + step] @ found.T, 9)
        out.append(np.argsort(-score, axis=1, kind="stable")[:, :n])
    return np.concatenate(out)


def approximate(index: DataFrame, queries: DataFrame, k: int, recall: float = 0.95, cells: int = 0, sample: int = SAMPLE, channel: str = "vector") -> DataFrame:
    """Approximate neighbours: a vector lies in the cell of its nearest centroid; a query meets the vectors of
    its nearest cells and scores those exactly.

    How many cells a query looks into is measured: as few as give the wanted recall on a bounded sample. Vectors
    in clusters need few; vectors without any structure need most cells, and exact search is then as cheap.
    cells: about four times the square root of the index by default. Cells are counted, and large ones are
    dealt into several groups, each of which the queries meet; so are queries beyond QUERY_BLOCK in a cell.
    """
    index = index.select("representation_id", "chunk_id", "document_id", "values")
    queries = queries.select("query_id", "values")
    m = sampled(index, sample)
    if not len(m):
        return _ranked(index.sparkSession.createDataFrame([], BEST), k, channel)
    centers = centroids(m, cells or max(1, min(CENTROIDS, int(4 * index.count() ** 0.5))))
    probes = probes_for(m, centers, k, recall)

    def placed(df: DataFrame, n: int) -> DataFrame:
        def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                if len(frame):
                    frame["cells"] = list(_nearest(_unit(_matrix(frame["values"])), centers, n).astype(np.int32))
                    yield frame

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", cells array<int>"
        return df.mapInPandas(task, schema).select(*df.columns, F.explode("cells").alias("cell"))

    def lanes(df: DataFrame, most: int):
        held = {r[0]: r[1] for r in df.groupBy("cell").count().collect()}
        return F.element_at(F.array(*[F.lit(max(1, -(-held.get(c, 0) // most))) for c in range(len(centers))]), F.col("cell") + 1)

    left, right = placed(index, 1), placed(queries, probes)
    salts, blocks = lanes(left, INDEX_BLOCK), lanes(right, QUERY_BLOCK)
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    left = left.withColumn("salt", F.pmod(F.xxhash64("representation_id"), salts).cast("int")).withColumn("block", every(blocks))
    right = right.withColumn("block", F.pmod(F.xxhash64("query_id"), blocks).cast("int")).withColumn("salt", every(salts))
    return _ranked(_met(left, right, ["cell", "salt", "block"], k), k, channel)


def identity(vectors: DataFrame) -> DataFrame:
    """(model, dims, n) groups; an index must have one."""
    return vectors.groupBy("model", F.size("values").alias("dims")).agg(F.count("*").alias("n"))
