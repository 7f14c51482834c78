"""Centroid clustering in exact integers, by exponion search.

Each vector keeps its centroid, an upper bound of its distance to it and a lower bound of its distance to
every other one. After centroids have moved the bounds are loosened by how far they moved. Where the bounds
do not decide, only centroids inside a ball around the vector's own centroid are met: with u the distance to it
and g its distance to the nearest other centroid, both the nearest and the second nearest centroid lie
within 2u + g of it. The ball's members are a prefix of the centroid's list of the others, sorted by distance.

Distances are squared sums of integers, exact in 64 bits; bounds are their roots, moved outward by more than
what floating point can lose, and a vector is left alone only where its upper bound is strictly below the
other bounds. The ball's radius is inclusive, so that centroids at equal distance are met and the smaller number wins.

A round is one pass over the vectors' table. Sums of components are combined in each task, then by cluster;
only k rows reach the driver. The bounds are written with the vectors, whose previous table then goes.

Defined cases: a null vector, one of another length, or one with a null or non-finite component is not
kept; equal vectors get equal rows, also under one id; null ids are vectors like others, but seeds only
after all that have ids, least components first among equal ones; with fewer vectors than centroids each is a
seed; an empty table gives an empty result; a component beyond LIMIT in size is an error, as distances then leave
64 bits; columns called like results are replaced, others pass through.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import Workspace, regroup

#: Largest size of a component: 1,024 squares of twice as much stay below 2 ** 63.
LIMIT = 1 << 25
#: Bounds are widened by this share, far more than rounding of doubles loses.
SLACK = 1e-12
RESULTS = ("cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated")
OWN = ("__x", "__cluster", "__upper", "__lower")


def quantised(vectors: DataFrame, column: str = "embedding", size: int = 64, scale: int = 256) -> DataFrame:
    """Vectors of that length without null or non-finite components, with __x: floor(scale * component) of each."""
    x = F.col(f"`{column}`")
    whole = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    kept = vectors.where((F.size(x) == size) & whole)
    steps = F.transform(x, lambda v: F.floor(v.cast("double") * scale))
    small = F.forall(steps, lambda v: F.abs(v) <= LIMIT)
    said = F.raise_error(F.lit(f"a component is beyond {LIMIT}: squared distances would not fit 64 bits"))
    return kept.withColumn("__x", F.when(small, F.transform(steps, lambda v: v.cast("int"))).otherwise(said))


def seeds(vectors: DataFrame, k: int, salt: str, key: str = "vec_id") -> np.ndarray:
    """The k vectors with the smallest sha256 of salt:key, in that order."""
    order = [F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256).asc_nulls_last(), F.col("__x")]
    rows = vectors.orderBy(*order).select("__x").limit(k).collect()
    return np.array([r[0] for r in rows], dtype=np.int64)


class Exponion:
    """The search over one set of centroids, and by how much they moved since the bounds were taken."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c = centroids
        k = len(centroids)
        gaps = np.sqrt(np.array([((centroids - c) ** 2).sum(axis=1) for c in centroids], dtype=float)) * (1 - SLACK)
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, axis=1)
        np.fill_diagonal(gaps, np.inf)
        self.nearest = gaps.min(axis=1) if k > 1 else np.full(k, np.inf)
        moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(axis=1).astype(float)) * (1 + SLACK)
        self.moved = moved
        top = np.argsort(-moved, kind="stable")[:2]
        self.others_moved = np.full(k, moved[top[0]])
        self.others_moved[top[0]] = moved[top[1]] if k > 1 else 0.0

    def squares(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((x - self.c[which]) ** 2).sum(axis=1)

    def search(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, measured: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Clusters, squared distances, bounds, and how many distances were taken for each vector.

        A cluster of -1 is a vector without bounds yet: its ball holds all centroids. Unless measured, vectors
        whose bounds decide get -1 as their distance."""
        new = cluster < 0
        own = np.where(new, 0, cluster)
        lower = lower - self.others_moved[own]
        upper = upper + self.moved[own]
        bound = np.maximum(lower, self.nearest[own] / 2)
        met = np.flatnonzero(new | (upper >= bound) | measured)
        out, best, taken = own.copy(), np.full(len(x), -1, dtype=np.int64), np.zeros(len(x), dtype=np.int64)
        best[met], taken[met] = self.squares(x[met], own[met]), 1
        upper[met] = np.sqrt(best[met].astype(float)) * (1 + SLACK)
        # the bound just taken may decide where the loosened one did not
        open_ = np.flatnonzero(new | (upper >= bound))
        if len(open_):
            a = own[open_]
            radius = np.where(new[open_], np.inf, 2 * upper[open_] + self.nearest[a])
            # gaps are rounded down and radii up: what lies on the rim is inside
            many = np.empty(len(open_), dtype=np.int64)
            for c in np.unique(a).tolist():
                at = a == c
                many[at] = np.searchsorted(self.gaps[c], radius[at] * (1 + SLACK), side="right")
            taken[open_] = many
            least = np.full(len(open_), np.iinfo(np.int64).max)
            second, name = least.copy(), np.full(len(open_), len(self.c))
            for place in range(int(many.max())):
                live = np.flatnonzero(many > place)
                j = self.order[a[live], place]
                d = self.squares(x[open_[live]], j)
                wins = (d < least[live]) | ((d == least[live]) & (j < name[live]))
                second[live] = np.where(wins, least[live], np.minimum(second[live], d))
                least[live] = np.where(wins, d, least[live])
                name[live] = np.where(wins, j, name[live])
            out[open_], best[open_] = name, least
            upper[open_] = np.sqrt(least.astype(float)) * (1 + SLACK)
            lower[open_] = np.where(second == np.iinfo(np.int64).max, np.inf, np.sqrt(second.astype(float)) * (1 - SLACK))
        return out, best, upper, lower, taken


def _assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, keep: list[str], last: bool) -> DataFrame:
    """One pass: state with each vector's cluster, bounds, squared distance (whole in the last one) and number of distances taken."""
    has = "__cluster" in state.columns
    rows = state.select(*[F.col(f"`{c}`") for c in keep], "__x", *[F.col(c) if has else F.lit(v).cast(t).alias(c) for c, v, t in (("__cluster", -1, "int"), ("__upper", 0.0, "double"), ("__lower", 0.0, "double"))])
    fields = [*rows.schema.fields, T.StructField("__distance", T.LongType()), T.StructField("__evaluated", T.LongType())]
    schema = T.StructType(fields)
    n = len(keep)

    def task(batches):
        search = Exponion(centroids, before)
        for batch in regroup(batches, 4096, 8_000_000):
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(n).flatten(), dtype=np.int64).reshape(batch.num_rows, -1)
            found, square, upper, lower, taken = search.search(x, np.asarray(batch.column(n + 1), dtype=np.int64), np.asarray(batch.column(n + 2)), np.asarray(batch.column(n + 3)), last)
            made = [pa.array(found, pa.int32()), pa.array(upper), pa.array(lower), pa.array(square), pa.array(taken)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: n + 1], *made], [f.name for f in fields])

    return rows.mapInArrow(task, schema)


def _totals(state: DataFrame, size: int) -> dict[int, tuple[int, list[int]]]:
    """Vectors and component sums of each cluster: one row a cluster from each task, then one a cluster."""

    def task(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in regroup(batches, 4096, 8_000_000):
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column(1).flatten(), dtype=np.int64).reshape(batch.num_rows, -1)
            cluster = np.asarray(batch.column(0))
            for c in np.unique(cluster).tolist():
                some = x[cluster == c]
                sums[c] = sums.get(c, 0) + np.append(some.sum(axis=0), len(some))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v[:-1].tolist() for v in sums.values()], pa.list_(pa.int64())), pa.array([int(v[-1]) for v in sums.values()], pa.int64())], ["c", "s", "n"])

    parts = state.select("__cluster", "__x").mapInArrow(task, "c int, s array<long>, n long")
    by_place = parts.select("c", "n", F.posexplode("s").alias("i", "s")).groupBy("c", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[int, tuple[int, list[int]]] = {}
    for r in by_place.collect():
        out.setdefault(r["c"], (r["n"], [0] * size))[1][r["i"]] = int(r["s"])
    return out


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", key: str = "vec_id", column: str = "embedding", size: int = 64, scale: int = 256, keep: list[str] | None = None) -> tuple[DataFrame, np.ndarray]:
    """The columns of keep (all) with cluster, distance, cluster_inertia, inertia, centroid_sha256 and evaluated
    (distances that the last pass took for the vector), and the centroids as integers."""
    spark = vectors.sparkSession
    ws = Workspace(spark, "centroids")
    keep = [c for c in (keep or vectors.columns) if c not in RESULTS and c not in OWN]
    wanted = [*keep, *([key] if key not in keep else [])]
    older = "vectors"
    state = ws.save(quantised(vectors, column, size, scale).select(*[F.col(f"`{c}`") for c in wanted], "__x"), older)
    centroids, before = seeds(state, k, salt, key), None
    types = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string", "evaluated": "long"}
    if not len(centroids):
        return state.select(*[F.col(f"`{c}`") for c in keep], *[F.lit(None).cast(t).alias(c) for c, t in types.items()]), centroids
    for step in range(rounds + 1):
        state = ws.save(_assigned(state, centroids, before, wanted, step == rounds), f"round{step}")
        ws.drop(older)
        older = f"round{step}"
        if step == rounds:
            break
        before, centroids = centroids, centroids.copy()
        for c, (n, sums) in _totals(state, size).items():
            centroids[c] = [s // n for s in sums]
    inertia = state.groupBy("__cluster").agg(F.sum(F.col("__distance").cast("decimal(38,0)")).alias("own"))
    found = {r[0]: int(r[1]) for r in inertia.collect()}
    named = [(c, own, sum(found.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, own in found.items()]
    # k rows at most
    told = F.broadcast(spark.createDataFrame(named, "__cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    out = state.join(told, "__cluster", "left")
    return out.select(*[F.col(f"`{c}`") for c in keep], F.col("__cluster").alias("cluster"), F.col("__distance").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256", F.col("__evaluated").alias("evaluated")), centroids
