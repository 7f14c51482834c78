"""Clusters against brute force in integers: ties, repeats, empty clusters, rows that are not kept."""

import hashlib
import math
import random

import numpy as np
import pytest

from lodestack.llm import centroids as c

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k, rounds, salt="2"):
    """rows: (id, integer vector). Returns clusters, squared distances and centroids, row by row."""
    name = lambda r: hashlib.sha256(f"{salt}:{r[0]}".encode()).hexdigest()
    at = [list(x) for _, x in sorted((r for r in rows), key=lambda r: (r[0] is None, "" if r[0] is None else name(r), r[1]))[:k]]
    square = lambda x, y: sum((p - q) ** 2 for p, q in zip(x, y, strict=True))
    assign = lambda: [min((square(x, y), j) for j, y in enumerate(at)) for _, x in rows]
    for _ in range(rounds):
        own = assign()
        for j in range(len(at)):
            mine = [x for (_, x), (_, i) in zip(rows, own, strict=True) if i == j]
            if mine:
                at[j] = [sum(col) // len(mine) for col in zip(*mine, strict=True)]
    return assign(), at


def made(spark, vectors):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0) for i, v in vectors], SCHEMA)


@pytest.mark.parametrize("spread", [3, 40])
def test_equals_brute_force(spark, spread):
    rng = random.Random(spread)
    middles = [[rng.uniform(-2, 2) for _ in range(6)] for _ in range(9)]
    vectors = [(i, [x + rng.randrange(-spread, spread) / 256 for x in middles[i % 9]]) for i in range(600)]
    vectors += [(i, vectors[i][1]) for i in range(40)] + [(700 + i, vectors[5][1]) for i in range(200)] + [(None, middles[0]), (None, middles[1])]
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in vectors]
    out, centroids = c.cluster(made(spark, vectors), k=15, rounds=4, size=6)
    want, at = brute(kept, 15, 4)
    assert centroids.tolist() == at
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["distance"], r["cluster"]) for r in out.collect())
    assert got == sorted((i is None, i or 0, d, j) for (i, _), (d, j) in zip(kept, want, strict=True))
    row = out.first()
    assert row["inertia"] == sum(d for d, _ in want) and row["cluster_inertia"] == sum(d for d, j in want if j == row["cluster"])
    assert row["centroid_sha256"] == hashlib.sha256(",".join(map(str, at[row["cluster"]])).encode()).hexdigest()


def test_ball_leaves_centroids_out():
    rng = np.random.default_rng(1)
    centroids = rng.integers(-4000, 4000, size=(60, 8))
    x = centroids[rng.integers(0, 60, 3000)] + rng.integers(-60, 60, size=(3000, 8))
    none = (np.full(3000, -1), np.zeros(3000), np.zeros(3000))
    cluster, square, upper, lower, taken = c.Exponion(centroids).search(x, *none)
    assert (taken == 60).all()
    moved = centroids + rng.integers(-200, 200, size=centroids.shape)
    squares = ((x[:, None, :] - moved[None]) ** 2).sum(axis=2)
    search = c.Exponion(moved, centroids)
    again, square, upper, lower, taken = search.search(x, cluster, upper, lower)
    assert (again == squares.argmin(axis=1)).all() and (square == squares.min(axis=1)).all()
    assert taken.mean() < 12
    second = np.sqrt(np.partition(squares, 1, axis=1)[:, 1])
    assert (upper >= np.sqrt(squares.min(axis=1))).all() and (lower <= second).all()
    assert (search.search(x, cluster, *none[1:], measured=False)[1][taken > 1] >= 0).all()


def test_ties_on_the_rim_go_to_the_smaller_number():
    # the vector lies in the middle of four centroids, its own being the last one
    centroids = np.array([[4, 0], [-4, 0], [0, 4], [0, -4]])
    x = np.zeros((1, 2), dtype=np.int64)
    found = c.Exponion(centroids).search(x, np.array([3]), np.array([4.0]), np.array([0.0]))
    assert found[0].tolist() == [0] and found[1].tolist() == [16]
    same = np.array([[1, 1], [1, 1], [1, 1]])
    assert c.Exponion(same).search(x, np.array([2]), np.array([9.0]), np.array([0.0]))[0].tolist() == [0]


def test_what_is_not_kept(spark):
    inf = float("inf")
    vectors = [(0, [1, 2]), (1, None), (2, []), (3, [1]), (4, [1, None]), (5, [1, float("nan")]), (6, [inf, 1]), (7, [1, -inf]), (8, [1, 2, 3]), (9, [-0.001, 0.999])]
    found = made(spark, vectors).selectExpr("*", "'x' AS cluster", "'y' AS __x")
    out, centroids = c.cluster(found, k=5, rounds=2, size=2)
    assert {r["vec_id"] for r in out.collect()} == {0, 9} and len(centroids) == 2
    assert sorted(r["__x"] for r in c.quantised(made(spark, vectors), size=2).collect()) == [[-1, 255], [256, 512]]
    assert set(out.columns) == {"vec_id", "embedding", "label", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "evaluated"}
    empty, none = c.cluster(made(spark, vectors).limit(0), k=5, size=2)
    assert empty.count() == 0 and len(none) == 0 and dict(empty.dtypes)["distance"] == "bigint"
    with pytest.raises(Exception, match="64 bits"):
        c.cluster(made(spark, [(0, [1e30, 0])]), k=1, size=2)[0].collect()
