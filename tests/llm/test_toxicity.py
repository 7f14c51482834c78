"""The chain against brute force over all labellings, and held-out accuracy on invented texts."""

import random
from itertools import product

import numpy as np

from lodestack.llm import toxicity as t

from .conftest import EDGE


def test_marginals_are_exact():
    rng = np.random.default_rng(0)
    trans = rng.normal(size=(2, 2))
    sizes = [0, 1, 5, 2, 7, 0, 3]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    e = rng.normal(size=bounds[-1]) * 2
    got, mass = t.pair_mass(e, bounds, trans)
    want, pairs = np.zeros(len(e)), np.zeros((2, 2))
    for a, b in zip(bounds[:-1], bounds[1:]):
        total, sums, seen = 0.0, np.zeros(b - a), np.zeros((2, 2))
        for y in product((0, 1), repeat=int(b - a)):
            w = np.exp(sum(e[a + k] for k in range(b - a) if y[k]) + sum(trans[y[k], y[k + 1]] for k in range(b - a - 1)))
            total += w
            sums += w * np.array(y)
            for k in range(b - a - 1):
                seen[y[k], y[k + 1]] += w
        if b > a:
            want[a:b] = sums / total
            pairs += seen / total
    assert np.allclose(got, want) and np.allclose(mass, pairs)


def invented(n, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("aeioubcdfgst", k=rng.randint(3, 9))) for _ in range(600)]
    bad = ["zzgrom", "xxlurp", "qqfnord"]
    rows = []
    for i in range(n):
        text = rng.choices(words, k=rng.randint(5, 120))
        toxic = rng.random() < 0.25
        if toxic:
            for _ in range(4):
                text.insert(rng.randrange(len(text)), rng.choice(bad))
        rows.append((i, " ".join(text) + ".", int(toxic)))
    return rows


def test_held_out_accuracy_and_offsets(spark, make):
    rows = invented(1200, 3)
    docs = make([(i, x) for i, x, _ in rows] + [(5000 + i, x) for i, x in enumerate(EDGE)], clash=("score", "spans"))
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    model = t.train(docs, labels)
    got = {r["doc_id"]: r for r in t.score_toxicity(docs.withColumn("held_out", t.held_out()), model).collect()}
    held = [(y, got[i]["predicted"]) for i, _, y in rows if got[i]["held_out"]]
    assert len(held) > 200 and sum(a == b for a, b in held) / len(held) > 0.97
    for i, text, y in rows[:200]:
        marked = {text[s["start"] : s["end"]] for s in got[i]["spans"]}
        assert marked <= {"zzgrom", "xxlurp", "qqfnord"} and (not y or marked)
    assert got[5000]["score"] == got[5001]["score"] < 0.3
    assert t.score_toxicity(docs.limit(0), model).count() == 0
    flat = t.train(docs, labels.limit(0))
    assert {r["score"] for r in t.score_toxicity(docs.limit(5), flat).collect()} == {0.5}


def test_very_long_text_is_scored_whole(spark, make):
    rows = invented(600, 4)
    docs = make([(i, x) for i, x, _ in rows])
    model = t.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    text = "plain words here. " * 60_000 + "zzgrom xxlurp zzgrom."
    (row,) = t.score_toxicity(make([text]), model).collect()
    assert {text[s["start"] : s["end"]] for s in row["spans"]} <= {"zzgrom", "xxlurp"} and row["spans"][-1]["end"] > 1_080_000
