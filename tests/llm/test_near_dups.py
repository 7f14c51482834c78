"""Near-duplicates against brute force on full sets, with hubs, chains, blocks and edge rows."""

import math
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import near_dups as nd
from lodestack.llm.common import Workspace, spread_join
from lodestack.llm.components import components

from .conftest import EDGE

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sets_of(text, size):
    words = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    return {tuple(words[k : k + size]) for k in range(len(words) - size + 1)} if len(words) >= size else ({tuple(words)} if words else set())


def brute(rows, size, percent):
    sets = {i: sets_of(t, size) for i, t in rows if i is not None}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            p, q = find(a), find(b)
            up[max(p, q)] = min(p, q)
    return {i: (len(s), find(i), find(i) == i) for i, s in sets.items()}


def corpus(seed=5):
    """Families of edited copies of a few texts, spread over similarities around the threshold."""
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for family in range(6):
        base = rng.choices(vocabulary, k=rng.choice([12, 60, 150]))
        for _ in range(25):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 25))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(" ".join(words))
    rows += [" ".join(rng.choices(vocabulary, k=40)) for _ in range(40)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size,percent,block,local", [(3, 85, 512, None), (5, 80, 16, None), (3, 85, 16, 0)])
def test_against_brute_force(make, monkeypatch, size, percent, block, local):
    monkeypatch.setattr(nd, "BLOCK", block)
    monkeypatch.setattr(nd, "SIGNATURES", (block // 2, block))
    rows = list(enumerate(corpus() + EDGE))
    docs = make(rows + [(None, "no id here at all"), (None, "no id here at all")], clash=("set_key", "kept"))
    got = nd.near_duplicates(docs, size, percent, local_links=local).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None} == brute(rows, size, percent)
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)] * 2


def test_keep_first_keeps_one_of_each(make):
    rows = [(3, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "other words that are quite different here"), (None, "one two three four five six"), (9, None), (8, "")]
    kept = nd.keep_first(make(rows, clash=("component_id",)))
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 1), (False, 2), (False, 8), (False, 9), (True, 0)]
    assert nd.near_duplicates(make([]), 3, 85).count() == 0


def test_estimate_follows_similarity():
    rng = np.random.default_rng(1)
    for share in (0.5, 0.85, 0.95):
        a = rng.integers(0, 2**64, 2000, dtype=np.uint64)
        n = int(len(a) * 2 * share / (1 + share))
        b = np.concatenate([a[:n], rng.integers(0, 2**64, len(a) - n, dtype=np.uint64)])
        sig = [np.frombuffer(nd.pack(nd.minima(x)), dtype="<u8") for x in (a, b)]
        assert abs(float(nd.estimate(*sig)) - share) < 0.15
        assert nd.linked(np.sort(a), np.sort(b), 85) == (share >= 0.85 and n / (2 * len(a) - n) >= 0.85)


@pytest.mark.parametrize("percent", [50, 80, 85])
def test_estimate_drops_pairs_at_the_threshold_as_rarely_as_stated(percent):
    p = 1 / 16 + 15 / 16 * percent / 100
    lowest = nd.lowest_estimate(percent)
    dropped = [k for k in range(129) if (k / 128 - 1 / 16) / (15 / 16) < lowest]
    assert 1e-7 < sum(math.comb(128, k) * p**k * (1 - p) ** (128 - k) for k in dropped) <= 3e-6


@pytest.mark.parametrize("local", [0, 10_000])
def test_components_of_chains_and_stars(spark, local):
    links = [(i, i + 1) for i in range(10, 40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (200, 201), (201, 200)]
    df = spark.createDataFrame(links, "a long, b long")
    got = {r["id"]: r["component"] for r in components(df, Workspace(spark, "test"), local).collect()}
    assert got == {i: 10 for i in range(10, 41)} | {i: 100 for i in range(100, 120)} | {200: 200, 201: 200}
    assert components(df.limit(0), Workspace(spark, "test"), local).count() == 0


def test_very_long_texts(make):
    words = [f"w{k}" for k in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[:-3000])), (3, " ".join(words[:45_000])), (4, " ".join(words[1:] + ["end"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(make(rows), 3, 85).collect()}
    assert got == {1: (59_998, 1), 2: (56_998, 1), 3: (44_998, 3), 4: (59_998, 1)}


def test_hot_keys_join_as_others_do(spark):
    rows = [(k, f"r{i}") for i in range(400) for k in ((7 if i % 3 else i), None)]
    left = spark.createDataFrame(rows, "k long, r string")
    counts = left.where("k is not null").groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", F.col("k") * 2)
    got = sorted((r["r"], r["k"] or -1, r["n"] or -1, r["v"] or -1) for r in spread_join(left, counts, "k", "n").collect())
    held = {r["k"]: r["n"] for r in counts.collect()}
    assert got == sorted((r, k or -1, held.get(k) or -1, (2 * k if k is not None else None) or -1) for k, r in rows)
