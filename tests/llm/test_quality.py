"""Counts of texts, the fitted model and the filter."""

import math
import random
import re
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.llm import quality_rules as q

from .conftest import EDGE

TEXT = st.lists(st.sampled_from(list("ab \n\t.#|") + ["aa ", "b. "]), max_size=80).map("".join)


def brute(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    n = len(words)
    windows = Counter(tuple(words[k : k + 5]) for k in range(n - 4))
    covered = {k + j for k in range(n - 4) for j in range(5) if windows[tuple(words[k : k + 5])] > 1}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@given(TEXT)
@settings(max_examples=300, deadline=None)
def test_counts(text):
    assert q.text_counts(text)[:5] == brute(text)


def test_model_finds_faults_and_keeps_prose(spark, make):
    prose = [" ".join(f"word{i}x{j}" for j in range(40)) + "." for i in range(200)]
    junk = [" ".join(f"w{i}q{j}***" for j in range(40)) for i in range(15)] + [" ".join(f"LOUD{i}X{j}!!" for j in range(40)) for i in range(15)]
    docs = make(prose + junk + EDGE, clash=("n_words", "kept"))
    kept = {r["doc_id"] for r in q.keep_good(docs).collect()}
    assert set(range(200)) <= kept and not kept & set(range(200, 230))
    assert q.keep_good(docs).columns == docs.columns
    assert q.keep_good(docs.limit(0)).count() == 0


def brute_posteriors(votes, names):
    """Posteriors of documents by expectation-maximisation, document by document."""
    before = {k: q.BEFORE.get(k, q.BEFORE_FAULT) for k in names}
    weights = {k: [math.log(good / bad) for good, bad in zip(*before[k])] for k in names}
    prior, n = 1.0, len(votes)
    for _ in range(50):
        good = [1 / (1 + math.exp(-(prior + sum(weights[k][v[k] + 1] for k in names)))) for v in votes]
        prior = math.log((sum(good) + 1) / (n - sum(good) + 1))
        for k in names:
            shares = []
            for of, start in ((good, before[k][0]), ([1 - x for x in good], before[k][1])):
                held = [sum(x for x, v in zip(of, votes) if v[k] + 1 == j) + q.STRENGTH * n * start[j] for j in range(3)]
                shares.append([x / sum(held) for x in held])
            odds = [math.log(a / b) for a, b in zip(*shares)]
            weights[k] = [min(odds[0], 0), max(-1, min(1, odds[1])), max(odds[2], 0)]
    return [1 / (1 + math.exp(-(prior + sum(weights[k][v[k] + 1] for k in names)))) for v in votes]


def test_verdicts_by_brute_force(spark, make):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(200)]

    def text():
        out = [rng.choice(words) for _ in range(rng.randint(8, 90))]
        if rng.random() < 0.1:
            out = [w + rng.choice(["***", "", "#"]) for w in out]
        if rng.random() < 0.1:
            out = [w.upper() for w in out]
        if rng.random() < 0.1:
            out += out[:12] * 2
        return rng.choice([" ", " ", " ", "\n"]).join(out) + rng.choice([".", ".", "", "\n"])

    docs = make([text() for _ in range(300)] + EDGE)
    names = list(q.votes())
    voted = q.with_votes(q.with_counts(docs, ["doc_id"]))
    rows = q.judge(voted, q.fit(voted, names)).collect()
    want = brute_posteriors([{k: r[f"vote_{k}"] for k in names} for r in rows], names)
    for r, x in zip(rows, want):
        assert r["quality"] == pytest.approx(x, abs=1e-6)
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and r["quality"] >= 0.5)
    assert 50 < sum(r["kept"] for r in rows) < 290
    # the pipeline's filter decides alike, whatever the columns are called
    clash = docs.withColumns({c: F.lit("x") for c in ("n_words", "vote_prose", "__votes", "quality")})
    assert {r["doc_id"] for r in q.keep_good(clash).collect()} == {r["doc_id"] for r in rows if r["kept"]}


def test_very_long_text(make):
    text = "some plain words of a text. " * 40_000
    (row,) = q.with_counts(make([text]), ["doc_id"]).collect()
    assert row["n_words"] == 240_000 and row["n_repeat_words"] == 240_000


def test_null_and_empty_texts_have_no_counts(make):
    rows = q.with_counts(make([None, "", " \n"]), ["doc_id"]).collect()
    assert all(r[c] == 0 for r in rows for c in q.COUNTS)


def test_fit_of_no_patterns_is_the_start():
    model = q.fit_patterns([], list(q.FAULTS))
    assert model["prior"] == 1.0 and len(model["weights"]) == len(q.FAULTS)
