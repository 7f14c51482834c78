"""The tree in parts against the whole tree and its walk, with and without contexts that are too large for a task."""

import collections
import math
import random

import numpy as np
import pytest

from lodestack.llm import branches, queries
from lodestack.llm import suffix_tree as st
from lodestack.llm.common import Workspace

from .conftest import EDGE
from .test_suffix_tree import fitted, invented, walk, words


def parted(spark, docs, **more):
    return branches.scores(docs.repartition(3), Workspace(spark, "test"), **more)


@pytest.mark.parametrize("more", [{}, {"bucket": 500}, {"most": 60, "bucket": 700}, {"most": 9, "bucket": 300}, {"most": 5000}])
def test_parts_are_the_whole(spark, make, monkeypatch, more):
    monkeypatch.setattr(branches, "HEAD", 5)
    docs, tree, out = fitted(spark, make, EDGE + invented(300, 1) + ["a b a b a b"] * 30, clash=("score", "n", "word"))
    whole = {r["doc_id"]: r for r in out.collect()}
    got = parted(spark, docs, **more).collect()
    assert len(got) == len(whole) and sum(level.kept.sum() > 0 for level in tree.levels) >= 2
    for row in got:
        other = whole[row["doc_id"]]
        for c in ("held_out", "n_tokens", "n_known", "train_tokens", "word"):
            assert row[c] == other[c]
        assert math.isclose(row["base_score"], other["base_score"], rel_tol=1e-9)
        assert math.isclose(row["score"], other["score"], rel_tol=1e-9)


def test_rare_words_have_contexts_in_a_large_corpus(spark, make, tmp_path):
    """A pair of words that comes some twenty times among a million tokens: shares of the corpus used to hide it."""
    rng = random.Random(4)
    filler = [" ".join(rng.choices([f"w{k}" for k in range(300)], k=5000)) for _ in range(240)]
    texts = filler + ["zig zag"] * 20
    make(texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op13_lm_scores(spark, str(tmp_path)).where("doc_id >= 240").collect()
    pairs = sum(not r["held_out"] for r in rows)
    tokens = rows[0]["train_tokens"]
    assert len(rows) == 20 and 8 <= pairs < 2e-5 * tokens
    for row in rows:
        # zag after zig, and the end after zag, are near to certain
        assert row["score"] > math.log10((pairs + 1) / (tokens + 304)) - 0.2


def test_edges_of_parts(spark, make):
    docs = make([(None, "a b"), (None, None), (4, "a b c")]).withColumn("held_out", st.held_out())
    rows = parted(spark, docs).collect()
    assert len(rows) == 3 and {r["n_tokens"] for r in rows} == {3, 1, 4}
    assert parted(spark, docs.limit(0)).count() == 0
    (row,) = parted(spark, make([(0, "never seen")]).withColumn("held_out", st.F.lit(True))).collect()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)
    long = "one two " * 150_000 + "tail"
    for most in (branches.HOT, 1000):
        (row,) = parted(spark, make([(0, long)]).withColumn("held_out", st.F.lit(False)), most=most).collect()
        assert row["n_tokens"] == 300_002 and row["n_known"] == 300_002 and row["score"] > row["base_score"]


def test_walk_agrees_with_parts(spark, make):
    texts = invented(250, 5)
    docs, tree, _ = fitted(spark, make, texts)
    held = {r["doc_id"] for r in docs.where("held_out").collect()}
    seen = collections.Counter(w for i, t in enumerate(texts) if i not in held for w in words(t))
    for row in parted(spark, docs, most=100, bucket=1000).collect():
        assert math.isclose(row["score"], walk(tree, seen, texts[row["doc_id"]]), rel_tol=1e-9)


def test_sums_return_small():
    """Where buckets are many, nearly every place returns alone: documents and sums as they are were twelve bytes each."""
    rng = np.random.default_rng(1)
    doc = np.sort(rng.choice(4096, 450, replace=False))
    logs = -12 * rng.random(450)
    names, sums = branches._sums(doc, logs)
    assert len(names) + len(sums) < 8 * 450
    docs, parts = branches.pa.table({branches.DOC: doc}), branches.pa.table({"docs": [names], "sums": [sums]})
    assert np.abs(branches._totals(docs, parts) - logs).max() < 2e-10


def test_buckets_take_turns(spark, make):
    """What is dealt at once used to be every place; now each turn deals its buckets' places, and texts do not move for it."""
    rng = np.random.default_rng(2)
    root = branches.Root(np.array([2]), np.array([500]), np.array([40]), 20_100, 41, 100)
    symbols = rng.integers(2, 42, 5000)
    rows = branches.pa.table({branches.SYMBOLS: st.squeezed(symbols, np.array([2000, 5000])), "__learned": [True, False], branches.DOC: branches.pa.array([0, 1], branches.pa.int32())})
    turns = [branches._dealt(7, rows, root, [], [], 20, turn, 4).to_pydict() for turn in range(4)]
    whole = branches._dealt(7, rows, root, [], [], 20).to_pydict()
    parts = [x for turn in turns for x in zip(*turn.values())]
    assert sorted(parts, key=str) == sorted(zip(*whole.values()), key=str)
    assert max(sum(turn["n"]) for turn in turns) < 0.5 * sum(whole["n"]) and sum(whole["n"]) == 4998
    docs = make(invented(200, 6)).withColumn("held_out", st.held_out())
    for most in (branches.HOT, 60):
        ones = [parted(spark, docs, most=most, bucket=300, turns=turns) for turns in (1, 3)]
        one, other = ({r["doc_id"]: r["score"] for r in x.collect()} for x in ones)
        assert len(one) == 200 and one.keys() == other.keys() and all(math.isclose(one[k], other[k], rel_tol=1e-12) for k in one)
        # sums are all that is shuffled at the end
        assert ones[1]._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
