"""Counts and base against brute force, the tree against a walk with dictionaries, sums of distributions, held-out texts."""

import collections
import math
import random
import zlib

import numpy as np

from lodestack.llm import suffix_tree as st
from lodestack.llm.common import WORD_RE, Workspace

from .conftest import EDGE

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD_RE.findall((text or "").translate(LOW))


def invented(n, seed):
    """Texts of two tongues: what word comes next depends on the one before, and at times on the one before that."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        tongue, last, text = rng.choice("AB"), 0, []
        for _ in range(rng.randrange(5, 60)):
            last = rng.choice([(last * 3 + 1) % 12, (last * 5 + 2) % 12, rng.randrange(12)])
            text.append(f"{tongue}{last}" if rng.random() < 0.95 else f"rare{rng.randrange(4000)}")
        out.append(" ".join(text))
    return out


def fitted(spark, make, texts, clash=()):
    ws = Workspace(spark, "test")
    docs = make(texts, clash=clash).withColumn("held_out", st.held_out())
    tree, counts = st.train(docs.where("not held_out"), ws)
    return docs, tree, st.score(st.code(docs, tree, ws), tree, counts)


def test_one_table_for_learning_and_scoring(spark, make):
    docs, tree, out = fitted(spark, make, invented(200, 7))
    ws = Workspace(spark, "test")
    again, counts = st.words_of(docs.where("not held_out"), ws)
    coded = st.code(docs, again, ws, ["doc_id", "held_out"])
    both = st.score(coded, st.grow(again, coded.where("not held_out")), counts)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, out.select(both.columns).collect()))


def walk(tree, seen, text):
    """log10 probability of a text, state by state, without the operator's arrays."""
    symbols = [tree.number.get(w, st.OTHER) for w in words(text)] + [tree.end]
    total, rest = 0.0, 10 ** tree.root[st.OTHER]
    for i, symbol in enumerate(symbols):
        log, node = tree.root[symbol], 0
        for k, level in enumerate(tree.levels[:i], 1):
            key = node * tree.width + symbols[i - k]
            where = {v: n for n, v in enumerate(level.keys.tolist())}
            if key not in where:
                break
            node = where[key]
            if level.kept[node]:
                own = dict(zip(level.events.tolist(), level.logs.tolist()))
                log = own.get(node * tree.width + symbol, log + level.rest[node])
        total += log
    for w in words(text):
        if w not in tree.number:
            total += math.log10((seen[w] + 1) / tree.whole) - math.log10(rest)
    return total


def test_counts_base_and_walk(spark, make):
    texts = EDGE + invented(300, 1)
    docs, tree, out = fitted(spark, make, texts, clash=("score", "n", "word"))
    got = {r["doc_id"]: r for r in out.collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    seen = collections.Counter(w for i, t in enumerate(texts) if not held[i] for w in [*words(t), None])
    n, v = sum(seen.values()), len(seen)
    assert len(got) == len(texts) and tree.tokens == n and any(level.kept.any() for level in tree.levels)
    assert "word" in out.columns and out.columns.count("score") == 1
    for i, text in enumerate(texts):
        row, tokens = got[i], [*words(text), None]
        assert (row["held_out"], row["n_tokens"], row["train_tokens"]) == (held[i], len(tokens), n)
        assert row["n_known"] == sum(seen[w] > 0 for w in tokens)
        assert math.isclose(row["base_score"], sum(math.log10((seen[w] + 1) / (n + v + 1)) for w in tokens), rel_tol=1e-9)
        assert math.isclose(row["score"], walk(tree, seen, text), rel_tol=1e-9)


def test_contexts_help_on_held_out_texts(spark, make):
    docs, tree, out = fitted(spark, make, invented(1500, 2))
    rows = out.where("held_out").collect()
    base, own, tokens = (sum(r[c] for r in rows) for c in ("base_score", "score", "n_tokens"))
    assert len(rows) > 150 and own / tokens > base / tokens + 0.2


def test_distributions_sum_to_one(spark, make):
    _, tree, _ = fitted(spark, make, invented(400, 3))
    symbols = np.arange(tree.width)
    assert math.isclose((10 ** tree.root).sum(), 1, rel_tol=1e-9)
    tested = 0
    for k, level in enumerate(tree.levels, 1):
        for node in np.flatnonzero(level.kept)[:40].tolist():
            path, at = [], node
            for upper in reversed(tree.levels[1:k]):
                at = int(upper.keys[at]) // tree.width
                path.insert(0, at)
            nodes = [np.full(tree.width, x) for x in [*path, node]]
            assert math.isclose((10 ** tree.logs(symbols, nodes)).sum(), 1, rel_tol=1e-6)
            tested += 1
    assert tested > 20


def test_divergence_decides():
    # after x comes y or z as everywhere; after w always y
    tree = st.Tree([("w", 100), ("x", 100), ("y", 300), ("z", 300)], 900, 5, 100)
    tree.levels.append(tree.candidates(8, None))
    number, level = tree.number, tree.levels[0]
    node = {s: int(np.flatnonzero(level.keys == number[s])[0]) for s in "wx"}
    share = 10 ** tree.root
    rows = [("w", number["y"], 100)] + [("x", s, int(round(100 * share[s]))) for s in range(tree.width) if share[s] > 0.02]
    tree.learn(np.array([node[s] for s, _, _ in rows]), np.array([s for _, s, _ in rows]), np.array([n for _, _, n in rows]))
    assert level.kept[node["w"]] and not level.kept[node["x"]]


def test_edges(spark, make):
    docs, tree, out = fitted(spark, make, [(None, "a b"), (None, None), (4, "a b c")])
    rows = out.collect()
    assert len(rows) == 3 and {r["n_tokens"] for r in rows} == {3, 1, 4} and not any(r["held_out"] for r in rows if r["doc_id"] is None)
    assert fitted(spark, make, ["a"])[2].limit(0).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    (row,) = fitted(spark, make, [(held, "never seen")])[2].collect()
    assert (row["n_known"], row["train_tokens"], row["base_score"], row["score"]) == (0, 0, 0.0, 0.0)
    empty = make(["x"]).limit(0)
    ws = Workspace(spark, "test")
    tree, counts = st.train(empty, ws)
    assert st.score(st.code(empty, tree, ws), tree, counts).count() == 0
    long = "one two " * 150_000 + "tail"
    (row,) = fitted(spark, make, [(0, long)])[2].collect()
    assert row["n_tokens"] == 300_002 and row["n_known"] == 300_002 and row["score"] > row["base_score"]
