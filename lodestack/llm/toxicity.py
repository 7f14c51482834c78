"""Toxic spans by a two-state linear-chain conditional random field over the words of a text.

Labels are given for documents, so token labels are derived first: a word of a toxic document is
labelled toxic where it, or its beginning, is far more frequent among toxic documents than others. The
chain has features of each word (the word and its beginnings, those seen often enough in toxic
documents to tell) and transitions between the states; it is fitted by full-batch gradient steps on forward-backward marginals. Marginals give the
offending offsets, and three sums over them give the document's score through a logistic regression,
fitted on labelled documents that took no part before it.

Fitting reads a bounded sample: at most SAMPLE labelled documents of each label, the ones of least hash.
Scoring reads every word of every text.

Defined cases: a null text is empty, and an empty text gets the score of a text without toxic words;
equal texts have equal scores; label rows with null fields are left out, documents labelled more than
once are toxic if any label says so; with no label of one kind every score is the share of toxic
labels (0.5 without labels); a score of exactly the cut is predicted toxic, and equal words have equal features
wherever they stand; extra columns pass through, and ones called like results are replaced; texts are
scored whole, very long ones in time linear in their words.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import regroup

TOKEN = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"[.!?\n]")
SAMPLE = 1_500
PREFIXES = (4, 5, 6, 7)
LEAST_RATIO = 9.0
LEAST_EVIDENCE = 20.0
FEATURE_EVIDENCE = 8.0
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())]))


def held_out(doc_id="doc_id"):
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_keys(word: str) -> list[str]:
    word = word.lower()
    return ["w" + word, *["p" + word[:k] for k in PREFIXES if len(word) > k]]


@dataclass
class Model:
    """Weights of word features and the bias (key ""), transitions [from][to], and the document regression."""

    weights: dict[str, float]
    trans: np.ndarray
    logit: np.ndarray

    def emission(self, word: str) -> float:
        get = self.weights.get
        return get("", 0.0) + sum(get(k, 0.0) for k in word_keys(word))


def chain(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Log-odds of the toxic state at each token; texts are e[bounds[k]:bounds[k + 1]], all stepped at once."""
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], bounds[:-1][order]
    (t00, t01), (t10, t11) = trans
    forward, back = np.array(e, dtype=float), np.zeros(len(e))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # texts longer than t
    for t in range(1, longest):
        at = first[: active[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(t01, t11 + r) - np.logaddexp(t00, t10 + r)
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        r = e[at + 1] + back[at + 1]
        back[at] = np.logaddexp(t10, t11 + r) - np.logaddexp(t00, t01 + r)
    return forward + back


def pair_mass(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of the tokens, and the expected count of each transition."""
    logit = chain(e, bounds, trans)
    p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    inner = np.ones(len(e), dtype=bool)
    inner[bounds[:-1][bounds[:-1] < len(e)]] = False
    b = np.flatnonzero(inner)
    a = b - 1
    # P(a, b) from the forward odds of a and what comes after b
    (t00, t01), (t10, t11) = trans
    fwd = _forward(e, bounds, trans)
    after = logit - fwd + e
    w = np.stack([np.full(len(a), t00), t01 + after[b], t10 + fwd[a], t11 + fwd[a] + after[b]])
    w = np.exp(w - w.max(axis=0))
    w /= w.sum(axis=0)
    return p, w.sum(axis=1).reshape(2, 2)


def _forward(e: np.ndarray, bounds: np.ndarray, trans: np.ndarray) -> np.ndarray:
    size = np.diff(bounds)
    order = np.argsort(-size, kind="stable")
    size, first = size[order], bounds[:-1][order]
    (t00, t01), (t10, t11) = trans
    forward = np.array(e, dtype=float)
    active = np.searchsorted(-size, -np.arange(int(size[0]) if len(size) else 0), side="left")
    for t in range(1, len(active)):
        at = first[: active[t]] + t
        r = forward[at - 1]
        forward[at] += np.logaddexp(t01, t11 + r) - np.logaddexp(t00, t10 + r)
    return forward


def sums(logit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """What a document is scored by: largest marginal, log of the expected toxic words, and of their share."""
    p = 1 / (1 + np.exp(-np.clip(logit, -50, 50)))
    n = np.diff(bounds)
    total = np.concatenate([[0.0], np.cumsum(p)])
    mass = np.maximum(total[bounds[1:]] - total[bounds[:-1]], 0.0)
    top = np.zeros(len(n))
    some = n > 0
    if some.any():
        top[some] = np.maximum.reduceat(p, bounds[:-1][some])
    return np.stack([np.ones(len(n)), top, np.log1p(mass), np.log1p(1000 * mass / np.maximum(n, 100))], axis=1)


def _coded(texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    index: dict[str, int] = {}
    flat, bounds = [], [0]
    for text in texts:
        flat += [index.setdefault(w, len(index)) for w in TOKEN.findall(text)]
        bounds.append(len(flat))
    return list(index), np.array(flat, dtype=np.int64), np.array(bounds, dtype=np.int64)


def telling_keys(texts: list[str], toxic: list[int]) -> tuple[set[str], set[str]]:
    """(features, marks): words and beginnings that tell toxic documents, and those that mark their words."""
    counts = (Counter(), Counter())
    for text, label in zip(texts, toxic, strict=True):
        counts[label].update({k for w in {w.lower() for w in TOKEN.findall(text)} for k in word_keys(w)})
    n0, n1 = max(1, toxic.count(0)), max(1, toxic.count(1))
    features, marks = set(), set()
    for k, c in counts[1].items():
        d = counts[0][k]
        share = (c + d) / (n0 + n1)
        evidence = 2 * (c * math.log(c / (n1 * share)) + (d * math.log(d / (n0 * share)) if d else 0.0))
        if c >= 3 and c / n1 > d / n0 and evidence >= FEATURE_EVIDENCE:
            features.add(k)
            if evidence >= LEAST_EVIDENCE and (c / n1) / ((d + 0.5) / n0) >= LEAST_RATIO:
                marks.add(k)
    return features, marks


def fit(texts: list[str], toxic: list[int], share: float | None = None, rounds: int = 40) -> Model:
    """Fit on two thirds of the texts, the document regression on the rest (every third).

    share: share of toxic documents that scores are to reflect, where the texts are sampled by label.
    Sentences are the chains that are fitted; whole texts are the chains that are scored.
    """
    trans = np.log(np.array([[0.98, 0.02], [0.5, 0.5]]))
    weights = {"": -4.0}
    if len(set(toxic)) < 2:
        share = (sum(toxic) + 0.5) / (len(toxic) + 1) if toxic else 0.5
        return Model(weights, trans, np.array([math.log(share / (1 - share)), 0.0, 0.0, 0.0]))
    fold = np.zeros(len(texts), dtype=bool)
    for label in (0, 1):
        fold[[i for i, x in enumerate(toxic) if x == label][2::3]] = True
    own = [i for i in range(len(texts)) if not fold[i]]
    features, marks = telling_keys([texts[i] for i in own], [toxic[i] for i in own])
    parts = [(part, toxic[i]) for i in own for part in SENTENCE.split(texts[i])]
    words, flat, bounds = _coded([part for part, _ in parts])
    index = {k: n for n, k in enumerate(["", *sorted(features)])}
    rows = [[0, *[index[k] for k in word_keys(w) if k in index]] for w in words]
    wide = max(map(len, rows), default=1)
    table = np.array([r + [len(index)] * (wide - len(r)) for r in rows], dtype=np.int64).reshape(len(rows), wide)
    marked = np.array([any(k in marks for k in word_keys(w)) for w in words], dtype=bool)
    in_toxic = np.repeat(np.array([label == 1 for _, label in parts]), np.diff(bounds))
    y = (marked[flat] & in_toxic).astype(float)
    inner = np.ones(len(flat), dtype=bool)
    inner[bounds[:-1][bounds[:-1] < len(flat)]] = False
    b = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[b - 1].astype(int), y[b].astype(int)), 1.0)
    full = np.zeros(len(index) + 1)
    full[0] = weights[""]
    m = v = np.zeros_like(full)
    tm = tv = np.zeros((2, 2))
    for step in range(1, rounds + 1):
        e = full[table].sum(axis=1)[flat]
        p, mass = pair_mass(e, bounds, trans)
        by_word = np.bincount(flat, weights=y - p, minlength=len(words))
        grad = np.bincount(table.ravel(), weights=np.repeat(by_word, wide), minlength=len(full)) - 0.05 * full
        grad[-1] = 0.0
        t_grad = seen - mass - 0.05 * trans
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        tm, tv = 0.9 * tm + 0.1 * t_grad, 0.99 * tv + 0.01 * t_grad**2
        rate = 0.3 / (1 + step / 20)
        full = full + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        trans = trans + 0.2 * rate * (tm / (1 - 0.9**step)) / (np.sqrt(tv / (1 - 0.99**step)) + 1e-8)
        full[-1] = 0.0
    model = Model({k: float(full[n]) for k, n in index.items()}, trans, np.zeros(4))
    rest = [i for i in range(len(texts)) if fold[i]]
    words, flat, bounds = _coded([texts[i] for i in rest])
    e = np.array([model.emission(w) for w in words])[flat] if len(flat) else np.zeros(0)
    x = sums(chain(e, bounds, trans), bounds)
    y = np.array([toxic[i] for i in rest], dtype=float)
    seen = toxic.count(1) / len(toxic)
    share = share or seen
    model.logit = regression(x, y, np.where(y == 1, share / seen, (1 - share) / (1 - seen)))
    return model


def regression(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression by Newton steps; the first column is not shrunk."""
    w = np.zeros(x.shape[1])
    keep = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        g = x.T @ (weight * (y - p)) - keep @ w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + keep
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 5.0 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside the held-out quarter."""
    known = labels.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = {}
    for label in (0, 1):
        rows = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
        chosen |= {r["doc_id"]: label for r in rows}
    if not chosen:
        return fit([], [])
    found = sorted({(r[0], r[1]) for r in docs.where(F.col("doc_id").isin(list(chosen))).select("doc_id", F.coalesce("text", F.lit(""))).collect()})
    return fit([t for _, t in found], [chosen[i] for i, _ in found], counts.get(1, 0) / sum(counts.values()))


def score_toxicity(docs: DataFrame, model: Model, keep: list[str] | None = None, at: float = 0.3) -> DataFrame:
    """The columns of keep (all), score, predicted (score >= at) and spans (start, end, marginal of toxic words)."""
    keep = [c for c in (keep or docs.columns) if c not in ("score", "predicted", "spans")]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("spans", SPANS)])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
    packed = (model.weights, model.trans.tolist(), model.logit.tolist())

    def task(batches):
        own = Model(packed[0], np.array(packed[1]), np.array(packed[2]))

        class Memo(dict):
            def __missing__(self, word):
                self[word] = e = own.emission(word)
                return e

        memo = Memo()
        for batch in regroup(batches, 8192, 16_000_000):
            if len(memo) > 1_000_000:
                memo.clear()
            texts = [t or "" for t in batch.column(batch.num_columns - 1).to_pylist()]
            parts, bounds = [], [0]
            for text in texts:
                words = TOKEN.findall(text)
                parts.append(np.fromiter(map(memo.__getitem__, words), dtype=float, count=len(words)))
                bounds.append(bounds[-1] + len(words))
            bounds = np.array(bounds, dtype=np.int64)
            logit = chain(np.concatenate(parts), bounds, own.trans)
            score = np.round(1 / (1 + np.exp(-np.clip(sums(logit, bounds) @ own.logit, -50, 50))), 6)
            spans = [[] for _ in texts]
            hits = np.flatnonzero(logit > 0)
            which = np.searchsorted(bounds, hits, side="right") - 1
            for i in np.unique(which).tolist():
                places = [m.span() for m in TOKEN.finditer(texts[i])]
                for k in hits[which == i].tolist():
                    a, b = places[k - bounds[i]]
                    spans[i].append({"start": a, "end": b, "score": float(1 / (1 + math.exp(-min(50.0, logit[k]))))})
            predicted = (score >= at).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score), pa.array(predicted), pa.array(spans, arrow)], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).mapInArrow(task, schema)
