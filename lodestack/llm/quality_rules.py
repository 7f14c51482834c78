"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Each rule reads a few counts of the text and votes good (1), bad (-1) or abstains (0). Votes of all
documents are counted by pattern (at most 3 to the number of rules: what reaches the driver does not
grow with the input), and a two-class model with a vote distribution for each rule and class is fitted
to the counts. A document's posterior is a sum of weights, computed beside its votes.

Defined cases: a null text has no words (all counts 0, most rules abstain); repeated rows vote each for
itself; documents of one pattern of votes have one posterior, and one of exactly the threshold is kept; an
empty table keeps the starting weights; nulls elsewhere and extra columns pass through,
columns called like results are replaced; very long texts are counted whole, in time about linear in them.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import WORD_RE, Workspace, forget, regroup

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_shout_words", "top_word", "n_ended_lines")
WINDOW = 5
#: name -> (ratio above which it votes bad, ratio up to which the text may count as prose).
FAULTS = {
    "symbols": (0.05, 0.01),
    "dup_lines": (0.30, 0.05),
    "repeats": (0.20, 0.05),
    "shouting": (0.40, 0.20),
    "one_word": (0.30, 0.20),
}
#: Mean word sizes outside the first pair vote bad, inside the second may count as prose.
WORD_SIZES = ((2, 16), (3, 12))


#: Vote shares (bad, abstain, good) of good and of bad documents that rules are taken to have before any
#: document is seen. They start the fit and count in it like STRENGTH times as many documents as voted.
BEFORE = {"prose": ((0.01, 0.09, 0.90), (0.09, 0.90, 0.01))}
BEFORE_FAULT = ((0.01, 0.98, 0.01), (0.20, 0.79, 0.01))
STRENGTH = 0.05


def repeat_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more in the text, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    codes = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    mixed = np.zeros(n, dtype=np.uint64)
    for j in range(window):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + (codes[j : j + n] ^ (codes[j : j + n] >> np.uint64(31)))
    order = np.argsort(mixed, kind="stable")
    equal = mixed[order][1:] == mixed[order][:-1]
    if not equal.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][equal]] = True
    twice[order[:-1][equal]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, np.flatnonzero(twice), 1)
    np.add.at(edges, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORD_RE.findall(text)
    if not words:
        return (0, 0, sum(map(text.count, SYMBOLS)), *(0,) * (len(COUNTS) - 3))
    seen, dup, lines, ended = set(), 0, 0, 0
    for line in text.split("\n"):
        if WORD_RE.search(line):
            lines += 1
            ended += line.rstrip()[-1:] in ".!?:;\"'"
            if line in seen:
                dup += 1
            seen.add(line)
    top = Counter(words).most_common(1)[0][1]
    shout = sum(w.isupper() and len(w) > 1 for w in words)
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words), lines, shout, top, ended


def with_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns of keep and COUNTS; text is read and, unless kept, left behind."""
    keep = [c for c in keep if c not in COUNTS]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, T.LongType()) for c in COUNTS])
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))

    def task(batches):
        forget()
        for batch in regroup(batches, 1024, 2_000_000):
            rows = [text_counts(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            table = np.array(rows, dtype=np.int64).reshape(len(rows), len(COUNTS))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(table[:, j]) for j in range(len(COUNTS))]], schema.names)

    return source.mapInArrow(task, schema)


def votes() -> dict[str, Column]:
    """A vote of each rule from COUNTS: one rule for each fault, and one that finds prose."""
    n, c = F.col("n_words"), F.col
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    ratio = {
        "symbols": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "shouting": share("n_shout_words", "n_words"),
        "one_word": F.when(n >= 10, share("top_word", "n_words")).otherwise(0.0),
    }
    mean, bad = share("word_chars", "n_words"), {}
    for k, r in ratio.items():
        bad[k] = (n > 0) & (r > FAULTS[k][0])
    bad["word_size"] = (n > 0) & ((mean < WORD_SIZES[0][0]) | (mean > WORD_SIZES[0][1]))
    bad["unended"] = (c("n_lines") >= 3) & (c("n_ended_lines") == 0)
    out = {k: F.when(v, -1).otherwise(0) for k, v in bad.items()}
    fine = (n >= 10) & mean.between(*WORD_SIZES[1]) & (c("n_ended_lines") > 0)
    for k, r in ratio.items():
        fine = fine & (r <= FAULTS[k][1])
    out["prose"] = F.when(fine, 1).otherwise(0)
    return {k: v.cast("int") for k, v in out.items()}


def pattern(names: list[str]) -> Column:
    """Votes as digits of a number to base 3."""
    total = F.lit(0)
    for k in names:
        total = total * 3 + (F.col(f"vote_{k}") + 1)
    return total


def fit(voted: DataFrame, names: list[str], rounds: int = 50) -> dict:
    """Prior and weights by expectation-maximisation over counted vote patterns."""
    found = sorted((r[0], r[1]) for r in voted.groupBy(pattern(names).alias("p")).count().collect())
    return fit_patterns(found, names, rounds)


def fit_patterns(found: list[tuple[int, int]], names: list[str], rounds: int = 50) -> dict:
    """found: (pattern, documents). Returns {"prior": log-odds, "weights": [log-odds of vote -1, 0, 1]}."""
    n_rules = len(names)
    before = [np.array(BEFORE.get(k, BEFORE_FAULT)) for k in names]
    weight = [np.log(b[0] / b[1]) for b in before]
    prior = 1.0
    if not found:
        return {"prior": prior, "weights": [[float(x) for x in w] for w in weight]}
    digits = np.array([[(p // 3 ** (n_rules - 1 - j)) % 3 for j in range(n_rules)] for p, _ in found])
    count = np.array([c for _, c in found], dtype=float)
    extra = STRENGTH * count.sum()
    for _ in range(rounds):
        score = prior + sum(weight[j][digits[:, j]] for j in range(n_rules))
        good = 1 / (1 + np.exp(-np.clip(score, -60, 60)))
        mass = np.array([(count * good).sum(), (count * (1 - good)).sum()]) + 1.0
        prior = math.log(mass[0] / mass[1])
        new = []
        for j in range(n_rules):
            share = np.array([[(count * q * (digits[:, j] == v)).sum() for v in range(3)] for q in (good, 1 - good)]) + extra * before[j]
            share /= share.sum(axis=1, keepdims=True)
            odds = np.log(share[0] / share[1])
            # a rule is taken to be better than chance: a vote may lose its weight, not turn round
            new.append(np.array([min(odds[0], 0.0), np.clip(odds[1], -1.0, 1.0), max(odds[2], 0.0)]))
        done = max(np.abs(a - b).max() for a, b in zip(new, weight, strict=True)) < 1e-9
        weight = new
        if done:
            break
    return {"prior": prior, "weights": [[float(x) for x in w] for w in weight]}


def posterior(model: dict, names: list[str]) -> Column:
    score = F.lit(float(model["prior"]))
    for k, w in zip(names, model["weights"], strict=True):
        v = F.col(f"vote_{k}")
        score = score + F.when(v < 0, float(w[0])).when(v == 0, float(w[1])).otherwise(float(w[2]))
    return 1 / (1 + F.exp(-score))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_votes(counted: DataFrame) -> DataFrame:
    return counted.select("*", *[v.alias(f"vote_{k}") for k, v in votes().items()])


def judge(voted: DataFrame, model: dict, threshold: float = 0.5) -> DataFrame:
    names = list(votes())
    return voted.withColumns({"base_failed": base_failed(), "quality": posterior(model, names)}).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold))


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that are kept, with their own columns.

    Texts are counted once: documents are written with their votes, the model is fitted to the votes
    and applied to them. Votes are digits of one number, so that columns called like counts stay."""
    names, own = list(votes()), "__votes"
    # no column of documents may meet a count or a vote of the same name
    place = {c: "text" if c == "text" else f"__own_{n}" for n, c in enumerate(docs.columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(x) for c, x in place.items()])
    voted = with_votes(with_counts(renamed, renamed.columns)).select(*renamed.columns, base_failed().alias("__failed"), pattern(names).alias(own))
    voted = Workspace(docs.sparkSession, "quality", codec="none").save(voted, "votes")
    digits = voted.withColumns({f"vote_{k}": F.pmod(F.floor(F.col(own) / 3 ** (len(names) - 1 - j)), F.lit(3)).cast("int") - 1 for j, k in enumerate(names)})
    model = fit(digits, names)
    kept = digits.where(~F.col("__failed") & (posterior(model, names) >= threshold))
    return kept.select(*[F.col(x).alias(c) for c, x in place.items()])
