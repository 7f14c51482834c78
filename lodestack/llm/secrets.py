"""Secrets: fixed patterns, and character Markov models of random strings against identifiers.

Three fixed patterns give the base spans. Beside them, every run of RUN or more key characters, whether
a base span touches it or not, is scored by two first-order Markov models, one of random strings and one
of ordinary words and identifiers; a run whose log-likelihood ratio passes the threshold is a span of
kind "markov". Models are trained from labelled strings: runs of a bounded sample of documents, labelled
by whether a base pattern lies in them (those in doubt are left out), and generated keys, identifiers
and numbers. A part of the strings is held out: the threshold is the least at which no more than
FALSE_RATE of the held-out ordinary ones pass (and never under LEAST), and the model says how many of
the held-out random ones do.

Defined cases: a null text has no spans; equal texts have equal spans; overlapping kinds are all
reported; an empty table gives an empty result, and the models then know generated strings only; extra
columns pass through, and one called spans is replaced; texts are scanned whole whatever their length, in
time linear in it. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import random
import re
import string
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm.common import regroup

#: Kinds in the order of ties, and the base patterns.
KINDS = ("assign", "access", "hex", "markov")
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the leftmost run of 16 or more, as a run of fewer fails whole
#: Key characters of a run that the models score, at least.
RUN = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % RUN)
DIGIT = re.compile("[0-9]")
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
SAMPLE_DOCUMENTS = 2_000
SAMPLE_WORDS = 20_000
#: Share of held-out ordinary strings that may pass, and the least threshold whatever they say.
FALSE_RATE = 1e-3
LEAST = 8.0

CODE = np.full(128, 0, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(len(ALPHABET))

SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = []
    if "=" in text or ":" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def train(samples: list[tuple[str, int]], weight: float = 20.0) -> np.ndarray:
    """Table of log P(next | last, random) - log P(next | last, ordinary) from (string, 1 if random).

    Transitions are smoothed by the class's own single characters, counted like `weight` transitions: a
    character that ordinary strings hardly have stays unlikely after one that they never had.
    """
    n = len(ALPHABET)
    counts, single = np.zeros((2, n, n)), np.full((2, n), 0.5)
    for text, label in samples:
        codes = CODE[np.frombuffer(text.encode("ascii"), dtype=np.uint8)]
        np.add.at(counts[label], (codes[:-1], codes[1:]), 1.0)
        np.add.at(single[label], codes, 1.0)
    single /= single.sum(axis=1, keepdims=True)
    logs = np.log((counts + weight * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + weight))
    return logs[1] - logs[0]


#: Words that ordinary identifiers are put together from.
NAME_WORDS = (
    "account address application array buffer build byte cache client code column command config connection content context count create data date default delete "
    "document error event example field file filter final format function get group handler header height image index input item key label layer length level library "
    "line list load local log main manager map message method model module name node number object option order output page parent path point position process project "
    "query queue read record report request response result root row sample schema select server service session set size source start state status stream string table "
    "target task test text time title token total tree type unit update user util value vector version view width window word write"
).split()


@dataclass(frozen=True)
class Model:
    """Ratios of transitions, the threshold, and which shares of held-out strings pass it."""

    table: np.ndarray
    threshold: float
    recall: float
    false_rate: float


def held_out(text: str) -> bool:
    """A fifth of all strings, by checksum; one string in capitals or not is on one side."""
    return zlib.crc32(text.lower().encode()) % 5 == 0


def fit(samples: list[tuple[str, int]]) -> Model:
    """Models of (string, 1 if random), with the threshold that the held-out strings of RUN or more characters ask for.

    What is ordinary stays so in capitals, whole or first.
    """
    samples = samples + [(x, 0) for s, label in samples if not label for x in (s.upper(), s.capitalize()) if x != s]
    table = train([x for x in samples if not held_out(x[0])])
    tested = [x for x in samples if held_out(x[0]) and len(x[0]) >= RUN]
    score, label = markov_scores([x for x, _ in tested], table), np.array([y for _, y in tested], dtype=bool)
    ordinary = np.sort(score[~label])
    # as many as FALSE_RATE of the ordinary ones lie above
    threshold = max(LEAST, float(ordinary[len(ordinary) - 1 - int(FALSE_RATE * len(ordinary))])) if len(ordinary) else LEAST
    share = lambda x: float((x > threshold).mean()) if len(x) else 0.0
    return Model(table, threshold, share(score[label]), share(ordinary))


def ordinary_names(n: int = 4_000, seed: int = 5) -> list[str]:
    """Identifiers of the usual shapes: snake, kebab, camel and path, some with numbers and dates; and plain numbers."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if i % 8 == 7:
            out.append("-".join(str(rng.randrange(10 ** rng.randint(3, 6))) for _ in range(rng.randint(2, 4))).replace("-", ("", "-", "/")[i // 8 % 3]))
            continue
        words = rng.choices(NAME_WORDS, k=rng.randint(3, 6))
        if i % 4 == 0:
            words = [words[0], *[w.capitalize() for w in words[1:]]]
        name = ("", "_", "-", "/")[i % 4].join(words)
        tail = ("", str(rng.randint(1, 99)), f"_{rng.randint(1990, 2035)}-{rng.randint(1, 12):02d}-{rng.randint(1, 28):02d}", f"-v{rng.randint(1, 9)}")[i // 4 % 4]
        out.append(name + tail)
    return out


def random_keys(n: int = 4_000, seed: int = 7) -> list[str]:
    """Keys drawn evenly from the usual alphabets (hex, letters and digits, base64)."""
    rng = random.Random(seed)
    sets = [string.hexdigits[:16], string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits]
    return ["".join(rng.choices(sets[i % len(sets)], k=rng.randint(20, 64))) for i in range(n)]


def train_from(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS, words: int = SAMPLE_WORDS) -> Model:
    """Models from generated strings and a bounded sample: at most `words` distinct long runs of at most
    `documents` documents, the ones of least hash, labelled random where a base pattern lies in them."""
    ids = [r[0] for r in docs.where("doc_id is not null").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(documents).collect()]
    run = F.explode(F.expr(r"regexp_extract_all(text, '[A-Za-z0-9+/_=-]{8,64}', 0)")).alias("word")
    found = docs.where(F.col("doc_id").isin(ids)).select(run).distinct().orderBy(F.xxhash64("word"), "word").limit(words).collect() if ids else []
    made = [(k, 1) for k in random_keys()] + [(k, 0) for k in ordinary_names()]
    runs = [r[0] for r in found]
    # a run with digits that generated strings alone make out as random is of unknown label: no pattern says so
    doubtful = markov_scores(runs, train(made)) > LEAST
    labelled = [(r, int(base)) for r, d in zip(runs, doubtful.tolist(), strict=True) if (base := bool(base_spans(r))) or not (d and DIGIT.search(r))]
    return fit(labelled + made)


def markov_scores(runs: list[str], table: np.ndarray) -> np.ndarray:
    """Log-likelihood ratio of each run of key characters."""
    if not runs:
        return np.zeros(0)
    codes = CODE[np.frombuffer("".join(runs).encode("ascii"), dtype=np.uint8)]
    step = np.zeros(len(codes))
    step[1:] = table[codes[:-1], codes[1:]]
    begin = np.cumsum([0, *[len(r) for r in runs[:-1]]])
    step[begin] = 0.0
    return np.add.reduceat(step, begin)


def find_in(texts: list[str | None], model: Model) -> list[list[tuple[int, int, int]]]:
    """(start, number of the kind, end) in each text, by start and kind."""
    out, runs, where = [], [], []
    for i, text in enumerate(texts):
        out.append(base_spans(text) if text else [])
        if text:
            for m in CANDIDATE.finditer(text):
                runs.append(m[0])
                where.append((i, m.start(), m.end()))
    for at in np.flatnonzero(markov_scores(runs, model.table) > model.threshold).tolist():
        i, a, b = where[at]
        out[i] = sorted([*out[i], (a, 3, b)])
    return out


def find_secrets(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all) and spans: array of kind, start, end."""
    keep = [c for c in (keep or docs.columns) if c != "spans"]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("spans", SPANS)])
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def task(batches):
        for batch in regroup(batches, 1024, 2_000_000):
            found = find_in(batch.column(batch.num_columns - 1).to_pylist(), model)
            spans = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, arrow)], schema.names)

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text")).mapInArrow(task, schema)


def merged(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Overlapping spans as one."""
    out: list[tuple[int, int]] = []
    for a, _, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def redact(docs: DataFrame, model: Model, mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text replaced by mark; n_chars, where it is a column, follows the new text."""

    def task(batches):
        for batch in regroup(batches, 1024, 2_000_000):
            at = batch.schema.get_field_index("text")
            texts = batch.column(at).to_pylist()
            for i, spans in enumerate(find_in(texts, model)):
                for a, b in reversed(merged(spans)):
                    texts[i] = texts[i][:a] + mark + texts[i][b:]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(task, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def joined(*kinds: str):
    """kind:start:end of the spans of these kinds (all), comma-joined by start, then kind as listed."""
    spans = F.filter("spans", lambda s: s["kind"].isin(*kinds)) if kinds else F.col("spans")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
