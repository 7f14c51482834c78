"""Each stage's decisions on small documents, against what brute force says, and the whole run."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline as cp
from lodestack.llm import mixing, quality_rules, secrets

from .conftest import DOCUMENT, EDGE
from .test_near_dups import brute


def rows():
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 8))) for _ in range(300)]
    prose = [" ".join(rng.choices(words, k=rng.randint(40, 120))) + "." for _ in range(60)]
    copies = [prose[i] + " tail" for i in range(5)] + prose[:5]
    junk = [" ".join(w + "***" for w in rng.choices(words, k=50)) for _ in range(6)]
    hidden = [" ".join(rng.choices(words, k=60)) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end.']
    return list(enumerate(prose + copies + junk + hidden + EDGE))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows()], DOCUMENT)


def test_stages(spark, docs):
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality", "near_dups", "secrets", "mixing", "packing"]
    stage = dict(cp.STAGES)
    good = stage["quality"](spark, docs, "")
    kept = {r["doc_id"]: r["text"] for r in good.collect()}
    texts = dict(rows())
    assert good.columns == docs.columns and set(range(60)) <= set(kept) and all(kept[i] == texts[i] for i in kept)
    for i, t in kept.items():
        n, _, _, _, repeated, *_ = quality_rules.text_counts(t)
        assert n >= 10 and 100 * repeated <= 20 * n
    assert not any("***" in t for t in kept.values())

    one = stage["near_dups"](spark, good, "")
    classes = brute(sorted(kept.items()), 5, 80)
    assert {r["doc_id"] for r in one.collect()} == {i for i, (_, _, first) in classes.items() if first} and one.columns == docs.columns

    clean = stage["secrets"](spark, one, "")
    after = {r["doc_id"]: r for r in clean.collect()}
    assert clean.columns == docs.columns and set(after) == {r["doc_id"] for r in one.collect()}
    for i, r in after.items():
        assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"])
        assert r["text"] == kept[i] or "[secret]" in r["text"]
    assert any("[secret]" in r["text"] for r in after.values())

    mixed = stage["mixing"](spark, clean, "")
    drawn = {r["doc_id"]: r["text"] for r in mixed.collect()}
    assert mixed.columns == docs.columns and all(after[i]["text"] == t for i, t in drawn.items()) and len(drawn) > len(after) / 3

    pieces = defaultdict(int)
    for r in stage["packing"](spark, mixed, "").collect():
        pieces[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert {i for i, _ in pieces} == set(drawn) and all(total == n for (_, total), n in pieces.items())


def test_last_fit_decides_the_mixture(spark, monkeypatch):
    """Weights as they were before the last rake would draw other documents."""
    rng = random.Random(3)
    places = [("a", "en")] * 6 + [("a", "de"), ("b", "de"), ("b", "de"), ("b", "fr"), ("c", "fr")]
    docs = spark.createDataFrame([(i, "word " * rng.choice([8, 60, 300]), *reversed(rng.choice(places)), 0) for i in range(900)], DOCUMENT)
    rake, calls, idle = mixing.rake, [], []

    def watched(cells, *rest, **more):
        calls.append(1)
        return cells if len(calls) in idle else rake(cells, *rest, **more)

    monkeypatch.setattr(mixing, "rake", watched)
    drawn = {r["doc_id"] for r in cp.mixture(spark, docs, "").collect()}
    idle.append(len(calls))
    calls.clear()
    assert drawn != {r["doc_id"] for r in cp.mixture(spark, docs, "").collect()}


def test_stages_take_empty_tables(spark, docs):
    for _, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), "").count() == 0


def test_run(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = cp.run(spark, str(tmp_path)).collect()
    assert got and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got[0].asDict())
