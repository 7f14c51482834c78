"""URL rules, winnowing and mixing: built-in functions only, against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestack.llm import mixing, winnowing
from lodestack.llm.common import Workspace
from lodestack.llm.queries import URL_RULES
from lodestack.llm.url_filters import enclosing, host_key, judge_urls

from .conftest import EDGE


def no_python(df):
    """Whether the plan is of built-in operators only. The fixtures' own rows are not part of what is asked."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not re.search("Python|Pandas|Arrow", plan)


def judged(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), a == "block", len(h), p, h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[4] if best else None, best[5] if best else "allow"


URLS = ["http://a.example.net/en/1", "https://example.net/en/", "HTTP://WWW.Example.NET/fr/?q=1", "x", None, "", "http://net", "http://net/", "http://bexample.com/de/", "http://example.com/de/x#y", "http://org/fr/", "http://a.b.org/fr", "http://a.b.org/fr/z", "http:///p", "://h/p://q/r", "http://example.net", "http://é.net/en/", "http://ÉA.net/en/", "http://éa.net/", "http://x.Éa.net/q", "http://a..net/x\ny?z", "http://net./x"]


@pytest.mark.parametrize("salts", [1, 5])
def test_url_rules(spark, salts):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS * 3)], "page_id long, url string, rule string, `odd name.x` string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    got = judge_urls(pages, rules, salts=salts)
    assert no_python(got)
    assert sorted(got.columns) == sorted(["page_id", "url", "odd name.x", "host", "path", "rule", "verdict"])
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == {i: judged(u, URL_RULES) for i, u in enumerate(URLS * 3)}
    assert judge_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    own = [("Éa.net", "/", "block"), ("NET", "/en/", "allow"), ("", "/", "block"), ("net", None, "block"), (None, "/", "block"), ("net", "/x\ny", "block"), ("net", "/x\ny", "allow")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, spark.createDataFrame(own, "host string, path string, action string"), salts=salts).collect()}
    fitting = [("Éa.net", "/", "block"), ("net", "/en/", "allow"), ("net", "/x\ny", "block")]
    for i, u in enumerate(URLS * 3):
        host, path, rule, verdict = judged(u, fitting)
        assert got[i] == (host, path, "NET/en/" if rule == "net/en/" else rule, verdict), u


def test_hot_host_is_dealt_over_tasks(spark):
    """No task of a sweep holds more than a fraction of the urls of a host that nearly all share."""
    rows = spark.range(4000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://hot.net/en/"), F.col("id").cast("string")).alias("url"))
    rules = spark.createDataFrame([("net", "/", "block"), ("hot.net", "/en/1", "allow"), *[(f"h{i}.net", "/", "block") for i in range(30)]], "host string, path string, action string")
    points = rows.select("page_id", host_key(F.lit("hot.net")).alias("key"))
    hosts = rules.select(host_key(F.col("host")).alias("key"), F.col("host").alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        held = enclosing(points, hosts, all_levels=True).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(r["count"] for r in held) == 8000 and max(r["count"] for r in held) < 4000
    got = {r["page_id"]: r["rule"] for r in judge_urls(rows, rules).collect()}
    assert got == {i: "hot.net/en/1" if str(i).startswith("1") else "net/" for i in range(4000)}


def test_very_long_urls(spark):
    urls = ["http://" + "a." * 300 + "net/" + "x/" * 20_000, "http://net/" + "y" * 200_000, "x" * 100_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("net", "/", "block"), ("a.net", "/x/x/", "allow"), ("net", "/" + "y" * 50_000, "allow")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    assert got == {i: judged(u, rules) for i, u in enumerate(urls)}


def test_many_nested_rules(spark):
    rng = random.Random(2)
    label = lambda: rng.choice("abc")
    hosts = sorted({".".join(label() for _ in range(rng.randint(1, 4))) for _ in range(120)})
    rules = sorted({(h, rng.choice(["/", "/x/", "/x/y/"]), rng.choice(["allow", "block"])) for h in hosts for _ in range(2)})
    urls = ["http://" + ".".join(label() for _ in range(rng.randint(1, 6))) + rng.choice(["", "/", "/x/1", "/x/y/2"]) for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in judge_urls(pages, spark.createDataFrame(rules, "host string, path string, action string")).collect()}
    for i, u in enumerate(urls):
        assert got[i] == judged(u, rules)


def brute_grams(text):
    n = len(text)
    grams = [text[k : k + winnowing.GRAM] for k in range(n - winnowing.GRAM + 1)] if n >= winnowing.GRAM else [text]
    return grams


def brute_hash(gram, single):
    """Hash of a run: those of its code points, each shifted by how many come after it."""
    out = 0
    for c in gram:
        out = (out << 1) & (2**64 - 1) ^ single[c]
    return out - (out >> 63 << 64)


@pytest.mark.parametrize("text", ["", "a", "abcdefgh", "abcdefghi" * 3, "x" * 60, "日本語\U0001f600" * 12, "the quick brown fox jumps over the lazy dog " * 3, "ab\ncd" * 9, "(.*)[a$" * 9])
def test_chosen_grams(spark, text):
    grams = brute_grams(text)
    pieces = set(text) if len(text) >= winnowing.GRAM else {text}
    single = {r["g"]: r["x"] & (2**64 - 1) for r in spark.createDataFrame([(g,) for g in pieces], "g string").selectExpr("g", "xxhash64(g) x").collect()}
    if len(text) >= winnowing.GRAM:
        upper = [brute_hash(g, single) >> winnowing.PLACE_BITS for g in grams]
    else:
        upper = [(single[text] - (single[text] >> 63 << 64)) >> winnowing.PLACE_BITS]
    w = min(winnowing.WINDOW, len(grams))
    want = set()
    for k in range(len(grams) - w + 1):
        least = min(upper[k : k + w])
        want.add(max(j for j in range(k, k + w) if upper[j] == least))
    row = winnowing.fingerprints(spark.createDataFrame([(text,)], "text string")).selectExpr("transform(grams, k -> 268435455L - (k & 268435455L)) p", "fingerprint").first()
    assert row["p"] == sorted(want) and row["fingerprint"] == "".join(f"{upper[j] & (2**36 - 1):09X}" for j in sorted(want))


def test_shared_passages_share_a_hash(spark):
    """Texts that share GRAM + WINDOW - 1 code points in a row share a chosen hash at the passage's place in each."""
    rng = random.Random(5)
    word = lambda n: "".join(rng.choices("abcdef ", k=n))
    passage = word(winnowing.GRAM + winnowing.WINDOW - 1)
    heads = [word(rng.randint(0, 90)) for _ in range(12)]
    rows = winnowing.fingerprints(spark.createDataFrame([(k, h + passage + word(rng.randint(0, 90))) for k, h in enumerate(heads)], "k int, text string")).select("k", winnowing.hashes(F.col("grams")).alias("h"), F.transform("grams", winnowing.place).alias("p")).collect()
    inside = [{(h, p - len(heads[r["k"]])) for h, p in zip(r["h"], r["p"]) if 0 <= p - len(heads[r["k"]]) < winnowing.WINDOW} for r in rows]
    assert set.intersection(*inside)


def test_very_long_text_is_fingerprinted_whole(spark, make):
    text = "".join(random.Random(6).choices("abcdefgh é", k=400_000))
    row, other = winnowing.with_edited(make([text, text[:-40] + "X" * 40])).orderBy("doc_id").collect()
    assert row["n_chars"] == 400_000 and row["positions"][-1] > 400_000 - 40 and len(row["positions"]) * 9 == len(row["fingerprint"])
    assert row["near_next"] > 0.99 > 0.8 > row["near_edited"] > 0.4 and row["fingerprint"] != other["fingerprint"]


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_edited_texts(spark, make, ranges):
    rng = random.Random(4)
    texts = EDGE + ["".join(rng.choices("abcde fgh\n", k=rng.randint(0, 300))) for _ in range(60)] + ["z" * 37, "y" * 38, "long " * 400]
    ids = rng.sample(range(1000), len(texts))
    rows = list(zip(ids, texts)) + [(None, "no id"), (None, "other without id"), (ids[0], "same id again")]
    df = winnowing.with_edited(make(rows, clash=("fingerprint",)), ranges)
    assert no_python(df)
    got = sorted((r.asDict() for r in df.collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]))
    order = sorted((i, t or "") for i, t in rows if i is not None)
    want, prints = [(None, t, t[: len(t) - len(t) // 4] + t[: len(t) // 4]) for i, t in rows if i is None], {}
    for k, (i, t) in enumerate(order):
        q, after = len(t) // 4, order[(k + 1) % len(order)][1]
        want.append((i, t, t[: len(t) - q] + after[:q]))
    edited = spark.createDataFrame([(e,) for _, _, e in want] + [(t,) for _, t, _ in want], "text string")
    prints = {r["text"]: r["fingerprint"] for r in winnowing.fingerprints(edited).collect()}
    expected = sorted((i is not None, i or 0, len(t), hashlib.sha256(e.encode()).hexdigest(), prints[t], prints[e]) for i, t, e in want)
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) for r in got) == expected
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_edited_ends_are_not_chosen_anew(spark, make, monkeypatch):
    """The next document's grams serve for its beginning in the edited text; whole quarters of texts used to be hashed again."""
    plain = winnowing.chosen

    def bounded(text, offset=None):
        most = F.when(F.length(text) > 2 * winnowing.REACH, F.raise_error(F.lit("hashed again")).cast("string")).otherwise(text)
        return plain(text if offset is None else most, offset)

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcde fgh\n", k=k)) for k in (5000, 30, 1200, 40, 2000, 148, 147, 151, 3000, 900, 36, 37, 38)]
    monkeypatch.setattr(winnowing, "chosen", bounded)
    rows = winnowing.with_edited(make(texts)).orderBy("doc_id").select("n_chars", "edited_fingerprint").collect()
    after = [*texts[1:], texts[0]]
    edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, after, strict=True)]
    prints = {r["text"]: r["fingerprint"] for r in winnowing.fingerprints(spark.createDataFrame([(e,) for e in edited], "text string")).collect()}
    assert [r["edited_fingerprint"] for r in rows] == [prints[e] for e in edited]


def test_edited_of_none_and_one(make):
    assert winnowing.with_edited(make([])).count() == 0
    (row,) = winnowing.with_edited(make(["only one text, longer than a gram"])).collect()
    assert row["near_next"] == 1.0


def mixed_corpus():
    rng = random.Random(1)
    return [(i, "word " * rng.randint(1, 200), rng.choice(["en", "en", "de"]), "hot" if rng.random() < 0.4 else rng.choice("abc")) for i in range(600)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, "x") for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long, weight string")


def test_raking_meets_targets(spark):
    docs = frame(spark, mixed_corpus())
    want = {"hot": 1.0, "a": 1.0, "b": 1.0, "c": 1.0}
    targets = {"source": spark.createDataFrame(list(want.items()), "value string, share double"), "lang": spark.createDataFrame([("en", 0.5), ("de", 0.5)], "value string, share double")}
    out = mixing.mix(docs, targets)
    rows = out.collect()
    total = sum(r["tokens"] * r["weight"] for r in rows)
    for column, shares in (("source", {k: 0.25 for k in want}), ("lang", {"en": 0.5, "de": 0.5})):
        for value, share in shares.items():
            assert abs(sum(r["tokens"] * r["weight"] for r in rows if r[column] == value) / total - share) < 0.005
    assert max(r["probability"] for r in rows) == pytest.approx(1.0) and all(0 <= r["probability"] <= 1 for r in rows)
    expected, drawn = sum(r["probability"] for r in rows), sum(r["sampled"] for r in rows)
    assert abs(expected - drawn) < 60
    again = {r["doc_id"]: r["sampled"] for r in mixing.mix(docs.repartition(7), targets).collect()}
    assert again == {r["doc_id"]: r["sampled"] for r in rows}


def test_mixing_edge_rows(spark):
    rows = [(1, None, None, None), (1, None, None, None), (None, "text", "en", "a"), (2, "", "de", "a"), (3, "x" * 9000, "en", "b")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == 5 and {r["topic"] for r in got} == {"short", "long"}
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    zero = {"source": spark.createDataFrame([("a", 1.0)], "value string, share double")}
    assert all(r["probability"] == 0 for r in mixing.mix(frame(spark, rows), zero).collect() if r["source"] == "b")


def kept_share(rows):
    return sum(r["tokens"] * r["probability"] for r in rows) / sum(r["tokens"] for r in rows)


def test_rare_documents_do_not_set_the_scale(spark):
    rare = [(9000, "tiny", "en", "rare"), (9001, "word " * 50, "xx", "a")]
    docs = frame(spark, mixed_corpus() + rare)
    rows = mixing.mix(docs).collect()
    assert kept_share(rows) > mixing.LEAST - 1e-6
    assert {r["probability"] for r in rows if r["doc_id"] in (9000, 9001)} == {1.0}
    assert all(r["capped"] for r in rows if r["doc_id"] in (9000, 9001)) and not all(r["capped"] for r in rows)
    assert all(r["probability"] == 1 for r in rows if r["capped"])
    for budget in (0.3, 0.9):
        rows = mixing.mix(docs, budget=budget).collect()
        assert kept_share(rows) == pytest.approx(budget, abs=1e-6) and max(r["probability"] for r in rows) <= 1
    assert {r["probability"] for r in mixing.mix(docs, budget=2.0).collect()} == {1.0}


def blocks(stray):
    """Sources with a language of their own, but for a share of strays; the first source is hot."""
    rng, own = random.Random(2), ["en", "de", "fr"]
    places = [rng.choice([0, 0, 0, 1, 2]) for _ in range(600)]
    return [(i, "word " * rng.randint(1, 100), own[(k + (rng.random() < stray)) % 3], "abc"[k]) for i, k in enumerate(places)]


def shares(rows, column):
    masses = {}
    for r in rows:
        masses[r[column]] = masses.get(r[column], 0) + r["tokens"] * r["weight"]
    return {k: x / sum(masses.values()) for k, x in masses.items()}


@pytest.mark.parametrize("stray", [0.0, 0.02])
def test_raking_of_blocks(spark, stray):
    docs = frame(spark, blocks(stray))
    rows = mixing.mix(docs).collect()
    tokens = {k: sum(r["tokens"] for r in rows if r["source"] == k) ** 0.7 for k in "abc"}
    got = shares(rows, "source")
    assert all(got[k] == pytest.approx(x / sum(tokens.values()), rel=1e-3) for k, x in tokens.items())
    if not stray:
        return
    # the shares of some weights that are no product of factors, so that they can be met together
    bent = [r.asDict() | {"weight": 1 + (r["source"] == "a" and r["lang"] == "de") * 9 + (r["source"] == "b") * 2} for r in rows]
    want = {m: shares(bent, m) for m in ("source", "lang")}
    rows = mixing.mix(docs, {m: spark.createDataFrame(list(x.items()), "value string, share double") for m, x in want.items()}).collect()
    assert all(shares(rows, m)[k] == pytest.approx(x, rel=1.1e-3) for m in want for k, x in want[m].items())


def tangled():
    """Sources, languages and topics that depend on each other."""
    rng = random.Random(9)
    out = []
    for i in range(900):
        source = rng.choice("aaab" if i % 3 else "bcc")
        lang = rng.choice({"a": ["en"] * 8 + ["de"], "b": ["de"] * 5 + ["en", "fr"], "c": ["fr", "fr", "en"]}[source])
        size = rng.choice({"en": [8, 60, 90], "de": [8, 8, 70], "fr": [8, 200, 300]}[lang])
        out.append((i, "word " * size, lang, source))
    return out


def test_default_weights_by_hand(spark):
    """Tempered shares inside source and language give the goals; numpy's fitting from the tokens as they are, the weights."""
    rows = mixing.mix(frame(spark, tangled())).collect()
    names = {m: sorted({r[m] for r in rows}) for m in mixing.MARGINS}
    cell = lambda r: tuple(names[m].index(r[m]) for m in mixing.MARGINS)
    table = np.zeros([len(x) for x in names.values()])
    got = np.zeros_like(table)
    for r in rows:
        table[cell(r)] += r["tokens"]
        got[cell(r)] = r["weight"]
    source, lang = table.sum((1, 2)) ** 0.7, table.sum(2) ** 0.85
    model = (source / source.sum() * table.sum())[:, None, None] * (lang / lang.sum(1, keepdims=True))[:, :, None] * table / np.maximum(table.sum(2, keepdims=True), 1)
    weight = np.ones_like(table)
    for _ in range(2000):
        for axis in range(3):
            others = tuple(k for k in range(3) if k != axis)
            weight *= (model.sum(others) / (table * weight).sum(others)).reshape([-1 if k == axis else 1 for k in range(3)])
    here = table > 0
    assert np.allclose(got[here], weight[here], rtol=5e-3)


@pytest.mark.parametrize("given", [(), ("lang",), mixing.MARGINS])
def test_no_rake_is_idle(spark, monkeypatch, given):
    """Every fit moves weights, by far more than its tolerance, and given targets are met."""
    moved, rake = [], mixing.rake

    def watched(cells, targets, ws, **more):
        out = rake(cells, targets, ws, **more)
        both = cells.select(*mixing.MARGINS, F.col("weight").alias("before")).join(out, list(mixing.MARGINS)).where("tokens > 0")
        moved.append(both.agg(F.max(F.abs(F.col("weight") / F.col("before") - 1))).first()[0])
        return out

    monkeypatch.setattr(mixing, "rake", watched)
    docs = frame(spark, tangled())
    wanted = {"source": [("a", 0.3), ("b", 0.4), ("c", 0.3)], "lang": [("en", 0.4), ("de", 0.3), ("fr", 0.3)], "topic": [("short", 0.2), ("prose", 0.8)]}
    rows = mixing.mix(docs, {m: spark.createDataFrame(wanted[m], "value string, share double") for m in given}).collect()
    assert moved and min(moved) > 0.01
    for m in given:
        assert shares(rows, m) == pytest.approx(dict(wanted[m]), rel=1.1e-3)


def test_slow_fits_end(spark):
    """Few strays between sources and languages: plain sweeps would need some 800."""
    share = lambda i, j, t: [0.9, 0.1][i] * (0.9999 if i == j else 0.0001) * [0.3, 0.7][t]
    rows = [(f"s{i}", f"l{j}", f"t{t}", round(1e7 * share(i, j, t))) for i in range(2) for j in range(2) for t in range(2)]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    model = mixing.tempered(cells, mixing.POWERS)
    goals = {m: model.groupBy(F.col(m).alias("value")).agg(F.sum(F.col("tokens") * F.col("weight")).alias("share")) for m in mixing.MARGINS}
    got = mixing.rake(cells.withColumn("weight", F.lit(1.0)), goals, Workspace(spark, "test"), sweeps=60).collect()
    for m, goal in goals.items():
        for r in goal.collect():
            assert sum(x["tokens"] * x["weight"] for x in got if x[m] == r["value"]) == pytest.approx(r["share"], rel=1e-3)
    weight = {(x["source"], x["lang"], x["topic"]): x["weight"] for x in got}
    assert weight["s0", "l0", "t0"] * weight["s1", "l1", "t0"] == pytest.approx(weight["s0", "l1", "t0"] * weight["s1", "l0", "t0"], rel=1e-6)


@pytest.mark.parametrize("budget", [None, 0.3, 0.9])
def test_against_ipf_and_sampling_by_hand(spark, budget):
    """Weights of numpy's iterative proportional fitting, calibrated probabilities and the sample, cell by cell and row by row."""
    docs = frame(spark, mixed_corpus())
    shares_ = {"source": {"hot": 0.1, "a": 0.2, "b": 0.3, "c": 0.4}, "lang": {"en": 0.3, "de": 0.7}, "topic": {"short": 0.5, "prose": 0.5}}
    mixed = mixing.mix(docs, {m: spark.createDataFrame(list(x.items()), "value string, share double") for m, x in shares_.items()}, budget=budget)
    assert no_python(mixed)
    rows = mixed.collect()
    names = {m: sorted({r[m] for r in rows}) for m in shares_}
    table = np.zeros([len(x) for x in names.values()])
    cell = lambda r: tuple(names[m].index(r[m]) for m in names)
    for r in rows:
        table[cell(r)] += r["tokens"]
    weight = np.ones_like(table)
    for _ in range(500):
        for axis, (m, x) in enumerate(shares_.items()):
            goal = np.array([x.get(v, 0.0) for v in names[m]])
            mass = (table * weight).sum(axis=tuple(k for k in range(3) if k != axis))
            weight *= (goal / goal.sum() * table.sum() / mass).reshape([-1 if k == axis else 1 for k in range(3)])
    got = np.zeros_like(weight)
    for r in rows:
        got[cell(r)] = r["weight"]
    here = table > 0
    assert np.allclose(got[here], weight[here], rtol=3e-3)

    def kept(scale):
        return (table * np.minimum(1, got * scale)).sum() / table.sum()

    top = 1 / got[here].max()
    want = budget if budget is not None else max(mixing.LEAST, kept(top))
    low, high = 0.0, 1e6
    for _ in range(200):
        low, high = ((low + high) / 2, high) if kept((low + high) / 2) < want else (low, (low + high) / 2)
    assert all(r["probability"] == pytest.approx(min(1, got[cell(r)] * high), rel=1e-6) for r in rows)
    assert all(r["capped"] == (got[cell(r)] * high > 1 + 1e-6) for r in rows if abs(got[cell(r)] * high - 1) > 1e-5)
    assert kept_share(rows) == pytest.approx(want, rel=1e-3)
    hashed = {r["doc_id"]: r["h"] for r in docs.select("doc_id", F.xxhash64(F.lit(11), F.col("doc_id").cast("string")).alias("h")).collect()}
    assert all(r["sampled"] == (((hashed[r["doc_id"]] & (2**64 - 1)) >> 11) / 2**53 < r["probability"]) for r in rows)


def test_counted_tokens_and_given_topics(spark):
    docs = frame(spark, mixed_corpus()).withColumns({"n_tokens": F.col("doc_id") % 7, "subject": F.when(F.col("doc_id") % 3 == 0, "law")})
    rows = mixing.mix(docs, tokens="n_tokens", topic="subject").collect()
    assert all(r["tokens"] == r["doc_id"] % 7 and r["topic"] == ("law" if r["doc_id"] % 3 == 0 else "") for r in rows)


def test_mixing_very_long_text(spark):
    rows = [(1, "x" * 3_000_000, "en", "a"), (2, "short", "en", "b")]
    got = {r["doc_id"]: (r["topic"], r["tokens"]) for r in mixing.mix(frame(spark, rows)).collect()}
    assert got == {1: ("long", 750_000), 2: ("short", 2)}


def test_contradicting_targets_are_an_error(spark):
    cells = spark.createDataFrame([("a", "en", "short", 60, 1.0), ("b", "de", "short", 40, 1.0)], "source string, lang string, topic string, tokens long, weight double")
    targets = {m: spark.createDataFrame(x, "value string, share double") for m, x in (("source", [("a", 0.5), ("b", 0.5)]), ("lang", [("en", 0.7), ("de", 0.3)]))}
    with pytest.raises(ValueError, match="contradict"):
        mixing.rake(cells, targets, Workspace(spark, "test"), sweeps=10)
