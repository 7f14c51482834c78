"""Goldens and structure of text functions and chunkers."""

import hashlib
import random
import re
from time import perf_counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.operators import chunking as ch
from lodestack.operators import representations as rep
from lodestack.operators.common import ContractError


def docs(spark, *texts, title=""):
    rows = [(f"doc{i}", "", title, x, hashlib.sha256(x.encode()).hexdigest(), {}) for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, source_uri string, title string, text string, content_digest string, metadata map<string,string>")


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("text,want", [("Oak, OAK! tree-42 oak", ["oak", "oak", "tree", "42", "oak"]), ("", []), ("--- !!", []), ("Ünïcode Wörter", ["ünïcode", "wörter"]), ("日本 語2", ["日本", "語2"])])
def test_terms(spark, text, want):
    assert value(spark, t.terms("x"), x=text) == want
    assert value(spark, t.term_set("x"), x=text) == list(dict.fromkeys(want))


def test_digest_goldens(spark):
    assert value(spark, t.digest("x"), x="hello") == "2cf24dba5fb0a30e26e83b2ac5b9e29e1b161e5c1fa7425e73043362938b9824"
    got = value(spark, t.canonical_json(F.struct(F.col("x").alias("a"))), x="<b>& ")
    assert got == '{"a":"\\u003cb\\u003e\\u0026\\u2028"}'


def test_fixed_golden(spark):
    rows = ch.Fixed(6, 1).chunk(spark.createDataFrame([("doc", "one 🌳 two three")], "id string, text string")).orderBy("ordinal").collect()
    assert [r["text"] for r in rows] == ["one 🌳 ", " two t", "three"]
    assert rows[0]["id"] == "chunk-51d9d498f37a5843"
    assert [(r["byte_start"], r["byte_end"]) for r in rows] == [(0, 9), (8, 14), (13, 18)]


def test_raw_representation_golden(spark):
    chunk = spark.createDataFrame([("chunk", "text", hashlib.sha256(b"text").hexdigest())], "id string, text string, content_digest string")
    assert rep.raw(chunk).first()["id"] == "rep-3fa424a352378dbc"


@given(st.text(st.sampled_from(list("ab.!?\né🌳 ")), max_size=60), st.integers(1, 9), st.integers(0, 8), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_windows_cover_and_move_on(text, size, overlap, snap):
    overlap = min(overlap, size - 1)
    spans = list(ch.windows(text, 0, len(text), size, overlap, snap))
    assert not text or (spans[0][0] == 0 and spans[-1][1] == len(text))
    for (a, b), (c, d) in zip(spans, spans[1:]):
        assert c == b - overlap and d > b and b - a <= size
    if not snap:
        assert all(b - a == size for a, b in spans[:-1])


def test_native_fixed_equals_loop(spark):
    texts = ["", "a", "ab" * 50, "é🌳x\n" * 33, "z" * 120, "z" * 121]
    for size, overlap in ((10, 0), (7, 3), (120, 119), (500, 20)):
        native = ch.Fixed(size, overlap).chunk(docs(spark, *texts)).collect()
        loop = ch.SnappedFixed(size, overlap).chunk(docs(spark, *texts)).collect()
        assert sorted(native) == sorted(loop)


def test_snap_retreats_to_sentence_end():
    assert list(ch.windows("One. Two three four", 0, 19, 8, 0, 5))[0] == (0, 4)
    assert list(ch.windows("One. Two three four", 0, 19, 8, 5, 5))[0] == (0, 8)  # it would not move on


def test_sections_skip_fences_and_deep_indents():
    text = "intro\n# A\nx\n```\n# no\n```\n   ## B\n    # no\n#no\n#\ttab\n~~~~\n# in\n~~~\n# in\n~~~~\n### C"
    assert [text[a:b].split("\n")[0] for a, b in ch.sections(text)] == ["intro", "# A", "   ## B", "#\ttab", "### C"]
    assert ch.sections("") == [] and ch.sections("# A\ntext") == [(0, 8)]


def test_small_sections_join():
    assert ch.joined_sections([(0, 2), (2, 4), (4, 20), (20, 22)], 5) == [(0, 22)]
    assert ch.joined_sections([(0, 10), (10, 12), (12, 14)], 5) == [(0, 14)]
    assert ch.joined_sections([(0, 2), (2, 4)], 5) == [(0, 4)]
    assert ch.joined_sections([(0, 2), (2, 4)], 0) == [(0, 2), (2, 4)]


def test_markdown_heading_chunks_are_exact_slices(spark):
    text = "# Títle\n" + "word " * 60 + "\n## Small\nx\n## Next\n" + "más " * 30
    for chunker in (ch.Markdown(80, 10, 20), ch.MarkdownHeading(150, 40, 20)):
        rows = chunker.chunk(docs(spark, text)).orderBy("ordinal").collect()
        for r in rows:
            assert text.encode()[r["byte_start"] : r["byte_end"]].decode() == r["text"]
        assert rows[0]["chunker"] == chunker.name and rows[-1]["byte_end"] == len(text.encode())


@pytest.mark.parametrize("make", [lambda: ch.Fixed(0), lambda: ch.Fixed(5, 5), lambda: ch.Markdown(5, 1, -1), lambda: ch.MarkdownHeading(5, 5)])
def test_bad_parameters(spark, make):
    with pytest.raises(ContractError):
        make().chunk(docs(spark, "text"))


def test_from_ranges(spark):
    d = docs(spark, "añb cd")
    ranges = spark.createDataFrame([("doc0", 0, 3), ("doc0", 3, 7)], "document_id string, byte_start int, byte_end int")
    assert [r["text"] for r in ch.from_ranges(d, ranges, "given").orderBy("ordinal").collect()] == ["añ", "b cd"]
    for bad in ([("doc0", 0, 2)], [("doc0", 0, 99)], [("none", 0, 1)], [("doc0", 0, 4), ("doc0", 3, 5)]):
        with pytest.raises(Exception):
            ch.from_ranges(d, spark.createDataFrame(bad, "document_id string, byte_start int, byte_end int"), "given").collect()


def test_heading_path():
    text = "pre\n# One\n## Two\ntext\n# Three\nmore"
    at = lambda s: len(text[: text.index(s)].encode())
    assert ch.heading_path(text, "Doc", at("text")) == "Doc > One > Two"
    assert ch.heading_path(text, "Three", at("more")) == "Three"
    assert ch.heading_path(text, "", at("## Two")) == "One > Two"
    assert ch.heading_path(text, None, 0) == "(document root)"
    assert ch.heading_path("```\n# no\n```\nx", None, 12) == "(document root)"


def test_lines_and_summaries(spark):
    assert value(spark, t.question_lines("x"), x="1. What?\n- * Why\n\n```\n2) 3 oaks\n• ok") == ["What?", "Why", "3 oaks", "ok"]
    assert value(spark, t.collapse_line("x"), x=" a \r\n\n```json\nb\n```") == "a; b"
    lead = lambda x, n=300: value(spark, t.lead_sentence("x", n), x=x)
    assert lead("  Hi there. More") == "Hi there." and lead("abc") == "abc" and lead("abcdef", 4) == "abc…" and lead("ab", 1) == "…" and lead(".x. y") == ".x."
    assert value(spark, t.excerpt("x"), x="\n  a \t b \nc") == "a b"
    assert value(spark, t.strip_code_fence("x"), x="```json\n{}\n```") == "{}" and value(spark, t.strip_code_fence("x"), x="```json {}") == "```json {}"


def test_small_to_big_and_compose(spark):
    d = docs(spark, "abcdefghij" * 20, "short")
    small, big = ch.Fixed(10).chunk(d), ch.Fixed(64, 8).chunk(d)
    for width in (16, 4096):
        rows = rep.best_parents(small, big, width).collect()
        parents = {r["id"]: r for r in big.collect()}
        for r in rows:
            share = lambda p: min(r["byte_end"], p["byte_end"]) - max(r["byte_start"], p["byte_start"])
            best = max(share(p) for p in parents.values() if p["document_id"] == r["document_id"])
            assert share(parents[r["parent_id"]]) == best
    assert rep.small_to_big(small, big).select("kind").distinct().collect()[0][0] == "small"
    raw = rep.raw(big)
    assert rep.compose(raw, raw).count() == big.count() == rep.ensure_raw(raw.limit(1), big).count()
    with pytest.raises(ContractError):
        rep.small_to_big(small, big.where("document_id = 'doc0'"))


def test_generated_groups_are_repaired(spark):
    d = docs(spark, "# A\none two. three four.\n# B\nfive six seven.", title="T")
    chunks = ch.Markdown(12, 0).chunk(d)
    calls = []

    def generate(df):
        calls.append(df.columns)
        grouped = "chunk_ids" in df.columns
        return df.withColumn("output", F.lit('noise [x] [{"chunk":1,"text":" first "},{"chunk":1,"text":"again"},{"chunk":9,"text":"no"}]') if grouped else F.concat(F.lit("own "), "input"))

    out = rep.generated(chunks, d, "summary", generate, "m", "p", "pd", group_size=2).collect()
    assert len(out) == chunks.count() and len(calls) == 2
    assert sum(r["text"] == "first" for r in out) == -(-len(out) // 2) and all(r["model"] == "m" for r in out)
    assert rep.parse_numbered('text [1] then [{"chunk":2,"text":"b"}]', 2) == {2: "b"}


def test_a_random_generator_is_run_once(spark):
    """Each chunk comes out once, in the words of the answer that was given for it, whatever the generator leaves out."""
    d = docs(spark, *["# A\none two. three four.\n# B\nfive six seven.\n# C\neight" * 3] * 4, title="T")
    chunks = ch.Markdown(12, 0).chunk(d)

    def generate(df):
        if "chunk_ids" not in df.columns:
            return df.withColumn("output", F.concat(F.lit("own "), F.uuid()))
        entry = lambda i: F.when(F.rand() < 0.5, F.concat(F.lit('{"chunk":'), i.cast("string"), F.lit(',"text":"group '), F.uuid(), F.lit('"}')))
        return df.withColumn("output", F.concat(F.lit("["), F.array_join(F.array_compact(F.transform(F.sequence(F.lit(1), "n_chunks"), entry)), ","), F.lit("]")))

    out = rep.generated(chunks, d, "summary", generate, "m", "p", "pd", group_size=5)
    first, second = ({r["chunk_id"]: r["text"] for r in out.collect()} for _ in range(2))
    assert out.count() == chunks.count() == len(first) and first == second
    assert {x.split()[0] for x in first.values()} == {"own", "group"}


def brute_heading_path(text, title, byte_start):
    """The path from a scan of everything before one position."""
    data = text.encode()
    start = stop = min(byte_start, len(data))
    if start < len(data) and (start == 0 or data[start - 1 : start] == b"\n"):
        stop = data.find(b"\n", start) if b"\n" in data[start:] else len(data)
    levels, fences = [""] * 7, ch.Fences()
    for line in data[:stop].decode("utf-8", "replace").split("\n"):
        if not fences.covers(line) and (found := re.match(r"(#{1,6}) (.*)", line.strip(), re.DOTALL)):
            levels[len(found[1]) :] = [found[2].strip(), *[""] * (6 - len(found[1]))]
    head = [title.strip()] if title and title.strip() else []
    return " > ".join(head + [x for n, x in enumerate(levels) if x and not (n == 1 and head and head[-1] == x)]) or "(document root)"


@given(st.lists(st.sampled_from(["# a", "## b", " ### c", "```", "~~~~", "\n", "\n\n", "text", "é", " ", "#", "   # d "]), max_size=25).map("".join))
@settings(max_examples=200, deadline=None)
def test_heading_paths_in_one_pass(text):
    starts = list(range(len(text.encode()) + 2))
    random.Random(1).shuffle(starts)
    assert ch.heading_paths(text, "a", starts) == [brute_heading_path(text, "a", x) for x in starts]


@pytest.mark.parametrize("size,overlap", [(1, 0), (5, 0), (5, 2), (7, 6), (3, 1)])
def test_fixed_windows_by_brute_force(spark, size, overlap):
    texts = ["", "a", "abcde", "añb日本\U0001f600 cd\n" * 5, "ascii only\n" * 7]
    want = {}
    for k, text in enumerate(texts):
        starts = range(0, 1 + max(0, -(-(len(text) - size) // (size - overlap))) * (size - overlap), size - overlap) if text else []
        want[f"doc{k}"] = [(n, len(text[:s].encode()), len(text[: s + size].encode()), text[s : s + size]) for n, s in enumerate(starts)]
    got = {f"doc{k}": [] for k in range(len(texts))}
    for r in ch.Fixed(size, overlap).chunk(docs(spark, *texts)).orderBy("document_id", "ordinal").collect():
        got[r["document_id"]].append((r["ordinal"], r["byte_start"], r["byte_end"], r["text"]))
    assert got == want


def test_long_texts_take_time_in_proportion(spark):
    """Fixed windows, given ranges and heading paths over 4 M code points take little over twice as long as over 2 M."""
    took = {}
    for n in (1, 2, 4):
        d = docs(spark, "# Heading é\nsome words of a line that goes on\n" * (25_000 * n))
        chunks = ch.Fixed(1200, 120).chunk(d)
        ranges = ch.Fixed(300).chunk(d).select("document_id", "byte_start", "byte_end")
        for what, df in (("fixed", chunks), ("ranges", ch.from_ranges(d, ranges, "r")), ("paths", rep.with_heading_path(chunks, d))):
            began = perf_counter()
            df.write.format("noop").mode("overwrite").save()
            took[what, n] = perf_counter() - began
    assert all(took[what, 4] <= 2.5 * took[what, 2] + 1 for what in ("fixed", "ranges", "paths")), took


def test_group_inputs(spark):
    d = docs(spark, "# A\none", title="T")
    row = rep.group_inputs(ch.Markdown(50).chunk(d), d, with_lead=True).first()
    assert row["input"] == "Document title: T\nDocument lead:\n# A\none\n\n[1] Section: T > A\n# A\none\n"
    assert re.fullmatch("chunk-[0-9a-f]{16}", row["chunk_ids"][0])
