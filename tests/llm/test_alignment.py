"""Groups, links and counts against byte offsets of whole texts."""

import collections
import random

import pytest

from lodestack.llm import alignment as al
from lodestack.llm.common import Workspace

from .conftest import EDGE


@pytest.fixture(scope="module")
def paths():
    tokenizers = pytest.importorskip("public_tokenizers")
    return str(tokenizers.path("byte_bpe_50k.json")), str(tokenizers.path("piece_bpe_32k.model"))


def spans(ids, of):
    out, at = [], 0
    for i in ids:
        out.append((i, at, at + len(of[i])))
        at += len(of[i])
    return out


def brute(a_side, b_side, text):
    """Ids, links and groups by offsets, the text encoded whole."""
    a, b = (side.encode([text])[0] if text else [] for side in (a_side, b_side))
    want = b" " + (text or "").encode()
    if not text or b"".join(a_side.bytes[i] for i in a) != want or b"".join(b_side.bytes[i] for i in b) != want:
        return [], [], [], ""
    a_spans, b_spans = spans(a, a_side.bytes), spans(b, b_side.bytes)
    links = [(i, j) for i, s, e in a_spans for j, t, f in b_spans if s < f and t < e]
    cuts = sorted({e for *_, e in a_spans} & {e for *_, e in b_spans})
    side = lambda spans, lo, hi: ",".join(str(i) for i, _, e in spans if lo < e <= hi)
    return a, b, links, ";".join(f"{side(a_spans, lo, hi)}|{side(b_spans, lo, hi)}" for lo, hi in zip([0, *cuts[:-1]], cuts, strict=True))


def test_equals_offsets(spark, make, paths):
    rng = random.Random(5)
    letters = ["a", "the", " ", "  ", "\n", "é", "日本", "\U0001f600", "Unbelievable", "tion", "1234", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\x7f"]
    texts = EDGE + ["".join(rng.choices(letters, k=rng.randrange(1, 40))) for _ in range(60)] + ["blank ▁ mark", "the cat", "the cat", "the cat sat"]
    docs = make([*enumerate(texts), (None, "the cat")], clash=("n_a", "groups", "best"))
    got = al.link_counts(al.align(docs, *paths), Workspace(spark, "test")).collect()
    assert len(got) == len(texts) + 1 and {"best", "lang", "text", "n_best"} <= set(got[0].asDict())
    a_side, b_side = al.ByteLevel(paths[0]), al.Pieces(paths[1])
    want = {t: brute(a_side, b_side, t) for t in set(texts)}
    held = collections.Counter(p for t in [*texts, "the cat"] for p in set(want[t][2]))
    best = collections.Counter()
    for (i, _), n in held.items():
        best[i] = max(best[i], n)
    for row in got:
        a, b, links, groups = want[row["text"]]
        assert (row["n_a"], row["n_b"], row["n_links"], row["groups"]) == (len(a), len(b), len(links), groups)
        assert row["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert row["n_best"] == sum(held[p] == best[p[0]] for p in links) and row["count_sum"] == sum(held[p] for p in links)
    assert not want["blank ▁ mark"][0] and want["the cat"][0]
    assert al.link_counts(al.align(docs.limit(0), *paths), Workspace(spark, "test")).count() == 0


def test_segments_are_the_whole(paths):
    rng = random.Random(6)
    words = ["the", "Thlyouble", "of.", "x1", "ürde", "naïve,", "12", "(see", "a)", "end.\nNext", "  two", "tab\tbed", "'s", "n't", "日本", "\u3000wide", "\xa0", "\x1c", "<s>", "<|endoftext|>", "e\u0301", "-", "'"]
    text = " ".join(rng.choices(words, k=5000))
    aligner = al.Aligner(*paths)
    assert aligner.cuts
    segments = al.SAFE_BLANK.split(text)
    assert len(segments) > 2000 and " ".join(segments) == text
    for side in (aligner.a, aligner.b):
        assert [i for p in side.encode(segments) for i in p] == side.encode([text])[0]


def test_segments_are_forgotten(paths):
    texts = ["one two three", "two three four", "x" * 100, "one two three", None, "five six seven eight nine"] * 3
    small, large = al.Aligner(*paths, most=4), al.Aligner(*paths)
    assert list(small.texts(texts)) == list(large.texts(texts))
    assert len(small.newer) + len(small.older) < 14 and "x" * 100 not in large.newer


def test_very_long_text(spark, make, paths):
    text = "Plain words and more of them, 1234 and so on. " * 20_000
    (row,) = al.link_counts(al.align(make([text]), *paths), Workspace(spark, "test")).collect()
    a_side, b_side = al.ByteLevel(paths[0]), al.Pieces(paths[1])
    assert (row["n_a"], row["n_b"]) == (len(a_side.encode([text])[0]), len(b_side.encode([text])[0]))
    assert row["count_sum"] == row["n_links"] >= row["n_groups"] > 200_000


def test_transitions_are_remembered_and_forgotten():
    bytes_of = [b"a", b"ab", b"b", b"abc", b"c"]
    machine = al.Transducer(bytes_of, bytes_of, most=2)
    for _ in range(3):
        # abc|c against a|bc.. : A leads, then B
        links, ends = machine.align([1, 4, 3], [0, 2, 4, 0, 2, 4])
        assert ends == [(1, 2), (2, 3), (3, 6)]
        assert [(x >> al.SHIFT, x & 0xFFFFF) for x in links] == [(1, 0), (1, 2), (4, 4), (3, 0), (3, 2), (3, 4)]
    crossing = al.Transducer([b"ab", b"cd"], [b"a", b"bc", b"d"])
    links, ends = crossing.align([0, 1], [0, 1, 2])
    assert ends == [(2, 3)] and [(x >> al.SHIFT, x & 0xFFFFF) for x in links] == [(0, 0), (0, 1), (1, 1), (1, 2)]
    with pytest.raises(ValueError, match="different bytes"):
        crossing.align([0], [2])
