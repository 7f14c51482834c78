"""Token memo, counts, files and packing against the tokenizers library."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestack.llm import packing, simple8b
from lodestack.llm.common import TokenMemo, Workspace
from lodestack.llm.queries import vocabulary
from lodestack.llm.token_counts import count_tokens
from lodestack.llm.token_files import read_tokens, write_tokens

from .conftest import EDGE

NAMES = ("word_bpe_49k.json", "byte_bpe_50k.json")
MEMOS = {n: TokenMemo(vocabulary(n)) for n in NAMES}
ALPHABET = st.lists(st.sampled_from(list("abAB1é.,'!#< \t\n\r\x0b\x1c\x85\xa0　́|>ſ") + ["<|endoftext|>", "<|startoftext|>", "  "]), max_size=30).map("".join)


def plain(name, texts):
    return [x.ids for x in MEMOS[name].tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", NAMES)
@given(texts=st.lists(ALPHABET, min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_memo_gives_the_whole_texts_ids(name, texts):
    ids, starts = MEMOS[name].encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(starts[:-1], starts[1:])] == plain(name, texts)


@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 70_000), st.integers(0, 2**64 - 1)), max_size=400))
@settings(max_examples=150, deadline=None)
def test_simple8b_round_trip(values):
    ids = np.array(values, dtype=np.uint64)
    words, offsets = simple8b.encode(ids)
    assert simple8b.decode(words, offsets, len(ids)).tolist() == values
    assert len(offsets) == -(-len(values) // simple8b.BLOCK) + 1 and offsets[-1] == len(words)
    if values:  # any block decodes alone
        k = (len(offsets) - 2) // 2
        part = simple8b.decode(words[offsets[k] : offsets[k + 1]], offsets[k : k + 2] - offsets[k], len(ids[k * simple8b.BLOCK :][: simple8b.BLOCK]))
        assert part.tolist() == values[k * simple8b.BLOCK :][: simple8b.BLOCK]


def test_counts_and_cache(spark, make):
    docs = make(EDGE, clash=("n_tokens", "extra"))
    cache = Workspace(spark, "test").path("cache")
    for _ in range(2):  # the second call finds every text in the cache
        rows = {r["doc_id"]: r for r in count_tokens(docs, vocabulary(NAMES[0]), cache, limit=3, blanks_matter=False).collect()}
        for (i, text), ids in zip(enumerate(EDGE), plain(NAMES[0], [t or "" for t in EDGE])):
            assert (rows[i]["n_bytes"], rows[i]["n_tokens"], rows[i]["over_limit"]) == (len((text or "").encode()), len(ids), len(ids) > 3)
            assert rows[i]["extra"] == "x"
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() < len(EDGE)
    assert count_tokens(docs.limit(0), vocabulary(NAMES[0])).count() == 0


def test_files_read_back(spark, make):
    rows = [(i * 3 % 29, t) for i, t in enumerate(EDGE)] + [(None, "no id"), (5, "again"), (5, "again")]
    path = Workspace(spark, "test").path("ids")
    write_tokens(make(rows, clash=("start",)), vocabulary(NAMES[0]), path)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in read_tokens(spark, path).collect()))
    want, start = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(plain(NAMES[0], [text or ""])[0] + [1], dtype="<u4")
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    empty = Workspace(spark, "test").path("none")
    write_tokens(make(rows).limit(0), vocabulary(NAMES[0]), empty)
    assert read_tokens(spark, empty).count() == 0


def test_packing_places_each_id_once(make):
    rows = list(enumerate(EDGE)) + [(100, "long text " * 3000), (None, "no id"), (7, "again"), (7, "again")]
    got = packing.pack_documents(make(rows, clash=("offset",)).coalesce(1), vocabulary(NAMES[1]), pool=2000).collect()
    ids = {}
    for (i, text), x in zip(rows, plain(NAMES[1], [t or "" for _, t in rows])):
        ids.setdefault(i, []).append(x + [1])
    assert sum(r["length"] for r in got) == sum(len(x) for v in ids.values() for x in v)
    windows = defaultdict(list)
    for r in got:
        assert any(zlib.crc32(np.array(x[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(x) for x in ids[r["doc_id"]])
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at & (at - 1) == 0 and at <= 2048
    assert packing.pack_documents(make([]), vocabulary(NAMES[1])).count() == 0


@given(st.lists(st.integers(1, 9000), max_size=60))
@settings(max_examples=100, deadline=None)
def test_pack_covers_lengths(lengths):
    covered, padding = defaultdict(list), 0
    for size, window in packing.pack(lengths):
        used = sum(n for _, _, n in window)
        padding += size - used
        for doc, start, n in window:
            covered[doc].append((start, n))
    assert padding == 0
    for doc, n in enumerate(lengths):
        at = 0
        for start, size in sorted(covered[doc]):
            assert start == at
            at += size
        assert at == n


def test_step_groups_are_even():
    groups = packing.step_groups([4] * 40 + [1] * 24, windows=16)
    cost = defaultdict(int)
    for g, c in zip(groups, [4] * 40 + [1] * 24):
        cost[g] += c
    assert len(cost) == 4 and max(cost.values()) - min(cost.values()) <= 4


def test_very_long_texts(spark, make):
    texts = ["a few words, " * 60_000, "x" * 300_000, "short"]
    want = [len(x) for x in plain(NAMES[0], texts)]
    assert {r["doc_id"]: r["n_tokens"] for r in count_tokens(make(texts), vocabulary(NAMES[0]), blanks_matter=False).collect()} == dict(enumerate(want))
    path = Workspace(spark, "test").path("long")
    write_tokens(make(texts), vocabulary(NAMES[0]), path)
    assert {r["doc_id"]: r["n_tokens"] for r in read_tokens(spark, path).collect()} == {i: n + 1 for i, n in enumerate(want)}


def test_equal_ids_lie_in_order_over_files(spark, make):
    """Rows of one id, or none, are dealt by the beginning of their texts, and keep their order."""
    rows = [(k, f"{i:03} text") for i in range(200) for k in (None, 4)]
    path = Workspace(spark, "test").path("ids")
    write_tokens(make(rows).repartition(3), vocabulary(NAMES[0]), path)
    got = read_tokens(spark, path).orderBy("start").collect()
    assert [r["doc_id"] for r in got] == [None] * 200 + [4] * 200
    ids = [zlib.crc32(np.array(x + [1], dtype="<u4").tobytes()) for x in plain(NAMES[0], [f"{i:03} text" for i in range(200)])]
    assert [r["ids_crc32"] for r in got] == ids * 2


@given(st.lists(st.integers(1, 5000), min_size=1, max_size=80))
@settings(max_examples=100, deadline=None)
def test_windows_begin_with_a_piece_of_their_tier(lengths):
    """Long documents give whole windows; other windows begin with a piece that no smaller tier holds, or are the powers of two of what is left."""
    found = packing.pack(lengths)
    cut = next((k for k, (size, _) in enumerate(found) if size not in packing.TIERS), len(found))
    below = dict(zip(packing.TIERS, (0, *packing.TIERS)))
    whole = sum(n // packing.TIERS[-1] for n in lengths)
    assert all(size == packing.TIERS[-1] and len(window) == 1 for size, window in found[:whole])
    left = sum(lengths) - sum(size for size, window in found if size in packing.TIERS and below[size] < window[0][2])
    assert cut == len(found) or left < 2 * packing.TIERS[-1] * len(packing.TIERS)
