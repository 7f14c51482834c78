"""Quotes against every way to place them, chunks that tile, quotes that are reported."""

import random
from itertools import combinations, product

import pytest
from pyspark.sql import functions as F

from lodestack.operators import markers as mk
from lodestack.operators import validation as val

DOC = "id string, source_uri string, title string, text string, content_digest string, metadata map<string,string>"


def brute(text, quotes):
    """Most quotes in order, then the least place behind the chain, by trying all choices of all occurrences."""
    solid = lambda x: "".join(x.split())
    places = []
    for q in quotes:
        exact = [i for i in range(len(text)) if q.strip() and text.startswith(q, i)]
        loose = [i for i in range(len(text)) if solid(q) and not text[i].isspace() and solid(text[i:]).startswith(solid(q))]
        places.append(exact or loose)
    for size in range(len(quotes), 0, -1):
        ends = []
        for chosen in combinations(range(len(quotes)), size):
            for at in product(*[places[c] for c in chosen]):
                if all(a < b for a, b in zip(at, at[1:])):
                    ends.append(at[-1])
        if ends:
            return size, min(ends)
    return 0, -1


def test_most_quotes_furthest_left():
    rng = random.Random(3)
    for _ in range(400):
        text = "".join(rng.choices("ab \n", k=rng.randrange(0, 14)))
        quotes = ["".join(rng.choices("ab ", k=rng.randrange(0, 4))) for _ in range(rng.randrange(0, 5))]
        found = mk.placed(text, quotes)
        at = [x[0] for x in found if x]
        assert (len(at), at[-1] if at else -1) == brute(text, quotes)
        assert all(a < b for a, b in zip(at, at[1:]))
        for q, x in zip(quotes, found):
            assert x is None or (text.startswith(q, x[0]) if x[1] == mk.VERBATIM else "".join(text[x[0] :].split()).startswith("".join(q.split())))


def test_wrong_quotes_give_way():
    text = "Oak trees grow. Pine trees grow too. Oak trees have lobes. The end."
    got = mk.placed(text, ["Oak trees", "The end", "Pine  trees", "nowhere", "Oak\ntrees have", ""])
    assert got == [(0, mk.VERBATIM), None, (16, mk.BLANKS), None, (37, mk.BLANKS), None]


def documents(spark, *texts):
    import hashlib

    return spark.createDataFrame([(f"d{i}", "u", "", x, hashlib.sha256((x or "").encode()).hexdigest(), {}) for i, x in enumerate(texts)], DOC)


def test_chunks_tile_whatever_was_quoted(spark):
    texts = ["Éone two. Three four.\n\nFive  six 日本 seven. End", "no cuts here", "", "ab" * 50_000 + "X" + "cd" * 50_000]
    docs = documents(spark, *texts)
    quotes = [("d0", 0, "Éone"), ("d0", 1, "Three four"), ("d0", 2, "Five six 日本"), ("d0", 3, "Nine"), ("d0", 4, "End"), ("d0", 5, None), ("d2", 0, "x"), ("d3", 0, "Xcd")]
    aligned = mk.align_markers(docs, spark.createDataFrame(quotes, "document_id string, n int, marker string"))
    got = {(r["document_id"], r["n"]): (r["match"], r["byte_start"]) for r in aligned.collect()}
    at = lambda i, x: len(texts[i][: texts[i].index(x)].encode())
    assert got == {("d0", 0): (mk.VERBATIM, 0), ("d0", 1): (mk.VERBATIM, at(0, "Three")), ("d0", 2): (mk.BLANKS, at(0, "Five")), ("d0", 3): (None, None), ("d0", 4): (mk.VERBATIM, at(0, "End")), ("d0", 5): (None, None), ("d2", 0): (None, None), ("d3", 0): (mk.VERBATIM, 100_000)}
    chunks = mk.marker_chunks(docs, aligned)
    assert val.corpus_problems(docs, chunks).count() == 0
    whole = {r[0]: r[1] for r in chunks.orderBy("ordinal").groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda x: x["text"]), "")).collect()}
    assert whole == {"d0": texts[0], "d1": texts[1], "d3": texts[3]}
    assert {r[0]: r[1] for r in chunks.groupBy("document_id").count().collect()} == {"d0": 4, "d1": 1, "d3": 2}
    with pytest.raises(Exception, match="unknown document"):
        mk.align_markers(docs, spark.createDataFrame([("zz", 0, "x")], "document_id string, n int, marker string")).collect()
