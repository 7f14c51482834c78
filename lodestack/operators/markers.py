"""Chunks at cut points that a model names by quoting the source.

A model answers with the first words of each part, in order. Quotes are aligned with the source: at a verbatim occurrence,
or, where there is none, at one that differs in white space only. Of all ways to place quotes one after the other,
the one that places most of them is taken, and of those the one that lies furthest left: a quote that is wrong, out of
order or matches by chance gives way to those around it. Quotes that are not placed are reported, never guessed. Chunks
run from cut to cut and tile the document, so that they are exact slices whatever the model wrote.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.operators import chunking
from lodestack.operators.common import ContractError

BLANK = re.compile(r"\s+")
VERBATIM, BLANKS = "verbatim", "blanks"
ALIGNED = "document_id string, n int, marker string, match string, byte_start long"


class Source:
    """Occurrences in a text, verbatim or blank-insensitive, from a place on."""

    def __init__(self, text: str):
        self.text = text
        self.solid = None

    def first(self, marker: str, at: int) -> int:
        return self.text.find(marker, at)

    def first_solid(self, marker: str, at: int) -> int:
        """Where the first characters of a stretch lie that is the marker but for blanks; -1: nowhere from `at` on."""
        if self.solid is None:
            self.places = [i for i, c in enumerate(self.text) if not c.isspace()]
            self.solid = "".join(self.text[i] for i in self.places)
            self.rank = [0] * (len(self.text) + 1)
            for i in self.places:
                self.rank[i + 1] = 1
            for i in range(len(self.text)):
                self.rank[i + 1] += self.rank[i]
        found = self.solid.find(BLANK.sub("", marker), self.rank[min(at, len(self.text))])
        return self.places[found] if found >= 0 else -1


def placed(text: str, markers: list[str]) -> list[tuple[int, str] | None]:
    """Where each marker is cut in, and how it matched, or None: most markers in order, then furthest left.

    One step for each marker and chain length: ends[l] is the least place behind a chain of l markers."""
    source, ends, chains = Source(text), [0], [None]
    for n, marker in enumerate(markers):
        if not marker or marker.isspace():
            continue
        verbatim = source.first(marker, 0) >= 0
        if not verbatim and source.first_solid(marker, 0) < 0:
            continue
        find, how = (source.first, VERBATIM) if verbatim else (source.first_solid, BLANKS)
        for length in range(len(ends) - 1, -1, -1):
            at = find(marker, ends[length])
            if at < 0:
                continue
            chain = (n, at, how, chains[length])
            if length + 1 == len(ends):
                ends.append(at + 1)
                chains.append(chain)
            elif at + 1 < ends[length + 1]:
                ends[length + 1], chains[length + 1] = at + 1, chain
    out: list[tuple[int, str] | None] = [None] * len(markers)
    chain = chains[-1]
    while chain:
        n, at, how, chain = chain
        out[n] = (at, how)
    return out


def align_markers(documents: DataFrame, markers: DataFrame) -> DataFrame:
    """markers (document_id, n, marker) with match (verbatim, blanks or null) and byte_start, in order of n within a document.

    A document meets its markers in one row, as its answer is one: an answer is bounded by its model. Markers of documents
    that are not there are an error; null and blank markers match nothing."""
    listed = markers.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("n", "marker"))).alias("m"))
    joined = listed.join(documents.select(F.col("id").alias("document_id"), F.coalesce("text", F.lit("")).alias("whole")), "document_id", "left")
    known = F.when(F.col("whole").isNull(), F.raise_error(F.concat(F.lit("markers of an unknown document "), F.col("document_id"))).cast("string")).otherwise(F.col("whole"))

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, quotes, text in zip(frame["document_id"], frame["m"], frame["whole"], strict=True):
                found = placed(text, [q["marker"] or "" for q in quotes])
                done = size = 0
                for q, hit in zip(quotes, found, strict=True):
                    if hit is not None:  # bytes are counted on from the last cut
                        size, done = size + len(text[done : hit[0]].encode()), hit[0]
                    rows.append((doc, q["n"], q["marker"], hit and hit[1], size if hit is not None else None))
            out = pd.DataFrame(rows, columns=[c.split()[0] for c in ALIGNED.split(", ")])
            yield out.astype({"n": "Int32", "byte_start": "Int64"})

    return joined.withColumn("whole", known).select("document_id", "m", "whole").mapInPandas(task, ALIGNED)


def marker_chunks(documents: DataFrame, aligned: DataFrame, name: str = "markers") -> DataFrame:
    """Chunks of all documents from cut to cut, the first from the beginning; a document without cuts is one chunk, an empty one none."""
    if not name:
        raise ContractError("a chunker name is required")
    sized = documents.select(F.col("id").alias("document_id"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size")).where("size > 0")
    cuts = aligned.where("byte_start > 0").groupBy("document_id").agg(F.array_sort(F.collect_set("byte_start")).alias("cuts"))
    none = F.array().cast("array<bigint>")
    edges = F.concat(F.array(F.lit(0).cast("long")), F.coalesce("cuts", none), F.array("size"))
    spans = F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda i: F.struct(F.element_at("edges", i).alias("byte_start"), F.element_at("edges", i + 1).alias("byte_end")))
    ranges = sized.join(cuts, "document_id", "left").withColumn("edges", edges).select("document_id", F.inline(spans))
    return chunking.from_ranges(documents, ranges, name)
