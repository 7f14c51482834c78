"""Chunkers: documents in, exact byte slices out.

Fixed windows are plain expressions, as every window's start follows from its number. Sentence snapping
and Markdown sections depend on the text before them and run as a function of one document at a time,
in Arrow batches: no shuffle, and nothing of a document leaves its task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.operators.common import ContractError, let

CHUNK_COLUMNS = ("id", "document_id", "ordinal", "byte_start", "byte_end", "text", "content_digest", "chunker")
#: Windows whose bytes are summed up together.
SUMMED = 256
_RANGES = "document_id string, ordinal int, byte_start int, byte_end int, text string"


def check_window(size: int, overlap: int) -> None:
    if size < 1:
        raise ContractError("the window size must be positive")
    if not 0 <= overlap < size:
        raise ContractError("the overlap must be at least zero and below the window size")


@dataclass(frozen=True)
class Fixed:
    """Windows of a number of code points, each beginning `overlap` before the last one's end."""

    size: int
    overlap: int = 0

    @property
    def name(self) -> str:
        return f"fixed-{self.size}-{self.overlap}"

    def chunk(self, documents: DataFrame) -> DataFrame:
        check_window(self.size, self.overlap)
        step, text = self.size - self.overlap, F.col("text")
        length = F.char_length(text)
        n = 1 + F.ceil(F.greatest(length - self.size, F.lit(0)) / step).cast("int")
        ascii_only = F.octet_length(text) == length
        reach = -(-self.size // step)

        total = lambda sizes, start, count: F.aggregate(F.slice(sizes, start, count), F.lit(0), lambda x, y: x + y)

        def block_starts(sizes: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / SUMMED).cast("int")), lambda b: total(sizes, b * SUMMED + 1, F.lit(SUMMED)))
            return F.aggregate(sums, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))

        def cut(pieces: Column, begin) -> Column:
            def window(i: Column) -> Column:
                piece = F.substring(F.array_join(F.slice(pieces, i + 1, F.lit(reach)), ""), 1, self.size)
                return F.struct(i.alias("ordinal"), begin(i).alias("byte_start"), piece.alias("piece"))

            return F.transform(F.sequence(F.lit(0), n - 1), window)

        def counted(pieces: Column) -> Column:
            """Windows with the bytes before them: those of whole blocks of pieces, and of the pieces before in its own block."""

            def with_sizes(sizes: Column) -> Column:
                own = lambda i: F.floor(i / SUMMED).cast("int")
                return let(block_starts(sizes), lambda sums: cut(pieces, lambda i: F.element_at(sums, own(i) + 1) + total(sizes, own(i) * SUMMED + 1, i % SUMMED)))

            return let(F.transform(pieces, lambda x: F.octet_length(x)), with_sizes)

        # the text is cut into pieces of a step once, and windows are put together from those
        pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{step}}}"), F.lit(0))
        whole = let(pieces, lambda p: F.when(ascii_only, cut(p, lambda i: i * step)).otherwise(counted(p)))
        rows = documents.where(length > 0).select(F.col("id").alias("document_id"), F.inline(whole))
        return identified(rows.select("document_id", "ordinal", "byte_start", (F.col("byte_start") + F.octet_length("piece")).alias("byte_end"), F.col("piece").alias("text")), self.name)


@dataclass(frozen=True)
class SnappedFixed:
    """Fixed windows whose ends move back to a sentence end within `snap` code points."""

    size: int
    overlap: int = 0
    snap: int = 0

    @property
    def name(self) -> str:
        return f"fixed-{self.size}-{self.overlap}"

    def chunk(self, documents: DataFrame) -> DataFrame:
        check_window(self.size, self.overlap)
        return _by_document(documents, self.name, lambda text: windows(text, 0, len(text), self.size, self.overlap, self.snap))


@dataclass(frozen=True)
class Markdown:
    """Sections at structural headings, each cut into windows."""

    size: int
    overlap: int = 0
    snap: int = 0

    @property
    def name(self) -> str:
        return f"markdown-{self.size}-{self.overlap}" + (f"-snap{self.snap}" if self.snap else "")

    def chunk(self, documents: DataFrame) -> DataFrame:
        check_window(self.size, self.overlap)
        if self.snap < 0:
            raise ContractError("the snap must not be negative")

        def cut(text: str) -> Iterator[tuple[int, int]]:
            for start, end in sections(text):
                yield from windows(text, start, end, self.size, self.overlap, self.snap)

        return _by_document(documents, self.name, cut)


@dataclass(frozen=True)
class MarkdownHeading:
    """Whole sections where they fit; small ones join the next, large ones are cut into windows."""

    size: int
    least: int = 0
    overlap: int = 0

    @property
    def name(self) -> str:
        return f"markdown-heading-{self.size}-{self.least}-{self.overlap}"

    def chunk(self, documents: DataFrame) -> DataFrame:
        check_window(self.size, self.overlap)
        if not 0 <= self.least < self.size:
            raise ContractError("the least section must be at least zero and below the largest")

        def cut(text: str) -> Iterator[tuple[int, int]]:
            for start, end in joined_sections(sections(text), self.least):
                if end - start <= self.size:
                    if end > start:
                        yield start, end
                else:
                    yield from windows(text, start, end, self.size, self.overlap, 0)

        return _by_document(documents, self.name, cut)


def identified(ranges: DataFrame, name: str) -> DataFrame:
    """Chunks with digests and content-addressed ids from (document_id, ordinal, byte_start, byte_end, text)."""
    out = ranges.withColumns({"content_digest": t.digest("text"), "chunker": F.lit(name)})
    key = t.chunk_id(F.col("document_id"), F.col("chunker"), F.col("byte_start").cast("int"), F.col("byte_end").cast("int"), F.col("content_digest"))
    return out.withColumns({"id": key, "ordinal": F.col("ordinal").cast("int"), "byte_start": F.col("byte_start").cast("int"), "byte_end": F.col("byte_end").cast("int")}).select(*CHUNK_COLUMNS)


def from_ranges(documents: DataFrame, ranges: DataFrame, name: str) -> DataFrame:
    """Chunks at given byte ranges (document_id, byte_start, byte_end), which must be ordered and apart."""
    listed = ranges.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("byte_start", "byte_end"))).alias("r"))
    # a document meets all its ranges in one row: its text is neither copied nor read again for each
    joined = listed.join(documents.select(F.col("id").alias("document_id"), F.col("text").alias("whole")), "document_id", "left")
    error = lambda: F.raise_error(F.concat(F.lit("invalid range in document "), F.col("document_id")))

    def cut(data: Column) -> Column:
        def piece(x: Column, i: Column) -> Column:
            start, end = x["byte_start"], x["byte_end"]
            before = F.when(i > 0, F.try_element_at("r", i)["byte_end"])
            fits = data.isNotNull() & (start >= 0) & (end > start) & (end <= F.octet_length(data)) & ~F.coalesce(before > start, F.lit(False))
            text = F.when(fits, F.substring(data, start + 1, end - start).cast("string"))
            return F.struct(i.alias("ordinal"), start.alias("byte_start"), end.alias("byte_end"), F.when(F.is_valid_utf8(text), text).otherwise(error().cast("string")).alias("text"))

        return F.transform("r", piece)

    return identified(joined.select("document_id", F.inline(let(F.col("whole").cast("binary"), cut))), name)


def _by_document(documents: DataFrame, name: str, cut) -> DataFrame:
    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, text in zip(batch["id"], batch["text"], strict=True):
                at, chars, n = 0, 0, 0
                spans = list(cut(text or ""))
                for start, end in spans:
                    # windows may overlap: count bytes on from the last start, never from the beginning
                    at, chars = (at + len(text[chars:start].encode()), start) if start >= chars else (at - len(text[start:chars].encode()), start)
                    piece = text[start:end]
                    rows.append((doc, n, at, at + len(piece.encode()), piece))
                    n += 1
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _RANGES.split(", ")])

    return identified(documents.select("id", "text").mapInPandas(task, _RANGES), name)


def windows(text: str, begin: int, end: int, size: int, overlap: int, snap: int) -> Iterator[tuple[int, int]]:
    """Code point windows of text[begin:end]."""
    start = begin
    while start < end:
        stop = min(start + size, end)
        if snap > 0 and stop < end:
            stop = _sentence_end(text, start, stop, overlap, snap)
        yield start, stop
        if stop == end:
            return
        start = stop - overlap


def _sentence_end(text: str, start: int, stop: int, overlap: int, snap: int) -> int:
    """The last sentence end within reach, unless the next window would not move on."""
    lowest = max(stop - snap, start + 1)
    last = max(text.rfind(mark, lowest - 1, stop) for mark in ".!?\n") + 1
    return last if last > 0 and last > start + overlap else stop


HEADING = re.compile(r" {0,3}#{1,6}(?:[ \t]|$)")
FENCE = re.compile(r" {0,3}(`{3,}|~{3,})(.*)", re.DOTALL)


class Fences:
    """Whether lines, given in order, lie in or open or close a code fence."""

    def __init__(self) -> None:
        self.open = ""

    def covers(self, line: str) -> bool:
        found = FENCE.match(line)
        if self.open:
            if found and found[1][0] == self.open[0] and len(found[1]) >= len(self.open) and not found[2].strip():
                self.open = ""
            return True
        if found:
            self.open = found[1]
            return True
        return False


def sections(text: str) -> list[tuple[int, int]]:
    """Code point ranges that begin at structural headings; what stands before the first is one too."""
    if not text:
        return []
    starts, at, fences = [0], 0, Fences()
    for line in text.split("\n"):
        if not fences.covers(line.removesuffix("\r")) and at and HEADING.match(line.removesuffix("\r")):
            starts.append(at)
        at += len(line) + 1
    return list(zip(starts, [*starts[1:], len(text)], strict=True))


def joined_sections(parts: list[tuple[int, int]], least: int) -> list[tuple[int, int]]:
    """Sections below the least size begin the next one; a small last one ends the one before it.

    A section's own size decides, without what waits before it; the last one, if small, is put to the
    one before even if others wait.
    """
    if least <= 0 or len(parts) <= 1:
        return parts
    out: list[tuple[int, int]] = []
    waiting: int | None = None
    for k, (start, end) in enumerate(parts):
        small, last = end - start < least, k == len(parts) - 1
        if small and not last:
            waiting = start if waiting is None else waiting
            continue
        if small and last and out:
            out[-1] = (out[-1][0], end)
        else:
            out.append((start if waiting is None else waiting, end))
        waiting = None
    return out


def heading_paths(text: str, title: str | None, byte_starts: list[int]) -> list[str]:
    """For each byte position the document's title and the latest heading of each level that governs it.

    One pass over the text for all positions: lines that end before a position are read once, and only the
    line that it lies in is read up to it.
    """
    data, head = text.encode(), [title.strip()] if title and title.strip() else []
    levels, fences, at, out = [""] * 7, Fences(), 0, [""] * len(byte_starts)
    end = data.find(b"\n")

    def read(line: bytes, levels: list[str], fences: Fences) -> None:
        line = line.decode("utf-8", "replace")
        if not fences.covers(line) and (found := re.match(r"(#{1,6}) (.*)", line.strip(), re.DOTALL)):
            level = len(found[1])
            levels[level:] = [found[2].strip(), *[""] * (6 - level)]

    for k in sorted(range(len(byte_starts)), key=byte_starts.__getitem__):
        start = stop = min(byte_starts[k], len(data))
        if start < len(data) and (start == 0 or data[start - 1 : start] == b"\n"):
            stop = data.find(b"\n", start)
            stop = len(data) if stop < 0 else stop
        while 0 <= end < stop:
            read(data[at:end], levels, fences)
            at = end + 1
            end = data.find(b"\n", at)
        own = levels
        # most lines are neither headings nor fences, and a long one is not read again for each position in it
        if data[at : min(at + 8, stop)].strip()[:1] in (b"#", b"`", b"~", b""):
            own, passing = list(levels), Fences()
            passing.open = fences.open
            read(data[at:stop], own, passing)
        rest = [x for n, x in enumerate(own) if x and not (n == 1 and head and head[-1] == x)]
        out[k] = " > ".join(head + rest) or "(document root)"
    return out


def heading_path(text: str, title: str | None, byte_start: int) -> str:
    return heading_paths(text, title, [byte_start])[0]


def chunk_all(chunker, documents: DataFrame) -> DataFrame:
    """Chunks of all documents in document and ordinal order."""
    return chunker.chunk(documents).orderBy("document_id", "ordinal")
