"""Alignment of the tokens of two tokenizers over the same bytes, by a dangling-suffix transducer.

The transducer reads both token sequences from the left. Its state is which side leads and the bytes by which it
leads, the residual: the rest of one token, as the lagging side always moves next. A transition takes the
lagging side's next token: inside the residual it shortens it, past it the sides change. An empty residual is a
place where tokens of both end, and closes a group. Every transition from a residual is a pair of tokens that
overlap: a link. Transitions are remembered by state and token, and texts repeat them.

How many documents hold a pair of ids linked, and which of its partners an id of the first side is linked to in most
documents, are counted over all documents: batches list their distinct pairs once (`batch_values`).

A text is cut at single blanks between characters that are none. Both tokenizers always end a token there (the vocabulary's
pattern takes such a blank with what follows, and the model has no piece with a blank after another character), so
that groups end there too. Segments repeat as words do: each is encoded and aligned once while it is remembered.

Defined cases: a null or empty text, or one whose tokens do not spell blank + text on both sides (the mark that stands for
blanks, standing in the text itself), has no tokens: zeros, no groups; equal texts get equal rows; null ids are
documents like others; columns called like results are replaced, others pass through; an empty table gives an
empty result. Texts over PART characters are cut at blanks between letters, digits or closing marks, where both
tokenizers always end a token, so that memory is bounded; one without such blanks is encoded whole.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.llm import batch_values as bv
from lodestack.llm.common import Workspace, regroup

#: Segments that a worker remembers, in two halves: some 300 bytes each, as longer ones than REMEMBERED characters are not.
SEGMENTS, REMEMBERED = 400_000, 64
#: Characters that are encoded in one call.
CALL = 500_000
SAFE_BLANK = re.compile(r"(?<=\S) (?=\S)")
SHIFT = 20
RESULTS = ("n_a", "n_b", "n_groups", "n_links", "groups", "n_best", "count_sum")


def byte_alphabet() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 for itself, the other bytes, in order, from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteLevel:
    """Side A: a byte-level vocabulary of the tokenizers library; special strings in texts are plain text."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.own.encode_special_tokens = True
        letters = byte_alphabet()
        self.bytes = [b""] * self.own.get_vocab_size()
        for token, i in self.own.get_vocab().items():
            self.bytes[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        self.cuts = True

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]


class Pieces:
    """Side B: a sentencepiece model that puts a blank before the text."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.own = SentencePieceProcessor(model_file=path)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        # a piece with a blank after another character could span a cut
        self.cuts = not any("▁" in p.lstrip("▁") for p in pieces)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


class Transducer:
    """States, and transitions by state and token; both are forgotten together when there are `most` of the latter."""

    def __init__(self, a_bytes: list[bytes], b_bytes: list[bytes], most: int = 1_000_000):
        self.a_bytes, self.b_bytes, self.most = a_bytes, b_bytes, most
        self._forget()

    def _forget(self) -> None:
        self.states: dict[tuple[bool, bytes], int] = {(True, b""): 0}
        self.leads, self.rest = [True], [b""]
        self.steps: dict[int, int] = {}

    def _state(self, a_leads: bool, rest: bytes) -> int:
        if (found := self.states.get((a_leads, rest))) is None:
            found = self.states[a_leads, rest] = len(self.rest)
            self.leads.append(a_leads)
            self.rest.append(rest)
        return found

    def _step(self, state: int, token: int) -> int:
        """The transition of the lagging side's token; the empty state takes a token of A."""
        rest = self.rest[state]
        if not state:
            return self._state(True, self.a_bytes[token])
        a_leads = self.leads[state]
        own = (self.b_bytes if a_leads else self.a_bytes)[token]
        if own == rest:
            return 0
        if rest.startswith(own):
            return self._state(a_leads, rest[len(own) :])
        if own.startswith(rest):
            return self._state(not a_leads, own[len(rest) :])
        raise ValueError("the two sides spell different bytes")

    def align(self, a: list[int], b: list[int]) -> tuple[list[int], list[tuple[int, int]]]:
        """Links, as id of A << SHIFT | id of B, and for each group how many tokens of each side end with it."""
        if len(self.steps) > self.most:
            self._forget()
        steps, leads, step = self.steps, self.leads, self._step
        links, ends, i, j, state, lead, n = [], [], 0, 0, 0, 0, len(a)
        while i < n or state:
            a_leads = leads[state]
            if not state:
                token = lead = a[i]
                i += 1
            elif a_leads:
                token = b[j]
                j += 1
                links.append(lead << SHIFT | token)
            else:
                token = a[i]
                i += 1
                links.append(token << SHIFT | lead)
            key = state << SHIFT | token
            after = steps.get(key)
            if after is None:
                after = steps[key] = step(state, token)
            if not after:
                ends.append((i, j))
            elif leads[after] != a_leads:
                lead = token
            state = after
        return links, ends


def groups_text(a: list[str], b: list[str], ends: list[tuple[int, int]]) -> str:
    """`a1,a2|b1;a3|b2,b3`: ids of A and of B of each group."""
    out, p, q = [], 0, 0
    for i, j in ends:
        out.append(f"{','.join(a[p:i])}|{','.join(b[q:j])}")
        p, q = i, j
    return ";".join(out)


#: What a segment gives: tokens of A, of B, groups, groups as text, links as 64-bit integers in a row. None: the sides spell other bytes.
Aligned = tuple[int, int, int, str, bytes]


class Aligner:
    def __init__(self, a_path: str, b_path: str, most: int = SEGMENTS):
        self.a, self.b = ByteLevel(a_path), Pieces(b_path)
        self.cuts = self.a.cuts and self.b.cuts
        self.transducer = Transducer(self.a.bytes, self.b.bytes)
        self.a_names, self.b_names = ([str(i) for i in range(len(x.bytes))] for x in (self.a, self.b))
        self.most = most
        self.newer: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def texts(self, texts: list[str | None]):
        """What each text gives, a bounded part of the texts at a time."""
        waiting, size = [], 0
        for text in texts:
            waiting.append((SAFE_BLANK.split(text) if self.cuts else [text]) if text else [])
            size += len(text or "")
            if size >= CALL:
                yield from self._some(waiting)
                waiting, size = [], 0
        yield from self._some(waiting)

    def _some(self, waiting: list[list[str]]):
        found = self._segments({s for segments in waiting for s in segments})
        for segments in waiting:
            own = list(map(found.__getitem__, segments))
            if not own or None in own:
                yield 0, 0, 0, "", b""
            else:
                n_a, n_b, n_groups, groups, links = zip(*own, strict=True)
                yield sum(n_a), sum(n_b), sum(n_groups), ";".join(groups), b"".join(links)

    def _segments(self, wanted: set[str]) -> dict[str, Aligned | None]:
        """Segments from what is remembered; the others are encoded. What is met moves to the newer half."""
        if len(self.newer) > self.most // 2:
            self.newer, self.older = {}, self.newer
        newer, older = self.newer, self.older
        out, new = {}, []
        for s in wanted:
            if s in newer:
                out[s] = newer[s]
            elif s in older:
                out[s] = newer[s] = older[s]
            else:
                new.append(s)
        at = 0
        while at < len(new):  # one long segment does not go in one call with others
            end, size = at, 0
            while end < len(new) and (end == at or size + len(new[end]) <= CALL):
                size, end = size + len(new[end]), end + 1
            some = new[at:end]
            for s, a, b in zip(some, self.a.encode(some), self.b.encode(some), strict=True):
                out[s] = self._one(s, a, b)
                if len(s) <= REMEMBERED:
                    newer[s] = out[s]
            at = end
        return out

    def _one(self, segment: str, a: list[int], b: list[int]) -> Aligned | None:
        want = b" " + segment.encode()
        if b"".join(map(self.a.bytes.__getitem__, a)) != want or b"".join(map(self.b.bytes.__getitem__, b)) != want:
            return None
        links, ends = self.transducer.align(a, b)
        text = groups_text([self.a_names[x] for x in a], [self.b_names[x] for x in b], ends)
        return len(a), len(b), len(ends), text, array("q", links).tobytes()


_ALIGNERS: dict[tuple[str, str], Aligner] = {}
PAIR = "struct<a:int,b:int,n:int>"


def align(docs: DataFrame, a_path: str, b_path: str, keep: list[str] | None = None) -> DataFrame:
    """The columns of keep (all) with n_a, n_b, n_groups, n_links and groups; further columns for link_counts.

    Rows of batches (`batch_values`) are among them: link_counts takes them away.
    """
    keep = [c for c in (keep or docs.columns) if c not in RESULTS]
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias("__text"))
    made = [T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")] + [T.StructField("groups", T.StringType())]
    schema = bv.written_schema([*rows.schema.fields[:-1], *made], PAIR)
    names = [f.name for f in schema.fields]

    def task(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        kinds = to_arrow_schema(schema).types
        if (a_path, b_path) not in _ALIGNERS:
            _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
        aligner = _ALIGNERS[a_path, b_path]
        for number, batch in zip(bv.batch_ids(), regroup(batches, bv.ROWS, bv.BYTES)):
            n_a, n_b, n_groups, n_links, groups, pairs, times = [], [], [], [], [], [], []
            for a, b, g, text, links in aligner.texts(batch.column(batch.num_columns - 1).to_pylist()):
                linked = np.frombuffer(links, dtype=np.int64)
                found, often = np.unique(linked, return_counts=True)
                pairs.append(found)
                times.append(often)
                for column, value in ((n_a, a), (n_b, b), (n_groups, g), (n_links, len(linked)), (groups, text)):
                    column.append(value)
            listed, where, many = np.unique(np.concatenate([*pairs, np.zeros(0, np.int64)]), return_inverse=True, return_counts=True)
            ends = np.cumsum([len(p) for p in pairs])
            places = [bv.packed(where[e - len(t) : e], t) for e, t in zip(ends.tolist(), times, strict=True)]
            numbers = [pa.array(c, pa.int64()) for c in (n_a, n_b, n_groups, n_links)]
            yield bv.document_rows(number, [*batch.columns[:-1], *numbers, pa.array(groups, kinds[-4])], places, kinds, names)
            columns = [pa.array(c, pa.int32()) for c in (listed >> SHIFT, listed & ((1 << SHIFT) - 1), many)]
            yield bv.batch_row(number, pa.StructArray.from_arrays(columns, fields=list(kinds[-1].value_type)), kinds, names)

    return rows.mapInArrow(task, schema)


def link_counts(aligned: DataFrame, ws: Workspace) -> DataFrame:
    """Rows of align with n_best and count_sum in place of its further columns.

    A link's count is how many documents hold its pair; it is a best one if no pair of its id of A has a higher one."""
    written = ws.save(aligned, "aligned")
    pairs = bv.entries(written)
    counts = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    # an id of A has as many partners as side B has ids, at most
    counts = ws.save(counts.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a"))), "counts")
    values = pairs.select(bv.BATCH, "__k", "a", "b").join(counts, ["a", "b"]).select(bv.BATCH, "__k", "count", "best")

    def finish(docs, found):
        count, best = found
        n_best, total = [], []
        for places in docs.column(bv.PLACES).to_pylist():
            at, often = bv.unpacked(places)
            n_best.append(int(often[best[at].astype(bool)].sum()))
            total.append(int((often * count[at]).sum()))
        return [pa.array(n_best, pa.int64()), pa.array(total, pa.int64())]

    return bv.with_values(written, values, finish, "n_best long, count_sum long")
