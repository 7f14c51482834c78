"""Hierarchical packing into several context sizes, with gaps of long windows filled from shorter tiers.

Each task packs what it reads, in one pass and bounded memory; nothing is shuffled. Documents are
tokenised and routed to the smallest tier (context size) that holds them; what is over the longest
tier is cut into whole windows first and its rest routed. When the pool of a task holds POOL ids, or
its input ends, tiers are packed from the longest down: pieces of the tier by size, then the gap is
filled with the largest fitting pieces of shorter tiers, and the last gap with a cut piece, so every
window but the last of a task is full. That last one is cut into the powers of two that make up its
length where that pads less. Windows are dealt into step groups of about equal attention cost.

Defined cases: a null text is an empty document (its end id only); repeated rows are packed each for
itself; null ids stay null; of pieces of one length the one read last is taken first; a very long
text is cut into windows of the longest tier and a rest; an empty table gives no pieces; extra columns are left out.
"""

from __future__ import annotations

import bisect
import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.common import MEMO_PIECES, regroup, text_or_empty, token_memo

TIERS = (256, 512, 1024, 2048)
POOL = 2_000_000
STEP_WINDOWS = 16
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"


class Shelf:
    """Pieces (document, start, length) of one tier, taken by length."""

    def __init__(self):
        self.sizes: list[int] = []
        self.by_size: dict[int, list[tuple[int, int]]] = {}

    def put(self, doc: int, start: int, length: int) -> None:
        if length not in self.by_size:
            self.by_size[length] = []
            bisect.insort(self.sizes, length)
        self.by_size[length].append((doc, start))

    def take(self, most: int) -> tuple[int, int, int] | None:
        """The largest piece of at most that length."""
        at = bisect.bisect_right(self.sizes, most) - 1
        if at < 0:
            return None
        length = self.sizes[at]
        doc, start = self.by_size[length].pop()
        if not self.by_size[length]:
            del self.by_size[length]
            del self.sizes[at]
        return doc, start, length


def pack(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of (size, [(document, start, length)]): all are full but at most one, the last."""
    shelves, longest = [Shelf() for _ in tiers], tiers[-1]
    windows = []
    for doc, n in enumerate(lengths):
        whole = n - n % longest
        windows += [(longest, [(doc, at, longest)]) for at in range(0, whole, longest)]
        if n > whole:
            shelves[bisect.bisect_left(tiers, n - whole)].put(doc, whole, n - whole)
    rest: list[tuple[int, int, int]] = []
    for k in range(len(tiers) - 1, -1, -1):
        size, shelf = tiers[k], shelves[k]
        while piece := shelf.take(size):
            window, gap = [piece], size - piece[2]
            for lower in range(k, -1, -1):  # own tier first, then gap filling from shorter ones
                while gap and (piece := shelves[lower].take(gap)):
                    window.append(piece)
                    gap -= piece[2]
            while gap:  # only longer pieces are left: cut the shortest
                piece = next((shelves[j].take(shelves[j].sizes[0]) for j in range(k + 1) if shelves[j].sizes), None)
                if piece is None:
                    break
                doc, start, length = piece
                used = min(gap, length)
                window.append((doc, start, used))
                gap -= used
                if length > used:
                    left = length - used
                    shelves[bisect.bisect_left(tiers, left)].put(doc, start + used, left)
            if gap:
                rest += window
            else:
                windows.append((size, window))
    return windows + _last(rest, longest)


def _last(rest: list[tuple[int, int, int]], longest: int) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """What is left, cut into powers of two that need no padding."""
    windows, total, at = [], sum(x[2] for x in rest), 0
    pieces = list(reversed(rest))
    while total:
        size = min(longest, 1 << (total.bit_length() - 1))
        window, gap = [], size
        while gap:
            doc, start, length = pieces.pop()
            used = min(gap, length)
            window.append((doc, start, used))
            if used < length:
                pieces.append((doc, start + used, length - used))
            gap -= used
        windows.append((size, window))
        total -= size
        at += size
    return windows


def step_groups(costs: list[int], windows: int = STEP_WINDOWS) -> list[int]:
    """A group for each window: costliest first, each to the cheapest group with room."""
    n = max(1, -(-len(costs) // windows))
    heap, room, out = [(0, g) for g in range(n)], [windows] * n, [0] * len(costs)
    for i in sorted(range(len(costs)), key=lambda i: -costs[i]):
        cost, g = heapq.heappop(heap)
        out[i] = g
        room[g] -= 1
        if room[g]:
            heapq.heappush(heap, (cost + costs[i], g))
    return out


def pack_documents(docs: DataFrame, vocabulary: str, tiers: tuple[int, ...] = TIERS, end_id: int = 1, pool: int = POOL, memo_pieces: int = MEMO_PIECES, batch_bytes: int = 12_000_000) -> DataFrame:
    """Pieces of all documents. sequence_id is unique over all tasks; a task's number is its upper half.

    pool, memo_pieces and batch_bytes bound a worker's memory: ids held for packing, pieces remembered
    by the tokenizer's memo, and text encoded at once. Only the first has a part in what is packed where.
    """

    def task(batches):
        from pyspark import TaskContext

        memo, base = token_memo(vocabulary, memo_pieces), TaskContext.get().partitionId() << 40
        held, held_ids, sequence, group = [], 0, 0, 0
        for batch in regroup(batches, 8192, batch_bytes):
            ids, starts = memo.encode(batch.column("text"))
            ids = np.insert(ids, starts[1:], end_id)
            starts = starts + np.arange(len(starts))
            held.append((batch.column("doc_id"), ids, starts))
            held_ids += len(ids)
            if held_ids >= pool:
                out, sequence, group = _pieces(held, tiers, base, sequence, group)
                yield out
                held, held_ids = [], 0
        if held:
            yield _pieces(held, tiers, base, sequence, group)[0]

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(task, PIECES)


def _pieces(held, tiers, base: int, sequence: int, group: int):
    known = pa.concat_arrays([x[0] for x in held])
    ids = np.concatenate([x[1] for x in held]).astype("<u4")
    sizes = np.concatenate([np.diff(x[2]) for x in held])
    begins = np.concatenate([[0], np.cumsum(sizes)])
    windows = pack(sizes.tolist(), tiers)
    groups = step_groups([sum(p[2] ** 2 for p in w) for _, w in windows])
    flat = [(doc, start, length, sequence + k, groups[k] + group) for k, (_, w) in enumerate(windows) for doc, start, length in w]
    counts = [len(w) for _, w in windows]
    doc, start, length, seq, grp = (np.array(x, dtype=np.int64) for x in zip(*flat, strict=True))
    offset = np.cumsum(length) - length
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    offset -= np.repeat(offset[first], counts)
    total = np.repeat(np.add.reduceat(length, first), counts)
    tier = np.repeat(np.array([s for s, _ in windows], dtype=np.int32), counts)
    data, at = memoryview(ids.tobytes()), ((begins[doc] + start) * 4).tolist()
    crc = [zlib.crc32(data[a : a + 4 * n]) for a, n in zip(at, length.tolist(), strict=True)]
    columns = [known.take(pa.array(doc)), start, length, pa.array(crc, pa.int64()), sizes[doc].astype(np.int64), seq + base, offset, total, tier, grp + base]
    out = pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in columns], [c.split()[0] for c in PIECES.split(", ")])
    return out, sequence + len(windows), group + max(groups) + 1
