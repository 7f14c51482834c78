"""Simple-8b word-aligned coding of non-negative ids, vectorised over blocks of 128 ids.

A 64-bit word holds a 4-bit selector above 60 bits of payload: the selector says how many ids of how
many bits follow, lowest bits first. Selector 15 escapes an id of over 60 bits: its payload is empty
and the next word is the id itself. Blocks are coded each for itself, so the offsets of their first
words let a reader decode any block alone or all of them at once.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
#: Ids in a word and bits of each, by selector 0 to 13; 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], dtype=np.int64)
BITS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], dtype=np.int64)
ESCAPE = 15
SELECTOR = np.uint64(60)
PAYLOAD = np.uint64((1 << 60) - 1)


def _widths(ids: np.ndarray) -> np.ndarray:
    """Smallest selector whose field holds each id (14: none does)."""
    return np.searchsorted((np.uint64(1) << BITS.astype(np.uint64)) - np.uint64(1), ids.astype(np.uint64), side="left").astype(np.uint8)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words uint64, first word of each block int64 with the total at the end)."""
    ids = np.ascontiguousarray(ids).astype(np.uint64)
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return np.zeros(0, dtype=np.uint64), np.zeros(1, dtype=np.int64)
    widest = _widths(ids)
    # the selector that takes most ids from each position on: runs grow while their widest id fits
    best = np.maximum(widest, np.uint8(13))
    reach, covered = widest, 1
    for s in range(len(COUNTS) - 2, -1, -1):
        m = int(COUNTS[s])
        if m > n:
            break
        grown = np.full(n, 255, dtype=np.uint8)
        if n >= m:
            step = m - covered
            grown[: n - m + 1] = np.maximum(reach[: n - m + 1], reach[step : step + n - m + 1]) if step <= covered else _running(widest, m)
        reach, covered = grown, m
        np.copyto(best, np.uint8(s), where=grown <= s)
    begin = np.arange(n_blocks, dtype=np.int64) * BLOCK
    end = np.minimum(begin + BLOCK, n)
    lanes, at = np.arange(n_blocks), begin.copy()
    out_lane, out_at, out_sel = [], [], []
    while len(lanes):
        sel = best[at].astype(np.int64)
        left = end[lanes] - at
        escaped = sel == 14
        take = np.where(escaped, 1, COUNTS[np.minimum(sel, 13)])
        short = (take > left) & ~escaped
        if short.any():  # a run may not pass the block's end: the selector of the most ids that are left
            sel[short] = np.searchsorted(-COUNTS, -left[short], side="left")
            take[short] = COUNTS[sel[short]]
        out_lane.append(lanes)
        out_at.append(at)
        out_sel.append(sel)
        at = at + take
        more = at < end[lanes]
        lanes, at = lanes[more], at[more]
    lane, pos, sel = np.concatenate(out_lane), np.concatenate(out_at), np.concatenate(out_sel)
    order = np.lexsort((pos, lane))
    pos, sel, lane = pos[order], sel[order], lane[order]
    room = np.where(sel == 14, 2, 1)
    place = np.concatenate([[0], np.cumsum(room)])
    words = np.zeros(place[-1], dtype=np.uint64)
    for s in range(len(COUNTS)):
        rows = np.flatnonzero(sel == s)
        if len(rows):
            word, m, b = np.full(len(rows), np.uint64(s) << SELECTOR), int(COUNTS[s]), int(BITS[s])
            for j in range(m):
                word |= ids[pos[rows] + j] << np.uint64(j * b)
            words[place[rows]] = word
    rows = np.flatnonzero(sel == 14)
    words[place[rows]] = np.uint64(ESCAPE) << SELECTOR
    words[place[rows] + 1] = ids[pos[rows]]
    first = np.searchsorted(lane, np.arange(n_blocks), side="left")
    return words, np.concatenate([place[first], [place[-1]]])


def _running(values: np.ndarray, m: int) -> np.ndarray:
    """Largest of each m values in a row, by doubling."""
    out, have = values, 1
    while have < m:
        step = min(have, m - have)
        out = np.maximum(out[: len(out) - step], out[step:])
        have += step
    return out


def decode(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids (uint64) of all blocks; offsets as encode() gave them."""
    if not n:
        return np.zeros(0, dtype=np.uint64)
    words = np.asarray(words, dtype=np.uint64)
    sel = (words >> SELECTOR).astype(np.int64)
    raw = np.zeros(len(words), dtype=bool)
    if (sel == ESCAPE).any():  # a raw word may look like any selector: step over it block by block
        raw = _raw_words(sel, np.asarray(offsets))
    take = np.where(sel == ESCAPE, 0, COUNTS[np.minimum(sel, 13)])
    take[raw] = 1
    place = np.concatenate([[0], np.cumsum(take)])
    out = np.zeros(place[-1], dtype=np.uint64)
    for s in range(len(COUNTS)):
        rows = np.flatnonzero((sel == s) & ~raw)
        if len(rows):
            load, b = words[rows] & PAYLOAD, np.uint64(BITS[s])
            mask = (np.uint64(1) << b) - np.uint64(1)
            for j in range(int(COUNTS[s])):
                out[place[rows] + j] = (load >> np.uint64(j * int(b))) & mask
    out[place[:-1][raw]] = words[raw]
    return out


def _raw_words(sel: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    raw = np.zeros(len(sel), dtype=bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        if (sel[a:b] == ESCAPE).any():
            i = a
            while i < b:
                if sel[i] == ESCAPE:
                    raw[i + 1] = True
                    i += 1
                i += 1
    return raw
