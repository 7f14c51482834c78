"""The best rows of many queries inside a task, so that a search shuffles k rows a task and query."""

from __future__ import annotations

import numpy as np
import pandas as pd

from lodestack.operators.common import SCORE_DECIMALS

KEYS = ["document_id", "chunk_id", "representation_id"]
#: What a task yields; cut is the rounded score that ranks, made once so that every cut goes by the same.
BEST = "query_id string, representation_id string, chunk_id string, document_id string, score double, cut double"


class Best:
    """The first k rows of each query by (rounded score, ids), of all rows added so far; by_document: of the best row of each document.

    Holds k rows a query, and as many again for each of WAITING batches. A cut never goes by anything but
    the whole order: what stays does not depend on how rows are dealt into batches and tasks.
    """

    WAITING = 16

    def __init__(self, ids: list, k: int, by_document: bool = False):
        self.ids, self.k, self.by_document = np.asarray(ids, dtype=object), k, by_document
        self.held: list[pd.DataFrame] = []

    def add(self, scores: np.ndarray, keys: pd.DataFrame, present: np.ndarray | None = None) -> None:
        """scores: rows by queries; present: which of them are hits (None: all)."""
        n, q = scores.shape
        if not n or not q:
            return
        cut = np.round(scores, SCORE_DECIMALS) + 0.0  # no negative zero
        if present is not None:
            cut = np.where(present, cut, -np.inf)
        place = np.empty(n, dtype=np.int64)
        place[np.lexsort([keys[c].to_numpy().astype(str) for c in reversed(KEYS)])] = np.arange(n)
        table, group = cut, None
        if self.by_document:
            # rows in order of ids: a document's are side by side, and its first best one goes first
            order = np.argsort(place)
            names = keys["document_id"].to_numpy()[order]
            group = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            ordered = cut[order]
            table, place = np.maximum.reduceat(ordered, group, axis=0), np.arange(len(group))
        n = len(table)
        least = np.partition(table, n - self.k, axis=0)[n - self.k] if n > self.k else np.full(q, -np.inf)
        at, of = np.nonzero((table >= least[None, :]) & np.isfinite(table))
        sort = np.lexsort((place[at], -table[at, of], of))
        at, of = at[sort], of[sort]
        stays = np.arange(len(of)) - np.searchsorted(of, np.arange(q))[of] < self.k
        rows, queries = at[stays], of[stays]
        if group is not None:
            ends = np.append(group[1:], len(ordered))
            rows = order[[group[d] + int(np.argmax(ordered[group[d] : ends[d], x])) for d, x in zip(rows.tolist(), queries.tolist(), strict=True)]] if len(rows) else rows
        found = pd.DataFrame({"query": queries, "score": scores[rows, queries], "cut": cut[rows, queries], **{c: keys[c].to_numpy()[rows] for c in KEYS}})
        self.held.append(found)
        if len(self.held) > self.WAITING:
            self.held = [self._merged()]

    def _merged(self) -> pd.DataFrame:
        whole = pd.concat(self.held, ignore_index=True)
        whole = whole.sort_values(["query", "cut", *KEYS], ascending=[True, False, True, True, True])
        if self.by_document:
            whole = whole.drop_duplicates(["query", "document_id"])
        return whole.groupby("query", sort=False).head(self.k)

    def rows(self) -> pd.DataFrame | None:
        if not self.held:
            return None
        out = self._merged()
        out["query_id"] = self.ids[out["query"].to_numpy()]
        return out[["query_id", "representation_id", "chunk_id", "document_id", "score", "cut"]]
