"""Connected components of a link table, labelled by the smallest id that can be reached.

Links are contracted by alternating large-star and small-star steps: each is a grouped minimum and a
join on the node, so hubs are combined map-side and split by skew handling, and a chain of n nodes
takes about log n rounds. Each round is written to the shared folder. A table of at most LOCAL_LINKS
links (16 MB, counted first) is resolved by one task instead; nothing goes through the driver.

Defined cases: no links give no labels; repeated links and links to itself change nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import Workspace

LOCAL_LINKS = 1_000_000
LABELS = "id long, component long"


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = x
        while (above := up.get(root, root)) != root:
            root = above
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, a: int, b: int) -> bool:
        """Whether they were apart."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        self.up.setdefault(min(a, b), min(a, b))
        return True


def _resolve(batches):
    sets = UnionFind()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(a, b)
    ids = list(sets.up)
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([sets.find(x) for x in ids], pa.int64())], ["id", "component"])


def components(links: DataFrame, ws: Workspace, local_links: int = LOCAL_LINKS) -> DataFrame:
    """links: columns a and b (long). Returns id and component of every linked id, as a written table."""
    links = links.select("a", "b").where("a <> b")
    if links.count() <= local_links:
        return ws.save(links.coalesce(1).mapInArrow(_resolve, LABELS), "labels")
    links, state = ws.save(links.distinct(), "links"), None
    while True:
        links = ws.save(_small_star(_large_star(links)), "star")
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    labels = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = links.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return ws.save(labels.unionByName(roots), "labels")


def _large_star(links: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = links.select("a", "b").union(links.select("b", "a"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
