"""Near-duplicates by b-bit MinHash: banded candidates, packed signatures, links confirmed on full sets.

A document's set is its distinct word shingles as 64-bit hashes. Equal sets become one class first, so
copies cost nothing further. For each class the minima of 128 hash functions are kept twice: hashed by
four into 32 bands (two sets of similarity s share none with probability (1 - s^4)^32, 6e-11 at 0.85),
and their lowest four bits packed into 64 bytes, from which the share of equal minima, corrected for
chance, estimates similarity by bit counts.

No bucket is expanded into pairs:
1. star: each member of a bucket is estimated against the bucket's smallest id;
2. in buckets whose members are still apart, those outside the bucket's largest component are compared
   with all others in blocks of bounded size, inside tasks, by signature alone; only links that join
   something new leave the task;
3. what hangs together by estimate is a cluster. Only for clusters the texts are read again. Members
   are confirmed on their sets against a hub block of their cluster, again in bounded blocks, and
   only links that join something new leave the task;
4. in clusters of several blocks that still have several components, members outside the largest one are
   compared with all that they are apart from, by signature alone; only those that are alike to a member
   of another component are confirmed on their sets.
Hot buckets and clusters are few and their sizes broadcast, so that no bucket or cluster meets in one
task. Rows are copied once for each block that they face, so blocks of signatures grow with their group: up
to 131,072 members a row is copied sixteen times at most, and above once for every 8,192 members.
To drop a pair, so few minima must be equal that a pair at the threshold has no more with probability
MISSED at most (exact binomial tail).

Defined cases: a null text, or one without words, has an empty set (0 shingles) and is linked with
nothing; with fewer words than a shingle the whole sequence is the one shingle; rows without doc_id
are linked with nothing and have a null component; repeated rows and equal texts are one class; rows of
one doc_id are one document, so different texts under one id are in one component; the component is its
smallest doc_id; an empty table gives an empty result; extra columns are not read; sets of very long texts
are whole.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import Workspace, forget, key_runs, regroup, release, spread_join
from lodestack.llm.components import UnionFind, components

HASHES, ROWS, BITS = 128, 4, 4
BANDS = HASHES // ROWS
#: Rows of a block of sets; of signatures (64 bytes each) a block holds a sixteenth of its group, within bounds.
BLOCK = 512
SIGNATURES = (256, 8_192)
MISSED = 3e-6
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LANES = np.uint64(0x1111111111111111)


class WordHashes(dict):
    """word -> 64-bit hash, kept for MOST words at a time, until a task ends: workers wait for other work with what they hold."""

    MOST = 150_000

    def room(self) -> None:
        if len(self) > self.MOST:
            self.clear()

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


_WORDS = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def _multipliers(n: int, seed: int) -> np.ndarray:
    """Odd 64-bit numbers from a fixed rule."""
    return _mixed((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed)) * _STEP) | np.uint64(1)


FACTORS = _multipliers(HASHES, 1_000)
BAND_PLACES = _multipliers(ROWS, 77)
BAND_MARKS = np.arange(BANDS, dtype=np.uint64) * _STEP
PLACES = _multipliers(64, 0)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct shingle hashes; A to Z in lower case, words cut at U+0020 and U+0009 to U+000D."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.zeros(0, dtype=np.uint64)
    codes = np.fromiter(map(_WORDS.__getitem__, words), dtype=np.uint64, count=len(words))
    place = PLACES[:size]
    if len(codes) < size:
        parts = np.append(codes * place[: len(codes)], np.array([len(codes)], dtype=np.uint64) * _STEP)
        return _mixed(parts.sum(dtype=np.uint64, keepdims=True))
    n = len(codes) - size + 1
    total = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        total += codes[j : j + n] * place[j]
    return np.unique(_mixed(total))


def minima(hashes: np.ndarray) -> np.ndarray:
    """Minimum of each hash function over a set that is not empty."""
    least = np.full(HASHES, np.uint64(0xFFFFFFFFFFFFFFFF))
    for start in range(0, len(hashes), 1024):
        part = (hashes[start : start + 1024, None] * FACTORS[None, :]) >> np.uint64(16)
        least = np.minimum(least, part.min(axis=0))
    return least


def pack(least: np.ndarray) -> bytes:
    """The lowest BITS bits of the minima, two to a byte."""
    low = (least & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (low[0::2] | (low[1::2] << 4)).tobytes()


def signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype="<u8").reshape(-1, HASHES * BITS // 64)


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity from packed signatures (last axis): equal lanes by bit count, corrected for chance."""
    x = a ^ b
    x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & _LANES
    equal = 1.0 - np.bitwise_count(x).sum(axis=-1) / HASHES
    chance = 2.0**-BITS
    return (equal - chance) / (1.0 - chance)


def lowest_estimate(percent: int) -> float:
    """Half a lane below the least number of equal lanes whose lower tail at the threshold exceeds MISSED."""
    chance = 2.0**-BITS
    p = chance + (1 - chance) * percent / 100
    tail, equal = 0.0, 0
    while equal < HASHES and (tail := tail + math.comb(HASHES, equal) * p**equal * (1 - p) ** (HASHES - equal)) <= MISSED:
        equal += 1
    return ((equal - 0.5) / HASHES - chance) / (1 - chance)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union, on full sets."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(both) - common)


def _signed(docs: DataFrame, size: int) -> DataFrame:
    def task(batches):
        forget()
        for batch in regroup(batches, 512, 2_000_000):
            _WORDS.room()
            n, key, bands, sig = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                if not len(s):
                    key.append(None), bands.append(None), sig.append(None)
                    continue
                least = minima(s)
                key.append(xxhash.xxh128_digest(s.tobytes()))
                keys = (least.reshape(BANDS, ROWS) * BAND_PLACES).sum(axis=1, dtype=np.uint64) + BAND_MARKS
                bands.append(_mixed(keys).view(np.int64))
                sig.append(pack(least))
            arrays = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_shingles", "set_key", "sig", "bands"])
        _WORDS.clear()
        release()

    return docs.select("doc_id", "text").mapInArrow(task, "doc_id long, n_shingles long, set_key binary, sig binary, bands array<long>")


def _estimated(pairs: DataFrame, classes: DataFrame, lowest: float) -> DataFrame:
    def task(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(estimate(signatures(batch.column(2)), signatures(batch.column(3))) >= lowest))

    sig = classes.select("rep", "sig")
    both = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b").select("a", "b", "sig_a", "sig_b")
    return both.mapInArrow(task, both.schema).select("a", "b")


def _signature_block() -> Column:
    return F.least(F.greatest(F.ceil(F.col("n") / 16), F.lit(SIGNATURES[0])), F.lit(SIGNATURES[1]))


def _facing(rows: DataFrame, size: Column | int, main: str, n: str, n_main: str) -> DataFrame:
    """rows with (i, j, side) for each pair of blocks that they meet in; side is i or j.

    Members of the main component are only compared with those outside it. Blocks of others are
    0, 1, ..., those of the main component -1, -2, ...
    """
    n_other, n_own = (F.ceil(x / size).cast("int") for x in (F.col(n) - F.col(n_main), F.col(n_main)))
    outside = F.col("component") != F.col(main)
    at = F.pmod(F.xxhash64("id"), F.when(outside, n_other).otherwise(n_own)).cast("int")
    facing = F.when(outside, F.sequence(-n_own, n_other - 1)).otherwise(F.sequence(F.lit(0), n_other - 1))
    dealt = rows.withColumns({"side": F.when(outside, at).otherwise(-1 - at).cast("long"), "other": F.explode(facing.cast("array<long>"))})
    return dealt.withColumns({"i": F.greatest("side", "other"), "j": F.least("side", "other")}).drop("other")


def _main_components(rows: DataFrame, group: str) -> DataFrame:
    """group, main (the largest component), n_main, n and parts (number of components) of each group. rows: group, component.

    Components of a group are counted map-side; a group is then as many rows as it has components."""
    counts = rows.groupBy(group, "component").agg(F.count("*").alias("c"))
    return counts.groupBy(group).agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.max("c").alias("n_main"), F.sum("c").alias("n"), F.count("*").alias("parts"))


def _alike(rows: DataFrame, lowest: float, members: bool) -> DataFrame:
    """rows: bucket, i, j, side, id, component, sig. Links of a spanning forest of what is alike by estimate
    across components; or, with members, the ids that are alike to a member of another component."""

    def task(batches):
        for (_, i, j), table in key_runs(batches, ["bucket", "i", "j"]):
            ids, comp, side = (np.asarray(table.column(c)) for c in ("id", "component", "side"))
            sig = signatures(table.column("sig"))
            left = np.flatnonzero(side == i)
            right = left if i == j else np.flatnonzero(side == j)
            facing, beside = sig[right], comp[right]
            sets, out, met = UnionFind(), [], np.zeros(len(ids), dtype=bool)
            for x in left.tolist():
                near = np.flatnonzero((beside != comp[x]) & (estimate(facing, sig[x]) >= lowest))
                if members and len(near):
                    met[x] = True
                    met[right[near]] = True
                for y in [] if members else right[near].tolist():
                    if sets.join(int(comp[x]), int(comp[y])):
                        out.append((int(ids[x]), int(ids[y])))
            if members:
                out = [(x, x) for x in ids[met].tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    rows = rows.select("bucket", "i", "j", "side", "id", "component", "sig")
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").mapInArrow(task, "a long, b long")


def _confirmed(rows: DataFrame, percent: int, lowest: float) -> DataFrame:
    """rows: cluster, i, j, side, id, component, sig, set; side is i or j. Confirmed links that join something."""

    def task(batches):
        for (_, i, j), table in key_runs(batches, ["cluster", "i", "j"]):
            ids, comp, side = (np.asarray(table.column(c)) for c in ("id", "component", "side"))
            sig = signatures(table.column("sig"))
            sets = [np.frombuffer(x, dtype="<u8") for x in table.column("set").to_pylist()]
            left = np.flatnonzero(side == i)
            right = left if i == j else np.flatnonzero(side == j)
            found, out = UnionFind(), []
            for x in left.tolist():
                score = estimate(sig[right], sig[x])
                near = np.flatnonzero((score >= lowest) & (comp[right] != comp[x]))
                for y in right[near[np.argsort(-score[near], kind="stable")]].tolist():
                    if found.find(int(comp[x])) != found.find(int(comp[y])) and linked(sets[x], sets[y], percent):
                        found.join(int(comp[x]), int(comp[y]))
                        out.append((int(ids[x]), int(ids[y])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out, strict=True)], ["a", "b"])

    return rows.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(task, "a long, b long")


def _with_sets(docs: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """members: id, cluster, m, set_key, sig. The same with the set in place of its key, from the texts."""

    def task(batches):
        forget()
        for batch in regroup(batches, 256, 2_000_000):
            _WORDS.room()
            sets = [shingles(t, size) for t in batch.column("text").to_pylist()]
            data = [s.astype("<u8").tobytes() for s in sets]
            same = pa.array([xxhash.xxh128_digest(s.tobytes()) == k for s, k in zip(sets, batch.column("set_key").to_pylist(), strict=True)])
            arrays = [*(batch.column(c) for c in ("id", "cluster", "m", "sig")), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "cluster", "m", "sig", "set"]).filter(same)
        _WORDS.clear()
        release()

    found = docs.select(F.col("doc_id").alias("id"), "text").join(members, "id").select("id", "cluster", "m", "set_key", "sig", "text")
    return found.mapInArrow(task, "id long, cluster long, m long, sig binary, set binary")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, local_links: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept (doc_id = component_id) of each row."""
    # hashes hardly shrink: without a codec its native buffers do not add to the executors' memory
    ws = Workspace(docs.sparkSession, "near-dups", codec="none")
    lowest = lowest_estimate(percent)
    limit = {} if local_links is None else {"local_links": local_links}
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = ws.save(_signed(docs, size), "signed")
    # one class for each set; the minimum is combined map-side
    some = signed.where("set_key is not null and doc_id is not null")
    classes = some.groupBy("set_key").agg(F.min(F.struct("doc_id", "sig", "bands")).alias("x"), F.count("*").alias("copies"))
    classes = ws.save(classes.select("set_key", F.col("x.doc_id").alias("rep"), "x.sig", "x.bands", "copies"), "classes")

    dealt = classes.select("rep", F.explode("bands").alias("bucket"))
    shared = dealt.groupBy("bucket").agg(F.min("rep").alias("center"), F.max("rep").alias("last"), F.count("*").alias("n")).where("center < last")
    shared = ws.save(shared.drop("last"), "shared")
    rows = ws.save(spread_join(dealt, shared, "bucket", "n").where("center is not null"), "buckets")

    pairs = rows.where("rep <> center").select(F.col("center").alias("a"), F.col("rep").alias("b")).distinct()
    alike = ws.save(_estimated(pairs, classes, lowest), "alike")
    soft = components(alike, ws, **limit)

    placed = rows.where("n > 2").join(soft.withColumnRenamed("id", "rep"), "rep", "left").select("bucket", F.col("rep").alias("id"), F.coalesce("component", "rep").alias("component"))
    apart = ws.save(_main_components(placed, "bucket"), "apart")
    open_rows = spread_join(placed, apart, "bucket", "n").where("parts > 1").join(classes.select(F.col("rep").alias("id"), "sig"), "id")
    more = ws.save(_alike(_facing(open_rows, _signature_block(), "main", "n", "n_main"), lowest, members=False), "more")
    if not more.isEmpty():
        alike = alike.union(more)
        soft = components(alike, ws, **limit)

    members = soft.select("id", F.col("component").alias("cluster")).join(classes.select(F.col("rep").alias("id"), "set_key", "sig"), "id")
    sizes = ws.save(members.groupBy("cluster").agg(F.count("*").alias("m")), "sizes")
    members = ws.save(spread_join(members, sizes, "cluster", "m"), "members")
    sets = ws.save(_with_sets(docs, members, size), "sets")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    placed = sets.withColumn("side", F.pmod(F.xxhash64("id"), blocks).cast("long"))
    hub = F.when(F.col("side") == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(F.col("side").cast("int")))
    first = placed.withColumn("component", F.col("id")).withColumn("i", F.lit(0).cast("long")).withColumn("j", F.explode(hub))
    links = ws.save(_confirmed(first.select("cluster", "i", F.col("j").cast("long"), "side", "id", "component", "sig", "set"), percent, lowest), "links")
    hard = components(links, ws, **limit)

    in_large = members.where(F.col("m") > BLOCK).select("id", "cluster", "sig")
    split = in_large.join(hard, "id", "left").select("id", "cluster", "sig", F.coalesce("component", "id").alias("component"))
    main = ws.save(_main_components(split, "cluster"), "main")
    if not main.where("parts > 1").isEmpty():
        rest = ws.save(spread_join(split, main, "cluster", "n").where("parts > 1").drop("parts"), "rest")
        met = _alike(_facing(rest.withColumnRenamed("cluster", "bucket"), _signature_block(), "main", "n", "n_main"), lowest, members=True)
        met = ws.save(rest.select("id", "cluster", "sig", "component").join(met.select(F.col("a").alias("id")).distinct(), "id"), "met")
        again = ws.save(_main_components(met, "cluster"), "again")
        open_sets = spread_join(met, again, "cluster", "n").where("parts > 1").join(sets.select("id", "set"), "id")
        late = ws.save(_confirmed(_facing(open_sets, BLOCK, "main", "n", "n_main").select("cluster", "i", "j", "side", "id", "component", "sig", "set"), percent, lowest), "late")
        if not late.isEmpty():
            hard = components(links.union(late), ws, **limit)

    named = classes.select("set_key", "copies", F.col("rep").alias("id")).join(hard, "id", "left").select("set_key", "copies", F.coalesce("component", "id").alias("found"))
    out = spread_join(signed.select("doc_id", "n_shingles", "set_key"), ws.save(named, "named"), "set_key", "copies")
    component = F.when(F.col("doc_id").isNull(), None).otherwise(F.coalesce("found", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keep_first(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near-duplicates, with all its columns; rows without doc_id stay.

    Rows of one doc_id are one document: the one of the least text stays, nulls last."""
    kept = near_duplicates(docs, size, percent).where("kept and doc_id is not null").select("doc_id").distinct()
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("text").asc_nulls_last()))
    one = docs.join(kept, "doc_id", "left_semi").withColumn("__place", first).where("__place = 1").drop("__place")
    return one.unionByName(docs.where("doc_id is null")).select(*[F.col(f"`{c}`") for c in docs.columns])
