"""A block-max inverted index: postings by term in blocks, searched by upper bounds.

Rows are numbered as they are written; 64 rows in a row are a window and 8,192 a shard. A block is one term's
postings in one window of one kind: places in the window, counts, and the block's largest impact (the BM25 factor of its
best posting, rounded up). The blocks of a term in a shard are one row, packed; the empty term's row holds the sizes of the
rows instead of counts. A task writes the rows of its shards as they are made, in folders by slot, a hash of the
term: no posting is shuffled to build an index, and a search reads the slots of its queries' terms, of which nothing else goes further.

A search weighs the queries' terms and brings their blocks together by shard. There the sum of a window's largest
impacts bounds what a row of it can score. In a first pass each shard scores a few windows of the highest bounds; the
k-th best score of all shards is then a threshold for all of them. In the second pass windows are scored from the highest
bound down, until no bound reaches the threshold, which rises with what is found. A shard sends its k best rows, and
all that tie with the last of them: ids decide then, by the one total order of hits. The result is that of scoring every row.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.common import SCORE_DECIMALS, ContractError, saved, scratch, top_k
from lodestack.operators.lexical import QUERY_BLOCK, BM25Config, analysed, as_hits, query_terms

VERSION = 1
#: Rows of a window and of a shard, as powers of two: numbers of rows are cut by shifts.
WINDOW_BITS, SHARD_BITS = 6, 13
#: Folders of blocks, by hash of the term.
SLOTS = 16
#: Windows that a shard scores first, for each query.
PROBED = 4
BLOCK = "field string, kind string, term string, shard long, n int, n_blocks int, blocks binary, places binary, counts binary"
STORED = f"{BLOCK}, slot int"
#: A packed block: its window in the shard, how many postings it has, and its largest impact.
PACKED = np.dtype([("window", "u1"), ("n", "u1"), ("most", "<f4")])
TERM = "field string, term string, df long, blocks long"
FOUND = "query_id string, row long, score double, cut double, blocks long, read long"
KEYS = ["document_id", "chunk_id", "representation_id"]


@dataclass
class Postings:
    """rows: row, ids, kind and n_<field>; blocks and terms (field, term, df, blocks): as stored."""

    path: str
    rows: DataFrame
    blocks: DataFrame
    terms: DataFrame
    manifest: dict = field(default_factory=dict)

    @property
    def config(self) -> BM25Config:
        return BM25Config(self.manifest["k1"], self.manifest["b"])


def slot_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(SLOTS)).cast("int")


def impact(counts: np.ndarray, sizes: np.ndarray, mean: float, config: BM25Config) -> np.ndarray:
    norm = (1 - config.b) + (config.b * sizes / mean if mean > 0 else 0.0)
    return counts * (config.k1 + 1) / (counts + config.k1 * norm)


def _whole_shards(batches):
    """The same rows in batches that end with a shard; rows come in the order of their numbers, file by file."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        shard = np.asarray(batch.column(0)) >> SHARD_BITS
        other = np.flatnonzero(shard != shard[-1])
        cut = int(other[-1]) + 1 if len(other) else 0
        if waiting and int(shard[0]) != waiting[-1].column(0)[-1].as_py() >> SHARD_BITS:
            yield _one(waiting)
            waiting = []
        if cut:
            yield _one([*waiting, batch.slice(0, cut)])
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield _one(waiting)


def _one(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(batches).combine_chunks().to_batches()[0]


def _blocks(rows: DataFrame, name: str, mean: float, config: BM25Config) -> DataFrame:
    """Rows of blocks of one field. A window that two tasks share gives two blocks of a term; a search takes the larger impact of both."""

    def task(batches):
        for batch in _whole_shards(batches):
            row, kind = np.asarray(batch.column(0)), batch.column(1).dictionary_encode()
            terms = batch.column(2)
            size = np.diff(np.asarray(terms.offsets, dtype=np.int64))
            coded = terms.flatten().dictionary_encode()
            words = pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([""])])
            n = len(words)
            key, tf = np.unique(np.repeat(np.arange(len(row)), size) * n + np.asarray(coded.indices, dtype=np.int64), return_counts=True)
            # the last term is the empty one, which every row with terms holds as often as it has terms
            held = np.flatnonzero(size)
            at, term, tf = np.concatenate([key // n, held]), np.concatenate([key % n, np.full(len(held), n - 1)]), np.concatenate([tf, size[held]])
            if not len(at):
                continue
            kinds = np.asarray(kind.indices)[at]
            order = np.lexsort((row[at], kinds, term, row[at] >> SHARD_BITS))
            at, term, tf, kinds = at[order], term[order], tf[order], kinds[order]
            shard, window = row[at] >> SHARD_BITS, row[at] >> WINDOW_BITS
            new = np.concatenate([[True], (shard[1:] != shard[:-1]) | (term[1:] != term[:-1]) | (kinds[1:] != kinds[:-1])])
            cut = new | np.concatenate([[True], window[1:] != window[:-1]])
            starts, firsts = np.flatnonzero(new), np.flatnonzero(cut)
            most = np.maximum.reduceat(impact(tf, size[at], mean, config), firsts)
            packed = np.zeros(len(firsts), dtype=PACKED)
            packed["window"] = window[firsts] & ((1 << (SHARD_BITS - WINDOW_BITS)) - 1)
            packed["n"] = np.diff(np.append(firsts, len(at)))
            low = most.astype("<f4")
            packed["most"] = np.where(low < most, np.nextafter(low, np.float32(np.inf)), low)
            ends, where = np.append(starts[1:], len(at)), np.searchsorted(firsts, np.append(starts, len(at)))
            places = (row[at] & ((1 << WINDOW_BITS) - 1)).astype("u1")
            binary = lambda x, edges: pa.array([x[a:b].tobytes() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)], pa.binary())
            edges = np.append(starts, len(at))
            columns = [pa.array([name] * len(starts)), kind.dictionary.take(pa.array(kinds[starts])), words.take(pa.array(term[starts])), pa.array(shard[starts])]
            columns += [pa.array(ends - starts, pa.int32()), pa.array(np.diff(where), pa.int32()), binary(packed, where), binary(places, edges), binary(tf.astype("<u4"), edges)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in BLOCK.split(", ")])

    return rows.select("row", "kind", f"terms_{name}").mapInArrow(task, BLOCK)


def build_postings(records: DataFrame, path: str, fields: dict[str, Column] | None = None, config: BM25Config = BM25Config()) -> Postings:
    """Write an index of records (representation_id, chunk_id, document_id, what fields are made of; kind, if there is one)."""
    from lodestack.sources.bundle import exists, write_json
    from lodestack.sources.corpus import checksum_tree

    spark = records.sparkSession
    if exists(spark, f"{path}/manifest.json"):
        raise ContractError(f"{path} holds an index")
    made = analysed(records, fields)
    kind = F.coalesce("kind", F.lit("")) if "kind" in records.columns else F.lit("")
    kept = made.entries.select(F.monotonically_increasing_id().alias("row"), *KEYS, kind.alias("kind"), *[F.size(f"terms_{f}").alias(f"n_{f}") for f in made.fields], *[f"terms_{f}" for f in made.fields])
    kept.write.option("compression", "zstd").parquet(f"{path}/analysed")
    rows = spark.read.schema(kept.schema).parquet(f"{path}/analysed")
    totals = rows.agg(F.count("*").alias("n"), *[F.coalesce(F.avg(f"n_{f}"), F.lit(0.0)).alias(f) for f in made.fields]).first()
    blocks = None
    for f in made.fields:
        part = _blocks(rows, f, totals[f], config)
        blocks = part if blocks is None else blocks.unionByName(part)
    dealt = blocks.withColumn("slot", slot_of(F.col("term"))).sortWithinPartitions("slot", "field", "term", "shard")
    dealt.write.option("compression", "zstd").partitionBy("slot").parquet(f"{path}/blocks")
    blocks = spark.read.schema(STORED).parquet(f"{path}/blocks")
    counted = blocks.where("term <> ''").groupBy("field", "term").agg(F.sum("n").alias("df"), F.sum("n_blocks").alias("blocks"))
    terms = saved(counted.repartitionByRange("field", "term").sortWithinPartitions("field", "term"), f"{path}/terms")
    held = terms.groupBy("field").agg(F.sum("blocks").alias("blocks"), F.sum("df").alias("postings")).collect()
    manifest = {
        "version": VERSION,
        "fields": list(made.fields),
        "k1": config.k1,
        "b": config.b,
        "totals": {f: [float(totals["n"]), totals[f]] for f in made.fields},
        "blocks": {r["field"]: r["blocks"] for r in held},
        "postings": {r["field"]: r["postings"] for r in held},
    }
    manifest["digest"] = {name: checksum_tree(df, *key).root for name, df, key in _tables(rows, blocks, terms)}
    write_json(spark, f"{path}/manifest.json", manifest)
    return open_postings(spark, path)


def _tables(rows: DataFrame, blocks: DataFrame, terms: DataFrame) -> list[tuple[str, DataFrame, tuple[str, ...]]]:
    """What an index's digest covers: the terms of rows are in the blocks."""
    numbered = rows.select(*[c for c in rows.columns if not c.startswith("terms_")])
    return [("rows", numbered, ("row",)), ("blocks", blocks, ("field", "term", "shard", "kind")), ("terms", terms, ("field", "term"))]


def open_postings(spark: SparkSession, path: str, check: bool = False) -> Postings:
    """The index under path; its content is only read and digested with check."""
    from lodestack.sources.bundle import read_json
    from lodestack.sources.corpus import checksum_tree

    m = read_json(spark, f"{path}/manifest.json")
    if m.get("version") != VERSION:
        raise ContractError("unknown index version")
    found = Postings(path, spark.read.parquet(f"{path}/analysed"), spark.read.schema(STORED).parquet(f"{path}/blocks"), spark.read.schema(TERM).parquet(f"{path}/terms"), m)
    for name, df, key in _tables(found.rows, found.blocks, found.terms) if check else ():
        if checksum_tree(df, *key).root != m["digest"][name]:
            raise ContractError(f"{name} of the index differ from their digest")
    return found


class _Asked:
    """Queries as arrays: for each one its terms (numbers of `known`) with their weights."""

    def __init__(self, index: Postings, asked: list, boosts: dict[str, float]):
        spark = index.rows.sparkSession
        self.ids = sorted({r["query_id"] for r in asked})
        vocabulary = sorted({r["term"] for r in asked})
        self.wanted = spark.createDataFrame(pd.DataFrame({"term": pd.Series([*vocabulary, ""], dtype=str)}), "term string")
        rows = index.terms.where(F.col("field").isin(list(boosts))).join(F.broadcast(self.wanted), "term", "left_semi").collect()
        self.known = sorted((r["field"], r["term"]) for r in rows)
        number = {x: i for i, x in enumerate(self.known)}
        own, totals = defaultdict(list), index.manifest["totals"]
        idf = {(r["field"], r["term"]): float(np.log(1 + (totals[r["field"]][0] - r["df"] + 0.5) / (r["df"] + 0.5))) for r in rows}
        for r in sorted(asked, key=lambda r: r["term"]):
            for f, boost in boosts.items():
                if (f, r["term"]) in number:
                    own[r["query_id"]].append((number[f, r["term"]], boost * r["qtf"] * idf[f, r["term"]]))
        self.terms = [np.array([n for n, _ in own[q]], dtype=np.int64) for q in self.ids]
        self.weights = [np.array([w for _, w in own[q]]) for q in self.ids]


class _Shard:
    """Blocks of one shard, by number of term."""

    def __init__(self, table: pa.Table, known: list[tuple[str, str]], means: dict[str, float], config: BM25Config):
        table = table.combine_chunks()
        fields = list(means)
        names = pc.binary_join_element_wise(table.column("field"), table.column("term"), "\n")
        every = [f"{f}\n{t}" for f, t in known] + [f"{f}\n" for f in fields]
        number = np.asarray(pc.index_in(names, pa.array(every, pa.string())).fill_null(-1).combine_chunks(), dtype=np.int64)
        packed = np.frombuffer(b"".join(table.column("blocks").to_pylist()), dtype=PACKED)
        places = np.frombuffer(b"".join(table.column("places").to_pylist()), dtype="u1").astype(np.int64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype="<u4").astype(np.int64)
        number = np.repeat(number, np.asarray(table.column("n_blocks").combine_chunks()))
        window, n = packed["window"].astype(np.int64), packed["n"].astype(np.int64)
        at = np.cumsum(n) - n
        place, of = np.repeat(window << WINDOW_BITS, n) + places, np.repeat(number, n)
        self.impact = np.zeros(len(place))
        for i, f in enumerate(fields):
            own = of == len(known) + i
            size = np.zeros(1 << SHARD_BITS)
            size[place[own]] = counts[own]
            mine = np.isin(of, [j for j, (g, _) in enumerate(known) if g == f])
            self.impact[mine] = impact(counts[mine], size[place[mine]], means[f], config)
        order = np.lexsort((window, number))
        number, self.window, self.n, self.at = number[order], window[order], n[order], at[order]
        self.place, self.base = place, (table.column("shard")[0].as_py() << SHARD_BITS) if table.num_rows else 0
        self.starts, self.ends = (np.searchsorted(number, np.arange(len(known)), side=s) for s in ("left", "right"))
        # of blocks of one term in one window, the first has the largest impact of all, the others none
        first = np.concatenate([[True], (number[1:] != number[:-1]) | (self.window[1:] != self.window[:-1])])
        self.windows, self.most = 1 << (SHARD_BITS - WINDOW_BITS), np.zeros(len(number))
        self.most[first] = np.maximum.reduceat(packed["most"].astype(float)[order], np.flatnonzero(first))

    def search(self, terms: np.ndarray, weights: np.ndarray, first: float, k: int, probe: bool = False):
        """Rows, scores, and how many blocks the query's terms have here and were scored; probe: of PROBED windows only."""
        held = self.ends[terms] - self.starts[terms]
        blocks = np.repeat(self.starts[terms] - np.concatenate([[0], np.cumsum(held)[:-1]]), held) + np.arange(held.sum())
        weight, window = np.repeat(weights, held), self.window[blocks]
        bound = np.bincount(window, weights=weight * self.most[blocks], minlength=self.windows)
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        order = order[:PROBED] if probe else order
        threshold, step, done, read = first, PROBED, 0, 0
        rows, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        while done < len(order):
            # two roundings at SCORE_DECIMALS may bring a bound and a score together
            some = order[done : done + step]
            some = some[bound[some] >= threshold - 2e-9 * max(1.0, threshold)]
            if not len(some):
                break
            done, step = done + step, step * 2
            chosen = np.zeros(self.windows, dtype=bool)
            chosen[some] = True
            mine = chosen[window]
            ours, n = blocks[mine], self.n[blocks[mine]]
            read += len(ours)
            at = np.repeat(self.at[ours] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            place, back = np.unique(self.place[at], return_inverse=True)
            rows = np.concatenate([rows, place])
            scores = np.concatenate([scores, np.bincount(back, weights=np.repeat(weight[mine], n) * self.impact[at], minlength=len(place))])
            if len(scores) > k:
                cut = np.round(scores, SCORE_DECIMALS)
                stays = cut >= np.partition(cut, len(cut) - k)[len(cut) - k]
                rows, scores = rows[stays], scores[stays]
            if len(scores) >= k:
                threshold = max(threshold, scores.min())
        if len(rows):
            stays = scores >= threshold - 2e-9 * max(1.0, threshold)
            rows, scores = rows[stays], scores[stays]
        return self.base + rows, scores, len(blocks), read


def _found(index: Postings, queries: DataFrame, k: int, boosts: dict[str, float], kinds: list[str] | None, told: bool) -> DataFrame:
    """What every shard finds for at most QUERY_BLOCK queries; told: instead, how many blocks it has and scores for each."""
    asked = _Asked(index, query_terms(queries).collect(), boosts)
    spark = index.rows.sparkSession
    if not asked.known:
        return spark.createDataFrame([], FOUND)
    slots = sorted(r[0] for r in asked.wanted.select(slot_of(F.col("term"))).distinct().collect())
    blocks = index.blocks.where(F.col("slot").isin(slots) & F.col("field").isin(list(boosts)))
    if kinds is not None:
        blocks = blocks.where(F.col("kind").isin(kinds))
    blocks = blocks.join(F.broadcast(asked.wanted), "term", "left_semi")
    means, config = {f: t[1] for f, t in index.manifest["totals"].items() if f in boosts}, index.config
    known = asked.known

    def searched(least: dict[str, float], probe: bool) -> DataFrame:
        each = [(q, terms, weights, least.get(q, 0.0)) for q, terms, weights in zip(asked.ids, asked.terms, asked.weights, strict=True)]
        return grouped.applyInArrow(_task(known, each, means, config, k, probe, told and not probe), FOUND)

    grouped = blocks.select("shard", "field", "term", "n_blocks", "blocks", "places", "counts").groupBy("shard")
    # one row a query
    least = {r[0]: r[1] for r in top_k(searched({}, True), k, [F.col("score").desc()]).where(F.col("rank") == k).select("query_id", "score").collect()}
    return searched(least, False)


def _task(known, each, means, config, k, probe, told):
    def task(table: pa.Table) -> pa.Table:
        shard = _Shard(table, known, means, config)
        parts = []
        for q, terms, weights, first in each:
            rows, scores, held, read = shard.search(terms, weights, first, k, probe)
            if told:
                rows, scores = np.array([-1]), np.zeros(1)
            parts.append((rows, scores, np.full(len(rows), held), np.full(len(rows), read), [q] * len(rows)))
        rows, scores, held, read = (np.concatenate([p[i] for p in parts]) for i in range(4))
        columns = [pa.array([q for p in parts for q in p[4]], pa.string()), pa.array(rows), pa.array(scores), pa.array(np.round(scores, SCORE_DECIMALS) + 0.0), pa.array(held), pa.array(read)]
        return pa.Table.from_arrays(columns, [c.split()[0] for c in FOUND.split(", ")])

    return task


def _each_block(index: Postings, queries: DataFrame, k: int, boosts: dict[str, float] | None, kinds: list[str] | None, told: bool = False) -> DataFrame:
    boosts = {f: b for f, b in (boosts or dict.fromkeys(index.manifest["fields"], 1.0)).items() if b > 0}
    if unknown := sorted(set(boosts) - set(index.manifest["fields"])):
        raise ContractError(f"fields that the index does not hold: {', '.join(unknown)}")
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    numbered = queries.select("query_id", "text").withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    out = None
    for b in range(blocks):
        part = _found(index, numbered.where(F.col("block") == b), k, boosts, kinds, told)
        out = part if out is None else out.unionByName(part)
    return out


def search_postings(index: Postings, queries: DataFrame, k: int, boosts: dict[str, float] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """The k best hits of each query by the sum of the fields' boosted scores; kinds: of rows of these kinds only."""
    # written, so that the planner knows its size: ids of all rows are shuffled only where what was found is large too
    found = saved(_each_block(index, queries, k, boosts, kinds).drop("blocks", "read"), scratch(queries.sparkSession, "found"))
    hits = found.join(index.rows.select("row", *KEYS), "row")
    return as_hits(top_k(hits, k, [F.col("cut").desc(), *[F.col(c) for c in KEYS]]), index.config.channel)


def blocks_read(index: Postings, queries: DataFrame, k: int, boosts: dict[str, float] | None = None, kinds: list[str] | None = None) -> DataFrame:
    """Of each query: how many blocks its terms have, and how many a search scores; the index's own number is in its manifest."""
    return _each_block(index, queries, k, boosts, kinds, told=True).groupBy("query_id").agg(F.sum("blocks").alias("blocks"), F.sum("read").alias("read"))
