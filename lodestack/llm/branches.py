"""The suffix tree of `suffix_tree` at any size: no node of it is dropped, and none comes to the driver.

Symbols are numbers: words that training texts hold twice or more, in the order of their counts, so that a table of the
distinct counts (at most the square root of twice the tokens) gives a symbol's count. Each place of a text is its
symbol and the three before it. Contexts that end in one symbol make a branch of the tree: places are dealt to
buckets by it, where the branch is learned from the places of training texts, and all places are scored; sums by
document return. What is sent is packed by batch of documents and bucket.

A symbol, or a context, of more than HOT places would make a branch too large for a task. It is learned by joins instead: the
distinct pairs of it and a next symbol, listed once a batch, are counted, its sums are collected (one row for each, at
most tokens / HOT rows), and probabilities return to the batches that list them. Its places are then dealt by one symbol
more. Contexts below HOT places meet in one task; HOT counts places of training texts.

What is dealt goes when its sums are written, and buckets may take turns, so that the disk holds a turn's share of the places
at once. Each place is dealt in one turn, with all others of its bucket. Documents are bucketed by batch: they stay
where they are when probabilities and sums return to their batches.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from zstandard import ZstdCompressor, ZstdDecompressor

from lodestack.llm import batch_values as bv
from lodestack.llm import suffix_tree as st
from lodestack.llm.common import Workspace, regroup, release

#: Places of a context that meet in one task, at most; tokens for each bucket; words that are sent to the tasks that cut texts.
HOT, BUCKET, HEAD = 1_500_000, 1_500_000, 100_000
#: A context's symbol that no context of enough places has, or the start of the text.
STOP = 0
#: Turns that buckets are dealt in: each one more reads all places again, and halves, thirds, ... what is dealt at once.
TURNS = 1
SYMBOLS, DOC, SHARED = "__symbols", "__i", "__shared"
_PART = (1 << 33) - 1


class Root:
    """Counts and log10 probabilities of symbols. firsts, counts: the first number of each distinct count, and that count."""

    def __init__(self, firsts: np.ndarray, counts: np.ndarray, words: np.ndarray, tokens: int, distinct: int, ends: int):
        self.tokens, self.whole, self.ends = tokens, tokens + distinct + 1, ends
        named = int((counts * words).sum())
        mass = self.whole - named - int(words.sum()) - (ends + 1 if ends else 0)
        self.size = st.OTHER + 1 + int(words.sum())
        self.firsts = np.concatenate([[st.END, st.OTHER], firsts]).astype(np.int64)
        self.numbers = np.concatenate([[ends, tokens - ends - named], counts]).astype(np.int64)
        self.steps = np.log10((self.numbers + 1.0) / self.whole)
        self.steps[st.OTHER] = np.log10(mass / self.whole)

    def step(self, symbols: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, symbols, side="right") - 1


def vocabulary(texts: DataFrame, ws: Workspace) -> tuple[st.Tree, Root, DataFrame]:
    """The most frequent words as a tree's symbols, the root, and word, n and number of every word."""
    counts = ws.save(st.word_counts(texts), "words")
    found = counts.agg(F.sum("n"), F.count("*")).first()
    ends = texts.count()
    tokens, distinct = (found[0] or 0) + ends, found[1] + (ends > 0)
    often = F.col("n") >= st.LEAST_SYMBOL
    placed = ws.save(counts.where(often).orderBy(F.desc("n"), "word").withColumn("__at", F.monotonically_increasing_id()), "ordered")
    # one row for each task of the sort
    sizes = placed.groupBy(F.shiftright("__at", 33).alias("__part")).count().orderBy("__part").collect()
    at = np.concatenate([[0], np.cumsum([r["count"] for r in sizes])]) + st.OTHER + 1
    firsts = ws.spark.createDataFrame([(r["__part"], int(k)) for r, k in zip(sizes, at[:-1])], "__part long, __first long")
    named = placed.join(F.broadcast(firsts), F.shiftright("__at", 33) == F.col("__part")).select("word", "n", (F.col("__first") + F.col("__at").bitwiseAND(F.lit(_PART))).alias("number"))
    # distinct counts only
    steps = placed.groupBy("n").count().orderBy(F.desc("n")).toArrow()
    n, words = (np.asarray(steps.column(c).combine_chunks(), dtype=np.int64) for c in ("n", "count"))
    root = Root(np.concatenate([[0], np.cumsum(words)])[:-1] + st.OTHER + 1, n, words, tokens, distinct, ends)
    # HEAD rows at most
    head = named.where(F.col("number") < HEAD + st.OTHER + 1).orderBy("number").toArrow()
    tree = st.Tree(list(zip(head.column("word").to_pylist(), head.column("n").to_pylist(), strict=True)), tokens, distinct, ends)
    return tree, root, named.unionByName(counts.where(~often).withColumn("number", F.lit(st.OTHER).cast("long")))


def entry_values(coded: DataFrame, words: DataFrame) -> DataFrame:
    """n and number of every entry of code()."""
    return bv.entries(coded).join(words, "word", "left").select(bv.BATCH, "__k", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("number", F.lit(st.OTHER)).alias("number"))


def numbered(coded: DataFrame, values: DataFrame, root: Root, learned: str) -> DataFrame:
    """Rows of code() with their symbols, and what words alone decide: n_tokens, n_known, train_tokens, base_score."""
    sent = coded.sparkSession.sparkContext.broadcast(root)

    def finish(batch, found):
        own = sent.value
        numbers, bounds = st._flat(batch.column(bv.PLACES))
        starts, rare = np.concatenate([[0], bounds[:-1]]), numbers < 0
        symbols, at = numbers.copy(), -1 - numbers[rare]
        symbols[rare] = found[1][at]
        n = own.numbers[own.step(symbols)]
        # an end that no training text has is a word that none has
        n[symbols == st.OTHER] = 0
        n[rare] = found[0][at]
        base = np.log10((n + 1.0) / own.whole)
        shared = np.where(symbols == st.OTHER, base - own.steps[st.OTHER], 0.0)
        sums = [np.add.reduceat(x, starts) for x in ((n > 0).astype(np.int64), base, shared)]
        packed = st.squeezed(symbols, bounds)
        tokens = np.full(len(starts), own.tokens, dtype=np.int64)
        columns = [pa.array(x) for x in (bounds - starts, sums[0], tokens, sums[1], sums[2], np.arange(len(starts), dtype=np.int32))]
        return [*columns, batch.column(learned), pa.array(packed, pa.binary()), batch.column(bv.BATCH)]

    added = f"n_tokens long, n_known long, train_tokens long, base_score double, {SHARED} double, {DOC} int, __learned boolean, {SYMBOLS} binary, {bv.BATCH} long"
    return bv.with_values(coded, values, finish, added)


def _runs(batches):
    """Rows of equal batch numbers that follow each other."""
    for batch in regroup(batches, bv.ROWS, bv.BYTES):
        if batch.num_rows:
            of = np.asarray(batch.column(bv.BATCH))
            cuts = [0, *(np.flatnonzero(of[1:] != of[:-1]) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield int(of[a]), batch.slice(a, b - a)


class Places:
    """All places of some documents: symbols, contexts (most recent first), whether learned from, and the document's number."""

    def __init__(self, rows: pa.RecordBatch | pa.Table, root: Root, hot: list[np.ndarray]):
        self.symbols, bounds = st._flat(rows.column(SYMBOLS))
        size = np.diff(bounds, prepend=0)
        self.learned = np.repeat(np.asarray(rows.column("__learned")), size)
        self.doc = np.repeat(np.asarray(rows.column(DOC)), size)
        self.step = root.step(self.symbols)
        place = np.arange(len(self.symbols)) - np.repeat(bounds - size, size)
        usable = np.where((root.numbers[self.step] >= st.LEAST_CONTEXT) & (self.symbols != st.END), self.symbols, STOP)
        self.contexts, alive = [], np.ones(len(place), dtype=bool)
        for k in range(1, st.DEPTH + 1):
            c = np.zeros(len(place), dtype=np.int64)
            live = np.flatnonzero(alive & (place >= k))
            c[live] = usable[live - k]
            self.contexts.append(c)
            alive = c != STOP
        # for each level, the place's context among the hot ones, or -1
        self.hot, above = [], np.zeros(len(place), dtype=np.int64)
        for keys, c in zip(hot, self.contexts, strict=False):
            above = np.where(above >= 0, st._found(keys, (np.maximum(above, 0) << 32) | c), -1)
            self.hot.append(above)


def _hot_pairs(docs: DataFrame, root, hot: list[np.ndarray]) -> DataFrame:
    """For each batch, the last level's hot contexts with the symbols that follow, and how often in training texts."""

    def task(batches):
        for number, rows in _runs(batches):
            p = Places(rows, root.value, hot)
            live = p.hot[-1] >= 0
            pairs, at = np.unique((p.hot[-1][live] << 32) | p.symbols[live], return_inverse=True)
            n = np.bincount(at, weights=p.learned[live], minlength=len(pairs)).astype(np.int64)
            columns = np.full(len(pairs), number), pairs >> 32, pairs & 0xFFFFFFFF, n
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [bv.BATCH, "h", "x", "n"])

    return docs.select(bv.BATCH, DOC, "__learned", SYMBOLS).mapInArrow(task, f"{bv.BATCH} long, h long, x long, n long")


def _with_parents(events: DataFrame, root, keys: np.ndarray, last: DataFrame | None) -> DataFrame:
    """events with log: log10 of x's probability by the suffix of the context h."""

    def task(batches):
        for b in batches:
            h, x = (np.asarray(b.column(c)) for c in ("h", "x"))
            log = root.value.steps[root.value.step(x)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(log), pa.array(keys[h] >> 32)], ["h", "x", "n", "log", "up"])

    out = events.mapInArrow(task, "h long, x long, n long, log double, up long")
    if last is None:
        return out
    return out.drop("log").join(last.select(F.col("h").alias("up"), "x", "log"), ["up", "x"])


def hot_levels(docs: DataFrame, root: Root, ws: Workspace, most: int) -> tuple[list[np.ndarray], DataFrame | None]:
    """Keys of hot contexts by level, and for each batch log10 probabilities of symbols after them: __of, level, event (h and x), log."""
    sent, hot, paths, last, values = ws.spark.sparkContext.broadcast(root), [], [], None, None
    bounds = np.append(root.firsts, root.size).tolist()
    found = [(x,) for k in np.flatnonzero(root.numbers > most).tolist() if k != st.END for x in range(bounds[k], bounds[k + 1])]
    for level in range(1, st.DEPTH + 1):
        if not found:
            break
        where = [{path: i for i, path in enumerate(known)} for known in paths]
        keyed = sorted(((where[-1][path[:-1]] if where else 0) << 32 | path[-1], path) for path in found)
        hot.append(np.array([k for k, _ in keyed], dtype=np.int64))
        paths.append([path for _, path in keyed])
        pairs = ws.save(_hot_pairs(docs, sent, hot), f"hot{level}")
        events = pairs.groupBy("h", "x").agg(F.sum("n").alias("n"))
        events = ws.save(_with_parents(events, sent, hot[-1], last), f"events{level}")
        often, p = F.col("n") >= st.LEAST_EVENT, F.pow(F.lit(10.0), F.col("log"))
        sums = [F.sum("n").alias("total"), F.sum(often.cast("long")).alias("kinds"), F.sum(F.when(often, F.col("n")).otherwise(0)).alias("seen")]
        sums += [F.sum(F.when(often, p).otherwise(0.0)).alias("under"), F.sum(F.when(often, F.col("n") * F.log(F.col("n") / p)).otherwise(0.0)).alias("told")]
        rows = events.groupBy("h").agg(*sums).collect()
        total, kinds, seen, under, told = (np.array([r[c] for r in rows], dtype=float) for c in ("total", "kinds", "seen", "under", "told"))
        kept, rest = st.tested(total, kinds, seen, under, told - seen * np.log(total))
        stats = [(r["h"], float(r["total"]), r["kinds"] + 1.0, bool(k), float(x)) for r, k, x in zip(rows, kept, rest, strict=True)]
        stats = ws.spark.createDataFrame(stats, "h long, total double, weight double, kept boolean, rest double")
        own = F.log10((F.col("n") + F.col("weight") * p) / (F.col("total") + F.col("weight")))
        log = F.when(~F.col("kept"), F.col("log")).when(often, own).otherwise(F.col("log") + F.col("rest"))
        last = ws.save(events.join(F.broadcast(stats), "h").select("h", "x", "n", log.alias("log")), f"logs{level}")
        ws.drop(f"events{level}")
        back = pairs.join(last.drop("n"), ["h", "x"]).select(F.col(bv.BATCH).alias("__of"), F.lit(level).alias("level"), F.shiftleft("h", 32).bitwiseOR(F.col("x")).alias("event"), "log")
        values = back if values is None else values.unionByName(back)
        # tokens / most rows at most
        next_ones = last.where((F.col("n") > most) & (F.col("x") != st.END)).select("h", "x").collect() if level < st.DEPTH else []
        found = [(r["x"], *paths[-1][r["h"]]) for r in next_ones]
    if values is not None:
        values = ws.save(values, "hot")
        for level in range(1, len(hot) + 1):
            ws.drop(f"hot{level}")
            ws.drop(f"logs{level}")
    return hot, values


#: Parts of one in which logarithms and their sums are sent: whole numbers, whose high bytes are alike, and sums in any order are equal.
UNIT = 2.0**32


def _sent(logs: np.ndarray) -> bytes:
    return np.rint(logs * UNIT).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _received(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(8, -1).T).view("<i8")[:, 0]


def _planes(columns: list[np.ndarray]) -> np.ndarray:
    """Integers byte by byte, as most high bytes are zero."""
    return np.ascontiguousarray(np.stack([c.astype("<i4") for c in columns]).view(np.uint8).reshape(len(columns), -1, 4).transpose(0, 2, 1))


def _packed(planes: np.ndarray, flags: np.ndarray, logs: np.ndarray) -> bytes:
    return ZstdCompressor(level=1).compress(planes.tobytes() + flags.tobytes() + _sent(logs))


def _unpacked(row: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    buf = ZstdDecompressor().decompress(row)
    planes = np.frombuffer(buf, np.uint8, 20 * n).reshape(5, 4, n).transpose(0, 2, 1)
    flags = np.frombuffer(buf, np.uint8, n, 20 * n)
    return np.ascontiguousarray(planes).view("<i4")[:, :, 0], flags, _received(np.frombuffer(buf, np.uint8, -1, 21 * n)) / UNIT


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_SENT = ["bucket", "batch", "n", "places", "docs", "sums"]
_SENT_SCHEMA = "bucket int, batch long, n int, places binary, docs binary, sums binary"


def _sums(doc: np.ndarray, logs: np.ndarray) -> tuple[bytes, bytes]:
    """Documents, as differences, and their sums of logs."""
    if not len(doc):
        return b"", b""
    total, has = np.bincount(doc, weights=logs), np.bincount(doc)
    which = np.flatnonzero(has)
    small, steps = ZstdCompressor(level=1), np.diff(which, prepend=0).astype("<i4")
    return small.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes()), small.compress(_sent(total[which]))


def _dealt(number: int, rows, root: Root, hot: list[np.ndarray], values: list[tuple[np.ndarray, np.ndarray]], buckets: int, turn: int = 0, turns: int = 1) -> pa.RecordBatch:
    """One row for each of the turn's buckets with the places that it scores, and in one turn one with the sums of the others."""
    p = Places(rows, root, hot)
    logs, level = root.steps[p.step], np.zeros(len(p.symbols), dtype=np.int64)
    for k, (found, (keys, values_of)) in enumerate(zip(p.hot, values, strict=True), 1):
        live = np.flatnonzero(found >= 0)
        level[live] = k
        logs[live] = values_of[np.searchsorted(keys, (found[live] << 32) | p.symbols[live])] if len(live) else 0.0
    after = np.choose(level, [*p.contexts, np.zeros_like(level)])
    go = after != STOP
    at = np.flatnonzero(go)
    key = np.zeros(len(at), dtype=np.uint64)
    for k, c in enumerate(p.contexts):
        deep = np.flatnonzero(level[at] >= k)
        key[deep] = _mixed(key[deep] * np.uint64(0x9E3779B97F4A7C15) + c[at[deep]].astype(np.uint64) + np.uint64(1))
    to = (key % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int64)
    mine = np.flatnonzero(to % turns == turn)
    order = mine[np.argsort(to[mine], kind="stable")]
    at, to = at[order], to[order].astype(np.int64)
    cuts = np.flatnonzero(np.diff(to, prepend=-1)) if len(to) else np.zeros(0, dtype=np.int64)
    planes, lead = _planes([*[c[at] for c in p.contexts], p.symbols[at], p.doc[at]]), level[at]
    flags, known, out = (lead * 2 + p.learned[at]).astype(np.uint8), logs[at], [[], [], []]
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(to)], strict=False):
        out[0].append(int(to[a]))
        out[1].append(b - a)
        out[2].append(_packed(planes[:, :, a:b], flags[a:b], known[a:b][lead[a:b] > 0]))
    own = number % buckets
    plain = [(own, *_sums(p.doc[~go], logs[~go]))] if own % turns == turn else []
    n, last = len(out[0]), len(plain)
    columns = [pa.array([*out[0], *[x[0] for x in plain]], pa.int32()), pa.array([number] * (n + last), pa.int64()), pa.array([*out[1], *[0] * last], pa.int32())]
    columns += [pa.array(x, pa.binary()) for x in ([*out[2], *[None] * last], [*[None] * n, *[x[1] for x in plain]], [*[None] * n, *[x[2] for x in plain]])]
    return pa.RecordBatch.from_arrays(columns, _SENT)


def learned_logs(contexts: np.ndarray, symbols: np.ndarray, learned: np.ndarray, level: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log10 probabilities of places whose contexts, longer than level, lie here with all of their places; logs: by the contexts of length level."""
    logs, node, live = logs.copy(), np.zeros(len(symbols), dtype=np.int64), np.arange(len(symbols))
    for k, c in enumerate(contexts, 1):
        live = live[c[live] != STOP]
        found, here = np.unique((node[live] << 32) | c[live], return_inverse=True)
        mine = learned[live]
        total = np.bincount(here, weights=mine, minlength=len(found))
        given = level[live] >= k
        alive = given | (total[here] >= st.LEAST_CONTEXT)
        live, here, given = live[alive], here[alive], given[alive]
        node[live] = here
        if given.all():
            continue
        open_ones, of = live[~given], here[~given]
        events, first, at = np.unique((of << 32) | symbols[open_ones], return_index=True, return_inverse=True)
        n = np.bincount(at, weights=learned[open_ones], minlength=len(events))
        log, where = logs[open_ones[first]], events >> 32
        often = n >= st.LEAST_EVENT
        own, kept, rest = st.distributions(where[often], n[often], 10 ** log[often], total)
        out = log + np.where(kept[where], rest[where], 0.0)
        out[often] = np.where(kept[where[often]], np.log10(own), log[often])
        logs[open_ones] = out[at]
    return logs


def _solved(root):
    """A bucket's branches: sums of log10 probabilities by batch and document."""

    def task(table: pa.Table) -> pa.Table:
        plain = table.column("places").is_null()
        done = table.filter(plain).select(["batch", "docs", "sums"]).combine_chunks()
        batches, docs, sums = (done.column(c).to_pylist() for c in ("batch", "docs", "sums"))
        rows = table.filter(pc.invert(plain))
        if rows.num_rows:
            n = rows.column("n").to_pylist()
            parts = [_unpacked(x, k) for x, k in zip(rows.column("places").to_pylist(), n, strict=True)]
            columns, flags, known = (np.concatenate([x[k] for x in parts], axis=-1) for k in range(3))
            level = flags >> 1
            del parts
            symbols = columns[3].astype(np.int64)
            logs = root.value.steps[root.value.step(symbols)]
            logs[level > 0] = known
            logs = learned_logs(columns[:3], symbols, flags & 1, level, logs)
            for number, a, b in zip(rows.column("batch").to_pylist(), np.cumsum([0, *n[:-1]]).tolist(), np.cumsum(n).tolist(), strict=True):
                which, total = _sums(columns[4, a:b], logs[a:b])
                batches.append(number)
                docs.append(which)
                sums.append(total)
            release()
        return pa.table({"batch": pa.array(batches, pa.int64()), "docs": pa.array(docs, pa.binary()), "sums": pa.array(sums, pa.binary())})

    return task


def _totals(docs: pa.Table, parts: pa.Table) -> np.ndarray:
    """Sums by document."""
    which = np.asarray(docs.column(DOC).combine_chunks())
    total, large = np.zeros(int(which.max(initial=-1)) + 1, dtype=np.int64), ZstdDecompressor()
    for names, sums in zip(parts.column("docs").to_pylist(), parts.column("sums").to_pylist(), strict=True):
        if names:
            steps = np.frombuffer(large.decompress(names), np.uint8).reshape(4, -1).T
            total[np.cumsum(np.ascontiguousarray(steps).view("<i4")[:, 0])] += _received(np.frombuffer(large.decompress(sums), np.uint8))
    return total[which] / UNIT


def scores(docs: DataFrame, ws: Workspace, held_out: str = "held_out", keep: list[str] | None = None, most: int = HOT, bucket: int = BUCKET, turns: int = TURNS) -> DataFrame:
    """The columns of keep (all but texts) with n_tokens, n_known, train_tokens, base_score and score; rows of held_out are not learned from."""
    from pyspark.sql.pandas.types import to_arrow_schema

    context = docs.sparkSession.sparkContext
    tree, root, words = vocabulary(docs.where(~F.col(held_out)), ws)
    keep = [c for c in (keep or docs.columns) if c not in st.RESULTS]
    coded = st.code(docs.withColumn("__known", ~F.col(held_out)), tree, ws, [*keep, "__known"])
    # written by itself: the shuffles of its join go before texts are shuffled
    found = ws.save(entry_values(coded, words), "values")
    for name in ("words", "ordered"):
        ws.drop(name)
    rows = ws.save(numbered(coded, found, root, "__known").drop("__known"), "numbered", by=bv.BATCH)
    for name in ("coded", "values"):
        ws.drop(name)
    ready = rows.select(bv.BATCH, DOC, "__learned", SYMBOLS)
    hot, values = hot_levels(rows, root, ws, most)
    buckets = max(1, -(-root.tokens // bucket))
    turns = min(turns, buckets)
    sent, levels = context.broadcast(root), len(hot)

    def deal(turn: int, batches):
        for number, some in _runs(batches):
            yield _dealt(number, some, sent.value, hot, [], buckets, turn, turns)

    def deal_with(turn: int, left: pa.Table, right: pa.Table) -> pa.Table:
        level, event, log = (np.asarray(right.column(c).combine_chunks()) for c in ("level", "event", "log"))
        found = []
        for k in range(1, levels + 1):
            mine = level == k
            keys = event[mine]
            order = np.argsort(keys)
            found.append((keys[order], log[mine][order]))
        if not left.num_rows:
            return pa.Table.from_batches([], to_arrow_schema(T_SENT))
        return pa.Table.from_batches([_dealt(int(left.column(bv.BATCH)[0].as_py()), left, sent.value, hot, found, buckets, turn, turns)])

    T_SENT = st.T._parse_datatype_string(_SENT_SCHEMA)
    parts = None
    for turn in range(turns):
        if values is None:
            dealt = ready.mapInArrow(partial(deal, turn), _SENT_SCHEMA)
        else:
            dealt = ready.groupBy(bv.BATCH).cogroup(values.groupBy("__of")).applyInArrow(partial(deal_with, turn), _SENT_SCHEMA)
        solved = ws.save(dealt.groupBy("bucket").applyInArrow(_solved(sent), "batch long, docs binary, sums binary"), f"sums{turn}")
        parts = solved if parts is None else parts.unionByName(solved)
    mine = rows.drop(SYMBOLS, "__learned")
    kept = [f for f in mine.schema.fields if f.name not in (bv.BATCH, DOC, SHARED)]

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        score = _totals(left, right) + np.asarray(left.column(SHARED).combine_chunks())
        return pa.Table.from_arrays([*[left.column(f.name) for f in kept], pa.array(score)], [*[f.name for f in kept], "score"])

    schema = st.T.StructType([*kept, st.T.StructField("score", st.T.DoubleType())])
    return mine.groupBy(bv.BATCH).cogroup(parts.groupBy("batch")).applyInArrow(finish, schema)
