"""What the corpus operators share: tables in the shared folder, token memos, Arrow helpers."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word contracts, U+0020 and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"
WORD_RE = re.compile("[^\x20\x09-\x0d]+")

#: ASCII punctuation without the apostrophe (contractions) and "<" (special strings).
MARKS = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"

MARKS_END = "(?P<marks>[" + re.escape(MARKS) + "]+)$"
LATIN_END = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]$"

#: Vectored reads leave each reading thread a direct buffer as large as what it read, for as long as it lives.
READING = {"parquet.hadoop.vectored.io.enabled": "false"}
#: For folders of the local file system, which forks a command for each file it makes: no second file with checksums.
WRITING = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}
#: Shuffles of a write are of no use once the table is there.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_OWN_FOLDER: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a fresh one where it is unset."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not _OWN_FOLDER:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        _OWN_FOLDER.append(f"file://{tempfile.mkdtemp(prefix='lodestack-')}")
    return _OWN_FOLDER[0]


class Workspace:
    """Intermediate tables of one operator call, as Parquet in the shared folder.

    A written table cuts lineage: a lost executor costs the tasks it ran, not the plan above them.
    Spark's committer makes each write all-or-nothing, so a retried task never doubles rows.
    """

    def __init__(self, spark: SparkSession, name: str, codec: str = "zstd"):
        self.spark = spark
        self.codec = codec
        small_batches(spark)
        self.root = f"{shared_folder(spark)}/lodestack/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._saved: dict[str, str] = {}
        self._tables: dict[str, str] = {}
        atexit.register(self.close)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """by: a column by which rows are bucketed, as many as a shuffle has partitions, so that they meet others by it without a shuffle."""
        path = self.path(name)
        writer = df.write.options(**WRITING).option("compression", self.codec)
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            if by:
                table = self._tables[path] = f"lodestack_{uuid.uuid4().hex}"
                writer.option("path", path).bucketBy(int(self.spark.conf.get("spark.sql.shuffle.partitions")), by).sortBy(by).saveAsTable(table, format="parquet")
            else:
                writer.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self._saved[name] = path
        if by:
            return self.spark.read.options(**READING).table(self._tables[path])
        return self.spark.read.options(**READING).schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete the table last saved under that name: what was made from it has been written since."""
        path = self._saved.pop(name)
        self._forget(path)
        self._delete(path)

    def _forget(self, path: str) -> None:
        if path in self._tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self._tables.pop(path)}")

    def _delete(self, path: str) -> None:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)

    def close(self) -> None:
        try:
            for path in list(self._tables):
                self._forget(path)
            self._delete(self.root)
        except Exception:  # the session has ended; the folder goes with the cluster's own clean-up
            return


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.options(**READING).parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


#: A key is hot if it holds more than one in so many of all rows; so many keys can be hot at most.
HOT_KEYS = 1_000


def spread_join(rows: DataFrame, values: DataFrame, key: str, n: str) -> DataFrame:
    """rows, left-joined to values (one row a key) without a hot key meeting in one task.

    n: the column of values that says how many rows hold the key. Values of hot keys, fewer than
    HOT_KEYS whatever the input holds, are broadcast; their rows, and those without key, are then dealt
    evenly, as lanes that no other value is in, and the rest meet by key as usual.
    """
    names = [c for c in values.columns if c != key]
    lane, hot, cold = "__lane", "__hot", "__cold"
    least = (values.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    packed = values.select(key, F.struct(*names).alias("x"), (F.col(n) > least).alias("is_hot"))
    out = rows.join(F.broadcast(packed.where("is_hot").select(key, F.col("x").alias(hot))), key, "left")
    out = out.withColumn(lane, F.when(F.col(hot).isNull() & F.col(key).isNotNull(), 0).otherwise(1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 30))).cast("int"))
    # a broadcast of the rest would have no bound
    rest = packed.where("not is_hot").select(key, F.col("x").alias(cold), F.lit(0).alias(lane)).hint("merge")
    out = out.join(rest, [key, lane], "left")
    found = F.coalesce(hot, cold)
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[found[c].alias(c) for c in names])


#: Rows of an Arrow batch between the JVM and Python, at most: texts may be long, and both sides hold
#: several batches at once.
BATCH_ROWS = 1_000


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to BATCH_ROWS, where it is larger: plans read it when they run, after the query returns."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def release() -> None:
    """Give freed memory back to the system: a worker waits for further tasks and keeps what it holds."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def regroup(batches: Iterable[pa.RecordBatch], rows: int = 4096, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most so many, and about so many bytes; one row may hold more."""
    held, n, held_size = [], 0, 0
    for batch in batches:
        step = max(1, min(rows, batch.num_rows * size // max(1, batch.nbytes))) if batch.num_rows else 1
        for start in range(0, batch.num_rows, step):
            part = batch.slice(start, step)
            if held and (n + part.num_rows > rows or held_size + part.nbytes > size):
                yield _joined_batch(held)
                held, n, held_size = [], 0, 0
            held.append(part)
            n, held_size = n + part.num_rows, held_size + part.nbytes
    if held:
        yield _joined_batch(held)
    held.clear()
    release()


def _joined_batch(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


class TokenMemo:
    """Encode texts word by word with a bounded memo; the ids are those of the whole text.

    The memo has two halves: when the newer one is full it becomes the older one, whose pieces move
    back as they are met, so frequent pieces stay and memory is bounded by `most` pieces.

    Texts are cut at blanks, equal pieces of a batch are found by Arrow's dictionary encoding, and
    only pieces new to this worker reach the tokenizer. Where the vocabulary drops white space any
    such cut is exact. Where a blank belongs to the word after it, a cut is exact unless the piece
    before it is empty or ends in white space: texts with such pieces are encoded whole.
    """

    def __init__(self, vocabulary: str, most: int = 800_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.most = most
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.drops_blanks = not self.ids([" "])[0]
        special = [(i, t.content) for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special]
        self.mark_id, self.mark = special[0] if special else (None, None)

    def ids(self, texts: list[str]) -> list[bytes]:
        """Each text on its own, as little-endian unsigned 32-bit integers."""
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Pieces without the marker, encoded as one text with markers between: one call, one result to cut."""
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = np.flatnonzero(ids == self.mark_id)
        buf = ids.tobytes()
        starts, ends = [0, *(4 * at + 4).tolist()], [*(4 * at).tolist(), len(buf)]
        return [buf[a:b] for a, b in zip(starts, ends, strict=True)]

    def _unit_ids(self, units: list[str]) -> list[bytes]:
        """Ids of units from the memo; units that are new to it are encoded, those without "<" many at a time."""
        if len(self.memo) > self.most // 2:
            self.memo, self.older = {}, self.memo
        memo, older = self.memo, self.older
        new = list(set(units).difference(memo))
        if older and new:
            memo.update([(k, older[k]) for k in new if k in older])
            new = [k for k in new if k not in memo]
        plain = [k for k in new if k and "<" not in k] if self.mark is not None else []
        for start in range(0, len(plain), 512):
            some = plain[start : start + 512]
            memo.update(zip(some, self._joined(some), strict=True))
        rest = new if self.mark is None else [k for k in new if not k or "<" in k]
        memo.update(zip(rest, self.ids(rest), strict=True))
        return list(map(memo.__getitem__, units))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids start (one entry more than texts)."""
        if self.drops_blanks:
            for c in "\n\t\r":
                texts = pc.replace_substring(texts, c, " ")
        cut = pc.split_pattern(texts, " ")
        bounds = np.asarray(cut.offsets, dtype=np.int64) - cut.offsets[0].as_py()
        coded = cut.flatten().dictionary_encode()
        which, found = np.array(coded.indices, dtype=np.int64), coded.dictionary
        if self.drops_blanks:  # letter case is dropped as well; special strings keep theirs
            plain = pc.and_(pc.string_is_ascii(found), pc.invert(pc.match_substring(found, "<")))
            pieces = pc.if_else(plain, pc.ascii_lower(found), found)
        else:  # all but a text's first piece take the blank before them
            pieces = pa.concat_arrays([pc.binary_join_element_wise(" ", found, ""), found.take(pa.array(which[bounds[:-1]]))])
            which[bounds[:-1]] = np.arange(len(found), len(pieces))
        values, starts = self._piece_ids(pieces)
        flat, starts = gather(values, starts, which)
        starts = starts[bounds]
        if not self.drops_blanks:
            trimmed = pc.equal(pc.utf8_rtrim_whitespace(pieces), pieces)
            unsafe = ~np.asarray(pc.or_(trimmed, pc.equal(pieces, "")))
            if unsafe.any():
                per_text = np.add.reduceat(unsafe[which].astype(np.int64), bounds[:-1]) > 0
                return self._whole(texts, flat, starts, np.flatnonzero(per_text).tolist())
        return flat, starts

    def _piece_ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row and where each one's start.

        Marks after a Latin letter always are a pre-token of their own: the word and its marks are two
        units, each encoded once whatever stands beside it.
        """
        core = pc.ascii_rtrim(pieces, characters=MARKS)
        split = pc.and_(pc.and_(pc.not_equal(core, pieces), pc.match_substring_regex(core, LATIN_END)), pc.invert(pc.match_substring(pieces, "<")))
        cores = pc.if_else(split, core, pieces).dictionary_encode()
        tails = pc.struct_field(pc.extract_regex(pieces.filter(split), MARKS_END), "marks").dictionary_encode()
        units = cores.dictionary.to_pylist()
        n = len(units)
        ids = self._unit_ids(units + tails.dictionary.to_pylist())
        size = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
        has = np.asarray(split)
        at = np.arange(len(has)) + np.cumsum(has) - has
        order = np.empty(len(has) + int(has.sum()), dtype=np.int64)
        order[at] = np.asarray(cores.indices)
        order[at[has] + 1] = n + np.asarray(tails.indices, dtype=np.int64)
        values, starts = gather(np.frombuffer(b"".join(ids), dtype="<u4"), np.concatenate([[0], np.cumsum(size)]), order)
        return values, np.append(starts[at], starts[-1])

    def _whole(self, texts: pa.Array, flat: np.ndarray, starts: np.ndarray, redo: list[int]) -> tuple[np.ndarray, np.ndarray]:
        parts, done = [], 0
        size = np.diff(starts)
        for i, ids in zip(redo, self.ids([texts[i].as_py() for i in redo]), strict=True):
            parts += [flat[starts[done] : starts[i]], np.frombuffer(ids, dtype="<u4")]
            size[i], done = len(ids) // 4, i + 1
        parts.append(flat[starts[done] :])
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(size)])


def gather(values: np.ndarray, starts: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs values[starts[k]:starts[k + 1]] for k in which; also where each run begins."""
    size = (starts[1:] - starts[:-1])[which]
    begins = np.concatenate([[0], np.cumsum(size)])
    kind = np.int32 if max(int(begins[-1]), len(values)) < 2**31 else np.int64
    at = np.repeat((starts[:-1][which] - begins[:-1]).astype(kind), size)
    at += np.arange(begins[-1], dtype=kind)
    return values[at], begins


_MEMOS: dict[tuple[str, int], TokenMemo] = {}
#: Pieces that a worker remembers: some 200 bytes each.
MEMO_PIECES = 800_000


def token_memo(vocabulary: str, most: int = MEMO_PIECES) -> TokenMemo:
    """One memo for each worker process, vocabulary file and size."""
    if (vocabulary, most) not in _MEMOS:
        _MEMOS[vocabulary, most] = TokenMemo(vocabulary, most)
    return _MEMOS[vocabulary, most]


def forget() -> None:
    """A worker drops its memos and returns their memory: tasks that encode nothing call it first, as the worker may have served ones that did."""
    if _MEMOS:
        _MEMOS.clear()
        release()


def key_runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows of equal keys (integers, sorted) as one table each, also across batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(k)) for k in keys]
        changed = np.zeros(batch.num_rows, dtype=bool)
        for c in columns:
            changed[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(changed).tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield last, pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield last, pa.Table.from_batches(held)
    held.clear()
    release()
