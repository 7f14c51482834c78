"""Documents that arrive over time, cut and appended batch by batch.

The library has no event-time semantics; a stream here is an unbounded list of documents. Each micro-batch is
checked, cut and appended to the stage tables under its own batch number, so a batch that is
tried again replaces what it wrote and nothing is doubled. `ingest` takes documents as they come; `ingest_once` keeps the
digest of every id beside them, so that documents that come again are dropped and those that differ are set aside.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestack import schemas as s
from lodestack.operators import embedding
from lodestack.operators import representations as rep
from lodestack.operators import validation as val
from lodestack.operators.common import STORED, ContractError, require, saved, tidy
from lodestack.sources.bundle import exists, hadoop_path, publish, remove

STAGES = ("documents", "chunks", "representations")


def stage_batch(documents: DataFrame, batch: int, chunker, root: str) -> None:
    """One batch: documents, chunks and raw representations, each under batch=<number>.

    Each table is written once and read for the next one, and gets its place when all three are there."""
    spark, part = documents.sparkSession, f"{root}/_arriving/batch={batch}"
    with tidy(spark):
        try:
            written = saved(documents, f"{part}/documents", **STORED)
            require(val.document_problems(written), f"batch {batch}")
            chunks = saved(chunker.chunk(written), f"{part}/chunks", **STORED)
            saved(rep.raw(chunks), f"{part}/representations", **STORED)
            for name in STAGES:
                _place(spark, f"{part}/{name}", root, name, batch)
        finally:
            remove(spark, part)


def _place(spark: SparkSession, part: str, root: str, name: str, batch: int) -> None:
    """Give a written table its place, instead of what an earlier try of the batch has left there."""
    at = f"{root}/{name}/batch={batch}"
    remove(spark, at)
    fs, folder = hadoop_path(spark, at)
    fs.mkdirs(folder)
    publish(spark, part, f"{at}/piece=0")


def ingest(spark: SparkSession, source: str, chunker, root: str, fmt: str = "parquet", **options) -> StreamingQuery:
    """Start ingesting new document files of a folder; all that is there now is taken and the query ends."""
    stream = spark.readStream.format(fmt).schema(s.DOCUMENT_DDL).options(**options).load(source)
    return (
        stream.writeStream.foreachBatch(lambda df, n: stage_batch(df, n, chunker, root))
        .option("checkpointLocation", f"{root}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def staged(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stage table, whatever batches and pieces its files lie in."""
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{name}")


#: What became of the rows of one id: the first content, the same again, or another.
NEW, REPEAT, CONFLICT = "new", "repeat", "conflict"
_KNOWN = "id string, content_digest string, batch long"


def known(spark: SparkSession, root: str, batch: int) -> DataFrame:
    """id and content_digest that batches before this one have staged; what a batch that is tried again has written does not count."""
    at = f"{root}/_known"
    if not exists(spark, at):
        return spark.createDataFrame([], _KNOWN).drop("batch")
    return spark.read.schema(_KNOWN).parquet(at).where(F.col("batch") < batch).drop("batch")


def outcomes(arrived: DataFrame, before: DataFrame) -> DataFrame:
    """Documents of a batch with outcome and n, by the content that was met first under each id; before: the ids known so far.

    Among rows of an id that is not known yet, the one with the least digest is first. Rows that differ from the first are conflicts,
    one row of each content with how many there were; rows that agree are repeats, an id and how many. What becomes of them is
    told by ids and digests alone; texts are moved once, of equal ones in a task only one.
    """
    columns, digest = arrived.columns, F.coalesce("content_digest", F.lit("")).alias("digest")
    seen = arrived.groupBy("id", digest).agg(F.count("*").alias("seen"))
    firsts = before.select("id", F.col("content_digest").alias("first"))
    least = F.min("digest").over(Window.partitionBy("id"))
    told = lambda outcome, n: F.struct(F.lit(outcome).alias("outcome"), n.cast("long").alias("n"))
    one = F.array(told(NEW, F.lit(1)))
    new = F.when(F.col("seen") > 1, F.concat(one, F.array(told(REPEAT, F.col("seen") - 1)))).otherwise(one)
    same = F.col("digest") == F.coalesce("first", least)
    fate = F.when(~same, F.array(told(CONFLICT, F.col("seen")))).when(F.col("first").isNull(), new).otherwise(F.array(told(REPEAT, F.col("seen"))))
    fates = seen.join(firsts, "id", "left").withColumn("fate", fate).select("id", "digest", F.inline("fate"))
    rows = arrived.groupBy("id", digest).agg(F.first(F.struct(*[c for c in columns if c != "id"])).alias("row"))
    # a row without id meets none and is an error of the batch; the hint keeps texts from being broadcast
    met = (fates["id"] == rows["id"]) & (fates["digest"] == rows["digest"]) & (fates["outcome"] != REPEAT)
    out = fates.join(rows.hint("merge"), met, "left")
    return out.select(*[fates["id"] if c == "id" else rows["row"][c].alias(c) for c in columns], "outcome", "n")


def ingest_once(spark: SparkSession, source: str, chunker, root: str, fmt: str = "parquet", **options) -> StreamingQuery:
    """Like ingest, but each id is staged once, whatever the stream brings again, over micro-batches and restarts.

    Besides the stage tables there are `conflicts` (documents of a known id with other content, and n) and `repeats` (id, n). Rows
    without id are an error of the batch, as in ingest. The ids' digests are a table of their own, root/_known, to which each batch
    adds those that it staged."""
    stream = spark.readStream.format(fmt).schema(s.DOCUMENT_DDL).options(**options).load(source)
    return (
        stream.writeStream.foreachBatch(lambda df, n: _stage_outcomes(outcomes(df, known(df.sparkSession, root, n)), n, chunker, root))
        .option("checkpointLocation", f"{root}/_progress")
        .trigger(availableNow=True)
        .start()
    )


def _stage_outcomes(told: DataFrame, batch: int, chunker, root: str) -> None:
    """Write a batch's outcomes once: what is staged and what is set aside are of the same rows."""
    spark, part = told.sparkSession, f"{root}/_arrived/batch={batch}"
    with tidy(spark):
        try:
            rows = saved(told, f"{part}/all", **STORED)
            new = rows.where(F.col("outcome") == NEW).drop("outcome", "n")
            stage_batch(new, batch, chunker, root)
            aside = {"conflicts": rows.where(F.col("outcome") == CONFLICT).drop("outcome"), "repeats": rows.where(F.col("outcome") == REPEAT).select("id", "n")}
            for name, df in (aside | {"_known": new.select("id", "content_digest")}).items():
                saved(df, f"{part}/{name}", **STORED)
                _place(spark, f"{part}/{name}", root, name, batch)
        finally:
            remove(spark, part)


class Stager:
    """Batches of documents, chunks, representations and vectors, in this order of phases, under one folder.

    What is added is written once, checked as a whole and against what earlier phases have staged, then published under one
    number, by one rename; files of more than batch_size rows are dealt into pieces of about that many, without being written
    again. A phase is closed as soon as a later one has a batch; nothing to add is an error.
    """

    PHASES = ("documents", "chunks", "representations", "vectors")

    def __init__(self, spark: SparkSession, root: str, batch_size: int = 1_000_000):
        self.spark, self.root, self.batch_size = spark, root.rstrip("/"), batch_size

    def _has(self, phase: str) -> bool:
        return exists(self.spark, f"{self.root}/{phase}")

    def _add(self, phase: str, rows: DataFrame, problems: Callable[[DataFrame], list[DataFrame]]) -> None:
        at = self.PHASES.index(phase)
        if later := [p for p in self.PHASES[at + 1 :] if self._has(p)]:
            raise ContractError(f"{phase} cannot follow {later[0]}")
        if missing := [p for p in self.PHASES[:at] if not self._has(p)]:
            raise ContractError(f"{phase} need {missing[0]} first")
        batch, key = uuid.uuid4().hex, "representation_id" if phase == "vectors" else "id"
        part = f"{self.root}/part-{batch}"
        with tidy(self.spark):
            try:
                # files of a quarter of a piece at most, so that pieces of whole files come out even
                written = saved(rows, f"{part}/piece=0", maxRecordsPerFile=max(1, self.batch_size // 4), **STORED)
                if not (n := written.count()):
                    raise ContractError(f"there are no {phase} to stage")
                for found in problems(written):
                    require(found, phase)
                if self._has(phase):
                    require(written.select(key).join(staged(self.spark, self.root, phase).select(key), key, "left_semi"), f"{phase} that are staged already")
                if n > self.batch_size:
                    self._deal(part, written, -(-n // self.batch_size))
                fs, at_root = hadoop_path(self.spark, f"{self.root}/{phase}")
                fs.mkdirs(at_root)
                publish(self.spark, part, f"{self.root}/{phase}/batch={batch}")
            finally:
                remove(self.spark, part)

    def _deal(self, part: str, written: DataFrame, pieces: int) -> None:
        """Move files to pieces, the largest first and each to the piece that has the fewest rows yet."""
        files = written.groupBy(F.col("_metadata.file_name").alias("name")).agg(F.count("*").alias("n")).collect()
        loads = [(0, k) for k in range(pieces)]
        fs, _ = hadoop_path(self.spark, part)
        for k in range(1, pieces):
            fs.mkdirs(hadoop_path(self.spark, f"{part}/piece={k}")[1])
        for name, n in sorted(files, key=lambda x: (-x["n"], x["name"])):
            load, k = heapq.heappop(loads)
            heapq.heappush(loads, (load + n, k))
            if k:
                publish(self.spark, f"{part}/piece=0/{name}", f"{part}/piece={k}/{name}")

    def add_documents(self, rows: DataFrame) -> None:
        self._add("documents", rows, lambda df: [val.document_problems(df)])

    def add_chunks(self, rows: DataFrame) -> None:
        self._add("chunks", rows, lambda df: val.chunk_checks(df, staged(self.spark, self.root, "documents")))

    def add_representations(self, rows: DataFrame) -> None:
        self._add("representations", rows, lambda df: [val.representation_problems(df, staged(self.spark, self.root, "chunks"))])

    def add_vectors(self, rows: DataFrame) -> None:
        self._add("vectors", rows, lambda df: [embedding.vector_problems(df, staged(self.spark, self.root, "representations"))])
