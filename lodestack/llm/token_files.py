"""Token-id files in Simple-8b, written in ascending doc_id order and read back.

Format (version 1): a folder of Parquet files whose names ascend with doc_id. A row is a frame of whole
documents: shard, frame, doc_ids (int64), lengths (uint32, ids of each document), n_ids, offsets
(uint32, first word of each block of 128 ids, total at the end), words (uint64 Simple-8b words) and
words_crc32; all packed little-endian. A frame holds at most 2,048 documents or about 4 MB of text, and a longer
document alone.

Defined cases: a null text is an empty document (its end id only); null ids come first and stay null;
rows of equal id, or without one, are ordered by text, and dealt over several files by how their texts begin;
an empty table gives no frames; extra columns are not written; very long texts are one document of one frame.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm import simple8b
from lodestack.llm.common import regroup, text_or_empty, token_memo

FRAMES = "shard int, frame int, doc_ids binary, has_id binary, lengths binary, n_ids long, offsets binary, words binary, words_crc32 long"


def write_tokens(docs: DataFrame, vocabulary: str, path: str, end_id: int = 1) -> None:
    """Encode text, append end_id to each document and write the frames to path."""

    def encode(batches):
        from pyspark import TaskContext

        memo, shard, frame = token_memo(vocabulary), TaskContext.get().partitionId(), 0
        for batch in regroup(batches, 2048, 4_000_000):
            ids, starts = memo.encode(batch.column("text"))
            lengths = np.diff(starts) + 1
            ids = np.insert(ids, starts[1:], end_id)
            words, offsets = simple8b.encode(ids)
            data = words.astype("<u8").tobytes()
            known = batch.column("doc_id")
            yield pa.RecordBatch.from_pydict(
                {
                    "shard": pa.array([shard], pa.int32()),
                    "frame": pa.array([frame], pa.int32()),
                    "doc_ids": [np.asarray(pc.fill_null(known, 0)).astype("<i8").tobytes()],
                    "has_id": [np.asarray(pc.is_valid(known)).astype("u1").tobytes()],
                    "lengths": [lengths.astype("<u4").tobytes()],
                    "n_ids": pa.array([len(ids)], pa.int64()),
                    "offsets": [offsets.astype("<u4").tobytes()],
                    "words": [data],
                    "words_crc32": pa.array([zlib.crc32(data)], pa.int64()),
                }
            )
            frame += 1

    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id", F.substring("text", 1, 32)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(encode, FRAMES).write.option("compression", "none").parquet(path)


def frames(spark, path: str) -> DataFrame:
    return spark.read.schema(FRAMES).parquet(path)


def decode_frame(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(ids, where each document starts) of a frame; a damaged frame is an error."""
    if zlib.crc32(row["words"]) != row["words_crc32"]:
        raise ValueError(f"frame {row['frame']} of shard {row['shard']} is damaged")
    words, offsets = np.frombuffer(row["words"], dtype="<u8"), np.frombuffer(row["offsets"], dtype="<u4").astype(np.int64)
    ids = simple8b.decode(words, offsets, row["n_ids"])
    return ids, np.concatenate([[0], np.cumsum(np.frombuffer(row["lengths"], dtype="<u4"), dtype=np.int64)])


def read_tokens(spark, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32, all from the files."""

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, starts = decode_frame(row)
                data = memoryview(ids.astype("<u4").tobytes())
                at = (4 * starts).tolist()
                known = np.frombuffer(row["has_id"], dtype="u1") == 0
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(known), row["shard"], dtype=np.int32)),
                        pa.array(np.full(len(known), row["frame"], dtype=np.int32)),
                        pa.array(np.frombuffer(row["doc_ids"], dtype="<i8"), mask=known),
                        pa.array(starts[:-1]),
                        pa.array(np.diff(starts)),
                        pa.array([zlib.crc32(data[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64()),
                    ],
                    ["shard", "frame", "doc_id", "local", "n_tokens", "ids_crc32"],
                )

    stored = frames(spark, path)
    # few rows: a frame stands for thousands of documents; its start is the sum of those before it
    totals = stored.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    shards = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("shard_start"))
    w = Window.partitionBy("shard").orderBy("frame")
    begin = stored.select("shard", "frame", (F.sum("n_ids").over(w) - F.col("n_ids")).alias("frame_start")).join(shards, "shard")
    begin = begin.select("shard", "frame", (F.col("frame_start") + F.col("shard_start")).alias("base"))
    rows = stored.mapInArrow(decode, "shard int, frame int, doc_id long, local long, n_tokens long, ids_crc32 long")
    return rows.join(begin, ["shard", "frame"]).select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
