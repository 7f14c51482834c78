"""Values of keys, met again by the documents that hold them, without a row for each document and key.

Documents are read in batches (bounded by rows and bytes). A batch lists its distinct keys once, as entries; its
documents hold places in that list. Entries are joined to whatever a key's value is, by key, and return to their
batch: as a batch lists a key once, a key that every document holds is as many rows as there are batches.

The table that is written has one row a document, with its places, and one row a batch, with its entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents and bytes of text of a batch, at most; one longer text is a batch of its own.
ROWS, BYTES = 4096, 8_000_000
BATCH, PLACES, ENTRIES = "__batch", "__places", "__entries"


def batch_ids() -> Iterator[int]:
    """Numbers that no other task gives: they are read from the written table only, which holds one attempt of each task."""
    first = TaskContext.get().partitionId() << 32
    while True:
        yield first
        first += 1


def written_schema(fields: list[T.StructField], entry: str) -> T.StructType:
    """Columns of the written table: fields of documents, which are null in rows of batches, and ours."""
    own = [T.StructField(BATCH, T.LongType()), T.StructField(PLACES, T.BinaryType()), T.StructField(ENTRIES, T.ArrayType(T._parse_datatype_string(entry)))]
    return T.StructType([*[T.StructField(f.name, f.dataType) for f in fields], *own])


def document_rows(batch: int, columns: list[pa.Array], places: list[bytes], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    n = len(places)
    return pa.RecordBatch.from_arrays([*columns, pa.array([batch] * n, pa.int64()), pa.array(places, pa.binary()), pa.nulls(n, kinds[-1])], names)


def batch_row(batch: int, entries: pa.StructArray, kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    listed = pa.ListArray.from_arrays(pa.array([0, len(entries)], pa.int32()), entries)
    return pa.RecordBatch.from_arrays([*[pa.nulls(1, k) for k in kinds[:-3]], pa.array([batch], pa.int64()), pa.nulls(1, pa.binary()), listed], names)


def packed(places: np.ndarray, often: np.ndarray) -> bytes:
    """A document's places in its batch's list, ascending, as differences, and how often it holds each."""
    return np.diff(places, prepend=0).astype("<i4").tobytes() + often.astype("<i4").tobytes()


def unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(row, dtype="<i4").astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def entries(written: DataFrame) -> DataFrame:
    """One row for each batch and key: __batch, __k (the place in the batch's list) and the entry's fields."""
    listed = written.where(F.col(ENTRIES).isNotNull()).select(BATCH, F.posexplode(ENTRIES).alias("__k", "__e"))
    return listed.select(BATCH, "__k", "__e.*")


def with_values(written: DataFrame, values: DataFrame, finish: Callable[[pa.Table, list[np.ndarray]], list[pa.Array]], added: str) -> DataFrame:
    """Documents with the columns of added, which finish makes for one batch.

    values: entries with further columns, of which finish gets one array each, in the order of the batch's list.
    """
    docs = written.where(F.col(PLACES).isNotNull()).drop(ENTRIES)
    kept = [f for f in docs.schema.fields if f.name not in (BATCH, PLACES)]
    schema = T.StructType([*kept, *T._parse_datatype_string(added).fields])
    names = [f.name for f in schema.fields]
    columns = [c for c in values.columns if c not in (BATCH, "__k")]

    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(np.asarray(right.column("__k")), kind="stable")
        found = [np.asarray(right.column(c).combine_chunks())[order] for c in columns]
        made = finish(left, found)
        return pa.Table.from_arrays([*[left.column(f.name) for f in kept], *made], names)

    values = values.select(F.col(BATCH).alias("__of"), "__k", *columns)
    return docs.groupBy(BATCH).cogroup(values.groupBy("__of")).applyInArrow(task, schema)
