"""Ordering and guards that operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Scores are ranked at nine decimals: sums of equal terms in another order must tie, and ties go by id.
SCORE_DECIMALS = 9


def wider(df: DataFrame, **more: str) -> T.StructType:
    """The schema of df and further fields by DDL type; StructType.add() would change df's own."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, T._parse_datatype_string(v)) for k, v in more.items()]])


class ContractError(ValueError):
    """Data that breaks a stated contract."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path under spark.checkpoint.dir, which driver and executors share; a temporary one on a single machine."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ContractError("spark.checkpoint.dir must name a folder that all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='lodestack-')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, path: str, **options) -> DataFrame:
    """df, computed once and written to path: whatever reads it sees the same rows. options: the writer's."""
    df.write.mode("overwrite").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables that stay hold texts two or three times over: zstd takes two thirds of what the session's codec does.
STORED = {"compression": "zstd"}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffles of each action in it are deleted as the action ends, not when the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


def let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hit_order(score: str = "score") -> list[Column]:
    """Total order of hits: score, then document, chunk and representation."""
    return [F.round(score, SCORE_DECIMALS).desc(), F.col("document_id"), F.col("chunk_id"), F.col("representation_id")]


def top_k(hits: DataFrame, k: int, order: list[Column] | None = None, by: tuple[str, ...] = ("query_id",)) -> DataFrame:
    """The first k rows of each query with their rank; the limit is pushed below the shuffle."""
    if k < 1:
        raise ContractError("the limit must be positive")
    w = Window.partitionBy(*by).orderBy(*(order or hit_order()))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def require(violations: DataFrame, what: str) -> None:
    """Raise for the first violations, if there are any."""
    found = violations.limit(5).collect()
    if found:
        raise ContractError(f"{what}: " + "; ".join(str(r.asDict()) for r in found))
