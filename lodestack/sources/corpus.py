"""Corpora and evaluation sets as strict JSON files, and corpus digests."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack import schemas as s
from lodestack.functions import text as t
from lodestack.operators import validation as val
from lodestack.operators.common import ContractError, require


def _strict(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A JSON file of exactly these fields; others, wrong types and trailing values are errors."""
    seen = spark.read.option("multiLine", True).option("primitivesAsString", True).json(path)
    known = [f.name for f in spark.createDataFrame([], ddl).schema]
    if extra := [c for c in seen.columns if c not in known]:
        raise ContractError(f"unknown fields in {path}: {', '.join(extra)}")
    return spark.read.schema(ddl).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of documents, not empty and valid."""
    docs = _strict(spark, path, s.DOCUMENT_DDL).withColumn("metadata", F.coalesce("metadata", F.create_map().cast("map<string,string>")))
    if docs.isEmpty():
        raise ContractError("the corpus is empty")
    require(val.document_problems(docs), "corpus")
    return docs


def load_evaluation(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str]:
    """(queries, judgments with pos, corpus digest) of an evaluation file."""
    whole = _strict(spark, path, s.EVALUATION_DDL)
    queries = whole.select(F.explode("queries").alias("q")).select("q.*")
    judgments = whole.select(F.posexplode("judgments").alias("pos", "j")).select("j.*", "pos")
    if queries.isEmpty():
        raise ContractError("the evaluation set has no queries")
    require(val.query_problems(queries), "queries")
    require(val.judgment_problems(judgments, queries), "judgments")
    return queries, judgments, whole.select(F.coalesce("corpus_digest", F.lit(""))).first()[0]


#: Hexadecimal digits of the key's hash that name a leaf: 256 leaves a table.
LEAF_DIGITS = 2


@dataclass(frozen=True)
class Tree:
    """A digest of a table: of each leaf, the rows whose key's hash begins with its name, and of all leaves."""

    rows: int
    leaves: dict[str, str]

    @property
    def root(self) -> str:
        return hashlib.sha256(",".join(f"{k}{v}" for k, v in sorted(self.leaves.items())).encode()).hexdigest() if self.leaves else ""

    def differing(self, other: Tree) -> list[str]:
        """Names of the leaves that are not the same in both."""
        return sorted(k for k in self.leaves.keys() | other.leaves.keys() if self.leaves.get(k) != other.leaves.get(k))


def checksum_tree(rows: DataFrame, *order: str) -> Tree:
    """Like table_tree for tables that are derived from digested ones: rows have two 64-bit hashes, which tell changes that
    happen but withstand no one who makes them on purpose, at a tenth of the cost."""
    columns = [F.col(c) for c in sorted(rows.columns)]
    hashes = [F.xxhash64(F.lit(seed), *columns).alias(f"h{seed}") for seed in (0, 1)]
    leaf = F.lpad(F.lower(F.hex(F.pmod(F.xxhash64(*[F.col(c) for c in order]), F.lit(16**LEAF_DIGITS)))), LEAF_DIGITS, "0").alias("leaf")
    words = [w.alias(f"w{2 * i + j}") for i, h in enumerate(("h0", "h1")) for j, w in enumerate((F.shiftrightunsigned(h, 32), F.col(h).bitwiseAND(F.lit(0xFFFFFFFF))))]
    return _summed(rows.select(leaf, *hashes).select("leaf", *words), len(words))


def _summed(words: DataFrame, n: int) -> Tree:
    sums = words.groupBy("leaf").agg(F.count("*").alias("n"), *[F.sum(f"w{i}").alias(f"w{i}") for i in range(n)])
    leaves = {r["leaf"]: (r["n"], hashlib.sha256(",".join(str(x) for x in r[1:]).encode()).hexdigest()) for r in sums.collect()}
    return Tree(sum(n for n, _ in leaves.values()), {k: h for k, (_, h) in leaves.items()})


def _leaf(order: tuple[str, ...]):
    key = F.concat_ws("\u0001", *[F.col(c).cast("string") for c in order])
    return F.substring(F.sha2(key, 256), 1, LEAF_DIGITS)


def table_tree(rows: DataFrame, *order: str) -> Tree:
    """The digest tree of a table's rows, whatever their order and partitioning, in one pass.

    A row's SHA-256 is eight words of 32 bits, which are added up by leaf: tasks send one row of sums for each leaf, and
    no row digest is moved. A sum tells repeated rows from single ones, and holds 2 ** 31 rows of a leaf; more are an error.
    """
    row = t.json_digest(F.struct(*[F.col(c) for c in sorted(rows.columns)]))
    word = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("long")
    digests = rows.select(_leaf(order).alias("leaf"), row.alias("h"))
    return _summed(digests.select("leaf", *[word(i).alias(f"w{i}") for i in range(8)]), 8)


def leaf_rows(rows: DataFrame, leaves: list[str], *order: str) -> DataFrame:
    """The rows of some leaves: where two trees differ, what to compare."""
    return rows.where(_leaf(order).isin(leaves))


def table_digest(rows: DataFrame, *order: str) -> str:
    """The root of a table's digest tree."""
    return table_tree(rows, *order).root


def check_corpus(documents: DataFrame, expected: str) -> None:
    """Whether the corpus is the one that an evaluation set was made for; an empty digest says nothing."""
    if expected and table_digest(documents, "id") != expected:
        raise ContractError("the corpus is not the one of the evaluation set")


def decode_strict(text: str, fields: dict[str, type]) -> dict:
    """One JSON object of exactly known fields."""
    value, end = json.JSONDecoder().raw_decode(text.strip())
    if text.strip()[end:].strip():
        raise ContractError("trailing data")
    if not isinstance(value, dict) or (extra := sorted(set(value) - set(fields))):
        raise ContractError(f"unknown fields: {extra if isinstance(value, dict) else value!r}")
    for k, x in value.items():
        if x is not None and not isinstance(x, fields[k]):
            raise ContractError(f"field {k} has another type")
    return value


def contained_path(root: str, name: str) -> Path:
    """name under root, with links resolved; a path that leads out is an error."""
    base, path = Path(root).resolve(), (Path(root) / name).resolve()
    if not path.is_relative_to(base):
        raise ContractError(f"{name} leads out of {root}")
    return path
