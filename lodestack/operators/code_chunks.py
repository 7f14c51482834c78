"""Go sources: declarations as chunks, admission of files, symbol representations.

A scanner finds top-level declarations by brackets outside strings and comments; signatures are the
source up to the body with blanks collapsed, not a re-printed syntax tree.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestack.functions import text as t
from lodestack.operators import chunking, representations, validation

EXTRACTOR = "go-declarations-v1"
RECORD = (
    "document_id string, ordinal int, byte_start int, byte_end int, line_start int, line_end int, text string, kind string, name string, qualified_name string, "
    "receiver string, signature string, documentation string, exported boolean, test boolean, package_name string, parse_status string, path string, package_path string"
)
MEMBER = re.compile(r"func\s*(\([^)]*\))?\s*([\w]+)?")


@dataclass(frozen=True)
class Policy:
    maximum_bytes: int = 1 << 20
    maximum_testdata_bytes: int = 256 << 10
    include_vendor: bool = False
    include_generated: bool = False


def is_generated(text: str) -> bool:
    """A generated-code marker before any code."""
    comment = False
    for line in map(str.strip, text.split("\n")):
        if line.startswith("// Code generated ") and line.endswith(" DO NOT EDIT."):
            return True
        if not comment and line.startswith("/*"):
            comment, line = True, line[2:]
        if comment:
            before, mark, after = line.partition("*/")
            comment = not mark
            if mark and after.strip():
                return False
        elif line and not line.startswith("//"):
            return False
    return False


def admission(path: Column, size: Column, generated: Column, policy: Policy = Policy()) -> Column:
    """Why a file is left out, or 'admitted'."""
    within = lambda d: F.startswith(path, F.lit(f"{d}/")) | F.contains(path, F.lit(f"/{d}/"))
    return (
        F.when(F.lit(not policy.include_vendor) & within("vendor"), "vendor")
        .when(size > policy.maximum_bytes, "file-too-large")
        .when(within("testdata") & (size > policy.maximum_testdata_bytes), "testdata-too-large")
        .when(F.lit(not policy.include_generated) & generated, "generated")
        .otherwise("admitted")
    )


@F.pandas_udf(T.BooleanType())
def generated(text: pd.Series) -> pd.Series:
    """is_generated of each text; a null one is not."""
    return text.fillna("").map(is_generated).astype(bool)


def admit(files: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """files (path, text) with size_bytes, reason and, where admitted, digest."""
    out = files.withColumn("size_bytes", F.octet_length("text")).withColumn("reason", admission(F.col("path"), F.col("size_bytes"), generated("text"), policy))
    return out.withColumn("digest", F.when(F.col("reason") == "admitted", t.digest("text")))


def _code_mask(text: str) -> str:
    """The source with strings and comments blanked, of equal length."""
    out, i, n = list(text), 0, len(text)
    while i < n:
        two, stop = text[i : i + 2], None
        if two == "//":
            stop = text.find("\n", i)
        elif two == "/*":
            end = text.find("*/", i + 2)
            stop = -1 if end < 0 else end + 2
        elif text[i] == "`":
            end = text.find("`", i + 1)
            stop = -1 if end < 0 else end + 1
        elif text[i] in "\"'":
            j = i + 1
            while j < n and text[j] not in (text[i], "\n"):
                j += 2 if text[j] == "\\" else 1
            stop = min(j + 1, n)
        if stop is None:
            i += 1
            continue
        stop = n if stop < 0 else stop
        for k in range(i, stop):
            if out[k] != "\n":
                out[k] = " "
        i = stop
    return "".join(out)


def declarations(text: str, path: str) -> tuple[list[dict], list[str]]:
    """(declarations with code point ranges, problems) of one source file."""
    mask, found, problems = _code_mask(text), [], []
    package = re.search(r"^package\s+(\w+)", mask, re.MULTILINE)
    name = package[1] if package else ""
    if not package:
        problems.append("no package clause")
    test = path.endswith("_test.go")
    if package and (doc := _doc_start(text, mask, package.start())) < package.start():
        found.append(dict(start=doc, end=package.end(), kind="package", name=name, documentation=_comment(text[doc : package.start()]), signature="", receiver="", exported=False))
    depth = line_start = 0
    starts = []
    for line in mask.split("\n"):
        if depth == 0 and re.match(r"(func|type|const|var)\b", line):
            starts.append(line_start)
        depth = max(0, depth + sum(line.count(c) for c in "({[") - sum(line.count(c) for c in ")}]"))
        line_start += len(line) + 1
    if depth:
        problems.append("brackets are not closed")
    for at in starts:
        end = _declaration_end(mask, at)
        word = re.match(r"\w+", mask[at:])[0]
        doc = _doc_start(text, mask, at)
        d = dict(start=doc, end=end, kind=word, name="", receiver="", documentation=_comment(text[doc:at]), signature="", exported=False)
        if word == "func":
            m = MEMBER.match(mask, at)
            d["name"] = m[2] or ""
            d["receiver"] = _receiver(text[m.start(1) : m.end(1)]) if m[1] else ""
            d["kind"] = "method" if m[1] else _function_kind(d["name"], test)
            body = mask.find("{", m.end())
            d["signature"] = " ".join(("func" + text[m.end() : body if 0 <= body < end else end]).split())
        else:
            head = re.match(r"\w+\s+(\w+)", mask[at:end])
            if head:
                d["name"] = head[1]
            d["signature"] = " ".join(text[at:end].split("{", 1)[0].split("\n", 1)[0].split())
        d["exported"] = d["name"][:1].isupper()
        found.append(d)
    for d in found:
        d.update(package_name=name, test=test, parse_status="syntax-errors" if problems else "syntax")
    return found, problems


def _declaration_end(mask: str, at: int) -> int:
    depth = 0
    for i in range(at, len(mask)):
        c = mask[i]
        depth += (c in "({[") - (c in ")}]")
        if c == "\n" and depth <= 0:
            return len(mask[:i].rstrip())
    return len(mask.rstrip())


def _doc_start(text: str, mask: str, at: int) -> int:
    """Where the comment that stands directly above begins."""
    start = at
    while start > 0:
        line = text.rfind("\n", 0, start - 1) + 1
        own = text[line : start - 1]
        if not own.strip() or mask[line : start - 1].strip():
            break
        start = line
    return start


def _comment(text: str) -> str:
    lines = [re.sub(r"^\s*(//|/\*|\*/|\*)\s?", "", x).removesuffix("*/").rstrip() for x in text.split("\n")]
    return "\n".join(lines).strip()


def _receiver(text: str) -> str:
    return text.strip("() \t").split()[-1] if text.strip("() \t") else ""


def _function_kind(name: str, test: bool) -> str:
    kinds = {"Example": "example", "Test": "test", "Benchmark": "benchmark", "Fuzz": "fuzz"}
    return next((k for prefix, k in kinds.items() if test and name.startswith(prefix)), "function")


def extract(documents: DataFrame) -> DataFrame:
    """Declarations of Go documents (metadata: repository, commit, path, package_path) with chunk ids."""
    names = [c.split()[0] for c in RECORD.split(", ")]

    def task(frames):
        for frame in frames:
            rows = []
            for doc, text, path, package in zip(frame["id"], frame["text"], frame["path"], frame["package"], strict=True):
                for n, d in enumerate(declarations(text, path)[0]):
                    piece = text[d["start"] : d["end"]]
                    begin = len(text[: d["start"]].encode())
                    own = f"({d['receiver']}).{d['name']}" if d["receiver"] else d["name"]
                    qualified = f"{package}.{own}" if package and own else own
                    first = text.count("\n", 0, d["start"]) + 1
                    rows.append((doc, n, begin, begin + len(piece.encode()), first, first + piece.count("\n"), piece, d["kind"], d["name"], qualified, d["receiver"], d["signature"], d["documentation"], d["exported"], d["test"], d["package_name"], d["parse_status"], path, package))
            yield pd.DataFrame(rows, columns=names)

    meta = lambda k: F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))
    found = documents.select("id", "text", meta("path").alias("path"), meta("package_path").alias("package")).mapInPandas(task, RECORD)
    key = F.struct(F.col("document_id").alias("DocumentID"), F.lit(EXTRACTOR).alias("Extractor"), F.col("kind").alias("Kind"), F.col("qualified_name").alias("QualifiedName"), t.digest("text").alias("ContentDigest"), F.col("byte_start").alias("ByteStart"), F.col("byte_end").alias("ByteEnd"))
    return found.withColumns({"id": t.truncated_id("chunk-", key), "content_digest": t.digest("text"), "chunker": F.lit(EXTRACTOR)})


def record_problems(records: DataFrame, documents: DataFrame) -> DataFrame:
    """(entity, key, problem) of declaration chunks: what chunks must meet, and their documents' and own metadata."""
    meta = lambda k: t.trimmed(F.coalesce(F.try_element_at("metadata", F.lit(k)), F.lit(""))) == ""
    blank = lambda c: t.trimmed(F.coalesce(c, F.lit(""))) == ""
    origin = documents.select(F.col("id").alias("document_id"), (meta("repository") | meta("commit") | meta("path")).alias("no_origin"))
    tests = {
        "no repository, commit or path": "no_origin",
        "bad lines": "line_start < 1 or line_end < line_start",
    }
    found = records.join(origin, "document_id").withColumn("unnamed", blank(F.col("kind")) | blank(F.col("package_name")))
    problems = F.array_compact(F.array(*[F.when(F.coalesce(F.expr(x), F.lit(True)), F.lit(name)) for name, x in tests.items()], F.when(F.col("unnamed"), F.lit("no kind or package"))))
    own = found.select(F.lit("record").alias("entity"), F.col("id").alias("key"), F.explode(problems).alias("problem"))
    return validation.chunk_problems(records, documents).unionByName(own)


def fixed_with_lines(documents: DataFrame, size: int, overlap: int) -> DataFrame:
    """Fixed chunks of sources with line numbers and package name."""
    chunks = chunking.Fixed(size, overlap).chunk(documents)
    docs = documents.select(F.col("id").alias("document_id"), F.col("text").alias("whole"), F.regexp_extract("text", "(?m)^package\\s+(\\w+)", 1).alias("package_name"))
    lines = lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit("")))
    before = F.substring(F.col("whole").cast("binary"), F.lit(1), F.col("byte_start")).cast("string")
    joined = chunks.join(docs, "document_id")
    return joined.withColumn("line_start", lines(before) + 1).withColumn("line_end", F.col("line_start") + lines(F.rtrim("text"))).drop("whole")


def symbols(records: DataFrame, repository: str) -> DataFrame:
    """Symbol representations of what extract returns, with ids like other representations'."""
    text = t.symbol_text(F.col("kind"), F.col("name"), F.col("qualified_name"), F.col("package_path"), F.col("signature"), F.lit(repository), F.coalesce(F.col("path"), F.lit("")), F.col("documentation"))
    return representations.derived(records, "symbol", text)
