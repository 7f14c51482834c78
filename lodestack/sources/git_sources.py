"""Committed sources of git repositories, by a manifest of paths; nothing of a work tree is read."""

from __future__ import annotations

import json
import os
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions import text as t
from lodestack.operators.code_chunks import Policy, admit
from lodestack.operators.common import ContractError


def _git(repository: str, *arguments: str) -> bytes:
    """git on that repository only: variables of a surrounding git call are dropped."""
    env = {k: v for k, v in os.environ.items() if not k.startswith("GIT_")}
    done = subprocess.run(["git", "-C", repository, *arguments], capture_output=True, env=env)
    if done.returncode:
        raise ContractError(f"git {' '.join(arguments)}: {done.stderr.decode(errors='replace').strip()}")
    return done.stdout


def load_committed(spark: SparkSession, manifest: str, policy: Policy = Policy()) -> tuple[DataFrame, DataFrame]:
    """(documents, admissions) of the Go files at HEAD. manifest: JSON array of {name, path}."""
    rows = []
    for entry in json.loads(Path(manifest).read_text()):
        repository, name = entry["path"], entry["name"]
        commit = _git(repository, "rev-parse", "HEAD").decode().strip()
        paths = [p for p in _git(repository, "ls-tree", "-r", "--name-only", "-z", commit).decode().split("\0") if p.endswith(".go")]
        module = ""
        if "go.mod" in _git(repository, "ls-tree", "--name-only", commit).decode().split("\n"):
            lines = _git(repository, "show", f"{commit}:go.mod").decode().split("\n")
            module = next((x.split()[1] for x in lines if x.startswith("module ")), "")
        for p in paths:
            body = _git(repository, "show", f"{commit}:{p}").decode("utf-8", "replace")
            folder = os.path.dirname(p)
            rows.append((name, commit, p, body, f"{module}/{folder}" if folder else module))
    files = admit(spark.createDataFrame(rows, "repository string, commit string, path string, text string, package_path string"), policy)
    key = F.struct("repository", "commit", "path", "digest")
    meta = F.create_map(*[x for c in ("repository", "commit", "path", "package_path") for x in (F.lit(c), F.col(c))])
    docs = files.where("reason = 'admitted'").select(t.truncated_id("doc-", key).alias("id"), F.col("path").alias("source_uri"), F.col("path").alias("title"), "text", F.col("digest").alias("content_digest"), meta.alias("metadata"))
    return docs, files.select("repository", "commit", "path", "size_bytes", "reason", "digest")
