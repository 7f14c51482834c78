"""The thin queries of this package, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import Workspace, documents, small_batches


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm import secrets as s

    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = s.find_secrets(docs, s.train_from(docs), ["doc_id"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex", "markov")],
        F.sha2(s.joined("assign", "access", "hex"), 256).alias("base_sha256"),
        s.joined().alias("spans"),
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.token_counts import count_tokens

    docs = documents(spark, sf_dir).select("doc_id", "text")
    return count_tokens(docs, vocabulary("word_bpe_49k.json"), blanks_matter=False).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.token_files import read_tokens, write_tokens

    path = Workspace(spark, "token-files").path("ids")
    write_tokens(documents(spark, sf_dir), vocabulary("word_bpe_49k.json"), path)
    return read_tokens(spark, path)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm import quality_rules as q

    counted = q.with_votes(q.with_counts(documents(spark, sf_dir), ["doc_id"]))
    voted = Workspace(spark, "quality").save(counted, "votes")
    judged = q.judge(voted, q.fit(voted, list(q.votes())))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("quality", 6).alias("quality"))


#: The rules that the query judges by: host, path, action.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.url_filters import judge_urls

    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(a).alias("action")) for h, p, a in URL_RULES])))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op3_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.near_dups import near_duplicates

    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.winnowing import with_edited

    return with_edited(documents(spark, sf_dir))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm import toxicity as t

    docs = documents(spark, sf_dir).select("doc_id", "text")
    model = t.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = t.score_toxicity(docs, model, ["doc_id"])
    return scored.select("doc_id", t.held_out().alias("held_out"), "score", "predicted", F.size("spans").cast("long").alias("n_spans"), F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), ",").alias("spans"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.mixing import mix

    mixed = mix(documents(spark, sf_dir).select("doc_id", "text", "source", "lang"))
    return mixed.select("doc_id", "source", "lang", "topic", "tokens", F.round("weight", 6).alias("weight"), F.round("probability", 6).alias("probability"), "capped", "sampled")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm.centroids import cluster

    small_batches(spark)
    found, _ = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), k=40, rounds=5, salt="2", keep=["vec_id"])
    return found.drop("evaluated")


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm import alignment as a

    docs = documents(spark, sf_dir).select("doc_id", "text")
    aligned = a.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), ["doc_id"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return a.link_counts(aligned.withColumn("groups", digest), Workspace(spark, "alignment")).withColumnRenamed("groups", "groups_sha256")


def op13_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestack.llm import branches, suffix_tree

    docs = documents(spark, sf_dir).select("doc_id", "text", suffix_tree.held_out().alias("held_out"))
    return branches.scores(docs, Workspace(spark, "suffix-tree"), keep=["doc_id", "held_out"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DUPS_SQL = f"""WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS (SELECT a.doc_id AS x, b.doc_id AS y FROM flat a JOIN flat b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS r FROM sets UNION SELECT reach.doc_id, links.y FROM reach JOIN links ON links.x = reach.r)
SELECT sets.doc_id, cast(len(s) AS bigint) AS n_shingles, min(r) AS component_id, sets.doc_id = min(r) AS kept FROM sets JOIN reach USING (doc_id) GROUP BY sets.doc_id, s"""


def _url_sql() -> str:
    fits = {h + p: f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in URL_RULES}
    longest = sorted(URL_RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits[h + p]} THEN '{h}{p}'" for h, p, _ in longest)
    action = " ".join(f"WHEN rule = '{h}{p}' THEN '{a}'" for h, p, a in longest)
    return f"""WITH parts AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
judged AS (SELECT *, CASE {rule} END AS rule FROM parts) SELECT page_id, host, path, rule, CASE {action} ELSE 'allow' END AS verdict FROM judged"""


def _centroids_sql(k: int = 40, rounds: int = 5) -> str:
    square = "list_sum(list_transform(range(1, 65), lambda i: (v.x[i] - c.x[i]) * (v.x[i] - c.x[i])))"
    parts = [
        "v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda y: cast(floor(256 * cast(y AS double)) AS bigint)) AS x FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: isfinite(y))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS j, x FROM v ORDER BY j LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT r, arg_min(j, struct_pack(d := d, j := j)) AS j, min(d) AS d FROM (SELECT v.r, c.j, cast({square} AS bigint) AS d FROM v CROSS JOIN c{t} c) GROUP BY r)")
        if t < rounds:
            means = f"SELECT j, list(m ORDER BY i) AS x FROM (SELECT a.j, i, cast((sum(v.x[i]) - (((sum(v.x[i]) % count(*)) + count(*)) % count(*))) / count(*) AS bigint) AS m FROM a{t} a JOIN v USING (r) CROSS JOIN range(1, 65) g(i) GROUP BY a.j, i) GROUP BY j"
            parts.append(f"c{t + 1} AS MATERIALIZED (SELECT c.j, coalesce(m.x, c.x) AS x FROM c{t} c LEFT JOIN ({means}) m USING (j))")
    last = f"SELECT v.vec_id, cast(a.j AS integer) AS cluster, a.d AS distance, cast(sum(a.d) OVER (PARTITION BY a.j) AS bigint) AS cluster_inertia, cast(sum(a.d) OVER () AS bigint) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v USING (r) JOIN c{rounds} c ON c.j = a.j"
    return "WITH " + ",\n".join(parts) + "\n" + last


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can express; models, samples and token ids are held against brute force in tests."""
    return {"op3_near_dups": NEAR_DUPS_SQL, "op6_url_filters": _url_sql(), "op11_centroids": _centroids_sql()}
