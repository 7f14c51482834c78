"""The catalogue's queries in DuckDB SQL, over the same tables."""

from __future__ import annotations

DOCS = "docs AS (SELECT cast(doc_id AS varchar) AS id, doc_id, text, source, lang FROM documents)"


def chunk_cte(name: str, size: int, overlap: int) -> str:
    step = size - overlap
    return f"""{name}_n AS (
  SELECT id AS document_id, text AS whole, unnest(range(0, 1 + cast(ceil(greatest(length(text) - {size}, 0) / {step}.0) AS bigint))) AS ordinal
  FROM docs WHERE length(text) > 0),
{name}_t AS (
  SELECT document_id, ordinal, cast(strlen(substring(whole, 1, ordinal * {step})) AS bigint) AS byte_start, substring(whole, ordinal * {step} + 1, {size}) AS text FROM {name}_n),
{name} AS (
  SELECT 'chunk-' || substr(sha256('{{"document_id":"' || document_id || '","chunker":"fixed-{size}-{overlap}","byte_start":' || byte_start || ',"byte_end":' || (byte_start + strlen(text)) || ',"text_digest":"' || sha256(text) || '"}}'), 1, 16) AS id,
    document_id, ordinal, byte_start, cast(byte_start + strlen(text) AS bigint) AS byte_end, text, sha256(text) AS content_digest FROM {name}_t)"""


def snapped_cte(sections: str, out: str, name: str, size: int, overlap: int, snap: int) -> str:
    """Windows of each section (document_id, whole, section, begin, stop; code points from 0), one after the other; needs WITH RECURSIVE."""
    full = f"least(start + {size}, stop)"
    low = f"greatest({full} - {snap}, start + 1)"
    # length up to the last sentence end within reach; regexp_extract gives '' where there is none
    last = f"({low} - 1 + length(regexp_extract(substring(whole, {low}, {full} - {low} + 1), '(?s)^(.*[.!?\\n])', 1)))"
    end = f"CASE WHEN {full} < stop AND {snap} > 0 AND {last} > {low} - 1 AND {last} > start + {overlap} THEN {last} ELSE {full} END"
    return f"""{out}_w AS (
  SELECT document_id, whole, section, stop, 0 AS n, begin AS start, (SELECT {end} FROM (SELECT begin AS start)) AS fin FROM {sections} WHERE begin < stop
  UNION ALL SELECT document_id, whole, section, stop, n + 1, start, {end} FROM (SELECT document_id, whole, section, stop, n, fin - {overlap} AS start FROM {out}_w WHERE fin < stop)),
{out}_t AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY section, n) - 1 AS ordinal, cast(strlen(substring(whole, 1, start)) AS bigint) AS byte_start, substring(whole, start + 1, fin - start) AS text FROM {out}_w),
{out} AS (SELECT 'chunk-' || substr(sha256('{{"document_id":"' || document_id || '","chunker":"{name}","byte_start":' || byte_start || ',"byte_end":' || (byte_start + strlen(text)) || ',"text_digest":"' || sha256(text) || '"}}'), 1, 16) AS id,
    document_id, ordinal, byte_start, cast(byte_start + strlen(text) AS bigint) AS byte_end, text, sha256(text) AS content_digest FROM {out}_t)"""


#: Conversations as documents, and their sections: lines are read one after the other with the fence that is open.
TALKS = """talks AS (SELECT cast(conv_id AS varchar) AS document_id, '# Conversation ' || conv_id || chr(10) || string_agg('## ' || coalesce(role, '') || chr(10) || coalesce(text, ''), chr(10) ORDER BY turn) AS whole FROM conversations GROUP BY conv_id),
split AS (SELECT document_id, whole, string_split(whole, chr(10)) AS lines FROM talks),
fences AS (SELECT document_id, whole, lines, 0 AS i, 0 AS pos, '' AS open, false AS head FROM split
  UNION ALL SELECT document_id, whole, lines, i + 1, pos + length(lines[i + 1]) + 1,
    CASE WHEN open = '' THEN f ELSE CASE WHEN f <> '' AND f[1] = open[1] AND length(f) >= length(open) AND trim(substring(regexp_replace(line, '^ {0,3}', ''), length(f) + 1), ' ' || chr(9)) = '' THEN '' ELSE open END END,
    open = '' AND f = '' AND pos > 0 AND regexp_matches(line, '^ {0,3}#{1,6}([ \t]|$)')
  FROM (SELECT *, regexp_extract(line, '^ {0,3}(`{3,}|~{3,})', 1) AS f FROM (SELECT *, regexp_replace(lines[i + 1], '\r$', '') AS line FROM fences WHERE i < len(lines)))),
starts AS (SELECT document_id, whole, 0 AS begin FROM talks UNION ALL SELECT document_id, whole, pos - length(lines[i]) - 1 FROM fences WHERE head),
parts AS (SELECT document_id, whole, begin AS section, begin, coalesce(lead(begin) OVER (PARTITION BY document_id ORDER BY begin), length(whole)) AS stop FROM starts)"""


LARGE = chunk_cte("large", 1200, 120)
SMALL = chunk_cte("small", 300, 0)
TERMS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def terms(x: str) -> str:
    return TERMS.format(x)


def rep_id(chunk: str, digest: str) -> str:
    return f"""'rep-' || substr(sha256('{{"chunk_id":"' || {chunk} || '","content_digest":"' || {digest} || '","kind":"raw"}}'), 1, 16)"""


def derived_id(chunk: str, digest: str, kind: str, text: str) -> str:
    return f"""'rep-' || substr(sha256('{{"chunk_id":"' || {chunk} || '","content_digest":"' || {digest} || '","kind":"{kind}","text_digest":"' || sha256({text}) || '"}}'), 1, 16)"""


RECORDS = f"records AS (SELECT {rep_id('id', 'content_digest')} AS representation_id, id AS chunk_id, document_id, text, content_digest FROM large)"
ASKED = "asked AS (SELECT cast(item_id AS varchar) AS query_id, text FROM benchmark)"

KEYWORDS = f"asked AS (SELECT cast(item_id AS varchar) AS query_id, array_to_string(list_transform(list_sort(list_transform(list_distinct({terms('text')}), lambda y: lpad(cast(1000 - length(y) AS varchar), 4, '0') || y))[1:4], lambda z: substr(z, 5)), ' ') AS text FROM benchmark)"


def bm25_cte(records: str = "records", text: str = "text", out: str = "scored") -> str:
    return f"""{out}_tok AS (SELECT representation_id, chunk_id, document_id, {terms(text)} AS terms FROM {records}),
{out}_tot AS (SELECT cast(count(*) AS double) AS n, avg(len(terms)) AS avg_len FROM {out}_tok),
{out}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({terms('text')}) AS term FROM asked) GROUP BY ALL),
{out}_post AS (SELECT representation_id, chunk_id, document_id, dl, term, cast(count(*) AS double) AS tf FROM (SELECT representation_id, chunk_id, document_id, len(terms) AS dl, unnest(terms) AS term FROM {out}_tok) GROUP BY ALL),
{out}_df AS (SELECT term, cast(count(*) AS double) AS df FROM {out}_post GROUP BY term),
{out} AS (SELECT query_id, representation_id, chunk_id, document_id,
    sum(qtf * ln(1 + (n - df + 5e-1) / (df + 5e-1)) * tf * 2.2e0 / (tf + 1.2e0 * (2.5e-1 + CASE WHEN avg_len > 0 THEN 7.5e-1 * dl / avg_len ELSE 0 END))) AS score
  FROM {out}_post JOIN {out}_df USING (term) JOIN {out}_q USING (term), {out}_tot GROUP BY ALL)"""


def top_cte(source: str, out: str, k: int) -> str:
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, document_id, chunk_id, representation_id) AS rank FROM {source}) WHERE rank <= {k})"""


BM25 = f"{DOCS}, {LARGE}, {RECORDS}, {ASKED}, {bm25_cte()}"


def hits(k: int) -> str:
    return f"{BM25}, {top_cte('scored', 'hits', k)}"


COLLAPSED = """best AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY rank, chunk_id, representation_id) AS n FROM hits),
collapsed AS (SELECT * EXCLUDE (rank, n), row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id, representation_id) AS rank FROM best WHERE n = 1)"""

TRIM = "regexp_replace({0}, '^[\\s\\x{{85}}\\x{{a0}}]+|[\\s\\x{{85}}\\x{{a0}}]+$', '', 'g')"
WORD_LEAD = TRIM.format("text")
SUMMARY = f"""(SELECT id, content_digest, document_id, CASE WHEN regexp_extract(t, '(?s)^(.[^.?!\\n]{{0,298}}[.?!\\n])', 1) <> '' THEN regexp_extract(t, '(?s)^(.[^.?!\\n]{{0,298}}[.?!\\n])', 1)
   WHEN length(t) <= 300 THEN t ELSE substring(t, 1, 299) || '…' END AS s FROM (SELECT *, {WORD_LEAD} AS t FROM large))"""
SUMMARIES = f"summaries AS (SELECT id AS chunk_id, content_digest, document_id, {TRIM.format('s')} AS text FROM {SUMMARY} WHERE {TRIM.format('s')} <> '')"


def embed_cte(source: str, key: str, out: str, dims: int) -> str:
    slot = f"cast(('0x' || substr(sha256(term), 1, 16))::ubigint % {dims} AS bigint)"
    sign = "CASE WHEN ('0x' || substr(sha256(term), 16, 1))::ubigint % 2 = 0 THEN 1e0 ELSE -1e0 END"
    return f"""{out}_t AS (SELECT {key} AS key, unnest({terms('text')}) AS term FROM {source}),
{out}_s AS (SELECT key, {slot} AS d, sum({sign}) AS s FROM {out}_t GROUP BY ALL),
{out}_n AS (SELECT key, sqrt(sum(s * s)) AS norm FROM {out}_s GROUP BY key),
{out} AS (SELECT {out}_s.key, d, cast(CASE WHEN norm = 0 THEN 0 ELSE s / norm END AS float) AS x FROM {out}_s JOIN {out}_n ON {out}_s.key = {out}_n.key)"""


VECTORS = """vec AS (SELECT cast(vec_id AS varchar) AS id, embedding, label, vec_id FROM embeddings),
pairs AS (SELECT q.id AS query_id, v.id AS representation_id, v.id AS chunk_id, v.id AS document_id, q.label AS query_label, v.label AS label,
  list_cosine_similarity(q.embedding::double[], v.embedding::double[]) AS score FROM vec q, vec v WHERE q.vec_id % 100 = 0)"""

GAIN = "(pow(2e0, {g} - {m}) * (1 - exp(-({g}) * ln(2e0))) / log2({i} + 2))"

MEASURED = f"""measured_o AS (SELECT *, length(text) AS runes, CASE WHEN lag(ordinal) OVER w = ordinal - 1 THEN lag(byte_end) OVER w END AS before FROM large WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)),
measured_r AS (SELECT *, before IS NOT NULL AS has_predecessor, cast(coalesce(greatest(before - byte_start, 0), 0) AS bigint) AS overlap_bytes,
  len(regexp_extract_all(text, '\\d{{3}}[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}')) >= 3 OR contains(text, '[wpforms id=') OR regexp_matches(text, '(?i)\\A\\s*login\\s*\\z') OR regexp_matches(text, 'stock_status:\\s*\\w') AS furniture FROM measured_o),
measured AS (SELECT *, list_filter([CASE WHEN runes >= 1190 THEN 'at-limit' END, CASE WHEN runes < 300 THEN 'short' END,
  CASE WHEN has_predecessor AND overlap_bytes = 0 THEN 'no-overlap' END, CASE WHEN runes < 300 AND has_predecessor AND overlap_bytes = 0 THEN 'heading-cut' END,
  CASE WHEN furniture THEN 'furniture' END], lambda x: x IS NOT NULL) AS signals FROM measured_r)"""

METRICS = f"""{VECTORS}, {top_cte('pairs', 'hits', 20)},
rel AS (SELECT query_id, count(*) FILTER (query_label = label) AS relevant FROM pairs GROUP BY query_id),
ks AS (SELECT unnest([1, 5, 10]) AS k),
found AS (SELECT query_id, k, count(*) FILTER (query_label = label AND rank <= k) AS h, sum(CASE WHEN query_label = label AND rank <= k THEN {GAIN.format(g='1e0', m='1e0', i='(rank - 1)')} ELSE 0 END) AS g,
  min(CASE WHEN query_label = label THEN rank END) AS first FROM hits, ks GROUP BY ALL),
ideal AS (SELECT query_id, k, sum({GAIN.format(g='1e0', m='1e0', i='i')}) AS ig FROM (SELECT query_id, k, unnest(range(0, least(k, relevant))) AS i FROM rel, ks) GROUP BY ALL),
metrics AS (SELECT query_id, k, h / cast(k AS double) AS precision, CASE WHEN relevant > 0 THEN h / cast(relevant AS double) ELSE 0 END AS recall, CASE WHEN h > 0 THEN 1e0 ELSE 0e0 END AS hit_rate,
  CASE WHEN ig > 0 THEN g / ig ELSE 0 END AS ndcg, coalesce(1e0 / first, 0) AS mrr FROM found JOIN rel USING (query_id) LEFT JOIN ideal USING (query_id, k))"""

JUDGED = "judged AS (SELECT source AS query_id, CASE WHEN source = 'src3' AND doc_id % 7 = 0 THEN 'chunk' ELSE 'document' END AS target, cast(doc_id AS varchar) AS target_id, cast(quality AS double) AS grade, doc_id AS pos FROM labels JOIN documents USING (doc_id))"


def furniture_sql(column: str) -> str:
    phone = f"len(regexp_extract_all({column}, '\\d{{3}}[-.\\s]\\d{{3}}[-.\\s]\\d{{4}}'))"
    form = f"len(regexp_extract_all({column}, '\\[wpforms id='))"
    login = f"len(regexp_extract_all({column}, '(?i)\\A\\s*login\\s*\\z'))"
    stock = f"len(regexp_extract_all({column}, 'stock_status:\\s*\\w'))"
    name = f"CASE WHEN {phone} >= 3 THEN 'address directory' WHEN {form} >= 1 THEN 'contact form' WHEN {login} >= 1 THEN 'navigation' WHEN {stock} >= 1 THEN 'product data' END"
    n = f"CASE WHEN {phone} >= 3 THEN {phone} WHEN {form} >= 1 THEN {form} WHEN {login} >= 1 THEN {login} WHEN {stock} >= 1 THEN {stock} END"
    return f"{name} AS pattern, cast({n} AS bigint) AS matches"


KIND_FILTER = f"""WITH {DOCS}, {LARGE}, {SUMMARIES}, {ASKED},
records AS (SELECT DISTINCT {rep_id('id', 'content_digest')} AS representation_id, id AS chunk_id, document_id, text, 'raw' AS kind FROM large UNION ALL SELECT DISTINCT {derived_id('chunk_id', 'content_digest', 'summary', 'text')}, chunk_id, document_id, text, 'summary' FROM summaries),
{bm25_cte()}, kept AS (SELECT scored.* FROM scored JOIN records r USING (representation_id) WHERE r.kind = 'summary'), {top_cte('kept', 'hits', 10)} SELECT query_id, representation_id, rank, round(score, 6) AS score FROM hits"""


SCORED_RERANK = f"WITH {hits(20)}, sized AS (SELECT hits.query_id, hits.chunk_id, rank AS old, length(large.text) AS n FROM hits JOIN large ON large.id = hits.chunk_id) SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, old) AS rank, cast(n AS bigint) AS n FROM sized) WHERE rank <= 10"


#: The first 20 hits of both channels: hits and vhits.
BOTH = f"""{hits(20)}, {embed_cte('large', 'id', 'ce', 64)}, {embed_cte('asked', 'query_id', 'qe', 64)},
cn AS (SELECT key, sqrt(sum(x::double * x::double)) AS n FROM ce GROUP BY key), qn AS (SELECT key, sqrt(sum(x::double * x::double)) AS n FROM qe GROUP BY key),
dots AS (SELECT qe.key AS query_id, ce.key AS chunk_id, sum(qe.x::double * ce.x::double) AS s FROM qe JOIN ce USING (d) GROUP BY ALL),
vec_scored AS (SELECT a.query_id, r.representation_id, r.chunk_id, r.document_id, coalesce(CASE WHEN qn.n * cn.n = 0 THEN 0 ELSE dots.s / (qn.n * cn.n) END, 0) AS score
  FROM asked a CROSS JOIN records r LEFT JOIN dots ON dots.query_id = a.query_id AND dots.chunk_id = r.chunk_id LEFT JOIN qn ON qn.key = a.query_id LEFT JOIN cn ON cn.key = r.chunk_id),
{top_cte('vec_scored', 'vhits', 20)}"""


def fused_sql(times: int) -> str:
    """Fusion of both channels, each of which is listed so many times."""
    return f"""WITH {BOTH}, parts AS (SELECT query_id, chunk_id, document_id, 1e0 / (60 + rank) AS value FROM hits, range({times}) UNION ALL SELECT query_id, chunk_id, document_id, 5e-1 / (60 + rank) FROM vhits, range({times})),
fused AS (SELECT query_id, chunk_id, min(document_id) AS document_id, sum(value) AS score FROM parts GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, chunk_id) AS rank, round(score, 9) AS score FROM fused) WHERE rank <= 10"""


def queries() -> dict[str, str]:
    with_ = lambda *parts: "WITH " + ", ".join(parts) + " "
    collapse = "list_filter(list_transform(regexp_split_to_array(text, '[\\r\\n]+'), lambda y: " + TRIM.format("y") + "), lambda x: x <> '' AND NOT starts_with(x, '```'))"
    return {
        "tokenize_terms": f"SELECT doc_id, cast(len({terms('text')}) AS bigint) AS n_terms, cast(len(list_distinct({terms('text')})) AS bigint) AS n_distinct, sha256(array_to_string({terms('text')}, ' ')) AS terms_sha256 FROM documents",
        "content_digest": "SELECT cast(doc_id AS varchar) AS id, sha256(text) AS content_digest FROM documents",
        "text_shapes": f"SELECT doc_id, cast(length(text) AS bigint) AS runes, cast(strlen(text) AS bigint) AS bytes, substring(text, 1, 20) AS lead, sha256(array_to_string({collapse}, '; ')) AS collapsed_sha256 FROM documents",
        "fixed_chunks": with_(DOCS, LARGE) + "SELECT id, document_id, ordinal, byte_start, byte_end, content_digest FROM large",
        "range_chunks": with_(DOCS, SMALL, "kept AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY byte_start) - 1 AS ordinal, byte_start, byte_end, content_digest FROM small)")
        + """SELECT 'chunk-' || substr(sha256('{"document_id":"' || document_id || '","chunker":"ranges","byte_start":' || byte_start || ',"byte_end":' || byte_end || ',"text_digest":"' || content_digest || '"}'), 1, 16) AS id, document_id, ordinal, byte_start, content_digest FROM kept""",
        "raw_representations": with_(DOCS, LARGE) + f"SELECT {rep_id('id', 'content_digest')} AS id, id AS chunk_id, 'raw' AS kind, content_digest FROM large",
        "lead_summaries": with_(DOCS, LARGE, SUMMARIES) + f"SELECT {derived_id('chunk_id', 'content_digest', 'summary', 'text')} AS id, chunk_id, 'summary' AS kind, text FROM summaries",
        "small_to_big": with_(DOCS, LARGE, SMALL, """best AS (SELECT s.id, s.document_id, s.ordinal, p.id AS parent_id, row_number() OVER (PARTITION BY s.id ORDER BY least(s.byte_end, p.byte_end) - greatest(s.byte_start, p.byte_start) DESC, p.ordinal, p.byte_start, p.byte_end, p.id) AS n
  FROM small s JOIN large p ON s.document_id = p.document_id AND least(s.byte_end, p.byte_end) > greatest(s.byte_start, p.byte_start))""") + "SELECT id, document_id, ordinal, parent_id FROM best WHERE n = 1",
        "compose_dedupe": with_(DOCS, LARGE, SUMMARIES) + f"SELECT kind, count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT DISTINCT {rep_id('id', 'content_digest')} AS id, 'raw' AS kind FROM large UNION ALL SELECT DISTINCT {derived_id('chunk_id', 'content_digest', 'summary', 'text')}, 'summary' FROM summaries) GROUP BY kind",
        "ensure_raw": with_(DOCS, LARGE) + f"SELECT {rep_id('id', 'content_digest')} AS id, id AS chunk_id, 'raw' AS kind FROM large",
        "first_chunk": with_(DOCS, LARGE) + "SELECT document_id, id AS chunk_id, ordinal FROM large WHERE ordinal = 0",
        "batch_groups": with_(DOCS, SMALL) + "SELECT id, ordinal // 12 AS group_no, ordinal % 12 + 1 AS place FROM small",
        "hash_embedding": with_(DOCS, embed_cte("docs", "id", "emb", 16), f"ids AS (SELECT id, cast(len({terms('text')}) AS bigint) AS n_terms FROM docs)", "dims AS (SELECT unnest(range(0, 16)) AS d)")
        + "SELECT ids.id, n_terms, dims.d, round(cast(coalesce(x, 0) AS double), 5) AS x FROM ids CROSS JOIN dims LEFT JOIN emb ON emb.key = ids.id AND emb.d = dims.d",
        "bm25_topk": f"""WITH {BM25}, best AS (SELECT *, row_number() OVER (PARTITION BY query_id, document_id ORDER BY round(score, 9) DESC, chunk_id, representation_id) AS n FROM scored),
firsts AS (SELECT * FROM best WHERE n = 1), {top_cte('firsts', 'hits', 10)} SELECT query_id, document_id, chunk_id, rank, round(score, 6) AS score FROM hits""",
        "two_field_bm25": f"""WITH {DOCS}, {LARGE}, {RECORDS}, titled AS (SELECT *, substring(text, 1, 60) AS title FROM records), {ASKED}, {bm25_cte('titled', 'title', 'by_title')}, {bm25_cte('titled', 'text', 'by_body')},
both_f AS (SELECT query_id, representation_id, chunk_id, document_id, sum(score) AS score FROM (SELECT query_id, representation_id, chunk_id, document_id, 2e0 * score AS score FROM by_title UNION ALL SELECT query_id, representation_id, chunk_id, document_id, score FROM by_body) GROUP BY ALL),
{top_cte('both_f', 'hits', 10)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits""",
        "exact_cosine_topk": f"WITH {VECTORS}, {top_cte('pairs', 'hits', 10)} SELECT query_id, representation_id, rank, round(score, 6) AS score FROM hits",
        "vector_identity": "SELECT 'given' AS model, cast(len(embedding) AS bigint) AS dims, count(*) AS n FROM embeddings GROUP BY ALL",
        "vector_norms": "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))), 5) AS norm, true AS finite FROM embeddings",
        "collapse_document": f"WITH {hits(30)}, {COLLAPSED} SELECT query_id, document_id, chunk_id, rank FROM collapsed",
        "rrf_fusion": f"""WITH {BOTH}, parts AS (SELECT query_id, chunk_id, document_id, 1e0 / (60 + rank) AS value FROM hits UNION ALL SELECT query_id, chunk_id, document_id, 5e-1 / (60 + rank) FROM vhits),
fused AS (SELECT query_id, chunk_id, min(document_id) AS document_id, sum(value) AS score, count(*) AS n_channels FROM parts GROUP BY ALL)
SELECT * FROM (SELECT query_id, chunk_id, document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, chunk_id) AS rank, round(score, 9) AS score, n_channels FROM fused) WHERE rank <= 10""",
        "hyde_topk": fused_sql(1),
        "multi_query_topk": fused_sql(3),
        "written_representations": with_(DOCS, LARGE, "told AS (SELECT id, text, substr(content_digest, 1, 6) AS x FROM large)")
        + """SELECT id AS chunk_id, 'question' AS kind, sha256(unnest(['What of ' || x || '?', 'Why ' || x || '?'])) AS text_sha256 FROM told
UNION ALL SELECT id, 'entities', sha256(unnest(list_distinct([x, reverse(x)]))) FROM told
UNION ALL SELECT id, 'statement', sha256(x || ' is so.; and so on') FROM told
UNION ALL SELECT id, 'contextual', sha256({0}) FROM told""".format(TRIM.format("'Part of it.' || chr(10) || text")),
        "hydrate": f"WITH {hits(5)} SELECT query_id, hits.chunk_id, rank, large.content_digest FROM hits JOIN large ON large.id = hits.chunk_id",
        "kind_filter_topk": KIND_FILTER,
        "kind_index_topk": KIND_FILTER,
        "role_filter_topk": f"WITH {hits(50)}, kept AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM hits JOIN docs ON docs.id = hits.document_id WHERE docs.source IN ('src0', 'src1', 'src2')) SELECT * FROM kept WHERE rank <= 5",
        "term_overlap_rerank": f"""WITH {hits(20)}, over AS (SELECT hits.query_id, hits.chunk_id, rank AS old, len(list_intersect(list_distinct({terms('large.text')}), list_distinct({terms('asked.text')}))) AS overlap FROM hits JOIN large ON large.id = hits.chunk_id JOIN asked ON asked.query_id = hits.query_id),
ranked AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, old) AS rank, cast(overlap AS bigint) AS overlap FROM over) SELECT * FROM ranked WHERE rank <= 10""",
        "context_pack": f"""WITH RECURSIVE {hits(10)}, ev AS (SELECT hits.query_id, rank, hits.chunk_id, length(large.text) AS n FROM hits JOIN large ON large.id = hits.chunk_id),
fold AS (SELECT query_id, cast(0 AS bigint) AS step, cast([] AS varchar[]) AS adm, cast(0 AS bigint) AS om, cast(0 AS bigint) AS used FROM (SELECT DISTINCT query_id FROM ev)
  UNION ALL SELECT f.query_id, f.step + 1, CASE WHEN len(f.adm) >= 5 OR f.used + e.n > 3000 THEN f.adm ELSE list_append(f.adm, e.chunk_id) END, f.om + CASE WHEN len(f.adm) >= 5 OR f.used + e.n > 3000 THEN 1 ELSE 0 END,
    f.used + CASE WHEN len(f.adm) >= 5 OR f.used + e.n > 3000 THEN 0 ELSE e.n END FROM fold f JOIN ev e ON e.query_id = f.query_id AND e.rank = f.step + 1)
SELECT query_id, cast(len(adm) AS bigint) AS n_admitted, om AS n_omitted, used, array_to_string(adm, ',') AS admitted FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY step DESC) AS z FROM fold) WHERE z = 1""",
        "extractive_answers": f"""WITH {hits(2)}, lines AS (SELECT hits.query_id, rank, hits.chunk_id, '[' || hits.chunk_id || '] ' || {TRIM.format('large.text')} AS line FROM hits JOIN large ON large.id = hits.chunk_id),
ans AS (SELECT query_id, string_agg(line, chr(10) || chr(10) ORDER BY rank) AS answer, string_agg(chunk_id, ',' ORDER BY rank) AS cites FROM lines GROUP BY query_id)
SELECT asked.query_id, sha256(coalesce(answer, 'I do not have enough evidence.')) AS answer_sha256, coalesce(cites, '') AS citations, CASE WHEN answer IS NULL THEN 'abstain' ELSE 'stop' END AS finish_reason,
  CASE WHEN answer IS NOT NULL THEN cast(strlen(text) // 4 AS bigint) END AS input_tokens, cast(strlen(answer) // 4 AS bigint) AS output_tokens FROM asked LEFT JOIN ans USING (query_id)""",
        "retrieval_metrics": f"WITH {METRICS} SELECT query_id, cast(k AS bigint) AS k, round(precision, 6) AS precision, round(recall, 6) AS recall, round(hit_rate, 6) AS hit_rate, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr FROM metrics",
        "metrics_macro": f"WITH {METRICS} SELECT cast(k AS bigint) AS k, count(*) AS evaluated, round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(hit_rate), 6) AS hit_rate, round(avg(ndcg), 6) AS ndcg, round(avg(mrr), 6) AS mrr FROM metrics GROUP BY k",
        "mixed_targets": f"WITH {JUDGED} SELECT query_id FROM judged GROUP BY query_id HAVING count(DISTINCT target) > 1",
        "target_levels": f"WITH {JUDGED} SELECT query_id, arg_min(target, pos) AS target, count(*) AS n_judgments, count(*) FILTER (grade > 0) AS n_relevant, count(DISTINCT target) > 1 AS mixed FROM judged GROUP BY query_id",
        "judgment_violations": f"""WITH {JUDGED}, bad AS (SELECT *, grade - CASE WHEN pos % 50 = 0 THEN 2 ELSE 0 END AS g FROM judged)
SELECT 'judgment' AS entity, problem, count(*) AS n FROM (SELECT 'bad grade' AS problem FROM bad WHERE g < 0 UNION ALL SELECT 'mixed targets' FROM bad GROUP BY query_id HAVING count(DISTINCT target) > 1) GROUP BY problem""",
        "chunk_overlap": with_(DOCS, LARGE, MEASURED) + "SELECT id, cast(runes AS bigint) AS runes, has_predecessor, overlap_bytes FROM measured",
        "chunk_signals": with_(DOCS, LARGE, MEASURED) + "SELECT id, array_to_string(signals, ',') AS signals FROM measured",
        "furniture": f"SELECT * FROM (SELECT 'page' AS kind, page_id AS id, {furniture_sql('html')} FROM pages UNION ALL SELECT 'document', doc_id, {furniture_sql('text')} FROM documents) WHERE pattern IS NOT NULL",
        "size_histogram": with_(DOCS, LARGE, "bars AS (SELECT * FROM (VALUES (0, 0, 99), (1, 100, 199), (2, 200, 399), (3, 400, 599), (4, 600, 799), (5, 800, 999), (6, 1000, 1189), (7, 1190, 1200)) b(bucket, low, high))", "tot AS (SELECT count(*) AS total FROM large)")
        + "SELECT cast(bucket AS bigint) AS bucket, cast(low AS bigint) AS low, cast(high AS bigint) AS high, count(large.id) AS n, round(count(large.id) / cast(any_value(total) AS double) * 100, 6) AS share FROM bars LEFT JOIN large ON length(large.text) BETWEEN low AND high CROSS JOIN tot GROUP BY ALL",
        "size_percentiles": with_(DOCS, LARGE, "sized AS (SELECT length(text) AS runes, row_number() OVER (ORDER BY length(text)) AS r, count(*) OVER () AS total FROM large)")
        + "SELECT cast(p AS bigint) AS percentile, cast(runes AS bigint) AS runes FROM sized, (SELECT unnest([25, 50, 75, 95]) AS p) WHERE r = (p * total + 99) // 100",
        "signal_summary": with_(DOCS, LARGE, MEASURED, "ex AS (SELECT document_id, unnest(signals) AS signal FROM measured)", "names AS (SELECT unnest(['at-limit', 'short', 'no-overlap', 'heading-cut', 'furniture']) AS signal)")
        + "SELECT names.signal, count(ex.document_id) AS chunks, count(DISTINCT ex.document_id) AS documents FROM names LEFT JOIN ex ON ex.signal = names.signal GROUP BY names.signal",
        "signals_by_document": with_(DOCS, LARGE, MEASURED, "flat AS (SELECT document_id, unnest(signals) AS s FROM measured)", "names AS (SELECT unnest(['at-limit', 'short', 'no-overlap', 'heading-cut', 'furniture']) AS s, unnest(range(5)) AS o)",
            "agg AS (SELECT document_id, string_agg(s, ',' ORDER BY o) AS signals FROM (SELECT DISTINCT document_id, s, o FROM flat JOIN names USING (s)) GROUP BY document_id)",
            "pats AS (SELECT document_id, ordinal, CASE WHEN len(regexp_extract_all(text, '\\d{3}[-.\\s]\\d{3}[-.\\s]\\d{4}')) >= 3 THEN 'address directory' WHEN contains(text, '[wpforms id=') THEN 'contact form' WHEN regexp_matches(text, '(?i)\\A\\s*login\\s*\\z') THEN 'navigation' ELSE 'product data' END AS p FROM measured WHERE furniture)",
            "pagg AS (SELECT document_id, string_agg(p, ',' ORDER BY o) AS patterns FROM (SELECT document_id, p, min(ordinal) AS o FROM pats GROUP BY ALL) GROUP BY document_id)")
        + "SELECT d.document_id, coalesce(agg.signals, '') AS signals, coalesce(pagg.patterns, '') AS patterns FROM (SELECT DISTINCT document_id FROM large) d LEFT JOIN agg USING (document_id) LEFT JOIN pagg USING (document_id)",
        "evidence_identities": f"WITH {hits(3)} SELECT query_id, string_agg(hits.chunk_id || ':' || large.content_digest, ',' ORDER BY rank) AS evidence FROM hits JOIN large ON large.id = hits.chunk_id GROUP BY query_id",
        "unit_targets": f"WITH {hits(10)} SELECT query_id, chunk_id, rank, CASE WHEN docs.lang = 'en' THEN docs.source ELSE document_id END AS target_id FROM hits JOIN docs ON docs.id = hits.document_id",
        "candidate_metadata": with_(DOCS, LARGE) + "SELECT large.id AS chunk_id, document_id, source AS source_role, lang FROM large JOIN docs ON docs.id = large.document_id",
        "prefixed_fusion": f"""WITH {hits(20)}, parts AS (SELECT query_id, chunk_id, 2e0 / (60 + rank) AS value FROM hits UNION ALL SELECT query_id, chunk_id, 2e0 / (60 + rank // 2) FROM hits WHERE rank % 2 = 0),
fused AS (SELECT query_id, chunk_id, sum(value) AS score FROM parts GROUP BY ALL) SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 15) DESC, chunk_id) AS rank, round(score, 9) AS score FROM fused""",
        "ordinal_labels": f"WITH {hits(4)} SELECT query_id, chunk_id, 'E' || rank AS label FROM hits",
        "answer_contract": f"""WITH {hits(2)}, k AS (SELECT cast(query_id AS bigint) % 5 AS k FROM (SELECT DISTINCT query_id FROM hits))
SELECT k IN (0, 2) AS valid, k <> 0 AS abstained, CASE WHEN k IN (1, 3) THEN 'contract' WHEN k = 4 THEN 'parse' END AS failure_category, count(*) AS n FROM k GROUP BY ALL""",
        "document_summaries": with_(DOCS, LARGE, f"sums AS (SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(substring(text, 1, 80), '[\\r\\n]+'), lambda y: {TRIM.format('y')}), lambda x: x <> '' AND NOT starts_with(x, '```')), '; ') AS text FROM docs)")
        + f"SELECT {derived_id('large.id', 'content_digest', 'document-summary', 'sums.text')} AS id, large.id AS chunk_id, 'document-summary' AS kind, sums.text FROM large JOIN sums ON sums.id = large.document_id WHERE ordinal = 0 AND sums.text <> ''",
        "line_functions": f"""WITH turns AS (SELECT * FROM conversations WHERE text IS NOT NULL)
SELECT conv_id, turn, array_to_string(list_filter(list_transform(list_transform(string_split(text, chr(10)), lambda y: regexp_replace({TRIM.format('y')}, '^[-*• \t]+', '')), lambda z: regexp_replace(z, '^[0-9]+[.)][ \t]*', '')), lambda x: x <> '' AND NOT starts_with(x, '```')), '|') AS questions,
  coalesce(substring(regexp_replace({TRIM.format("list_filter(string_split(text, chr(10)), lambda y: " + TRIM.format('y') + " <> '')[1]")}, '[\\s]+', ' ', 'g'), 1, 80), '') AS excerpt FROM turns""",
        "representation_violations": with_(DOCS, LARGE) + """SELECT 'representation' AS entity, problem, count(*) AS n FROM (SELECT 'digest differs' AS problem FROM large WHERE length(text) % 5 = 1 UNION ALL SELECT 'raw text differs' FROM large WHERE length(text) % 5 = 1 UNION ALL SELECT 'unknown chunk' FROM large WHERE length(text) % 5 = 2) GROUP BY problem""",
        "normalized_vectors": "SELECT vec_id, round(cast(cast(cast(embedding[1] * 3 AS float)::double / sqrt(list_sum(list_transform(embedding, lambda x: cast(x * 3 AS float)::double * cast(x * 3 AS float)::double))) AS float) AS double), 5) AS first, 1e0 AS norm FROM embeddings",
        "document_rollup": with_(DOCS, LARGE) + "SELECT document_id, document_id AS name, count(*) AS chunks, cast(sum(length(text)) AS bigint) AS total_runes, cast(min(length(text)) AS bigint) AS min_runes, cast(max(length(text)) AS bigint) AS max_runes, min(ordinal) AS first_ordinal, max(ordinal) AS last_ordinal FROM large GROUP BY document_id",
        "corpus_violations": with_(DOCS, LARGE) + """SELECT entity, problem, count(*) AS n FROM (
  SELECT 'document' AS entity, 'digest differs' AS problem FROM docs WHERE doc_id % 97 = 0 AND doc_id % 101 <> 0
  UNION ALL SELECT 'chunk', 'unknown document' FROM large WHERE cast(document_id AS bigint) % 101 = 0
  UNION ALL SELECT 'chunk', 'length differs' FROM large WHERE cast(document_id AS bigint) % 89 = 0 AND ordinal = 0
  UNION ALL SELECT 'chunk', CASE WHEN byte_end + 1 > strlen(docs.text) THEN 'range out of bounds' ELSE 'not an exact slice' END FROM large JOIN docs ON docs.id = large.document_id WHERE doc_id % 89 = 0 AND ordinal = 0 AND doc_id % 101 <> 0) GROUP BY ALL""",
        "usage_sum": "SELECT event_type, cast(sum(CASE WHEN event_type <> 'view' THEN cast(floor(value) AS bigint) END) AS bigint) AS input_tokens, cast(sum(CASE WHEN event_id % 2 = 0 THEN cast(floor(value) AS bigint) END) AS bigint) AS output_tokens FROM events GROUP BY event_type",
        "transient_errors": """SELECT class, count(*) AS n FROM (SELECT CASE WHEN event_id % 4 = 0 THEN (CASE WHEN [200, 404, 408, 429, 500, 599, 600][event_id % 7 + 1] IN (408, 429, 500, 599) THEN 'transient' ELSE 'fatal' END)
  ELSE (CASE WHEN event_id % 6 IN (0, 1, 4) THEN 'transient' ELSE 'fatal' END) END AS class FROM events) GROUP BY class""",
        "query_contract": """SELECT problem, count(*) AS n FROM (SELECT 'blank' AS problem FROM benchmark WHERE item_id % 9 = 0 UNION ALL SELECT 'blank' FROM benchmark WHERE item_id % 10 = 0 AND item_id % 9 = 0 UNION ALL SELECT 'repeated' FROM benchmark WHERE item_id % 10 = 0) GROUP BY problem""",
        "neighbours_in_document": with_(DOCS, LARGE) + "SELECT id, lag(id) OVER w AS before, lead(id) OVER w AS after FROM large WINDOW w AS (PARTITION BY document_id ORDER BY ordinal)",
        "grouped_generation": with_(DOCS, LARGE) + "SELECT id AS chunk_id, 'summary' AS kind, CASE WHEN (ordinal % 12 + 1) % 3 = 0 THEN 'own' ELSE 'group ' || (ordinal % 12 + 1) END AS text FROM large",
        "tied_vectors": f"""WITH vec AS (SELECT cast(vec_id AS varchar) AS id, vec_id, list_transform(embedding[1:4], lambda x: CASE WHEN x >= 0 THEN 1e0 ELSE -1e0 END) AS v FROM embeddings),
pairs AS (SELECT q.id AS query_id, v.id AS representation_id, v.id AS chunk_id, v.id AS document_id, list_dot_product(q.v, v.v) / 4 AS score FROM vec q, vec v WHERE q.vec_id % 100 = 0),
{top_cte('pairs', 'hits', 10)} SELECT query_id, representation_id, rank, round(score, 6) AS score FROM hits""",
        "stored_index_topk": f"WITH {hits(10)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits",
        "forward_index_topk": f"WITH {hits(10)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits",
        "search_bundle_topk": f"WITH {DOCS}, {LARGE}, {RECORDS}, {KEYWORDS}, {bm25_cte()}, {top_cte('scored', 'hits', 10)} SELECT query_id, hits.chunk_id, rank, content_digest FROM hits JOIN large ON large.id = hits.chunk_id",
        # each quote at its first occurrence behind the last one's; blank quotes and those of nothing match nothing
        "quoted_cuts": f"""WITH RECURSIVE {DOCS}, base AS (SELECT id, text, cast((length(text) - 1) // 500 AS bigint) AS last FROM docs WHERE text IS NOT NULL AND text <> ''),
walk AS (SELECT id, text, last, cast(0 AS bigint) AS i, cast(0 AS bigint) AS pos, false AS hit FROM base
  UNION ALL SELECT id, text, last, i + 1, CASE WHEN p > 0 THEN pos + p ELSE pos END, p > 0 FROM (SELECT *, CASE WHEN regexp_full_match(m, '\\s*') THEN 0 ELSE strpos(substring(text, pos + 1), m) END AS p FROM (SELECT *, substring(text, i * 500 + 1, 24) AS m FROM walk WHERE i <= last))),
cuts AS (SELECT DISTINCT id, strlen(substring(text, 1, pos - 1)) AS cut FROM walk WHERE hit),
ends AS (SELECT id, count(*) FILTER (cut > 0) + 1 AS chunks, coalesce(sum(cut) FILTER (cut > 0), 0) AS ends FROM cuts GROUP BY id)
SELECT id AS document_id, last + 1 + (last + 1) // 3 AS quotes, (SELECT count(*) FROM walk w WHERE w.id = base.id AND hit) AS matched, coalesce(chunks, 1) AS chunks, cast(coalesce(ends, 0) + strlen(text) AS bigint) AS ends FROM base LEFT JOIN ends USING (id)""",
        "keyword_topk": f"WITH {DOCS}, {LARGE}, {RECORDS}, {KEYWORDS}, {bm25_cte()}, {top_cte('scored', 'hits', 10)} SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM hits",
        "vector_violations": """WITH base AS (SELECT vec_id, vec_id % 50 = 0 AS bad, vec_id % 61 = 0 AS short, vec_id % 73 = 0 AS other FROM embeddings), doubled AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE vec_id % 97 = 0)
SELECT problem, count(*) AS n FROM (SELECT 'value not finite' AS problem FROM doubled WHERE bad UNION ALL SELECT 'dimensions differ' FROM doubled WHERE short UNION ALL SELECT 'model differs' FROM doubled WHERE other
  UNION ALL SELECT 'repeated' FROM base WHERE vec_id % 97 = 0 UNION ALL SELECT 'unknown representation' FROM doubled WHERE vec_id % 89 = 0) GROUP BY problem""",
        "signal_counts": with_(DOCS, LARGE, MEASURED) + "SELECT document_id, signal, count(*) AS n FROM (SELECT document_id, unnest(signals) AS signal FROM measured) GROUP BY ALL",
        "uncounted_sizes": with_(DOCS, LARGE) + "SELECT count(*) AS uncounted FROM large WHERE NOT (length(text) BETWEEN 0 AND 99 OR length(text) BETWEEN 200 AND 1100)",
        "bundle_inspection": with_(DOCS, LARGE) + "SELECT document_id, document_id AS name, count(*) AS chunks, min(ordinal) AS first, max(ordinal) AS last, 'matches' AS corpus FROM large GROUP BY document_id",
        "ordered_vectors": with_(DOCS, LARGE) + f"SELECT {rep_id('id', 'content_digest')} AS representation_id, 'hash-16' AS model, cast(16 AS bigint) AS dims FROM large",
        "content_lookup": with_(DOCS, LARGE) + "SELECT id, document_id, content_digest FROM large WHERE ordinal = 0",
        "staged_bundle": with_(DOCS, LARGE) + "SELECT 'documents' AS name, count(*) AS n FROM docs WHERE text IS NOT NULL UNION ALL SELECT 'chunks', count(*) FROM large UNION ALL SELECT 'representations', count(*) FROM large",
        "cached_generation": """WITH d AS (SELECT source || lang AS x FROM documents)
SELECT cast(run AS bigint) AS run, n AS rows, CASE WHEN run = 0 THEN 0 ELSE n END AS hits, CASE WHEN run = 0 THEN n ELSE 0 END AS misses, CASE WHEN run = 0 THEN k ELSE 0 END AS writes, CASE WHEN run = 0 THEN (SELECT cast(sum(length(x)) AS bigint) FROM (SELECT DISTINCT x FROM d)) END AS input_tokens FROM (SELECT count(*) AS n, count(DISTINCT x) AS k FROM d), (SELECT unnest([0, 1]) AS run)""",
        "generation_flow": "SELECT doc_id, reverse(upper(source || '-' || lang)) AS output FROM documents",
        "scored_rerank": SCORED_RERANK,
        "called_rerank": SCORED_RERANK,
        "called_generation": "SELECT doc_id, CASE WHEN NOT starts_with(sha256(text), '0') THEN sha256(text) END AS output, CASE WHEN starts_with(sha256(text), '0') THEN 'fatal' END AS failure_class, cast(0 AS bigint) AS called_again FROM documents WHERE text IS NOT NULL",
        "ingested_documents": with_(DOCS, LARGE) + """SELECT 'documents' AS name, count(*) AS n FROM docs WHERE text IS NOT NULL UNION ALL SELECT 'chunks', count(*) FROM large
UNION ALL SELECT 'conflicts', count(*) FROM docs WHERE text IS NOT NULL AND doc_id % 7 = 0
UNION ALL SELECT 'repeats', cast(coalesce(sum(2 - doc_id % 3), 0) AS bigint) FROM docs WHERE text IS NOT NULL AND doc_id % 5 = 0""",
        "evidence_violations": f"""WITH {hits(3)} SELECT problem, count(*) AS n FROM (SELECT 'text differs' AS problem FROM hits WHERE rank = 1 UNION ALL SELECT 'unknown chunk' FROM hits WHERE rank = 2 UNION ALL SELECT 'rank below 1' FROM hits WHERE rank = 3) GROUP BY problem""",
        "embedding_cache": """WITH t AS (SELECT count(*) AS n, count(DISTINCT text) AS k FROM conversations WHERE text IS NOT NULL) SELECT cast(run AS bigint) AS run, n AS rows, CASE WHEN run = 0 THEN 0 ELSE n END AS hits, CASE WHEN run = 0 THEN k ELSE 0 END AS writes FROM t, (SELECT unnest([0, 1]) AS run)""",
        "sentence_snap_chunks": f"WITH RECURSIVE {DOCS}, whole_docs AS (SELECT id AS document_id, text AS whole, 0 AS section, 0 AS begin, length(text) AS stop FROM docs), {snapped_cte('whole_docs', 'snapped', 'fixed-1200-120', 1200, 120, 200)} SELECT id, document_id, ordinal, byte_start, byte_end, content_digest FROM snapped",
        "hit_violations": f"WITH {hits(3)} SELECT CASE rank WHEN 1 THEN 'rank below 1' WHEN 2 THEN 'score not finite' ELSE 'empty id' END AS problem, count(*) AS n FROM hits GROUP BY 1",
        "rerank_violations": f"WITH {hits(5)} SELECT CASE cast(query_id AS bigint) % 3 WHEN 0 THEN 'count differs' WHEN 1 THEN 'foreign chunk' ELSE 'score not finite' END AS problem, count(DISTINCT query_id) AS n FROM hits GROUP BY 1",
        "prepared_violations": f"""WITH {hits(10)}, sized AS (SELECT query_id, cast(query_id AS bigint) % 4 AS turn, count(*) AS n, sum(length(text)) AS runes FROM hits JOIN large ON large.id = hits.chunk_id GROUP BY ALL),
told AS (SELECT unnest(list_filter([CASE WHEN n > 5 THEN 'too many texts' END, CASE WHEN runes > 3000 THEN 'too many code points' END, CASE WHEN turn = 1 AND n > 1 THEN 'repeated label' END, CASE WHEN turn = 0 THEN 'label of another style' END], lambda x: x IS NOT NULL)) AS problem FROM sized)
SELECT problem, count(*) AS n FROM told GROUP BY problem""",
        "judgment_targets": "SELECT cast(item_id AS varchar) AS query_id, CASE WHEN item_id % 5 = 0 THEN 'page' END AS target FROM benchmark WHERE item_id % 5 = 0 OR item_id % 7 = 0",
        # a heading governs until the next one of its level or a lesser one; the first level is left out where it is the title
        "breadcrumbs": f"""WITH RECURSIVE {TALKS}, {snapped_cte('parts', 'cut', 'markdown-400-40', 400, 40, 0)},
heads AS (SELECT a.document_id, strlen(substring(a.whole, 1, a.pos - length(a.lines[a.i]) - 1)) AS at_byte, length(regexp_extract(trim(a.lines[a.i]), '^(#{{1,6}}) ', 1)) AS level, trim(regexp_extract(trim(a.lines[a.i]), '(?s)^#{{1,6}} (.*)$', 1)) AS heading
  FROM fences a JOIN fences b ON b.document_id = a.document_id AND b.i = a.i - 1 WHERE b.open = '' AND NOT regexp_matches(a.lines[a.i], '^ {{0,3}}(`{{3}}|~{{3}})') AND regexp_matches(trim(a.lines[a.i]), '^#{{1,6}} ')),
governs AS (SELECT cut.id, h.level, h.heading FROM cut JOIN heads h ON h.document_id = cut.document_id AND h.at_byte <= cut.byte_start
  WHERE NOT EXISTS (SELECT 1 FROM heads o WHERE o.document_id = h.document_id AND o.at_byte > h.at_byte AND o.at_byte <= cut.byte_start AND o.level <= h.level)),
paths AS (SELECT cut.id, 'Conversation ' || cut.document_id || coalesce(string_agg(' > ' || heading, '' ORDER BY level) FILTER (heading <> '' AND NOT (level = 1 AND heading = 'Conversation ' || cut.document_id)), '') AS path FROM cut LEFT JOIN governs ON governs.id = cut.id GROUP BY cut.id, cut.document_id),
crumbs AS (SELECT cut.id AS chunk_id, content_digest, {TRIM.format("path || chr(10) || text")} AS text FROM cut JOIN paths ON paths.id = cut.id)
SELECT {derived_id('chunk_id', 'content_digest', 'breadcrumb', 'text')} AS id, chunk_id, 'breadcrumb' AS kind, text FROM crumbs""",
        "markdown_chunks": f"WITH RECURSIVE {TALKS}, {snapped_cte('parts', 'cut', 'markdown-400-40', 400, 40, 0)} SELECT id, document_id, ordinal, byte_start, byte_end, content_digest FROM cut",
        "markdown_heading_chunks": f"""WITH RECURSIVE {TALKS}, sized AS (SELECT *, stop - begin >= 120 AS large, count(*) FILTER (stop - begin >= 120) OVER (PARTITION BY document_id) AS n_large FROM parts),
grouped AS (SELECT *, least(coalesce(count(*) FILTER (large) OVER (PARTITION BY document_id ORDER BY begin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), greatest(n_large - 1, 0)) AS g FROM sized),
joined AS (SELECT document_id, whole, min(begin) AS section, min(begin) AS begin, max(stop) AS stop FROM grouped GROUP BY document_id, whole, g),
{snapped_cte('joined', 'cut', 'markdown-heading-600-120-60', 600, 60, 0)} SELECT id, document_id, ordinal, byte_start, byte_end, content_digest FROM cut""",
    }
