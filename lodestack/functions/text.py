"""Text and digest expressions. All are built-in functions; nothing here runs Python on executors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


# terms ------------------------------------------------------------------------------------------
def terms(text: Column | str) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.filter(F.split(F.lower(col(text)), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def term_set(text: Column | str) -> Column:
    return F.array_distinct(terms(text))


# digests ----------------------------------------------------------------------------------------
def digest(text: Column | str) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(col(text), 256)


def canonical_json(value: Column, keep_nulls: bool = False) -> Column:
    """to_json with <, >, & and the two line separators escaped, as identities were first defined."""
    out = F.to_json(value, {"ignoreNullFields": "false" if keep_nulls else "true"})
    for plain, escaped in (("&", "\\u0026"), ("<", "\\u003c"), (">", "\\u003e"), (" ", "\\u2028"), (" ", "\\u2029")):
        out = F.replace(out, F.lit(plain), F.lit(escaped))
    return out


def json_digest(value: Column) -> Column:
    return F.sha2(canonical_json(value), 256)


def truncated_id(prefix: str, value: Column, n_bytes: int = 8) -> Column:
    return F.concat(F.lit(prefix), F.substring(json_digest(value), 1, 2 * n_bytes))


def optional(text: Column | str) -> Column:
    """Null for an empty string: such fields are left out of identities."""
    return F.nullif(col(text), F.lit(""))


def sorted_map(m: Column | str) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(col(m))))


def chunk_id(document_id: Column, chunker: Column, start: Column, end: Column, text_digest: Column) -> Column:
    parts = {"document_id": document_id, "chunker": chunker, "byte_start": start, "byte_end": end, "text_digest": text_digest}
    return truncated_id("chunk-", F.struct(*[v.alias(k) for k, v in parts.items()]))


def raw_representation_id(chunk: Column, text_digest: Column) -> Column:
    return truncated_id("rep-", F.struct(chunk.alias("chunk_id"), text_digest.alias("content_digest"), F.lit("raw").alias("kind")))


def derived_representation_id(chunk: Column, chunk_digest: Column, kind: Column, text_digest: Column, model: Column | None = None, prompt_digest: Column | None = None) -> Column:
    empty = F.lit(None).cast("string")
    fields = {"chunk_id": chunk, "content_digest": chunk_digest, "kind": kind, "text_digest": text_digest}
    fields |= {"model": empty if model is None else optional(model), "prompt_digest": empty if prompt_digest is None else optional(prompt_digest)}
    return truncated_id("rep-", F.struct(*[v.alias(k) for k, v in fields.items()]))


# lengths and slices -----------------------------------------------------------------------------
def runes(text: Column | str) -> Column:
    return F.char_length(col(text))


def lead(text: Column | str, n: int) -> Column:
    """The first n code points."""
    return F.substring(col(text), 1, n)


def byte_slice(text: Column | str, start: Column, end: Column) -> Column:
    """Bytes start to end (exclusive) as text."""
    binary = col(text).cast("binary")
    return F.substring(binary, start + 1, end - start).cast("string")


BLANK = "[\\s\\u0085\\u00a0]"


def trimmed(text: Column | str) -> Column:
    return F.regexp_replace(col(text), f"^{BLANK}+|{BLANK}+$", "")


def collapse_line(text: Column | str) -> Column:
    """Lines joined by "; ", without blank lines and code fences."""
    lines = F.transform(F.split(col(text), "[\\r\\n]+"), trimmed)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("```"))), "; ")


def question_lines(text: Column | str) -> Column:
    """Questions, one a line, without bullets, numbering, blanks and fences."""
    lines = F.transform(F.split(col(text), "\\n"), lambda x: F.regexp_replace(trimmed(x), "^[-*• \\t]+", ""))
    lines = F.transform(lines, lambda x: F.regexp_replace(x, "^[0-9]+[.)][ \\t]*", ""))
    return F.filter(lines, lambda x: (x != "") & ~F.startswith(x, F.lit("```")))


def unique_lines(lines: Column) -> Column:
    """Trimmed lines in first-seen order, without blanks and repeats."""
    return F.array_distinct(F.filter(F.transform(lines, trimmed), lambda x: x != ""))


def excerpt(text: Column | str, n: int = 80) -> Column:
    """The first line that is not blank, blanks collapsed, at most n code points."""
    lines = F.filter(F.split(col(text), "\\n"), lambda x: trimmed(x) != "")
    return F.coalesce(F.substring(F.regexp_replace(trimmed(F.try_element_at(lines, F.lit(1))), f"{BLANK}+", " "), 1, n), F.lit(""))


def lead_sentence(text: Column | str, most: int = 300) -> Column:
    """Up to the first . ? ! or line end after the first code point, within most; else cut with an ellipsis."""
    t = trimmed(text)
    sentence = F.regexp_extract(t, f"(?s)^(.[^.?!\\n]{{0,{max(0, most - 2)}}}[.?!\\n])", 1) if most > 1 else F.lit("")
    cut = F.lit("…") if most == 1 else F.concat(F.substring(t, 1, most - 1), F.lit("…"))
    return F.when(sentence != "", sentence).when(F.char_length(t) <= most, t).otherwise(cut)


def strip_complete_fence(text: Column | str) -> Column:
    """The payload of a complete bare or json code fence, else the text."""
    t = trimmed(text)
    inner = F.regexp_extract(t, "(?s)^```(?:json)?[ \\t]*\\r?\\n(.*)```$", 1)
    return F.when(t.rlike("(?s)^```(?:json)?[ \\t]*\\r?\\n.*```$"), trimmed(inner)).otherwise(col(text))


def strip_code_fence(text: Column | str) -> Column:
    """The payload of a fence of any language around the whole answer, else the text."""
    t = trimmed(text)
    return F.when(t.rlike("(?s)^```[^\\n]*\\n.*```$"), trimmed(F.regexp_extract(t, "(?s)^```[^\\n]*\\n(.*)```$", 1))).otherwise(col(text))


def package_path(module: Column | str, directory: Column | str) -> Column:
    d = col(directory)
    joined = F.concat(F.regexp_replace(col(module), "/$", ""), F.lit("/"), F.regexp_replace(d, "^\\./", ""))
    return F.when((d == ".") | (d == ""), col(module)).otherwise(joined)


def symbol_text(kind: Column, name: Column, qualified: Column, package: Column, signature: Column, repository: Column, path: Column, documentation: Column) -> Column:
    """What a code symbol is searched by, one fact a line."""
    first = F.concat(F.lit("Go "), F.coalesce(optional(kind), F.lit("declaration")), F.lit(" "), F.coalesce(optional(qualified), name), F.lit("."))
    line = lambda label, x, end=".": F.concat(F.lit(label), optional(x), F.lit(end))
    return F.concat_ws("\n", first, line("Package: ", package), line("Signature: ", signature), F.concat(F.lit("Repository: "), repository, F.lit(".")), F.concat(F.lit("Defined in "), path, F.lit(".")), line("Documentation: ", documentation, ""))
