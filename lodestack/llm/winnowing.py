"""Document fingerprints by winnowing, in DataFrame functions only.

Every run of GRAM code points is hashed. Hashes roll: each code point is hashed once, and the hash of a run is
those of its halves, the first one shifted by the length of the second, so that hashes of 2, 4 and 8 code
points follow from each other at all places of the text at once. Of each WINDOW hashes in a row the least is chosen, the
rightmost of equal ones, and kept with its position. Two texts that share GRAM + WINDOW - 1 code points
in a row share a chosen hash, so copied passages of that length cannot be missed; positions say where.

A chosen gram is one long: the upper 36 bits of the hash (each depends on the whole run) above 28 bits that fall with the position, so that a plain
minimum breaks ties to the right. Window minima are found by doubling as well (of 2, 4, 8, then 16 in a row): each pass pairs an
array with itself some places on, as a lambda of two elements costs a third of one that looks three up by place.

Defined cases: a null text is empty; a text shorter than a gram is one gram; one with fewer grams than a
window chooses the least of all; equal texts have equal fingerprints; an empty table gives none; texts are
whole however long, and one of more than PLACES (268,435,455) code points is an error; rows without doc_id
stand outside the order of documents, and the next document of each is itself; rows of one doc_id follow
each other by text, in one task; extra columns pass through, and ones called like results are replaced.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Powers of two.
GRAM = 8
WINDOW = 16
PLACE_BITS = 28
PLACES = (1 << PLACE_BITS) - 1
#: Code points of all windows that hold a gram, from its first one on.
REACH = GRAM + 2 * (WINDOW - 1) - 1


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def paired(a: Column, step: int, use) -> Column:
    """use of each element and the one that stands so many places after it; null after the last."""
    return F.zip_with(a, F.slice(a, F.lit(step + 1), F.size(a)), use)


def rolled(chars: Column) -> Column:
    """Hashes of all runs of GRAM of an array of single characters; the last GRAM - 1 elements are null."""

    def doubled(size: int):
        return lambda a: paired(a, size, lambda x, y: F.shiftleft(x, size).bitwiseXOR(y))

    single = F.transform(chars, lambda c: F.xxhash64(c))
    return reduce(lambda a, size: let(a, doubled(size)), [1 << s for s in range(GRAM.bit_length() - 1)], single)


def grams(text: Column, offset: Column | None = None) -> Column:
    """Keys of all grams; offset: position of the text's first code point in a longer text."""
    top = F.lit(PLACES).cast("long") - (F.lit(0) if offset is None else offset)
    key = lambda h, at: h.bitwiseAND(F.lit(~PLACES)).bitwiseOR(at)
    keyed = lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - (GRAM - 1)), F.sequence(top, top - F.size(h) + GRAM, F.lit(-1).cast("long")), key)
    whole = F.when(F.length(text) > PLACES, F.raise_error(F.lit("a text of more code points than positions can tell")).cast("string")).otherwise(text)
    return F.when(F.length(text) < GRAM, F.array(key(F.xxhash64(text), top))).otherwise(let(rolled(F.split(whole, "")), keyed))


def window_minima(keys: Column) -> Column:
    """Least key of each window; of all keys where there are fewer."""

    def widened(step: int):
        return lambda a: paired(a, step, lambda x, y: F.least(x, y))

    steps = [1 << s for s in range(WINDOW.bit_length() - 1)]
    # least() skips nulls: the last WINDOW - 1 are of less than a window
    every = lambda k: F.slice(reduce(lambda a, s: let(a, widened(s)), steps, k), F.lit(1), F.size(k) - (WINDOW - 1))
    return let(keys, lambda k: F.when(F.size(k) <= WINDOW, F.array(F.array_min(k))).otherwise(every(k)))


def chosen(text: Column, offset: Column | None = None) -> Column:
    """Keys of the chosen grams, by position."""
    return F.array_distinct(window_minima(grams(text, offset)))


def place(key: Column) -> Column:
    return F.lit(PLACES).cast("long") - key.bitwiseAND(F.lit(PLACES).cast("long"))


def hashes(keys: Column) -> Column:
    return F.transform(keys, lambda k: F.shiftrightunsigned(k, PLACE_BITS))


def as_string(keys: Column) -> Column:
    """Hashes of the chosen grams in order, nine hexadecimal digits each."""
    return F.array_join(F.transform(hashes(keys), lambda h: F.lpad(F.hex(h), 9, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Shared hashes over all hashes of two fingerprints; 1 where both are the same."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with grams (chosen keys: hashes and positions) and fingerprint."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ("grams", "fingerprint")]
    return docs.select(*kept, chosen(F.coalesce(F.col(text), F.lit(""))).alias("grams")).withColumn("fingerprint", as_string(F.col("grams")))


def with_edited(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next and positions
    (of the fingerprint's hashes) of every row.

    The edited text ends in the beginning of the next document by (doc_id, text), the first after the
    last. Rows are dealt into ranges of doc_id, each with a copy of the first row of the range after
    it, so the next document is a lead() inside a range and no range waits for another.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    known = rows.where("doc_id is not null")
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [i / ranges for i in range(1, ranges)]
    quantiles = known.stat.approxQuantile("doc_id", points, 0.2 / ranges) if points else []
    bounds = sorted({int(q) for q in quantiles})
    dealt = known.withColumn("range", _position(bounds, F.col("doc_id")))
    # one id for each range that holds rows: where the range begins
    first = sorted((r[0], r[1]) for r in dealt.groupBy("range").agg(F.min("doc_id")).collect())
    begins = [{"at": first[(k + 1) % len(first)][1], "range": number, "wraps": k + 1 == len(first)} for k, (number, _) in enumerate(first)]
    copies = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(begins)), "array<struct<at: bigint, range: int, wraps: boolean>>")))
    own = dealt.withColumns({"wraps": F.lit(False), "own": F.lit(True)})
    ghost = known.join(F.broadcast(copies), F.col("doc_id") == F.col("at")).select("doc_id", "text", "range", "wraps", F.lit(False).alias("own"))
    order = [F.col("wraps"), F.col("doc_id"), F.col("text")]
    keyed = own.unionByName(ghost).repartitionById(len(bounds) + 1, "range").sortWithinPartitions("range", *order).withColumn("grams", chosen(F.col("text")))
    after = Window.partitionBy("range").orderBy(*order)
    both = keyed.withColumns({"next_text": F.lead("text").over(after), "next_grams": F.lead("grams").over(after)}).where("own")
    alone = rows.where("doc_id is null").withColumn("grams", chosen(F.col("text"))).withColumns({"next_text": F.col("text"), "next_grams": F.col("grams")})
    names = ["doc_id", "text", "grams", "next_text", "next_grams"]
    both = both.select(*names).unionByName(alone.select(*names))

    n = F.length("text")
    cut = n - F.floor(n / 4).cast("int")
    # windows that begin before `shared` hold nothing of the new end; those from `start` on are chosen anew
    shared = F.greatest(cut - (GRAM + WINDOW - 2), F.lit(0))
    start = F.greatest(F.col("shared") - (WINDOW - 1), F.lit(0))
    edited = both.withColumn("n", n).withColumn("cut", cut).withColumn("shared", shared).withColumn("start", start)
    edited = edited.withColumn("edited", F.concat(F.expr("substring(text, 1, cut)"), F.expr("substring(next_text, 1, n - cut)")))
    edited = edited.withColumn("shared", F.when(F.col("start") == 0, 0).otherwise(F.col("shared")))
    # all windows that hold a gram of the next document's beginning lie in it, but for the first WINDOW - 1 grams and the last
    # ones: only around the cut and at the end is anything chosen anew
    edited = edited.withColumn("size", F.length("edited")).withColumn("middle", F.col("size") - F.col("cut") >= REACH)
    low, high = F.col("cut") + (WINDOW - 1), F.col("size") - (GRAM + WINDOW - 2)
    before = F.filter("grams", lambda k: place(k) < F.col("shared"))
    border = chosen(F.expr(f"substring(edited, start + 1, cut + {REACH} - start)"), F.col("start"))
    border = F.filter(border, lambda k: (place(k) >= F.col("shared")) & (~F.col("middle") | (place(k) < low)))
    copied = F.filter(F.transform("next_grams", lambda k: k - F.col("cut")), lambda k: (place(k) >= low) & (place(k) < high))
    end = F.filter(chosen(F.expr(f"substring(edited, size - {REACH - 1})"), F.col("size") - REACH), lambda k: place(k) >= high)
    both_ends = F.when(F.col("middle"), F.concat(border, copied, end)).otherwise(border)
    edited = edited.withColumn("edited_grams", F.concat(before, both_ends))
    out = edited.select(
        "doc_id",
        F.col("n").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string(F.col("grams")).alias("fingerprint"),
        as_string(F.col("edited_grams")).alias("edited_fingerprint"),
        F.array_distinct(hashes(F.col("grams"))).alias("a"),
        F.array_distinct(hashes(F.col("edited_grams"))).alias("b"),
        F.array_distinct(hashes(F.col("next_grams"))).alias("c"),
        F.transform("grams", place).alias("positions"),
    )
    near = {"near_edited": F.round(likeness(F.col("a"), F.col("b")), 6), "near_next": F.round(likeness(F.col("a"), F.col("c")), 6)}
    return out.withColumns(near).select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "positions")


def _position(bounds: list[int], value: Column) -> Column:
    """Number of bounds (sorted) that are at most value, by halving steps over one literal array."""
    if not bounds:
        return F.lit(0)
    sorted_bounds = F.expr(f"array({', '.join(f'{b}L' for b in bounds)})")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(len(bounds).bit_length()))])
    moved = lambda at, step: (at + step <= len(bounds)) & (F.try_element_at(sorted_bounds, at + step) <= value)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(moved(at, step), at + step).otherwise(at))
