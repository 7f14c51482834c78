"""Chunk statistics: overlaps, signals, page furniture, histogram, percentiles, document rollups."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.operators.common import ContractError

SIGNALS = ("at-limit", "short", "no-overlap", "heading-cut", "furniture")

#: Inclusive sizes of the histogram's bars.
BUCKETS = ((0, 99), (100, 199), (200, 399), (400, 599), (600, 799), (800, 999), (1000, 1189), (1190, 1200))

#: Name, expression, fewest matches and what they are evidence of, in order of precedence.
FURNITURE = (
    ("address directory", r"\d{3}[-.\s]\d{3}[-.\s]\d{4}", 3, "telephone numbers"),
    ("contact form", r"\[wpforms id=", 1, "form shortcodes"),
    ("navigation", r"(?i)\A\s*login\s*\z", 1, "navigation labels"),
    ("product data", r"stock_status:\s*\w", 1, "stock fields"),
)
PERCENTILES = (25, 50, 75, 95)


@dataclass(frozen=True)
class Options:
    """maximum: the chunker's largest size; at_limit: from where a chunk counts as at it (0: 10 less)."""

    maximum: int
    at_limit: int = 0
    short: int = 300
    furniture: tuple = ()
    buckets: tuple = BUCKETS

    @property
    def limit(self) -> int:
        return self.at_limit if self.at_limit > 0 else max(1, self.maximum - 10)


def overlaps(chunks: DataFrame) -> DataFrame:
    """chunks with runes, has_predecessor and overlap_bytes; a predecessor has the ordinal before."""
    w = Window.partitionBy("document_id").orderBy("ordinal")
    before = F.when(F.lag("ordinal").over(w) == F.col("ordinal") - 1, F.lag("byte_end").over(w))
    return chunks.withColumns({"runes": F.char_length("text"), "before": before}).select(
        *chunks.columns, "runes", F.col("before").isNotNull().alias("has_predecessor"), F.coalesce(F.greatest(F.col("before") - F.col("byte_start"), F.lit(0)), F.lit(0)).alias("overlap_bytes")
    )


def furniture(text: Column, patterns: tuple = FURNITURE) -> Column:
    """(pattern, matches, evidence) of the first pattern with enough matches; null if there is none."""
    out = F.lit(None).cast("struct<pattern:string,matches:int,evidence:string>")
    for name, expression, least, evidence in reversed(patterns):
        n = F.regexp_count(text, F.lit(expression))
        out = F.when(n >= max(1, least), F.struct(F.lit(name).alias("pattern"), n.alias("matches"), F.lit(evidence).alias("evidence"))).otherwise(out)
    return out


def measured(chunks: DataFrame, options: Options) -> DataFrame:
    """overlaps() with signals (in the order of SIGNALS) and the furniture found."""
    rows = overlaps(chunks).withColumn("furniture", furniture(F.col("text"), options.furniture))
    short, apart = F.col("runes") < options.short, F.col("has_predecessor") & (F.col("overlap_bytes") == 0)
    tests = (F.col("runes") >= options.limit, short, apart, short & apart, F.col("furniture").isNotNull())
    return rows.withColumn("signals", F.array_compact(F.array(*[F.when(x, name) for name, x in zip(SIGNALS, tests, strict=True)])))


def histogram(chunks: DataFrame, buckets: tuple = BUCKETS) -> DataFrame:
    """bucket, low, high, n and share (per cent) of every bar, empty ones too. chunks: runes."""
    spark = chunks.sparkSession
    bar = F.lit(None).cast("int")
    for k, (low, high) in reversed(list(enumerate(buckets))):
        bar = F.when(F.col("runes").between(low, high), k).otherwise(bar)
    counts = chunks.groupBy(bar.alias("bucket")).agg(F.count("*").alias("n"))
    bars = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(k).alias("bucket"), F.lit(a).alias("low"), F.lit(b).alias("high")) for k, (a, b) in enumerate(buckets)])))
    total = counts.agg(F.sum("n").alias("total"))
    share = F.when(F.col("total") > 0, F.col("n") / F.col("total") * 100).otherwise(0.0)
    full = F.broadcast(bars).join(counts, "bucket", "left").crossJoin(F.broadcast(total))
    return full.withColumn("n", F.coalesce("n", F.lit(0))).select("bucket", "low", "high", "n", share.alias("share"))


def uncounted(chunks: DataFrame, buckets: tuple = BUCKETS) -> DataFrame:
    inside = F.lit(False)
    for low, high in buckets:
        inside = inside | F.col("runes").between(low, high)
    return chunks.agg(F.count_if(~inside).alias("uncounted"))


def percentiles(chunks: DataFrame, points: tuple = PERCENTILES) -> DataFrame:
    """Nearest-rank percentiles of runes, from counts of each size rather than from sorted rows."""
    sizes = chunks.groupBy("runes").agg(F.count("*").alias("n"))
    w = Window.orderBy("runes")
    running = sizes.withColumns({"upto": F.sum("n").over(w), "total": F.sum("n").over(Window.partitionBy())})
    wanted = chunks.sparkSession.range(1).select(F.explode(F.array(*[F.lit(p) for p in points])).alias("percentile"))
    reached = running.join(F.broadcast(wanted), F.col("upto") >= F.floor((F.col("percentile") * F.col("total") + 99) / 100))
    return reached.groupBy("percentile").agg(F.min("runes").alias("runes"))


def signal_summary(rows: DataFrame) -> DataFrame:
    """signal, chunks and documents of each signal, zeros kept."""
    named = rows.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(x) for x in SIGNALS])).alias("pos", "signal"))
    counts = rows.select("document_id", F.explode("signals").alias("signal")).groupBy("signal").agg(F.count("*").alias("chunks"), F.countDistinct("document_id").alias("documents"))
    full = F.broadcast(named).join(counts, "signal", "left")
    return full.select("pos", "signal", F.coalesce("chunks", F.lit(0)).alias("chunks"), F.coalesce("documents", F.lit(0)).alias("documents"))


def flagged(rows: DataFrame, signal: str) -> DataFrame:
    check_signal(signal)
    return rows.where(F.array_contains("signals", signal))


def count(rows: DataFrame, signal: str) -> int:
    """Chunks with a signal."""
    return flagged(rows, signal).count()


def document_count(rows: DataFrame, signal: str) -> int:
    """Documents with a chunk with a signal."""
    return flagged(rows, signal).select("document_id").distinct().count()


def count_by_document(rows: DataFrame) -> DataFrame:
    """document_id, signal and n: how many chunks of a document carry each signal; none are left out."""
    return rows.select("document_id", F.explode("signals").alias("signal")).groupBy("document_id", "signal").agg(F.count("*").alias("n"))


def check_signal(signal: str) -> None:
    if signal not in SIGNALS:
        raise ContractError(f"unknown signal {signal!r}")


def signals_by_document(rows: DataFrame) -> DataFrame:
    """document_id, signals in fixed order, and furniture patterns by first appearance."""
    order = F.array(*[F.lit(x) for x in SIGNALS])
    seen = F.array_sort(F.collect_list(F.when(F.col("furniture").isNotNull(), F.struct("ordinal", F.col("furniture.pattern").alias("pattern")))))
    grouped = rows.groupBy("document_id").agg(F.flatten(F.collect_set("signals")).alias("found"), seen.alias("seen"))
    return grouped.select("document_id", F.array_intersect(order, "found").alias("signals"), F.array_distinct("seen.pattern").alias("patterns"))


def document_rollup(chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """document_id, chunks, total, least and most runes, first and last ordinal, and title where there is one.

    A chunk without text does not count as the least while another follows it.
    """
    rows = chunks.select("document_id", "ordinal", F.char_length("text").alias("runes"))
    least = F.coalesce(F.min(F.when(F.col("runes") > 0, F.col("runes"))), F.lit(0))
    out = rows.groupBy("document_id").agg(
        F.count("*").alias("chunks"),
        F.sum("runes").alias("total_runes"),
        least.alias("min_runes"),
        F.max("runes").alias("max_runes"),
        F.min("ordinal").alias("first_ordinal"),
        F.max("ordinal").alias("last_ordinal"),
    )
    if documents is None:
        return out
    named = documents.select(F.col("id").alias("document_id"), F.nullif("title", F.lit("")).alias("title"), F.nullif("source_uri", F.lit("")).alias("uri"))
    return out.join(named, "document_id", "left").select(*out.columns, F.coalesce("title", "uri", "document_id").alias("name"))


def document_by_id(rollup: DataFrame, document_id: str) -> DataFrame:
    """The row of document_rollup() of one document."""
    return rollup.where(F.col("document_id") == document_id)


def chunks_of(chunks: DataFrame, document_id: str) -> DataFrame:
    return chunks.where(F.col("document_id") == document_id).orderBy("ordinal")


def measure(chunks: DataFrame, options: Options) -> dict[str, DataFrame]:
    """All statistics of a bundle's chunks, as one table each."""
    rows = measured(chunks, options)
    return {
        "chunks": rows,
        "histogram": histogram(rows, options.buckets),
        "uncounted": uncounted(rows, options.buckets),
        "percentiles": percentiles(rows),
        "signals": signal_summary(rows),
    }
