"""URL rules by sort-merge range joins on reversed-host keys, swept with a stack of open rules.

The canonical key of a host is its labels from the last to the first, each closed by a dot
(www.example.net: "net.example.www."). A host with all its subdomains is then one interval of keys, and
so are all paths that begin with a rule's path; intervals of prefixes nest. Two sweeps find the rule:
1. over host keys: which rule hosts enclose a url's host;
2. over (enclosing rule host, path): the longest rule path there that the url's path begins with.
Of the winners of its enclosing hosts a url takes the longest rule.

A sweep sorts the urls and the two events of each interval, opening and closing: the running sum of
openings less closings is the height of the stack, and what lies at a level of the stack is the last
opening at that height. Rows are dealt by (range of keys, salt), with a copy of the events of every
interval that a range touches; ranges are counted first, and one that holds many urls has as many salts,
so that a hot host is spread over many tasks. A url meets the events, never a list of rules: its cost does
not grow with the rules of its host.

Everything is DataFrame functions. Defined cases: a null url or one without "://" has empty host and path
and fits no rule; an empty host has an empty key; a url without path fits no rule, as rule paths begin
with "/"; equal rules with both actions block; rules with a null, an empty host or a U+0000 in it fit
nothing; hosts of rules and urls are lower-cased alike (A to Z), other letters stay; an empty rule table
leaves every url to the default; rows, nulls in other columns and extra columns pass through, and columns
called like results are replaced; very long urls are keys like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import Workspace

SPLITTERS = 64
RESULTS = ("host", "path", "rule", "verdict")
OPENS, POINT, CLOSES = 0, 1, 2


def lowered(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """From the first :// up to / ? # or the end, A to Z in lower case."""
    return lowered(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)^.*?://[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, "\\.", -1)), "."), F.lit(".")))


def enclosing(points: DataFrame, prefixes: DataFrame, all_levels: bool, salts: int | None = None) -> DataFrame:
    """points with found: the value of the longest prefix of key, null if there is none; with all_levels a
    row for each prefix of key (longest: is_top), or one row with null.

    points: key (string) and others; prefixes: key (distinct) and value. salts: of every range; None: as
    many as its share of the points asks for.
    """
    spark = points.sparkSession
    # any prefixes may bound the ranges; a bounded number of them, spread by hash, is enough
    chosen = prefixes.select("key").orderBy(F.xxhash64("key"), "key").limit(SPLITTERS).collect()
    bounds = sorted(r["key"].encode() for r in chosen)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bucket = lambda key: sum((F.when(key >= F.lit(b), 1).otherwise(0) for b in bounds), F.lit(0))
    keyed = points.withColumn("__key", F.col("key").cast("binary")).withColumn("__range", bucket(F.col("__key")))
    dealt = [salts] * (len(bounds) + 1)
    if salts is None:
        held = {r[0]: r[1] for r in keyed.groupBy("__range").count().collect()}
        dealt = [max(1, -(-4 * parts * held.get(n, 0) // max(1, sum(held.values())))) for n in range(len(bounds) + 1)]
    n_salts = F.element_at(F.array(*[F.lit(n) for n in dealt]), F.col("__range") + 1)

    kept = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    value = prefixes.schema["value"].dataType
    urls = keyed.select("__range", F.pmod(F.monotonically_increasing_id(), n_salts).cast("int").alias("__salt"), "__key", F.lit(POINT).alias("__kind"), kept.alias("__row"), F.lit(None).cast(value).alias("__value"))
    first = F.col("key").cast("binary")
    last = F.concat(first, F.lit(b"\xff"))  # behind all strings that begin with the prefix, as UTF-8 has no such byte
    spans = prefixes.select(first.alias("__first"), last.alias("__last"), "value", F.explode(F.sequence(bucket(first), bucket(last))).alias("__range"))
    spans = spans.withColumn("__salt", F.explode(F.sequence(F.lit(0), n_salts - 1)))
    row = F.lit(None).cast(urls.schema["__row"].dataType).alias("__row")
    events = spans.select("__range", "__salt", F.explode(F.array(F.struct(F.col("__first").alias("k"), F.lit(OPENS).alias("s")), F.struct(F.col("__last").alias("k"), F.lit(CLOSES).alias("s")))).alias("e"), "value")
    events = events.select("__range", "__salt", F.col("e.k").alias("__key"), F.col("e.s").alias("__kind"), row, F.when(F.col("e.s") == OPENS, F.col("value")).alias("__value"))

    sweep = Window.partitionBy("__range", "__salt").orderBy("__key", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    height = F.sum(F.when(F.col("__kind") == OPENS, 1).when(F.col("__kind") == CLOSES, -1).otherwise(0)).over(sweep)
    raised = urls.unionByName(events).withColumn("__height", height.cast("int")).where(F.col("__kind") != CLOSES)
    levels = F.array("__height")
    if all_levels:
        levels = F.when((F.col("__kind") == POINT) & (F.col("__height") > 1), F.sequence(F.lit(1), F.col("__height"))).otherwise(levels)
    by_level = raised.withColumn("__level", F.explode(levels))
    stack = Window.partitionBy("__range", "__salt", "__level").orderBy("__key", "__kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # the last opening at a level no higher than the stack is still open
    found = by_level.withColumn("__value", F.last("__value", ignorenulls=True).over(stack)).where(F.col("__kind") == POINT)
    return found.select(*[F.col(f"__row.`{c}`").alias(c) for c in points.columns], F.col("__value").alias("found"), (F.col("__level") == F.col("__height")).alias("is_top"))


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow", salts: int | None = None) -> DataFrame:
    """pages with host, path, rule and verdict (the winning rule's action, else default).

    rules: host, path, action (allow or block).
    """
    usable = rules.where("host <> '' and path is not null and not contains(host, char(0))").withColumn("key", host_key(lowered(F.col("host"))))
    rule = F.struct(
        (F.length("host") + F.length("path")).alias("size"),
        (F.col("action") == "block").cast("int").alias("blocks"),
        F.length("host").alias("host_size"),
        "path",
        F.concat("host", "path").alias("rule"),
        "action",
    )
    place = lambda key: F.concat(key, F.lit("\0"), F.col("path"))
    hosts = usable.select("key", F.col("key").alias("value")).distinct()
    paths = usable.select(place(F.col("key")).alias("key"), rule.alias("value")).groupBy("key").agg(F.max("value").alias("value"))

    kept = [c for c in pages.columns if c not in RESULTS]
    row = F.struct(*[F.col(f"`{c}`") for c in kept])
    parsed = pages.select(F.monotonically_increasing_id().alias("id"), row.alias("row"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    in_hosts = enclosing(parsed.withColumn("key", host_key(F.col("host"))), hosts, all_levels=True, salts=salts)
    # one of a url's rows carries what is not needed to judge it
    placed = in_hosts.select("id", F.when(F.col("is_top"), F.col("row")).alias("row"), "host", "path", F.coalesce(place(F.col("found")), F.lit("")).alias("key"))
    # written: the second sweep counts its ranges before it runs, and would run the first one for that
    in_paths = enclosing(Workspace(pages.sparkSession, "url-filters").save(placed, "placed"), paths, all_levels=False, salts=salts)
    won = in_paths.groupBy("id").agg(F.max("found").alias("won"), F.first("row", ignorenulls=True).alias("row"), F.first("host").alias("host"), F.first("path").alias("path"))
    return won.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "host", "path", F.col("won.rule").alias("rule"), F.coalesce("won.action", F.lit(default)).alias("verdict"))
