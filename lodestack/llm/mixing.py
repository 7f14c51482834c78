"""Mixing to target weights by iterative proportional fitting (raking), in DataFrame functions only.

Token counts are summed by cell (source, language, topic). Each margin's factor is set in turn so that
the margin's share of the reweighted tokens is its target share, until no share is further off than
the tolerance (of itself); targets that are not met in SWEEPS sweeps, as they contradict each other,
are an error that gives the deviation. Where sweeps get on slowly (sources that nearly have a language of their
own), every few of them are extrapolated, which stays among products of factors. A document's weight is the product of its three factors; documents are then sampled
with probabilities proportional to their weights as far as 1, by a hash of their id: the same rows
are drawn whatever the partitioning. The scale is solved for a token budget: cells at 1 stay there and
the others make up the rest. Without a budget the largest probability is 1, but at least the share
LEAST of the tokens is kept in expectation: rare cells are then kept whole and fall short of their
targets, instead of deciding how much of everything else survives.

Default targets are margins of one table, so that they can be met together: shares of sources, of the languages
of a source, and of the topics of a language of a source are tempered, each by its power, and the table is
raked to the given targets, if there are any. It is no product of factors by margin: raking starts from the tokens as they
are and finds the three factors that meet its margins. Languages and topics so follow the sources where a source has
a language of its own.

Cells stay DataFrames, written to the shared folder every few sweeps: their number follows the number
of sources, not of documents, and nothing of them is collected but one row of sums at a time.

Defined cases: null source, language or text count as '' (topic of an empty text: 'short'); a margin
without targets gets those of the table above; a value missing from given targets gets share 0 of that
margin and probability 0; targets of values that hold no tokens are left out and the rest rescaled;
a target whose tokens all have probability 0 by other margins' targets is an error; null counts of tokens
count as none, and null topics as ''; very long texts are measured whole;
documents without tokens count for no margin and keep their factors; rows without doc_id are drawn
by a hash of their text; repeated rows are drawn alike; an empty table gives an empty result; extra
columns pass through, and ones called like results are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import Workspace

MARGINS = ("source", "lang", "topic")
#: Powers of the observed shares that make default targets: sources are evened out, topics stay.
POWERS = {"source": 0.7, "lang": 0.85, "topic": 1.0}
SWEEPS = 1000
#: Sweeps in one written table, at most; the first tables have fewer.
BATCH = 4
TOLERANCE = 1e-3
#: Logarithm of the factor that an extrapolation of two sweeps moves a weight by, roughly, at most.
FARTHEST = 5.0
#: Share of the tokens of positive weight that a mixture without a budget keeps at least, in expectation.
LEAST = 0.8
RESULTS = ("topic", "tokens", "weight", "probability", "capped", "sampled")


def topic_of(text: Column) -> Column:
    """A register told from the text's form; documents carry no topic of their own."""
    t = F.coalesce(text, F.lit(""))
    size = F.greatest(F.length(t), F.lit(1))
    marks = F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))
    digits = F.length(t) - F.length(F.translate(t, "0123456789", ""))
    return F.when(size < 200, "short").when(marks > size * 0.02, "symbols").when(digits > size * 0.02, "figures").when(size > 8000, "long").otherwise("prose")


def tokens_of(text: Column) -> Column:
    """Tokens, estimated as a quarter of the UTF-8 bytes, rounded up."""
    return F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long")


def tempered(cells: DataFrame, powers: dict[str, float]) -> DataFrame:
    """cells with weight: a margin's shares inside the margins before it go by its power; below 1 evens them out."""
    out, above = cells.withColumn("weight", F.lit(1.0)), []
    for m in MARGINS:
        power, group = powers.get(m, 1.0), [*above, m]
        if power != 1:
            seen = cells.where("tokens > 0").groupBy(*group).agg(F.sum("tokens").cast("double").alias("x")).withColumn("y", F.pow("x", F.lit(power)))
            whole = seen.groupBy(*above).agg(F.sum("x").alias("all_x"), F.sum("y").alias("all_y"))
            both = seen.join(whole, above) if above else seen.crossJoin(F.broadcast(whole))
            factor = both.select(*group, (F.col("y") / F.col("x") * F.col("all_x") / F.col("all_y")).alias("factor"))
            out = out.join(factor, group, "left").withColumn("weight", F.col("weight") * F.coalesce("factor", F.lit(1.0))).drop("factor")
        above = group
    return out.select(*MARGINS, "tokens", "weight")


def rake(cells: DataFrame, targets: dict[str, DataFrame], ws: Workspace, sweeps: int = SWEEPS, tolerance: float = TOLERANCE) -> DataFrame:
    """cells (source, lang, topic, tokens, weight) with raked weights; targets: margin -> (value, share), shares of any total."""
    total = cells.agg(F.sum("tokens").cast("double").alias("all_tokens"))
    now = cells
    for m, t in targets.items():
        present = cells.where("tokens > 0").select(F.col(m).alias("value")).distinct()
        known = t.join(present, "value").where("share > 0")
        whole = known.agg(F.sum("share").alias("whole"))
        goal = known.crossJoin(F.broadcast(whole)).crossJoin(F.broadcast(total)).select(F.col("value").alias(m), (F.col("share") / F.col("whole") * F.col("all_tokens")).alias(f"goal_{m}"))
        now = now.join(goal, m, "left")
    now = ws.save(now, "cells")
    done, worst = 0, None
    while done < sweeps:
        swept, batch = now, min(done + 1, BATCH, sweeps - done)
        for k in range(batch):
            swept = swept.withColumn("off", F.lit(0.0)).withColumn(f"log{batch - k}", F.log("weight"))
            for m in targets:
                # sums over cells, not over documents: a window keeps the plan as long as the sweeps are many
                swept = swept.withColumn("mass", F.sum(F.col("tokens") * F.col("weight")).over(Window.partitionBy(m)))
                goal, mass = F.col(f"goal_{m}"), F.col("mass")
                factor = F.when(mass > 0, F.coalesce(goal, F.lit(0.0)) / mass).otherwise(F.when(goal.isNull(), 1.0).otherwise(0.0))
                off = F.when(goal.isNull(), 0.0).when(mass > 0, F.abs(goal / mass - 1)).otherwise(float("inf"))
                swept = swept.withColumns({"off": F.greatest("off", off), "weight": F.col("weight") * factor}).drop("mass")
        now = ws.save(swept, "swept")
        done += batch
        first, last, sums = None, None, [F.max("off").alias("worst")]
        if batch == BATCH:
            first = F.col("log1") - F.col("log2")
            last = F.log("weight") - F.col("log1") - first
            live = F.when((F.col("tokens") > 0) & (F.col("weight") > 0), F.col("tokens"))
            sums += [F.sum(live * first * first).alias("moved"), F.sum(live * last * last).alias("bent"), F.max(F.when(live.isNotNull(), F.abs(first))).alias("most")]
        found = now.agg(*sums).first()
        worst = found["worst"]
        # what later margins of a sweep move is as much again, at most
        if worst is None or worst <= tolerance / 2:
            return now.select(*MARGINS, "tokens", "weight")
        if worst == float("inf"):
            break
        if batch == BATCH and found["bent"]:
            # a step along the last two sweeps, in logarithms: weights stay products of factors, and slow fits end
            step = min((found["moved"] / found["bent"]) ** 0.5, FARTHEST / found["most"])
            if step > 1:
                ahead = F.exp(F.col("log2") + 2 * step * first + step * step * last)
                now = now.withColumn("weight", F.when(F.col("weight") > 0, ahead).otherwise(0.0))
        now = now.drop("off", *[f"log{k + 1}" for k in range(batch)])
    raise ValueError(f"targets of {', '.join(targets)} contradict each other: a share is off by {worst:.3g} of itself after {done} sweeps")


def raked(cells: DataFrame, targets: dict[str, DataFrame], powers: dict[str, float], ws: Workspace) -> DataFrame:
    """cells with weights that meet the targets, and for margins without targets those that the docstring derives."""
    plain, free = cells.withColumn("weight", F.lit(1.0)), [m for m in MARGINS if m not in targets]
    if not free:
        return rake(plain, targets, ws)
    model, tolerance = tempered(cells, {m: powers[m] for m in free}), TOLERANCE
    if targets:
        # both rakes share the tolerance; goals are the model's own margins, as given ones with derived ones could contradict by a trifle
        tolerance = TOLERANCE / 2
        model = rake(model, targets, ws, tolerance=tolerance)
    model = ws.save(model, "model")
    mass = F.sum(F.col("tokens") * F.col("weight")).alias("share")
    goals = {m: ws.save(model.groupBy(F.col(m).alias("value")).agg(mass), "derived") for m in MARGINS}
    return rake(plain, goals, ws, tolerance=tolerance)


def scale_for(weighed: DataFrame, wanted: float) -> float:
    """The scale at which tokens times least(1, weight * scale) sum up to wanted, or at which all are 1.

    Newton's steps from below: the sum is concave in the scale and linear between cells that reach 1,
    so no step goes too far, and the last one is exact."""
    scale = 0.0
    while True:
        full = F.col("weight") * scale >= 1
        sums = weighed.where("tokens > 0 and weight > 0").agg(F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("full"), F.sum(F.when(full, 0.0).otherwise(F.col("tokens") * F.col("weight"))).alias("mass")).first()
        if not sums["mass"] or (found := (wanted - sums["full"]) / sums["mass"]) <= scale * (1 + 1e-12):
            return scale
        scale = found


def drawn(doc_id: Column, text: Column, probability: Column, seed: int) -> Column:
    """Whether a number in [0, 1), hashed from the id, is below the probability."""
    key = F.xxhash64(F.lit(seed), F.coalesce(doc_id.cast("string"), F.concat(F.lit("text "), F.coalesce(text, F.lit("")))))
    return F.shiftrightunsigned(key, 11).cast("double") / float(1 << 53) < probability


def mix(
    docs: DataFrame, targets: dict[str, DataFrame] | None = None, powers: dict[str, float] | None = None, budget: float | None = None, seed: int = 11, tokens: str | None = None, topic: str | None = None
) -> DataFrame:
    """docs with topic, tokens, weight, probability, capped and sampled.

    capped: the document's cell would need a probability over 1 to meet its targets, is kept whole and falls short of them.

    tokens, topic: columns that hold counted tokens (such as token_counts gives) and topics; without
    them tokens are estimated and topics told from the text.

    targets: margin -> (value, share); margins not named are tempered by powers,
    as far as the others allow. budget: share of all
    tokens to keep in expectation, as far as probabilities up to 1 allow; None: as many as proportional
    probabilities allow, and at least LEAST.
    """
    ws = Workspace(docs.sparkSession, "mixing")
    plain = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in RESULTS])
    counted = F.coalesce(F.col(tokens).cast("long"), F.lit(0)) if tokens else tokens_of(F.col("text"))
    told = F.coalesce(F.col(topic).cast("string"), F.lit("")) if topic else topic_of(F.col("text"))
    # the columns that hold them may be called like results
    placed = docs.select(*[F.col(f"`{c}`") for c in plain.columns], told.alias("topic"), counted.alias("tokens"))
    key = {m: F.coalesce(F.col(m).cast("string"), F.lit("")) for m in MARGINS}
    cells = placed.groupBy(*[k.alias(m) for m, k in key.items()]).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("documents"))
    cells = ws.save(cells, "counts")
    given = {m: t for m, t in (targets or {}).items() if t is not None}
    weighed = raked(cells.drop("documents"), given, powers or POWERS, ws)
    held, whole = F.col("tokens"), F.col("weight") > 0
    sums = weighed.where("tokens > 0").agg(F.max("weight").alias("top"), F.sum("tokens").alias("n"), F.sum(F.when(whole, held).otherwise(0)).alias("open"), F.sum(held * F.col("weight")).alias("mass")).first()
    scale = 1.0 / sums["top"] if sums["top"] else 1.0
    if sums["mass"] and budget is not None:
        scale = scale_for(weighed, budget * sums["n"])
    elif sums["mass"] and sums["mass"] * scale < LEAST * sums["open"]:
        scale = scale_for(weighed, LEAST * sums["open"])
    scaled = F.col("weight") * scale
    chances = weighed.select(*[F.col(m).alias(f"__{m}") for m in MARGINS], "weight", F.least(F.lit(1.0), scaled).alias("probability"), (scaled > 1 + 1e-9).alias("capped"))
    found = placed.join(chances, [key[m] == F.col(f"__{m}") for m in MARGINS], "left")
    found = found.withColumns({"weight": F.coalesce("weight", F.lit(1.0)), "probability": F.coalesce("probability", F.lit(1.0)), "capped": F.coalesce("capped", F.lit(False))})
    return found.select("*", drawn(F.col("doc_id"), F.col("text"), F.col("probability"), seed).alias("sampled")).drop(*[f"__{m}" for m in MARGINS])
