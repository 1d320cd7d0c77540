"""Problem 9: drawing documents so that sources reach target weights.

Every document gets a hash-random 64-bit key; the key's top bits name a fixed range, so the order
within a source is range-sorted without sampling and the same after any retry. Token counts are
summed per (source, range), prefix-summed over the ranges, and each document's place in its source
is its range's offset plus a running sum inside the range. Cutting at a source's budget is then a
comparison per row. No task ever holds more than one range of one source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.text import SPACE, count_tokens

RANGE_BITS = 10
MAX_TARGETS = 100_000


def source_key(source: Column) -> Column:
    """How sources compare: trimmed and lower-cased; null stays null and a blank source becomes null."""
    return F.nullif(F.lower(F.regexp_replace(source, f"^[{SPACE}]+|[{SPACE}]+$", "")), F.lit(""))


def budgets(totals: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per (mix_id, source): its tokens, wanted and granted tokens.

    The size of a mix is the tokens of all its sources; a source wants its weight of that and gets
    at most its tokens times ``max_repeats``.
    """
    t = targets.select(
        "mix_id", "source", source_key(F.col("source")).alias("src"),
        F.col("target_weight").cast("double").alias("weight"), F.coalesce("max_repeats", F.lit(1)).alias("repeats"),
    ).distinct()
    joined = t.join(totals, "src", "left").withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
    mix = Window.partitionBy("mix_id")
    wanted = F.coalesce("weight", F.lit(0.0)) * F.sum("source_tokens").over(mix)
    reach = F.col("source_tokens") * F.col("repeats")
    return joined.select("mix_id", "source", "src", "weight", "repeats", "source_tokens", wanted.alias("wanted"), F.least(wanted, reach.cast("double")).alias("granted"))


def mix_sources(documents: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(chosen, shares).

    chosen: mix_id, source, doc_id, tokens, copies (1 or more). shares: mix_id, source, target_weight,
    source_tokens, granted, short, reached_tokens, reached_share. A source is short if all its documents were
    drawn as often as they may be and what that reached is less than it wants.

    Documents without source (null or blank) take no part; a null text counts no tokens and is never
    drawn; copies of a text are documents of their own; equal keys are ordered by doc_id. ``targets``
    may hold at most MAX_TARGETS rows (checked), which bounds what is broadcast; identical rows count once.
    """
    if len(targets.select(F.lit(1)).limit(MAX_TARGETS + 1).collect()) > MAX_TARGETS:
        raise ValueError(f"more than {MAX_TARGETS} targets")
    wanted = targets.select(source_key(F.col("source")).alias("src")).where("src is not null").distinct()
    key = F.xxhash64("doc_id", F.lit(seed))
    docs = (
        documents.select("doc_id", source_key(F.col("source")).alias("src"), count_tokens(F.col("text")).cast("long").alias("tokens"))
        .where("src is not null and tokens > 0")
        .join(F.broadcast(wanted), "src", "left_semi")
        .select("doc_id", "src", "tokens", key.alias("key"), F.shiftright(key, 64 - RANGE_BITS).cast("int").alias("range"))
    )
    sums = docs.groupBy("src", "range").agg(F.sum("tokens").alias("t"))
    totals = sums.groupBy("src").agg(F.sum("t").alias("source_tokens"))
    plan = budgets(totals, targets)
    before = Window.partitionBy("src").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("src", "range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("src", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    placed = docs.withColumn("cum", F.sum("tokens").over(inside)).join(starts, ["src", "range"])
    full = F.floor(F.col("granted") / F.col("source_tokens"))
    rest = F.col("granted") - full * F.col("source_tokens")
    copies = (full + F.when(F.col("start") + F.col("cum") <= rest, 1).otherwise(0)).cast("int")
    chosen = (
        placed.join(F.broadcast(plan.where("granted > 0")), "src")
        .select("mix_id", "source", "doc_id", "tokens", copies.alias("copies"))
        .where("copies > 0")
    )
    reached = chosen.groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("reached_tokens"))
    shares = (
        plan.join(reached, ["mix_id", "source"], "left")
        .withColumn("reached_tokens", F.coalesce("reached_tokens", F.lit(0)))
        .withColumn("reached_share", F.col("reached_tokens") / F.nullif(F.sum("reached_tokens").over(Window.partitionBy("mix_id")), F.lit(0)))
        .withColumn("short", (F.col("reached_tokens") >= F.col("source_tokens") * F.col("repeats")) & (F.col("reached_tokens") < F.col("wanted")))
        .select("mix_id", "source", F.col("weight").alias("target_weight"), "source_tokens", "granted", "short", "reached_tokens", "reached_share")
    )
    return chosen, shares
