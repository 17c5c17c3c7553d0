"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight, and a schedule of weights over the training time 0 to 1 (piecewise linear). Targets
come from the weights by filling up to a cap. A source's documents, in the order of a hash, are a stream of words
that is read until its target, a second time where the target is larger than the source. The integral of the
source's schedule says how many words are asked for until a time; inverting it gives every document its training
position, and ``schedule`` sorts by it.

A source's stream is summed in two steps (buckets of the hash, then documents within a bucket), so the largest
source is spread like any other; only one row per source and bucket is needed to join them. Where many rows of a
source share an id, or have none, their bucket is split by a hash of the text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS

#: Weights of sources in their order, repeating; the share of all words that is mixed; the most of a source.
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
#: Times of the schedule's knots, and for each weight the multipliers there: early, late and even sources.
KNOTS = (0.0, 0.5, 1.0)
SCHEDULES = ((2.0, 1.0, 0.5), (0.5, 1.0, 2.0), (1.0, 1.0, 1.0))
#: Documents of a bucket, about; a bucket with over SPLIT times as many, and over 1 / HOT of all, is split by text.
BUCKET, SPLIT, HOT = 16_384, 8, 10_000


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space."""
    inner = trimmed(text)
    return F.when(F.coalesce(inner, F.lit("")) == "", F.lit(0)).otherwise(F.size(F.split(inner, f"[{BLANKS}]+"))).cast("long")


def trimmed(text: Column) -> Column:
    return F.trim(text, F.lit(" \t\n\x0b\f\r"))


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """From (source, source_size): also its number in code point order (null last), weight and target.

    target = least(cap * source_size, level * weight), with the level at which all targets sum to share * all sizes.
    Sources are ranked by the level at which they reach their cap; the first that stays below it has the level.
    One row per source passes through one task.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("number", F.row_number().over(order) - 1)
    weighed = numbered.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("number") % len(weights) + 1).cast("int")).cast("double"))
    full = cap * F.col("source_size") / F.col("weight")
    before = Window.orderBy("full", "number").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    left = (share * F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.withColumn("full", full).withColumn("level", left)
    level = F.min(F.when(F.col("level") <= F.col("full"), F.struct("full", "number", "level"))).over(every)["level"]
    return levels.withColumn("target", F.least(cap * F.col("source_size"), level * F.col("weight"))).select("source", "source_size", "number", "weight", "target")


def position(demand: Column, total: Column, number: Column, knots: tuple = KNOTS, schedules: tuple = SCHEDULES) -> Column:
    """The training time at which the schedule has asked for ``demand`` of ``total`` words: the inverse of its integral."""
    out = F.lit(None).cast("double")
    for k, weights in enumerate(schedules):
        areas = [(t1 - t0) * (a + b) / 2 for t0, t1, a, b in zip(knots, knots[1:], weights, weights[1:], strict=False)]
        asked = demand / total * sum(areas)
        inverse, before = F.lit(knots[-1]), sum(areas)
        for j in range(len(areas) - 1, -1, -1):
            before -= areas[j]
            a, slope = weights[j], (weights[j + 1] - weights[j]) / (knots[j + 1] - knots[j])
            inside = F.lit(knots[j]) + 2 * (asked - before) / (a + F.sqrt(a * a + 2 * slope * (asked - before)))
            inverse = F.when(asked < before + areas[j], inside).otherwise(inverse)
        out = F.when(number % len(schedules) == k, F.when(total > 0, inverse).otherwise(F.lit(0.0))).otherwise(out)
    return out


def bucket_sums(sized: DataFrame) -> DataFrame:
    return sized.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"), F.count("*").alias("documents")).checkpoint()


def split_hot(sized: DataFrame, buckets: DataFrame, n: int) -> DataFrame | None:
    """``sized`` with the buckets that many rows of one id fill split by ``tie``; None where there are none. At most HOT are."""
    over = buckets.where(F.col("documents") > max(SPLIT * BUCKET, n / HOT))
    hot = over.select("source", "bucket", F.ceil(F.col("documents") / BUCKET).alias("parts")).collect()  # under HOT rows
    if not hot:
        return None
    known = F.broadcast(sized.sparkSession.createDataFrame(hot, "hot_source string, hot_bucket string, parts long"))
    met = sized.join(known, F.col("source").eqNullSafe(F.col("hot_source")) & (F.col("bucket") == F.col("hot_bucket")), "left")
    part = F.lpad(F.hex(F.pmod(F.col("tie"), F.col("parts"))), 16, "0")
    return met.withColumn("bucket", F.when(F.col("parts").isNull(), F.col("bucket")).otherwise(F.concat("bucket", part))).drop("hot_source", "hot_bucket", "parts")


def mix(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP, carry: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, passes (an array of words and position, one for each reading), taken, and a struct ``carry``.

    size: words of the text, null and empty texts 0; a null source is a source of its own. Rows that repeat a doc_id
    are documents of their own, very many of one id in an order of their texts first. Of the hash order, ties of equal
    rows change nothing. A very long text is one row, counted whole. The words taken of a source sum
    to its target, rounded down; the document at the end is taken in part. An empty table gives no rows. Columns other
    than doc_id, source and text are only carried, whatever their names.
    """
    rest = [F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carry")] if carry else []
    doc = F.col("doc_id").cast("string")
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words(F.col("text")).alias("size"), F.md5(F.coalesce(doc, F.lit(""))).alias("turn"), F.xxhash64("text").alias("tie"), *rest)
    n = docs.count()
    digits = max(1, math.ceil(math.log(max(1, n) / BUCKET, 16)))
    sized = sized.withColumn("bucket", F.substring("turn", 1, digits))
    buckets = bucket_sums(sized)
    finer = split_hot(sized, buckets, n)
    if finer is not None:
        sized, buckets = finer, bucket_sums(finer)
    sources = targets(buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("bucket_start"))
    joined = starts.join(sources, starts["source"].eqNullSafe(sources["source"])).select(F.coalesce(starts["source"], F.lit("")).alias("name"), starts["source"].isNull().alias("unnamed"), "bucket", "bucket_start", "source_size", "number", "target")
    keyed = sized.withColumn("name", F.coalesce("source", F.lit(""))).withColumn("unnamed", F.col("source").isNull())
    rows = keyed.join(joined, ["name", "unnamed", "bucket"])
    within = Window.partitionBy("name", "unnamed", "bucket").orderBy("turn", "doc_id", "size", "tie").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0))
    asked = F.floor("target")
    placed = rows.withColumn("start", start)
    readings = []
    for k in range(cap):
        at = F.col("start") + k * F.col("source_size")
        words = F.greatest(F.lit(0), F.least(F.col("size"), asked - at)).cast("long")
        readings.append(F.struct(words.alias("words"), F.round(position(at, F.col("target"), F.col("number")), 9).alias("position")))
    passes = F.filter(F.array(*readings), lambda x: x["words"] > 0)
    out = placed.withColumn("passes", passes).withColumn("taken", F.aggregate("passes", F.lit(0).cast("long"), lambda n, x: n + x["words"]))
    return out.select("doc_id", "source", "size", "source_size", "target", "passes", "taken", *(["carry"] if carry else []))


def schedule(docs: DataFrame, figures: bool = False, **options) -> DataFrame:
    """The mix as training reads it: the columns of ``docs`` and ``position``, one row per reading, sorted by position.

    Rows of one position go by doc_id, and repeated rows of one position and id in any order. A document that is taken in part is cut to its first words (joined by one space); n_chars, if there, follows the text.
    With ``figures`` also size, source_size and target (none of these may be a column of ``docs``), and after all others a row
    for each document that isn't read, without text and position.
    """
    columns, more = docs.columns, ["size", "source_size", "target"] if figures else []
    readings = (F.explode_outer if figures else F.explode)("passes").alias("take")
    takes = mix(docs, carry=columns, **options).select("size", "source_size", "target", "carry", readings)
    text = F.col("carry")["text"]
    cut = F.array_join(F.slice(F.split(trimmed(text), f"[{BLANKS}]+"), 1, F.col("take.words").cast("int")), " ")
    read = F.when(F.col("take.words") < F.col("size"), cut).when(F.col("take").isNotNull(), text).alias("text")
    rows = takes.select(*(F.col("carry")[c].alias(c) for c in columns if c != "text"), read, F.col("take.position").alias("position"), *more)
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(*columns, "position", *more).orderBy(F.col("position").asc_nulls_last(), "doc_id")
