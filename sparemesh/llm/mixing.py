"""Mixing sources to target weights: capped water-filling and seeded repetitions, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..operators.ordering import sorted_positions
from .common import WORD, stored

# Sources up to this many bytes of names are broadcast to the documents; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20


def word_count(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def order_key(doc_id: Column, size: Column, seed: int) -> Column:
    """A document's place in the seeded order of its source: equal for repeated rows."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), doc_id.cast("string"), size.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, max_epochs: int) -> DataFrame:
    """(source, source_size, target): the words each source gives to the mix.

    Sources in code point order, null last, take ``weights`` in turn. They share ``share`` of all words in proportion to
    their weights; a source that would exceed ``max_epochs`` times its size is clamped there and what is left
    is shared anew among the rest, until none is above. Each round clamps one source at least and brings two sums to the driver.
    If all are clamped, the mix stays below its size.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("__null", F.col("source").isNull())
    placed = sorted_positions(by_source, ["__null", "source"], into="__at").drop("__null")
    weight = F.get(F.lit(list(weights)), (F.col("__at") % len(weights)).cast("int"))
    sources = stored(placed.select("source", "source_size", weight.cast("double").alias("weight")), "sources")
    cap = F.col("source_size") * max_epochs
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    goal, level, before = share * total, None, -1
    while True:
        clamped = F.lit(False) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1]) >= cap
        n, used, free = sources.agg(F.count_if(clamped), F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0.0).otherwise(F.col("weight")))).first()
        if n == before or not free:
            break
        before, level = n, (float(goal - used), float(free))
    shared = F.lit(0.0) if level is None else F.col("weight") * F.lit(level[0]) / F.lit(level[1])
    return sources.select("source", "source_size", F.least(shared, cap.cast("double")).alias("target"))


def source_plan(sizes: DataFrame, targets: DataFrame, seed: int) -> DataFrame:
    """``targets`` plus ``copies`` (whole repetitions of every document) and ``until``: documents whose order key is at most ``until`` are taken once more.

    The order key is uniform hex, so its first three digits cut every source, the largest too, into 4,096 even
    ranges. Sums of the ranges tell in which one the fractional repetition ends; only that range is put in order.
    """
    keyed = sizes.select("source", "size", order_key(F.col("doc_id"), F.col("size"), seed).alias("key")).withColumn("range", F.substring("key", 1, 3))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = targets.withColumn("copies", whole).withColumn("need", F.col("target") - F.col("copies") * F.col("source_size"))
    ranges = keyed.groupBy("source", "range").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("ahead", F.coalesce(F.sum("words").over(running), F.lit(0))).withColumnRenamed("source", "__source")
    last = (
        plan.join(ranges, plan["source"].eqNullSafe(ranges["__source"]) & (F.col("ahead") < F.col("need")))
        .groupBy("source")
        .agg(F.max_by(F.struct("range", "ahead", "need"), "range").alias("at"))
        .select(F.col("source").alias("__source"), "at.*")
    )
    inside = keyed.withColumnRenamed("range", "__range")
    inside = inside.join(last, inside["source"].eqNullSafe(last["__source"]) & (inside["__range"] == last["range"]))
    inside = inside.groupBy("source", "key", "ahead", "need", "range").agg(F.sum("size").alias("size"))
    before = F.col("ahead") + F.coalesce(F.sum("size").over(Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    taken = inside.withColumn("__in", before + F.col("size") / 2 <= F.col("need"))
    until = taken.groupBy(F.col("source").alias("__source")).agg(F.coalesce(F.max(F.when(F.col("__in"), F.col("key"))), F.first("range")).alias("until"))
    return plan.join(until, plan["source"].eqNullSafe(until["__source"]), "left").select("source", "source_size", "target", "copies", F.coalesce("until", F.lit("")).alias("until"))


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 7, size: str | None = None
) -> DataFrame:
    """``docs`` with ``size`` (words), ``source_size``, ``target`` (of its source) and ``copies`` (how often the mix takes the row).

    Each source's words in the mix differ from its target by at most half of one document (of a group of repeated
    rows, which share one decision); no row is taken more than ``max_epochs`` times. Null text: size 0. Null source: a
    source of its own. The same seed and rows give the same mix on any cluster. ``size`` names a column that holds the
    sizes already. Input columns of the four names are replaced.

    Documents are never shuffled: plans are made from ids and sizes, and a row's decision needs only its source's plan.
    """
    names = ("size", "source_size", "target", "copies")
    sized = docs.withColumn("__size", F.col(size).cast("long") if size else word_count("text")).drop(*names)
    sizes = stored(sized.select(F.col("source").cast("string").alias("source"), "doc_id", F.col("__size").alias("size")), "sizes")
    plan = stored(source_plan(sizes, source_targets(sizes, weights, share, max_epochs), seed), "mix-plan")
    plan = plan.select(*[F.col(c).alias(f"__plan_{c}") for c in plan.columns])
    total_bytes = plan.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("__plan_source"), F.lit(0)) + 100), F.lit(0))).first()[0]
    small = F.broadcast(plan) if total_bytes <= BROADCAST_BYTES else plan
    rows = sized.join(small, sized["source"].cast("string").eqNullSafe(small["__plan_source"]))
    more = (order_key(F.col("doc_id"), F.col("__size"), seed) <= F.col("__plan_until")).cast("long")
    return rows.select(
        *[F.col(c) for c in docs.columns if c not in names],
        F.col("__size").alias("size"),
        F.col("__plan_source_size").alias("source_size"),
        F.col("__plan_target").alias("target"),
        (F.col("__plan_copies") + more).alias("copies"),
    )
