"""Review queue and human decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sealing import review_id

STAMPS = {"APPROVE": "[VERIFIED BY HUMAN EXPERT]", "REJECT": "[REJECTED BY HUMAN EXPERT]"}
BOOTSTRAP_OFFICER = "CHIEF_MATERIALS_ENGINEER_BOOTSTRAP"


def uncertainty(score: Column) -> Column:
    """One at a score of a half, zero at the ends."""
    return F.lit(1.0) - F.least(F.lit(1.0), F.abs(score - 0.5) * 2)


def review_items(matches: DataFrame) -> DataFrame:
    """Review entries of all matches that are not Tier-1.

    Expects query, canonical_id, similarity, tier and optionally cosine and a touch time ``ts``.
    """
    cosine = F.coalesce(F.col("cosine"), F.col("similarity")) if "cosine" in matches.columns else F.col("similarity")
    return matches.filter(F.col("tier") != "Tier-1").withColumns(
        {
            "id": review_id(F.col("query"), F.col("canonical_id")),
            "uncertainty": uncertainty(F.col("similarity")),
            "cosine": cosine,
        }
    )


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; partial aggregation keeps one row per key and task."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("__row")).select(*keys, "__row.*")


def most_recent(df: DataFrame, order: list[str], capacity: int | None) -> DataFrame:
    """The newest ``capacity`` rows, newest first (a top-N, no global window); None: all rows, in no order."""
    return df if capacity is None else df.orderBy(*[F.desc(c) for c in order]).limit(capacity)


def review_queue(entries: DataFrame, capacity: int | None = None, touched: str = "ts") -> DataFrame:
    """Queue after all entries: latest entry per id, all of them, or the newest ``capacity``."""
    return most_recent(latest(entries, ["id"], [touched]), [touched, "id"], capacity)


def bootstrap_queue(matches: DataFrame, capacity: int | None = None) -> DataFrame:
    """First fill of an empty queue: with ``capacity``, the most uncertain entries survive."""
    entries = review_items(matches)
    unique = latest(entries, ["id"], ["uncertainty", "cosine"])
    return unique if capacity is None else unique.orderBy(F.desc("uncertainty"), "id").limit(capacity)


def resolve(queue: DataFrame, decisions: DataFrame, capacity: int | None = None) -> DataFrame:
    """Training examples of the decided entries, all of them, or the newest ten times the queue's ``capacity``."""
    examples = queue.join(decisions, "id").select(
        "query",
        F.coalesce(F.nullif("corrected_candidate", F.lit("")), F.nullif("canonical_description", F.lit("")), F.col("canonical_id")).alias("candidate"),
        F.col("accepted").cast("int").alias("label"),
        "cosine", "decided_at", "id",
    )
    return most_recent(examples, ["decided_at", "id"], capacity and capacity * 10).select("query", "candidate", "label", "cosine", "decided_at")


def queue_counters(queue: DataFrame, decisions: DataFrame, capacity: int | None = None) -> DataFrame:
    """Pending and resolved entries and the capacity (null: no bound), as one row."""
    marked = queue.select("id").join(decisions.select("id", F.lit(True).alias("done")).distinct(), "id", "left")
    return marked.agg(
        F.count_if(F.col("done").isNull()).alias("pending_reviews"),
        F.count_if(F.col("done").isNotNull()).alias("resolved_reviews"),
        F.lit(capacity).cast("int").alias("review_capacity"),
    )


def latest_decisions(decisions: DataFrame) -> DataFrame:
    """Last decision per (query text, SKU)."""
    return latest(decisions, ["query_text", "source_sku"], ["decided_at"])


def latest_stamps(decisions: DataFrame) -> DataFrame:
    """Stamp of the last approval or rejection per SKU."""
    known = decisions.filter(F.col("decision").isin(*STAMPS)).select("source_sku", "decision", "decided_at")
    last = latest(known, ["source_sku"], ["decided_at"])
    return last.select("source_sku", F.when(F.col("decision") == "APPROVE", STAMPS["APPROVE"]).otherwise(STAMPS["REJECT"]).alias("stamp"))


def decision_log(decisions: DataFrame, capacity: int | None = None) -> DataFrame:
    """Decisions kept: last per key, all of them or the newest ``capacity``."""
    return most_recent(latest_decisions(decisions), ["decided_at", "query_text", "source_sku"], capacity)


def decisions_from_golden(pairs: DataFrame) -> DataFrame:
    """Seed decisions from labelled pairs (query_text, source_sku, tier): tiers 1 and 2 approve."""
    filled = pairs.filter((F.coalesce("query_text", F.lit("")) != "") & (F.coalesce("source_sku", F.lit("")) != ""))
    tier = F.coalesce(F.col("tier"), F.lit(3))
    return filled.select(
        "query_text", "source_sku",
        F.when(tier.isin(1, 2), "APPROVE").otherwise("REJECT").alias("decision"),
        F.concat(F.lit("Tier "), tier.cast("string")).alias("tier_override"),
        F.lit(BOOTSTRAP_OFFICER).alias("officer"),
    )


def feedback_entries(decisions: DataFrame) -> DataFrame:
    """Decisions as ledger rows waiting for their hash; the officer is the session user."""
    from ..functions.sealing import sorted_json

    fields = {n: F.col(n) for n in ("query_text", "source_sku", "decision", "tier_override") if n in decisions.columns}
    return decisions.select(
        F.lit("ACTIVE_LEARNING_FEEDBACK").alias("action_category"),
        F.lit("HITL_FEEDBACK").alias("action_name"),
        F.col("username").alias("actor_name"),
        *[F.col(c) for c in ("actor_role", "cpse", "depot") if c in decisions.columns],
        F.col("source_sku").alias("reference_id"),
        sorted_json({**fields, "officer": F.col("username")}).alias("details"),
        F.col("decided_at").alias("timestamp"),
    )
