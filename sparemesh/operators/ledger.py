"""Tamper-evident audit ledger."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sealing import GENESIS, ledger_hash, sealed, sorted_json
from ..session import checkpoint_dir, checkpointed
from .inventory import ALL, search
from .ordering import page

SEARCH_COLUMNS = ("action_name", "actor_name", "reference_id", "sha256_hash")
EXPORT_COLUMNS = (
    "log_id", "timestamp", "action_category", "action_name", "actor_name", "actor_role", "cpse", "depot", "reference_id",
    "details", "prev_hash", "sha256_hash",
)
ORDER = ["timestamp", "log_id"]


def entries(ledger: DataFrame, category: str = ALL, cpse: str = ALL) -> DataFrame:
    out = ledger
    if category and category != ALL:
        out = out.filter(F.col("action_category") == category)
    if cpse and cpse != ALL:
        out = out.filter(F.col("cpse") == cpse)
    return out


def entry_page(ledger: DataFrame, skip: int = 0, limit: int = 50, **filters) -> DataFrame:
    """Newest entries first, with the total beside each row."""
    kept = entries(ledger, **filters)
    total = kept.agg(F.count("*").alias("total"))
    return page(kept, [F.desc("timestamp"), F.desc("log_id")], skip, limit).crossJoin(F.broadcast(total))


def entry(ledger: DataFrame, log_id, cpse: str | None = None) -> DataFrame:
    out = ledger.filter(F.col("log_id") == log_id)
    return out.filter(F.col("cpse") == cpse) if cpse else out


def searched(ledger: DataFrame, text: str) -> DataFrame:
    return search(ledger, text, SEARCH_COLUMNS)


def export_rows(ledger: DataFrame, category: str = ALL, cpse: str = ALL) -> DataFrame:
    """Rows of the export, oldest first."""
    kept = entries(ledger, category, cpse)
    return kept.select(*[F.col(c) for c in EXPORT_COLUMNS if c in kept.columns]).orderBy(*ORDER)




def request_hash(columns: dict):
    """Hash of a request body that does not depend on the order of its keys."""
    return F.sha2(sorted_json(columns), 256)


def append_batch(pending: DataFrame, last_hash: str = GENESIS, block_rows: int = 500_000) -> DataFrame:
    """Chain a batch of new entries after ``last_hash``.

    A hash chain is serial by definition: each hash needs the one before. The row texts are prepared in parallel and dealt by
    ranges of time into blocks of about ``block_rows`` entries, written to the checkpoint folder. One task after the other sorts and folds
    one block and hands its last hash on, so no task holds more than a block, however large the batch is.
    """
    fields = ("log_id", "timestamp", "actor_name", "action_name", "reference_id", "details")
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in fields])
    rest = [c for c in pending.columns if c not in ("prev_hash", "sha256_hash")]
    spark = pending.sparkSession
    folder = f"{checkpoint_dir(spark)}/chain-{uuid.uuid4().hex}"
    ready = pending.select(*rest, text.alias("__text"))
    blocks = max(1, -(-pending.count() // block_rows))
    dealt = ready.repartitionByRange(blocks, *ORDER).withColumn("__block", F.spark_partition_id())
    dealt.write.partitionBy("__block").parquet(f"{folder}/pending")
    stored = spark.read.schema(dealt.schema).parquet(f"{folder}/pending")
    schema = ready.drop("__text").withColumns({"prev_hash": F.lit(""), "sha256_hash": F.lit(""), "__n": F.lit(0).cast("long")}).schema

    def chained(rows: DataFrame, start: str) -> DataFrame:
        def chain(frames):
            previous, n = start, 0
            for pdf in frames:
                before, after = [], []
                for body in pdf["__text"]:
                    before.append(previous)
                    previous = hashlib.sha256(f"{previous}|{body}".encode()).hexdigest()
                    after.append(previous)
                yield pdf.drop(columns="__text").assign(prev_hash=before, sha256_hash=after, __n=range(n, n + len(pdf)))
                n += len(pdf)

        return rows.repartition(1).sortWithinPartitions(*ORDER).mapInPandas(chain, schema)

    previous, paths = last_hash, []
    for block in range(blocks):
        paths.append(f"{folder}/chained-{block}")
        chained(stored.filter(F.col("__block") == block).drop("__block"), previous).write.parquet(paths[-1])
        last = spark.read.schema(schema).parquet(paths[-1]).agg(F.max_by("sha256_hash", "__n")).first()[0]
        previous = last or previous
    return spark.read.schema(schema).parquet(*paths).drop("__n")


def check_chain(ledger: DataFrame, partitions: int | None = None, row=F.col) -> DataFrame:
    """Each entry with its position and whether its link and its own hash hold.

    Only ids, times and hashes are ordered. They are range-partitioned (a crowded time is cut by the
    id), written to the checkpoint folder, linked inside each partition, and the first row of a
    partition is linked to the last row of the one before through a table of one row per partition.
    ``row`` gives the column of a hashed field, for ledgers that hash another form of it.
    """
    count = partitions or int(ledger.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = ledger.select(
        "log_id", "timestamp", "prev_hash", "sha256_hash", (ledger_hash(F.col("prev_hash"), row) == F.col("sha256_hash")).alias("hash_ok")
    )
    ranged = checkpointed(slim.repartitionByRange(count, *ORDER).withColumn("__part", F.spark_partition_id()))
    last = ranged.groupBy("__part").agg(F.max_by("sha256_hash", F.struct(*ORDER)).alias("__hash"), F.count("*").alias("__rows"))
    seam = Window.partitionBy(F.lit(0)).orderBy("__part")  # one row per partition
    seams = last.select(
        "__part",
        F.lag("__hash").over(seam).alias("__carried"),
        F.coalesce(F.sum("__rows").over(seam.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"),
    )
    inside = Window.partitionBy("__part").orderBy(*ORDER)
    linked = ranged.withColumns(
        {"__before": F.lag("sha256_hash").over(inside), "__n": F.row_number().over(inside) - 1}
    ).join(F.broadcast(seams), "__part")
    expected = F.coalesce("__before", "__carried", F.lit(GENESIS))
    return linked.select(
        "log_id", "timestamp", (F.col("__offset") + F.col("__n")).alias("position"),
        (F.col("prev_hash") == expected).alias("link_ok"), "hash_ok",
    )


def verify_chain(ledger: DataFrame, partitions: int | None = None, row=F.col) -> DataFrame:
    """One row: valid, first broken position and entry, entries checked."""
    broken = ~F.col("link_ok") | ~F.col("hash_ok")
    checked = check_chain(ledger, partitions, row)
    return checked.agg(
        (F.count_if(broken) == 0).alias("is_valid"),
        F.min(F.when(broken, F.col("position"))).alias("first_broken_position"),
        F.min_by("log_id", F.when(broken, F.col("position"))).alias("first_broken_log_id"),
        F.count("*").alias("total_verified"),
    )


__all__ = [
    "append_batch", "check_chain", "entries", "entry", "entry_page", "export_rows", "request_hash",
    "searched", "sealed", "verify_chain",
]
