"""Change feed into derived tables.

The database side of the capture stays in the database; its contract is the outbox row
(id, table_name, operation, record_id, payload, created_at). A batch is reduced to the last change per
record and appended under its batch number, so a batch that runs twice replaces itself. Readers take the
change with the highest id of each record: changes that arrive out of order need no care, and no
table is rewritten per batch. ``compact`` folds old batches into one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import graph
from ..operators.review import latest

OUTBOX = "id long, table_name string, operation string, record_id string, payload string, created_at timestamp"
ITEM = (
    "sku_code string, cpse string, depot_id string, depot_location string, description string, item_type string, "
    "size_nb_mm double, pressure_class int, schedule string, metallurgy string, facing_end string, quantity int, "
    "unit_cost_inr double, total_value_inr double, status string, days_idle int, is_broadcasted_surplus boolean"
)
REQUISITION = (
    "requisition_id string, source_cpse string, target_cpse string, source_depot string, target_depot string, sku_code string, "
    "required_qty int, unit_cost_inr double, total_value_inr double, status string, urgency_level string, justification string, "
    "requested_by string, approved_by string, audit_hash string"
)
TABLES = {"inventory_items": ("sku_code", ITEM), "requisitions": ("requisition_id", REQUISITION)}
OPERATIONS = ("INSERT", "UPDATE", "DELETE")


def outbox_stream(spark: SparkSession, path: str, max_files: int = 50) -> DataFrame:
    """Outbox files as a stream, a bounded number per batch."""
    return spark.readStream.schema(OUTBOX).option("maxFilesPerTrigger", max_files).parquet(path)


def parsed(changes: DataFrame) -> DataFrame:
    """Outbox rows with their status; a row that cannot be applied is FAILED with a reason."""
    known = F.col("table_name").isin(*TABLES) & F.col("operation").isin(*OPERATIONS)
    body = F.from_json("payload", "map<string,string>", {"mode": "PERMISSIVE"})
    key = F.lit(None).cast("string")
    for table, (name, _) in TABLES.items():
        key = F.when(F.col("table_name") == table, F.try_element_at(body, F.lit(name))).otherwise(key)
    reason = (
        F.when(~known, "unknown table or operation")
        .when(body.isNull() | (F.size(body) == 0), "payload is not a JSON object")
        .when(F.coalesce(key, F.lit("")) == "", "payload has no key")
    )
    return changes.withColumns(
        {"record_key": key, "status": F.when(reason.isNull(), "PROCESSED").otherwise("FAILED"), "error_message": reason}
    )


def last_changes(changes: DataFrame) -> DataFrame:
    """The change with the highest id of each record."""
    return latest(changes, ["table_name", "record_key"], ["id"])


def batch_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("events"))


def apply_batch(root: str):
    """Function for ``foreachBatch``: append the last changes, the failed rows and the counts of a batch."""

    def apply(batch: DataFrame, number: int) -> None:
        rows = parsed(batch).persist()
        try:
            part = f"batch={number:012d}"
            good = rows.filter("status = 'PROCESSED'").select("id", "table_name", "operation", "record_key", "payload")
            last_changes(good).write.mode("overwrite").parquet(f"{root}/changes/{part}")
            failed = rows.filter("status = 'FAILED'").select("id", "table_name", "operation", "record_id", "payload", "error_message")
            failed.write.mode("overwrite").parquet(f"{root}/failed/{part}")
            batch_counts(rows).write.mode("overwrite").parquet(f"{root}/counts/{part}")
        finally:
            rows.unpersist()

    return apply


def follow(stream: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep the change table at ``root`` current; ``once`` drains what is there and stops."""
    writer = stream.writeStream.foreachBatch(apply_batch(root)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()


def stored_changes(spark: SparkSession, root: str, kind: str = "changes") -> DataFrame:
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{kind}")


def current_records(spark: SparkSession, root: str, table: str = "inventory_items", columns: list[str] | None = None) -> DataFrame:
    """Live records of a table after all stored changes, all columns or the given ones; only what is asked for is read from the payloads and shuffled."""
    _, schema = TABLES[table]
    if columns:
        schema = ", ".join(field for field in schema.split(", ") if field.split(" ")[0] in columns)
    rows = stored_changes(spark, root).filter(F.col("table_name") == table)
    if not columns:
        last = last_changes(rows).filter("operation <> 'DELETE'").select(F.from_json("payload", schema).alias("r"))
        return last.select("r.*")
    read = rows.select("table_name", "record_key", "id", "operation", F.from_json("payload", schema).alias("r"))
    return last_changes(read).filter("operation <> 'DELETE'").select(*[F.col("r")[c].alias(c) for c in columns])


def current_edges(spark: SparkSession, root: str, keep_stale: bool = False) -> DataFrame:
    """Item edges after all stored changes.

    By default an item has the edges of its last change. ``keep_stale`` also keeps those of earlier stored
    changes of live items (only changes that were the last of their batch are stored).
    """
    if not keep_stale:
        return graph.item_edges(graph.item_payload(current_records(spark, root)))
    live = current_records(spark, root).select("sku_code")
    every = stored_changes(spark, root).filter("table_name = 'inventory_items' and operation <> 'DELETE'")
    rows = every.select(F.from_json("payload", ITEM).alias("r")).select("r.*").join(live, "sku_code", "left_semi")
    return graph.item_edges(graph.item_payload(rows))


def is_empty(spark: SparkSession, root: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/changes")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return not files.exists(path) or stored_changes(spark, root).isEmpty()


def backfill(items: DataFrame, root: str, table: str = "inventory_items") -> bool:
    """Load all records once, when nothing is stored yet; later changes have higher ids."""
    spark = items.sparkSession
    if not is_empty(spark, root):
        return False
    key, _ = TABLES[table]
    kept = items.filter(F.coalesce(F.col(key), F.lit("")) != "")
    body = kept.select(
        F.lit(-1).cast("long").alias("id"), F.lit(table).alias("table_name"), F.lit("INSERT").alias("operation"),
        F.col(key).cast("string").alias("record_key"), F.to_json(F.struct(*items.columns)).alias("payload"),
    )
    # such rows cannot fail, and only those of repeated keys need a choice: the wide payloads of the others are neither kept nor shuffled
    groups = kept.groupBy(F.col(key).cast("string").alias("record_key")).agg(F.count("*").alias("n"))
    total, most = groups.agg(F.sum("n"), F.max("n")).first()
    last = body
    if most and most > 1:
        repeated = groups.filter("n > 1").select("record_key")
        chosen = last_changes(body.join(repeated, "record_key", "left_semi")).select(body.columns)
        last = body.join(repeated, "record_key", "left_anti").select(body.columns).union(chosen)
    last.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/changes/batch=backfill")
    none = spark.createDataFrame([], "id long, table_name string, operation string, record_id string, payload string, error_message string")
    none.write.mode("overwrite").parquet(f"{root}/failed/batch=backfill")
    counts = spark.createDataFrame([("PROCESSED", total)] if total else [], "status string, events long")
    counts.write.mode("overwrite").parquet(f"{root}/counts/batch=backfill")
    return True


def backfill_and_follow(items: DataFrame, stream: DataFrame, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    backfill(items, root)
    return follow(stream, root, checkpoint, once)


def compact(spark: SparkSession, root: str, target: str) -> None:
    """Fold all stored changes into one batch under another root.

    Deletions stay as rows, so that a late change with a lower id cannot bring a deleted record back.
    """
    last = last_changes(stored_changes(spark, root))
    last.write.mode("overwrite").parquet(f"{target}/changes/batch=base")


def follow_reviews(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append the review entries of streamed search results; the queue is read from the path."""
    from ..operators.review import review_items

    def apply(batch: DataFrame, number: int) -> None:
        review_items(batch).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
