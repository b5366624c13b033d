"""Streaming jobs drained over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators.review import review_queue
from ..session import checkpoint_dir
from ..streaming import changes, stateful
from . import oracle_views as O
from . import views as V
from .flow_queries import QUEUE, SEEN, sightings, stock_sql
from .registry import query


def scratch(spark, name: str) -> str:
    """A fresh folder in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(spark, df, name: str, batches: int = 4):
    """The rows of a table as a stream of some batches; each is several files, so that one task does not read a batch alone."""
    path = scratch(spark, name)
    files = 2 * spark.sparkContext.defaultParallelism
    df.repartition(batches * files).write.parquet(path)
    reader = spark.readStream.schema(df.schema)
    # a single batch takes whatever there is
    return (reader.option("maxFilesPerTrigger", files) if batches > 1 else reader).parquet(path)


def collected(spark, stream, name: str, schema: str):
    """Run a stream to its end and read its output back."""
    out, state = scratch(spark, name + "-out"), scratch(spark, name + "-state")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def drained(spark, sf_dir) -> str:
    """Root of the change tables after the whole feed."""
    root = scratch(spark, "feed")
    stream = as_stream(spark, V.outbox(spark, sf_dir), "outbox")
    changes.follow(stream, root, scratch(spark, "feed-state"), once=True).awaitTermination()
    return root


LAST = "SELECT user_id, max(event_id) AS id, arg_max(event_type, event_id) AS kind FROM events WHERE event_id % 101 <> 100 GROUP BY user_id"
LIVE = f"""SELECT 'SKU-' || user_id AS sku_code, 'T' || (user_id % 5) AS cpse, 'D' || (id % 25) AS depot_id, id % 6 * 50.0 + 50.0 AS size, {O.pick('id', V.CLASSES)} AS class, (id % 90)::INT AS quantity FROM last WHERE kind <> 'error'"""


@query("st3_current_items", O.sql("", "SELECT sku_code, cpse, depot_id, size::DOUBLE AS size_nb_mm, class AS pressure_class, quantity FROM live", last=LAST, live=LIVE))
def current_items(spark, sf_dir):
    return changes.current_records(spark, drained(spark, sf_dir)).select("sku_code", "cpse", "depot_id", "size_nb_mm", "pressure_class", "quantity")


@query("st4_failed_events", "SELECT event_id AS id, 'payload is not a JSON object' AS error_message FROM events WHERE event_id % 101 = 100")
def failed(spark, sf_dir):
    return changes.stored_changes(spark, drained(spark, sf_dir), "failed").select("id", "error_message")


@query("a12_batch_counts", "SELECT CASE WHEN event_id % 101 = 100 THEN 'FAILED' ELSE 'PROCESSED' END AS status, count(*) AS events FROM events GROUP BY 1")
def counts(spark, sf_dir):
    return changes.stored_changes(spark, drained(spark, sf_dir), "counts").groupBy("status").agg(F.sum("events").alias("events"))


@query("st5_current_edges", O.sql("", "SELECT sku_code AS src, 'HAS_SIZE' AS rel, CAST(size::DOUBLE AS VARCHAR) || ' mm' AS dst FROM live UNION ALL SELECT sku_code, 'HAS_PRESSURE_CLASS', class || '#' FROM live", last=LAST, live=LIVE))
def edges(spark, sf_dir):
    out = changes.current_edges(spark, drained(spark, sf_dir))
    return out.filter(F.col("rel").isin("HAS_SIZE", "HAS_PRESSURE_CLASS")).select("src", "rel", "dst")


@query(
    "st10_backfill_then_changes",
    O.sql("inventory", "SELECT sku_code, quantity FROM live UNION ALL SELECT sku_code, quantity FROM inventory WHERE sku_code NOT IN (SELECT 'SKU-' || user_id FROM last)", last=LAST, live=LIVE),
)
def backfilled(spark, sf_dir):
    root = scratch(spark, "backfilled")
    stream = as_stream(spark, V.outbox(spark, sf_dir), "outbox")
    changes.backfill_and_follow(V.inventory(spark, sf_dir), stream, root, scratch(spark, "backfilled-state"), once=True).awaitTermination()
    return changes.current_records(spark, root, columns=["sku_code", "quantity"])


@query("st6_stock_stream", stock_sql("SELECT w.sku_code, event_id, e.requisition_id, w.event_type, e.quantity, w.granted, w.stock_left FROM walk w JOIN numbered e USING (event_id) WHERE w.n > 0"))
def stock_stream(spark, sf_dir):
    """Stock outcomes of the streamed events; one batch, so time order holds throughout."""
    stateful.use_rocksdb(spark)
    stream = as_stream(spark, V.stock_events(spark, sf_dir), "stock", batches=1)
    return collected(spark, stateful.stock_stream(stream, V.opening_stock(spark, sf_dir)), "stock", stateful.STOCK_RESULT)


@query("st7_distinct_keys", "SELECT count(DISTINCT user_id || '-' || event_type) AS keys FROM events")
def distinct_keys(spark, sf_dir):
    intake = V.table(spark, sf_dir, "events").select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("idempotency_key"), F.col("ts").cast("timestamp").alias("ts"))
    stream = as_stream(spark, intake, "keys")
    out = collected(spark, stateful.distinct_keys(stream, life="60 days"), "keys", "idempotency_key string, ts timestamp")
    return out.agg(F.count("*").alias("keys"))


def security_events(spark, sf_dir):
    return V.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("scope"), F.concat(F.lit("s"), F.pmod("user_id", F.lit(3)).cast("string")).alias("subject"), "event_id", F.col("ts").cast("timestamp").alias("ts")
    )


@query(
    "st8_bursts",
    "SELECT event_type AS scope, 's' || (user_id % 3) AS subject, time_bucket(INTERVAL 4 HOUR, ts, TIMESTAMP '1970-01-01') AS window_start, count(*) AS hits FROM events GROUP BY ALL HAVING count(*) > 4",
)
def bursts(spark, sf_dir):
    return stateful.bursts(security_events(spark, sf_dir), limit=4, seconds=4 * 3600)


@query("st8_guarded_stream")
def guarded(spark, sf_dir):
    """Decision per event with windows that start at a subject's first event."""
    stateful.use_rocksdb(spark)
    stream = as_stream(spark, security_events(spark, sf_dir), "guard", batches=1)
    return collected(spark, stateful.guarded(stream, limit=4, seconds=4 * 3600), "guard", stateful.BURST_RESULT)


@query("st9_review_stream", O.sql("", "SELECT id, query, canonical_id, ts FROM queue", seen=SEEN, queue=QUEUE))
def review_stream(spark, sf_dir):
    path = scratch(spark, "reviews")
    stream = as_stream(spark, sightings(spark, sf_dir), "sightings")
    changes.follow_reviews(stream, path, scratch(spark, "reviews-state"), once=True).awaitTermination()
    return review_queue(spark.read.parquet(path).drop("batch")).select("id", "query", "canonical_id", "ts")
