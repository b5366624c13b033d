"""Keyed state on event streams.

The processors need the RocksDB state store:
``spark.sql.streaming.stateStore.providerClass =
org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STOCK_RESULT = "sku_code string, event_id long, requisition_id string, event_type string, quantity int, granted boolean, stock_left long"
BURST_RESULT = "scope string, subject string, event_id long, window_start timestamp, hits int, allowed boolean, retry_after_seconds int"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class StockState(StatefulProcessor):
    """Stock left and open locks of one SKU.

    Events of a batch are taken in time order; an event that comes in a later batch than its
    successors is taken when it comes.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.left = handle.getValueState("left", "left long")
        self.locks = handle.getMapState("locks", "requisition_id string", "quantity int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        left = int(self.left.get()[0]) if self.left.exists() else int(pdf["opening"].iloc[0])
        out = []
        for row in pdf.itertuples():
            if row.event_type == "CREATE":
                ok = row.quantity <= left
                if ok:
                    left -= int(row.quantity)
                    self.locks.updateValue((row.requisition_id,), (int(row.quantity),))
            else:
                ok = self.locks.containsKey((row.requisition_id,))
                if ok:
                    if row.event_type == "REJECT":
                        left += int(self.locks.getValue((row.requisition_id,))[0])
                    self.locks.removeKey((row.requisition_id,))
            out.append((key[0], int(row.event_id), row.requisition_id, row.event_type, int(row.quantity), bool(ok), left))
        self.left.update((left,))
        yield pd.DataFrame(out, columns=["sku_code", "event_id", "requisition_id", "event_type", "quantity", "granted", "stock_left"])

    def close(self) -> None:
        pass


def stock_stream(events: DataFrame, stock: DataFrame) -> DataFrame:
    """Outcome of streamed stock events; the opening stock is a static table."""
    opening = stock.select("sku_code", F.col("quantity").cast("long").alias("opening"))
    joined = events.join(opening, "sku_code", "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    return joined.groupBy("sku_code").transformWithStateInPandas(
        statefulProcessor=StockState(), outputStructType=STOCK_RESULT, outputMode="Append", timeMode="None"
    )


def distinct_keys(intake: DataFrame, key: str = "idempotency_key", time: str = "ts", life: str = "24 hours") -> DataFrame:
    """Drop a key that comes again before it expires; the watermark bounds the state."""
    return intake.withWatermark(time, life).dropDuplicatesWithinWatermark([key])


def bursts(events: DataFrame, limit: int = 30, seconds: int = 60, time: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Windows on the clock in which a subject exceeds the limit within a scope."""
    grouped = events.withWatermark(time, late) if events.isStreaming else events
    return (
        grouped.groupBy(F.window(time, f"{seconds} seconds"), "scope", "subject")
        .agg(F.count("*").alias("hits"))
        .filter(F.col("hits") > limit)
        .select("scope", "subject", F.col("window.start").alias("window_start"), "hits")
    )


class BurstState(StatefulProcessor):
    """Window of one subject that starts at its first event and restarts when it is over."""

    def __init__(self, limit: int, seconds: int) -> None:
        self.limit, self.seconds = max(1, limit), max(1, seconds)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "start timestamp, hits int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        start, hits = self.window.get() if self.window.exists() else (None, 0)
        start = None if start is None else pd.Timestamp(start)
        out = []
        for row in pdf.itertuples():
            now = pd.Timestamp(row.ts)
            if start is None or (now - start).total_seconds() >= self.seconds:
                start, hits = now, 0
            hits += 1
            over = hits > self.limit
            retry = int(self.seconds - (now - start).total_seconds()) + 1 if over else 0
            out.append((key[0], key[1], int(row.event_id), start, hits, not over, retry))
        self.window.update((start.to_pydatetime(), hits))
        yield pd.DataFrame(out, columns=["scope", "subject", "event_id", "window_start", "hits", "allowed", "retry_after_seconds"])

    def close(self) -> None:
        pass


def guarded(events: DataFrame, limit: int = 30, seconds: int = 60) -> DataFrame:
    """Decision for each event of (scope, subject, event_id, ts)."""
    return events.groupBy("scope", "subject").transformWithStateInPandas(
        statefulProcessor=BurstState(limit, seconds), outputStructType=BURST_RESULT, outputMode="Append", timeMode="None"
    )
