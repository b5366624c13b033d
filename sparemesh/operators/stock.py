"""Stock reservation as an exact parallel replay.

A request is granted when the stock left covers it; a refused request takes nothing; a rejection
gives back what its request had locked. Each decision depends on those before it, so a running sum is
wrong. Yet a popular SKU may have a third of all requests, so a SKU is not one group either:

* events are range-partitioned by (SKU, time), so a popular SKU spans many partitions in order;
* each partition replays its own rows as a stream and keeps only the stock left and the open locks;
* for the SKU that continues from the partition before, the stock left at the seam and the fate of
  earlier requests are inputs. They are guessed, and partitions whose inputs changed are replayed with the
  outcome of the last round until the seams agree; the others are settled and not touched again. The
  first partition of a SKU is right in the first round, the second at the latest in the second, and so
  on, so the result is exact.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpointed

EVENT_ORDER = ["sku_code", "ts", "event_id"]
RESULT = "sku_code string, ts timestamp, event_id long, requisition_id string, event_type string, quantity int, granted boolean, stock_left long"


def _replay(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replay the rows of one partition, which are in order of SKU and time."""
    sku, left = None, 0
    fate: dict[str, bool] = {}
    locks: dict[str, int] = {}
    for pdf in rows:
        granted, stock = [], []
        columns = (pdf[c].to_numpy() for c in ("__part", "sku_code", "requisition_id", "event_type", "quantity", "start", "earlier_grant", "earlier_quantity"))
        for part, key, req, kind, quantity, start, earlier, earlier_quantity in zip(*columns):
            if (part, key) != sku:
                sku, left, fate, locks = (part, key), int(start), {}, {}
            if kind == "CREATE":
                ok = bool(quantity <= left)
                fate[req] = ok
                if ok:
                    left -= int(quantity)
                    locks[req] = int(quantity)
            elif req in fate:
                ok = req in locks
                if ok and kind == "REJECT":
                    left += locks[req]
                locks.pop(req, None)
            else:
                # the request lies in an earlier partition of this SKU
                ok = bool(earlier) if earlier is not None and earlier == earlier else False
                fate[req] = ok
                if ok and kind == "REJECT":
                    left += int(earlier_quantity)
            granted.append(ok)
            stock.append(left)
        out = pdf[["__part", "sku_code", "ts", "event_id", "requisition_id", "event_type", "quantity"]].copy()
        out["granted"], out["stock_left"] = granted, stock
        yield out


def reserve_stock(events: DataFrame, stock: DataFrame, partitions: int | None = None) -> DataFrame:
    """Outcome of every stock event.

    Events: event_id, ts, requisition_id, sku_code, event_type (CREATE, REJECT, DELIVER), quantity.
    Request ids are unique. Stock: sku_code, quantity. An event of an unknown SKU finds no stock.
    """
    spark = events.sparkSession
    count = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    base = events.select("sku_code", "ts", "event_id", "requisition_id", "event_type", F.col("quantity").cast("int").alias("quantity"))
    opening = stock.groupBy("sku_code").agg(F.sum("quantity").cast("long").alias("opening"))
    joined = base.join(opening, "sku_code", "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    ranged = checkpointed(
        joined.repartitionByRange(count, *EVENT_ORDER).sortWithinPartitions(*EVENT_ORDER).withColumn("__part", F.spark_partition_id())
    )
    # SKUs that cross a seam, with their partitions; at most one per seam
    ends = ranged.groupBy("__part").agg(F.min("sku_code").alias("first"), F.max("sku_code").alias("last")).orderBy("__part").collect()
    carried = {}
    for earlier, later in zip(ends, ends[1:]):
        if earlier["last"] == later["first"]:
            carried[later["__part"]] = later["first"]
    seams: dict[int, int] = {}
    grants = None
    left: dict[tuple[str, int], int] = {}
    pieces: list[tuple[DataFrame, set[int]]] = []
    todo = {row["__part"] for row in ends}
    # a chain of partitions settles from its start, one at least per round
    for _ in range(len(ends) + 2):
        replayed = ranged.filter(F.col("__part").isin(sorted(todo))) if pieces else ranged
        part_result = checkpointed(_run(spark, replayed, carried, seams, grants))
        pieces = [(df, parts - todo) for df, parts in pieces if parts - todo] + [(part_result, set(todo))]
        result = functools.reduce(DataFrame.unionByName, [df.filter(F.col("__part").isin(sorted(parts))) for df, parts in pieces]) if len(pieces) > 1 else part_result
        if not carried:
            return result.drop("__part")
        last = (
            part_result.join(F.broadcast(_seam_keys(spark, carried)), ["sku_code"])
            .groupBy("sku_code", "__part")
            .agg(F.max_by("stock_left", F.struct("ts", "event_id")).alias("left"))
            .collect()
        )
        left |= {(r["sku_code"], r["__part"]): r["left"] for r in last}
        found = {}
        for part, sku in carried.items():
            before = max((p for s, p in left if s == sku and p < part), default=None)
            found[part] = left[(sku, before)]
        # the fate of requests whose later events lie in another partition
        new_grants = _crossing(result, spark, carried)
        differ = new_grants if grants is None else new_grants.exceptAll(grants).unionByName(grants.exceptAll(new_grants))
        todo = {part for part in carried if found[part] != seams.get(part)} | {r["__part"] for r in differ.select("__part").distinct().collect()}
        if not todo:
            return result.drop("__part")
        seams, grants = found, new_grants
    raise RuntimeError("the stock replay did not settle")


def _seam_keys(spark, carried) -> DataFrame:
    return spark.createDataFrame([(s,) for s in sorted(set(carried.values()))], "sku_code string")


def _crossing(result: DataFrame, spark, carried) -> DataFrame:
    """Requests on seam SKUs with an event in a later partition than their creation."""
    rows = result.join(F.broadcast(_seam_keys(spark, carried)), "sku_code")
    made = rows.filter("event_type = 'CREATE'").groupBy("sku_code", "requisition_id").agg(
        F.min("__part").alias("made_in"),
        F.min_by("granted", F.struct("ts", "event_id")).alias("earlier_grant"),
        F.min_by("quantity", F.struct("ts", "event_id")).alias("earlier_quantity"),
    )
    later = rows.filter("event_type <> 'CREATE'").groupBy("sku_code", "requisition_id", "__part").agg(
        F.min(F.struct("ts", "event_id")).alias("at")
    )
    # only the first later event can still find the lock
    first = later.groupBy("sku_code", "requisition_id").agg(F.min_by("__part", "at").alias("__part"))
    return checkpointed(
        made.join(first, ["sku_code", "requisition_id"]).filter(F.col("__part") > F.col("made_in")).select(
            "sku_code", "requisition_id", "__part", "earlier_grant", "earlier_quantity"
        )
    )


def _run(spark, ranged, carried, seams, grants) -> DataFrame:
    rows = [(part, sku, seams.get(part)) for part, sku in carried.items()]
    starts = spark.createDataFrame(rows, "__part int, sku_code string, seam long")
    step = ranged.join(F.broadcast(starts), ["__part", "sku_code"], "left").withColumn("start", F.coalesce("seam", "opening"))
    if grants is None:
        step = step.withColumns({"earlier_grant": F.lit(None).cast("boolean"), "earlier_quantity": F.lit(None).cast("int")})
    else:
        step = step.join(grants, ["sku_code", "requisition_id", "__part"], "left")
        step = step.repartition("__part").sortWithinPartitions("__part", *EVENT_ORDER)
    names = ["__part", "sku_code", "ts", "event_id", "requisition_id", "event_type", "quantity", "start", "earlier_grant", "earlier_quantity"]
    return step.select(*names).mapInPandas(_replay, "__part int, " + RESULT)


def stock_after(result: DataFrame) -> DataFrame:
    """Stock left and quantities granted per SKU."""
    return result.groupBy("sku_code").agg(
        F.max_by("stock_left", F.struct("ts", "event_id")).alias("stock_left"),
        F.count_if((F.col("event_type") == "CREATE") & F.col("granted")).alias("granted"),
        F.count_if((F.col("event_type") == "CREATE") & ~F.col("granted")).alias("refused"),
    )


def locks_of(result: DataFrame) -> DataFrame:
    """Lock rows of the granted requests; a later rejection or delivery ends the lock."""
    made = result.filter("event_type = 'CREATE' and granted").select(
        "sku_code", "requisition_id", F.col("quantity").alias("locked_qty"), F.col("ts").alias("locked_at")
    )
    ended = result.filter("event_type <> 'CREATE' and granted").select("sku_code", "requisition_id").distinct().withColumn("__ended", F.lit(True))
    return made.join(ended, ["sku_code", "requisition_id"], "left").select(
        "sku_code", "requisition_id", "locked_qty", "locked_at",
        (F.col("locked_at") + F.expr("INTERVAL 7 DAYS")).alias("expires_at"),
        F.col("__ended").isNull().alias("is_active"),
    )
