"""Global positions without a one-task window (used by W5, W6, W10, L1-L3)."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed


def hash_order(*parts: Column, seed: int = 42) -> Column:
    """Pseudo-random but repeatable order key: hex MD5 of the parts and the seed."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts], F.lit(str(seed))))


def same_keys_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner equi-join on key columns where a null key meets a null key; the keys appear once."""
    other = right.withColumnsRenamed({k: "__r_" + k for k in keys})
    on = functools.reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("__r_" + k)) for k in keys])
    return left.join(other, on).drop(*["__r_" + k for k in keys])


def hash_positions(df: DataFrame, groups: list[str], order: str, into: str = "position", total: str = "total") -> DataFrame:
    """Zero-based position of each row in its group by a hex hash column, and the group's size.

    A group is cut into ranges by the first hex digits, which are even whatever the data: 4,096 ranges, or
    more when the session has many shuffle partitions. Rows are ranked inside a range; the ranges'
    counts, made by a map-side aggregate, give each range its offset. So a group with most of the
    rows is still ranked by many tasks. Null is a group like any other.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    digits = max(3, math.ceil(math.log(16 * tasks, 16)))
    ranged = df.withColumn("__range", F.substring(order, 1, digits))
    counts = ranged.groupBy(*groups, "__range").agg(F.count("*").alias("__rows"))
    by_group = Window.partitionBy(*groups)
    offsets = counts.withColumns(
        {
            "__offset": F.sum("__rows").over(by_group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)),
            total: F.sum("__rows").over(by_group),
        }
    ).drop("__rows")
    rank = F.row_number().over(Window.partitionBy(*groups, "__range").orderBy(order))
    out = same_keys_join(ranged.withColumn("__rank", rank), offsets, [*groups, "__range"])
    return out.withColumn(into, F.coalesce("__offset", F.lit(0)) + F.col("__rank") - 1).drop("__range", "__rank", "__offset")


def sorted_positions(df: DataFrame, order: list[str], into: str = "position", partitions: int | None = None) -> DataFrame:
    """Zero-based position of each row in the order of the given columns.

    The rows are range-partitioned and written to the shared checkpoint folder, because two runs of a
    range partitioner may cut at different values. Then each partition ranks its own rows and a
    table with one row per partition gives the offsets.
    """
    count = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = checkpointed(df.repartitionByRange(count, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__rows"))
    # one row per partition, so this window is as small as the number of partitions
    offsets = sizes.withColumn(
        "__offset", F.sum("__rows").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    ).drop("__rows")
    inside = Window.partitionBy("__part").orderBy(*order)
    out = ranged.withColumn("__rank", F.row_number().over(inside)).join(F.broadcast(offsets), "__part")
    return out.withColumn(into, F.coalesce("__offset", F.lit(0)) + F.col("__rank") - 1).drop("__rank", "__offset")


def page(df: DataFrame, order: list, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page of an ordered list; Spark keeps only ``skip + limit`` rows per task."""
    return df.orderBy(*order).offset(skip).limit(limit)
