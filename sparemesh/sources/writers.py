"""Table and file sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAIR_OUTPUT = ("query", "candidate", "cosine", "dim_cosine", "met_cosine", "pt_cosine", "std_cosine", "label")


def write_csv(df: DataFrame, path: str, byte_order_mark: bool = False, compression: str = "none") -> None:
    """Rows as CSV with a header; quotes are doubled and values with a comma, quote or line break quoted.

    The output is a folder of part files. ``byte_order_mark`` puts the mark before the first header name
    of each part, for spreadsheet programs. ``compression`` (``gzip``, ...) is for files that only jobs read.
    """
    flat = df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])
    if byte_order_mark:
        flat = flat.withColumnRenamed(flat.columns[0], "﻿" + flat.columns[0])
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("compression", compression).csv(path)


def rewrite_catalog(df: DataFrame, path: str, source: str, compression: str = "none") -> None:
    """A normalised catalog under a new path; never over the files it is read from."""
    if path.rstrip("/") == source.rstrip("/"):
        raise ValueError("the normalised catalog needs a path of its own")
    write_csv(df, path, compression=compression)


def write_pairs(df: DataFrame, path: str) -> None:
    """Training pairs in their fixed column order."""
    df.select(*PAIR_OUTPUT).write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def stable_id(column) -> F.Column:
    """Name-based UUID (version 5, URL namespace) of a canonical id, so a rebuilt row keeps its id."""
    namespace = uuid.NAMESPACE_URL.hex
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(column, "utf-8")))
    variant = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    third = F.concat(F.lit("5"), F.substring(digest, 14, 3))
    fourth = F.concat(F.lower(F.hex(variant)), F.substring(digest, 18, 3))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), third, fourth, F.substring(digest, 21, 12))


def publish_vectors(df: DataFrame, root: str, view: str, canonical_id: str = "canonical_id") -> str:
    """Write a new version of the vector table, then point the view at it: readers never see a partial one."""
    spark: SparkSession = df.sparkSession
    path = f"{root}/v={uuid.uuid4().hex}"
    df.withColumn("point_id", stable_id(F.col(canonical_id))).write.parquet(path)
    spark.read.parquet(path).createOrReplaceTempView(view)
    return path
