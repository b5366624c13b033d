"""Substring joins on equal keys."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIECE = 3


def pieces(text: Column) -> Column:
    """All distinct three-letter pieces of a text, and the empty piece."""
    last = F.length(text) - (PIECE - 1)
    found = F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(PIECE)))
    ).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(F.lit("")), found))


def anchor(needle: Column) -> Column:
    """Piece every text containing the needle must have; empty for needles shorter than a piece."""
    return F.when(F.length(needle) >= PIECE, F.substring(needle, 1, PIECE)).otherwise("")


def _piece(text: Column, size: Column, at: Column) -> Column:
    return F.substring(text, at, size)


def grams(text: Column, lengths=(PIECE,)) -> Column:
    """All distinct pieces of the given lengths (0: one empty piece)."""
    found = []
    for n in sorted(lengths):
        if n == 0:
            found.append(F.array(F.lit("")))
            continue
        last = F.length(text) - (n - 1)
        size = F.lit(n)
        cut = F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), functools.partial(_piece, text, size))
        found.append(F.when(last >= 1, cut).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*found))


def rarest_grams(needles: DataFrame, needle: str, texts: DataFrame, text: str) -> DataFrame:
    """``needles`` with ``__gram``: of the pieces of three letters of a needle the one that the fewest texts have.

    A needle of one or two letters is its own piece, an empty one the empty piece. Every text that contains the needle has the piece; a
    piece that no text has finds nothing. Counting pieces is one aggregate with map-side combine.
    """
    rows = needles.withColumn("__id", F.xxhash64(*needles.columns))
    short = F.least(F.length(needle), F.lit(PIECE))
    own = rows.select("__id", F.explode(F.when(short < PIECE, F.array(F.col(needle))).otherwise(grams(F.col(needle)))).alias("__gram")).distinct()
    held = texts.select(F.explode(grams(F.col(text))).alias("__gram")).join(own.select("__gram").distinct(), "__gram", "left_semi").groupBy("__gram").agg(F.count("*").alias("__texts"))
    picked = own.join(held, "__gram", "left").groupBy("__id").agg(F.min(F.struct(F.coalesce("__texts", F.lit(0)).alias("n"), "__gram")).alias("__best"))
    return rows.join(picked.select("__id", F.col("__best.__gram").alias("__gram")), "__id").drop("__id")


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str, on: list[str] | None = None) -> DataFrame:
    """Rows of both tables where ``text`` contains ``needle`` (and the ``on`` columns agree).

    A text meets only the needles whose rarest piece it has, so this is a shuffle join on equal keys with the substring test behind it,
    never a product of the two tables. Needles of one or two letters meet the texts on exactly those, so no key is shared by all texts but
    that of an empty needle, which every text contains. A null text or needle finds nothing.
    """
    columns = needles.columns
    held, asked = texts.where(F.col(text).isNotNull()), needles.where(F.col(needle).isNotNull())
    right = rarest_grams(asked.select(needle).distinct(), needle, held, text).select(F.col(needle).alias("__needle"), F.col("__gram").alias("__piece"))
    right = asked.join(right, F.col(needle) == F.col("__needle")).select(*columns, "__piece")
    left = held.withColumn("__piece", F.explode(grams(F.col(text), (0, 1, 2, PIECE))))
    # texts without a wanted piece end here, before their rows are shuffled with all columns
    left = left.join(right.select("__piece").distinct(), "__piece", "left_semi")
    return left.join(right, [*(on or []), "__piece"]).filter(F.contains(F.col(text), F.col(needle))).drop("__piece")
