"""Recognised text blocks and document lists."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import page

MIN_SCORE = 0.4


def confident_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.filter(F.col("score") >= MIN_SCORE)


def document_confidence(docs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Mean block score per document, zero without blocks."""
    means = blocks.groupBy("doc_id").agg(F.avg("score").alias("confidence"))
    return docs.select("doc_id").join(means, "doc_id", "left").select("doc_id", F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def document_methods(pages: DataFrame) -> DataFrame:
    """Extraction method and text of each document from its pages (doc_id, page, text, engine, source_type).

    ``engine`` is null for native text. Pages of one document are collected, which a document's own
    size bounds.
    """
    rows = pages.groupBy("doc_id").agg(
        F.collect_set("engine").alias("engines"),
        F.first("source_type").alias("source_type"),
        F.sort_array(F.collect_list(F.struct("page", "text"))).alias("pages"),
    )
    texts = F.filter(F.transform("pages", lambda p: F.regexp_replace(p["text"], r"(?U)^\s+|\s+$", "")), lambda t: t != "")
    method = (
        F.when(F.size("engines") == 0, "pymupdf")
        .when((F.col("source_type") == "pdf") | (F.size("engines") > 1), "hybrid_ocr")
        .otherwise(F.col("engines")[0])
    )
    return rows.select("doc_id", method.alias("extraction_method"), F.array_join(texts, "\n\n").alias("raw_text"), F.size("pages").alias("page_count"))


def page_regions(blocks: DataFrame, height: str = "page_height") -> DataFrame:
    """Header and body blocks of each page by vertical position."""
    region = F.when(F.col("y") <= F.col(height) * 0.2, "header").otherwise("body")
    return (
        blocks.withColumn("label", region)
        .groupBy("doc_id", "page", "label")
        .agg(F.sort_array(F.collect_list("block_no")).alias("block_indexes"))
    )


def bucket_lines(blocks: DataFrame) -> DataFrame:
    """Text of each page in rows of eight pixels, left to right inside a row."""
    entry = F.struct(F.bround(F.col("y") / 8).alias("row"), F.col("x").alias("x"), F.col("block_no").alias("n"), F.col("text").alias("text"))
    rows = confident_blocks(blocks).groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    return rows.select("doc_id", "page", F.array_join(F.transform("e", lambda e: e["text"]), "\n").alias("text"))


def _order_page(pdf: pd.DataFrame) -> pd.DataFrame:
    """Greedy row grouping of one page: rows overlap by half of the smaller height."""
    pdf = pdf.assign(__mid=(pdf["top"] + pdf["bottom"]) / 2).sort_values(["__mid", "x"], kind="stable")
    rows: list[dict] = []
    for index, block in pdf.iterrows():
        top, bottom = block["top"], block["bottom"]
        home = None
        for row in rows:
            shared = min(bottom, row["bottom"]) - max(top, row["top"])
            smaller = min(bottom - top, row["bottom"] - row["top"])
            if bottom > top and row["bottom"] > row["top"] and shared >= 0.5 * smaller:
                home = row
                break
        if home is None:
            rows.append({"top": top, "bottom": bottom, "blocks": [index]})
        else:
            home["top"], home["bottom"] = min(home["top"], top), max(home["bottom"], bottom)
            home["blocks"].append(index)
    rows.sort(key=lambda r: pdf.loc[r["blocks"], "__mid"].median())
    order = [i for r in rows for i in pdf.loc[r["blocks"]].sort_values("x", kind="stable").index]
    out = pdf.loc[order, ["doc_id", "page", "block_no", "text"]].copy()
    out["reading_position"] = range(1, len(out) + 1)
    return out


def reading_order(blocks: DataFrame) -> DataFrame:
    """Blocks of each page in reading order.

    The grouping is greedy and depends on the blocks before, so each page is one small pandas
    group; pages are independent and a page's blocks fit in memory.
    """
    return (
        blocks.select("doc_id", "page", "block_no", "text", "x", "top", "bottom")
        .groupBy("doc_id", "page")
        .applyInPandas(_order_page, "doc_id long, page int, block_no long, text string, reading_position int")
    )


def list_documents(ledger: DataFrame, skip: int = 0, limit: int = 20) -> DataFrame:
    return page(ledger.drop("raw_text"), [F.desc("doc_id")], skip, limit)


def preview(ledger: DataFrame, doc_id: int) -> DataFrame:
    """One document with the first 1,000 characters of its text."""
    return ledger.filter(F.col("doc_id") == doc_id).withColumn("raw_text_preview", F.substring("raw_text", 1, 1000)).drop("raw_text")
