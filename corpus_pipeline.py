"""The corpus pipeline: five stages from raw documents to packed windows.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparemesh.llm.common import stored
from sparemesh.llm.jaccard_join import jaccard_components
from sparemesh.llm.language_id import identify_languages
from sparemesh.llm.line_dedup import dedup_lines
from sparemesh.llm.mixing import mix_sources
from sparemesh.llm.packing import pack_documents

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def as_documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``; ``n_chars`` follows the text."""
    return df.select("doc_id", "text", "lang", "source", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"))


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a letter; ``lang`` becomes the predicted one. Null texts and texts without a letter go.

    Where nothing can be learned (no label outside the held-out fold), no language is predicted: all documents with a letter stay
    and keep their own ``lang``, null or not.
    """
    judged = identify_languages(docs.select(*COLUMNS), mark="lettered").where("lettered")
    # a prediction for a text with a letter has a score above 0, also if the label is named 'und'
    return as_documents(judged.withColumn("lang", F.when(F.col("score") > 0, F.col("lang_pred")).otherwise(F.col("lang"))))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines found in five documents stay in one of them; documents of which nothing but blanks is left go."""
    kept = dedup_lines(docs.select(*COLUMNS))
    return as_documents(kept.where(F.col("text").rlike(r"[^\x20\x09-\x0D]")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group linked by five-word shingles at a similarity of 0.8.

    Rows of one id are one document: the smallest text stays. A row without an id cannot be named by a group and stays.
    """
    groups = jaccard_components(docs.where("doc_id IS NOT NULL").select("doc_id", "text"), width=5, percent=80)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(first, "doc_id", "left_semi")
    kept = kept.withColumn("row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).where("row = 1")
    return as_documents(kept.drop("row").unionByName(docs.select(*COLUMNS).where("doc_id IS NULL")))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its sources takes it: not at all, once or twice."""
    mixed = mix_sources(docs.select(*COLUMNS), weights=(5, 2, 1), share=1.5, max_epochs=2)
    repeated = mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return as_documents(repeated)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 1,024: ids are little-endian 32-bit numbers."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), capacity=1024)


STAGES = [
    ("language ID", identify),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

# The trained network and the tokenizer cannot be written in SQL; tests hold each stage against plain recomputation.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if stage is not STAGES[-1][1]:
            docs = stored(docs, "stage-" + name.replace(" ", "-"))
    return docs
