"""Table and file scans."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT_TYPES = ("pdf", "png", "jpg", "jpeg", "tiff", "bmp", "webp")
MAX_DOCUMENT_BYTES = 15 * 1024 * 1024
PAIR_COLUMNS = ("query", "candidate", "cosine", "label")
GOLDEN = (
    "test_id string, expected_tier string, expected_is_compatible boolean, expected_violation_code string, target_standard string, "
    "scenario_description string, query_part struct<item_type:string,size_nb_mm:double,pressure_class:int,metallurgy:string,properties:map<string,string>>, "
    "candidate_part struct<item_type:string,size_nb_mm:double,pressure_class:int,metallurgy:string,properties:map<string,string>>"
)
SPANS = "text string, labels array<struct<start:int,end:int,label:string>>"
PAIRS_JSONL = "anchor string, positive string, negative string, canonical_id string, item_type string, size_nb_mm double, pressure_class int"
TAXONOMY = {"commodities": "code string, title string, level string, parent_code string", "categories": "category_id string, name string, parent_id string"}


class MissingColumnsError(ValueError):
    """A table lacks columns a job needs."""


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise MissingColumnsError("missing required columns: " + ", ".join(missing))
    return df


def catalog_csv(spark: SparkSession, path: str) -> DataFrame:
    """A catalog with all columns as text; types are set when the schema is canonical."""
    return spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)


def table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def jdbc_table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple | None = None, parts: int = 64, **options) -> DataFrame:
    """A database table, read in ``parts`` ranges of a numeric key when its bounds are known."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def taxonomy_csv(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """``commodities`` or ``categories``; both come out as code, title, parent_code (and level)."""
    df = spark.read.schema(TAXONOMY[kind]).option("header", True).csv(path)
    return df if kind == "commodities" else df.toDF("code", "title", "parent_code")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that holds one JSON array; such files are read whole, so large sets belong in JSON lines."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def golden_pairs(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, GOLDEN)


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def training_pairs(spark: SparkSession, path: str) -> DataFrame:
    return require(spark.read.parquet(path), PAIR_COLUMNS)


def document_bytes(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """Documents of the accepted types with 1 byte to 15 MB; without ``content`` only the listing is read.

    ``rejected_documents`` lists the other files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    kept = files.filter(kind.isin(*DOCUMENT_TYPES) & F.col("length").between(1, MAX_DOCUMENT_BYTES))
    columns = ["path", "length", "modificationTime", kind.alias("extension")]
    return kept.select(*columns, *(["content"] if content else []))


def rejected_documents(spark: SparkSession, path: str) -> DataFrame:
    """Files ``document_bytes`` leaves out, with the reason: TYPE or TOO_LARGE. Only the listing is read; the scan itself never lists empty files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    kind = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    reason = F.when(~kind.isin(*DOCUMENT_TYPES), "TYPE").when(F.col("length") > MAX_DOCUMENT_BYTES, "TOO_LARGE")
    return files.select("path", "length", reason.alias("reason")).filter("reason is not null")
