"""Sources and sinks: derived tables written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, training
from ..sources import readers, writers
from . import oracle_views as O
from . import views as V
from .flow_queries import labelled
from .registry import query
from .stock_queries import raw_catalog
from .stream_queries import scratch


@query("s1_catalog_csv", O.sql("inventory", "SELECT sku_code, cpse, description, size_nb_mm, quantity, unit_cost_inr, status FROM inventory"))
def catalog_csv(spark, sf_dir):
    path = scratch(spark, "catalog")
    writers.write_csv(raw_catalog(spark, sf_dir), path)
    out = catalog.canonical_rows(readers.catalog_csv(spark, path))
    return out.select("sku_code", "cpse", "description", "size_nb_mm", "quantity", "unit_cost_inr", "status")


@query("k1_rewritten_catalog", O.sql("inventory", "SELECT sku_code, cpse, CAST(days_idle AS VARCHAR) AS days_idle, status FROM inventory"))
def rewritten(spark, sf_dir):
    source, target = scratch(spark, "raw"), scratch(spark, "normal")
    # plain text would take several times the space of the tables, twice
    writers.write_csv(raw_catalog(spark, sf_dir), source, compression="gzip")
    writers.rewrite_catalog(catalog.normalize_catalog(readers.catalog_csv(spark, source)), target, source, compression="gzip")
    return readers.catalog_csv(spark, target).select("sku_code", "cpse", "days_idle", "status")


@query("k8_csv_round_trip", "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, lang FROM documents")
def round_trip(spark, sf_dir):
    path = scratch(spark, "rows")
    writers.write_csv(V.table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path)
    return readers.catalog_csv(spark, path).select("doc_id", F.md5("text").alias("text_md5"), "lang")


@query("k5_json_lines", "SELECT doc_id, md5(text) AS text_md5 FROM documents")
def json_lines(spark, sf_dir):
    path = scratch(spark, "lines")
    writers.write_json_lines(V.table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return readers.json_lines(spark, path, "doc_id long, text string").select("doc_id", F.md5("text").alias("text_md5"))


@query("k4_training_pairs", O.sql("", "SELECT label, count(*) AS pairs, round(sum(dim_cosine), 6) AS dim FROM (SELECT quality AS label, doc_id % 7 / 7.0::DOUBLE AS dim_cosine FROM labels) GROUP BY label"))
def training_pairs(spark, sf_dir):
    path = scratch(spark, "pairs")
    rows = labelled(spark, sf_dir).select(
        F.lit("q").alias("query"), F.lit("c").alias("candidate"), F.lit(0.5).alias("cosine"), (F.pmod("row_id", F.lit(7)) / 7.0).alias("dim_cosine"),
        *[F.lit(0.1).alias(f"{d}_cosine") for d in ("met", "pt", "std")], "label",
    )
    writers.write_pairs(rows, path)
    back = readers.training_pairs(spark, path)
    return back.groupBy("label").agg(F.count("*").alias("pairs"), F.round(F.sum("dim_cosine"), 6).alias("dim"))


@query("k6_published_vectors", "SELECT 'CAN-' || vec_id AS canonical_id, label, true AS named FROM embeddings")
def published(spark, sf_dir):
    rows = V.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("CAN-"), F.col("vec_id").cast("string")).alias("canonical_id"), "embedding", "label")
    writers.publish_vectors(rows, scratch(spark, "vectors"), "sparemesh_vectors")
    shape = F.col("point_id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-5[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return spark.table("sparemesh_vectors").select("canonical_id", "label", shape.alias("named"))


@query("s4_taxonomy_csv", O.sql("parts", "SELECT m.unspsc_code AS code, count(*) AS parts FROM parts JOIN (" + O.rows("i, unspsc_code", [(i, t[5]) for i, t in enumerate(training.MASTER_TYPES)]) + ") m ON m.i = p_partkey % 8 GROUP BY 1"))
def taxonomy_csv(spark, sf_dir):
    path = scratch(spark, "taxonomy")
    training.commodities(spark).coalesce(1).write.option("header", True).csv(path)
    tree = readers.taxonomy_csv(spark, path, "commodities")
    codes = V.pick(F.col("p_partkey"), tuple(t[5] for t in training.MASTER_TYPES))
    return V.parts(spark, sf_dir).select(codes.alias("code")).join(tree, "code").groupBy("code").agg(F.count("*").alias("parts"))
