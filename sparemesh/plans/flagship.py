"""The flagship query: ranked substitutes of every requested part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.matching import match_requests
from . import views as V


def ranked_substitutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = match_requests(V.requests(spark, sf_dir), V.inventory(spark, sf_dir))
    return matches.select(
        "request_id", "rank", "sku_code", "cpse", "depot_id", "item_type", "size_nb_mm", "pressure_class", "metallurgy",
        "compatibility_score", "tier", "is_compatible", "violation_code", "distance_km", "transit_hours",
    )
