"""Tenant-scoped stock lists and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .ordering import page

PRIVATE_COLUMNS = ("unit_cost_inr", "total_value_inr", "po_no")
SEARCH_COLUMNS = ("sku_code", "description", "oil_material_code", "indian_standard", "standard", "metallurgy")
CRORE = 1e7
ALL = "ALL"


def is_surplus(status: Column | None = None, flag: Column | None = None) -> Column:
    status = F.col("status") if status is None else status
    flag = F.col("is_broadcasted_surplus") if flag is None else flag
    return F.coalesce(status == "IDLE_SURPLUS", F.lit(False)) | F.coalesce(flag, F.lit(False))


def is_any_surplus() -> Column:
    """The wider surplus test of the network view."""
    return is_surplus() | F.coalesce(F.col("status").isin("SURPLUS_DECLARED", "POTENTIAL_SURPLUS"), F.lit(False))


def needs_review() -> Column:
    return F.coalesce(F.col("status") == "HITL_REVIEW", F.lit(False)) | F.coalesce(F.col("days_idle") >= 90, F.lit(False))


def masked(df: DataFrame, requester: str | Column) -> DataFrame:
    """Hide prices and order numbers of other tenants."""
    requester = requester if isinstance(requester, Column) else F.lit(requester)
    return df.withColumns(
        {c: F.when(F.col("cpse") == requester, F.col(c)) for c in PRIVATE_COLUMNS if c in df.columns}
    )


def tenant_items(df: DataFrame, cpse: str, depot: str = ALL, status: str = ALL, item_type: str = ALL) -> DataFrame:
    out = df.filter(F.col("cpse") == cpse)
    for column, value in (("depot_id", depot), ("status", status), ("item_type", item_type)):
        if value and value != ALL:
            out = out.filter(F.col(column) == value)
    return out


def tenant_page(df: DataFrame, cpse: str, skip: int = 0, limit: int = 100, **filters) -> DataFrame:
    """One page of a tenant's items, with the total beside each row."""
    items = tenant_items(df, cpse, **filters)
    total = items.agg(F.count("*").alias("total"))  # one row
    return page(masked(items, cpse), ["sku_code"], skip, limit).crossJoin(F.broadcast(total))


def item(df: DataFrame, cpse: str, sku: str) -> DataFrame:
    return masked(df.filter((F.col("cpse") == cpse) & (F.col("sku_code") == sku)), cpse)


def item_properties(df: DataFrame, cpse: str, sku: str | None = None) -> DataFrame:
    """Property columns of one item (or of all the tenant's items) as a struct."""
    names = ("item_type", "size_nb_mm", "pressure_class", "schedule", "metallurgy", "facing_end", "standard", "heat_no")
    out = df.filter(F.col("cpse") == cpse)
    if sku is not None:
        out = out.filter(F.col("sku_code") == sku)
    fields = [F.col(n) for n in names if n in df.columns]
    bag = F.col("props") if "props" in df.columns else F.create_map().cast("map<string,string>")
    return out.select("sku_code", "cpse", F.struct(*fields, bag.alias("extended_properties")).alias("properties"))


def surplus_radar(df: DataFrame, cpse: str) -> DataFrame:
    """Surplus of all other tenants, prices hidden."""
    return df.filter(is_surplus() & (F.col("cpse") != cpse)).drop(*PRIVATE_COLUMNS)


def review_list(df: DataFrame, cpse: str) -> DataFrame:
    return df.filter((F.col("cpse") == cpse) & needs_review())


def depot_surplus(df: DataFrame, cpse: str, depot: str) -> DataFrame:
    return df.filter((F.col("cpse") == cpse) & (F.col("depot_id") == depot) & is_surplus()).select(
        "sku_code", "description", "item_type", "quantity", "days_idle"
    )


def discover_surplus(
    df: DataFrame, cpse: str, item_type: str | None = None, max_distance_km: float | None = None, limit: int | None = None, compat_limit_first: bool = False
) -> DataFrame:
    """Surplus items of a tenant with distance, within the optional distance; then perhaps the first ``limit`` by SKU.

    ``compat_limit_first`` takes the limit before the distance cut, as the original does, and so misses items near by.
    """
    found = df.filter((F.col("cpse") == cpse) & is_surplus())
    if item_type and item_type != ALL:
        found = found.filter(F.col("item_type") == item_type)
    if limit is not None and compat_limit_first:
        found = page(found, ["sku_code"], 0, limit)
    place = F.coalesce(F.nullif("depot_location", F.lit("")), F.nullif("depot_id", F.lit("")), F.lit("Panipat"))
    target = geo.named_point(place, default=geo.point(geo.CENTRAL))
    found = found.withColumn("__km", geo.road_km(geo.point(geo.PANIPAT), target))
    if max_distance_km:
        found = found.filter(F.col("__km") <= max_distance_km)
    if limit is not None and not compat_limit_first:
        found = page(found, ["sku_code"], 0, limit)
    return masked(found, cpse).withColumns(
        {
            "distance_km": F.round("__km", 1),
            "transit_hours": F.round(geo.transit_hours(F.col("__km")), 1),
            "co2_saved_kg": F.round(geo.co2_saved(F.col("__km")), 1),
        }
    ).drop("__km")


def search(df: DataFrame, text: str, columns=SEARCH_COLUMNS) -> DataFrame:
    """Rows with the text in any of the columns, ignoring case; a blank text keeps all."""
    wanted = text.lower()
    if not wanted.strip():
        return df
    hit = F.lit(False)
    for name in columns:
        if name in df.columns:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(name)), F.lit(wanted)), F.lit(False))
    return df.filter(hit)


def locate_spares(df: DataFrame, canonical_id: str, cpse: str, minimum_idle_days: int = 30) -> DataFrame:
    """Idle items of other tenants under one canonical id."""
    return df.filter(
        (F.col("canonical_id") == canonical_id) & (F.col("cpse") != cpse) & (F.col("days_idle") >= minimum_idle_days)
    ).drop(*PRIVATE_COLUMNS)


def key_figures(items: DataFrame, requisitions: DataFrame, cpse: str | None = None) -> DataFrame:
    """Counts and capital per tenant, in one pass over each table."""
    own = items if cpse is None else items.filter(F.col("cpse") == cpse)
    figures = own.groupBy("cpse").agg(
        F.count("*").alias("total_items"),
        F.count_if(is_surplus()).alias("total_surplus"),
        F.count_if(needs_review()).alias("total_hitl"),
        F.coalesce(F.sum(F.when(is_surplus(), F.col("total_value_inr"))), F.lit(0.0)).alias("capital_inr"),
    )
    sides = F.array_distinct(F.array("source_cpse", "target_cpse"))
    orders = requisitions.select(F.explode_outer(sides).alias("cpse")).groupBy("cpse").agg(F.count("*").alias("total_requisitions"))
    return figures.join(orders, "cpse", "left").select(
        "cpse", "total_items", "total_surplus", "total_hitl",
        F.coalesce("total_requisitions", F.lit(0)).alias("total_requisitions"),
        F.round(F.col("capital_inr") / CRORE, 2).alias("capital_unlocked_cr"),
    )


def by_tenant(items: DataFrame) -> DataFrame:
    return items.groupBy("cpse").agg(
        F.count("*").alias("items"),
        F.round(F.coalesce(F.sum("total_value_inr"), F.lit(0.0)) / CRORE, 2).alias("total_value_cr"),
    )


def by_category(items: DataFrame) -> DataFrame:
    return items.groupBy("cpse", F.col("item_type").alias("category")).agg(F.count("*").alias("items"))


def tenant_topology(items: DataFrame) -> DataFrame:
    return items.groupBy("cpse").agg(
        F.count("*").alias("total_items"),
        F.count_if(is_any_surplus()).alias("surplus_items"),
        F.round(F.coalesce(F.sum("total_value_inr"), F.lit(0.0)) / CRORE, 2).alias("total_value_cr"),
    )


def depot_topology(items: DataFrame) -> DataFrame:
    """Depots with coordinates, map position and counts."""
    rows = items.groupBy("depot_id", "depot_location", "cpse").agg(
        F.count("*").alias("items_count"),
        F.count_if(is_any_surplus()).alias("surplus_count"),
        F.round(F.coalesce(F.sum("total_value_inr"), F.lit(0.0)) / CRORE, 2).alias("unlocked_value_cr"),
    )
    point = geo.named_point(F.col("depot_location"), F.col("depot_id"), default=geo.point(geo.CENTRAL))
    rows = rows.withColumn("__p", point)
    spot = geo.map_position(F.col("__p.lat"), F.col("__p.lon"))
    location = F.coalesce("depot_location", F.lit(""))
    name = F.concat(F.col("cpse"), F.lit(" "), F.when(location != "", F.initcap(location)).otherwise(F.col("depot_id")))
    return rows.select(
        "depot_id", name.alias("name"), "cpse", location.alias("location"),
        F.col("__p.lat").alias("latitude"), F.col("__p.lon").alias("longitude"),
        spot["x"].alias("map_x"), spot["y"].alias("map_y"),
        "items_count", "surplus_count", "unlocked_value_cr",
    )


def network_totals(depots: DataFrame) -> DataFrame:
    """Totals over the depots of each tenant."""
    return depots.groupBy("cpse").agg(
        F.count("*").alias("total_depots"),
        F.sum("items_count").alias("total_items"),
        F.sum("surplus_count").alias("total_surplus_items"),
        F.round(F.sum("unlocked_value_cr"), 2).alias("total_unlocked_value_cr"),
    )


