"""Inventory lists, roll-ups, logistics and catalog intake."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import catalog, graph, inventory as inv, requisitions as rq
from . import oracle_views as O
from . import views as V
from .registry import query

SURPLUS = "(status = 'IDLE_SURPLUS' OR is_broadcasted_surplus)"
WIDE_SURPLUS = "(status IN ('IDLE_SURPLUS', 'SURPLUS_DECLARED', 'POTENTIAL_SURPLUS') OR is_broadcasted_surplus)"
LIST = "sku_code, cpse, depot_id, item_type, quantity, unit_cost_inr, po_no, days_idle, status"
LIST_COLUMNS = LIST.split(", ")
P_LAT, P_LON = repr(geo.PANIPAT[0]), repr(geo.PANIPAT[1])


@query("f1_tenant_page", O.sql("inventory", f"SELECT {LIST}, (SELECT count(*) FROM inventory WHERE cpse = 'T1' AND item_type = 'PIPE') AS total FROM inventory WHERE cpse = 'T1' AND item_type = 'PIPE' ORDER BY sku_code LIMIT 100 OFFSET 50"))
def tenant_page(spark, sf_dir):
    items = V.inventory(spark, sf_dir)
    return inv.tenant_page(items, "T1", 50, 100, item_type="PIPE").select(*LIST_COLUMNS, "total")


@query("f1_tenant_items", O.sql("inventory", f"SELECT {LIST} FROM inventory WHERE cpse = 'T1' AND depot_id = 'D6' AND status = 'SURPLUS_DECLARED'"))
def tenant_items(spark, sf_dir):
    return inv.tenant_items(V.inventory(spark, sf_dir), "T1", depot="D6", status="SURPLUS_DECLARED").select(*LIST_COLUMNS)


FIRST_SKU = "(SELECT min(sku_code) FROM inventory WHERE cpse = 'T2')"


@query("f2_item", O.sql("inventory", f"SELECT {LIST} FROM inventory WHERE cpse = 'T2' AND sku_code = {FIRST_SKU}"))
def one_item(spark, sf_dir):
    items = V.inventory(spark, sf_dir)
    first = items.filter("cpse = 'T2'").agg(F.min("sku_code")).first()[0]
    return inv.item(items, "T2", first).select(*LIST_COLUMNS)


@query("f3_surplus_radar", O.sql("inventory", f"SELECT sku_code, cpse, item_type, days_idle FROM inventory WHERE {SURPLUS} AND cpse <> 'T0'"))
def radar(spark, sf_dir):
    return inv.surplus_radar(V.inventory(spark, sf_dir), "T0").select("sku_code", "cpse", "item_type", "days_idle")


@query("f4_review_queue", O.sql("inventory", "SELECT sku_code, days_idle, status FROM inventory WHERE cpse = 'T3' AND (status = 'HITL_REVIEW' OR days_idle >= 90)"))
def review(spark, sf_dir):
    return inv.review_list(V.inventory(spark, sf_dir), "T3").select("sku_code", "days_idle", "status")


def point_sql(text, mode="first", default=geo.CENTRAL):
    texts = text if isinstance(text, list) else [text]
    return O.named_point(texts, "lat", repr(default[0]), mode), O.named_point(texts, "lon", repr(default[1]), mode)


LOC = point_sql("depot_location")


@query(
    "f5_discover_surplus",
    O.sql(
        "inventory",
        f"""SELECT sku_code, item_type, round(km, 1) AS distance_km, round(km / 40.0 + 4.0, 1) AS transit_hours,
              round(greatest(0.0, 100000.0 - km * 60.0) / 1000.0, 1) AS co2_saved_kg, unit_cost_inr
            FROM (SELECT *, {O.road_km(P_LAT, P_LON, LOC[0], LOC[1])} AS km FROM
              (SELECT * FROM inventory WHERE cpse = 'T2' AND {SURPLUS} AND item_type = 'FLANGE')) WHERE km <= 1600""",
    ),
)
def discover(spark, sf_dir):
    return inv.discover_surplus(V.inventory(spark, sf_dir), "T2", "FLANGE", 1600.0).select(
        "sku_code", "item_type", "distance_km", "transit_hours", "co2_saved_kg", "unit_cost_inr"
    )


@query("f6_depot_surplus", O.sql("inventory", f"SELECT sku_code, description, item_type, quantity, days_idle FROM inventory WHERE cpse = 'T1' AND depot_id = 'D6' AND {SURPLUS}"))
def depot_surplus(spark, sf_dir):
    return inv.depot_surplus(V.inventory(spark, sf_dir), "T1", "D6")


@query("f9_text_search", O.sql("inventory", "SELECT sku_code, description, standard, metallurgy FROM inventory WHERE contains(lower(sku_code), '316') OR contains(lower(description), '316') OR contains(lower(coalesce(indian_standard, '')), '316') OR contains(lower(coalesce(standard, '')), '316') OR contains(lower(coalesce(metallurgy, '')), '316')"))
def text_search(spark, sf_dir):
    return inv.search(V.inventory(spark, sf_dir), "316").select("sku_code", "description", "standard", "metallurgy")


@query("f14_locate_spares", O.sql("inventory", "SELECT sku_code, cpse, quantity FROM inventory WHERE canonical_id = 'CAN-77' AND cpse <> 'T1' AND days_idle >= 30"))
def locate(spark, sf_dir):
    return inv.locate_spares(V.inventory(spark, sf_dir), "CAN-77", "T1").select("sku_code", "cpse", "quantity")


@query("f17_item_properties", O.sql("inventory", "SELECT sku_code, cpse, item_type, size_nb_mm, pressure_class, metallurgy, facing_end, standard FROM inventory WHERE cpse = 'T4'"))
def properties(spark, sf_dir):
    names = ("item_type", "size_nb_mm", "pressure_class", "metallurgy", "facing_end", "standard")
    return inv.item_properties(V.inventory(spark, sf_dir), "T4").select("sku_code", "cpse", *[F.col("properties")[n].alias(n) for n in names])


@query("n13_masked_items", O.sql("inventory", "SELECT sku_code, cpse, CASE WHEN cpse = 'T1' THEN unit_cost_inr END AS unit_cost_inr, CASE WHEN cpse = 'T1' THEN po_no END AS po_no FROM inventory"))
def masked(spark, sf_dir):
    return inv.masked(V.inventory(spark, sf_dir), "T1").select("sku_code", "cpse", "unit_cost_inr", "po_no")


@query(
    "a1_key_figures",
    O.sql(
        "inventory requisitions",
        f"""SELECT i.cpse, total_items, total_surplus, total_hitl, coalesce(r.n, 0) AS total_requisitions, capital_unlocked_cr FROM
            (SELECT cpse, count(*) AS total_items, count(*) FILTER ({SURPLUS}) AS total_surplus,
               count(*) FILTER (status = 'HITL_REVIEW' OR days_idle >= 90) AS total_hitl,
               round(coalesce(sum(total_value_inr) FILTER ({SURPLUS}), 0) / 1e7, 2) AS capital_unlocked_cr FROM inventory GROUP BY cpse) i
            LEFT JOIN (SELECT cpse, count(*) AS n FROM (SELECT requisition_id, source_cpse AS cpse FROM requisitions UNION SELECT requisition_id, target_cpse FROM requisitions) GROUP BY cpse) r USING (cpse)""",
    ),
)
def key_figures(spark, sf_dir):
    return inv.key_figures(V.inventory(spark, sf_dir), V.requisitions(spark, sf_dir))


@query("a2_by_tenant", O.sql("inventory", "SELECT cpse, count(*) AS items, round(sum(total_value_inr) / 1e7, 2) AS total_value_cr FROM inventory GROUP BY cpse"))
def by_tenant(spark, sf_dir):
    return inv.by_tenant(V.inventory(spark, sf_dir))


@query("a3_by_category", O.sql("inventory", "SELECT cpse, item_type AS category, count(*) AS items FROM inventory GROUP BY ALL"))
def by_category(spark, sf_dir):
    return inv.by_category(V.inventory(spark, sf_dir))


@query("a4_tenant_topology", O.sql("inventory", f"SELECT cpse, count(*) AS total_items, count(*) FILTER ({WIDE_SURPLUS}) AS surplus_items, round(coalesce(sum(total_value_inr), 0) / 1e7, 2) AS total_value_cr FROM inventory GROUP BY cpse"))
def tenant_topology(spark, sf_dir):
    return inv.tenant_topology(V.inventory(spark, sf_dir))


BOTH = point_sql(["depot_location", "depot_id"])
DEPOTS_SQL = f"""SELECT depot_id, cpse || ' ' || depot_location AS name, cpse, depot_location AS location, lat AS latitude, lon AS longitude,
      round(greatest(10.0, least(90.0, (lon - 68.0) / 28.0 * 75.0 + 15.0)), 1) AS map_x,
      round(greatest(10.0, least(90.0, 100.0 - ((lat - 8.0) / 24.0 * 75.0 + 15.0))), 1) AS map_y, items_count, surplus_count, unlocked_value_cr
    FROM (SELECT *, {BOTH[0]} AS lat, {BOTH[1]} AS lon FROM
      (SELECT depot_id, depot_location, cpse, count(*) AS items_count, count(*) FILTER ({WIDE_SURPLUS}) AS surplus_count,
         round(coalesce(sum(total_value_inr), 0) / 1e7, 2) AS unlocked_value_cr FROM inventory GROUP BY depot_id, depot_location, cpse))"""


@query("a5_depot_topology", O.sql("inventory", f"SELECT * EXCLUDE (name), lower(name) AS name FROM ({DEPOTS_SQL})"))
def depot_topology(spark, sf_dir):
    return inv.depot_topology(V.inventory(spark, sf_dir)).withColumn("name", F.lower("name"))


@query("a6_network_totals", O.sql("inventory", f"SELECT cpse, count(*) AS total_depots, sum(items_count)::BIGINT AS total_items, sum(surplus_count)::BIGINT AS total_surplus_items, round(sum(unlocked_value_cr), 2) AS total_unlocked_value_cr FROM ({DEPOTS_SQL}) GROUP BY cpse"))
def network_totals(spark, sf_dir):
    return inv.network_totals(inv.depot_topology(V.inventory(spark, sf_dir)))


@query("n5_lifecycle", O.sql("inventory", "SELECT sku_code, status, is_broadcasted_surplus FROM inventory"))
def lifecycle(spark, sf_dir):
    return V.inventory(spark, sf_dir).select("sku_code", "status", "is_broadcasted_surplus")


def raw_catalog(spark, sf_dir):
    """Stock under the headers of a foreign catalog."""
    return V.inventory(spark, sf_dir).select(
        F.col("sku_code").alias("Local_Code"), F.concat(F.lit(" "), F.lower("cpse")).alias("Organization"),
        F.col("depot_location").alias("depot_location"), F.col("description").alias("Item_Description"),
        F.col("size_nb_mm").cast("string").alias("Nominal_Bore_mm"), F.when(F.col("pressure_class") != 900, F.col("pressure_class").cast("string")).alias("Class"),
        F.col("metallurgy").alias("Grade"), F.col("quantity").cast("string").alias("quantity"), F.col("unit_cost_inr").cast("string").alias("unit_cost_inr"),
        F.col("days_idle").cast("string").alias("Idle_Days"), F.col("po_no").alias("Vendor_Ref"),
    )


DEPOT_ID = "cpse || '_' || upper(replace(trim(split_part(depot_location, ',', 1)), ' ', '_'))"


@query(
    "n3_canonical_rows",
    O.sql(
        "inventory",
        f"""SELECT sku_code, cpse, {DEPOT_ID} AS depot_id, description, size_nb_mm, CASE WHEN pressure_class <> 900 THEN pressure_class END AS pressure_class,
              metallurgy, quantity, unit_cost_inr, days_idle, status, is_broadcasted_surplus, po_no AS vendor_ref FROM inventory""",
    ),
)
def canonical_rows(spark, sf_dir):
    names = ("sku_code", "cpse", "depot_id", "description", "size_nb_mm", "pressure_class", "metallurgy", "quantity", "unit_cost_inr", "days_idle", "status", "is_broadcasted_surplus")
    return catalog.canonical_rows(raw_catalog(spark, sf_dir)).select(*names, F.col("properties")["vendor_ref"].alias("vendor_ref"))


@query(
    "n1_normalize_catalog",
    O.sql(
        "inventory",
        f"""SELECT sku_code, cpse, depot_location, description, CAST(size_nb_mm AS VARCHAR) AS size_nb_mm, CASE WHEN pressure_class <> 900 THEN CAST(pressure_class AS VARCHAR) END AS pressure_class,
              metallurgy, CAST(days_idle AS VARCHAR) AS days_idle, {DEPOT_ID} AS depot_id, status, is_broadcasted_surplus FROM inventory""",
    ),
)
def normalize_catalog(spark, sf_dir):
    raw = raw_catalog(spark, sf_dir).withColumn("mesc_code", F.lit("old")).withColumn("oil_material_code", F.lit("new"))
    out = catalog.normalize_catalog(raw)
    assert "mesc_code" not in out.columns and "oil_material_code" in out.columns
    return out.select("sku_code", "cpse", "depot_location", "description", "size_nb_mm", "pressure_class", "metallurgy", "days_idle", "depot_id", "status", "is_broadcasted_surplus")


@query("n4_depot_ids", O.sql("inventory", f"SELECT DISTINCT cpse, depot_location, {DEPOT_ID} AS depot_id FROM inventory"))
def depot_ids(spark, sf_dir):
    items = V.inventory(spark, sf_dir)
    return items.select("cpse", "depot_location", catalog.depot_id_of(F.col("cpse"), F.col("depot_location")).alias("depot_id")).distinct()


def upload(spark, sf_dir):
    """Stock as an uploaded file: repeated, blank and unreadable rows."""
    rows = V.inventory(spark, sf_dir)
    number = F.regexp_extract("sku_code", r"-(\d+)-", 1).cast("long")
    other = F.regexp_extract("sku_code", r"-(\d+)$", 1).cast("long")
    rows = rows.withColumns({"k": number, "s": other})
    return rows.select(
        (F.col("k") * 1_000_000 + F.col("s")).alias("row_id"),
        F.when(F.pmod("k", F.lit(17)) == 3, F.lit("")).otherwise(F.concat(F.lit("UP-"), F.floor(F.col("k") / 2).cast("long").cast("string"))).alias("SKU_Code"),
        "depot_location", "description", F.lower("item_type").alias("item_type"), F.col("size_nb_mm").cast("string").alias("size_nb_mm"),
        F.when(F.pmod("k", F.lit(13)) == 5, F.lit("many")).otherwise(F.col("quantity").cast("string")).alias("available_qty"),
        F.col("days_idle").cast("string").alias("days_idle"), F.col("unit_cost_inr").cast("string").alias("unit_cost_inr"), F.col("k"),
    )


UPLOAD = """SELECT k * 1000000 + s AS row_id, CASE WHEN k % 17 = 3 THEN '' ELSE 'UP-' || (k // 2) END AS sku, depot_location, description, upper(item_type) AS item_type, size_nb_mm,
      CASE WHEN k % 13 = 5 THEN NULL ELSE quantity END AS quantity, days_idle, unit_cost_inr, k
    FROM (SELECT *, CAST(split_part(sku_code, '-', 2) AS BIGINT) AS k, CAST(split_part(sku_code, '-', 3) AS BIGINT) AS s FROM inventory)"""
LEDGER = "SELECT 'UP-' || p_partkey AS sku FROM part WHERE p_type = 'PROMO'"


def stored(spark, sf_dir):
    """SKUs that are in the ledger already: those of one part type."""
    p = V.table(spark, sf_dir, "part").filter("p_type = 'PROMO'")
    return p.select(F.concat(F.lit("UP-"), F.col("p_partkey").cast("string")).alias("sku_code"))


@query(
    "n6_intake_rows",
    O.sql(
        "inventory",
        """SELECT row_id, nullif(sku, '') AS sku_code, 'T9' AS cpse, 'DEFAULT_DEPOT' AS depot_id, item_type, quantity, days_idle,
             CASE WHEN days_idle >= 90 THEN 'SURPLUS' ELSE 'ACTIVE' END AS status, CASE WHEN quantity IS NULL THEN 'available_qty' END AS error FROM upload""",
        upload=UPLOAD,
    ),
)
def intake(spark, sf_dir):
    return catalog.intake_rows(upload(spark, sf_dir), "t9").select(
        "row_id", "sku_code", "cpse", "depot_id", "item_type", "quantity", "days_idle", "status", "error"
    )


@query(
    "k2_new_rows",
    O.sql(
        "inventory",
        """SELECT sku AS sku_code, row_id, quantity FROM (SELECT *, row_number() OVER (PARTITION BY sku ORDER BY row_id) AS n FROM upload WHERE sku <> '' AND quantity IS NOT NULL)
           WHERE n = 1 AND sku NOT IN (SELECT sku FROM stored)""",
        upload=UPLOAD, stored=LEDGER,
    ),
)
def new_rows(spark, sf_dir):
    rows = catalog.intake_rows(upload(spark, sf_dir), "T9")
    return catalog.new_rows(rows, stored(spark, sf_dir)).select("sku_code", "row_id", "quantity")


@query(
    "k2_intake_counts",
    O.sql(
        "inventory",
        """SELECT count(*) AS rows_processed, count(*) FILTER (sku <> '' AND quantity IS NULL) AS errors_count,
             (SELECT count(DISTINCT sku) FROM upload WHERE sku <> '' AND quantity IS NOT NULL AND sku NOT IN (SELECT sku FROM stored)) AS imported_count FROM upload""",
        upload=UPLOAD, stored=LEDGER,
    ),
)
def intake_counts(spark, sf_dir):
    rows = catalog.intake_rows(upload(spark, sf_dir), "T9")
    return catalog.intake_counts(rows, catalog.new_rows(rows, stored(spark, sf_dir)))


@query("u3_absent_skus", O.sql("", "SELECT 'UP-' || p_partkey AS sku_code FROM part WHERE p_type <> 'PROMO'"))
def absent(spark, sf_dir):
    p = V.table(spark, sf_dir, "part").select(F.concat(F.lit("UP-"), F.col("p_partkey").cast("string")).alias("sku_code"))
    return p.join(stored(spark, sf_dir), "sku_code", "left_anti")


@query("n7_foreign_tenants", O.sql("inventory", "SELECT DISTINCT cpse FROM inventory WHERE cpse <> 'T1'"))
def foreign(spark, sf_dir):
    return catalog.foreign_tenants(V.inventory(spark, sf_dir), " t1")


def doubtful(spark, sf_dir):
    k = F.regexp_extract("sku_code", r"-(\d+)-", 1).cast("long")
    rows = V.inventory(spark, sf_dir).withColumn("k", k)
    return rows.withColumns(
        {
            "quantity": F.when(F.pmod("k", F.lit(10)) == 0, -F.col("quantity")).otherwise(F.col("quantity")),
            "unit_cost_inr": F.when(F.pmod("k", F.lit(11)) == 0, F.lit(-1.0)).otherwise(F.col("unit_cost_inr")),
            "cpse": F.when(F.pmod("k", F.lit(12)) == 0, F.lit(" ")).when(F.pmod("k", F.lit(12)) == 1, F.lit("oil")).otherwise(F.col("cpse")),
            "description": F.when(F.pmod("k", F.lit(9)) != 0, F.col("description")),
        }
    )


DOUBT = """SELECT sku_code, k % 10 = 0 AND quantity > 0 AS a, k % 11 = 0 AS b, k % 12 = 0 AS c, k % 12 <> 1 AND cpse NOT IN ('T1', 'T2') OR k % 12 = 0 AS d, k % 9 = 0 AS e
    FROM (SELECT *, CAST(split_part(sku_code, '-', 2) AS BIGINT) AS k FROM inventory)"""
KNOWN = ("T1", "T2", "OIL")


@query("n8_conformance", O.sql("inventory", "SELECT count(*) AS total_rows, count(*) FILTER (a OR b OR c OR d OR e) AS rejected_rows, 0 AS missing_sku_code, 0 AS missing_cpse, 0 AS missing_depot_location, count(*) FILTER (e) AS missing_description, 0 AS missing_quantity, 0 AS missing_unit_cost_inr, count(*) FILTER (c) AS blank_cpse, count(*) FILTER (a) AS negative_quantity, count(*) FILTER (b) AS negative_unit_cost, count(*) FILTER (d) AS unknown_cpse FROM doubt", doubt=DOUBT))
def conformance(spark, sf_dir):
    return catalog.conformance_report(doubtful(spark, sf_dir), KNOWN)


@query("n8_rejected_rows", O.sql("inventory", "SELECT sku_code, concat_ws(',', CASE WHEN e THEN 'missing_description' END, CASE WHEN c THEN 'blank_cpse' END, CASE WHEN a THEN 'negative_quantity' END, CASE WHEN b THEN 'negative_unit_cost' END, CASE WHEN d THEN 'unknown_cpse' END) AS failed FROM doubt WHERE a OR b OR c OR d OR e", doubt=DOUBT))
def rejected(spark, sf_dir):
    return catalog.rejected_rows(doubtful(spark, sf_dir), KNOWN).select("sku_code", F.array_join("failed_checks", ",").alias("failed"))


# ---- logistics ---------------------------------------------------------------------------------------

ROUTES = "SELECT DISTINCT source_depot AS source, target_depot AS target FROM requisitions"
SRC, DST = point_sql("source", "last", geo.PANIPAT), point_sql("target", "last", geo.VISAKH)


@query(
    "g6_route_logistics",
    O.sql(
        "requisitions",
        f"""SELECT source, target, round(km, 1) AS distance_km, round(km / 40.0 + 4.0, 1) AS transit_hours, round(greatest(0.0, 100000.0 - km * 60.0) / 1000.0, 1) AS co2_saved_kg,
              round(km * 5.0, 2) AS estimated_freight_inr FROM (SELECT *, {O.road_km(SRC[0], SRC[1], DST[0], DST[1])} AS km FROM routes)""",
        routes=ROUTES,
    ),
)
def route_logistics(spark, sf_dir):
    r = V.requisitions(spark, sf_dir)
    return graph.route_logistics(r.select(F.col("source_depot").alias("source"), F.col("target_depot").alias("target")).distinct())


@query(
    "g5_route_summary",
    O.sql(
        "requisitions depots",
        f"""SELECT requisition_id, source, target, weight_kg, round(km, 2) AS road_distance_km, round(km / 40.0 + 4.0, 2) AS estimated_transit_hours,
              round(km * (weight_kg / 1000.0) * 5.0, 2) AS estimated_freight_cost_inr, round(greatest(0.0, 100000.0 - km * 60.0) / 1000.0 * (weight_kg / 1000.0), 2) AS co2_saved_kg
            FROM (SELECT r.*, {O.road_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM r JOIN depots a ON a.name = source JOIN depots b ON b.name = target)""",
        r="SELECT requisition_id, replace(split_part(source_depot, ',', 1), ' Depot', '') AS source, replace(target_depot, ' Works', '') AS target, required_qty * 25.0::DOUBLE AS weight_kg FROM requisitions",
    ),
)
def route_summary(spark, sf_dir):
    r = V.requisitions(spark, sf_dir)
    return graph.route_summary(
        r.select(
            "requisition_id", F.regexp_replace(F.split("source_depot", ",")[0], " Depot", "").alias("source"),
            F.regexp_replace("target_depot", " Works", "").alias("target"), (F.col("required_qty") * 25.0).alias("weight_kg"),
        )
    )


@query(
    "g1_haversine_sites",
    O.sql(
        "sites depots",
        f"""SELECT s_suppkey, d.name AS depot, {O.road_km('d.lat', 'd.lon', P_LAT, P_LON)} / 1.28 AS haversine_km, {O.road_km('d.lat', 'd.lon', P_LAT, P_LON)} AS road_km
            FROM sites JOIN depots d ON split_part(depot_location, ' Depot', 1) = d.name""",
    ),
)
def haversine_sites(spark, sf_dir):
    sites = V.sites(spark, sf_dir).withColumn("name", F.regexp_extract("depot_location", r"^(.*?) Depot", 1))
    d = geo.depots(spark).drop("ord")
    here = geo.point(geo.PANIPAT)
    return sites.join(F.broadcast(d), "name").select(
        "s_suppkey", F.col("name").alias("depot"),
        geo.haversine(F.col("lat"), F.col("lon"), here["lat"], here["lon"]).alias("haversine_km"),
        geo.road_km(F.struct("lat", "lon"), here).alias("road_km"),
    )


@query(
    "w3_nearest_depots",
    O.sql(
        "sites depots",
        f"""SELECT near_depot_id, rank, count(*) AS sites, min(round(distance_km, 6)) AS distance_km, n.depot_id FROM
            (SELECT a.name AS depot_id, b.name AS near_depot_id, {O.road_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS distance_km,
               row_number() OVER (PARTITION BY a.name ORDER BY {O.road_km('a.lat', 'a.lon', 'b.lat', 'b.lon')}, b.ord) AS rank FROM depots a JOIN depots b ON a.name <> b.name) n
            JOIN sites ON split_part(depot_location, ' Depot', 1) = n.depot_id WHERE rank <= 5 GROUP BY ALL""",
    ),
)
def nearest(spark, sf_dir):
    near = graph.nearest_depots(spark, 5)
    sites = V.sites(spark, sf_dir).select(F.regexp_extract("depot_location", r"^(.*?) Depot", 1).alias("depot_id"))
    return sites.join(F.broadcast(near), "depot_id").groupBy("depot_id", "near_depot_id", "rank").agg(
        F.count("*").alias("sites"), F.min(F.round("distance_km", 6)).alias("distance_km")
    )


FIRST = point_sql("target_depot", "first")
LAST = point_sql("target_depot", "last")


@query(
    "j9_depot_points",
    O.sql("requisitions", f"SELECT DISTINCT target_depot, {FIRST[0]} AS first_lat, {FIRST[1]} AS first_lon, {LAST[0]} AS last_lat, {LAST[1]} AS last_lon FROM requisitions"),
)
def depot_points(spark, sf_dir):
    t = F.col("target_depot")
    a = geo.named_point(t, default=geo.point(geo.CENTRAL))
    b = geo.named_point(t, mode="last", default=geo.point(geo.CENTRAL))
    return V.requisitions(spark, sf_dir).select(
        t, a["lat"].alias("first_lat"), a["lon"].alias("first_lon"), b["lat"].alias("last_lat"), b["lon"].alias("last_lon")
    ).distinct()


@query(
    "g6_corridor_stock",
    O.sql(
        "inventory depots",
        f"""SELECT source, target, name, distance_km, transit_hours, co2_saved_kg, status, (SELECT count(*) FROM inventory WHERE split_part(depot_location, ' Depot', 1) = source) AS source_items FROM
            (SELECT c.*, round(km, 1) AS distance_km, round(km / 40.0 + 4.0, 1) AS transit_hours, round(greatest(0.0, 100000.0 - km * 60.0) / 1000.0, 1) AS co2_saved_kg, 'OPERATIONAL' AS status
             FROM (SELECT c.*, {O.road_km('a.lat', 'a.lon', 'b.lat', 'b.lon')} AS km FROM corridors c JOIN depots a ON a.name = source JOIN depots b ON b.name = target) c)""",
        corridors=O.rows("source, target, name", geo.CORRIDORS),
    ).replace("SELECT c.*, round(km, 1)", "SELECT source, target, name, round(km, 1)"),
)
def corridor_stock(spark, sf_dir):
    stock = V.inventory(spark, sf_dir).groupBy(F.regexp_extract("depot_location", r"^(.*?) Depot", 1).alias("source")).agg(F.count("*").alias("source_items"))
    return graph.corridors(spark).join(stock, "source", "left").withColumn("source_items", F.coalesce("source_items", F.lit(0)))


# ---- requisitions ------------------------------------------------------------------------------------

REQ = "requisition_id, sku_code, source_cpse, target_cpse, source_depot, target_depot, required_qty, status"
REQ_COLUMNS = REQ.split(", ")


@query("f7_requisitions", O.sql("requisitions", f"SELECT {REQ} FROM requisitions WHERE (source_cpse = 'T1' OR target_cpse = 'T1') AND (source_depot ILIKE '%guwahati%' OR target_depot ILIKE '%guwahati%')"))
def requisition_list(spark, sf_dir):
    return rq.newest_first(rq.listed(V.requisitions(spark, sf_dir), "T1", "guwahati")).select(*REQ_COLUMNS)


@query("w4_newest_requisitions", O.sql("requisitions", f"SELECT {REQ} FROM requisitions ORDER BY created_at DESC, requisition_id DESC LIMIT 50 OFFSET 20"))
def newest(spark, sf_dir):
    return rq.newest_first(V.requisitions(spark, sf_dir)).select(*REQ_COLUMNS).offset(20).limit(50)


@query("f8_visible_for_user", O.sql("requisitions", f"SELECT {REQ} FROM requisitions WHERE requested_by = 'user-7' OR contains(lower(source_depot), 'oil moran') OR source_cpse = 'T3'"))
def visible_one(spark, sf_dir):
    return rq.visible_for_user(V.requisitions(spark, sf_dir), "user-7", "T3", "OIL Moran").select(*REQ_COLUMNS)


@query("f8_visible_counts", O.sql("requisitions users", "SELECT username, count(*) AS requisitions FROM requisitions r JOIN users u ON r.requested_by = u.username OR contains(lower(r.source_depot), lower(u.depot_id)) OR r.source_cpse = u.cpse GROUP BY username"))
def visible_many(spark, sf_dir):
    return rq.visible_counts(V.requisitions(spark, sf_dir), V.users(spark, sf_dir))


@query("f10_incoming_pending", O.sql("requisitions", f"SELECT {REQ} FROM requisitions WHERE (source_cpse = 'T2' OR contains(lower(source_depot), 'jorhat')) AND upper(status) IN ('PENDING_APPROVAL', 'REQUESTED') AND (contains(lower(sku_code), '-1') OR contains(lower(requisition_id), '-1') OR contains(lower(source_cpse), '-1') OR contains(lower(target_cpse), '-1') OR contains(lower(source_depot), '-1') OR contains(lower(target_depot), '-1') OR contains(lower(requested_by), '-1'))"))
def incoming_pending(spark, sf_dir):
    rows = rq.in_scope(V.requisitions(spark, sf_dir), "INCOMING", "user-1", "T2", "Jorhat")
    return rq.searched(rq.with_status(rows, "PENDING"), " -1 ").select(*REQ_COLUMNS)


@query("f10_outgoing", O.sql("requisitions", f"SELECT {REQ} FROM requisitions WHERE requested_by = 'user-1' OR target_cpse = 'T2'"))
def outgoing(spark, sf_dir):
    return rq.in_scope(V.requisitions(spark, sf_dir), "OUTGOING", "user-1", "T2").select(*REQ_COLUMNS)


@query("f18_pending_approvals", O.sql("requisitions", f"SELECT {REQ} FROM requisitions WHERE status IN ('PENDING_APPROVAL', 'REQUESTED')"))
def pending(spark, sf_dir):
    return rq.pending(V.requisitions(spark, sf_dir)).select(*REQ_COLUMNS)


@query("a11_tab_counts", O.sql("requisitions", "SELECT count(*) FILTER (requested_by = 'user-1' OR target_cpse = 'T2') AS outgoing, count(*) FILTER (source_cpse = 'T2' OR contains(lower(source_depot), 'jorhat')) AS incoming FROM requisitions"))
def tabs(spark, sf_dir):
    return rq.tab_counts(V.requisitions(spark, sf_dir), "user-1", "T2", "Jorhat")


@query("j5_item_certificates", O.sql("inventory certificates", "SELECT sku_code, doc_id, grade FROM (SELECT *, CAST(split_part(sku_code, '-', 2) AS BIGINT) AS k FROM inventory) LEFT JOIN certificates ON doc_id = k * 2"))
def item_certificates(spark, sf_dir):
    docs = V.certificates(spark, sf_dir).select("doc_id", "grade")
    # only half of the items have a certificate under this number
    items = V.inventory(spark, sf_dir).withColumn("mtc_document_id", F.regexp_extract("sku_code", r"-(\d+)-", 1).cast("long") * 2)
    out = rq.with_certificate(items, docs)
    return out.select("sku_code", F.when(F.col("grade").isNotNull(), F.col("mtc_document_id")).alias("doc_id"), "grade")


