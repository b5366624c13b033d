"""Property graph as node and edge tables."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.values import no_zero
from ..session import checkpointed
from .textjoin import containing

NODE_KEYS = ("CPSE", "Depot", "InventoryItem", "Size", "PressureClass", "MaterialGrade", "Requisition")
# The seeded upgrade edges (better, kind, replaced).
UPGRADES = (
    ("300#", "SAFE_UPGRADE_FOR", "150#"), ("600#", "SAFE_UPGRADE_FOR", "300#"), ("CF8M", "ALLOY_UPGRADE_FOR", "WCB"),
    ("Trim 5", "TRIM_UPGRADE_FOR", "Trim 8"), ("Trim 8", "TRIM_UPGRADE_FOR", "Trim 1"),
    ("Full Bore", "PORT_UPGRADE_FOR", "Reduced Bore"),
)
EDGE = ("src_label", "src", "rel", "dst_label", "dst")


def upgrade_edges(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(UPGRADES), "src string, rel string, dst string")


def route_logistics(routes: DataFrame) -> DataFrame:
    """Distance, time, emissions and freight of one ton between two named depots."""
    source = geo.named_point(F.col("source"), mode="last", default=geo.point(geo.PANIPAT))
    target = geo.named_point(F.col("target"), mode="last", default=geo.point(geo.VISAKH))
    step = routes.withColumn("km", geo.road_km(source, target))
    return step.select(
        *routes.columns,
        F.round("km", 1).alias("distance_km"),
        F.round(geo.transit_hours(F.col("km")), 1).alias("transit_hours"),
        F.round(geo.co2_saved(F.col("km")), 1).alias("co2_saved_kg"),
        F.round(geo.freight_inr(F.col("km"), F.lit(1000.0)), 2).alias("estimated_freight_inr"),
    )


def corridors(spark: SparkSession) -> DataFrame:
    """The five named corridors with their logistics; depots are looked up by exact name."""
    rows = spark.createDataFrame(list(geo.CORRIDORS), "source string, target string, name string")
    depots = geo.depots(spark)
    a = depots.select(F.col("name").alias("source"), F.struct("lat", "lon").alias("a"))
    b = depots.select(F.col("name").alias("target"), F.struct("lat", "lon").alias("b"))
    step = rows.join(F.broadcast(a), "source").join(F.broadcast(b), "target").withColumn("km", geo.road_km(F.col("a"), F.col("b")))
    return step.select(
        "source", "target", "name", F.round("km", 1).alias("distance_km"),
        F.round(geo.transit_hours(F.col("km")), 1).alias("transit_hours"),
        F.round(geo.co2_saved(F.col("km")), 1).alias("co2_saved_kg"), F.lit("OPERATIONAL").alias("status"),
    )


def route_summary(routes: DataFrame) -> DataFrame:
    """Summary of routes (source, target, weight_kg); routes with an unknown depot drop out."""
    spark = routes.sparkSession
    depots = geo.depots(spark)
    a = depots.select(F.col("name").alias("source"), F.struct("lat", "lon").alias("__a"))
    b = depots.select(F.col("name").alias("target"), F.struct("lat", "lon").alias("__b"))
    step = routes.join(F.broadcast(a), "source").join(F.broadcast(b), "target").withColumn("km", geo.road_km(F.col("__a"), F.col("__b")))
    weight = F.col("weight_kg")
    return step.select(
        *routes.columns,
        F.round("km", 2).alias("road_distance_km"),
        F.round(geo.transit_hours(F.col("km")), 2).alias("estimated_transit_hours"),
        F.round(geo.freight_inr(F.col("km"), weight), 2).alias("estimated_freight_cost_inr"),
        F.round(geo.co2_saved(F.col("km")) * (weight / 1000.0), 2).alias("co2_saved_kg"),
    )


def nearest_depots(spark: SparkSession, top_n: int = 5) -> DataFrame:
    """The ``top_n`` nearest depots of each depot; the table has 35 rows by definition."""
    from pyspark.sql import Window

    d = geo.depots(spark)
    a = d.select(F.col("name").alias("depot_id"), F.struct("lat", "lon").alias("a"))
    b = d.select(F.col("name").alias("near_depot_id"), F.col("ord"), F.struct("lat", "lon").alias("b"))
    pairs = a.join(F.broadcast(b), F.col("depot_id") != F.col("near_depot_id")).withColumn("distance_km", geo.road_km(F.col("a"), F.col("b")))
    rank = F.row_number().over(Window.partitionBy("depot_id").orderBy("distance_km", "ord"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= top_n).select("depot_id", "near_depot_id", "distance_km", "rank")


def item_payload(items: DataFrame) -> DataFrame:
    """Items as they enter the graph, with defaults."""
    def text(name, default):
        own = F.nullif(F.col(name), F.lit("")) if name in items.columns else F.lit(None).cast("string")
        return F.coalesce(own, default if isinstance(default, Column) else F.lit(default))

    cpse = F.upper(text("cpse", "IOCL"))
    step = items.filter(F.coalesce("sku_code", F.lit("")) != "").withColumns(
        {"__cpse": cpse, "__depot": text("depot_id", F.concat(cpse, F.lit("_DEPOT")))}
    )
    step = step.withColumn("__place", text("depot_location", F.col("__depot")))
    point = geo.named_point(F.col("__place"), F.col("__depot"), default=geo.point(geo.CENTRAL))
    quantity = F.coalesce(F.col("quantity"), F.lit(0))
    cost = F.coalesce(F.col("unit_cost_inr").cast("double"), F.lit(0.0))
    total = no_zero(F.col("total_value_inr").cast("double")) if "total_value_inr" in items.columns else F.lit(None).cast("double")
    return step.withColumn("__point", point).select(
        "sku_code", F.col("__cpse").alias("cpse"), F.col("__depot").alias("depot_id"), F.col("__place").alias("depot_name"),
        F.col("__point.lat").alias("lat"), F.col("__point.lon").alias("lon"),
        text("description", "").alias("description"), text("item_type", "EQUIPMENT").alias("item_type"),
        quantity.alias("qty"), F.coalesce(F.col("days_idle"), F.lit(0)).alias("days_idle"),
        text("status", "TO_BE_CONSUMED").alias("status"), cost.alias("unit_cost_inr"),
        F.coalesce(total, quantity * cost).alias("total_value_inr"),
        F.coalesce(F.col("is_broadcasted_surplus"), F.lit(False)).alias("is_broadcasted_surplus") if "is_broadcasted_surplus" in items.columns else F.lit(False).alias("is_broadcasted_surplus"),
        F.concat(no_zero(F.col("size_nb_mm").cast("double")).cast("string"), F.lit(" mm")).alias("size_value"),
        F.concat(no_zero(F.col("pressure_class")).cast("string"), F.lit("#")).alias("class_value"),
        F.nullif("metallurgy", F.lit("")).alias("metal_value"),
    )


def _edge(src_label, src, rel, dst_label, dst) -> Column:
    parts = [F.lit(src_label), src, F.lit(rel), F.lit(dst_label), dst]
    return F.when(src.isNotNull() & dst.isNotNull(), F.struct(*[p.alias(n) for p, n in zip(parts, EDGE)]))


def item_edges(payload: DataFrame) -> DataFrame:
    """Edges of the items, each once."""
    cpse, depot, sku = F.col("cpse"), F.col("depot_id"), F.col("sku_code")
    rows = F.array_compact(
        F.array(
            _edge("CPSE", cpse, "OPERATES", "Depot", depot),
            _edge("Depot", depot, "HOLDS", "InventoryItem", sku),
            _edge("InventoryItem", sku, "BELONGS_TO_CPSE", "CPSE", cpse),
            _edge("InventoryItem", sku, "HAS_SIZE", "Size", F.col("size_value")),
            _edge("InventoryItem", sku, "HAS_PRESSURE_CLASS", "PressureClass", F.col("class_value")),
            _edge("InventoryItem", sku, "HAS_BODY_METALLURGY", "MaterialGrade", F.col("metal_value")),
        )
    )
    return payload.select(F.explode_outer(rows).alias("e")).select("e.*").distinct()


def item_nodes(payload: DataFrame) -> DataFrame:
    """(label, key, props) of the items and the nodes they point to, each once.

    Items keep their columns as JSON; a depot keeps its place; the rest is only a key. Equal nodes
    are merged by a map-side aggregate, so a depot or tenant with most items is no hot group.
    """
    item_props = F.to_json(
        F.struct("description", "item_type", "qty", "days_idle", "status", "unit_cost_inr", "total_value_inr", "is_broadcasted_surplus")
    )
    rows = F.array(
        F.struct(F.lit("CPSE").alias("label"), F.col("cpse").alias("key"), F.lit(None).cast("string").alias("props")),
        F.struct(F.lit("Depot").alias("label"), F.col("depot_id").alias("key"), F.to_json(F.struct(F.col("depot_name").alias("name"), "lat", "lon")).alias("props")),
        F.struct(F.lit("InventoryItem").alias("label"), F.col("sku_code").alias("key"), item_props.alias("props")),
        F.struct(F.lit("Size").alias("label"), F.col("size_value").alias("key"), F.lit(None).cast("string").alias("props")),
        F.struct(F.lit("PressureClass").alias("label"), F.col("class_value").alias("key"), F.lit(None).cast("string").alias("props")),
        F.struct(F.lit("MaterialGrade").alias("label"), F.col("metal_value").alias("key"), F.lit(None).cast("string").alias("props")),
    )
    return payload.select(F.explode_outer(rows).alias("n")).select("n.*").filter("key is not null").groupBy("label", "key").agg(F.max("props").alias("props"))


def duplicate_keys(nodes: DataFrame) -> DataFrame:
    """Nodes that break the uniqueness of their label's key."""
    return nodes.filter(F.col("label").isin(*NODE_KEYS)).groupBy("label", "key").agg(F.count("*").alias("nodes")).filter("nodes > 1")


def depot_links(names: DataFrame, depots: DataFrame, name: str) -> DataFrame:
    """Depot of each name: equal id, or one name inside the other, also by the part before a comma.

    Only distinct site names are matched. A name containing a whole other name also contains its
    part before the comma, so two substring joins cover all cases. The lowest depot id of all
    matches wins, so the pick is repeatable.
    """
    wanted = names.select(F.col(name).alias("__n")).filter(F.coalesce("__n", F.lit("")) != "").distinct()
    wanted = wanted.withColumns({"__low": F.lower("__n"), "__head": F.split(F.lower("__n"), ",")[0]})
    sites = depots.select(
        "depot_id", F.lower("depot_name").alias("__other"), F.split(F.lower("depot_name"), ",")[0].alias("__other_head")
    )
    exact = wanted.join(depots.select(F.col("depot_id").alias("__n"), "depot_id"), "__n").select("__n", "depot_id")
    inside = containing(wanted, "__low", sites, "__other_head").select("__n", "depot_id")
    around = containing(sites, "__other", wanted, "__head").select("__n", "depot_id")
    return exact.unionByName(inside).unionByName(around).groupBy(F.col("__n").alias(name)).agg(F.min("depot_id").alias("depot_id"))


def requisition_edges(reqs: DataFrame, items: DataFrame, depots: DataFrame) -> DataFrame:
    """Edges of requisitions to their item and their two depots."""
    source = depot_links(reqs, depots, "source_depot").withColumnRenamed("depot_id", "__src")
    target = depot_links(reqs, depots, "target_depot").withColumnRenamed("depot_id", "__dst")
    known = items.select("sku_code", F.col("sku_code").alias("__sku")).distinct()
    step = reqs.join(known, "sku_code", "left").join(source, "source_depot", "left").join(target, "target_depot", "left")
    req = F.col("requisition_id")
    rows = F.array_compact(
        F.array(
            _edge("Requisition", req, "REQUESTS_ITEM", "InventoryItem", F.col("__sku")),
            _edge("Depot", F.col("__src"), "DISPATCHES_REQUISITION", "Requisition", req),
            _edge("Requisition", req, "DESTINED_FOR", "Depot", F.col("__dst")),
        )
    )
    return step.filter(F.coalesce("requisition_id", F.lit("")) != "").select(F.explode_outer(rows).alias("e")).select("e.*").filter("src is not null").distinct()


def upgrade_closure(edges: DataFrame, kind: str, reflexive_over: DataFrame | None = None) -> DataFrame:
    """(better, replaced) over one kind of upgrade edge, any number of steps.

    The edges are a catalog of classes and grades, not of items. Each round doubles the length of the
    known paths, so a ladder of n steps needs about log2 n rounds.
    """
    base = edges.filter(F.col("rel") == kind).select(F.col("src").alias("better"), F.col("dst").alias("replaced")).distinct()
    known = checkpointed(base)
    size = known.count()
    while size:
        step = known.alias("a").join(known.alias("b"), F.col("a.replaced") == F.col("b.better")).select("a.better", "b.replaced")
        grown = checkpointed(known.unionByName(step).distinct())
        new_size = grown.count()
        known = grown
        if new_size == size:
            break
        size = new_size
    if reflexive_over is not None:
        same = reflexive_over.select(F.col("value").alias("better"), F.col("value").alias("replaced"))
        known = known.unionByName(same).distinct()
    return known


def closure_sql(edges_view: str, kind: str) -> str:
    """The same closure as recursive SQL."""
    return f"""
        WITH RECURSIVE up(better, replaced) AS (
            SELECT src, dst FROM {edges_view} WHERE rel = '{kind}'
            UNION ALL
            SELECT u.better, e.dst FROM up u JOIN {edges_view} e ON e.src = u.replaced AND e.rel = '{kind}'
        ) SELECT DISTINCT better, replaced FROM up"""


def compatible_surplus(wanted: DataFrame, payload: DataFrame, upgrades: DataFrame) -> DataFrame:
    """Items of the wanted type and size whose class and grade equal or may replace the wanted ones.

    Wanted: request_id, item_type, size_value, class_value, metal_value. The closures are small and
    widen each request to the values that may serve it; items then join on equal keys. A value serves itself, which only matters for
    values that are asked for, so the edges of the items are not needed.
    """
    def widened(column, kind):
        asked = wanted.select(F.col(column).alias("value")).distinct()
        closure = upgrade_closure(upgrades, kind, asked)
        return closure.select(F.col("replaced").alias(column), F.col("better").alias("__" + column))

    asks = wanted.join(widened("class_value", "SAFE_UPGRADE_FOR"), "class_value").join(
        widened("metal_value", "ALLOY_UPGRADE_FOR"), "metal_value"
    )
    asks = asks.select(
        "request_id", "item_type", "size_value", F.col("__class_value").alias("class_value"), F.col("__metal_value").alias("metal_value")
    )
    found = asks.join(payload, ["item_type", "size_value", "class_value", "metal_value"])
    return found.select(
        "request_id", "sku_code", "cpse", "depot_id", "depot_name", "lat", "lon", "qty", "days_idle",
        F.lit("Compatible Alternate").alias("candidate_class"), F.lit("Tier 1").alias("dynamic_tier"), F.lit(0.95).alias("compatibility_score"),
    )


def held_items(edges: DataFrame) -> DataFrame:
    """(cpse, depot_id, sku_code) by the OPERATES and HOLDS hops."""
    operates = edges.filter("rel = 'OPERATES'").select(F.col("src").alias("cpse"), F.col("dst").alias("depot_id"))
    holds = edges.filter("rel = 'HOLDS'").select(F.col("src").alias("depot_id"), F.col("dst").alias("sku_code"))
    return operates.join(holds, "depot_id")


def property_star(edges: DataFrame) -> DataFrame:
    """Properties of each item as a map from relation to value."""
    stars = edges.filter((F.col("src_label") == "InventoryItem") & F.col("rel").startswith("HAS_"))
    one = stars.groupBy("src", "rel").agg(F.max("dst").alias("dst"))
    return one.groupBy(F.col("src").alias("sku_code")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rel", "dst")))).alias("properties"))


def merge_nodes(current: DataFrame, changed: DataFrame, removed: DataFrame) -> DataFrame:
    """Nodes after upserts and removals by (label, key)."""
    gone = removed.select("label", "key").unionByName(changed.select("label", "key")).distinct()
    return current.join(gone, ["label", "key"], "left_anti").unionByName(changed, allowMissingColumns=True)


def merge_edges(current: DataFrame, changed: DataFrame, removed: DataFrame, keep_stale: bool = False) -> DataFrame:
    """Edges after upserts and removals.

    A changed node's outgoing edges and the edge from its depot are replaced; ``keep_stale`` keeps
    the old ones. Removal detaches the node on both sides.
    """
    gone = removed.select("label", "key").distinct()
    out = current.join(gone.select(F.col("label").alias("src_label"), F.col("key").alias("src")), ["src_label", "src"], "left_anti")
    out = out.join(gone.select(F.col("label").alias("dst_label"), F.col("key").alias("dst")), ["dst_label", "dst"], "left_anti")
    if not keep_stale:
        own = changed.filter(F.col("src_label").isin("InventoryItem", "Requisition")).select("src_label", "src").distinct()
        held = changed.filter(F.col("rel").isin("HOLDS", "DISPATCHES_REQUISITION")).select("rel", "dst_label", "dst").distinct()
        out = out.join(own, ["src_label", "src"], "left_anti").join(held, ["rel", "dst_label", "dst"], "left_anti")
    return out.select(*EDGE).unionByName(changed.select(*EDGE)).distinct()


def duplicate_groups(pairs: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 50) -> DataFrame:
    """Group of each item over the pairs that match: the smallest id it is connected to.

    Small-star and large-star rounds: a node hands its neighbours to its smallest neighbour, so long chains
    shrink quickly and a node with most of the pairs never gathers them in one group. Rounds are
    joined on equal keys and cut by checkpoints.
    """
    def both(df):
        return df.select("u", "v").unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))

    edges = pairs.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = checkpointed(edges)
    for _ in range(max_rounds):
        # large star: neighbours larger than u point to the smallest of u's neighbourhood
        around = both(edges)
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # small star: the neighbours smaller than u and u itself point to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            smallest.select("u", F.col("m").alias("v"))
        )
        small = checkpointed(small.filter("u <> v").distinct())
        if small.exceptAll(edges).limit(1).count() == 0 and edges.exceptAll(small).limit(1).count() == 0:
            break
        edges = small
    else:
        raise RuntimeError(f"groups did not settle in {max_rounds} rounds")
    members = edges.select(F.col("u").alias("item"), F.col("v").alias("group_id"))
    heads = edges.select(F.col("v").alias("item"), F.col("v").alias("group_id")).distinct()
    return members.unionByName(heads).distinct()


