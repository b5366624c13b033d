"""Requisition lists, replay, stock and gate passes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.sealing import gate_pass_seal, sealed
from .inventory import ALL, search
from .textjoin import containing

SEARCH_COLUMNS = ("requisition_id", "sku_code", "source_cpse", "target_cpse", "source_depot", "target_depot", "requested_by")
PENDING = ("PENDING_APPROVAL", "REQUESTED")
LOCK_DAYS = 7
STATE_AFTER = {
    "CREATE": "PENDING_APPROVAL", "APPROVE": "APPROVED", "REJECT": "REJECTED", "GATE_PASS": "GATE_PASS_ISSUED",
    "DISPATCH": "DISPATCHED", "DELIVER": "DELIVERED",
}


def _mentions(text: Column, part: Column) -> Column:
    return F.coalesce(F.contains(F.lower(text), F.lower(part)), F.lit(False))


def listed(reqs: DataFrame, cpse: str = ALL, depot: str = ALL) -> DataFrame:
    """Requisitions with a tenant or depot on either side."""
    out = reqs
    if cpse and cpse != ALL:
        out = out.filter((F.col("source_cpse") == cpse) | (F.col("target_cpse") == cpse))
    if depot and depot != ALL:
        out = out.filter(_mentions(F.col("source_depot"), F.lit(depot)) | _mentions(F.col("target_depot"), F.lit(depot)))
    return out


def newest_first(reqs: DataFrame) -> DataFrame:
    return reqs.orderBy(F.desc("created_at"), F.desc("requisition_id"))


def visible_to(username: Column, cpse: Column, depot: Column) -> Column:
    """A user sees own requests and those supplied by the user's depot or tenant."""
    return (
        F.coalesce(F.col("requested_by") == username, F.lit(False))
        | F.coalesce(_mentions(F.col("source_depot"), F.nullif(depot, F.lit(""))), F.lit(False))
        | F.coalesce(F.col("source_cpse") == cpse, F.lit(False))
    )


def visible_for_user(reqs: DataFrame, username: str, cpse: str | None, depot: str | None) -> DataFrame:
    return reqs.filter(visible_to(F.lit(username), F.lit(cpse), F.lit(depot)))


def visible_pairs(reqs: DataFrame, users: DataFrame) -> DataFrame:
    """(username, requisition_id) for many users.

    Each of the three reasons is an equi-join; depots first meet users as distinct names, and the
    pairs are merged at the end. ``visible_counts`` counts them without listing them.
    """
    mine = reqs.join(users.select("username", F.col("username").alias("requested_by")), "requested_by").select("username", "requisition_id")
    tenant = reqs.join(users.select("username", F.col("cpse").alias("source_cpse")), "source_cpse").select("username", "requisition_id")
    depot = reqs.join(_linked_depots(reqs, users), "source_depot").join(users.select("username", "depot_id"), "depot_id").select("username", "requisition_id")
    return mine.unionByName(tenant).unionByName(depot).distinct()


def _linked_depots(reqs: DataFrame, users: DataFrame) -> DataFrame:
    """(source_depot, depot_id) where a request's depot name contains a user's depot: distinct names, joined on their rarest letters."""
    depots = reqs.where("source_depot IS NOT NULL").select("source_depot", F.lower("source_depot").alias("__name")).distinct()
    named = users.where("depot_id <> ''").select("depot_id", F.lower("depot_id").alias("__part")).distinct()
    return containing(depots, "__name", named, "__part").select("source_depot", "depot_id")


def visible_counts(reqs: DataFrame, users: DataFrame) -> DataFrame:
    """(username, requisitions): how many requests each user sees, without making a row per user and request.

    Requests are first added up by author, tenant and depot. A user sees the tenant's requests, those of linked depots in other
    tenants, and own ones in neither; each is a count looked up by an equal key. User names and request ids are unique; users who see none have no row.
    """
    groups = reqs.groupBy("requested_by", "source_cpse", "source_depot").agg(F.count("*").alias("__n"))
    tenant = groups.where("source_cpse IS NOT NULL").groupBy(F.col("source_cpse").alias("cpse")).agg(F.sum("__n").alias("__tenant"))
    sites = groups.groupBy("source_cpse", "source_depot").agg(F.sum("__n").alias("__n")).join(_linked_depots(reqs, users), "source_depot")
    both = sites.where("source_cpse IS NOT NULL").groupBy("depot_id", F.col("source_cpse").alias("cpse")).agg(F.sum("__n").alias("__both"))
    depot = sites.groupBy("depot_id").agg(F.sum("__n").alias("__depot"))
    own = groups.join(users.select(F.col("username").alias("requested_by"), "cpse", "depot_id"), "requested_by")
    elsewhere = ~(
        F.coalesce(F.col("source_cpse") == F.col("cpse"), F.lit(False)) | F.coalesce(_mentions(F.col("source_depot"), F.nullif("depot_id", F.lit(""))), F.lit(False))
    )
    own = own.where(elsewhere).groupBy(F.col("requested_by").alias("username")).agg(F.sum("__n").alias("__own"))
    seen = users.select("username", "cpse", "depot_id").join(tenant, "cpse", "left").join(depot, "depot_id", "left").join(both, ["depot_id", "cpse"], "left").join(own, "username", "left")
    parts = [F.coalesce(c, F.lit(0)) for c in ("__tenant", "__depot", "__own")]
    total = parts[0] + parts[1] + parts[2] - F.coalesce("__both", F.lit(0))
    return seen.select("username", total.alias("requisitions")).where("requisitions > 0")


def in_scope(reqs: DataFrame, tab: str, username: str, cpse: str, depot: str | None = None, super_admin: bool = False) -> DataFrame:
    """Tab filter of the request list."""
    if tab == "OUTGOING":
        mine = F.coalesce(F.col("requested_by") == username, F.lit(False))
        return reqs.filter(mine if super_admin else mine | F.coalesce(F.col("target_cpse") == cpse, F.lit(False)))
    if tab == "INCOMING":
        return reqs.filter(incoming(cpse, depot))
    return reqs


def incoming(cpse: str, depot: str | None) -> Column:
    hit = F.coalesce(F.col("source_cpse") == cpse, F.lit(False))
    return hit | _mentions(F.col("source_depot"), F.lit(depot)) if depot else hit


def with_status(reqs: DataFrame, status: str = ALL) -> DataFrame:
    if status == ALL:
        return reqs
    upper = F.upper("status")
    return reqs.filter(upper.isin(*PENDING) if status == "PENDING" else upper == status)


def searched(reqs: DataFrame, text: str) -> DataFrame:
    return search(reqs, text.strip(), SEARCH_COLUMNS)


def pending(reqs: DataFrame) -> DataFrame:
    return reqs.filter(F.col("status").isin(*PENDING))


def tab_counts(reqs: DataFrame, username: str, cpse: str, depot: str | None = None) -> DataFrame:
    return reqs.agg(
        F.count_if((F.col("requested_by") == username) | (F.col("target_cpse") == cpse)).alias("outgoing"),
        F.count_if(incoming(cpse, depot)).alias("incoming"),
    )


def with_gate_pass(reqs: DataFrame, passes: DataFrame) -> DataFrame:
    """Requisitions with their first gate pass."""
    rest = [c for c in passes.columns if c != "requisition_id"]
    first = passes.groupBy("requisition_id").agg(F.min_by(F.struct(*rest), F.col("gate_pass_no")).alias("gate_pass"))
    return reqs.join(first, "requisition_id", "left")


def with_certificate(items: DataFrame, documents: DataFrame) -> DataFrame:
    return items.join(documents.withColumnRenamed("doc_id", "mtc_document_id"), "mtc_document_id", "left")


def replay_states(events: DataFrame) -> DataFrame:
    """Accept or refuse each step of each requisition, with the state after it.

    Approval and rejection set the state whatever it was, so a step is judged inside the stretch since
    the last of them: a gate pass needs an approved stretch and is taken once, dispatch needs a gate
    pass before it, delivery a dispatch. That makes the replay a chain of running aggregates per
    requisition and no per-row Python. Events: requisition_id, event_type, ts, event_id.
    """
    order = Window.partitionBy("requisition_id").orderBy("ts", "event_id")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    kind = F.col("event_type")
    step = events.withColumn("__created", F.coalesce(F.max(F.when(kind == "CREATE", 1)).over(before), F.lit(0)))
    reset = (kind == "CREATE") & (F.col("__created") == 0) | (kind.isin("APPROVE", "REJECT") & (F.col("__created") == 1))
    step = step.withColumn("__reset", reset)
    step = step.withColumns(
        {
            "__n": F.row_number().over(order),
            "__stretch": F.sum(F.col("__reset").cast("int")).over(upto),
            "__base": F.last(F.when(F.col("__reset"), kind), True).over(upto),
        }
    )
    inside = Window.partitionBy("requisition_id", "__stretch")
    gate = F.min(F.when((kind == "GATE_PASS") & (F.col("__base") == "APPROVE"), F.col("__n"))).over(inside)
    step = step.withColumn("__gate", gate)
    step = step.withColumn("__out", F.min(F.when((kind == "DISPATCH") & (F.col("__n") > F.col("__gate")), F.col("__n"))).over(inside))
    step = step.withColumn("__in", F.min(F.when((kind == "DELIVER") & (F.col("__n") > F.col("__out")), F.col("__n"))).over(inside))
    at = F.col("__n")
    accepted = F.coalesce(
        F.col("__reset") | (at == F.col("__gate")) | (at == F.col("__out")) | (at == F.col("__in")), F.lit(False)
    )
    base_state = F.when(F.col("__base") == "CREATE", "PENDING_APPROVAL").when(F.col("__base") == "APPROVE", "APPROVED").when(F.col("__base") == "REJECT", "REJECTED")
    state = (
        F.when(at >= F.col("__in"), "DELIVERED")
        .when(at >= F.col("__out"), "DISPATCHED")
        .when(at >= F.col("__gate"), "GATE_PASS_ISSUED")
        .otherwise(base_state)
    )
    return step.withColumns({"accepted": accepted, "state": state}).drop(
        "__created", "__reset", "__n", "__stretch", "__base", "__gate", "__out", "__in"
    )


def final_states(events: DataFrame) -> DataFrame:
    """Last state of each requisition and its refused steps."""
    return replay_states(events).groupBy("requisition_id").agg(
        F.max_by("state", F.struct("ts", "event_id")).alias("status"),
        F.count_if(~F.col("accepted")).alias("refused"),
    )


def duty_violations(events: DataFrame, reqs: DataFrame, users: DataFrame) -> DataFrame:
    """Steps that break segregation of duties or the tenant side they belong to.

    The state-dependent checks of the replay are not part of this.
    """
    joined = events.join(reqs.select("requisition_id", "requested_by", "source_cpse", "target_cpse"), "requisition_id").join(
        users.select(F.col("username").alias("actor"), F.col("cpse").alias("actor_cpse")), "actor", "left"
    )
    kind, tenant = F.col("event_type"), F.nullif("actor_cpse", F.lit(""))
    foreign = F.coalesce(tenant != F.nullif("source_cpse", F.lit("")), F.lit(False))
    not_target = F.coalesce(tenant != F.nullif("target_cpse", F.lit("")), F.lit(False))
    own = F.coalesce(F.col("requested_by") == F.col("actor"), F.lit(False))
    reason = (
        F.when((kind == "APPROVE") & own, "RESOURCE_OWNERSHIP")
        .when(kind.isin("APPROVE", "GATE_PASS", "DISPATCH") & foreign, "TENANT_MISMATCH")
        .when((kind == "REJECT") & ~own & foreign, "TENANT_MISMATCH")
        .when((kind == "DELIVER") & not_target, "TENANT_MISMATCH")
    )
    return joined.withColumn("reason_code", reason).filter("reason_code is not null")


def audit_hash(row=F.col) -> Column:
    """Hash of a new requisition: id, SKU, quantity and time."""
    return sealed(row("requisition_id"), row("sku_code"), row("quantity"), row("timestamp"))


def gate_passes(reqs: DataFrame) -> DataFrame:
    """Distance, time, emissions and seal of gate passes; the last depot named in a text counts."""
    source = geo.named_point(F.col("source_depot"), mode="last", default=geo.point(geo.PANIPAT))
    target = geo.named_point(F.col("target_depot"), mode="last", default=geo.point(geo.VISAKH))
    step = reqs.withColumn("transit_distance_km", geo.road_km(source, target))
    return step.withColumns(
        {
            "estimated_transit_hours": geo.transit_hours(F.col("transit_distance_km")).cast("int"),
            "co2_saved_kg": geo.co2_saved(F.col("transit_distance_km")),
            "sha256_hash": gate_pass_seal(),
        }
    )


def latest_status(items: DataFrame, transitions: DataFrame) -> DataFrame:
    """Items after their status transitions; IDLE_SURPLUS also broadcasts, and that stays set."""
    last = transitions.groupBy("sku_code", "cpse").agg(
        F.max_by("new_status", F.struct("ts", "event_id")).alias("__status"),
        F.bool_or(F.col("new_status") == "IDLE_SURPLUS").alias("__broadcast"),
    )
    return (
        items.join(last, ["sku_code", "cpse"], "left")
        .withColumns(
            {
                "status": F.coalesce("__status", "status"),
                "is_broadcasted_surplus": F.coalesce("is_broadcasted_surplus", F.lit(False)) | F.coalesce("__broadcast", F.lit(False)),
            }
        )
        .drop("__status", "__broadcast")
    )


def active_reservations(locks: DataFrame, at: Column | None = None) -> DataFrame:
    """Reserved quantity per SKU; ``at`` also ends locks that have expired by then."""
    live = locks.filter("is_active")
    if at is not None:
        live = live.filter(F.col("expires_at") > at)
    return live.groupBy("sku_code").agg(F.sum("locked_qty").alias("reserved_qty"), F.count("*").alias("locks"))
