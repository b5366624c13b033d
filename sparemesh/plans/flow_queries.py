"""Requisition replay, stock, ledger, graph, review queue, training sets and vectors."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.attributes import DOMAINS
from ..functions.sealing import ledger_hash, sorted_json
from ..operators import catalog, graph, ledger, requisitions as rq, review, stock, training, vector_lists, vectors
from ..session import written
from . import oracle_views as O
from . import views as V
from .match_queries import REST, SAFETY, pair_tables
from .registry import query

# ---- requisition history -----------------------------------------------------------------------------

REPLAY = """walk AS (
      SELECT requisition_id, n, event_id, event_type, event_type = 'CREATE' AS accepted, CASE WHEN event_type = 'CREATE' THEN 'PENDING_APPROVAL' END AS state FROM numbered WHERE n = 1
      UNION ALL
      SELECT e.requisition_id, e.n, e.event_id, e.event_type,
        CASE WHEN w.state IS NULL THEN e.event_type = 'CREATE' ELSE CASE e.event_type WHEN 'APPROVE' THEN true WHEN 'REJECT' THEN true WHEN 'GATE_PASS' THEN w.state = 'APPROVED'
          WHEN 'DISPATCH' THEN w.state = 'GATE_PASS_ISSUED' WHEN 'DELIVER' THEN w.state = 'DISPATCHED' ELSE false END END,
        CASE WHEN w.state IS NULL THEN CASE WHEN e.event_type = 'CREATE' THEN 'PENDING_APPROVAL' END ELSE CASE WHEN e.event_type = 'APPROVE' THEN 'APPROVED' WHEN e.event_type = 'REJECT' THEN 'REJECTED'
          WHEN e.event_type = 'GATE_PASS' AND w.state = 'APPROVED' THEN 'GATE_PASS_ISSUED' WHEN e.event_type = 'DISPATCH' AND w.state = 'GATE_PASS_ISSUED' THEN 'DISPATCHED'
          WHEN e.event_type = 'DELIVER' AND w.state = 'DISPATCHED' THEN 'DELIVERED' ELSE w.state END END
      FROM walk w JOIN numbered e ON e.requisition_id = w.requisition_id AND e.n = w.n + 1)"""
NUMBERED = "SELECT *, row_number() OVER (PARTITION BY requisition_id ORDER BY ts, event_id) AS n FROM requisition_events"


def replay_sql(body):
    return O.sql("requisition_events", "@", numbered=NUMBERED).replace(" @", f", {REPLAY} {body}")


@query("q3_replayed_steps", replay_sql("SELECT requisition_id, event_id, event_type, accepted, state FROM walk"))
def replayed(spark, sf_dir):
    return rq.replay_states(V.requisition_events(spark, sf_dir)).select("requisition_id", "event_id", "event_type", "accepted", "state")


@query("q3_final_states", replay_sql("SELECT requisition_id, arg_max(state, n) AS status, count(*) FILTER (NOT accepted) AS refused FROM walk GROUP BY 1"))
def final_states(spark, sf_dir):
    return rq.final_states(V.requisition_events(spark, sf_dir))


STOCK_WALK = """walk AS (
      SELECT sku_code, 0::BIGINT AS n, 0::BIGINT AS event_id, ''::VARCHAR AS event_type, false AS granted, quantity::BIGINT AS stock_left, []::VARCHAR[] AS held FROM opening_stock
      UNION ALL
      SELECT e.sku_code, e.n, e.event_id, e.event_type,
        CASE WHEN e.event_type = 'CREATE' THEN e.quantity <= w.stock_left ELSE list_contains(w.held, e.requisition_id) END,
        w.stock_left + CASE WHEN e.event_type = 'CREATE' THEN CASE WHEN e.quantity <= w.stock_left THEN -e.quantity ELSE 0 END WHEN e.event_type = 'REJECT' AND list_contains(w.held, e.requisition_id) THEN e.quantity ELSE 0 END,
        CASE WHEN e.event_type = 'CREATE' THEN CASE WHEN e.quantity <= w.stock_left THEN list_append(w.held, e.requisition_id) ELSE w.held END ELSE list_filter(w.held, lambda x: x <> e.requisition_id) END
      FROM walk w JOIN numbered e ON e.sku_code = w.sku_code AND e.n = w.n + 1)"""
STOCK_NUMBERED = "SELECT *, row_number() OVER (PARTITION BY sku_code ORDER BY ts, event_id) AS n FROM requisition_events WHERE event_type IN ('CREATE', 'REJECT', 'DELIVER')"


def stock_sql(body):
    return O.sql("requisition_events opening_stock", "@", numbered=STOCK_NUMBERED).replace(" @", f", {STOCK_WALK} {body}")


@query("q1_stock_reservations", stock_sql("SELECT sku_code, event_id, event_type, granted, stock_left FROM walk WHERE n > 0"))
def reservations(spark, sf_dir):
    out = stock.reserve_stock(V.stock_events(spark, sf_dir), V.opening_stock(spark, sf_dir))
    return out.select("sku_code", "event_id", "event_type", "granted", "stock_left")


@query("q2_stock_after_rejections", stock_sql("SELECT sku_code, arg_max(stock_left, n) AS stock_left, count(*) FILTER (event_type = 'CREATE' AND granted) AS granted, count(*) FILTER (event_type = 'CREATE' AND NOT granted) AS refused FROM walk WHERE n > 0 GROUP BY 1"))
def stock_after(spark, sf_dir):
    return stock.stock_after(stock.reserve_stock(V.stock_events(spark, sf_dir), V.opening_stock(spark, sf_dir)))


@query(
    "q8_active_reservations",
    stock_sql(
        """SELECT w.sku_code, sum(e.quantity)::BIGINT AS reserved_qty, count(*) AS locks FROM walk w JOIN numbered e USING (event_id) WHERE w.event_type = 'CREATE' AND w.granted
           AND e.requisition_id NOT IN (SELECT e2.requisition_id FROM walk w2 JOIN numbered e2 USING (event_id) WHERE w2.event_type <> 'CREATE' AND w2.granted)
           AND e.ts + INTERVAL 7 DAY > TIMESTAMP '1997-01-01' GROUP BY 1"""
    ),
)
def active(spark, sf_dir):
    locks = stock.locks_of(stock.reserve_stock(V.stock_events(spark, sf_dir), V.opening_stock(spark, sf_dir)))
    return rq.active_reservations(locks, F.lit("1997-01-01").cast("timestamp"))


@query(
    "q4_duty_violations",
    O.sql(
        "requisition_events requisitions users",
        """SELECT event_id, reason_code FROM (SELECT e.event_id, CASE WHEN event_type = 'APPROVE' AND requested_by = actor THEN 'RESOURCE_OWNERSHIP' WHEN event_type IN ('APPROVE', 'GATE_PASS', 'DISPATCH') AND u.cpse <> source_cpse THEN 'TENANT_MISMATCH'
             WHEN event_type = 'REJECT' AND requested_by <> actor AND u.cpse <> source_cpse THEN 'TENANT_MISMATCH' WHEN event_type = 'DELIVER' AND u.cpse <> target_cpse THEN 'TENANT_MISMATCH' END AS reason_code
           FROM requisition_events e JOIN requisitions r USING (requisition_id) LEFT JOIN users u ON u.username = e.actor) WHERE reason_code IS NOT NULL""",
    ),
)
def duties(spark, sf_dir):
    out = rq.duty_violations(V.requisition_events(spark, sf_dir), V.requisitions(spark, sf_dir), V.users(spark, sf_dir))
    return out.select("event_id", "reason_code")


SRC = O.named_point(["source_depot"], "lat", repr(V.geo.PANIPAT[0]), "last"), O.named_point(["source_depot"], "lon", repr(V.geo.PANIPAT[1]), "last")
DST = O.named_point(["target_depot"], "lat", repr(V.geo.VISAKH[0]), "last"), O.named_point(["target_depot"], "lon", repr(V.geo.VISAKH[1]), "last")


@query(
    "q6_gate_passes",
    O.sql(
        "requisitions",
        f"""SELECT requisition_id, round(km, 6) AS transit_distance_km, floor(km / 40.0 + 4.0)::INT AS estimated_transit_hours, round(greatest(0.0, 100000.0 - km * 60.0) / 1000.0, 6) AS co2_saved_kg,
              sha256('GP-' || requisition_id || '|V-1|DL-1|' || sku_code || '|' || required_qty || '|' || requested_by || '|' || status) AS sha256_hash FROM (SELECT *, {O.road_km(SRC[0], SRC[1], DST[0], DST[1])} AS km FROM requisitions)""",
    ),
)
def gate_passes(spark, sf_dir):
    reqs = V.requisitions(spark, sf_dir).withColumns(
        {"gate_pass_no": F.concat(F.lit("GP-"), F.col("requisition_id")), "vehicle_no": F.lit("V-1"), "driver_id": F.lit("DL-1"), "quantity": F.col("required_qty"), "issuing_officer": F.col("requested_by"), "timestamp": F.col("status")}
    )
    out = rq.gate_passes(reqs)
    return out.select("requisition_id", F.round("transit_distance_km", 6).alias("transit_distance_km"), "estimated_transit_hours", F.round("co2_saved_kg", 6).alias("co2_saved_kg"), "sha256_hash")


@query("q5_audit_hashes", O.sql("requisitions", "SELECT requisition_id, sha256(requisition_id || '|' || sku_code || '|' || required_qty || '|' || strftime(created_at, '%Y-%m-%d %H:%M:%S')) AS audit_hash FROM requisitions"))
def audit_hashes(spark, sf_dir):
    reqs = V.requisitions(spark, sf_dir).withColumns({"quantity": F.col("required_qty"), "timestamp": F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")})
    return reqs.select("requisition_id", rq.audit_hash().alias("audit_hash"))


PASSES = "SELECT requisition_id, min('GP-' || (event_id % 7) || '-' || event_id) AS gate_pass_no FROM requisition_events WHERE event_type = 'GATE_PASS' GROUP BY 1"


@query("j4_requisition_passes", O.sql("requisitions requisition_events", "SELECT requisition_id, gate_pass_no FROM requisitions LEFT JOIN passes USING (requisition_id)", passes=PASSES))
def requisition_passes(spark, sf_dir):
    passes = V.requisition_events(spark, sf_dir).filter("event_type = 'GATE_PASS'").select(
        "requisition_id", F.concat(F.lit("GP-"), F.pmod("event_id", F.lit(7)).cast("string"), F.lit("-"), F.col("event_id").cast("string")).alias("gate_pass_no"), "actor"
    )
    return rq.with_gate_pass(V.requisitions(spark, sf_dir), passes).select("requisition_id", F.col("gate_pass.gate_pass_no").alias("gate_pass_no"))


@query(
    "q7_status_transitions",
    O.sql(
        "inventory",
        """SELECT sku_code, coalesce(s, status) AS status, is_broadcasted_surplus OR coalesce(b, false) AS is_broadcasted_surplus FROM inventory LEFT JOIN
           (SELECT sku, arg_max(new_status, event_id) AS s, bool_or(new_status = 'IDLE_SURPLUS') AS b FROM
             (SELECT 'SKU-' || l_partkey || '-' || l_suppkey AS sku, CASE l_linenumber % 3 WHEN 0 THEN 'IDLE_SURPLUS' WHEN 1 THEN 'HITL_REVIEW' ELSE 'TO_BE_CONSUMED' END AS new_status, l_orderkey * 100 + l_linenumber AS event_id FROM lineitem)
            GROUP BY sku) ON sku = sku_code""",
    ),
)
def transitions(spark, sf_dir):
    line = V.table(spark, sf_dir, "lineitem")  # every line changes the status
    items = V.inventory(spark, sf_dir)
    moves = line.select(
        F.concat(F.lit("SKU-"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_suppkey").cast("string")).alias("sku_code"),
        V.pick(F.col("l_linenumber"), ("IDLE_SURPLUS", "HITL_REVIEW", "TO_BE_CONSUMED")).alias("new_status"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("event_id"),
    ).join(items.select("sku_code", "cpse"), "sku_code").withColumn("ts", F.lit(0))
    return rq.latest_status(items, moves).select("sku_code", "status", "is_broadcasted_surplus")


# ---- ledger ------------------------------------------------------------------------------------------

LEDGER = "log_id, action_name, actor_name, reference_id"
LEDGER_COLUMNS = LEDGER.split(", ")


@query("f12_ledger_page", O.sql("ledger_base", f"SELECT {LEDGER}, (SELECT count(*) FROM ledger_base WHERE action_category = 'CLICK' AND cpse = 'T1') AS total FROM ledger_base WHERE action_category = 'CLICK' AND cpse = 'T1' ORDER BY timestamp DESC, log_id DESC LIMIT 50 OFFSET 10"))
def ledger_page(spark, sf_dir):
    return ledger.entry_page(V.ledger_base(spark, sf_dir), 10, 50, category="CLICK", cpse="T1").select(*LEDGER_COLUMNS, "total")


@query("f11_ledger_search", O.sql("ledger_base", f"SELECT {LEDGER} FROM ledger_base WHERE contains(lower(action_name), 'ref-77') OR contains(lower(actor_name), 'ref-77') OR contains(lower(reference_id), 'ref-77')"))
def ledger_search(spark, sf_dir):
    return ledger.searched(V.ledger_base(spark, sf_dir), "REF-77").select(*LEDGER_COLUMNS)


@query("f16_ledger_entry", O.sql("ledger_base", f"SELECT {LEDGER} FROM ledger_base WHERE log_id = 77 AND cpse = (SELECT cpse FROM ledger_base WHERE log_id = 77)"))
def ledger_entry(spark, sf_dir):
    base = V.ledger_base(spark, sf_dir)
    return ledger.entry(base, 77, base.filter("log_id = 77").first()["cpse"]).select(*LEDGER_COLUMNS)


@query("k3_ledger_export", O.sql("ledger_base", "SELECT log_id, action_category, actor_role, cpse, details FROM ledger_base WHERE cpse = 'T2'"))
def ledger_export(spark, sf_dir):
    return ledger.export_rows(V.ledger_base(spark, sf_dir), cpse="T2").select("log_id", "action_category", "actor_role", "cpse", "details")


def paired_ledger(spark, sf_dir):
    """Ledger of two-entry chains with some damage: odd entries link to the even one before them."""
    base = V.ledger_base(spark, sf_dir).withColumn("k", F.col("log_id"))
    even = base.filter("k % 2 = 0").withColumn("prev_hash", F.lit("0" * 64))
    even = even.withColumn("sha256_hash", ledger_hash(F.col("prev_hash"), hash_field))
    odd = base.filter("k % 2 = 1").join(even.select((F.col("k") + 1).alias("k"), F.col("sha256_hash").alias("prev_hash")), "k")
    odd = odd.withColumn("sha256_hash", ledger_hash(F.col("prev_hash"), hash_field))
    rows = even.unionByName(odd)
    damaged = F.when(F.pmod("k", F.lit(997)) == 500, F.concat("sha256_hash", F.lit("x"))).otherwise(F.col("sha256_hash"))
    return rows.withColumn("sha256_hash", damaged).drop("k")


def hash_field(name):
    return F.lit("t") if name == "timestamp" else F.col(name)


PAIRED = """SELECT *, CASE WHEN log_id % 997 = 500 THEN clean || 'x' ELSE clean END AS sha256_hash FROM (
      SELECT log_id, timestamp, prev_hash, sha256(prev_hash || '|' || body) AS clean FROM (
        SELECT b.log_id, b.timestamp, b.body, CASE WHEN b.log_id % 2 = 0 THEN repeat('0', 64) ELSE sha256(repeat('0', 64) || '|' || a.body) END AS prev_hash
        FROM bodies b LEFT JOIN bodies a ON a.log_id = b.log_id - 1))"""
BODIES = "SELECT log_id, timestamp, log_id || '|t|' || actor_name || '|' || action_name || '|' || reference_id || '|' || details AS body FROM ledger_base"
CHECKED = """SELECT log_id, row_number() OVER (ORDER BY timestamp, log_id) - 1 AS position, prev_hash = coalesce(lag(sha256_hash) OVER (ORDER BY timestamp, log_id), repeat('0', 64)) AS link_ok, clean = sha256_hash AS hash_ok FROM paired"""


@query("w5_chain_links", O.sql("ledger_base", "SELECT log_id, position, link_ok, hash_ok FROM checked", bodies=BODIES, paired=PAIRED, checked=CHECKED))
def chain_links(spark, sf_dir):
    return ledger.check_chain(paired_ledger(spark, sf_dir), row=hash_field).select("log_id", "position", "link_ok", "hash_ok")


@query("e2_chain_verdict", O.sql("ledger_base", "SELECT count(*) FILTER (NOT link_ok OR NOT hash_ok) = 0 AS is_valid, min(position) FILTER (NOT link_ok OR NOT hash_ok) AS first_broken_position, arg_min(log_id, position) FILTER (NOT link_ok OR NOT hash_ok) AS first_broken_log_id, count(*) AS total_verified FROM checked", bodies=BODIES, paired=PAIRED, checked=CHECKED))
def chain_verdict(spark, sf_dir):
    return ledger.verify_chain(paired_ledger(spark, sf_dir), row=hash_field)


@query("e1_chain_of_events")
def chain(spark, sf_dir):
    """All events chained in order and verified again."""
    base = V.ledger_base(spark, sf_dir)
    return ledger.verify_chain(ledger.append_batch(base))


@query("e3_sorted_details", O.sql("ledger_base", """SELECT log_id, '{"actor": "' || actor_name || '", "n": ' || log_id || ', "ref": null}' AS details, sha256('{"actor": "' || actor_name || '", "n": ' || log_id || ', "ref": null}') AS request_hash FROM ledger_base"""))
def sorted_details(spark, sf_dir):
    columns = {"ref": F.lit(None).cast("string"), "n": F.col("log_id"), "actor": F.col("actor_name")}
    return V.ledger_base(spark, sf_dir).select("log_id", sorted_json(columns).alias("details"), ledger.request_hash(columns).alias("request_hash"))


def decisions(spark, sf_dir):
    """Reviewer decisions from events: user on a request text and SKU."""
    e = V.table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("query "), F.pmod("event_id", F.lit(300)).cast("string")).alias("query_text"), F.concat(F.lit("SKU-"), F.pmod("user_id", F.lit(50)).cast("string")).alias("source_sku"),
        F.when(F.col("event_type") == "error", "REJECT").when(F.col("event_type") == "view", "HOLD").otherwise("APPROVE").alias("decision"),
        F.concat(F.lit("Tier "), (F.pmod("event_id", F.lit(3)) + 1).cast("string")).alias("tier_override"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("username"),
        F.col("event_id").alias("decided_at"),
    )


DECISIONS = """SELECT 'query ' || (event_id % 300) AS query_text, 'SKU-' || (user_id % 50) AS source_sku, CASE event_type WHEN 'error' THEN 'REJECT' WHEN 'view' THEN 'HOLD' ELSE 'APPROVE' END AS decision,
      'Tier ' || (event_id % 3 + 1) AS tier_override, 'user-' || user_id AS username, event_id AS decided_at FROM events"""


@query("h5_decision_log", O.sql("", "SELECT query_text, source_sku, decision, tier_override FROM (SELECT *, row_number() OVER (PARTITION BY query_text, source_sku ORDER BY decided_at DESC) AS n FROM d) WHERE n = 1", d=DECISIONS))
def decision_log(spark, sf_dir):
    return review.decision_log(decisions(spark, sf_dir)).select("query_text", "source_sku", "decision", "tier_override")


@query("h5_sku_stamps", O.sql("", "SELECT source_sku, CASE arg_max(decision, decided_at) WHEN 'APPROVE' THEN '[VERIFIED BY HUMAN EXPERT]' ELSE '[REJECTED BY HUMAN EXPERT]' END AS stamp FROM d WHERE decision <> 'HOLD' GROUP BY 1", d=DECISIONS))
def stamps(spark, sf_dir):
    return review.latest_stamps(decisions(spark, sf_dir))


@query("e5_feedback_entries", O.sql("", """SELECT decided_at AS timestamp, username AS actor_name, source_sku AS reference_id, '{"decision": "' || decision || '", "officer": "' || username || '", "query_text": "' || query_text || '", "source_sku": "' || source_sku || '", "tier_override": "' || tier_override || '"}' AS details FROM d""", d=DECISIONS))
def feedback(spark, sf_dir):
    return review.feedback_entries(decisions(spark, sf_dir)).select("timestamp", "actor_name", "reference_id", "details")


@query("h6_golden_decisions", O.sql("", "SELECT 'text ' || p_partkey AS query_text, 'SKU-' || p_partkey AS source_sku, CASE WHEN p_partkey % 4 IN (1, 2) THEN 'APPROVE' ELSE 'REJECT' END AS decision, 'Tier ' || CASE WHEN p_partkey % 4 = 0 THEN 3 ELSE p_partkey % 4 END AS tier_override FROM part WHERE p_partkey % 9 <> 0"))
def golden_decisions(spark, sf_dir):
    k = F.col("p_partkey")
    pairs = V.table(spark, sf_dir, "part").select(
        F.when(F.pmod(k, F.lit(9)) != 0, F.concat(F.lit("text "), k.cast("string"))).alias("query_text"), F.concat(F.lit("SKU-"), k.cast("string")).alias("source_sku"),
        F.when(F.pmod(k, F.lit(4)) != 0, F.pmod(k, F.lit(4)).cast("int")).alias("tier"),
    )
    return review.decisions_from_golden(pairs).select("query_text", "source_sku", "decision", "tier_override")


# ---- review queue ------------------------------------------------------------------------------------


def sightings(spark, sf_dir):
    """Search results as they were seen: one per line."""
    line = V.table(spark, sf_dir, "lineitem")
    score = F.pmod(F.col("l_partkey") * 7 + F.col("l_suppkey"), F.lit(100)) / 100.0
    return line.select(
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("query"), F.concat(F.lit("CAN-"), F.col("l_suppkey").cast("string")).alias("canonical_id"),
        score.alias("similarity"), F.when(score >= 0.85, "Tier-1").when(score >= 0.6, "Tier-3").otherwise("Tier-4-Reject").alias("tier"),
        (F.col("l_orderkey") * 1000 + F.col("l_partkey")).alias("ts"), F.concat(F.lit("item "), F.col("l_suppkey").cast("string")).alias("canonical_description"),
    )


SEEN = """SELECT query, canonical_id, similarity, ts, canonical_description, sha256('["' || query || '","' || canonical_id || '"]') AS id, 1.0 - least(1.0, abs(similarity - 0.5) * 2) AS uncertainty FROM (
      SELECT 'part ' || l_partkey AS query, 'CAN-' || l_suppkey AS canonical_id, ((l_partkey * 7 + l_suppkey) % 100) / 100.0::DOUBLE AS similarity, l_orderkey * 1000 + l_partkey AS ts, 'item ' || l_suppkey AS canonical_description FROM lineitem) WHERE similarity < 0.85"""
QUEUE = "SELECT id, max(ts) AS ts, any_value(query) AS query, any_value(canonical_id) AS canonical_id, any_value(similarity) AS similarity, any_value(canonical_description) AS canonical_description FROM seen GROUP BY id"


@query("h1_review_items", O.sql("", "SELECT id, round(uncertainty, 9) AS uncertainty, similarity, ts FROM seen", seen=SEEN))
def review_items(spark, sf_dir):
    return review.review_items(sightings(spark, sf_dir)).select("id", F.round("uncertainty", 9).alias("uncertainty"), "similarity", "ts")


@query("h2_review_queue", O.sql("", "SELECT id, query, canonical_id, ts FROM queue", seen=SEEN, queue=QUEUE))
def queue(spark, sf_dir):
    return review.review_queue(review.review_items(sightings(spark, sf_dir))).select("id", "query", "canonical_id", "ts")


def queue_decisions(entries):
    return entries.filter(F.pmod("ts", F.lit(2)) == 0).select(
        "id", (F.pmod("ts", F.lit(3)) == 0).alias("accepted"), F.when(F.pmod("ts", F.lit(5)) == 0, "corrected").alias("corrected_candidate"), F.col("ts").alias("decided_at")
    )


@query("h3_training_examples", O.sql("", "SELECT query, CASE WHEN ts % 5 = 0 THEN 'corrected' ELSE canonical_description END AS candidate, CAST(ts % 3 = 0 AS INT) AS label, similarity AS cosine FROM queue WHERE ts % 2 = 0", seen=SEEN, queue=QUEUE))
def examples(spark, sf_dir):
    entries = review.review_queue(review.review_items(sightings(spark, sf_dir)))
    return review.resolve(entries, queue_decisions(entries)).select("query", "candidate", "label", "cosine")


@query("a9_queue_counters", O.sql("", "SELECT count(*) FILTER (ts % 2 <> 0) AS pending_reviews, count(*) FILTER (ts % 2 = 0) AS resolved_reviews, NULL::INT AS review_capacity FROM queue", seen=SEEN, queue=QUEUE))
def counters(spark, sf_dir):
    entries = review.review_queue(review.review_items(sightings(spark, sf_dir)))
    return review.queue_counters(entries, queue_decisions(entries))


@query("h4_bootstrap_queue", O.sql("", "SELECT id, round(max(uncertainty), 9) AS uncertainty FROM seen GROUP BY id", seen=SEEN))
def bootstrap(spark, sf_dir):
    return review.bootstrap_queue(sightings(spark, sf_dir)).select("id", F.round("uncertainty", 9).alias("uncertainty"))


@query("w9_recent_decisions", O.sql("", "SELECT query_text, source_sku, decided_at FROM d ORDER BY decided_at DESC LIMIT 500", d=DECISIONS))
def recent(spark, sf_dir):
    return review.most_recent(decisions(spark, sf_dir), ["decided_at"], 500).select("query_text", "source_sku", "decided_at")


# ---- graph -------------------------------------------------------------------------------------------

NUMBER_MM = "CAST(size_nb_mm AS VARCHAR) || ' mm'"
EDGES = f"""SELECT DISTINCT * FROM (
      SELECT 'CPSE' AS src_label, cpse AS src, 'OPERATES' AS rel, 'Depot' AS dst_label, depot_id AS dst FROM inventory
      UNION ALL SELECT 'Depot', depot_id, 'HOLDS', 'InventoryItem', sku_code FROM inventory UNION ALL SELECT 'InventoryItem', sku_code, 'BELONGS_TO_CPSE', 'CPSE', cpse FROM inventory
      UNION ALL SELECT 'InventoryItem', sku_code, 'HAS_SIZE', 'Size', {NUMBER_MM} FROM inventory UNION ALL SELECT 'InventoryItem', sku_code, 'HAS_PRESSURE_CLASS', 'PressureClass', pressure_class || '#' FROM inventory
      UNION ALL SELECT 'InventoryItem', sku_code, 'HAS_BODY_METALLURGY', 'MaterialGrade', metallurgy FROM inventory WHERE metallurgy IS NOT NULL)"""


def payload(spark, sf_dir):
    return graph.item_payload(V.inventory(spark, sf_dir))


@query("g7_item_edges", O.sql("inventory", "SELECT * FROM edges", edges=EDGES))
def item_edges(spark, sf_dir):
    return graph.item_edges(payload(spark, sf_dir))


@query("g7_item_nodes", O.sql("inventory", "SELECT label, count(*) AS nodes FROM (SELECT src_label AS label, src AS key FROM edges UNION SELECT dst_label, dst FROM edges) GROUP BY 1", edges=EDGES))
def item_nodes(spark, sf_dir):
    return graph.item_nodes(payload(spark, sf_dir)).groupBy("label").agg(F.count("*").alias("nodes"))


@query("g10_duplicate_keys", O.sql("", "SELECT 'Depot' AS label, 'D' || s_nationkey AS key, count(*) AS nodes FROM supplier GROUP BY s_nationkey HAVING count(*) > 1"))
def duplicate_keys(spark, sf_dir):
    nodes = V.table(spark, sf_dir, "supplier").select(F.lit("Depot").alias("label"), F.concat(F.lit("D"), F.col("s_nationkey").cast("string")).alias("key"))
    return graph.duplicate_keys(nodes)


@query("j6_held_items", O.sql("inventory", "SELECT a.src AS cpse, a.dst AS depot_id, count(*) AS items FROM edges a JOIN edges b ON b.src = a.dst AND b.rel = 'HOLDS' WHERE a.rel = 'OPERATES' GROUP BY ALL", edges=EDGES))
def held_items(spark, sf_dir):
    return graph.held_items(graph.item_edges(payload(spark, sf_dir))).groupBy("cpse", "depot_id").agg(F.count("*").alias("items"))


@query("j10_property_stars", O.sql("inventory", f"SELECT sku_code, {NUMBER_MM} AS size, pressure_class || '#' AS class, metallurgy AS metal FROM inventory"))
def property_stars(spark, sf_dir):
    star = graph.property_star(graph.item_edges(payload(spark, sf_dir)))
    names = {"HAS_SIZE": "size", "HAS_PRESSURE_CLASS": "class", "HAS_BODY_METALLURGY": "metal"}
    return star.select("sku_code", *[F.try_element_at("properties", F.lit(k)).alias(v) for k, v in names.items()])


LADDER = "SELECT DISTINCT b.pressure_class || '#' AS src, 'SAFE_UPGRADE_FOR' AS rel, a.pressure_class || '#' AS dst FROM (SELECT DISTINCT pressure_class, dense_rank() OVER (ORDER BY pressure_class) AS n FROM inventory) a JOIN (SELECT DISTINCT pressure_class, dense_rank() OVER (ORDER BY pressure_class) AS n FROM inventory) b ON b.n = a.n + 1"
UP = "up AS (SELECT src AS better, dst AS replaced FROM ladder UNION ALL SELECT u.better, e.dst FROM up u JOIN ladder e ON e.src = u.replaced)"


def ladder(spark, sf_dir, items=None):
    """Upgrade edges between neighbouring stocked classes."""
    classes = (V.inventory(spark, sf_dir) if items is None else items).select("pressure_class").distinct()
    # one row per pressure class
    up = classes.withColumn("next", F.lead("pressure_class").over(Window.partitionBy(F.lit(0)).orderBy("pressure_class"))).filter("next is not null")
    return up.select(F.concat(F.col("next").cast("string"), F.lit("#")).alias("src"), F.lit("SAFE_UPGRADE_FOR").alias("rel"), F.concat(F.col("pressure_class").cast("string"), F.lit("#")).alias("dst"))


@query("g8_upgrade_closure", O.sql("inventory", "@", ladder=LADDER).replace(" @", f", {UP} SELECT DISTINCT better, replaced FROM up"))
def closure(spark, sf_dir):
    return graph.upgrade_closure(ladder(spark, sf_dir), "SAFE_UPGRADE_FOR")


@query("g8_upgrade_closure_recursive", O.sql("inventory", "@", ladder=LADDER).replace(" @", f", {UP} SELECT DISTINCT better, replaced FROM up"))
def closure_recursive(spark, sf_dir):
    ladder(spark, sf_dir).createOrReplaceTempView("sparemesh_ladder")
    return spark.sql(graph.closure_sql("sparemesh_ladder", "SAFE_UPGRADE_FOR"))


@query(
    "j7_compatible_surplus",
    O.sql("inventory requests", "@", ladder=LADDER).replace(
        " @",
        f""", {UP} SELECT r.request_id, i.sku_code, i.cpse, i.depot_id, 'Tier 1' AS dynamic_tier, 0.95::DOUBLE AS compatibility_score FROM requests r JOIN inventory i ON i.item_type = r.item_type AND i.size_nb_mm = r.size_nb_mm AND i.metallurgy = r.metallurgy
              AND (i.pressure_class = r.pressure_class OR EXISTS (SELECT 1 FROM up WHERE better = i.pressure_class || '#' AND replaced = r.pressure_class || '#'))""",
    ),
)
def compatible(spark, sf_dir):
    wanted = V.requests(spark, sf_dir).select(
        "request_id", "item_type", F.concat(F.col("size_nb_mm").cast("string"), F.lit(" mm")).alias("size_value"), F.concat(F.col("pressure_class").cast("string"), F.lit("#")).alias("class_value"), F.col("metallurgy").alias("metal_value"),
    )
    # the columns of the stock that decide or are returned, read three times
    held = V.inventory(spark, sf_dir).select("sku_code", "cpse", "depot_id", "item_type", "size_nb_mm", "pressure_class", "metallurgy")
    held = written(held)
    none = F.lit(None)
    items = graph.item_payload(held.withColumns({"quantity": none.cast("int"), "days_idle": none.cast("int"), "unit_cost_inr": none.cast("double")}))
    out = graph.compatible_surplus(wanted, items, ladder(spark, sf_dir, held))
    return out.select("request_id", "sku_code", "cpse", "depot_id", "dynamic_tier", "compatibility_score")


DEPOTS = "SELECT depot_id, min(depot_location) AS depot_name FROM inventory GROUP BY 1"


def link_sql(side):
    return f"""SELECT n, min(depot_id) AS depot_id FROM (SELECT DISTINCT {side} AS n FROM requisitions) JOIN sites_list ON n = depot_id OR contains(lower(n), lower(depot_name)) OR contains(lower(depot_name), lower(n))
        OR contains(lower(n), split_part(lower(depot_name), ',', 1)) OR contains(lower(depot_name), split_part(lower(n), ',', 1)) GROUP BY n"""


@query("j8_depot_links", O.sql("inventory requisitions", "SELECT n AS source_depot, depot_id FROM (" + link_sql("source_depot") + ")", sites_list=DEPOTS))
def depot_links(spark, sf_dir):
    depots = V.inventory(spark, sf_dir).groupBy("depot_id").agg(F.min("depot_location").alias("depot_name"))
    return graph.depot_links(V.requisitions(spark, sf_dir), depots, "source_depot")


@query(
    "g9_requisition_edges",
    O.sql(
        "inventory requisitions",
        f"""SELECT 'Requisition' AS src_label, requisition_id AS src, 'REQUESTS_ITEM' AS rel, 'InventoryItem' AS dst_label, r.sku_code AS dst FROM requisitions r JOIN inventory USING (sku_code)
            UNION ALL SELECT 'Depot', l.depot_id, 'DISPATCHES_REQUISITION', 'Requisition', requisition_id FROM requisitions JOIN ({link_sql('source_depot')}) l ON l.n = source_depot
            UNION ALL SELECT 'Requisition', requisition_id, 'DESTINED_FOR', 'Depot', l.depot_id FROM requisitions JOIN ({link_sql('target_depot')}) l ON l.n = target_depot""",
        sites_list=DEPOTS,
    ),
)
def requisition_edges(spark, sf_dir):
    items = V.inventory(spark, sf_dir)
    depots = items.groupBy("depot_id").agg(F.min("depot_location").alias("depot_name"))
    return graph.requisition_edges(V.requisitions(spark, sf_dir), items, depots)


@query("u5_duplicate_groups", "WITH t AS (SELECT l_partkey AS a, l_partkey - l_partkey % 7 AS b FROM lineitem UNION SELECT l_partkey - l_partkey % 7, (l_partkey - l_partkey % 7) - (l_partkey - l_partkey % 7) % 49 FROM lineitem), n AS (SELECT a AS item FROM t WHERE a <> b UNION SELECT b FROM t WHERE a <> b) SELECT item, item - item % 49 AS group_id FROM n")
def duplicate_groups(spark, sf_dir):
    part = F.col("l_partkey")
    seven = part - F.pmod(part, F.lit(7))
    line = V.table(spark, sf_dir, "lineitem")
    pairs = line.select(part.alias("a"), seven.alias("b")).unionByName(line.select(seven.alias("a"), (seven - F.pmod(seven, F.lit(49))).alias("b")))
    return graph.duplicate_groups(pairs)


# ---- taxonomy and training ---------------------------------------------------------------------------

MASTER_SQL = f"""SELECT t.i AS type_no, t.item_type, t.type_name, t.unspsc_code, t.gem_category_id FROM ({O.rows('i, item_type, type_name, unspsc_code, gem_category_id', [(i, t, n, u, g) for i, (t, n, _, _, _, u, g) in enumerate(training.MASTER_TYPES)])}) t"""
AXES = dict(
    kinds=MASTER_SQL,
    sizes=O.rows("size_no, mm, inch, dn", [(i, *s) for i, s in enumerate(training.SIZES)]),
    classes=O.rows("class_no, pressure_class", list(enumerate(training.MASTER_CLASSES))),
    metals=O.rows("type_no, metal_no, metallurgy", [(i, j, m) for i, t in enumerate(training.MASTER_TYPES) for j, m in enumerate(t[2])]),
    faces=O.rows("type_no, face_no, facing_end", [(i, j, m) for i, t in enumerate(training.MASTER_TYPES) for j, m in enumerate(t[3])]),
    standards=O.rows("type_no, standard_no, standard", [(i, j, m) for i, t in enumerate(training.MASTER_TYPES) for j, m in enumerate(t[4])]),
    master="""SELECT 'CAN-' || lpad(CAST(row_number() OVER (ORDER BY type_no, size_no, class_no, metal_no, face_no, standard_no) AS VARCHAR), 6, '0') AS canonical_id, item_type, mm AS size_nb_mm, pressure_class, metallurgy, facing_end, standard, unspsc_code, gem_category_id,
              type_name || ', ' || inch || ' (' || dn || '), CLASS ' || pressure_class || ', ' || metallurgy || ', ' || facing_end || ' FACING, ' || standard AS canonical_description
            FROM kinds JOIN sizes ON true JOIN classes ON true JOIN metals USING (type_no) JOIN faces USING (type_no) JOIN standards USING (type_no)""",
)
MASTER_ID = "'CAN-' || lpad(CAST(p_partkey % 1750 + 1 AS VARCHAR), 6, '0')"


def linked_catalog(spark, sf_dir):
    """Parts linked to canonical ids."""
    return V.parts(spark, sf_dir).select(
        F.col("p_partkey").alias("text_id"), F.format_string("CAN-%06d", F.pmod("p_partkey", F.lit(1750)) + 1).alias("canonical_id"), F.concat(F.lit("T"), F.pmod("p_partkey", F.lit(5)).cast("string")).alias("cpse"), "description"
    )


@query("l10_contrastive_pairs", O.sql("parts", f"SELECT 'T' || (p_partkey % 5) || ': ' || p.description AS anchor, 'CANONICAL: ' || canonical_description AS positive, canonical_id, m.item_type, m.size_nb_mm::DOUBLE AS size_nb_mm, m.pressure_class FROM parts p JOIN master m ON m.canonical_id = {MASTER_ID}", **AXES))
def contrastive(spark, sf_dir):
    return catalog.contrastive_pairs(linked_catalog(spark, sf_dir), training.canonical_master(spark))


@query("l9_master_of_parts", O.sql("parts", f"SELECT canonical_id, m.item_type, m.facing_end, m.standard, canonical_description, count(*) AS parts FROM parts JOIN master m ON m.canonical_id = {MASTER_ID} GROUP BY ALL", **AXES))
def master_of_parts(spark, sf_dir):
    master = training.canonical_master(spark).select("canonical_id", "item_type", "facing_end", "standard", "canonical_description")
    counts = linked_catalog(spark, sf_dir).groupBy("canonical_id").agg(F.count("*").alias("parts"))
    return counts.join(master, "canonical_id")


@query("j14_type_codes", O.sql("parts", f"SELECT p_partkey AS text_id, m.unspsc_code, m.gem_category_id FROM parts JOIN master m ON m.canonical_id = {MASTER_ID}", **AXES))
def type_codes(spark, sf_dir):
    kinds = training.canonical_master(spark).select("canonical_id", "item_type")
    rows = linked_catalog(spark, sf_dir).join(kinds, "canonical_id")
    return catalog.assign_codes(rows, training.type_codes(spark)).select("text_id", "unspsc_code", "gem_category_id")


TREE = O.rows("code, title, level, parent_code", training.COMMODITIES)


@query(
    "l11_taxonomy_paths",
    O.sql("parts", "@", tree=TREE, **AXES).replace(
        " @",
        f""", walk(code, depth, path) AS (SELECT code, 1, code FROM tree WHERE parent_code = 'ROOT' UNION ALL SELECT c.code, w.depth + 1, w.path || '/' || c.code FROM walk w JOIN tree c ON c.parent_code = w.code)
            SELECT code, depth, path, count(*) AS parts FROM parts JOIN master m ON m.canonical_id = {MASTER_ID} JOIN walk ON walk.code = m.unspsc_code GROUP BY ALL""",
    ),
)
def taxonomy_paths(spark, sf_dir):
    kinds = training.canonical_master(spark).select("canonical_id", F.col("unspsc_code").alias("code"))
    used = linked_catalog(spark, sf_dir).join(kinds, "canonical_id").groupBy("code").agg(F.count("*").alias("parts"))
    return training.ancestor_paths(training.commodities(spark)).select("code", "depth", "path").join(used, "code")


POSITIONED = """SELECT item_id, item_type, spec, row_number() OVER (ORDER BY item_type, spec, h) - 1 AS pos, row_number() OVER (PARTITION BY item_type, spec ORDER BY h) - 1 AS in_spec, count(*) OVER (PARTITION BY item_type, spec) AS m, count(*) OVER (PARTITION BY item_type) AS n, h,
      ('0x' || substring(h, 4, 12))::BIGINT AS draw FROM (SELECT p_partkey AS item_id, item_type, concat_ws('|', CAST(size_nb_mm AS VARCHAR), CAST(pressure_class AS VARCHAR), coalesce(metallurgy, '?')) AS spec, md5(p_partkey || '|42') AS h FROM parts)"""
STARTS = "SELECT *, min(pos) OVER (PARTITION BY item_type, spec) AS spec_at, min(pos) OVER (PARTITION BY item_type) AS type_at FROM positioned"
TARGETS = """SELECT item_id, 1 AS label, CASE WHEN m > 1 THEN spec_at + (in_spec + j) % m ELSE pos END AS target FROM starts JOIN range(1, 6) r(j) ON j <= greatest(least(5, m - 1), 1)
    UNION ALL SELECT item_id, 0, type_at + CASE WHEN o < spec_at - type_at THEN o ELSE o + m END FROM (SELECT *, (draw % (n - m) + j * greatest(1, (n - m) // 15)) % (n - m) AS o FROM starts JOIN range(0, 15) r(j) ON j < least(15, n - m) WHERE n > m)"""


def items(spark, sf_dir):
    return V.parts(spark, sf_dir).withColumnRenamed("p_partkey", "item_id")


@query("j11_mined_pairs", O.sql("parts", "SELECT t.item_id AS query_id, s.item_id AS candidate_id, label FROM targets t JOIN starts s ON s.pos = t.target", positioned=POSITIONED, starts=STARTS, targets=TARGETS))
def mined_pairs(spark, sf_dir):
    return training.mine_pairs(items(spark, sf_dir))


def drawn(kind):
    return f"('0x' || substring(md5(item_id || '|{kind}' || j || '|42'), 1, 12))::BIGINT"


DRAWS = f"""SELECT item_id, 1 AS label, CASE WHEN m > 1 THEN spec_at + (in_spec + 1 + {drawn("p")} % (m - 1)) % m ELSE pos END AS target FROM starts, range(0, 5) r(j) WHERE n > m OR n < (SELECT count(*) FROM starts)
    UNION ALL SELECT item_id, 0, type_at + CASE WHEN o < spec_at - type_at THEN o ELSE o + m END FROM (SELECT *, {drawn("n")} % (n - m) AS o FROM starts, range(0, 15) r(j) WHERE n > m)
    UNION ALL SELECT item_id, 0, CASE WHEN o < type_at THEN o ELSE o + n END FROM (SELECT *, {drawn("n")} % (total - n) AS o FROM (SELECT *, count(*) OVER () AS total FROM starts), range(0, 15) r(j) WHERE n = m AND n < total)"""


@query("l1_sampled_pairs", O.sql("parts", "SELECT t.item_id AS query_id, s.item_id AS candidate_id, label FROM draws t JOIN starts s ON s.pos = t.target", positioned=POSITIONED, starts=STARTS, draws=DRAWS))
def sampled_pairs(spark, sf_dir):
    return training.mine_pairs(items(spark, sf_dir), replacement=True)


def labelled(spark, sf_dir):
    return V.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("row_id"), F.col("quality").alias("label"))


@query("l2_stratified_split", "SELECT doc_id AS row_id, quality AS label, CASE WHEN row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id || '|42')) <= greatest(1, ceil(count(*) OVER (PARTITION BY quality) * 20 / 100)) THEN 'validation' ELSE 'train' END AS split FROM labels")
def split(spark, sf_dir):
    return training.stratified_split(labelled(spark, sf_dir), "row_id")


@query("l3_group_split", O.sql("", "SELECT doc_id AS row_id, documents.source, CASE WHEN n <= least(total - 1, greatest(1, round_even(total * 0.15, 0))) THEN 'heldout' ELSE 'train' END AS split FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY md5(coalesce(source || '|', '') || '42')) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT source FROM documents)) g ON g.source IS NOT DISTINCT FROM documents.source"))
def group_split(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "source")
    return training.group_split(docs, "source").select("row_id", "source", "split")


@query("w10_area_under_curve", "WITH s AS (SELECT floor(len(text) / 7) AS score, quality AS label FROM labels JOIN documents USING (doc_id)) SELECT round((SELECT sum(CASE WHEN p.score > n.score THEN 1.0 WHEN p.score = n.score THEN 0.5 ELSE 0 END) FROM s p, s n WHERE p.label = 1 AND n.label = 0) / (count(*) FILTER (label = 1) * count(*) FILTER (label = 0)), 9) AS auc, count(*) FILTER (label = 1) AS positives, count(*) FILTER (label = 0) AS negatives FROM s")
def auc(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select("doc_id", F.floor(F.length("text") / 7).cast("double").alias("score"))
    scored = V.table(spark, sf_dir, "labels").join(docs, "doc_id").select("score", F.col("quality").alias("label"))
    return training.area_under_curve(scored).withColumn("auc", F.round("auc", 9))


@query("l4_ranker_auc")
def ranker(spark, sf_dir):
    """A small boosted ranker trained on mined pairs and checked on its validation split."""
    from ..functions.safety import pair_sides as sides, ranking_features

    pairs = training.mine_pairs(items(spark, sf_dir))
    table = training.pair_features_table(pairs, items(spark, sf_dir), "item_id")
    q, c = sides(table.columns)
    rows = table.select(F.concat_ws("-", "query_id", "candidate_id", "label").alias("row_id"), "label", ranking_features(q, c, F.lit(0.8)).alias("features"))
    _, result = training.train_ranker(rows, trees=3, depth=3)
    return result


def tokens(spark, sf_dir):
    """Words of part descriptions with offsets."""
    rows = V.parts(spark, sf_dir).select(F.col("p_partkey").alias("text_id"), F.posexplode(F.split("description", " ")).alias("token_no", "word"), "description")
    before = F.length(F.array_join(F.slice(F.split("description", " "), 1, F.col("token_no")), " "))
    start = F.when(F.col("token_no") == 0, 0).otherwise(before + 1)
    return rows.select("text_id", "token_no", start.alias("start"), (start + F.length("word")).alias("end"))


SPAN_LABELS = ("COLOR", "NAME")
TOKENS = """SELECT text_id, token_no, CASE WHEN token_no = 0 THEN 0 ELSE len(array_to_string(words[1:token_no], ' ')) + 1 END AS s, CASE WHEN token_no = 0 THEN 0 ELSE len(array_to_string(words[1:token_no], ' ')) + 1 END + len(words[token_no + 1]) AS e
    FROM (SELECT p_partkey AS text_id, string_split(description, ' ') AS words, unnest(range(len(string_split(description, ' ')))) AS token_no FROM parts)"""


def spans(spark, sf_dir):
    """Two spans per description: the first word, and everything after it."""
    one = V.parts(spark, sf_dir).select(F.col("p_partkey").alias("text_id"), F.length(F.split("description", " ")[0]).alias("cut"), F.length("description").alias("n"))
    both = F.array(
        F.struct(F.lit(0).alias("span_no"), F.lit(0).alias("start"), F.col("cut").alias("end"), F.lit("COLOR").alias("label")),
        F.struct(F.lit(1).alias("span_no"), (F.col("cut") + 1).alias("start"), F.col("n").alias("end"), F.lit("NAME").alias("label")),
    )
    return one.select("text_id", F.explode(both).alias("x")).select("text_id", "x.*")


@query("l6_bio_tags", O.sql("parts", "SELECT text_id, token_no::INT AS token_no, CASE token_no WHEN 0 THEN 'B-COLOR' WHEN 1 THEN 'B-NAME' ELSE 'I-NAME' END AS tag FROM tokens", tokens=TOKENS))
def bio(spark, sf_dir):
    return training.bio_tags(tokens(spark, sf_dir), spans(spark, sf_dir)).select("text_id", "token_no", "tag")


@query("l7_entity_scores", O.sql("", "SELECT label, tp, fp, fn, round(f1, 9) AS f1 FROM (SELECT *, 2.0 * tp / (2 * tp + fp + fn) AS f1 FROM s UNION ALL SELECT 'macro', sum(tp), sum(fp), sum(fn), avg(2.0 * tp / (2 * tp + fp + fn)) FROM s)", s="SELECT 'COLOR' AS label, count(*) AS tp, 0 AS fp, 0 AS fn FROM part UNION ALL SELECT 'NAME', count(*) FILTER (p_partkey % 3 <> 0), count(*) FILTER (p_partkey % 3 = 0 AND p_partkey % 2 = 0), count(*) FILTER (p_partkey % 3 = 0) FROM part"))
def entity_scores(spark, sf_dir):
    truth = spans(spark, sf_dir)
    k = F.col("text_id")
    wrong = (F.col("label") == "NAME") & (F.pmod(k, F.lit(3)) == 0)
    guess = truth.filter(~wrong | (F.pmod(k, F.lit(2)) == 0)).withColumn("end", F.when(wrong, F.col("end") + 1).otherwise(F.col("end")))
    return training.entity_scores(guess, truth, SPAN_LABELS).select("label", "tp", "fp", "fn", F.round("f1", 9).alias("f1"))


@query("l8_retrieval_tables", O.sql("", "SELECT 'query-' || doc_id AS query_id, source AS document_id, len(text)::BIGINT AS query_chars FROM documents"))
def retrieval_tables(spark, sf_dir):
    docs = V.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("text").alias("anchor"), F.col("text").alias("positive"), F.col("source").alias("canonical_id"))
    queries, _, relevance = training.retrieval_tables(docs)
    return relevance.join(queries, "query_id").select("query_id", "document_id", F.length("text").cast("long").alias("query_chars"))


@query("l12_expected_tiers", O.sql("", "SELECT expected_tier, compatibility_tier, count(*) AS pairs, count(*) FILTER (compatibility_tier = 'TIER_3_INCOMPATIBLE') AS with_violation FROM (SELECT CASE WHEN q % 3 = 0 THEN 'TIER_1_IDENTICAL' ELSE 'TIER_3_INCOMPATIBLE' END AS expected_tier, CASE WHEN c % 40 < q % 40 THEN 'TIER_3_INCOMPATIBLE' ELSE 'TIER_1_IDENTICAL' END AS compatibility_tier FROM pairs) GROUP BY ALL", pairs="SELECT DISTINCT l_partkey AS q, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = o_custkey"))
def expected_tiers(spark, sf_dir):
    from ..operators.rules.verdict import evaluate, expected_versus_actual, prepare_side

    pairs = pair_tables(spark, sf_dir)

    def values(side):
        return F.create_map(F.lit("smys_psi"), side)

    def strength(side):
        return (F.pmod(side, F.lit(40)) * 1000).cast("string")

    # equal pairs are evaluated once and counted
    expected = F.when(F.pmod("q", F.lit(3)) == 0, "TIER_1_IDENTICAL").otherwise("TIER_3_INCOMPATIBLE").alias("expected_tier")
    distinct = pairs.groupBy(expected, strength(F.col("q")).alias("q"), strength(F.col("c")).alias("c")).agg(F.count("*").alias("times"))
    rows = distinct.select(
        "expected_tier", "times", F.lit("PIPE").alias("q_item_type"), F.lit("PIPE").alias("c_item_type"), values(F.col("q")).alias("q_props"), values(F.col("c")).alias("c_props"),
    )
    return expected_versus_actual(evaluate(prepare_side(prepare_side(rows, "q_"), "c_")), times="times")


@query(
    "l13_label_spans",
    O.sql(
        "parts",
        f"""SELECT text_id, label, start, "end" FROM (
              SELECT p_partkey AS text_id, 'PRESSURE_RATING' AS label, strpos(text, 'CLASS ') - 1 AS start, len(text) AS "end" FROM described WHERE pressure_class <= 1500 OR true
              UNION ALL SELECT p_partkey, 'METALLURGY', strpos(text, metallurgy) - 1, strpos(text, metallurgy) - 1 + len(metallurgy) FROM described WHERE metallurgy IS NOT NULL)""",
        described="SELECT p_partkey, pressure_class, metallurgy, concat_ws(' ', description, metallurgy, 'CLASS ' || pressure_class) AS text FROM (SELECT p_partkey, pressure_class, metallurgy, 'x' AS description FROM parts)",
    ).replace("strpos(text, metallurgy) - 1 + len(metallurgy)", "strpos(text, metallurgy) - 1 + len(metallurgy)"),
)
def label_spans(spark, sf_dir):
    rows = V.parts(spark, sf_dir).select(
        F.col("p_partkey").alias("text_id"), F.concat_ws(" ", F.lit("x"), "metallurgy", F.concat(F.lit("CLASS "), F.col("pressure_class").cast("string"))).alias("text"),
        F.lit(None).cast("string").alias("item_type"), F.lit(None).cast("string").alias("facing_end"),
        F.concat(F.lit("CLASS "), F.col("pressure_class").cast("string")).alias("pressure_class"), "metallurgy",
    )
    return training.label_spans(rows).select("text_id", "label", "start", "end")


# ---- vectors -----------------------------------------------------------------------------------------

COS = "list_cosine_similarity(q.{0}, c.{0})"
HITS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS item_id, '{d}' AS domain, {COS.format(d)} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(d)} DESC, c.vec_id) AS rank FROM vectors q JOIN vectors c ON q.block = c.block) WHERE rank <= 25"
    for d in DOMAINS
)
MERGED = "SELECT query_id, item_id, max(score) * 0.75 + sum(score) / 4.0 * 0.25 AS cosine, " + ", ".join(f"max(score) FILTER (domain = '{d}') AS {d}" for d in DOMAINS) + " FROM hits GROUP BY ALL"


def sides(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    return v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id")


@query("v1_domain_hits", O.sql("vectors", "SELECT query_id, item_id, domain, round(score, 6) AS score FROM hits", hits=HITS))
def domain_hits(spark, sf_dir):
    q, c = sides(spark, sf_dir)
    return vectors.top_by_domain(q, c, 25).select("query_id", "item_id", "domain", F.round("score", 6).alias("score"))


@query("v2_fused_scores", O.sql("vectors", "SELECT query_id, item_id, round(cosine, 6) AS cosine, round(dim, 6) AS dim, round(std, 6) AS std FROM merged", hits=HITS, merged=MERGED))
def fused_scores(spark, sf_dir):
    q, c = sides(spark, sf_dir)
    merged = vectors.merge_domains(vectors.top_by_domain(q, c, 25))
    return merged.select("query_id", "item_id", F.round("cosine", 6).alias("cosine"), *[F.round(F.try_element_at("domain_scores", F.lit(d)), 6).alias(d) for d in ("dim", "std")])


def clamp(x):
    return f"greatest(0.0, least(1.0, coalesce({x}, 0.0)))"


SEARCHED = """SELECT m.*, a.item_type AS q_type, b.item_type AS c_type, a.size_nb_mm AS q_size, b.size_nb_mm AS c_size, a.pressure_class AS q_class, b.pressure_class AS c_class, a.metallurgy AS q_metal, b.metallurgy AS c_metal,
      a.facing_end AS q_face, b.facing_end AS c_face, a.standard AS q_std, b.standard AS c_std FROM merged m JOIN vectors a ON a.vec_id = query_id JOIN vectors b ON b.vec_id = item_id WHERE cosine >= 0.70"""
SEARCH_REST = REST.replace("4 * cosine", " + ".join(clamp(d) for d in DOMAINS))
SEARCH_SCORED = f"SELECT *, least(1.0, 0.5 * least(1.0, cosine) + 0.5 * ({SEARCH_REST}) / 12.0) AS similarity, {SAFETY} AS failed FROM searched"


@query(
    "v3_search",
    O.sql(
        "vectors",
        """SELECT query_id, item_id, rank, round(similarity, 6) AS similarity, CASE WHEN failed <> '' THEN 'Tier-4-Reject' WHEN similarity >= 0.85 THEN 'Tier-1' WHEN similarity >= 0.6 THEN 'Tier-3' ELSE 'Tier-4-Reject' END AS tier,
             len(failed) - len(replace(failed, ';', '')) AS violations FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, item_id) AS rank FROM scored) WHERE rank <= 5""",
        hits=HITS, merged=MERGED, searched=SEARCHED, scored=SEARCH_SCORED,
    ),
)
def search(spark, sf_dir):
    """The whole search: fusion, cut, safety, ranking score, tier and top five per query."""
    q, c = sides(spark, sf_dir)
    out = vectors.search(q, c, top_k=5)
    return out.select("query_id", "item_id", "rank", F.round("similarity", 6).alias("similarity"), "tier", F.size("violations").alias("violations"))


@query("w2_plain_search", O.sql("vectors", "SELECT query_id, item_id, round(cosine, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS n FROM merged WHERE cosine >= 0.70) WHERE n <= 25", hits=HITS, merged=MERGED))
def plain_search(spark, sf_dir):
    q, c = sides(spark, sf_dir)
    return vectors.search(q, c, top_k=25, rerank=False).select("query_id", "item_id", F.round("similarity", 6).alias("similarity"))


# every type a request type may be served by; other types serve themselves
FAMILY = """CASE item_type WHEN 'FLANGE' THEN ['FLANGE', 'FLANGE_WELD_NECK', 'FLANGE_SLIP_ON', 'FLANGE_BLIND'] WHEN 'VALVE' THEN ['VALVE', 'GATE_VALVE', 'BALL_VALVE', 'GLOBE_VALVE']
      WHEN 'BOLT' THEN ['BOLT', 'STUD_BOLT'] ELSE [item_type] END"""
STOCKED_TYPE = """CASE WHEN item_type = 'FLANGE' THEN (['FLANGE', 'FLANGE_WELD_NECK', 'FLANGE_SLIP_ON', 'FLANGE_BLIND'])[vec_id % 4 + 1] WHEN item_type = 'VALVE' THEN (['GATE_VALVE', 'BALL_VALVE', 'CHECK_VALVE'])[vec_id % 3 + 1] ELSE item_type END"""
FAMILY_SIDES = dict(
    asked=f"SELECT * REPLACE (CASE WHEN item_type = 'STUD_BOLT' AND vec_id % 2 = 0 THEN 'BOLT' WHEN item_type = 'PIPE' AND vec_id % 5 = 0 THEN NULL ELSE item_type END AS item_type) FROM vectors",
    stocked=f"SELECT * REPLACE ({STOCKED_TYPE} AS item_type) FROM vectors",
)
FAMILY_HITS = " UNION ALL ".join(
    f"SELECT * FROM (SELECT q.vec_id AS query_id, c.vec_id AS item_id, '{d}' AS domain, {COS.format(d)} AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(d)} DESC, c.vec_id) AS rank FROM families q JOIN stocked c ON q.item_type IS NULL OR list_contains(q.family, c.item_type)) WHERE rank <= 25"
    for d in DOMAINS
)
FAMILY_CTES = dict(**FAMILY_SIDES, families=f"SELECT *, {FAMILY} AS family FROM asked", hits=FAMILY_HITS)


def family_sides(spark, sf_dir):
    """Requests by general type (a tenth without one) and stock under specific types."""
    v, k = V.vectors(spark, sf_dir), F.col("vec_id")
    kind = F.col("item_type")
    asked = F.when((kind == "STUD_BOLT") & (F.pmod(k, F.lit(2)) == 0), "BOLT").when((kind == "PIPE") & (F.pmod(k, F.lit(5)) == 0), F.lit(None).cast("string")).otherwise(kind)
    stocked = F.when(kind == "FLANGE", V.pick(k, ("FLANGE", "FLANGE_WELD_NECK", "FLANGE_SLIP_ON", "FLANGE_BLIND"))).when(kind == "VALVE", V.pick(k, ("GATE_VALVE", "BALL_VALVE", "CHECK_VALVE"))).otherwise(kind)
    return v.withColumn("item_type", asked).withColumnRenamed("vec_id", "query_id"), v.withColumn("item_type", stocked).withColumnRenamed("vec_id", "item_id")


@query("v1_family_hits", O.sql("vectors", "SELECT query_id, item_id, domain, rank, round(score, 6) AS score FROM hits", **FAMILY_CTES))
def family_hits(spark, sf_dir):
    """Exact hits of every request among all types that may serve it, through inverted lists."""
    q, c = family_sides(spark, sf_dir)
    return vector_lists.search_lists(q, c, 25).select("query_id", "item_id", "domain", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


@query("w2_family_search", O.sql("vectors", "SELECT query_id, item_id, round(cosine, 6) AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, item_id) AS n FROM merged WHERE cosine >= 0.70) WHERE n <= 25", **FAMILY_CTES, merged=MERGED))
def family_search(spark, sf_dir):
    q, c = family_sides(spark, sf_dir)
    return vectors.search(q, c, top_k=25, rerank=False, families=True).select("query_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query("v1_listed_recall", O.sql("vectors", "SELECT domain, count(*) AS hits, true AS enough FROM hits GROUP BY domain", **FAMILY_CTES))
def listed_recall(spark, sf_dir):
    """Whether the nearest lists alone give nine of ten exact hits."""
    q, c = family_sides(spark, sf_dir)
    exact = vector_lists.search_lists(q, c, 25).select("query_id", "domain", "item_id")
    near = vector_lists.search_lists(q, c, 25, exact=False).select("query_id", "domain", "item_id", F.lit(True).alias("found"))
    both = exact.join(near, ["query_id", "domain", "item_id"], "left").groupBy("domain").agg(F.count("*").alias("hits"), F.count("found").alias("found"))
    return both.select("domain", "hits", (F.col("found") >= 0.9 * F.col("hits")).alias("enough"))


@query("v4_unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))), 6) AS before, 1.0::DOUBLE AS after FROM embeddings")
def unit_vectors(spark, sf_dir):
    from ..functions.vector import norm, unit

    e = V.table(spark, sf_dir, "embeddings").withColumn("d", F.col("embedding"))
    return e.select("vec_id", F.round(norm(F.col("d")), 6).alias("before"), F.round(norm(unit(F.col("d"))), 6).alias("after"))


@query("v5_pair_cosines", O.sql("vectors", "SELECT q.vec_id AS q, c.vec_id AS c, round(list_cosine_similarity(q.dim, c.dim), 6) AS dim_cosine, round(list_cosine_similarity(q.std, c.std), 6) AS std_cosine FROM (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem) JOIN vectors q ON q.vec_id = a JOIN vectors c ON c.vec_id = b"))
def pair_cosines(spark, sf_dir):
    v = V.vectors(spark, sf_dir)
    line = V.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("q"), F.col("l_suppkey").alias("c")).distinct()
    pairs = line.join(v.select(F.col("vec_id").alias("q"), *[F.col(d).alias("q_" + d) for d in DOMAINS]), "q").join(v.select(F.col("vec_id").alias("c"), *[F.col(d).alias("c_" + d) for d in DOMAINS]), "c")
    pairs = pairs.withColumns({"q_vector": F.concat(*["q_" + d for d in DOMAINS]), "c_vector": F.concat(*["c_" + d for d in DOMAINS])})
    return vectors.pair_cosines(pairs).select("q", "c", F.round("dim_cosine", 6).alias("dim_cosine"), F.round("std_cosine", 6).alias("std_cosine"))


@query(
    "l5_retrieval_metrics",
    O.sql("vectors", "SELECT domain, count(*) AS queries, round(avg(CASE WHEN rank <= 1 THEN 1.0 ELSE 0 END), 9) AS recall_at_1, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 9) AS recall_at_5, round(avg(CASE WHEN rank <= 10 THEN 1.0 ELSE 0 END), 9) AS recall_at_10, round(avg(CASE WHEN rank <= 10 THEN 1.0 / rank ELSE 0 END), 9) AS mrr_at_10 FROM (SELECT d.domain, q.vec_id, (SELECT min(h.rank) FROM hits h WHERE h.query_id = q.vec_id AND h.domain = d.domain AND h.item_id = q.vec_id - q.vec_id % 10 + (q.vec_id + 1) % 10) AS rank FROM vectors q, (SELECT DISTINCT domain FROM hits) d) GROUP BY domain", hits=HITS),
)
def metrics(spark, sf_dir):
    q, c = sides(spark, sf_dir)
    ranked = vectors.top_by_domain(q, c, 25)
    k = F.col("query_id")
    item = (k - F.pmod(k, F.lit(10)) + F.pmod(k + 1, F.lit(10))).alias("item_id")
    relevant = q.select(F.explode(F.array(*[F.lit(d) for d in DOMAINS])).alias("domain"), "query_id", item)
    # the search runs once for all domains
    out = training.retrieval_metrics(ranked, relevant, "query_id", "item_id", by=("domain",))
    return out.select("domain", "queries", *[F.round(n, 9).alias(n) for n in ("recall_at_1", "recall_at_5", "recall_at_10", "mrr_at_10")])
