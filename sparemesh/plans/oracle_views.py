"""The derived views as SQL, for checking the Spark results with another engine."""

from __future__ import annotations

from ..functions import geo
from . import views as V


def lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def pick(key: str, values) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[CAST({key} AS BIGINT) % {len(values)} + 1]"


def rows(columns: str, values) -> str:
    body = ", ".join("(" + ", ".join(lit(x) for x in row) + ")" for row in values)
    return f"SELECT * FROM (VALUES {body}) AS t({columns})"


def case(branches, otherwise: str | None = None) -> str:
    """CASE over (condition, value) pairs."""
    body = " ".join(f"WHEN {c} THEN {v}" for c, v in branches)
    return f"CASE {body}{' ELSE ' + otherwise if otherwise is not None else ''} END"


def road_km(a_lat, a_lon, b_lat, b_lon) -> str:
    return (
        f"(2.0 * asin(sqrt(pow(sin((radians({b_lat}) - radians({a_lat})) / 2.0), 2) + cos(radians({a_lat})) * cos(radians({b_lat}))"
        f" * pow(sin((radians({b_lon}) - radians({a_lon})) / 2.0), 2))) * 6371.0 * 1.28)"
    )


def named_point(texts: list[str], axis: str, default: str, mode: str = "first") -> str:
    """lat or lon of the first (or last) depot named in one of the texts."""
    table = V.geo.DEPOTS if mode == "first" else tuple(reversed(V.geo.DEPOTS))
    at = 1 if axis == "lat" else 2
    return case(
        [(" OR ".join(f"contains(lower({t}), {lit(d[0].lower())})" for t in texts), repr(d[at])) for d in table], default
    )


TYPE_CASE = case([(f"p_type = {lit(k)}", lit(v)) for k, v in V.TYPES.items()], "'FITTING'")
SUB_CASE = case([("p_type = 'PROMO'", pick("p_partkey", V.VALVES)), ("p_type = 'ECONOMY'", pick("p_partkey", V.FLANGES))])

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "depots": ((), rows("ord, name, lat, lon", [(i, *d) for i, d in enumerate(geo.DEPOTS)])),
    "parts": (
        (),
        f"""SELECT p_partkey, {TYPE_CASE} AS item_type, concat_ws(' ', p_name, {SUB_CASE}, {TYPE_CASE}) AS description,
            p_size * CAST(10 AS DOUBLE) AS size_nb_mm, {pick('p_partkey', V.CLASSES)} AS pressure_class,
            {pick('p_partkey', V.METALS)} AS metallurgy, {pick('p_partkey', V.FACINGS)} AS facing_end,
            {pick('p_partkey', V.STANDARDS)} AS standard, {pick('p_partkey', V.INDIAN)} AS indian_standard,
            {pick('p_partkey', V.LOCAL)} AS make_in_india_class, CAST(30 + p_partkey % 70 AS DOUBLE) AS local_content_percentage,
            p_retailprice AS unit_cost_inr, p_name FROM part""",
    ),
    "sites": (
        ("depots",),
        """SELECT s_suppkey, 'T' || n_regionkey AS cpse, 'D' || s_nationkey AS depot_id,
            d.name || ' Depot, Zone ' || n_regionkey AS depot_location
           FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN depots d ON d.ord = s_nationkey""",
    ),
    "inventory": (
        ("parts", "sites"),
        f"""SELECT *, CAST(quantity * unit_cost_inr AS DOUBLE) AS total_value_inr,
              CASE WHEN days_idle >= 365 THEN 'SURPLUS_DECLARED' WHEN days_idle >= 180 THEN 'POTENTIAL_SURPLUS' ELSE 'TO_BE_CONSUMED' END AS status,
              days_idle >= 180 AS is_broadcasted_surplus
            FROM (SELECT 'SKU-' || l_partkey || '-' || l_suppkey AS sku_code, 'CAN-' || l_partkey AS canonical_id, s.cpse, s.depot_id, s.depot_location,
              p.item_type, p.description, p.size_nb_mm, p.pressure_class, p.metallurgy, p.facing_end, p.standard, p.indian_standard,
              p.make_in_india_class, p.local_content_percentage, CAST(a.qty AS INT) AS quantity, p.unit_cost_inr, a.days_idle, 'PO-' || l_suppkey AS po_no
            FROM (SELECT l_partkey, l_suppkey, sum(l_quantity) AS qty,
                    CAST(floor(({V.DAY_ZERO} - epoch(max(l_shipdate))) / 86400) AS INT) AS days_idle
                  FROM lineitem GROUP BY l_partkey, l_suppkey) a
            JOIN parts p ON p.p_partkey = a.l_partkey JOIN sites s ON s.s_suppkey = a.l_suppkey)""",
    ),
    "requests": (
        ("parts",),
        f"""SELECT 'R-' || p_partkey AS request_id, 'T' || (p_partkey % 5) AS cpse,
              p_name || {pick('p_partkey', (' IS 2062', ' IS 14846', '', '', '', ''))} AS query_text,
              CASE WHEN item_type = 'VALVE' AND p_partkey % 4 <> 0 THEN {pick('p_partkey', V.VALVES)} || '_VALVE'
                   WHEN item_type = 'FLANGE' AND p_partkey % 4 <> 0 THEN 'FLANGE_' || {pick('p_partkey', V.FLANGES)}
                   WHEN item_type = 'STUD_BOLT' AND p_partkey % 4 <> 0 THEN 'FASTENER' ELSE item_type END AS item_type,
              size_nb_mm, pressure_class, metallurgy, {pick('p_partkey', ('RF', None, None))} AS facing_end, standard, p_partkey
            FROM parts""",
    ),
    "requisitions": (
        ("sites", "depots"),
        """SELECT 'REQ-' || o_orderkey AS requisition_id, o_orderdate AS created_at,
              'SKU-' || (ps // 1000000000) || '-' || (ps % 1000000000) AS sku_code,
              s.cpse AS source_cpse, s.depot_location AS source_depot, 'T' || n_regionkey AS target_cpse, d.name || ' Works' AS target_depot,
              CAST(o_orderkey % 40 + 1 AS INT) AS required_qty, 'user-' || (o_custkey % 97) AS requested_by,
              CASE o_orderstatus WHEN 'F' THEN 'DELIVERED' WHEN 'O' THEN 'PENDING_APPROVAL' ELSE 'APPROVED' END AS status
            FROM orders JOIN (SELECT l_orderkey, min(l_partkey * 1000000000 + l_suppkey) AS ps FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
            JOIN sites s ON s.s_suppkey = ps % 1000000000 JOIN customer ON o_custkey = c_custkey
            JOIN nation ON n_nationkey = c_nationkey JOIN depots d ON d.ord = c_nationkey""",
    ),
    "requisition_events": (
        (),
        " UNION ALL ".join(
            f"""SELECT o_orderkey * 10 + {i} AS event_id, 'REQ-' || o_orderkey AS requisition_id, o_orderdate + INTERVAL {days} DAY AS ts,
                '{kind}' AS event_type, 'P-' || (o_custkey // 10) AS sku_code, CAST(o_orderkey % 40 + 1 AS INT) AS quantity,
                'user-' || ((o_custkey + {i}) % 97) AS actor
                FROM orders WHERE o_orderkey % {div} {'=' if eq else '<>'} {rest}"""
            for i, (kind, days, div, rest, eq) in enumerate(V.STEPS)
        ),
    ),
    "opening_stock": (
        (),
        "SELECT 'P-' || g AS sku_code, CAST(g * 37 % 400 + 100 AS INT) AS quantity FROM (SELECT DISTINCT c_custkey // 10 AS g FROM customer)",
    ),
    "users": (
        ("depots",),
        """SELECT 'user-' || u AS username, 'T' || (u % 5) AS cpse, d.name AS depot_id
           FROM (SELECT DISTINCT c_custkey % 97 AS u FROM customer) JOIN depots d ON d.ord = u % 25""",
    ),
    "ledger_base": (
        (),
        """SELECT event_id AS log_id, ts AS timestamp, upper(event_type) AS action_category, event_type AS action_name,
             'user-' || user_id AS actor_name, 'OPERATOR' AS actor_role, 'T' || (user_id % 5) AS cpse, 'D0' AS depot,
             'REF-' || (event_id % 1000) AS reference_id, props AS details FROM events""",
    ),
    "certificates": (
        (),
        f"""SELECT p_partkey AS doc_id, (p_partkey % 30 + 10) / 100.0::DOUBLE AS c, (p_partkey % 90 + 40) / 100.0::DOUBLE AS mn,
              (p_partkey % 20)::DOUBLE AS cr, (p_partkey % 35) / 10.0::DOUBLE AS mo, (p_partkey % 200 + 180)::DOUBLE AS ys,
              (p_partkey % 300 + 400)::DOUBLE AS ts, (p_partkey % 30 + 10.5)::DOUBLE AS el, {pick('p_partkey', V.GRADES)} AS grade,
              'MTC-' || p_partkey AS cert_no, 'H-' || (p_partkey * 7) AS heat_no, 'Works ' || (p_partkey % 9) AS maker
            FROM part""",
    ),
    "blocks": (
        (),
        """SELECT conv_id AS doc_id, 1 AS page, turn AS block_no, text, (turn % 7 + 3) / 10.0::DOUBLE AS score,
             (turn * 37 % 100)::DOUBLE AS x, turn * 20.0::DOUBLE AS y, role, 200.0::DOUBLE AS page_height FROM conversations""",
    ),
    "vectors": (
        ("parts",),
        """SELECT vec_id, label AS block, CAST(embedding[1:16] AS DOUBLE[]) AS dim, CAST(embedding[17:32] AS DOUBLE[]) AS met,
             CAST(embedding[33:48] AS DOUBLE[]) AS pt, CAST(embedding[49:64] AS DOUBLE[]) AS std,
             item_type, size_nb_mm, pressure_class, metallurgy, facing_end, standard
           FROM embeddings LEFT JOIN parts ON p_partkey = vec_id""",
    ),
}


def sql(names: str, body: str, **extra: str) -> str:
    """``body`` with the named views (and those they need) as common table expressions."""
    order: list[str] = []

    def need(name):
        for other in CTES[name][0]:
            need(other)
        if name not in order:
            order.append(name)

    for name in names.split():
        need(name)
    parts = [f"{n} AS ({CTES[n][1]})" for n in order] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH RECURSIVE " + ", ".join(parts) + " " if parts else "") + body
