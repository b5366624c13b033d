"""Retrieval, scoring and ranking of requests, and the quick checks on pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import matching, ranked_retrieval, retrieval
from ..operators.rules import core
from ..operators.rules.verdict import evaluate, prepare_side
from ..functions import safety
from . import oracle_views as O
from . import views as V
from .flagship import ranked_substitutes
from .registry import query

KEYS = "cpse, base_type, sub_type"
# Requests with their search key; then every (request, item) that fits, ranked as the product ranks them.
ASKED = f"""SELECT *, {O.case([("contains(upper(item_type), 'VALVE')", "'VALVE'"), ("contains(upper(item_type), 'FLANGE')", "'FLANGE'"), ("contains(upper(item_type), 'PIPE')", "'PIPE'"), ("contains(upper(item_type), 'GASKET')", "'GASKET'"), ("contains(upper(item_type), 'FASTENER') OR contains(upper(item_type), 'BOLT')", "'STUD_BOLT'"), ("contains(upper(item_type), 'FITTING')", "'FITTING'")], "upper(item_type)")} AS base_type,
    {O.case([(f"contains(item_type, 'VALVE') AND contains(item_type, '{w}')", f"'{w}'") for w in V.VALVES] + [(f"contains(item_type, 'FLANGE') AND contains(item_type, '{w}')", f"'{w}'") for w in V.FLANGES])} AS sub_type,
    CASE WHEN len(split_part(query_text, ' ', 1)) >= 3 THEN lower(split_part(query_text, ' ', 1)) END AS word FROM requests"""
FITTING = """SELECT a.request_id, i.sku_code,
      coalesce(i.size_nb_mm = a.size_nb_mm, false) OR coalesce(i.metallurgy ILIKE '%' || a.metallurgy || '%', false) OR coalesce(i.pressure_class >= a.pressure_class, false)
        OR coalesce(i.description ILIKE '%' || a.word || '%', false) AS hit
    FROM asked a JOIN inventory i ON i.cpse = a.cpse AND i.item_type = a.base_type AND (a.sub_type IS NULL OR i.description ILIKE '%' || a.sub_type || '%')"""
FOUND = """SELECT request_id, sku_code, filled FROM (
      SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY filled, sku_code) AS n FROM (
        SELECT request_id, sku_code, CASE WHEN hit THEN 0 ELSE 1 END AS filled, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY request_id) AS hits FROM fitting)
      WHERE filled = 0 OR hits < 30) WHERE n <= 50"""


@query("j1_candidates", O.sql("requests inventory", "SELECT request_id, sku_code, filled FROM found", asked=ASKED, fitting=FITTING, found=FOUND))
def candidates(spark, sf_dir):
    found = retrieval.retrieve(V.requests(spark, sf_dir), V.inventory(spark, sf_dir))
    return found.select("request_id", "sku_code", "filled")


# The same items ranked by fit: size 8, metal 4, class 2, word 1.
RATED = """SELECT *, CASE WHEN fit > 0 THEN 0 ELSE 1 END AS filled, sum(CASE WHEN fit > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY request_id)::BIGINT AS hits FROM (
      SELECT a.request_id, i.sku_code, 8 * coalesce(i.size_nb_mm = a.size_nb_mm, false)::INT + 4 * coalesce(i.metallurgy ILIKE '%' || a.metallurgy || '%', false)::INT
        + 2 * coalesce(i.pressure_class >= a.pressure_class, false)::INT + coalesce(i.description ILIKE '%' || a.word || '%', false)::INT AS fit
      FROM asked a JOIN inventory i ON i.cpse = a.cpse AND i.item_type = a.base_type AND (a.sub_type IS NULL OR i.description ILIKE '%' || a.sub_type || '%'))"""
RANKED = """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY fit DESC, sku_code) AS n FROM rated WHERE fit > 0 OR hits < 30) WHERE n <= 50"""


@query("j1_ranked_candidates", O.sql("requests inventory", "SELECT request_id, sku_code, filled, fit, hits, greatest(hits - 50, 0) AS cut FROM ranked", asked=ASKED, rated=RATED, ranked=RANKED))
def ranked_candidates(spark, sf_dir):
    """The best candidates of each request by fit, and how many more there are."""
    found = ranked_retrieval.retrieve_ranked(V.requests(spark, sf_dir), V.inventory(spark, sf_dir), with_item=False)
    return found.select("request_id", "sku_code", "filled", "fit", "hits", "cut")


@query("j3_item_types", O.sql("requests", "SELECT request_id, item_type, base_type, sub_type FROM asked", asked=ASKED))
def item_types(spark, sf_dir):
    base, sub = retrieval.resolve_type(F.col("item_type"))
    return V.requests(spark, sf_dir).select("request_id", "item_type", base.alias("base_type"), sub.alias("sub_type"))


# ---- rules on pairs ----------------------------------------------------------------------------------
# A linear pair source: the part of a line and the part numbered like the order's customer.

METAL_TABLE = O.rows(
    "metal, family, level",
    [(m, f, lv) for m in V.METALS if m for f, lv, names in core.FAMILIES if m in names],
)
PAIRS = """SELECT DISTINCT l_partkey AS q, o_custkey AS c FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = o_custkey"""
SIDES = """SELECT q, c, a.item_type AS q_type, b.item_type AS c_type, a.size_nb_mm AS q_size, b.size_nb_mm AS c_size, a.pressure_class AS q_class, b.pressure_class AS c_class,
      a.metallurgy AS q_metal, b.metallurgy AS c_metal, x.family AS q_family, y.family AS c_family, x.level AS q_level, y.level AS c_level,
      a.facing_end AS q_face, b.facing_end AS c_face, a.standard AS q_std, b.standard AS c_std
    FROM pairs JOIN parts a ON a.p_partkey = q JOIN parts b ON b.p_partkey = c LEFT JOIN metals x ON x.metal = a.metallurgy LEFT JOIN metals y ON y.metal = b.metallurgy"""
CLASS_AT = "list_position([150, 300, 600, 900, 1500, 2500], {0})"
# tier, score and code of the core rules as SQL; {p} columns come from SIDES
CLASS_TIER = """CASE WHEN q_class = c_class THEN 1 WHEN c_class < q_class THEN 3 WHEN q_type = 'FLANGE' THEN 3 ELSE 1 END"""
CLASS_SCORE = f"""CASE WHEN q_class = c_class THEN 1.0 WHEN c_class < q_class OR q_type = 'FLANGE' THEN 0.0
    ELSE greatest(0.95, 1.0 - ({CLASS_AT.format('c_class')} - {CLASS_AT.format('q_class')}) * 0.01) END"""
CLASS_CODE = "CASE WHEN c_class < q_class THEN 'CLASS_DOWN' WHEN c_class > q_class AND q_type = 'FLANGE' THEN 'BOLT_CIRCLE' END"
NO_METAL = "q_metal IS NULL AND c_metal IS NULL"
METAL_BRANCHES = [
    ("q_metal IS NULL OR c_metal IS NULL", 2, "0.85", None),
    ("q_metal = c_metal", 1, "1.0", None),
    ("contains(q_metal, '304') AND NOT contains(q_metal, '304L') AND contains(c_metal, '316')", 1, "0.98", None),
    ("q_family = c_family", 1, "1.0", None),
    ("q_family = 'LOW_TEMP_CARBON_STEEL'", 3, "0.0", "CRYOGENIC"),
    ("q_family = 'AUSTENITIC_SS_304L' AND c_family IN ('AUSTENITIC_SS_304', 'MOLYBDENUM_SS_316')", 3, "0.0", "SENSITIZATION"),
    ("q_level >= 10 AND c_level < 10", 3, "0.0", "CREEP"),
    ("c_level >= 10 AND q_level < 10", 2, "0.88", None),
    ("c_level < q_level", 3, "0.0", "METAL_DOWN"),
    ("c_level > q_level", 2, "greatest(0.8, 1.0 - (c_level - q_level) * 0.05)", None),
]
METAL_TIER = O.case([(NO_METAL, "1")] + [(w, str(t)) for w, t, _, _ in METAL_BRANCHES], "2")
METAL_SCORE = O.case([(NO_METAL, "1.0")] + [(w, s) for w, _, s, _ in METAL_BRANCHES], "0.82")
METAL_CODE = O.case([(NO_METAL, "NULL")] + [(w, O.lit(code)) for w, _, _, code in METAL_BRANCHES], "NULL")
SIZE_OK = "abs(q_size - c_size) < 0.01"
RF_RTJ = "((q_face = 'RF' AND c_face = 'RTJ') OR (q_face = 'RTJ' AND c_face = 'RF'))"
FACE_TIER = f"CASE WHEN q_face IS NULL AND c_face IS NULL THEN 1 WHEN q_face = c_face THEN 1 WHEN q_face IS NULL OR c_face IS NULL THEN 2 ELSE 3 END"
FACE_SCORE = "CASE WHEN q_face IS NULL AND c_face IS NULL THEN 1.0 WHEN q_face = c_face THEN 1.0 WHEN q_face IS NULL OR c_face IS NULL THEN 0.85 ELSE 0.0 END"
FACE_CODE = f"CASE WHEN {RF_RTJ} THEN 'FACING' WHEN q_face <> c_face THEN 'CONNECTION' END"


def asked_pairs(spark, sf_dir):
    """Distinct (part of a line, customer of its order), dealt by customer, by which they are joined next."""
    line = V.table(spark, sf_dir, "lineitem").select("l_partkey", "l_orderkey")
    orders = V.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("q"), F.col("o_custkey").alias("c"))
    return rows.repartition("c").distinct()


def pair_tables(spark, sf_dir):
    keys = V.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("c"))
    return asked_pairs(spark, sf_dir).join(keys, "c")


def pair_sides(spark, sf_dir, prepared=True):
    """Pairs with the attributes of both parts under q_ and c_."""
    parts = safety.side_columns(V.parts(spark, sf_dir))
    parts = prepare_side(parts) if prepared else parts
    names = [n for n in parts.columns if n != "p_partkey"]
    q = parts.select(F.col("p_partkey").alias("q"), *[F.col(n).alias("q_" + n) for n in names])
    c = parts.select(F.col("p_partkey").alias("c"), *[F.col(n).alias("c_" + n) for n in names])
    # the join with the candidates also drops what is no part
    return asked_pairs(spark, sf_dir).join(c, "c").join(q, "q")


def rule_columns(out, name="out"):
    return [F.col(f"{name}.tier").alias("tier"), F.col(f"{name}.score").alias("score"), F.col(f"{name}.code").alias("code")]


CORE = dict(pairs=PAIRS, metals=METAL_TABLE, sides=SIDES)


@query("r1_size_rule", O.sql("parts", f"SELECT q, c, CASE WHEN {SIZE_OK} THEN 1 ELSE 3 END AS tier, CASE WHEN {SIZE_OK} THEN 1.0 ELSE 0.0 END::DOUBLE AS score, CASE WHEN NOT ({SIZE_OK}) THEN 'DIMENSIONAL_ZERO_TOLERANCE' END AS code FROM sides", **CORE))
def size_rule(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir)
    return pairs.withColumn("out", core.size_rule(F.col("q_size_nb_mm"), F.col("c_size_nb_mm"))).select("q", "c", *rule_columns(pairs))


@query("r2_pressure_class_rule", O.sql("parts", f"SELECT q, c, {CLASS_TIER} AS tier, round(({CLASS_SCORE})::DOUBLE, 9) AS score, {CLASS_CODE} AS code FROM sides", **CORE))
def class_rule(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir)
    rule = core.pressure_class_rule(F.col("q_pressure_class"), F.col("c_pressure_class"), F.col("q_item_type"), F.lit(False))
    return pairs.withColumn("out", rule).select("q", "c", *rule_columns(pairs)).withColumn("score", F.round("score", 9))


PSI = "SELECT q, c, CASE WHEN q % 7 = 0 THEN NULL ELSE q % 40 * 10.0::DOUBLE + 100 END AS a, CASE WHEN c % 9 = 0 THEN NULL ELSE c % 40 * 10.0::DOUBLE + 100 END AS b FROM pairs"


@query(
    "r3_pressure_psi_rule",
    O.sql(
        "",
        """SELECT q, c, CASE WHEN a IS NULL AND b IS NULL THEN 1 WHEN a IS NULL OR b IS NULL THEN 2 WHEN abs(b - a) < 0.01 THEN 1 WHEN b < a THEN 3 ELSE 1 END AS tier,
             round((CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL OR b IS NULL THEN 0.85 WHEN abs(b - a) < 0.01 THEN 1.0 WHEN b < a THEN 0.0
               ELSE greatest(0.95, least(1.0, 0.95 + 0.05 * (1.0 - (b - a) / a))) END)::DOUBLE, 9) AS score, CASE WHEN b < a THEN 'PSI_DOWN' END AS code FROM psi""",
        pairs=PAIRS, psi=PSI,
    ),
)
def psi_rule(spark, sf_dir):
    def psi(key, skip):
        return F.when(F.pmod(key, F.lit(skip)) != 0, F.pmod(key, F.lit(40)) * 10.0 + 100.0)

    pairs = pair_tables(spark, sf_dir)
    return pairs.withColumn("out", core.pressure_psi_rule(psi(F.col("q"), 7), psi(F.col("c"), 9))).select("q", "c", *rule_columns(pairs)).withColumn("score", F.round("score", 9))


# the rule alone, without the guard for pairs that name no metal at all
RULE_TIER, RULE_SCORE, RULE_CODE = (O.case([(b[0], pick(b)) for b in METAL_BRANCHES], rest) for pick, rest in ((lambda b: str(b[1]), "2"), (lambda b: b[2], "0.82"), (lambda b: O.lit(b[3]), "NULL")))


@query("r4_metal_rule", O.sql("parts", f"SELECT q, c, {RULE_TIER} AS tier, round(({RULE_SCORE})::DOUBLE, 9) AS score, {RULE_CODE} AS code FROM sides", **CORE))
def metal_rule(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir)
    rule = core.metal_rule(*[F.col(s + n) for n in ("metal", "metal_name", "metal_family") for s in ("q_", "c_")])
    return pairs.withColumn("out", rule).select("q", "c", *rule_columns(pairs)).withColumn("score", F.round("score", 9))


@query("r5_facing_rule", O.sql("parts", f"SELECT q, c, {FACE_TIER} AS tier, ({FACE_SCORE})::DOUBLE AS score, {FACE_CODE} AS code FROM sides", **CORE))
def facing_rule(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir)
    none = F.lit(None).cast("string")
    rule = core.facing_rule(F.col("q_facing"), F.col("c_facing"), F.col("c_metal"), F.lit(False), none, none)
    return pairs.withColumn("out", rule).select("q", "c", *rule_columns(pairs))


SCHEDULE_TEXTS = ("40", "SCH 80", "schedule 160", "STD", "XXS", "SCH 5S", "odd", "")
SCHEDULE_NAMES = ("SCH 40", "SCH 80", "SCH 160", "STD", "XXS", "SCH 5S", "ODD", None)
AT = f"list_position([{', '.join(O.lit(s) for s in core.SCHEDULES)}], {{0}})"


@query(
    "r6_schedule_rule",
    O.sql(
        "",
        f"""SELECT q, c, CASE WHEN a IS NULL AND b IS NULL THEN 1 WHEN a IS NULL OR b IS NULL THEN 2 WHEN a = b THEN 1 WHEN x IS NULL OR y IS NULL THEN 2 WHEN y < x THEN 3 ELSE 2 END AS tier,
              (CASE WHEN a IS NULL AND b IS NULL THEN 1.0 WHEN a IS NULL OR b IS NULL THEN 0.85 WHEN a = b THEN 1.0 WHEN x IS NULL OR y IS NULL THEN 0.85 WHEN y < x THEN 0.0 ELSE 0.9 END)::DOUBLE AS score,
              CASE WHEN y < x THEN 'SCHEDULE_DOWN' END AS code
            FROM (SELECT *, nullif({AT.format('a')}, 0) AS x, nullif({AT.format('b')}, 0) AS y FROM
              (SELECT q, c, {O.pick('q', SCHEDULE_NAMES)} AS a, {O.pick('c', SCHEDULE_NAMES)} AS b FROM pairs))""",
        pairs=PAIRS,
    ),
)
def schedule_rule(spark, sf_dir):
    pairs = pair_tables(spark, sf_dir)
    rule = core.schedule_rule(V.pick(F.col("q"), SCHEDULE_TEXTS), V.pick(F.col("c"), SCHEDULE_TEXTS))
    return pairs.withColumn("out", rule).select("q", "c", *rule_columns(pairs))


# Verdict over the core rules plus the three specialised rules that fire on bare part attributes.
GASKET_OUT = "q_type = 'GASKET' AND q_class >= 900"
BOLT_OUT = "q_type = 'STUD_BOLT' AND coalesce(q_metal, '') <> coalesce(c_metal, '')"
SCORED = f"""SELECT *, [CASE WHEN {SIZE_OK} THEN 1.0 ELSE 0.0 END, {CLASS_SCORE}, {METAL_SCORE}, {FACE_SCORE}] AS main,
      NOT ({SIZE_OK}) OR {CLASS_TIER} = 3 OR {METAL_TIER} = 3 OR {FACE_TIER} = 3 OR ({GASKET_OUT}) AS fatal,
      {CLASS_TIER} = 1 AND {METAL_TIER} = 1 AND {FACE_TIER} = 1 AND NOT ({BOLT_OUT}) AS all_one, ({BOLT_OUT}) AS bolt FROM sides"""
VERDICT = """SELECT *, CASE WHEN fatal THEN 'TIER_3_INCOMPATIBLE' WHEN mean >= 0.95 AND all_one THEN 'TIER_1_IDENTICAL' WHEN mean >= 0.80 THEN 'TIER_2_SUBSTITUTE' ELSE 'TIER_3_INCOMPATIBLE' END AS tier FROM
      (SELECT *, (main[1] + main[2] + main[3] + main[4] + CASE WHEN bolt THEN 0.88 ELSE 0 END)::DOUBLE / (4 + CASE WHEN bolt THEN 1 ELSE 0 END) AS mean FROM scored)"""
FIRST_CODE = f"coalesce(CASE WHEN NOT ({SIZE_OK}) THEN 'DIMENSIONAL_ZERO_TOLERANCE' END, CASE WHEN {CLASS_CODE} IS NOT NULL THEN 'ASME_B16_5' END, CASE WHEN {METAL_CODE} IS NOT NULL THEN 'ASTM_METALLURGY_DAG' END, CASE WHEN {RF_RTJ} THEN 'ASME_B16_5_FACING' WHEN q_face <> c_face THEN 'FACING_AND_CONNECTION_MISMATCH' END, CASE WHEN {GASKET_OUT} THEN 'ASME_B16_20_INNER_RING' END)"


@query(
    "r35_verdict",
    O.sql(
        "parts",
        f"SELECT q, c, tier AS compatibility_tier, CASE WHEN fatal THEN 0.0 ELSE round(mean, 4) END AS composite_score, tier = 'TIER_2_SUBSTITUTE' AS requires_hitl, {FIRST_CODE} AS first_violation FROM verdict",
        **CORE, scored=SCORED, verdict=VERDICT,
    ),
)
def verdict(spark, sf_dir):
    out = evaluate(pair_sides(spark, sf_dir))
    return out.select("q", "c", "compatibility_tier", "composite_score", "requires_hitl", F.try_element_at(F.col("rule_violations"), F.lit(1))["module_name"].alias("first_violation"))


@query(
    "r34_scorecard",
    O.sql(
        "parts",
        f"""SELECT name, status, count(*) AS pairs FROM (
              SELECT 'DIMENSIONS' AS name, CASE WHEN {SIZE_OK} THEN 'IDENTICAL' ELSE 'HARD_REJECT' END AS status FROM sides
              UNION ALL SELECT 'PRESSURE_RATING', CASE {CLASS_TIER} WHEN 3 THEN 'HARD_REJECT' ELSE CASE WHEN ({CLASS_SCORE})::DOUBLE >= 0.99 THEN 'IDENTICAL' ELSE 'SAFE_UPGRADE' END END FROM sides
              UNION ALL SELECT 'METALLURGY', CASE {METAL_TIER} WHEN 3 THEN 'HARD_REJECT' WHEN 2 THEN 'ADAPTABLE' ELSE CASE WHEN {METAL_SCORE} >= 0.99 THEN 'IDENTICAL' ELSE 'SAFE_UPGRADE' END END FROM sides
              UNION ALL SELECT 'CONNECTION', CASE {FACE_TIER} WHEN 3 THEN 'HARD_REJECT' WHEN 2 THEN 'ADAPTABLE' ELSE 'IDENTICAL' END FROM sides
              UNION ALL SELECT 'GASKETS', 'HARD_REJECT' FROM sides WHERE {GASKET_OUT}
              UNION ALL SELECT 'FASTENERS_LME', 'ADAPTABLE' FROM sides WHERE {BOLT_OUT}) GROUP BY ALL""",
        **CORE,
    ),
)
def scorecard(spark, sf_dir):
    out = evaluate(pair_sides(spark, sf_dir)).select(F.explode_outer("evaluations").alias("e"))
    return out.groupBy(F.col("e.name").alias("name"), F.col("e.status").alias("status")).agg(F.count("*").alias("pairs"))


# ---- ranking features and the whole match ------------------------------------------------------------

RANKS = {"ASTM A105": 0, "ASTM A350 LF2": 1, "SS304": 2, "SS304L": 2, "SS316": 2}
RANK = O.case([(f"{{0}} = {O.lit(m)}", str(r)) for m, r in RANKS.items()], "NULL")
Q_RANK, C_RANK = RANK.replace("{0}", "q_metal"), RANK.replace("{0}", "c_metal")
METALS_OK = f"(lower(q_metal) = lower(c_metal) OR {Q_RANK} IS NULL OR {C_RANK} IS NULL OR {C_RANK} >= {Q_RANK})"


def agree(a, b):
    return f"CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.5 WHEN lower({a}) = lower({b}) THEN 1.0 ELSE 0.0 END"


def both(a, b):
    return f"CASE WHEN {a} IS NOT NULL AND {b} IS NOT NULL THEN 1 ELSE 0 END"


COSINE = f"""CASE WHEN q_metal IS NOT NULL AND c_metal IS NOT NULL
    THEN (CAST(q_type = c_type AS INT) + CAST(abs(q_size - c_size) <= 1e-5 AS INT) + CAST(q_class = c_class AS INT) + CAST(upper(q_metal) = upper(c_metal) AS INT)) / 4.0::DOUBLE
    ELSE (CAST(q_type = c_type AS INT) + CAST(abs(q_size - c_size) <= 1e-5 AS INT) + CAST(q_class = c_class AS INT)) / 3.0::DOUBLE END"""
REST = f"""(CAST(q_size = c_size AS INT) + CAST(q_class = c_class AS INT) + CAST(c_class >= q_class AS INT)
    + CASE WHEN q_metal IS NULL OR c_metal IS NULL THEN 0.5 WHEN {METALS_OK} THEN 1.0 ELSE 0.0 END
    + {agree('q_type', 'c_type')} + {agree('q_face', 'c_face')} + {agree('q_std', 'c_std')}
    + (3 + {both('q_metal', 'c_metal')} + {both('q_face', 'c_face')} + {both('q_std', 'c_std')}) / 6.0::DOUBLE + 4 * cosine)"""
FEATURES = f"SELECT *, {COSINE} AS cosine FROM sides"
MODEL = f"SELECT *, 0.5 * cosine + 0.5 * ({REST} / 12.0::DOUBLE) AS model_score FROM features"


@query("p10_ranking_score", O.sql("parts", "SELECT q, c, round(cosine, 9) AS cosine, round(model_score, 9) AS model_score FROM model", **CORE, features=FEATURES, model=MODEL))
def ranking(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    out = pairs.select("q", "c", safety.estimated_cosine(q, c).alias("cosine"), *[x for x in pairs.columns if x not in ("q", "c")])
    score = safety.ranking_score(safety.ranking_features(q, c, F.col("cosine")))
    return out.select("q", "c", F.round("cosine", 9).alias("cosine"), F.round(score, 9).alias("model_score"))


@query(
    "p8_ranking_features",
    O.sql(
        "parts",
        f"""SELECT q, c, CAST(q_size = c_size AS INT)::DOUBLE AS f1, CAST(q_class = c_class AS INT)::DOUBLE AS f2, CAST(c_class >= q_class AS INT)::DOUBLE AS f3,
              (CASE WHEN q_metal IS NULL OR c_metal IS NULL THEN 0.5 WHEN {METALS_OK} THEN 1.0 ELSE 0.0 END)::DOUBLE AS f4, ({agree('q_type', 'c_type')})::DOUBLE AS f5,
              ({agree('q_face', 'c_face')})::DOUBLE AS f6, ({agree('q_std', 'c_std')})::DOUBLE AS f7,
              round((3 + {both('q_metal', 'c_metal')} + {both('q_face', 'c_face')} + {both('q_std', 'c_std')}) / 6.0::DOUBLE, 9) AS f8, 0.8::DOUBLE AS f12 FROM sides""",
        **CORE,
    ),
)
def features(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    out = pairs.withColumn("f", safety.ranking_features(q, c, F.lit(0.8)))
    return out.select("q", "c", *[F.col("f")[i].alias(f"f{i}") for i in range(1, 8)], F.round(F.col("f")[8], 9).alias("f8"), F.col("f")[12].alias("f12"))


SAFETY = f"""(CASE WHEN q_size <> c_size THEN 'size;' ELSE '' END || CASE WHEN c_class < q_class THEN 'class;' ELSE '' END
    || CASE WHEN q_metal IS NOT NULL AND c_metal IS NOT NULL AND NOT {METALS_OK} THEN 'metal;' ELSE '' END || CASE WHEN q_type <> c_type THEN 'type;' ELSE '' END
    || CASE WHEN (q_type = 'VALVE' OR c_type = 'VALVE') AND ((q_std = 'API 600' AND c_std = 'API 608') OR (q_std = 'API 608' AND c_std = 'API 600')) THEN 'standard;' ELSE '' END)"""


@query("r37_safety_checks", O.sql("parts", f"SELECT q, c, {SAFETY} AS failed FROM sides", **CORE))
def safety_checks(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    kinds = (("size", "size"), ("pressure", "class"), ("metallurgy", "metal"), ("item", "type"), ("incompatible", "standard"))
    names = F.create_map(*[F.lit(x) for pair in kinds for x in pair])
    found = F.transform(safety.safety_violations(q, c), lambda v: F.concat(F.try_element_at(names, F.regexp_extract(v, r"^(\w+)", 1)), F.lit(";")))
    return pairs.select("q", "c", F.array_join(found, "").alias("failed"))


@query("r40_search_tier", O.sql("parts", f"SELECT q, c, CASE WHEN {SAFETY} <> '' THEN 'Tier-4-Reject' WHEN model_score >= 0.85 THEN 'Tier-1' WHEN model_score >= 0.6 THEN 'Tier-3' ELSE 'Tier-4-Reject' END AS tier FROM model", **CORE, features=FEATURES, model=MODEL))
def search_tier(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    out = pairs.withColumns({"v": safety.safety_violations(q, c), "s": safety.ranking_score(safety.ranking_features(q, c, safety.estimated_cosine(q, c)))})
    return out.select("q", "c", safety.search_tier(F.round("s", 12), F.col("v")).alias("tier"))


ALLOY = "(q_metal IS NULL OR c_metal IS NULL OR lower(q_metal) = lower(c_metal))"


@query(
    "r39_classified_pairs",
    O.sql(
        "parts",
        f"""SELECT q, c, tier, CASE WHEN tier = 'Tier-4-Reject' THEN 0.0 ELSE round(model_score, 9) END::DOUBLE AS confidence,
              CASE tier WHEN 'Tier-1' THEN 'auto-link' WHEN 'Tier-4-Reject' THEN 'manual-entry' ELSE 'hitl' END AS routing, violations FROM
            (SELECT *, CASE WHEN violations > 0 THEN 'Tier-4-Reject' WHEN round(model_score, 12) >= 0.85 THEN 'Tier-1' WHEN round(model_score, 12) >= 0.6 THEN 'Tier-3' ELSE 'Tier-4-Reject' END AS tier FROM
              (SELECT *, len({SAFETY}) - len(replace({SAFETY}, ';', '')) + CAST(q_size <> c_size AS INT) + CAST(c_class < q_class AS INT) + CAST(NOT {ALLOY} AS INT) AS violations FROM model))""",
        **CORE, features=FEATURES, model=MODEL,
    ),
)
def classified(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    out = pairs.withColumn("cosine", safety.estimated_cosine(q, c))
    out = out.withColumn("s", safety.ranking_score(safety.ranking_features(q, c, F.col("cosine"))))
    out = safety.classify_pairs(out.withColumn("s", F.round("s", 12)), "s")
    return out.select("q", "c", "tier", F.round("confidence", 9).alias("confidence"), "routing", F.size("violations").alias("violations"))


@query("r38_allowed_substitutes", O.sql("parts", f"SELECT q, c, q_size = c_size AS size_ok, c_class >= q_class AS class_ok, {ALLOY} AS alloy_ok FROM sides", **CORE))
def allowed(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    made = safety.decisions(q, c)
    return pairs.select("q", "c", made["size"][0].alias("size_ok"), made["pressure"][0].alias("class_ok"), made["metallurgy"][0].alias("alloy_ok"))


@query(
    "p12_match_reasons",
    O.sql(
        "parts",
        f"""SELECT q, c, concat_ws('; ', CASE WHEN q_size = c_size THEN '✓ Exact size match (' || printf('%.1f', c_size) || ' mm)' ELSE '✗ Size mismatch (' || q_size || ' → ' || c_size || ' mm)' END,
              CASE WHEN c_class < q_class THEN '✗ Pressure class downgrade (' || q_class || ' → ' || c_class || ')' WHEN c_class > q_class THEN '✓ Pressure class upgrade (' || q_class || ' → ' || c_class || ')' ELSE '✓ Exact pressure class match (' || q_class || ')' END,
              CASE WHEN q_metal IS NOT NULL AND c_metal IS NOT NULL THEN CASE WHEN {METALS_OK} THEN '✓' ELSE '✗' END || ' Metallurgy: ' || q_metal || ' → ' || c_metal END) AS reasons FROM sides""",
        **CORE,
    ),
)
def reasons(spark, sf_dir):
    pairs = pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    return pairs.select("q", "c", F.array_join(safety.match_reasons(q, c), "; ").alias("reasons"))


MATCH_SIDES = """SELECT r.request_id, r.query_text, i.sku_code, i.cpse, i.depot_location, r.item_type AS q_type, i.item_type AS c_type, r.size_nb_mm AS q_size, i.size_nb_mm AS c_size,
      r.pressure_class AS q_class, i.pressure_class AS c_class, r.metallurgy AS q_metal, i.metallurgy AS c_metal, x.family AS q_family, y.family AS c_family, x.level AS q_level, y.level AS c_level,
      r.facing_end AS q_face, i.facing_end AS c_face, r.standard AS q_std, i.standard AS c_std, i.indian_standard, i.make_in_india_class, i.local_content_percentage, i.unit_cost_inr
    FROM found f JOIN requests r USING (request_id) JOIN inventory i USING (sku_code) LEFT JOIN metals x ON x.metal = r.metallurgy LEFT JOIN metals y ON y.metal = i.metallurgy"""
MII = "(local_content_percentage >= 50 OR coalesce(make_in_india_class, CASE WHEN local_content_percentage >= 50 THEN 'Class-I' ELSE 'Class-II' END) = 'Class-I')"


def carried(*markers):
    return " OR ".join(f"contains(coalesce({c}, ''), '{m}')" for m in markers for c in ("c_metal", "indian_standard", "c_std"))


EQUIVALENT = f"((contains(query_text, 'IS 2062') AND ({carried('A105', 'IS 2062')})) OR (contains(query_text, 'IS 14846') AND ({carried('API 600', 'WCB', 'IS 14846')})))"
COMBINED = f"""SELECT *, CASE WHEN compatible THEN boosted ELSE least(boosted, 0.74) END AS combined FROM
      (SELECT *, least(1.0, CASE WHEN equivalent AND compatible THEN greatest(base, 0.95) ELSE base END + CASE WHEN {MII} THEN 0.03 ELSE 0.0 END) AS boosted FROM
        (SELECT *, 0.7 * CASE WHEN fatal THEN 0.0 ELSE round(mean, 4) END + 0.3 * model_score AS base, tier <> 'TIER_3_INCOMPATIBLE' AS compatible, {EQUIVALENT} AS equivalent FROM model))"""
MATCH_VERDICT = VERDICT
PLACE = O.named_point(["depot_location"], "lat", repr(V.geo.CENTRAL[0])), O.named_point(["depot_location"], "lon", repr(V.geo.CENTRAL[1]))
KM = O.road_km(repr(V.geo.PANIPAT[0]), repr(V.geo.PANIPAT[1]), PLACE[0], PLACE[1])
# the flange rule looks at the exact requested type
MATCH_SCORED = SCORED.replace("q_type = 'FLANGE'", "q_type = 'FLANGE'").replace("q_type = 'STUD_BOLT'", "q_type IN ('STUD_BOLT', 'FASTENER')")
VALVE_TYPES = "'GATE_VALVE', 'BALL_VALVE', 'GLOBE_VALVE', 'CHECK_VALVE', 'BUTTERFLY_VALVE', 'FLANGE'"
MATCH_SCORED = MATCH_SCORED.replace("q_type = 'FLANGE'", f"q_type IN ({VALVE_TYPES})")
MATCH_CTES = dict(
    metals=METAL_TABLE, asked=ASKED, fitting=FITTING, found=FOUND, sides=MATCH_SIDES, scored=MATCH_SCORED, verdict=MATCH_VERDICT,
    features=f"SELECT *, {COSINE} AS cosine FROM verdict", model=MODEL, combined=COMBINED,
)
# the same with the candidates that fit best
BEST_CTES = {k: v for name, body in MATCH_CTES.items() for k, v in ({"rated": RATED, "found": RANKED} if name == "found" else {} if name == "fitting" else {name: body}).items()}
TIER = "CASE WHEN NOT compatible THEN 'Tier 3' WHEN combined >= 0.95 THEN 'Tier 1' WHEN combined >= 0.8 THEN 'Tier 2' ELSE 'Tier 3' END"


@query(
    "p2_match_scores",
    O.sql(
        "requests inventory",
        f"""SELECT request_id, sku_code, round(combined, 6) AS combined_score, {TIER} AS tier, compatible AS is_compatible, {MII} AS mii_compliant, round({KM}, 1) AS distance_km,
              round({KM} / 40.0 + 4.0, 1) AS transit_hours, unit_cost_inr FROM combined""",
        **MATCH_CTES,
    ),
)
def match_scores(spark, sf_dir):
    out = matching.match_requests(V.requests(spark, sf_dir), V.inventory(spark, sf_dir), lowest_skus=True)
    return out.select("request_id", "sku_code", F.round("combined_score", 6).alias("combined_score"), "tier", "is_compatible", "mii_compliant", "distance_km", "transit_hours", "unit_cost_inr")


@query(
    "p7_ranked_matches",
    O.sql(
        "requests inventory",
        f"""SELECT request_id, sku_code, rank, compatibility_score, tier, CASE tier WHEN 'Tier 1' THEN 1 WHEN 'Tier 2' THEN 2 ELSE 3 END AS tier_level FROM
            (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY compatibility_score DESC, sku_code) AS rank FROM
              (SELECT request_id, sku_code, round(combined * 100, 1) AS compatibility_score, {TIER} AS tier FROM combined)) WHERE rank <= 10""",
        **MATCH_CTES,
    ),
)
def ranked(spark, sf_dir):
    out = matching.match_requests(V.requests(spark, sf_dir), V.inventory(spark, sf_dir), lowest_skus=True, top_k=10)
    return out.select("request_id", "sku_code", "rank", "compatibility_score", "tier", "tier_level")


MATCH_CODE = FIRST_CODE.replace("q_type = 'FLANGE'", f"q_type IN ({VALVE_TYPES})")


@query(
    "p7_flagship",
    O.sql(
        "requests inventory",
        f"""SELECT request_id, row_number() OVER (PARTITION BY request_id ORDER BY compatibility_score DESC, sku_code) AS rank, sku_code, cpse, depot_id, item_type, size_nb_mm, pressure_class, metallurgy,
              compatibility_score, tier, is_compatible, violation_code, distance_km, transit_hours FROM
            (SELECT request_id, sku_code, round(combined * 100, 1) AS compatibility_score, {TIER} AS tier, compatible AS is_compatible, {MATCH_CODE} AS violation_code, round({KM}, 1) AS distance_km, round({KM} / 40.0 + 4.0, 1) AS transit_hours FROM combined)
            JOIN (SELECT sku_code, cpse, depot_id, item_type, size_nb_mm, pressure_class, metallurgy FROM inventory) USING (sku_code)""",
        **BEST_CTES,
    ),
)
def flagship(spark, sf_dir):
    return ranked_substitutes(spark, sf_dir)


@query(
    "p3_local_content",
    O.sql("inventory", f"SELECT sku_code, coalesce(make_in_india_class, CASE WHEN local_content_percentage >= 50 THEN 'Class-I' ELSE 'Class-II' END) AS class, {MII} AS compliant, CASE WHEN NOT {MII} THEN 'Less than half of the value is local content' END AS warning FROM inventory"),
)
def local_content(spark, sf_dir):
    named, compliant, warning = matching.local_content(F.col("make_in_india_class"), F.col("local_content_percentage"))
    return V.inventory(spark, sf_dir).select("sku_code", named.alias("class"), compliant.alias("compliant"), warning.alias("warning"))


@query(
    "j13_equivalent_standards",
    O.sql("requests inventory", f"SELECT request_id, sku_code, {EQUIVALENT} AS equivalent FROM sides", metals=METAL_TABLE, asked=ASKED, fitting=FITTING, found=FOUND, sides=MATCH_SIDES),
)
def equivalent(spark, sf_dir):
    found = retrieval.retrieve(V.requests(spark, sf_dir), V.inventory(spark, sf_dir))
    flag = matching.equivalent_standards(F.col("query_text"), F.col("item.metallurgy"), F.col("item.indian_standard"), F.col("item.standard"))
    return found.select("request_id", "sku_code", flag.alias("equivalent"))


DECIDED = """SELECT p_partkey, p_name || """ + O.pick("p_partkey", (" IS 2062", " IS 14846", "", "", "", "")) + """ AS query_text FROM part"""


@query(
    "p5_decided_matches",
    O.sql(
        "requests inventory",
        f"""SELECT request_id, sku_code, CASE WHEN d.decision = 'APPROVE' THEN d.tier_override ELSE {TIER} END AS tier, d.decision IS NOT NULL AS decided FROM combined c LEFT JOIN
            (SELECT query_text, source_sku, decision, tier_override FROM (SELECT *, row_number() OVER (PARTITION BY query_text, source_sku ORDER BY decided_at DESC) AS n FROM decisions) WHERE n = 1) d
            ON d.query_text = c.query_text AND d.source_sku = c.sku_code""",
        **MATCH_CTES,
        decisions="""SELECT r.query_text, i.sku_code AS source_sku, CASE WHEN r.p_partkey % 3 = 0 THEN 'REJECT' ELSE 'APPROVE' END AS decision, 'Tier ' || (r.p_partkey % 2 + 1) AS tier_override, r.p_partkey AS decided_at
                   FROM requests r JOIN inventory i ON i.canonical_id = 'CAN-' || r.p_partkey""",
    ),
)
def decided(spark, sf_dir):
    requests, stock = V.requests(spark, sf_dir), V.inventory(spark, sf_dir)
    k = F.regexp_extract("request_id", r"-(\d+)$", 1).cast("long")
    decisions = requests.withColumns({"k": k, "canonical_id": F.concat(F.lit("CAN-"), k.cast("string"))}).join(stock.select("canonical_id", "sku_code"), "canonical_id").select(
        "query_text", F.col("sku_code").alias("source_sku"), F.when(F.pmod("k", F.lit(3)) == 0, "REJECT").otherwise("APPROVE").alias("decision"),
        F.concat(F.lit("Tier "), (F.pmod("k", F.lit(2)) + 1).cast("string")).alias("tier_override"), F.col("k").alias("decided_at"),
    )
    out = matching.match_requests(requests, stock, decisions=decisions, lowest_skus=True)
    return out.select("request_id", "sku_code", "tier", F.contains("explanation", F.lit("HUMAN EXPERT")).alias("decided"))
