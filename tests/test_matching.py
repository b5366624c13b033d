"""Retrieval and scoring against a plain row-by-row computation."""

import random

import pytest
from pyspark.sql import functions as F

from sparemesh.operators import matching, retrieval
from sparemesh.operators.rules import verdict
from sparemesh.operators.rules.base import Side

TYPES = ["VALVE", "FLANGE", "PIPE"]
WORDS = ["GATE", "BALL", "WN", "BLIND", "steel", "old", "a_b"]
METALS = ["ASTM A105", "SS316", "SS 316L", "ASTM_A105", None]


def stock(seed, n=400):
    r = random.Random(seed)
    return [
        (f"S{i:04d}", r.choice(["T0", "T1"]), r.choice(TYPES), " ".join(r.sample(WORDS, 3)), r.choice([None, 50.0, 80.0, 100.0]), r.choice([None, 150, 300, 600]), r.choice(METALS))
        for i in range(n)
    ]


def asks(seed, n=60):
    r = random.Random(seed + 100)
    kinds = ["GATE_VALVE", "VALVE", "FLANGE WN", "pipe", "ALL", None]
    return [
        (f"R{i}", r.choice(["T0", "T1", "T2"]), r.choice(["steel x", "a_b", "ol", "", None, "GATE valve"]), r.choice(kinds), r.choice([None, 50.0, 65.0]), r.choice([None, 0, 300, 900]), r.choice(["SS", "A_M", "", None, "ss316"]))
        for i in range(n)
    ]


def like(text, part):
    import re

    pattern = "".join(".*" if ch == "%" else "." if ch == "_" else re.escape(ch) for ch in part.lower())
    return text is not None and re.search(pattern, text.lower(), re.S) is not None


def plain(ask, items, limit, fill_below, missing):
    _, cpse, text, kind, size, cls, metal = ask
    kind = kind or missing
    upper = kind.upper() if kind and kind != "ALL" else None
    base = sub = None
    if upper:
        base = next((b for b in ("VALVE", "FLANGE", "PIPE") if b in upper), upper)
        sub = next((w for w in retrieval.SUB_TYPES.get(base, ()) if w in upper), None)
    pool = [i for i in items if i[1] == cpse and (base is None or i[2] == base) and (sub is None or like(i[3], sub))]
    word = (text or "").split()
    word = word[0] if word and len(word[0]) >= 3 else None

    def hit(i):
        return (
            (size is not None and i[4] == size) or (metal and like(i[6], metal)) or (cls and i[5] is not None and i[5] >= cls) or (word and like(i[3], word))
        )

    found = [i[0] for i in pool if hit(i)][:limit]
    if len(found) < fill_below:
        found += [i[0] for i in pool if i[0] not in found][: limit - len(found)]
    return set(found)


ITEM = "sku_code string, cpse string, item_type string, description string, size_nb_mm double, pressure_class int, metallurgy string"
ASK = "request_id string, cpse string, query_text string, item_type string, size_nb_mm double, pressure_class int, metallurgy string"


@pytest.mark.parametrize("seed,broadcast_words,missing", [(1, 10_000, None), (2, 0, None), (3, 0, "GENERAL")])
def test_candidates(spark, seed, broadcast_words, missing):
    items, requests = stock(seed), asks(seed)
    found = retrieval.retrieve(
        spark.createDataFrame(requests, ASK), spark.createDataFrame(items, ITEM), limit=20, fill_below=12, broadcast_words=broadcast_words, missing_type=missing
    )
    got = {}
    for row in found.collect():
        got.setdefault(row["request_id"], set()).add(row["sku_code"])
    for ask in requests:
        assert got.get(ask[0], set()) == plain(ask, sorted(items), 20, 12, missing), ask


def test_types(spark):
    cases = {"GATE_VALVE": ("VALVE", "GATE"), "FLANGE SO": ("FLANGE", "SO"), "fastener": ("STUD_BOLT", None), "Pump": ("PUMP", None), "ALL": (None, None), None: (None, None), "PIPE_FITTING": ("PIPE", None)}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    base, sub = retrieval.resolve_type(F.col("t"))
    assert {r[0]: (r[1], r[2]) for r in df.select("t", base, sub).collect()} == cases


def test_rules_without_properties_equal_the_full_list(spark):
    r = random.Random(4)
    kinds = ["GASKET", "STUD_BOLT", "PIPE", "VALVE", "FLANGE", "PUMP", "ELBOW", "HE_TUBE", "LINE_BLIND", "MOTOR", "PSV", "BEARING", "TANK", "O_RING", None, "INSULATION", "FIK", "HOSE", "RUPTURE_DISK", "FILTER"]
    metals = ["ASTM A193 B7", "ASTM A193 B16", "ASTM A320 L7", "SS316", None]
    rows = [(i, r.choice(kinds), r.choice([None, 50.0, 700.0]), r.choice([None, 150, 900]), r.choice(metals), r.choice(kinds), r.choice([None, 50.0, 700.0]), r.choice([None, 150, 900]), r.choice(metals)) for i in range(600)]
    df = spark.createDataFrame(rows, "id int, q_item_type string, q_size_nb_mm double, q_pressure_class int, q_metallurgy string, c_item_type string, c_size_nb_mm double, c_pressure_class int, c_metallurgy string")
    df = verdict.prepare_side(verdict.prepare_side(df, "q_"), "c_")
    rest = [x for x in verdict.equipment_outcomes(Side("q_"), Side("c_")) if x[0] not in verdict.BARE_RULES]
    notable = [F.coalesce(g & ((o["tier"] != 1) | (o["score"] < 1.0) | o["code"].isNotNull()), F.lit(False)).alias(n) for n, g, o in rest]
    for row in df.select("id", F.transform(F.array(*notable), lambda x: x).alias("n")).collect():
        assert not any(row["n"]), rows[row["id"]]


def test_match_and_decisions(spark):
    items = [
        ("S1", "OIL", "FLANGE", "FLG WN", 100.0, 300, "ASTM A105", "OIL Duliajan", 10, 5.0), ("S2", "OIL", "FLANGE", "FLG WN", 100.0, 150, "ASTM A105", "Moran", 10, 5.0),
        ("S3", "OIL", "FLANGE", "FLG BL", 100.0, 300, None, "elsewhere", 10, 5.0),
    ]
    stock_df = spark.createDataFrame(items, ITEM + ", depot_location string, quantity int, unit_cost_inr double")
    asked = spark.createDataFrame([("R1", "OIL", "FLG DN100 300# A105 IS 2062", None, None, None, None), ("R2", "OIL", "FLG DN100 300# A105 IS 2062", None, None, None, None)], ASK)
    decisions = spark.createDataFrame([("FLG DN100 300# A105 IS 2062", "S3", "APPROVE", "Tier 1", 2), ("FLG DN100 300# A105 IS 2062", "S3", "REJECT", "Tier 3", 1)], "query_text string, source_sku string, decision string, tier_override string, decided_at int")
    rows = {(r["request_id"], r["sku_code"]): r for r in matching.match_requests(asked, stock_df, decisions=decisions).collect()}
    assert len(rows) == 6
    best = rows["R1", "S1"]
    # the extracted grade IS_2062 is unknown to the rules (0.82); the equivalence lifts the score to 0.95, local content adds 0.03
    assert best["rank"] == 1 and best["tier"] == "Tier 1" and best["compatibility_score"] == 98.0 and "standard agree" in best["explanation"]
    assert best["distance_km"] == 0.0 and best["transit_hours"] == 4.0 and best["unit_cost_inr"] == 5.0
    low = rows["R2", "S2"]
    assert low["tier"] == "Tier 3" and low["violation_code"] == "ASME_B16_5" and low["combined_score"] <= 0.74
    assert rows["R1", "S3"]["tier"] == "Tier 1" and "[VERIFIED BY HUMAN EXPERT]" in rows["R1", "S3"]["explanation"]
    filtered = matching.match_requests(asked, stock_df, min_local_content=80.0)
    assert filtered.count() == 0


def test_request_flags(spark):
    df = spark.createDataFrame([("R", "T", "", True, "SEAMLESS", 8, "HIGH_WELDABILITY", {"x": "1", "mfg": "old"})], "request_id string, cpse string, query_text string, sour_service boolean, mfg_method string, trim_no int, weldability_class string, props map<string,string>")
    props = matching.parse_requests(df).first()["props"]
    assert props == {"x": "1", "mfg": "SEAMLESS", "manufacturing_method": "SEAMLESS", "nace_mr0175": "true", "sour_service": "true", "hardness_max_hrc": "22.0", "trim_no": "8", "ce_max": "0.4", "weldability": "true"}
