"""Literal descriptions with known attributes."""

import pytest
from pyspark.sql import functions as F

from sparemesh.functions import safety
from sparemesh.functions.attributes import (
    domain_texts, normalize_pressure, normalize_size, with_attributes, with_dialect,
)
from sparemesh.functions.text import SHORTHAND, clean_lines, normalize_text

LONG = (
    "VALVE DN100 CLASS 300 ASTM A216 WCB IS 1239 OISD-STD-141 EIL SPEC 6-44-001 GeM Category 40141600 CPPP Tender 2024_MES_123 "
    "MESC 76.10.01 Manufacturer Acme Product Form CAST Coating FBE Inspection Class B Document No DOC-77 Project Paradip "
    "End Connection FLANGED Temperature 120 C PO-77 Certificate MTC-99"
)


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    "text,expected",
    [
        ("FLG WN DN50 RF 300#", "FLANGE WELD NECK SIZE_NB_MM=50 RAISED FACE CLASS=300"), ("50 mm", "SIZE_NB_MM=50"),
        ("SS316L", "SS316L"), ("THIS IS A FLANGE", "THIS IS A FLANGE"),
        ("VLV GV 4IN CL300 MS", "VALVE GATE VALVE SIZE_IN=4 CLASS=300 MILD STEEL"), ("wn flg  p&id\n\n v/v ", "WELD NECK FLANGE PIPING AND INSTRUMENTATION DIAGRAM\nVALVE"),
        ("GT VLV 3LPE-NACE", "GATE VALVE THREE LAYER POLYETHYLENE-NACE INTERNATIONAL"),
    ],
)
def test_normalized_text(spark, text, expected):
    assert one(spark, text, normalize_text) == expected


def test_no_expansion_contains_another_shorthand():
    for short, long in SHORTHAND.items():
        words = set(long.upper().replace("-", " ").split())
        assert not (words & set(SHORTHAND)) - {short}, short


def test_expansion_equals_one_by_one_replacement(spark):
    import re

    texts = [LONG, "WN FLG 4IN SO FLG V/V P&F P&ID GT VLV id OD_NB nb-dn SW/BW THD.NPT (RF) MT;PT", "BL FLG FLG FL WNRF wn rf _RF RF_ 3LPE3 3LPE"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(normalize_text(F.col("t"))).collect()]
    for text, found in zip(texts, got):
        out = text
        for pattern, to in (
            (r"(?<![A-Z0-9])DN\s*(\d+(?:\.\d+)?)\b", r"SIZE_NB_MM=\1"), (r"(?<![A-Z0-9])(\d+(?:\.\d+)?)\s*(?:mm|millimet(?:er|re)s?)\b", r"SIZE_NB_MM=\1"),
            (r"(?<![A-Z0-9])(\d+(?:\.\d+)?)\s*(?:in|inch(?:es)?)\b", r"SIZE_IN=\1"), (r"(?<![A-Z0-9])(?:CLASS|CL)\s*-?\s*(\d+)\b", r"CLASS=\1"),
        ):
            out = re.sub(pattern, to, out, flags=re.I)
        for short in sorted(SHORTHAND, key=len, reverse=True):
            out = re.sub(rf"(?<![A-Z0-9_]){re.escape(short)}(?![A-Z0-9_])", SHORTHAND[short], out, flags=re.I)
        assert found == re.sub(r"[ \t]+", " ", out).strip()


def test_clean_lines(spark):
    assert one(spark, "  a \t b×c \r\n\n  ″x’ ", clean_lines) == "a bxc\n\"x'"


@pytest.mark.parametrize("raw,mm", [('1/2"', 12.7), ('3/4"', 19.05), ('1 1/2"', 38.1), ('4"', 101.6), ("4 INCH", 101.6), ("DN100", 100.0), ("100 MM", 100.0), ("100mm NB", 100.0), ("1/0", None), ("x", None)])
def test_sizes(spark, raw, mm):
    got = one(spark, raw, normalize_size)
    assert got == (None if mm is None else pytest.approx(mm))


@pytest.mark.parametrize("raw,cls", [("PN6", 150), ("PN 64", 600), ("PN-420", 2500), ("PN37", None), ("PN37, CLASS 300", 300), ("CLASS 300", 300), ("XPN16", None), ("PN16X", None), ("600#", 600), ("150 LBS", 150)])
def test_pressures(spark, raw, cls):
    assert one(spark, raw, normalize_pressure) == cls


def test_fields(spark):
    row = with_attributes(spark.createDataFrame([(LONG,)], "d string"), "d").first()
    expected = dict(
        indian_standard="IS 1239", oisd_standard="OISD-STD-141", eil_specification="EIL SPEC 6-44-001", gem_category="40141600", cppp_tender_id="2024_MES_123",
        mesc_code="76.10.01", manufacturer="Acme", product_form="CAST", coating="FBE", inspection_class="B", document_number="DOC-77", project="Paradip",
        end_connection="FLANGED", temperature_rating=120.0, purchase_order="PO-77", certificate_number="MTC-99", item_type="VALVE", size_nb_mm=100.0, pressure_class=300,
    )
    assert {k: row[k] for k in expected} == expected
    other = with_attributes(spark.createDataFrame([("GeM Bid No GEM/2026/B/123",), ('FLANGE 4"',), ("THIS IS A FLANGE",)], "d string"), "d").collect()
    assert other[0]["gem_category"] is None and other[0]["gem_bid_number"] == "GEM/2026/B/123"
    assert other[1]["size_nb_mm"] == pytest.approx(101.6) and other[2]["indian_standard"] is None


DIALECT = [
    ("OIL MESC 03.10.45.19.04 PIPE SMLS 150 MM NB (6IN) SCH 80 IS 1239 Part 1 Heavy / API 5L PSL 2 ASTM A106 GR.B BE EIL 6-44-0005 MII Class-I (91.2%)",
     dict(item_type="PIPE", size_nb_mm=150.0, oil_material_code="03.10.45.19", make_in_india_class="Class-I"), dict(indian_standard="IS 1239", oil_std_spec="EIL")),
    ("OIL MESC 02.10.15.82.11 VLV GT 150 MM NB (6IN) PN 100 (600#) IS 14846 Grade FG 200 / API 600 ASTM A216 WCB TR8 OISD-RP-126 MII Class-I (76.5%)",
     dict(item_type="VALVE", size_nb_mm=150.0, pressure_class=600, pressure_rating_bar=100.0, oil_material_code="02.10.15.82"), dict(indian_standard="IS 14846", oil_std_spec="OISD")),
    ("OIL MESC 04.01.24.18.02 FLG WNRF 100 MM NB (4IN) PN 50 (300#) IS 2062 Grade E250 / ASME B16.5 ASTM A105 RF MII Class-I (84.0%)",
     dict(item_type="FLANGE", size_nb_mm=100.0, pressure_class=300, pressure_rating_bar=50.0), dict(indian_standard="IS 2062")),
    ("OIL MESC 05.02.64.14.13 STUD BLT 7/8IN X 150MM IS 1367 Part 3 Class 8.8 / ASME B16.5 STUD ASTM A193 B7 NUT 2H MII Class-I (88.0%)",
     dict(item_type="STUD_BOLT", oil_material_code="05.02.64.14"), dict(indian_standard="IS 1367")),
    ("GATE VALVE 200 NB PN 16 SLUICE VALVE", dict(item_type="VALVE", size_nb_mm=200.0, pressure_rating_bar=16.0, pressure_class=150), {}),
]


def test_dialect(spark):
    df = spark.createDataFrame([(i, d[0]) for i, d in enumerate(DIALECT)], "i int, d string")
    rows = {r["i"]: r for r in with_dialect(df, "d").collect()}
    for i, (_, exact, part) in enumerate(DIALECT):
        assert {k: rows[i][k] for k in exact} == exact
        for k, v in part.items():
            assert v in rows[i][k]


def test_domain_texts(spark):
    df = spark.createDataFrame([(100.0, "FLANGED", "SS316", 300, 120.0, "IS 1239", "ASME B16.5", "words")], "size_nb_mm double, end_connection string, metallurgy string, pressure_class int, temperature_rating double, indian_standard string, standard string, d string")
    texts = domain_texts(df.columns, F.col("d"))
    row = df.select(*[c.alias(n) for n, c in texts.items()]).first()
    assert row["dim"] == "size nb mm: 100.0; end connection: FLANGED" and row["met"] == "metallurgy: SS316"
    assert "300" in row["pt"] and "120" in row["pt"] and row["std"] == "standard: ASME B16.5; indian standard: IS 1239"


@pytest.mark.parametrize("grade,rank", [("ASTM A105N", 0), ("SS316L", 2), ("ASTM A105N0", None), ("X316Y", None), ("22050", None), ("SUPER DUPLEX", 4), ("STAINLESS", 2)])
def test_metal_rank(spark, grade, rank):
    assert one(spark, grade, safety.metal_rank) == rank


PAIR = "q_item_type string, q_size_nb_mm double, q_pressure_class int, q_metallurgy string, q_standard string, c_item_type string, c_size_nb_mm double, c_pressure_class int, c_metallurgy string, c_standard string"


def pair(spark, *values):
    df = spark.createDataFrame([values], PAIR)
    return df, *safety.pair_sides(df.columns)


@pytest.mark.parametrize(
    "values,text",
    [
        ((None, 100.0, None, None, None, None, 150.0, None, None, None), "size mismatch"), ((None, None, 600, None, None, None, None, 300, None, None), "pressure downgrade"),
        ((None, None, None, "SS316", None, None, None, None, "ASTM_A105", None), "metallurgy downgrade"), (("VALVE", None, None, None, None, "BOLT", None, None, None, None), "item type mismatch"),
        (("GATE_VALVE", None, None, None, "API 600", "GATE_VALVE", None, None, None, "API 608"), "incompatible standards"),
    ],
)
def test_safety(spark, values, text):
    df, q, c = pair(spark, *values)
    found = df.select(safety.safety_violations(q, c)).first()[0]
    assert len(found) == 1 and text in found[0]


def test_features_and_reasons(spark):
    df, q, c = pair(spark, "VALVE", 100.0, 300, None, None, "VALVE", 100.0, 600, None, None)
    f = safety.ranking_features(q, c, F.lit(0.8))
    row = df.select(f.alias("f"), safety.ranking_score(f).alias("s"), safety.match_reasons(q, c).alias("r")).first()
    assert row["f"] == [0.8, 1.0, 0.0, 1.0, 0.5, 1.0, 0.5, 0.5, 0.5, 0.8, 0.8, 0.8, 0.8]
    assert row["s"] == pytest.approx(0.5 * 0.8 + 0.5 * sum(row["f"][1:]) / 12)
    assert row["r"] == ["✓ Exact size match (100.0 mm)", "✓ Pressure class upgrade (300 → 600)"]
    domains = {"dim": F.lit(0.91), "met": F.lit(0.82), "pt": F.lit(0.73), "std": F.lit(0.64)}
    assert df.select(safety.ranking_features(q, c, F.lit(0.77), domains)).first()[0][9:] == [0.91, 0.82, 0.73, 0.64]


@pytest.mark.parametrize("score,tier", [(0.59, "Tier-4-Reject"), (0.60, "Tier-3"), (0.84, "Tier-3"), (0.85, "Tier-1")])
def test_search_tier(spark, score, tier):
    none = F.array().cast("array<string>")
    assert spark.range(1).select(safety.search_tier(F.lit(score), none), safety.search_tier(F.lit(1.0), F.array(F.lit("x")))).first() == (tier, "Tier-4-Reject")


def test_classification(spark):
    none = F.array().cast("array<string>")
    df, q, c = pair(spark, None, 100.0, 150, None, None, None, 100.0, 300, None, None)
    up = df.select(safety.classify(q, c, F.lit(0.92), none).alias("r")).first()["r"]
    assert (up["tier"], up["routing"]) == ("Tier-1", "auto-link")
    df, q, c = pair(spark, None, 100.0, None, None, None, None, 150.0, None, None, None)
    no = df.select(safety.classify(q, c, F.lit(0.99), none).alias("r")).first()["r"]
    assert (no["tier"], no["confidence"], no["routing"]) == ("Tier-4-Reject", 0.0, "manual-entry")


def test_classified_pairs_equal_the_struct(spark):
    sides = [("GATE_VALVE", 100.0, 600, "A105", "API 600"), ("FLANGE", 150.0, None, "F316L", None), (" ", None, 300, "", "API 608"), (None, 100.0, 150, "SS316", "API-600")]
    table = spark.createDataFrame(sides, "item_type string, size_nb_mm double, pressure_class int, metallurgy string, standard string")
    known = safety.side_columns(table)
    q, c = (known.select(*[F.col(n).alias(p + n) for n in known.columns]) for p in ("q_", "c_"))
    pairs = q.crossJoin(c).withColumns({"s": F.lit(0.9), "e": F.array(F.lit("size mismatch"), F.lit("size mismatch"))})
    bare = [n for n in pairs.columns if n[2:] in table.columns]
    fields = ["tier", "confidence", "routing", "reasons", "violations"]
    for earlier in (None, F.col("e")):
        none = F.array().cast("array<string>") if earlier is None else earlier
        made = safety.classify_pairs(pairs, "s", earlier).select(*bare, *fields)
        # the struct reads the texts themselves, not what was added to the sides
        want = pairs.withColumn("r", safety.classify(*safety.pair_sides(bare), F.col("s"), none)).select(*bare, *["r." + f for f in fields])
        assert sorted(map(str, made.collect())) == sorted(map(str, want.collect()))
    both = pairs.select(F.size(safety.all_violations(*safety.pair_sides(pairs.columns), F.col("e"))).alias("n"))
    assert both.agg(F.max("n")).first()[0] > 1
