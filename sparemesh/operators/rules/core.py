"""Rules every pair passes: size, pressure, metal, facing and schedule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.values import contains_any, first_true, keyed, lookup
from .base import decide, has_text, position, reject, safe, same, substitute

CLASS_LADDER = (150, 300, 600, 900, 1500, 2500)
# Nominal pressures read as classes by the pressure rule.
RULE_PN_CLASS = {16: 150, 20: 150, 40: 300, 50: 300, 100: 600}
FLANGED_TYPES = (
    "FLANGE", "GATE_VALVE", "GLOBE_VALVE", "CHECK_VALVE", "BALL_VALVE", "BUTTERFLY_VALVE", "PLUG_VALVE",
)
# Metal families as (family, level, spellings). Levels from 10 on are the Cr-Mo branch.
FAMILIES = (
    ("CARBON_STEEL", 0, (
        "ASTM A105", "A105", "ASTM A216 WCB", "A216 WCB", "WCB", "ASTM A106 GR.B", "ASTM A106-B",
        "A106 GR.B", "A106-B", "A106 B", "ASTM A234 WPB", "A234 WPB", "WPB", "ASTM A216 WCC", "WCC")),
    ("LOW_TEMP_CARBON_STEEL", 1, (
        "ASTM A350 LF2", "A350 LF2", "LF2", "LTCS", "ASTM A352 LCB", "A352 LCB", "LCB",
        "ASTM A333 GR.6", "A333-6", "A333 GR.6", "ASTM A420 WPL6", "A420 WPL6")),
    ("AUSTENITIC_SS_304", 2, (
        "ASTM A182 F304", "A182 F304", "F304", "ASTM A351 CF8", "A351 CF8", "CF8",
        "ASTM A312 TP304", "A312 TP304", "TP304", "SS304", "304")),
    ("AUSTENITIC_SS_304L", 2, (
        "ASTM A182 F304L", "A182 F304L", "F304L", "ASTM A351 CF3", "A351 CF3", "CF3",
        "ASTM A312 TP304L", "A312 TP304L", "TP304L", "SS304L", "304L")),
    ("STABILIZED_SS_321", 2, ("ASTM A182 F321", "F321", "SS321", "321", "TP321")),
    ("STABILIZED_SS_347", 2, ("ASTM A182 F347", "F347", "SS347", "347", "TP347")),
    ("MOLYBDENUM_SS_316", 3, (
        "ASTM A182 F316", "A182 F316", "F316", "ASTM A351 CF8M", "A351 CF8M", "CF8M",
        "ASTM A312 TP316", "A312 TP316", "TP316", "SS316", "316")),
    ("MOLYBDENUM_SS_316L", 3, (
        "ASTM A182 F316L", "A182 F316L", "F316L", "ASTM A351 CF3M", "A351 CF3M", "CF3M",
        "ASTM A312 TP316L", "A312 TP316L", "TP316L", "SS316L", "316L")),
    ("DUPLEX_2205", 4, (
        "ASTM A182 F51", "A182 F51", "F51", "ASTM A815 S31803", "S31803", "UNS S31803",
        "DUPLEX STAINLESS STEEL", "DUPLEX 2205", "DSS")),
    ("SUPER_DUPLEX_2507", 5, (
        "ASTM A182 F53", "A182 F53", "F53", "ASTM A815 S32750", "S32750", "UNS S32750",
        "SUPER DUPLEX STAINLESS", "SUPER DUPLEX 2507", "SDSS")),
    ("NICKEL_ALLOYS", 6, (
        "INCONEL 625", "ALLOY 625", "INCO 625", "UNS N06625", "HASTELLOY C-276", "HAST-C", "C-276",
        "UNS N10276", "MONEL 400", "MONEL K-500")),
    ("CR_MO_1_25CR", 10, (
        "ASTM A182 F11", "A182 F11", "F11", "ASTM A217 WC6", "WC6", "1.25CR-0.5MO",
        "ASTM A335 P11", "A335 P11", "P11", "ASTM A234 WP11", "WP11")),
    ("CR_MO_2_25CR", 11, (
        "ASTM A182 F22", "A182 F22", "F22", "ASTM A217 WC9", "WC9", "2.25CR-1MO",
        "ASTM A335 P22", "A335 P22", "P22", "ASTM A234 WP22", "WP22")),
    ("CR_MO_5CR", 12, (
        "ASTM A182 F5", "A182 F5", "F5", "ASTM A217 C5", "C5", "5CR-0.5MO",
        "ASTM A335 P5", "A335 P5", "P5", "ASTM A234 WP5", "WP5")),
    ("CR_MO_9CR", 13, (
        "ASTM A182 F91", "A182 F91", "F91", "ASTM A217 C12A", "C12A", "9CR-1MO-V",
        "ASTM A335 P91", "A335 P91", "P91", "ASTM A234 WP91", "WP91")),
)
LEVELS = {family: level for family, level, _ in FAMILIES}
STABLE_FAMILIES = ("AUSTENITIC_SS_304L", "MOLYBDENUM_SS_316L", "STABILIZED_SS_321", "STABILIZED_SS_347")
# Pipe schedules from thin to thick, and other spellings of them.
SCHEDULES = (
    "SCH 5", "SCH 5S", "SCH 10", "SCH 10S", "SCH 20", "SCH 30", "STD", "SCH 40", "SCH 40S", "SCH 60",
    "XS", "SCH 80", "SCH 80S", "SCH 100", "SCH 120", "SCH 140", "SCH 160", "XXS",
)
SCHEDULE_SPELLINGS = {
    "SCHEDULE 40": "SCH 40", "SCHEDULE 80": "SCH 80", "SCHEDULE 160": "SCH 160", "STANDARD": "STD",
    "EXTRA STRONG": "XS", "DOUBLE EXTRA STRONG": "XXS",
}


def size_rule(q: Column, c: Column) -> Column:
    return decide(
        (
            F.abs(q - c) >= 0.01,
            reject("DIMENSIONAL_ZERO_TOLERANCE", "DIMENSION MISMATCH: required ", q.cast("string"), " mm, candidate ", c.cast("string"), " mm"),
        )
    )


def _as_class(value: Column) -> Column:
    return F.when(value.isin(*CLASS_LADDER), value).otherwise(F.coalesce(lookup(RULE_PN_CLASS, value), value))


def pressure_class_rule(query: Column, candidate: Column, item_type: Column, spool: Column) -> Column:
    q, c = _as_class(query), _as_class(candidate)
    kind = F.regexp_replace(F.upper(item_type), " ", "_")
    steps = F.coalesce(position(CLASS_LADDER, c), F.lit(0)) - F.coalesce(position(CLASS_LADDER, q), F.lit(0))
    return decide(
        (q.isNull() & c.isNull(), same()),
        (q.isNull() | c.isNull(), substitute(0.85)),
        (q == c, same()),
        (c < q, reject("CLASS_DOWN", "PRESSURE DOWN-RATING: candidate class ", c.cast("string"), " is below ", q.cast("string"))),
        (spool, substitute(0.85)),
        (
            kind.isin(*FLANGED_TYPES),
            reject("BOLT_CIRCLE", "PRESSURE UPGRADE FLANGE MISMATCH: class ", c.cast("string"), " cannot bolt to class ", q.cast("string")),
        ),
        otherwise=safe(F.greatest(F.lit(0.95), F.lit(1.0) - F.greatest(F.lit(0), steps) * 0.01)),
    )


def pressure_psi_rule(q: Column, c: Column) -> Column:
    bonus = F.least(F.lit(1.0), F.lit(0.95) + (F.lit(1.0) - F.try_divide(c - q, q)) * 0.05)
    return decide(
        (q.isNull() & c.isNull(), same()),
        (q.isNull() | c.isNull(), substitute(0.85)),
        (F.abs(c - q) < 0.01, same()),
        (c < q, reject("PSI_DOWN", "PRESSURE DOWN-RATING: candidate ", c.cast("string"), " psi is below ", q.cast("string"), " psi")),
        otherwise=safe(F.greatest(F.lit(0.95), bonus)),
    )


def metal_name(raw: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(raw)), "  ", " ")


def metal_family(name: Column) -> Column:
    """Family of a normalised metal name."""
    return lookup({spelling: family for family, _, spellings in FAMILIES for spelling in spellings}, name)


def metal_rule(query: Column, candidate: Column, q: Column, c: Column, q_family: Column, c_family: Column) -> Column:
    """``q``/``c`` are normalised names; families come from :func:`metal_family`."""
    levels = keyed(LEVELS)
    q_level, c_level = F.try_element_at(levels, q_family), F.try_element_at(levels, c_family)
    wrought_304 = q.contains("304") & ~q.contains("304L") & ~q.contains("CF8")
    wrought_316 = c.contains("316") & ~c.contains("316L") & ~c.contains("CF8M")
    creep_bolt = q.contains("B7") & q.contains("A193") & c.contains("B16") & c.contains("A193")
    names = (query, " -> ", candidate)
    return decide(
        ((F.coalesce(query, F.lit("")) == "") | (F.coalesce(candidate, F.lit("")) == ""), substitute(0.85)),
        ((q == c) & (q != ""), same()),
        (wrought_304 & wrought_316, safe(0.98)),
        (creep_bolt, safe(0.99)),
        (q_level.isNull() | c_level.isNull(), substitute(0.82)),
        (q_family == c_family, same()),
        (
            (q_family == "LOW_TEMP_CARBON_STEEL") & (c_family != "LOW_TEMP_CARBON_STEEL"),
            reject("CRYOGENIC", "CRYOGENIC BRITTLE FRACTURE: ", *names),
        ),
        (
            q_family.isin(*STABLE_FAMILIES) & c_family.isin("AUSTENITIC_SS_304", "MOLYBDENUM_SS_316"),
            reject("SENSITIZATION", "INTERGRANULAR CORROSION: ", *names),
        ),
        ((q_level >= 10) & (c_level < 10), reject("CREEP", "CREEP RUPTURE: ", *names)),
        ((c_level >= 10) & (q_level < 10), substitute(0.88)),
        (c_level < q_level, reject("METAL_DOWN", "METALLURGY DOWNGRADE: ", *names)),
        (c_level > q_level, substitute(F.greatest(F.lit(0.80), F.lit(1.0) - (c_level - q_level) * 0.05))),
        otherwise=substitute(0.82),
    )


def facing_rule(query, candidate, body, cyclic, query_attachment, candidate_attachment) -> Column:
    qt = F.regexp_replace(F.upper(F.coalesce(query_attachment, F.lit(""))), "_", " ")
    ct = F.regexp_replace(F.upper(F.coalesce(candidate_attachment, F.lit(""))), "_", " ")
    qf = F.upper(F.trim(F.coalesce(query, F.lit(""))))
    cf = F.upper(F.trim(F.coalesce(candidate, F.lit(""))))
    metal = F.upper(F.coalesce(body, F.lit("")))
    faces = (qf, " -> ", cf)

    def pair(a, b):
        return ((qf == a) & (cf == b)) | ((qf == b) & (cf == a))

    return decide(
        (
            cyclic & has_text(qt, "WELD NECK", "WN") & has_text(ct, "SLIP ON", "SO"),
            reject("SLIP_ON", "FATIGUE FRACTURE: slip-on for weld neck in severe cyclic service"),
        ),
        (qf == cf, same()),
        (pair("RF", "RTJ"), reject("FACING", "FACING MISMATCH: ", *faces)),
        (
            contains_any(metal, ["CAST IRON", "CI", "A126", "GRAY IRON"]) & pair("FF", "RF"),
            reject("CAST_IRON", "CAST IRON FLANGE FRACTURE: ", *faces),
        ),
        ((qf != "") & (cf != ""), reject("CONNECTION", "CONNECTION / FACING MISMATCH: ", *faces)),
        otherwise=substitute(0.85),
    )


def schedule_name(raw: Column) -> Column:
    """One spelling per schedule; a bare number or size letter gets the SCH prefix when known."""
    text = F.regexp_replace(F.upper(F.trim(F.nullif(raw, F.lit("")))), "  ", " ")
    prefixed = F.concat(F.lit("SCH "), text)
    return first_true(
        [
            (text.isin(*SCHEDULE_SPELLINGS), lookup(SCHEDULE_SPELLINGS, text)),
            (text.isin(*SCHEDULES), text),
            (~text.startswith("SCH") & prefixed.isin(*SCHEDULES), prefixed),
        ],
        text,
    )


def schedule_rule(query: Column, candidate: Column) -> Column:
    q, c = schedule_name(query), schedule_name(candidate)
    q_at, c_at = position(SCHEDULES, q), position(SCHEDULES, c)
    return decide(
        (q.isNull() & c.isNull(), same()),
        (q.isNull() | c.isNull(), substitute(0.85)),
        (q == c, same()),
        (q_at.isNull() | c_at.isNull(), substitute(0.85)),
        (c_at < q_at, reject("SCHEDULE_DOWN", "SCHEDULE DOWN-RATING: candidate ", c, " is thinner than ", q)),
        otherwise=substitute(0.90),
    )
