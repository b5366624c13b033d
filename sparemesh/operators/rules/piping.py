"""Coating, sour service, fasteners, gaskets, flanges, fittings, pipe and tubing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.values import first_true
from .base import Side, decide, has_text, position, reject, safe, same, substitute

SOCKET_WELD_RATINGS = (3000.0, 6000.0, 9000.0)


def coating_rule(q: Side, c: Side) -> Column:
    qt, ct = q.number("coating_thickness_um"), c.number("coating_thickness_um")
    qc, cc = q.text("coating"), c.text("coating")
    return decide(
        (ct < qt, reject("COATING_THIN", "COATING THICKNESS DOWNGRADE: ", ct.cast("string"), " um below ", qt.cast("string"), " um")),
        (ct > qt, substitute(0.92)),
        ((qc != "") & (cc != "") & (qc != cc), substitute(0.90)),
    )


def sour_rule(q: Side, c: Side) -> Column:
    required = q.flag("nace_mr0175", "nace_required", "sour_service")
    certified = first_true(
        [
            (c.has("nace_mr0175"), c.flag("nace_mr0175")),
            (c.has("nace_compliant"), c.flag("nace_compliant")),
        ],
        F.lower(c.bag()).contains("nace"),
    )
    hardness = F.when(c.has("hardness_max_hrc"), c.number("hardness_max_hrc")).otherwise(c.number("hardness_hrc"))
    marked = (F.lower(F.coalesce(c.raw("nace_mr0175"), F.lit(""))) == "true") | c.bag().contains("B7M")
    return decide(
        (required & ~certified, reject("SOUR", "SOUR SERVICE VIOLATION: candidate is not certified for wet H2S")),
        (required & (hardness > 22.0), reject("SOUR_HARDNESS", "NACE HARDNESS VIOLATION: ", hardness.cast("string"), " HRC")),
        (~required & certified & marked, substitute(0.90)),
    )


def fastener_rule(q: Side, c: Side, q_metal: Column, c_metal: Column) -> Column:
    qs, cs = F.upper(F.coalesce(q_metal, F.lit(""))), F.upper(F.coalesce(c_metal, F.lit("")))
    temperature = F.coalesce(q.filled("temp", "temp_c"), c.filled("temp", "temp_c"))
    degrees = F.regexp_extract(temperature, r"[-+]?\d*\.?\d+", 0).try_cast("double")
    qy, cy = q.number("yield_strength_mpa"), c.number("yield_strength_mpa")
    nut = c.text("nut_grade", "nut")
    return decide(
        (
            (degrees > 200.0) & has_text(c.text("coating"), "GALV", "ZINC", "CADMIUM", "CAD"),
            reject("LIQUID_METAL", "LIQUID METAL EMBRITTLEMENT: coated stud at ", degrees.cast("string"), " C"),
        ),
        (cy < qy, reject("FASTENER_STRENGTH", "FASTENER STRENGTH DOWN-RATING: ", cy.cast("string"), " MPa below ", qy.cast("string"), " MPa")),
        (qs.contains("L7") & ~cs.contains("L7"), reject("COLD_BOLT", "CRYOGENIC BOLTING: candidate lacks low-temperature impact tests")),
        (
            cs.contains("B7") & has_text(nut, "MILD_STEEL", "COMMERCIAL", "GR.2", "GR 2", "CLASS 4.6"),
            reject("NUT", "THREAD SHEAR: nut too weak for the stud"),
        ),
        (qs == cs, same()),
        (qs.contains("B7") & cs.contains("B16") & ~has_text(nut, "MILD_STEEL", "COMMERCIAL", "GR.2"), safe(0.99)),
        otherwise=substitute(0.88),
    )


def gasket_rule(q: Side, c: Side, pressure_class: Column) -> Column:
    qt, ct = q.parsed("max_temp_c"), c.parsed("max_temp_c")
    heat = F.regexp_extract(q.filled("temp_c", "temp", "max_temp_c"), r"[-+]?\d*\.?\d+", 0).try_cast("double")
    rating = F.coalesce(F.when(pressure_class != 0, pressure_class.cast("double")), q.number("pressure_class"))
    f_hrb = F.coalesce(c.filled("flange_hardness_hrb"), q.raw("flange_hardness_hrb")).try_cast("double")
    g_hrb = F.coalesce(c.filled("gasket_hardness_hrb"), q.raw("gasket_hardness_hrb")).try_cast("double")
    q_filler, c_filler = q.text("filler"), c.text("filler")
    return decide(
        (ct < qt, reject("GASKET_TEMPERATURE", "GASKET TEMPERATURE DOWN-RATING: ", ct.cast("string"), " C below ", qt.cast("string"), " C")),
        (ct > qt, substitute(0.92)),
        (
            (heat > 260.0) & has_text(q_filler, "GRAPHITE", "GRAFOIL") & has_text(c_filler, "PTFE", "TEFLON"),
            reject("GASKET_FILLER", "GASKET MELTING: PTFE filler at ", heat.cast("string"), " C"),
        ),
        ((rating >= 900) & ~c.flag("inner_ring"), reject("INNER_RING", "GASKET COLLAPSE: no inner ring in class ", rating.cast("int").cast("string"))),
        (
            c.text("ring_type").contains("BX") & ~q.text("ring_type").contains("BX"),
            reject("RING_JOINT", "BX RING INCOMPATIBILITY with standard grooves"),
        ),
        (g_hrb >= f_hrb, reject("GASKET_HARDNESS", "RTJ GALLING: gasket ", g_hrb.cast("string"), " HRB, flange ", f_hrb.cast("string"), " HRB")),
        (~q.flag("inner_ring") & c.flag("inner_ring"), safe(0.99)),
    )


def _series(text: Column) -> Column:
    flat = F.translate(F.upper(F.trim(F.coalesce(text, F.lit("")))), "_-", "  ")
    return first_true(
        [(has_text(flat, "SERIES A", "MSS SP 44"), "A"), (has_text(flat, "SERIES B", "API 605"), "B")]
    )


def series_rule(q: Side, c: Side) -> Column:
    qs, cs = _series(q.raw("series")), _series(c.raw("series"))
    return decide(
        (qs.isNull() & cs.isNull(), same()),
        (qs.isNull() | cs.isNull(), substitute(0.85)),
        (qs == cs, same()),
        otherwise=reject("SERIES", "SERIES MISMATCH: required series ", qs, ", candidate series ", cs),
    )


def fitting_rating_rule(q: Side, c: Side) -> Column:
    qr, cr = q.number("rating"), c.number("rating")
    on_ladder = qr.isin(*SOCKET_WELD_RATINGS) & cr.isin(*SOCKET_WELD_RATINGS)
    ratings = (cr.cast("int").cast("string"), "# below ", qr.cast("int").cast("string"), "#")
    return decide(
        (qr.isNull() & cr.isNull(), same()),
        (qr.isNull() | cr.isNull(), substitute(0.85)),
        (cr == qr, same()),
        (on_ladder & (cr < qr), reject("FITTING_LADDER", "FITTING DOWN-RATING: ", *ratings)),
        (cr < qr, reject("FITTING_DOWN", "FITTING DOWN-RATING: ", *ratings)),
        (on_ladder, safe(0.97)),
        otherwise=safe(0.96),
    )


def elbow_rule(q: Side, c: Side, piggable: Column) -> Column:
    qr, cr = q.text("radius"), c.text("radius")
    return decide(
        (
            piggable & has_text(qr, "LR", "1.5D", "LONG") & has_text(cr, "SR", "1.0D", "SHORT"),
            reject("ELBOW", "PIGGING RESTRICTION: short radius elbow in a piggable line"),
        ),
        (qr == cr, same()),
        otherwise=substitute(0.88),
    )


def smys_rule(q: Side, c: Side) -> Column:
    qs, cs = q.number("smys_psi"), c.number("smys_psi")
    return decide((cs < qs, reject("SMYS", "HIGH-YIELD FITTING DOWNGRADE: ", cs.cast("string"), " psi below ", qs.cast("string"), " psi")))


def line_pipe_rule(q: Side, c: Side) -> Column:
    qp, cp = q.text("psl"), c.text("psl")
    service = q.text("service")
    lethal = q.flag("category_m", "lethal_service") | service.contains("CATEGORY_M")
    made, other = q.text("mfg", "mfg_method", "manufacturing_method"), c.text("mfg", "mfg_method", "manufacturing_method")
    welded = has_text(made, "SEAMLESS", "SMLS") & has_text(other, "WELDED", "ERW", "LSAW")
    critical = lethal | has_text(service, "H2", "HYDROGEN") | q.flag("hydrogen_service", "high_pressure")
    return decide(
        (has_text(qp, "PSL 2", "PSL2") & has_text(cp, "PSL 1", "PSL1"), reject("PSL", "BRITTLE PIPELINE RUPTURE: PSL 1 for PSL 2")),
        (lethal & has_text(c.text("joint"), "THREAD", "NPT"), reject("CATEGORY_M_JOINT", "CATEGORY M JOINT: threaded joint in lethal service")),
        (lethal & ~c.flag_or("category_m_certified", True), reject("CATEGORY_M", "LETHAL TOXIC ESCAPE: component is not category M")),
        (welded & critical, reject("WELDED_PIPE", "WELD SEAM RUPTURE: welded pipe for seamless in critical service")),
        (welded, substitute(0.85)),
        (has_text(qp, "PSL 1", "PSL1") & has_text(cp, "PSL 2", "PSL2"), substitute(0.90)),
    )


def tubing_rule(q: Side, c: Side) -> Column:
    qo = q.filled("od_mm").try_cast("double")
    co = c.filled("od_mm").try_cast("double")
    hardness = c.number("hardness_hrb")
    return decide(
        (F.abs(qo - co) > 0.05, reject("TUBING_OD", "TUBE BLOW-OFF: outside diameter ", co.cast("string"), " mm for ", qo.cast("string"), " mm")),
        (hardness > 90.0, reject("TUBING_HARDNESS", "TUBE HARDNESS: ", hardness.cast("string"), " HRB")),
    )


def expansion_rule(q: Side, c: Side) -> Column:
    tied = q.text("restraint").contains("TIED") | q.flag("tied_joint", "restrained_bellows")
    loose = c.text("restraint").contains("UNRESTRAINED") | F.lower(c.bag()).contains("unrestrained")
    c_tied = ~loose & c.flag_or("tied_joint", True)
    return decide(
        (tied & ~c_tied, reject("RESTRAINT", "BELLOWS RUPTURE: unrestrained bellows for a tied joint")),
        (
            has_text(q.text("braid_type"), "DOUBLE", "2-BRAID") & has_text(c.text("braid_type"), "SINGLE", "1-BRAID"),
            reject("HOSE_BRAID", "HOSE BRAID RUPTURE: single braid for double braid"),
        ),
    )


def line_blind_rule(q: Side, c: Side) -> Column:
    standard = c.text("certified_standard")
    shop = has_text(standard, "SHOP_CUT", "UNCERTIFIED")
    certified = c.flag_or("asme_b16_48_certified", True) & ~shop
    cut = c.flag("is_shop_fabricated", "shop_cut_plate") | shop
    return decide(
        ((cut & ~certified) | standard.contains("SHOP_CUT"), reject("LINE_BLIND", "POSITIVE ISOLATION BLOWOUT: uncertified plate")),
        (c.flag("unmarked_handle"), substitute(0.82)),
    )


def insulation_kit_rule(q: Side, c: Side) -> Column:
    qt, ct = q.text("fik_type", "type"), c.text("fik_type", "type")
    mixed = q.flag("bimetallic") | c.flag("bimetallic")
    heat = q.filled("max_temp_c").try_cast("double")
    return decide(
        (
            mixed & has_text(qt, "TYPE E", "FULL_FACE", "TYPE_E") & has_text(ct, "TYPE F", "RAISED_FACE", "TYPE_F"),
            reject("INSULATION_KIT", "GALVANIC PERFORATION: raised-face kit on a bimetallic joint"),
        ),
        (
            (heat > 100.0) & c.text("retainer_material").contains("PHENOLIC"),
            reject("KIT_RETAINER", "DIELECTRIC BREAKDOWN: phenolic retainer at ", heat.cast("string"), " C"),
        ),
        (qt == ct, same()),
        otherwise=substitute(0.88),
    )
