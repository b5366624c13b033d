"""Rotating and static equipment."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.values import first_true, no_zero
from .base import Side, decide, has_text, position, reject, same, substitute

CLEARANCES = ("C2", "CN", "C3", "C4", "C5")
PUMP_CLASSES = ("S-1", "S-3", "S-5", "S-6", "C-6", "A-8", "D-1", "D-2")
ELASTOMERS = {"NBR": 1, "NITRILE": 1, "EPDM": 2, "VITON": 3, "FKM": 3, "FFKM": 4, "KALREZ": 4}
PRESSURIZED_PLANS = ("PLAN 53A", "PLAN 53B", "PLAN 53C", "PLAN 54")
SINGLE_PLANS = ("PLAN 11", "PLAN 12", "PLAN 21", "PLAN 23", "PLAN 31", "PLAN 32", "PLAN 52")
TEMA = ("TEMA B", "TEMA C", "TEMA R")


def motor_rule(q: Side, c: Side) -> Column:
    zone, other_zone = q.text("zone", "area"), c.text("zone", "area")
    hazardous = (
        q.flag("ex_rating")
        | has_text(zone, "ZONE_1", "ZONE 1", "ZONE_2", "EX")
        | F.coalesce(q.raw("zone").isin("1", "2"), F.lit(False))
    )
    poles, other_poles = q.filled("poles", "pole_count"), c.filled("poles", "pole_count")
    rpm, other_rpm = no_zero(q.parsed("rpm")), no_zero(c.parsed("rpm"))
    kw, other_kw = no_zero(q.parsed("power_kw", "kw")), no_zero(c.parsed("power_kw", "kw"))

    def compact(side, key):
        return F.regexp_replace(side.text(key), " ", "")

    def differ(key):
        a, b = compact(q, key), compact(c, key)
        return (a != "") & (b != "") & (a != b)

    def ip(side):
        return F.when(compact(side, "ip_rating").startswith("IP"), F.substring(F.regexp_replace(compact(side, "ip_rating"), "IP", ""), 1, 2).try_cast("int"))

    return decide(
        (hazardous & ~c.flag("ex_rating"), reject("MOTOR_EX", "EXPLOSION: motor without Ex rating in a hazardous area ", other_zone)),
        (
            F.coalesce(poles != other_poles, F.lit(False)) | F.coalesce(F.abs(rpm - other_rpm) > 100, F.lit(False)),
            reject("MOTOR_SPEED", "HYDRAULIC SHOCK: pole count or speed differs"),
        ),
        (other_kw < kw, reject("MOTOR_POWER", "MOTOR OVERLOAD: ", other_kw.cast("string"), " kW below ", kw.cast("string"), " kW")),
        (differ("voltage"), reject("MOTOR_VOLTAGE", "VOLTAGE MISMATCH: ", compact(q, "voltage"), " -> ", compact(c, "voltage"))),
        (differ("frequency"), reject("MOTOR_FREQUENCY", "FREQUENCY MISMATCH: ", compact(q, "frequency"), " -> ", compact(c, "frequency"))),
        (ip(c) < ip(q), reject("MOTOR_IP", "IP RATING DOWNGRADE: ", compact(q, "ip_rating"), " -> ", compact(c, "ip_rating"))),
        (ip(c) > ip(q), substitute(0.94)),
    )


def _plan(side: Side) -> Column:
    text = F.trim(F.regexp_replace(F.regexp_replace(side.text("plan", "seal_plan", "api_plan"), "_", " "), r"\s+", " "))
    return F.when((text != "") & ~text.startswith("PLAN"), F.concat(F.lit("PLAN "), text)).otherwise(text)


def _elastomer(text: Column) -> Column:
    return first_true([(text.contains(word), rank) for word, rank in ELASTOMERS.items()])


def seal_rule(q: Side, c: Side) -> Column:
    qp, cp = _plan(q), _plan(c)
    both = (qp != "") & (cp != "") & (qp != cp)
    dual = has_text(qp, *PRESSURIZED_PLANS, "53", "DUAL")
    single = has_text(cp, *SINGLE_PLANS, "11", "SINGLE")
    qm, cm = q.first_present("material", "seal_material"), c.first_present("material", "seal_material")
    q_rank, c_rank = _elastomer(qm), _elastomer(cm)
    return decide(
        (both & dual & single, reject("SEAL_PLAN", "SEAL PLAN DOWNGRADE: ", qp, " -> ", cp)),
        (both & ~dual & ~single & has_text(cp, *PRESSURIZED_PLANS, "53"), substitute(0.90)),
        (
            both & ~(~dual & ~single & has_text(cp, *PRESSURIZED_PLANS, "53")) & qp.contains("53B") & cp.contains("52"),
            reject("COMPRESSOR_PLAN", "SEAL PLAN DOWNGRADE: ", qp, " -> ", cp),
        ),
        (c_rank < q_rank, reject("ELASTOMER", "SEAL MATERIAL DOWNGRADE: ", qm, " -> ", cm)),
        (c_rank > q_rank, substitute(0.93)),
    )


def bearing_rule(q: Side, c: Side) -> Column:
    qt, ct = q.first_present("type", "bearing_type"), c.first_present("type", "bearing_type")
    q_at, c_at = position(CLEARANCES, q.text("clearance")), position(CLEARANCES, c.text("clearance"))
    return decide(
        ((qt != "") & (ct != "") & (qt != ct), reject("BEARING_TYPE", "BEARING TYPE MISMATCH: ", qt, " -> ", ct)),
        (c_at < q_at, reject("BEARING_CLEARANCE", "BEARING SEIZURE: clearance ", c.text("clearance"), " is tighter than ", q.text("clearance"))),
        (c_at > q_at, substitute(0.90)),
    )


def pump_rule(q: Side, c: Side) -> Column:
    flow, other_flow = no_zero(q.parsed("flow_rate_m3h", "capacity_m3h")), no_zero(c.parsed("flow_rate_m3h", "capacity_m3h"))
    qc, cc = q.text("coupling"), c.text("coupling")
    mount, other_mount = q.text("api610_type", "api_mount", "pump_type"), c.text("api610_type", "api_mount", "pump_type")
    heat = F.coalesce(no_zero(q.parsed("temp_c")), no_zero(q.parsed("operating_temp_c")), no_zero(q.parsed("temp")))
    q_at, c_at = position(PUMP_CLASSES, q.text("api_class")), position(PUMP_CLASSES, c.text("api_class"))
    delta = c.parsed("hardness_delta_hb")
    rings = F.abs(no_zero(c.parsed("impeller_wear_ring_hb")) - no_zero(c.parsed("casing_wear_ring_hb")))
    return decide(
        (other_flow < flow, reject("PUMP_FLOW", "PUMP FLOW RATE DOWN-RATING: ", other_flow.cast("string"), " below ", flow.cast("string"))),
        ((qc != "") & (cc != "") & (qc != cc), reject("PUMP_COUPLING", "COUPLING TYPE MISMATCH: ", qc, " -> ", cc)),
        (
            (heat > 150.0) & mount.contains("OH2") & other_mount.contains("OH1"),
            reject("PUMP_MOUNTING", "THERMAL MISALIGNMENT: foot-mounted pump at ", heat.cast("string"), " C"),
        ),
        (c_at < q_at, reject("PUMP_CLASS", "PUMP MATERIAL DOWNGRADE: ", q.text("api_class"), " -> ", c.text("api_class"))),
        (delta < 50.0, reject("WEAR_RING", "WEAR RING GALLING: difference of ", delta.cast("string"), " HB")),
        (rings < 50.0, reject("WEAR_RING", "WEAR RING GALLING: difference of ", rings.cast("string"), " HB")),
    )


def compressor_rule(q: Side, c: Side) -> Column:
    keys = ("valve_function", "valve_role", "valve_type")
    qv, cv = q.text(*keys), c.text(*keys)
    metal = c.text("impeller_material")
    return decide(
        (
            (qv.contains("SUCTION") & cv.contains("DISCHARGE")) | (qv.contains("DISCHARGE") & cv.contains("SUCTION")),
            reject("CYLINDER_VALVE", "CYLINDER VALVE INVERSION: ", qv, " -> ", cv),
        ),
        (
            q.text("dgs_type", "seal_type").contains("TANDEM") & c.text("dgs_type", "seal_type").contains("SINGLE"),
            reject("DRY_GAS_SEAL", "DRY GAS SEAL DOWNGRADE: single seal for tandem"),
        ),
        (
            q.flag("sour_gas", "nace") & has_text(metal, "17-4PH", "AISI 630") & ~c.text("heat_treatment").contains("H1150M"),
            reject("IMPELLER", "IMPELLER BURST: 17-4PH without double ageing in sour gas"),
        ),
    )


def tank_rule(q: Side, c: Side) -> Column:
    keys = ("required_scfh", "inbreathing_capacity_nm3h", "venting_capacity_nm3h")
    qv, cv = q.filled(*keys).try_cast("double"), c.filled(*keys).try_cast("double")
    qa, ca = q.text("zone", "arrestor_type"), c.text("zone", "arrestor_type")
    qp, cp = q.first_present("paint_sys", "paint_system"), c.first_present("paint_sys", "paint_system")
    paint = (qp != "") & (cp != "") & (qp != cp)
    return decide(
        (cv < qv, reject("TANK_VENT", "TANK VACUUM IMPLOSION: capacity ", cv.cast("string"), " below ", qv.cast("string"))),
        (
            has_text(qa, "DETONATION", "IN_LINE", "IN-LINE") & has_text(ca, "DEFLAGRATION", "END_OF_LINE", "END-OF-LINE"),
            reject("ARRESTOR", "SUPERSONIC FLAME PENETRATION: deflagration arrestor for detonation duty"),
        ),
        (
            paint & has_text(qp, "EPOXY", "PHENOLIC", "VINYL") & has_text(cp, "ALKYD", "PRIMER"),
            reject("TANK_PAINT", "PAINT SYSTEM MISMATCH: ", qp, " -> ", cp),
        ),
        (paint, substitute(0.85)),
    )


def filter_rule(q: Side, c: Side) -> Column:
    def micron(side):
        return F.coalesce(side.filled("micron_rating"), side.raw("micron")).try_cast("double")

    qm, cm = micron(q), micron(c)
    qt, ct = F.trim(q.first_present("thread", "thread_type")), F.trim(c.first_present("thread", "thread_type"))
    return decide(
        (cm > qm, reject("MICRON", "MICRON RATING DOWNGRADE: ", cm.cast("string"), " um for ", qm.cast("string"), " um")),
        (cm < qm, substitute(0.93)),
        ((qt != "") & (ct != "") & (qt != ct), reject("THREAD", "THREAD MISMATCH: ", qt, " -> ", ct)),
        (
            has_text(q.text("trap_type"), "BUCKET", "FLOAT") & has_text(c.text("trap_type"), "DISC", "THERMODYNAMIC"),
            reject("STEAM_TRAP", "WATER HAMMER: disc trap for bucket or float trap"),
        ),
    )


def insulation_rule(q: Side, c: Side, substrate: Column) -> Column:
    metal = F.upper(F.coalesce(substrate, F.lit("")))
    stainless = q.flag("ss_piping") | c.flag("ss_piping") | has_text(metal, "304", "316", "DUPLEX", "2205", "2507")
    inhibited = c.flag("astm_c795_compliant") | F.upper(c.bag()).contains("C795")
    chlorides = c.filled("chloride_ppm_max", "leachable_chlorides_ppm").try_cast("double")
    heat = F.coalesce(q.filled("temp_c"), q.raw("operating_temp_c")).try_cast("double")
    cold = F.coalesce(heat < -29.0, F.lit(False)) | q.flag("cryogenic")
    porous = (
        has_text(c.text("insulation_type"), "MINERAL WOOL", "FIBERGLASS", "CALCIUM SILICATE")
        | ~c.flag_or("closed_cell", True)
        | F.upper(c.bag()).contains("OPEN_CELL")
    )
    return decide(
        (stainless & ~inhibited & (chlorides > 50.0), reject("CUI", "CHLORIDE STRESS CORROSION: ", chlorides.cast("string"), " ppm chlorides")),
        (cold & porous, reject("CRYO_INSULATION", "CRYOGENIC INSULATION SHATTERING: permeable insulation")),
    )


def exchanger_rule(q: Side, c: Side) -> Column:
    def tema(side):
        text = side.text("tema_class")
        return first_true(
            [
                (has_text(text, "TEMA R", "TEMA_R", "REFINERY"), 2),
                (has_text(text, "TEMA C", "TEMA_C", "COMMERCIAL"), 1),
                (has_text(text, "TEMA B", "TEMA_B"), 0),
            ]
        )

    keys = ("mfg", "tube_mfg", "design", "mfg_method")
    bent = q.flag("u_tube") | F.upper(q.bag()).contains("U-TUBE")
    return decide(
        (tema(c) < tema(q), reject("TEMA", "TEMA CLASS DOWNGRADE: ", q.text("tema_class"), " -> ", c.text("tema_class"))),
        (
            has_text(q.text(*keys), "SEAMLESS", "A213") & has_text(c.text(*keys), "WELDED", "A249"),
            reject("EXCHANGER_TUBE", "WELD SEAM RUPTURE: welded tube for seamless"),
        ),
        (
            has_text(q.text("wall_basis"), "MIN", "MW") & has_text(c.text("wall_basis"), "AVG", "AW"),
            reject("TUBE_WALL", "TUBE BUCKLING: average wall for minimum wall"),
        ),
        (bent & ~c.flag_or("u_bend_annealed", True), reject("U_BEND", "U-BEND CRACKING: bends are not annealed")),
    )
