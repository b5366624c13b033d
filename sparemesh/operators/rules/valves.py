"""Valve trim, bore, fire safety, relief valves and rupture disks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions.values import first_true
from .base import Side, decide, has_text, position, reject, safe, same, substitute

TRIMS = (1, 8, 5, 12, 16)
ORIFICES = ("D", "E", "F", "G", "H", "J", "K", "L", "M", "N", "P", "Q", "R", "T")


def trim_rule(q: Side, c: Side) -> Column:
    qt, ct = q.raw("trim_no").try_cast("int"), c.raw("trim_no").try_cast("int")
    q_at, c_at = position(TRIMS, qt), position(TRIMS, ct)
    return decide(
        (qt.isNull() & ct.isNull(), same()),
        (qt.isNull() | ct.isNull(), substitute(0.85)),
        (qt == ct, same()),
        (q_at.isNull() | c_at.isNull(), substitute(0.82)),
        (c_at < q_at, reject("TRIM", "TRIM DOWNGRADE: trim ", ct.cast("string"), " for trim ", qt.cast("string"))),
        otherwise=safe(0.98),
    )


def bore_rule(q: Side, c: Side, piggable: Column) -> Column:
    def bore(side):
        return F.regexp_replace(side.text("port_bore", "bore"), " ", "_")

    qb, cb = bore(q), bore(c)
    return decide(
        ((qb == "") & (cb == ""), same()),
        (
            (qb.contains("FULL") | piggable) & (cb.contains("REDUCED") | (cb == "RB")),
            reject("BORE", "PIG BLOCKAGE: reduced bore for full bore"),
        ),
        (qb == cb, same()),
        (qb.contains("REDUCED") & cb.contains("FULL"), safe(0.98)),
        otherwise=substitute(0.88),
    )


def valve_rule(q: Side, c: Side) -> Column:
    fire = F.when(q.has("fire_safe"), q.flag("fire_safe")).otherwise(q.flag("fire_safe_required"))
    proof = first_true(
        [(c.has("fire_safe"), c.flag("fire_safe"))],
        c.flag("fire_safe_certified") | F.lower(c.bag()).contains("api 607"),
    )
    heat = F.coalesce(q.filled("temp_c"), c.raw("temp_c")).try_cast("double")

    def differ(key):
        a, b = q.text(key), c.text(key)
        return (a != "") & (b != "") & (a != b)

    def change(key):
        return (q.text(key), " -> ", c.text(key))

    return decide(
        (fire & ~proof, reject("FIRE_SAFE", "HYDROCARBON FIRE: candidate is not fire-safe")),
        (
            has_text(q.text("category"), "CATEGORY B", "CAT_B", "CAT B")
            & has_text(c.text("category"), "CATEGORY A", "CAT_A", "CAT A"),
            reject("BUTTERFLY", "ELASTOMER BLOWOUT: category A for category B"),
        ),
        (
            (heat > 200.0) & has_text(c.text("seat"), "PTFE", "TEFLON"),
            reject("SOFT_SEAT", "SEAT LIQUEFACTION: soft seat at ", heat.cast("string"), " C"),
        ),
        (
            q.flag("toxic_service", "category_m") & ~c.flag_or("retainerless", True),
            reject("RETAINER", "FUGITIVE EMISSION: retainer design in toxic service"),
        ),
        (differ("offset") | differ("operator") | differ("disc_type"), substitute(0.90)),
        (differ("operation"), reject("OPERATION", "VALVE OPERATION MISMATCH: ", *change("operation"))),
        (differ("end_conn"), reject("END_CONNECTION", "END CONNECTION MISMATCH: ", *change("end_conn"))),
    )


def relief_rule(q: Side, c: Side) -> Column:
    qo = F.upper(F.trim(F.coalesce(q.raw("orifice"), F.lit(""))))
    co = F.upper(F.trim(F.coalesce(c.raw("orifice"), F.lit(""))))
    q_at, c_at = position(ORIFICES, qo), position(ORIFICES, co)
    qp, cp = q.filled("cdtp_bar").try_cast("double"), c.filled("cdtp_bar").try_cast("double")
    return decide(
        ((qo == "") & (co == ""), same()),
        (c_at < q_at, reject("ORIFICE", "OVERPRESSURE: orifice ", co, " is smaller than ", qo)),
        (c_at > q_at, substitute(0.90)),
        (F.abs(qp - cp) > 0.1, reject("SET_PRESSURE", "SET PRESSURE MISMATCH: ", cp.cast("string"), " bar for ", qp.cast("string"), " bar")),
        (qo == co, same()),
        otherwise=substitute(0.85),
    )


def rupture_disk_rule(q: Side, c: Side) -> Column:
    qt, ct = q.text("disk_type", "type"), c.text("disk_type", "type")
    whole = c.flag("non_fragmenting") | has_text(ct, "NON-FRAGMENTING", "NON_FRAGMENTING", "REVERSE_BUCKLING")
    fragments = ct.contains("FRAGMENTING") & ~ct.contains("NON")
    return decide(
        (
            (q.flag("upstream_of_psv") | c.flag("upstream_of_psv")) & (~whole | fragments),
            reject("FRAGMENTING", "PSV NOZZLE CLOGGING: fragmenting disk before a relief valve"),
        ),
        (
            has_text(qt, "REVERSE", "BUCKLING") & has_text(ct, "FORWARD", "TENSION"),
            reject("DISK_FATIGUE", "PREMATURE FATIGUE RUPTURE: tension-loaded disk for a reverse-buckling one"),
        ),
    )
