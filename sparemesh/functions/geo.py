"""Depot coordinates, distance, time, freight and emissions."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Depot name, latitude, longitude; the order matters for name matching.
DEPOTS = (
    ("OIL Duliajan", 27.3575, 95.3188), ("Duliajan", 27.3575, 95.3188),
    ("OIL Moran", 27.1856, 94.9282), ("Moran", 27.1856, 94.9282),
    ("OIL Digboi", 27.3826, 95.6262), ("NRL Numaligarh", 26.5982, 93.7543),
    ("Numaligarh", 26.5982, 93.7543), ("ONGC Nazira", 26.9183, 94.7342),
    ("Nazira", 26.9183, 94.7342), ("OIL Guwahati", 26.1855, 91.8214),
    ("OIL Jorhat", 26.7509, 94.2037), ("Jorhat", 26.7509, 94.2037),
    ("OIL Jodhpur", 26.2389, 73.0243), ("Jodhpur", 26.2389, 73.0243),
    ("OIL Kakinada", 16.9891, 82.2475), ("Kakinada", 16.9891, 82.2475),
    ("Panipat", 29.3909, 76.9635), ("Mathura", 27.4924, 77.6737), ("Koyali", 22.3217, 73.1384),
    ("Paradip", 20.3164, 86.6085), ("Barauni", 25.4714, 85.9990), ("Guwahati", 26.1445, 91.7362),
    ("Digboi", 27.3834, 95.6228), ("Hazira", 21.1000, 72.6500), ("Ankleshwar", 21.6263, 73.0025),
    ("Uran", 18.8789, 72.9341), ("Mumbai High", 19.3700, 71.3800), ("Rajahmundry", 17.0005, 81.8040),
    ("Mumbai Mahul", 19.0252, 72.8890), ("Kochi", 9.9312, 76.2673), ("Bina", 24.1814, 78.1292),
    ("Mumbai", 19.0176, 72.8562), ("Visakh", 17.6868, 83.2185), ("Pata", 26.4600, 80.5400),
    ("Vijaipur", 24.1084, 77.2905),
)
# Fallback coordinates and the five named corridors.
CENTRAL = (22.3217, 73.1384)
PANIPAT = (29.3909, 76.9635)
VISAKH = (17.6868, 83.2185)
DULIAJAN = (27.3575, 95.3188)
CORRIDORS = (
    ("Panipat", "Visakh", "IOCL to HPCL Critical Inter-CPSE Route"),
    ("Mumbai", "Uran", "BPCL to ONGC Offshore Corridor"),
    ("Pata", "Panipat", "GAIL to IOCL Feedstock Spares Corridor"),
    ("Mathura", "Bina", "IOCL to BPCL Central Pipeline Corridor"),
    ("Koyali", "Hazira", "IOCL to ONGC West Coast Hub"),
)


def depots(spark: SparkSession) -> DataFrame:
    rows = [(i, *d) for i, d in enumerate(DEPOTS)]
    return spark.createDataFrame(rows, "ord int, name string, lat double, lon double")


def point(pair) -> Column:
    return F.struct(F.lit(pair[0]).alias("lat"), F.lit(pair[1]).alias("lon"))


def named_point(*texts: Column, mode: str = "first", default: Column | None = None) -> Column:
    """Coordinates of the depot whose name occurs in one of the texts.

    The table is a fixed 35-row literal array that is filtered per row, so there is no join. ``mode``
    picks the first or the last entry of the table when several names occur.
    """
    table = F.from_json(F.lit(json.dumps([{"name": n.lower(), "lat": a, "lon": o} for n, a, o in DEPOTS])), F.lit("array<struct<name:string,lat:double,lon:double>>"))
    lowered = [F.lower(F.coalesce(t, F.lit(""))) for t in texts]

    def named(depot):
        hit = F.contains(lowered[0], depot["name"])
        for t in lowered[1:]:
            hit = hit | F.contains(t, depot["name"])
        return hit

    found = F.try_element_at(F.filter(table, named), F.lit(1 if mode == "first" else -1))
    spot = F.when(found.isNotNull(), F.struct(found["lat"].alias("lat"), found["lon"].alias("lon")))
    return spot if default is None else F.coalesce(spot, default)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a1, o1, a2, o2 = F.radians(lat1), F.radians(lon1), F.radians(lat2), F.radians(lon2)
    inner = F.pow(F.sin((a2 - a1) / 2.0), F.lit(2.0)) + F.cos(a1) * F.cos(a2) * F.pow(
        F.sin((o2 - o1) / 2.0), F.lit(2.0)
    )
    return F.asin(F.sqrt(inner)) * 2.0 * 6371.0


def road_km(source: Column, target: Column) -> Column:
    return haversine(source["lat"], source["lon"], target["lat"], target["lon"]) * 1.28


def transit_hours(km: Column) -> Column:
    return km / 40.0 + 4.0


def freight_inr(km: Column, kilograms: Column) -> Column:
    return km * (kilograms / 1000.0) * 5.0


def co2_saved(km: Column) -> Column:
    return F.greatest(F.lit(0.0), F.lit(100000.0) - km * 60.0) / 1000.0


def map_position(lat: Column, lon: Column) -> Column:
    """Position on the 100 x 100 network map, kept ten units from the border."""
    def inside(v):
        return F.round(F.greatest(F.lit(10.0), F.least(F.lit(90.0), v)), 1)

    return F.struct(
        inside((lon - 68.0) / 28.0 * 75.0 + 15.0).alias("x"),
        inside(F.lit(100.0) - ((lat - 8.0) / 24.0 * 75.0 + 15.0)).alias("y"),
    )
