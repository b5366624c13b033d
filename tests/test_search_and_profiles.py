"""Inverted lists, candidates ranked by fit, and verdicts by profile, against plain recomputation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparemesh.operators import ranked_retrieval, requisitions, retrieval, textjoin, vector_lists
from sparemesh.operators.matching import match_requests, parse_requests
from sparemesh.operators.rules import verdict
from sparemesh.operators.vectors import search

DOMAINS = ("dim", "met", "pt", "std")


# ---- vectors ----------------------------------------------------------------------------------------------


def vector_tables(spark, n=600, width=6, seed=1, clusters=0):
    rng = np.random.default_rng(seed)
    kinds = ["FLANGE", "FLANGE_BLIND", "GATE_VALVE", "PIPE", None]
    rows = []
    for i in range(n):
        row = [i, kinds[i % 5] if i % 7 else "FLANGE"]
        for _ in DOMAINS:
            v = rng.normal(size=width) + (4 * rng.permutation(np.eye(width))[0] if clusters else 0)
            row.append((v / np.linalg.norm(v)).tolist())
        rows.append(row)
    rows[10][2:] = rows[11][2:]  # equal vectors: the smaller id comes first
    rows[20][2] = None
    schema = "item_id long, item_type string, dim array<double>, met array<double>, pt array<double>, std array<double>"
    corpus = spark.createDataFrame(rows, schema).repartition(3)
    asked = [[i, kind, *rows[j][2:]] for i, (kind, j) in enumerate([("FLANGE", 11), ("VALVE", 5), (None, 3), ("PIPE", 20), ("BOLT", 4), ("", 8), ("flange", 100)])]
    return rows, asked, spark.createDataFrame(asked, schema.replace("item_id", "query_id")), corpus


def plain_hits(rows, asked, k):
    families = {"FLANGE": ("FLANGE", "FLANGE_WELD_NECK", "FLANGE_SLIP_ON", "FLANGE_BLIND"), "VALVE": ("VALVE", "GATE_VALVE", "BALL_VALVE", "GLOBE_VALVE"), "BOLT": ("BOLT", "STUD_BOLT")}
    out = {}
    for q in asked:
        types = families.get((q[1] or "").upper(), (q[1],))
        for d, domain in enumerate(DOMAINS, 2):
            if q[d] is not None:
                held = [(-float(np.dot(q[d], r[d])), r[0]) for r in rows if r[d] is not None and (not q[1] or r[1] in types)]
                out[q[0], domain] = [i for _, i in sorted(held, key=lambda x: (round(x[0], 12), x[1]))[:k]]
    return {key: v for key, v in out.items() if v}


@pytest.mark.parametrize("clusters", [0, 1])
def test_exact_lists_with_families(spark, clusters):
    rows, asked, queries, corpus = vector_tables(spark, clusters=clusters)
    found = {}
    for r in vector_lists.search_lists(queries, corpus, 9, least_rows=20, tile_rows=50).orderBy("rank").collect():
        found.setdefault((r.query_id, r.domain), []).append(r.item_id)
    assert found == plain_hits(rows, asked, 9)


@pytest.mark.parametrize("tile_rows", [50, 65536])
def test_near_lists_in_tiles(spark, tile_rows):
    """With room for all lists the nearest ones give the exact hits, also where lists lie in several tiles."""
    rows, asked, queries, corpus = vector_tables(spark)
    found = {}
    for r in vector_lists.search_lists(queries, corpus, 9, least_rows=20, tile_rows=tile_rows, exact=False, mass=1e9).orderBy("rank").collect():
        found.setdefault((r.query_id, r.domain), []).append(r.item_id)
    assert found == plain_hits(rows, asked, 9)


def test_a_query_moves_to_tiles_not_to_lists(spark, monkeypatch):
    """What comes back of the search is a row for each query, domain and tile, however many lists there are."""
    _, _, queries, corpus = vector_tables(spark)
    kept, ranked = [], vector_lists._ranked
    monkeypatch.setattr(vector_lists, "_ranked", lambda hits, *a: kept.append(hits) or ranked(hits, *a))
    one = {"blocks": F.array(F.lit("")), "block": "nothing", "least_rows": 20}
    vector_lists.search_lists(queries, corpus.withColumn("nothing", F.lit("")), 3, **one)
    assert kept[0].count() == kept[0].select("query_id", "domain").distinct().count() == 4 * 7 - 1  # one query has no vector in one domain


def test_empty_tables(spark):
    _, _, queries, corpus = vector_tables(spark, n=150)
    assert vector_lists.search_lists(queries, corpus.limit(0), 3).collect() == []
    assert vector_lists.search_lists(queries.limit(0), corpus, 3).collect() == []


def test_recall_and_growth_of_nearest_lists(spark):
    """Nine of ten neighbours in one block of vectors without clusters, and work that grows slower than n^1.6."""
    compared = []
    for sf in ("sf0.01", "sf0.1"):
        from sparemesh.plans import views as V

        v = V.vectors(spark, f"/root/testdata/{sf}").select("vec_id", *DOMAINS, F.lit("PIPE").alias("item_type"))
        queries, corpus = v.withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id")
        sizes = vector_lists.pairs_compared(queries, corpus, 10).agg(F.sum("compared"), F.sum("possible")).first()
        compared.append(sizes[0])
        assert sizes[1] == 4 * v.count() ** 2
    assert np.log(compared[1] / compared[0]) / np.log(4) < 1.6
    asked = queries.where("query_id % 10 = 0")
    pairs = [vector_lists.search_lists(asked, corpus, 10, exact=e).select("query_id", "domain", "item_id") for e in (True, False)]
    total = pairs[0].count()
    assert total == 200 * 4 * 10 and pairs[0].intersect(pairs[1]).count() >= 0.9 * total


def test_search_through_families(spark):
    """The whole search gives the same hits through lists as through one block of all types of a family."""
    _, _, queries, corpus = vector_tables(spark)
    queries, corpus = (df.where("item_type = 'PIPE'").withColumn("block", F.lit("p")) for df in (queries.where("query_id <> 3").withColumn("item_type", F.lit("PIPE")), corpus))
    plain = search(queries, corpus, top_k=5, rerank=False).select("query_id", "item_id", F.round("similarity", 9)).collect()
    assert sorted(search(queries, corpus, top_k=5, rerank=False, families=True).select("query_id", "item_id", F.round("similarity", 9)).collect()) == sorted(plain)


# ---- candidates -------------------------------------------------------------------------------------------

ITEMS = "sku_code string, cpse string, item_type string, description string, size_nb_mm double, pressure_class int, metallurgy string"
REQUESTS = "request_id string, cpse string, item_type string, query_text string, size_nb_mm double, pressure_class int, metallurgy string"


def stock_rows(n, seed=2):
    rng = random.Random(seed)
    words = ["Gate", "ball", "forged", "wn", "blind", "50%off", "a_b", "zz"]
    return [
        (f"S{i:04}", rng.choice(["T0", "T0", "T1"]), rng.choice(["VALVE", "VALVE", "FLANGE", "PIPE"]), " ".join(rng.choices(words, k=3)), rng.choice([50.0, 100.0, None]), rng.choice([150, 300, 600, None]), rng.choice(["ASTM A105", "SS316", "ss316L", None]))
        for i in range(n)
    ]


def request_rows(n, seed=3):
    rng = random.Random(seed)
    return [
        (f"R{i}", rng.choice(["T0", "T1", "T9"]), rng.choice(["GATE VALVE", "VALVE", "FLANGE_WN", "PIPE", "ALL", None, ""]), rng.choice(["forged item", "50%off", "a_b", "%zz x", "no", "", None, "ball thing"]), rng.choice([50.0, 77.0, None]), rng.choice([0, 150, 600, None]), rng.choice(["316", "ASTM A105", "", None]))
        for i in range(n)
    ]


def like(needle, text):
    import re

    return re.fullmatch("(?s).*" + "".join({"%": ".*", "_": "."}.get(c, re.escape(c)) for c in needle) + ".*", text) is not None


def plain_candidates(stock, requests, limit, fill_below):
    out = set()
    for rid, cpse, kind, text, size, pressure, metal in requests:
        upper = kind.upper() if kind and kind != "ALL" else None
        base = upper and next((b for w, b in (("VALVE", "VALVE"), ("FLANGE", "FLANGE"), ("PIPE", "PIPE")) if w in upper), upper)
        sub = next((w for w in {"VALVE": ("GATE", "BALL"), "FLANGE": ("WN", "BLIND", "SO")}.get(base, ()) if w in (upper or "")), None)
        first = (text or "").split(" ")[0]
        word = first.lower() if len(first) >= 3 else None
        rated = []
        for sku, tenant, item, description, s, c, m in stock:
            if tenant == cpse and (base is None or item == base) and (sub is None or sub.lower() in description.lower()):
                fit = 8 * (size is not None and s == size) + 4 * bool(metal and m and like(metal.lower(), m.lower())) + 2 * bool(pressure and c is not None and c >= pressure) + bool(word and like(word, description.lower()))
                rated.append((-fit, sku))
        hits = sum(f < 0 for f, _ in rated)
        best = sorted(r for r in rated if r[0] < 0 or hits < fill_below)[:limit]
        out |= {(rid, sku, -f, int(f == 0), hits, max(0, hits - limit)) for f, sku in best}
    return out


@pytest.mark.parametrize("limit,fill_below", [(50, 30), (7, 4), (3, 90)])
def test_candidates_ranked_by_fit(spark, monkeypatch, limit, fill_below):
    monkeypatch.setattr(ranked_retrieval, "TILE", 5)
    stock, requests = stock_rows(400), request_rows(60)
    found = ranked_retrieval.retrieve_ranked(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(stock, ITEMS), limit=limit, fill_below=fill_below)
    assert {tuple(r) for r in found.select("request_id", "sku_code", "fit", "filled", "hits", "cut").collect()} == plain_candidates(stock, requests, limit, fill_below)


def test_a_late_sku_is_found(spark):
    """The only fitting item has the last SKU of a large type; the original takes the first ones."""
    stock = [(f"S{i:04}", "T0", "PIPE", "plain", 10.0, 300, "SS316") for i in range(300)] + [("Z", "T0", "PIPE", "plain", 50.0, 300, "SS316")]
    request = spark.createDataFrame([("R", "T0", "PIPE", "x", 50.0, 300, "SS316")], REQUESTS)
    items = spark.createDataFrame(stock, ITEMS)
    best = ranked_retrieval.retrieve_ranked(request, items).orderBy(F.desc("fit")).first()
    assert (best.sku_code, best.hits, best.cut) == ("Z", 301, 251)
    assert retrieval.retrieve(request, items).where("sku_code = 'Z'").count() == 0
    ranked = match_requests(request, items, extract=False).orderBy("rank").first()
    assert ranked.sku_code == "Z" and match_requests(request, items, extract=False, lowest_skus=True).where("sku_code = 'Z'").count() == 0


def test_items_are_written_once(spark, monkeypatch):
    """Items that a search cannot tell apart are one row in every step but the first, in words and lists too."""
    kept = []
    for name in ("written", "checkpointed"):
        make = getattr(ranked_retrieval, name)
        monkeypatch.setattr(ranked_retrieval, name, lambda df, make=make: kept.append(make(df)) or kept[-1])
    items = spark.createDataFrame([(f"S{i:03}", "T1", "VALVE", "Gate forged valve", 50.0, 300, "SS304") for i in range(200)], ITEMS)
    request = spark.createDataFrame([("R", "T1", "GATE_VALVE", "gate valve", 50.0, 300, "SS304")], REQUESTS)
    found = ranked_retrieval.retrieve_ranked(request, items)
    assert [r.sku_code for r in found.orderBy("sku_code").collect()] == [f"S{i:03}" for i in range(50)]
    assert {(r.fit, r.hits, r.cut) for r in found.collect()} == {(15, 200, 150)}
    assert [n for n in (df.count() for df in kept) if n > 3] == [200]


def test_cells_tell_nulls_apart(spark):
    """A missing metal with a text and that text as metal are different cells."""
    stock = [("S1", "T1", "PIPE", None, None, None, "abc"), ("S2", "T1", "PIPE", "abc", None, None, None)]
    request = spark.createDataFrame([("R", "T1", "PIPE", "zzz", None, None, "abc")], REQUESTS)
    found = ranked_retrieval.retrieve_ranked(request, spark.createDataFrame(stock, ITEMS))
    assert [(r.sku_code, r.fit) for r in found.orderBy("sku_code").collect()] == [("S1", 4), ("S2", 0)]



def test_rarest_grams(spark):
    texts = spark.createDataFrame([(f"common{i % 3} rare",) for i in range(30)] + [("common0 xyz",), ("q",)], "text string")
    needles = spark.createDataFrame([("common0 x",), ("q",), ("",), ("zz",), ("nowhere",)], "needle string")
    found = {r.needle: r["__gram"] for r in textjoin.rarest_grams(needles, "needle", texts, "text").collect()}
    assert found["common0 x"] == "0 x" and found["q"] == "q" and found[""] == "" and found["zz"] == "zz" and len(found["nowhere"]) == 3


def test_substring_join_of_any_length(spark):
    """Short, empty, null and repeated needles, and one piece that nearly all texts have."""
    texts = [(i, f"common depot {i}") for i in range(40)] + [(40, "x"), (41, ""), (42, None), (43, "xy"), (44, "common depot 3"), (45, "ab common")]
    needles = [(1, "x"), (2, "xy"), (3, "common depot 3"), (4, ""), (5, None), (6, "zzz"), (7, "3"), (8, "com"), (9, "x"), (10, "depot 39")]
    found = textjoin.containing(spark.createDataFrame(texts, "t long, text string"), "text", spark.createDataFrame(needles, "n long, needle string"), "needle")
    assert found.columns == ["t", "text", "n", "needle"]
    want = sorted((t, n) for t, text in texts for n, needle in needles if text is not None and needle is not None and needle in text)
    assert sorted((r.t, r.n) for r in found.collect()) == want


def test_visible_counts_equal_the_listed_pairs(spark):
    rng = random.Random(11)
    sites = ["OIL Moran", "Jorhat Yard", "oil moran north", "X", None, ""]
    reqs = [(f"Q{i}", rng.choice(["a", "b", "c", None]), rng.choice(["T0", "T0", "T1", None]), rng.choice(sites)) for i in range(300)]
    users = [("a", "T0", "OIL Moran"), ("b", "T1", ""), ("c", None, "jorhat"), ("d", "T9", None), ("e", "T9", "x"), ("f", "T0", "o")]
    r = spark.createDataFrame(reqs, "requisition_id string, requested_by string, source_cpse string, source_depot string")
    u = spark.createDataFrame(users, "username string, cpse string, depot_id string")
    want = {}
    for name, cpse, depot in users:
        n = sum(by == name or (cpse is not None and tenant == cpse) or bool(depot and site is not None and depot.lower() in site.lower()) for _, by, tenant, site in reqs)
        if n:
            want[name] = n
    assert {x.username: x.requisitions for x in requisitions.visible_counts(r, u).collect()} == want
    listed = requisitions.visible_pairs(r, u).groupBy("username").agg(F.count("*").alias("n")).collect()
    assert {x.username: x.n for x in listed} == want


# ---- verdicts by profile ----------------------------------------------------------------------------------


def side_rows(n, seed):
    rng = random.Random(seed)
    kinds = ["PUMP", "PIPE", "GASKET", "STUD_BOLT", "GATE_VALVE", "FLANGE", None]
    bags = [None, {}, {"coupling": "FLEX"}, {"coupling": "RIGID", "flow_rate_m3h": "80"}, {"trim": "8"}, {"sour_service": "true"}, {"sched": "40"}, {"series": "A"}, {"coating": "FBE"}]
    return [(i, rng.choice(kinds), rng.choice([50.0, 700.0, 900.0, None]), rng.choice([150, 300, 900, None]), rng.choice(["ASTM A105", "SS316", "SS304L", None, ""]), rng.choice(["RF", "RTJ", None]), rng.choice([None, "SCH 40", "SCH 80"]), rng.choice(bags)) for i in range(n)]


SIDE = "id long, item_type string, size_nb_mm double, pressure_class int, metallurgy string, facing_end string, schedule string, props map<string,string>"
VERDICT = ("evaluations", "rule_violations", "engineering_upgrades", "compatibility_tier", "composite_score", "is_compatible", "requires_hitl", "summary", "explanation")


def test_verdicts_by_profile_equal_those_by_pair(spark):
    left, right = (verdict.with_profile(verdict.prepare_side(spark.createDataFrame(side_rows(60, s), SIDE))) for s in (1, 2))
    q = left.select("id", *[F.col(c).alias("q_" + c) for c in left.columns if c != "id"])
    c = right.select(F.col("id").alias("other"), *[F.col(n).alias("c_" + n) for n in right.columns if n != "id"])
    pairs = q.join(c, F.pmod("id", F.lit(6)) == F.pmod("other", F.lit(6)))
    plain = {(r.id, r.other): r for r in verdict.evaluate(pairs).select("id", "other", *VERDICT).collect()}
    found = {(r.id, r.other): r for r in verdict.evaluate_by_profile(pairs, verdict.profiles_of(left), verdict.profiles_of(right)).select("id", "other", *VERDICT).collect()}
    assert len(plain) == 600 and found == plain
    assert {r.compatibility_tier for r in plain.values()} == {"TIER_1_IDENTICAL", "TIER_2_SUBSTITUTE", "TIER_3_INCOMPATIBLE"}


def test_rules_see_each_pair_of_profiles_once(spark):
    """1,000 x 40 rows of few kinds: the scored pairs follow the kinds, not the rows."""
    rows = [(i, ("PIPE", "FLANGE")[i % 2], float(i), (150, 300)[i // 2 % 2], "SS316", None, None, None) for i in range(1000)]
    side = verdict.with_profile(verdict.prepare_side(spark.createDataFrame(rows, SIDE)))
    assert verdict.profiles_of(side).count() == 8  # two kinds, two classes, below or from 650 mm
    codes = side.select(F.col("profile").alias("q_profile")).distinct().crossJoin(side.where("id < 40").select(F.col("profile").alias("c_profile")).distinct())
    assert verdict.profile_outcomes(codes, verdict.profiles_of(side), verdict.profiles_of(side)).count() == 8 * 4


def test_a_given_value_wins_over_the_text(spark):
    rows = [("R1", "T0", "", "GATE VALVE DN50 300# SS316 RF", None, None, None), ("R2", "T0", "PIPE", "GATE VALVE DN50 300# SS316 RF", 80.0, 600, "ASTM A105"), ("R3", "T0", None, None, None, None, None)]
    found = {r.request_id: r for r in parse_requests(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert found["R1"].size_nb_mm == 50.0 and found["R1"].pressure_class == 300 and "VALVE" in found["R1"].item_type
    assert (found["R2"].item_type, found["R2"].size_nb_mm, found["R2"].pressure_class, found["R2"].metallurgy) == ("PIPE", 80.0, 600, "ASTM A105")
    assert found["R3"].item_type is None and found["R3"].size_nb_mm is None
