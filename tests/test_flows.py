"""Folds, chains, groups and samples against plain recomputation."""

import hashlib
import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sparemesh.functions.sealing import GENESIS, review_id, sorted_json
from sparemesh.operators import graph, ledger, requisitions, review, stock, training, vectors
from sparemesh.operators.ordering import hash_order, hash_positions, sorted_positions

DAY = datetime(2024, 1, 1)


def stock_history(seed, events=1500, skus=6):
    """Events in which one SKU has most of the requests, with rejections long after their request."""
    r = random.Random(seed)
    rows, open_reqs, n = [], [], 0
    for i in range(events):
        t = DAY + timedelta(minutes=i)
        if open_reqs and r.random() < 0.35:
            req, sku, qty = open_reqs.pop(r.randrange(len(open_reqs)))
            rows.append((i, t, req, sku, r.choice(["REJECT", "REJECT", "DELIVER"]), qty))
            if r.random() < 0.2:
                open_reqs.append((req, sku, qty))
        else:
            sku = "hot" if r.random() < 0.7 else f"s{r.randrange(skus)}"
            qty = r.randrange(1, 30)
            rows.append((i, t, f"R{n}", sku, "CREATE", qty))
            open_reqs.append((f"R{n}", sku, qty))
            n += 1
    return rows, {"hot": 120, **{f"s{i}": 40 for i in range(skus - 1)}}


def plain_replay(rows, opening):
    left, locks, out = dict(opening), {}, {}
    for i, t, req, sku, kind, qty in sorted(rows, key=lambda x: (x[1], x[0])):
        have = left.get(sku, 0)
        if kind == "CREATE":
            ok = qty <= have
            if ok:
                left[sku] = have - qty
                locks[req] = qty
        else:
            ok = req in locks
            if ok:
                held = locks.pop(req)
                if kind == "REJECT":
                    left[sku] = have + held
        out[i] = (ok, left.get(sku, 0))
    return out


@pytest.mark.parametrize("seed,parts", [(1, 1), (2, 7), (3, 16)])
def test_stock_replay_over_seams(spark, seed, parts):
    rows, opening = stock_history(seed)
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, requisition_id string, sku_code string, event_type string, quantity int")
    table = spark.createDataFrame(list(opening.items()), "sku_code string, quantity int")
    result = stock.reserve_stock(events, table, partitions=parts)
    got = {r["event_id"]: (r["granted"], r["stock_left"]) for r in result.collect()}
    assert got == plain_replay(rows, opening)
    locks = {r["requisition_id"]: r["is_active"] for r in stock.locks_of(result).collect()}
    assert any(locks.values()) and not all(locks.values())


def plain_states(rows):
    state, out = {}, {}
    for event_id, req, kind in rows:
        now = state.get(req)
        new = {
            "CREATE": "PENDING_APPROVAL" if now is None else None, "APPROVE": "APPROVED" if now else None, "REJECT": "REJECTED" if now else None,
            "GATE_PASS": "GATE_PASS_ISSUED" if now == "APPROVED" else None, "DISPATCH": "DISPATCHED" if now == "GATE_PASS_ISSUED" else None,
            "DELIVER": "DELIVERED" if now == "DISPATCHED" else None,
        }[kind]
        if new:
            state[req] = new
        out[event_id] = (new is not None, state.get(req))
    return out


def test_state_replay(spark):
    r = random.Random(5)
    kinds = ["CREATE", "APPROVE", "REJECT", "GATE_PASS", "DISPATCH", "DELIVER"]
    rows = [(i, f"R{r.randrange(40)}", r.choice(kinds)) for i in range(2000)]
    df = spark.createDataFrame([(i, req, k, DAY + timedelta(seconds=i)) for i, req, k in rows], "event_id long, requisition_id string, event_type string, ts timestamp")
    got = {x["event_id"]: (x["accepted"], x["state"]) for x in requisitions.replay_states(df).collect()}
    assert got == plain_states(rows)


def plain_chain(rows):
    previous, out = GENESIS, {}
    for log_id, ts, actor, action, ref, details in rows:
        current = hashlib.sha256(f"{previous}|{log_id}|{ts}|{actor}|{action}|{ref}|{details}".encode()).hexdigest()
        out[log_id] = (previous, current)
        previous = current
    return out


LOG = "log_id long, timestamp string, actor_name string, action_name string, reference_id string, details string"


def test_chain_append_and_verify(spark):
    rows = [(i, f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}", f"u{i % 3}", "act", f"r{i}", f'{{"n": {i}}}') for i in range(300)]
    shuffled = random.Random(1).sample(rows, len(rows))
    chained = ledger.append_batch(spark.createDataFrame(shuffled, LOG)).persist()
    assert {r["log_id"]: (r["prev_hash"], r["sha256_hash"]) for r in chained.collect()} == plain_chain(rows)
    for parts in (1, 5):
        good = ledger.verify_chain(chained, parts).first()
        assert good["is_valid"] and good["first_broken_position"] is None and good["total_verified"] == 300
    for damaged in (0, 137, 299):
        bad = chained.withColumn("details", F.when(F.col("log_id") == damaged, "changed").otherwise(F.col("details")))
        found = ledger.verify_chain(bad, 5).first()
        assert (found["is_valid"], found["first_broken_position"], found["first_broken_log_id"]) == (False, damaged, damaged)
    gone = ledger.verify_chain(chained.filter("log_id <> 50"), 5).first()
    assert gone["first_broken_position"] == 50 and gone["first_broken_log_id"] == 51


def test_positions(spark):
    df = spark.createDataFrame([(i, "big" if i % 10 else f"g{i % 30}") for i in range(3000)], "i int, g string").withColumn("h", hash_order(F.col("i")))
    rows = hash_positions(df, ["g"], "h").collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["g"]].append(r)
    for found in groups.values():
        assert [r["h"] for r in sorted(found, key=lambda r: r["position"])] == sorted(r["h"] for r in found)
        assert sorted(r["position"] for r in found) == list(range(len(found))) and {r["total"] for r in found} == {len(found)}
    ordered = sorted_positions(df, ["g", "i"], partitions=5).collect()
    assert [(r["g"], r["i"]) for r in sorted(ordered, key=lambda r: r["position"])] == sorted((r["g"], r["i"]) for r in ordered)


def union_find(pairs):
    head = {}

    def find(x):
        head.setdefault(x, x)
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        head[max(x, y)] = min(x, y)
    return {x: find(x) for x in head}


@pytest.mark.parametrize("pairs", [
    [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)],
    [(random.Random(i).randrange(200), random.Random(i + 999).randrange(200)) for i in range(150)],
])
def test_duplicate_groups(spark, pairs):
    pairs = [p for p in pairs if p[0] != p[1]]
    got = {r["item"]: r["group_id"] for r in graph.duplicate_groups(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == union_find(pairs)


def test_closure_and_links(spark):
    edges = graph.upgrade_edges(spark)
    got = {tuple(r) for r in graph.upgrade_closure(edges, "SAFE_UPGRADE_FOR").collect()}
    assert got == {("300#", "150#"), ("600#", "300#"), ("600#", "150#")}
    edges.createOrReplaceTempView("edges_view")
    assert {tuple(r) for r in spark.sql(graph.closure_sql("edges_view", "TRIM_UPGRADE_FOR")).collect()} == {("Trim 5", "Trim 8"), ("Trim 8", "Trim 1"), ("Trim 5", "Trim 1")}
    depots = spark.createDataFrame([("D1", "Panipat Refinery, Haryana"), ("D2", "Pata"), ("D3", "Uran Gas Plant")], "depot_id string, depot_name string")
    names = spark.createDataFrame([("panipat refinery",), ("Pata, UP",), ("D3",), ("Uran gas plant, Bombay",), ("nowhere",), (None,)], "n string")
    assert {r["n"]: r["depot_id"] for r in graph.depot_links(names, depots, "n").collect()} == {"panipat refinery": "D1", "Pata, UP": "D2", "D3": "D3", "Uran gas plant, Bombay": "D3"}


def test_graph_merges(spark):
    schema = "src_label string, src string, rel string, dst_label string, dst string"
    old = spark.createDataFrame([("InventoryItem", "a", "HAS_SIZE", "Size", "1"), ("Depot", "d", "HOLDS", "InventoryItem", "a"), ("InventoryItem", "b", "HAS_SIZE", "Size", "1")], schema)
    new = spark.createDataFrame([("InventoryItem", "a", "HAS_SIZE", "Size", "2"), ("Depot", "e", "HOLDS", "InventoryItem", "a")], schema)
    gone = spark.createDataFrame([("InventoryItem", "b")], "label string, key string")
    assert {r["dst"] + r["src"] for r in graph.merge_edges(old, new, gone).collect()} == {"2a", "ae"}
    assert {r["dst"] + r["src"] for r in graph.merge_edges(old, new, gone, keep_stale=True).collect()} == {"1a", "2a", "ad", "ae"}


def test_mined_pairs(spark):
    r = random.Random(3)
    rows = [(i, "A" if i % 3 else "B", float(r.randrange(3)), 150, "m") for i in range(400)] + [(1000, "C", 1.0, 150, "m"), (1001, "C", 1.0, 150, "m")]
    items = spark.createDataFrame(rows, "item_id long, item_type string, size_nb_mm double, pressure_class int, metallurgy string")
    spec = {x[0]: x[1:] for x in rows}
    found = defaultdict(lambda: {0: [], 1: []})
    for p in training.mine_pairs(items, positives=5, negatives=15).collect():
        found[p["query_id"]][p["label"]].append(p["candidate_id"])
    assert set(found) == set(spec)
    for query, sides in found.items():
        same = [k for k in spec if spec[k] == spec[query] and k != query]
        assert len(sides[1]) == len(set(sides[1])) == min(5, max(1, len(same)))
        assert all(spec[c] == spec[query] for c in sides[1]) and (query not in sides[1] or not same)
        assert len(sides[0]) == len(set(sides[0])) == 15
        if spec[query][0] == "C":
            assert all(spec[c][0] != "C" for c in sides[0])
        else:
            assert all(spec[c][0] == spec[query][0] and spec[c] != spec[query] for c in sides[0])


def test_pairs_drawn_with_replacement(spark):
    """Every item gets all its draws, however small its group; items without a type are a type; one item alone has no negatives and no rows."""
    rows = [(i, ("A", "B", None)[i % 3], float(i % 4), 150, "m") for i in range(36)] + [(100, "C", 1.0, 150, "m"), (101, "C", 1.0, 150, None)]
    schema = "item_id long, item_type string, size_nb_mm double, pressure_class int, metallurgy string"
    spec = {x[0]: x[1:] for x in rows}
    found = defaultdict(lambda: {0: [], 1: []})
    for p in training.mine_pairs(spark.createDataFrame(rows, schema), replacement=True).collect():
        found[p["query_id"]][p["label"]].append(p["candidate_id"])
    assert set(found) == set(spec)
    for query, sides in found.items():
        alone = sum(s == spec[query] for s in spec.values()) == 1
        assert len(sides[1]) == 5 and len(sides[0]) == 15
        assert all(spec[c] == spec[query] and (alone or c != query) for c in sides[1])
        assert all(spec[c][0] == spec[query][0] and spec[c] != spec[query] for c in sides[0])
    assert len({c for sides in found.values() for c in sides[0]}) == len(rows)
    assert training.mine_pairs(spark.createDataFrame(rows[:1], schema), replacement=True).count() == 0


def test_rows_without_a_group_stay(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else 1) for i in range(100)], "row_id int, label int")
    counts = Counter((r["label"], r["split"]) for r in training.stratified_split(rows, "row_id").collect())
    assert counts == {(k, s): n for k in (None, 1) for s, n in (("train", 40), ("validation", 10))}
    grouped = training.group_split(rows.withColumnRenamed("label", "canonical_id")).collect()
    assert len(grouped) == 100 and len({(r["canonical_id"], r["split"]) for r in grouped}) == 2


def test_splits(spark):
    rows = spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(501)], "row_id int, label int")
    counts = Counter((r["label"], r["split"]) for r in training.stratified_split(rows, "row_id").collect())
    assert counts == {(0, "train"): 360, (0, "validation"): 90, (1, "train"): 40, (1, "validation"): 11}
    with pytest.raises(ValueError):
        training.check_labels(rows.filter("label = 0"))
    grouped = training.group_split(spark.createDataFrame([(i, f"c{i % 20}") for i in range(100)], "i int, canonical_id string")).collect()
    sides = defaultdict(set)
    for r in grouped:
        sides[r["canonical_id"]].add(r["split"])
    assert all(len(s) == 1 for s in sides.values()) and sum(s == {"heldout"} for s in sides.values()) == 3


def test_area_under_curve(spark):
    r = random.Random(7)
    rows = [(r.randrange(12) / 10, r.randrange(2)) for _ in range(400)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    wins = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    got = training.area_under_curve(spark.createDataFrame(rows, "score double, label int")).first()
    assert got["auc"] == pytest.approx(wins / (len(pos) * len(neg)))


def test_vector_search_equals_brute_force(spark):
    import numpy as np

    r = np.random.default_rng(0)
    data = r.normal(size=(180, 4, 8))
    data /= np.linalg.norm(data, axis=2, keepdims=True)
    names = ["dim", "met", "pt", "std"]
    blocks = [0 if i % 4 else i % 3 for i in range(180)]
    rows = [(i, blocks[i], *[[float(x) for x in data[i, d]] for d in range(4)]) for i in range(180)]
    df = spark.createDataFrame(rows, "vec_id long, block int, dim array<double>, met array<double>, pt array<double>, std array<double>")
    hits = vectors.top_by_domain(df.withColumnRenamed("vec_id", "query_id"), df.withColumnRenamed("vec_id", "item_id"), 7, tile_rows=16)
    got = defaultdict(list)
    for h in hits.collect():
        got[h["query_id"], h["domain"]].append((h["rank"], h["item_id"]))
    for q in range(180):
        pool = [i for i in range(180) if blocks[i] == blocks[q]]
        for d, name in enumerate(names):
            best = sorted(pool, key=lambda i: (-round(float(data[q, d] @ data[i, d]), 12), i))[:7]
            assert [i for _, i in sorted(got[q, name])] == best
    one = spark.createDataFrame([({"dim": 0.9, "met": 0.5},)], "s map<string,double>").select(vectors.fused(F.col("s"))).first()[0]
    assert one == pytest.approx(0.9 * 0.75 + 1.4 / 4 * 0.25)


def test_review_queue(spark):
    rows = [("certain", "A", 0.95, "Tier-1", 1), ("x", "B", 0.7, "Tier-3", 2), ("u1", "B", 0.51, "Tier-3", 3), ("u2", "C", 0.49, "Tier-4-Reject", 4), ("x", "B", 0.6, "Tier-3", 5)]
    df = spark.createDataFrame(rows, "query string, canonical_id string, similarity double, tier string, ts long").withColumn("canonical_description", F.concat(F.lit("item "), "canonical_id"))
    boot = review.bootstrap_queue(df, 2).collect()
    assert {r["query"] for r in boot} == {"u1", "u2"}
    queue = review.review_queue(review.review_items(df), 2)
    assert [(r["query"], r["similarity"]) for r in queue.collect()] == [("x", 0.6), ("u2", 0.49)]
    many = spark.range(1001).select(F.concat(F.lit("q"), "id").alias("query"), F.lit("A").alias("canonical_id"), F.lit(0.5).alias("similarity"), F.lit("Tier-3").alias("tier"), F.col("id").alias("ts"))
    kept = review.review_queue(review.review_items(many))
    assert kept.count() == 1001
    done = kept.select("id", F.lit(True).alias("accepted"))
    assert tuple(review.queue_counters(kept, done).first()) == (0, 1001, None)
    ident = hashlib.sha256('["x","B"]'.encode()).hexdigest()
    assert ident in {r["id"] for r in queue.collect()}
    decided = spark.createDataFrame([(ident, True, None, 9)], "id string, accepted boolean, corrected_candidate string, decided_at long")
    got = review.resolve(queue, decided).collect()
    assert [(r["query"], r["candidate"], r["label"], r["cosine"]) for r in got] == [("x", "item B", 1, 0.6)]


def test_review_id_escapes_like_json(spark):
    import json

    texts = [('a "b" \\ c', "CAN-1"), ("plain", "CAN-2"), ("tab\tline\nend", "x/y")]
    got = [r[0] for r in spark.createDataFrame(texts, "q string, c string").select(review_id(F.col("q"), F.col("c"))).collect()]
    assert got == [hashlib.sha256(json.dumps(list(t), separators=(",", ":")).encode()).hexdigest() for t in texts]


def test_sorted_json(spark):
    import json

    row = spark.createDataFrame([("v", 3, None, 1.5, True)], "b string, a int, c string, d double, e boolean")
    got = row.select(sorted_json({n: F.col(n) for n in row.columns})).first()[0]
    assert got == json.dumps({"b": "v", "a": 3, "c": None, "d": 1.5, "e": True}, sort_keys=True)


def test_surplus_from_the_items_alone(spark):
    """A wanted class is served by itself and by every class above it; nothing but the items and the ladder is read."""
    wanted = spark.createDataFrame([("R1", "PIPE", "50.0 mm", "150#", "SS304"), ("R2", "PIPE", "50.0 mm", "900#", "SS304"), ("R3", "PIPE", "50.0 mm", "300#", None)], "request_id string, item_type string, size_value string, class_value string, metal_value string")
    stock = [("S1", 150), ("S2", 300), ("S3", 600), ("S4", 900)]
    items = spark.createDataFrame(
        [(sku, "T0", "D0", "PIPE", 50.0, kind, "SS304", 1, 0, 1.0) for sku, kind in stock],
        "sku_code string, cpse string, depot_id string, item_type string, size_nb_mm double, pressure_class int, metallurgy string, quantity int, days_idle int, unit_cost_inr double",
    )
    ladder = spark.createDataFrame([("300#", "SAFE_UPGRADE_FOR", "150#"), ("600#", "SAFE_UPGRADE_FOR", "300#")], "src string, rel string, dst string")
    found = graph.compatible_surplus(wanted, graph.item_payload(items), ladder)
    assert sorted((r.request_id, r.sku_code) for r in found.collect()) == [("R1", "S1"), ("R1", "S2"), ("R1", "S3"), ("R2", "S4")]
