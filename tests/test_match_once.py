"""Work of the match is done once for what is equal, and only for items that are a candidate."""

from pyspark.sql import functions as F

from sparemesh.functions.attributes import with_dialect
from sparemesh.operators import matching, retrieval
from sparemesh.operators.rules.verdict import with_profile

ITEM = (
    "sku_code string, cpse string, item_type string, description string, size_nb_mm double, pressure_class int, metallurgy string, facing_end string, "
    "depot_id string, depot_location string, quantity int, unit_cost_inr double"
)
SHAPE = "shape_id string, cpse string, base_type string, sub_type string, find_size double, find_metal string, find_class int, find_word string"


def items(n):
    kinds = [("VALVE", "GATE steel", 50.0, 150, "SS316", "RF"), ("VALVE", None, None, None, None, None), (None, "steel", 80.0, 300, "", "")]
    places = [("D1", "Mathura Depot"), (None, None), ("D2", "")]
    return [(None if i == 7 else f"S{i:04d}", f"T{i % 2}", *kinds[i % 3], *places[i % 5 % 3], i % 4 or None, 2.5 if i % 3 else None) for i in range(n)]


def test_equal_items_are_cut_before_they_are_put_under_their_keys(spark, monkeypatch):
    sizes, write = [], retrieval.written

    def seen(df):
        out = write(df)
        if "sku_code" in out.columns and "base_type" in out.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(retrieval, "written", seen)
    shapes = [("a", "T0", "VALVE", "", 50.0, None, None, "steel"), ("b", "T0", "*", "", None, "ss316", 100, None)]
    rows = sorted(items(3000), key=lambda i: i[0] or "")
    found = retrieval.candidates_by_shape(spark.createDataFrame(shapes, SHAPE), spark.createDataFrame(rows, ITEM), limit=4, fill_below=2)
    got = sorted((r["shape_id"], r["sku_code"]) for r in found.collect())
    own = [i for i in rows if i[0] and i[1] == "T0"]
    fits = {"a": [i[0] for i in own if i[2] == "VALVE" and i[3]], "b": [i[0] for i in own if i[5]]}
    assert got == [(s, sku) for s in "ab" for sku in fits[s][:4]]
    assert sizes and max(sizes) <= 4 * 3 * 3  # kinds, keys


def test_stock_is_resolved_once_for_equal_attributes(spark):
    stock = spark.createDataFrame(items(90), ITEM)
    found, kinds = matching.prepared_stock(stock)
    plain = with_profile(matching.prepare_items(stock))
    assert sorted(found.columns) == sorted(plain.columns)
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*sorted(plain.columns)))).collect())
    assert text(found) == text(plain)
    assert kinds.count() == 3 and {r[0] for r in kinds.select("profile").collect()} == {r[0] for r in plain.select("profile").collect()}


def test_each_text_is_read_once(spark):
    texts = ["GATE VALVE DN50 300# SS316 RF", "", None, "FLG 4IN 150# A105", "old plate"]
    rows = spark.createDataFrame([(i, texts[i % 5]) for i in range(40)], "i int, query_text string")
    found = matching.with_read_texts(rows).drop("__x_text")
    plain = with_dialect(rows.filter("query_text <> ''"), "query_text", "__x_")
    assert found.count() == 40
    columns = sorted(plain.columns)
    text = lambda df: sorted(r[0] for r in df.select(F.to_json(F.struct(*columns))).collect())
    assert text(found.filter("query_text <> ''")) == text(plain)
    assert found.filter("coalesce(query_text, '') = '' AND __x_item_type IS NOT NULL").count() == 0
