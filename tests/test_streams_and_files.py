"""Streams equal their batch results; files keep their content."""

import random
import uuid
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from sparemesh.operators import catalog, documents
from sparemesh.plans import views as V
from sparemesh.sources import readers, writers
from sparemesh.streaming import changes, stateful

from test_flows import DAY, plain_replay, stock_history


def stream_of(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def drain(spark, stream, tmp_path, schema):
    out = str(tmp_path / uuid.uuid4().hex)
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-s").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(schema).parquet(out)


def test_change_feed(spark, tmp_path):
    rows = [
        (1, "inventory_items", "INSERT", "a", '{"sku_code": "a", "cpse": "t1", "depot_id": "D", "size_nb_mm": 50.0, "quantity": 1}'),
        (2, "inventory_items", "INSERT", "b", '{"sku_code": "b", "size_nb_mm": 80.0}'),
        (3, "inventory_items", "UPDATE", "a", '{"sku_code": "a", "cpse": "t1", "depot_id": "D", "size_nb_mm": 100.0, "quantity": 2}'),
        (4, "inventory_items", "DELETE", "b", '{"sku_code": "b"}'),
        (5, "inventory_items", "UPDATE", "c", "{broken"), (6, "other", "UPDATE", "d", "{}"),
        (7, "requisitions", "INSERT", "R1", '{"requisition_id": "R1", "sku_code": "a", "required_qty": 3}'),
    ]
    root = str(tmp_path / "root")
    df = spark.createDataFrame([(*r, DAY) for r in rows], changes.OUTBOX)
    # the later change arrives first: the highest id counts, not the order of arrival
    for part in (df.filter("id in (3, 4, 5)"), df.filter("id not in (3, 4, 5)")):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "outbox"))
    spark_state = str(tmp_path / "state")
    changes.follow(changes.outbox_stream(spark, str(tmp_path / "outbox"), 1), root, spark_state, once=True).awaitTermination()
    live = {r["sku_code"]: r for r in changes.current_records(spark, root).collect()}
    assert set(live) == {"a"} and live["a"]["size_nb_mm"] == 100.0 and live["a"]["quantity"] == 2
    assert {r["requisition_id"] for r in changes.current_records(spark, root, "requisitions").collect()} == {"R1"}
    assert {r["id"] for r in changes.stored_changes(spark, root, "failed").collect()} == {5, 6}
    sizes = lambda keep: {r["dst"] for r in changes.current_edges(spark, root, keep).filter("rel = 'HAS_SIZE'").collect()}
    assert sizes(False) == {"100.0 mm"} and sizes(True) == {"50.0 mm", "100.0 mm"}
    # a batch that runs twice replaces itself
    before = changes.stored_changes(spark, root).count()
    changes.apply_batch(root)(df.filter("id in (3, 4, 5)"), 0)
    changes.apply_batch(root)(df.filter("id in (3, 4, 5)"), 0)
    assert changes.stored_changes(spark, root).filter("id = 3").count() >= 1 and before >= 4
    assert not changes.backfill(spark.createDataFrame([("z",)], "sku_code string"), root)
    changes.compact(spark, root, str(tmp_path / "folded"))
    folded = str(tmp_path / "folded")
    assert {r["sku_code"] for r in changes.current_records(spark, folded).collect()} == {"a"}
    # a late change with a lower id does not bring back what was deleted
    gone = changes.stored_changes(spark, folded).filter("operation = 'DELETE'").select("table_name", "record_key", "id")
    assert gone.count() > 0
    late = changes.stored_changes(spark, root).filter("operation <> 'DELETE'").join(gone.select("table_name", "record_key"), ["table_name", "record_key"], "left_semi")
    late.write.mode("overwrite").parquet(f"{folded}/changes/batch=late")
    assert {r["sku_code"] for r in changes.current_records(spark, folded).collect()} == {"a"}


def test_stock_stream_equals_plain_replay(spark, tmp_path):
    stateful.use_rocksdb(spark)
    rows, opening = stock_history(11, events=300)
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, requisition_id string, sku_code string, event_type string, quantity int")
    stock = spark.createDataFrame(list(opening.items()), "sku_code string, quantity int")
    for i in range(3):  # three batches in time order
        events.filter(F.floor(F.col("event_id") / 100) == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "events"))
    out = drain(spark, stateful.stock_stream(stream, stock), tmp_path, stateful.STOCK_RESULT)
    assert {r["event_id"]: (r["granted"], r["stock_left"]) for r in out.collect()} == plain_replay(rows, opening)


def test_guard_windows_start_at_the_first_event(spark, tmp_path):
    stateful.use_rocksdb(spark)
    r = random.Random(2)
    rows = [(i, "login", f"s{r.randrange(3)}", DAY + timedelta(seconds=i * r.choice([1, 2, 7]) % 4000)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, scope string, subject string, ts timestamp")
    out = drain(spark, stateful.guarded(stream_of(spark, df, str(tmp_path / "in"), 1), 5, 60), tmp_path, stateful.BURST_RESULT)
    windows, expected = {}, {}
    for i, _, subject, ts in sorted(rows, key=lambda x: (x[3], x[0])):
        start, hits = windows.get(subject, (ts, 0))
        if (ts - start).total_seconds() >= 60:
            start, hits = ts, 0
        windows[subject] = (start, hits + 1)
        expected[i] = hits + 1 <= 5
    assert {x["event_id"]: x["allowed"] for x in out.collect()} == expected and not all(expected.values())


def test_distinct_keys(spark, tmp_path):
    rows = [("k1", DAY), ("k2", DAY), ("k1", DAY + timedelta(hours=1))]
    df = spark.createDataFrame(rows, "idempotency_key string, ts timestamp")
    out = drain(spark, stateful.distinct_keys(stream_of(spark, df, str(tmp_path / "in"))), tmp_path, "idempotency_key string, ts timestamp")
    assert sorted(r[0] for r in out.collect()) == ["k1", "k2"]


def test_reading_order(spark):
    blocks = [(0, "right", 100.0, 10.0, 24.0), (1, "next row", 0.0, 28.0, 42.0), (2, "left", 0.0, 3.0, 17.0)]
    df = spark.createDataFrame([(7, 1, n, t, x, a, b) for n, t, x, a, b in blocks], "doc_id long, page int, block_no long, text string, x double, top double, bottom double")
    rows = documents.reading_order(df).orderBy("reading_position").collect()
    assert [r["text"] for r in rows] == ["left", "right", "next row"]


def test_documents_by_type_and_size(spark, tmp_path):
    for name, size in {"a.pdf": 10, "b.PNG": 5, "c.txt": 5, "d.jpeg": 0}.items():
        (tmp_path / name).write_bytes(b"x" * size)
    with open(tmp_path / "big.pdf", "wb") as f:
        f.truncate(readers.MAX_DOCUMENT_BYTES + 1)
    found = {r["path"].rsplit("/", 1)[1]: len(r["content"]) for r in readers.document_bytes(spark, str(tmp_path)).collect()}
    assert found == {"a.pdf": 10, "b.PNG": 5}
    left_out = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in readers.rejected_documents(spark, str(tmp_path)).collect()}
    assert left_out == {"c.txt": "TYPE", "big.pdf": "TOO_LARGE"}


def test_json_and_pairs(spark, tmp_path):
    (tmp_path / "golden.json").write_text('[{"test_id": "G1", "expected_tier": "T", "query_part": {"item_type": "PIPE", "size_nb_mm": 50, "properties": {"trim": 1, "fire_safe": true}}},\n {"test_id": "G2"}]')
    rows = readers.golden_pairs(spark, str(tmp_path / "golden.json")).orderBy("test_id").collect()
    assert rows[0]["query_part"]["properties"] == {"trim": "1", "fire_safe": "true"} and len(rows) == 2
    spark.range(1).write.parquet(str(tmp_path / "bad"))
    with pytest.raises(readers.MissingColumnsError):
        readers.training_pairs(spark, str(tmp_path / "bad"))
    df = spark.createDataFrame([('a "b", c', "x\ny", None)], "t string, u string, v string")
    writers.write_csv(df, str(tmp_path / "csv"), byte_order_mark=True)
    text = max((f.read_text(encoding="utf-8-sig") for f in (tmp_path / "csv").glob("*.csv")), key=len)
    assert text.startswith('t,u,v\n"a ""b"", c","x\ny",')
    with pytest.raises(ValueError):
        writers.rewrite_catalog(df, "/x/y/", "/x/y")


def test_stable_ids(spark, tmp_path):
    names = ["CAN-000001", "CAN-ü", "x"]
    df = spark.createDataFrame([(n,) for n in names], "canonical_id string")
    got = [r[0] for r in df.select(writers.stable_id(F.col("canonical_id"))).collect()]
    assert got == [str(uuid.uuid5(uuid.NAMESPACE_URL, n)) for n in names]
    first = writers.publish_vectors(df, str(tmp_path / "v"), "published")
    second = writers.publish_vectors(df.limit(2), str(tmp_path / "v"), "published")
    assert first != second and spark.table("published").count() == 2


def test_canonical_rows(spark):
    raw = spark.createDataFrame(
        [("L1", " iocl ", "Panipat Refinery, HR", "FLG", "nan", "77", "400", "z"), ("L2", "ongc", None, "VLV", "50", None, None, None)],
        "`Part_No` string, Company string, depot_location string, raw_description string, NB_MM string, vendor string, idle_days string, hsn_code string",
    )
    a, b = catalog.canonical_rows(raw).orderBy("sku_code").collect()
    assert (a["sku_code"], a["cpse"], a["depot_id"], a["status"], a["is_broadcasted_surplus"]) == ("L1", "IOCL", "IOCL_PANIPAT_REFINERY", "SURPLUS_DECLARED", True)
    assert a["size_nb_mm"] is None and a["properties"] == {"vendor": "77"} and a["hsn_code"] == "z" and a["days_idle"] == 400
    assert (b["depot_id"], b["size_nb_mm"], b["status"], b["is_broadcasted_surplus"]) == ("ONGC_CENTRAL", 50.0, "TO_BE_CONSUMED", False)
    assert len(catalog.CANONICAL) == 27 and len(set(catalog.CANONICAL)) == 27
    with pytest.raises(catalog.ForeignTenantError):
        catalog.reject_foreign_tenants(raw.withColumnRenamed("Company", "cpse"), "IOCL")


def test_registry_and_entry(spark, sf_dir):
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 150
    rows = entry.entry(spark)
    assert rows.columns[0] == "request_id" and rows.limit(5).count() == 5


@pytest.mark.parametrize("name", ["a4_tenant_topology", "f8_visible_counts", "r11_valve_trim", "m7_records", "q3_final_states", "j11_mined_pairs", "w2_plain_search", "n8_conformance", "st5_current_edges"])
def test_queries_equal_their_sql(spark, sf_dir, name):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in V.TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    df = entry.queries()[name](spark, sf_dir)
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)

    def clean(v):
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    got = sorted([tuple(clean(r[n]) for n in names) for r in df.collect()], key=repr)
    assert got == sorted([tuple(clean(v) for v in r) for r in cursor.fetchall()], key=repr) and got


