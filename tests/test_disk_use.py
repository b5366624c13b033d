"""Jobs that keep little on disk: compressed catalog copies, backfill without shuffled payloads."""

from sparemesh.sources import readers, writers
from sparemesh.streaming import changes


def test_compressed_catalog(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x, "y"\nz'), ("b", None)], "sku_code string, description string")
    writers.rewrite_catalog(df, str(tmp_path / "to"), str(tmp_path / "from"), compression="gzip")
    assert list((tmp_path / "to").glob("*.csv.gz")) and not list((tmp_path / "to").glob("*.csv"))
    assert sorted(map(tuple, readers.catalog_csv(spark, str(tmp_path / "to")).select("sku_code", "description").collect())) == [("a", 'x, "y"\nz'), ("b", None)]


def test_backfill_chooses_among_repeated_keys_only(spark, tmp_path):
    root = str(tmp_path / "root")
    items = spark.createDataFrame([("a", 1, "x"), ("b", 2, "x"), ("b", 2, "x"), ("", 3, "x"), (None, 4, "x"), ("c", None, None)], "sku_code string, quantity int, cpse string")
    assert changes.backfill(items, root) and not changes.backfill(items, root)
    stored = changes.stored_changes(spark, root)
    assert sorted(r[0] for r in stored.select("record_key").collect()) == ["a", "b", "c"]
    assert sorted(map(tuple, changes.stored_changes(spark, root, "counts").collect())) == [("PROCESSED", 4)]
    assert changes.stored_changes(spark, root, "failed").count() == 0
    few = changes.current_records(spark, root, columns=["sku_code", "quantity"])
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, changes.current_records(spark, root).select("sku_code", "quantity").collect())) == [("a", 1), ("b", 2), ("c", None)]
    assert "depot_location" not in few._jdf.queryExecution().analyzed().toString()
