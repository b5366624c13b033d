"""Rules over bags of few values run once for each combination of values."""

import pytest

from sparemesh.plans import all_queries, rule_queries


@pytest.fixture
def tables(spark, tmp_path):
    spark.createDataFrame([(i,) for i in range(40)], "p_partkey long").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(i, i % 40 if i % 9 else None) for i in range(300)], "o_orderkey long, o_custkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(i % 300, i * 7 % 211 if i % 13 else None) for i in range(900)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_rule_is_looked_up(spark, tables, monkeypatch):
    run = all_queries()["r21_seals"]
    found = run(spark, tables)
    rows = sorted(map(repr, found.collect()))
    assert "props" not in found._jdf.queryExecution().optimizedPlan().toString()
    monkeypatch.setattr(rule_queries, "MOST_COMBINATIONS", 0)
    assert rows == sorted(map(repr, run(spark, tables).collect())) and any("q=None" in r for r in rows)
    assert len({r.split("tier")[1] for r in rows}) > 3
