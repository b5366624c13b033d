"""Work that is heavy per row is dealt over all cores, however few tasks the file gives."""

import pytest

from sparemesh.plans import views as V


@pytest.mark.parametrize("view", ["catalog_text", "certificates", "table_certificates", "procurement_text"])
def test_texts_of_parts_are_dealt_over_all_cores(spark, sf_dir, view):
    made = getattr(V, view)(spark, sf_dir)
    assert V.table(spark, sf_dir, "part").rdd.getNumPartitions() == 1
    sizes = made.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(sizes) == V.table(spark, sf_dir, "part").count()
    assert sum(size > 0 for size in sizes) >= 2 * spark.sparkContext.defaultParallelism
    assert max(sizes) <= sum(sizes) / 4


def test_streamed_batches_are_several_files(spark, sf_dir):
    from sparemesh.plans.stream_queries import as_stream, collected

    rows = V.table(spark, sf_dir, "events").select("event_id")
    cores = spark.sparkContext.defaultParallelism
    for batches in (1, 4):
        tagged = as_stream(spark, rows, "spread", batches=batches).selectExpr("event_id", "input_file_name() AS file", "spark_partition_id() AS task")
        found = collected(spark, tagged, "spread", "event_id long, file string, task int").toPandas()
        assert sorted(found["event_id"]) == sorted(r[0] for r in rows.collect())
        assert found["file"].nunique() >= 2 * batches * cores and found["task"].nunique() > 1


def test_chain_in_blocks_is_one_chain(spark):
    from pyspark.sql import functions as F

    from sparemesh.operators import ledger

    rows = spark.range(1000).select(
        F.col("id").alias("log_id"), F.timestamp_seconds(F.floor((1000 - F.col("id")) / 7)).alias("timestamp"), F.lit("a").alias("actor_name"),
        F.lit("b").alias("action_name"), F.col("id").cast("string").alias("reference_id"), F.lit("{}").alias("details"),
    )
    whole = sorted(map(tuple, ledger.append_batch(rows).collect()))
    cut = ledger.append_batch(rows, block_rows=150)
    assert sorted(map(tuple, cut.collect())) == whole
    assert cut.rdd.getNumPartitions() > 1 and len(cut.inputFiles()) == 7
    assert ledger.verify_chain(cut).first()["is_valid"]


def test_first_places_keep_the_order_of_equal_scores():
    import numpy as np

    from sparemesh.operators.vectors import first_places

    scores = np.random.default_rng(3).integers(0, 9, (50, 400)).astype(float)
    scores[7] = 1.0
    for keep in (1, 25, 399, 400):
        assert (first_places(scores, keep) == np.argsort(-scores, axis=1, kind="stable")[:, :keep]).all()


def test_requests_are_dealt_before_they_are_parsed(spark, sf_dir):
    sizes = V.requests(spark, sf_dir).rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()
    assert sum(size > 0 for size in sizes) >= 2 * spark.sparkContext.defaultParallelism


def test_expected_tiers_count_equal_pairs(spark):
    from sparemesh.operators.rules.verdict import expected_versus_actual

    rows = spark.createDataFrame([("A", "X", ["v"], 3), ("A", "X", [], 4), ("B", "X", [], 5)], "expected_tier string, compatibility_tier string, rule_violations array<string>, times long")
    weighed = sorted(map(tuple, expected_versus_actual(rows, times="times").collect()))
    assert weighed == [("A", "X", 7, 3), ("B", "X", 5, 0)]
    assert sorted(map(tuple, expected_versus_actual(rows).collect())) == [("A", "X", 2, 1), ("B", "X", 1, 0)]


def test_pairs_are_checked_without_patterns_and_folds(spark, sf_dir):
    from sparemesh.functions import safety
    from sparemesh.plans import all_queries, match_queries as M

    def above_joins(df):
        lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return "\n".join(lines[: next(i for i, line in enumerate(lines) if "Join Inner" in line)])

    # what stands above the joins runs for each pair: no regular expression, and no lambda, which is interpreted with all it is given
    for name in ("r39_classified_pairs", "r40_search_tier", "r38_allowed_substitutes", "p8_ranking_features", "p10_ranking_score"):
        step = above_joins(all_queries()[name](spark, sf_dir))
        assert not [word for word in ("regexp", "RLIKE", "lambda", "aggregate(", "filter(") if word in step], name
    pairs = M.pair_sides(spark, sf_dir, prepared=False)
    q, c = safety.pair_sides(pairs.columns)
    assert "regexp" not in above_joins(pairs.select(safety.safety_violations(q, c)))

    # the pairs are dealt by the key they are joined on next: one exchange for distinct rows and join
    plan = M.asked_pairs(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(c#") == 1 and plan.count("hashpartitioning(q#") == 0
