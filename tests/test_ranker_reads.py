"""Ranker training computes its rows once, however many passes the training takes."""

from sparemesh.operators.training import train_ranker


def test_ranker_reads_its_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.range(400).selectExpr("id AS row_id", "CAST(id % 2 AS int) AS label", "array(CAST(id % 2 AS double), CAST(id AS double)) AS features")
    _, auc = train_ranker(rows.mapInArrow(run, rows.schema), trees=2, depth=2)
    assert auc.first().auc == 1.0
    # the split reads them for its counts and for its places
    assert seen.value <= 2 * 400
