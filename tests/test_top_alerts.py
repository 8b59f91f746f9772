"""The highest alerts: which rows, and that other columns are not worked out for all rows."""

from pyspark.sql import functions as F

from causalrisk.operators.narrative import top_alerts


def test_other_columns_are_worked_out_for_few_rows(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def reasons(i):
        made.add(1)
        return str(i)

    rows = spark.range(1000).select("id", (F.col("id") % 500 / 500).alias("p")).withColumn("reasons", reasons("id"))
    found = [(r.id, r.p) for r in top_alerts(rows, "p", "id", 5).collect()]
    assert found == [(499, 0.998), (999, 0.998), (498, 0.996), (998, 0.996), (497, 0.994)]
    assert made.value <= 12


def test_missing_and_odd_scores_keep_their_place(spark):
    rows = spark.createDataFrame([(1, None), (2, 0.5), (3, float("nan")), (4, None), (5, 0.5)], "id long, p double")
    for n, want in ((0, []), (1, [3]), (2, [3, 2]), (3, [3, 2, 5]), (4, [3, 2, 5, 1]), (9, [3, 2, 5, 1, 4])):
        assert [r.id for r in top_alerts(rows, "p", "id", n).collect()] == want
