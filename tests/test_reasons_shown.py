"""Reasons put into words only what is asked for, and shapes of contributions made in tasks."""

import numpy as np
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from causalrisk.operators import explain as ex, shapley as sh
from causalrisk.operators.trees import with_contributions


def test_only_the_asked_values_are_put_into_words(spark):
    rows = spark.createDataFrame([(1, 2.5, "a", Vectors.dense(2.5, 1.0, 0.0)), (2, 1.0, "b", Vectors.sparse(3, [0, 2], [1.0, 1.0]))], ["id", "x", "kind", "features"])
    names, weights, means = ["x", "kind=a", "kind=b"], [2.0, 1.0, -1.0], [1.0, 0.5, 0.5]
    every = rows.withColumn("reasons", ex.linear_reasons(rows, "features", names, weights, means))
    some = rows.withColumn("reasons", ex.linear_reasons(rows, "features", names, weights, means, show=("kind",)))
    a, b = ({r.id: r.reasons for r in d.orderBy("id").collect()} for d in (every, some))
    for i in a:
        assert [(r.feature, r.value, r.contribution) for r in a[i]] == [(r.feature, r.value, r.contribution) for r in b[i]]
        assert [r.shown for r in b[i]] == [None, *[r.shown for r in a[i]][1:]] and a[i][0].shown is not None


def test_a_value_is_told_once_per_row_and_repeated_rows_stay(spark):
    reasons = "array(struct('kind=a' as feature, CAST(NULL AS DOUBLE) as value, 'a' as shown, 1D as contribution), struct('kind=b' as feature, CAST(NULL AS DOUBLE) as value, 'a' as shown, 0D as contribution), struct('x' as feature, 1D as value, '1' as shown, 0D as contribution))"
    rows = spark.createDataFrame([(1,), (1,), (2,)], "id int").withColumn("reasons", F.expr(reasons))
    told = ex.shown_reasons(rows, "id", columns=("kind",))
    assert sorted(map(tuple, told.collect())) == [(1, "kind", "a"), (1, "kind", "a"), (2, "kind", "a")]
    assert "Exchange" not in told._jdf.queryExecution().executedPlan().toString()


def test_contributions_keep_the_other_columns(spark):
    rows = spark.createDataFrame([(i, None if i % 2 else f"t{i}", Vectors.dense(float(i), 1.0)) for i in range(7)], ["id", "text", "features"]).repartition(3)
    made = with_contributions(rows, lambda x: x * 2)
    assert made.columns == ["id", "text", "_c"]
    assert sorted((r.id, r.text, tuple(r._c)) for r in made.collect()) == [(i, None if i % 2 else f"t{i}", (2.0 * i, 2.0)) for i in range(7)]


def test_patterns_are_counted_alike_by_both_ways():
    pattern = np.random.default_rng(3).integers(0, 1 << 6, 500)
    assert sh.pattern_counts(pattern, 6) == sh.pattern_counts(pattern, sh.TABLE_FEATURES + 1)
    assert sh.pattern_counts(np.zeros(4, dtype=np.int64), 0) == [(0, 4)]
