import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from causalrisk.operators.ordered import exact_quantiles, in_segments, running_totals, with_row_index
from causalrisk.operators.calibrate import halve_by_time, inversions, spread_sample


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 6), st.integers(0, 9)), min_size=1, max_size=60), st.booleans())
def test_running_totals(spark, rows, descending):
    df = spark.createDataFrame(rows, "g string, x long, v long")
    found = running_totals(df, "x", {"n": F.lit(1), "v": F.col("v")}, by=("g",), descending=descending).collect()
    assert len(found) == len({(g, x) for g, x, _ in rows})
    for r in found:
        inside = [v for g, x, v in rows if g == r.g and (x >= r.x if descending else x <= r.x)]
        assert (r.cum_n, r.cum_v) == (len(inside), sum(inside))
        assert r.tot_n == sum(g == r.g for g, _, _ in rows)


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_quantiles_match_linear_interpolation(spark, partitions):
    values = np.random.default_rng(5).choice([0.0, 1.0, 1.5, 7.25, 100.0, -3.0], 501).tolist() + [float(i) / 7 for i in range(400)]
    probs = [0.0, 0.001, 0.1, 0.25, 0.5, 0.77, 0.999, 1.0]
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
        found = {r.prob: r.value for r in exact_quantiles(df, "v", probs).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert np.allclose([found[p] for p in probs], np.quantile(values, probs), atol=1e-12)


def test_quantiles_of_one_value_and_of_none(spark):
    df = spark.createDataFrame([(4.0,)], "v double")
    assert {r.value for r in exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()} == {4.0}
    assert exact_quantiles(df.filter("v > 9"), "v", [0.5]).collect() == []


def test_segments_do_not_pull_equal_values_together(spark):
    """A value that every row shares is still spread when the order has a tie-break."""
    df = spark.range(4000).select(F.lit(1).alias("t"), "id")
    with_aqe = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in in_segments(df, [F.col("t"), F.col("id")]).groupBy("_segment").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", with_aqe)
    assert len(sizes) == 4 and max(sizes) < 2000


def test_row_index_and_halves(spark):
    df = spark.range(101).select("id", F.floor(F.col("id") / 10).alias("t")).repartition(5)
    indexed = with_row_index(df, [F.col("t"), F.col("id")]).collect()
    assert all(r.row_index == r.id and r.rows == 101 for r in indexed)
    half = {r.half: r["count"] for r in halve_by_time(df, "t", "id").groupBy("half").count().collect()}
    assert half == {"early": 50, "late": 51}


def test_spread_sample(spark):
    df = spark.range(120).select("id", (F.col("id") / 120).alias("p"))
    picked = sorted(r.row_index for r in spread_sample(df, "p", "id").collect())
    assert picked == [*range(8), 40, 50, 60, 70, 80, 90, *range(116, 120)]


def test_inversions(spark):
    def count(pairs):
        return inversions(spark.createDataFrame(pairs, "s double, c double"), "s", "c").first().inversions

    assert count([(0.1, 0.2), (0.2, 0.2), (0.3, 0.2), (0.4, 0.9)]) == 0
    assert count([(0.1, 0.2), (0.2, 0.1), (0.3, 0.5), (0.4, 0.4)]) == 2
    rng = np.random.default_rng(1)
    s, c = np.sort(rng.random(500)), rng.random(500)
    assert count([(float(a), float(b)) for a, b in zip(s, c)]) == int((np.diff(c) < -1e-12).sum())
