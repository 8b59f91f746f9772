import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalrisk.operators import drift, profile, stats


@pytest.fixture(scope="module")
def df(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(3000):
        y = int(rng.random() < 0.1)
        rows.append((i, i * 600, y, ["a", "b", None][int(rng.integers(3))], f"r{rng.integers(200)}",
                     round(float(rng.normal(y, 1)), 1), float(rng.lognormal(3, 1)) if rng.random() < 0.7 else None))
    return spark.createDataFrame(rows, "id long, t long, y int, kind string, rare string, x double, gap double").cache()


def test_missingness(df):
    rows = {r["column"]: r for r in profile.missingness_report(df).collect()}
    pdf = df.toPandas()
    for c in pdf.columns:
        assert rows[c].n_missing == pdf[c].isna().sum() and rows[c].n_unique == pdf[c].nunique()
    empty = profile.missingness_report(df.limit(0)).collect()
    assert all(r.pct_missing == 0 for r in empty)


def test_blocks_need_the_same_rows_not_the_same_count(spark):
    df = spark.createDataFrame([(1, None, None, 1), (2, 1, 1, None)], "id int, a int, b int, c int")
    found = {r["columns"]: r.n_columns for r in profile.missingness_blocks(df, ["a", "b", "c", "zzz"], "id").collect()}
    assert found == {"a, b": 2, "c": 1}


def test_category_floor_lift_and_null_baseline(df):
    pdf = df.toPandas()
    for r in profile.category_rates(df, ["kind", "rare"], "y", min_count=20, top=5).collect():
        here = pdf[pdf[r["column"]] == r.value]
        assert r.n == len(here) >= 20 and r.position <= 5
        assert abs(r.lift - here.y.mean() / pdf.y.mean()) < 1e-9


def test_top_levels_are_limited_before_the_shuffle(df):
    plan = profile.category_rates(df, ["kind", "rare"], "y")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_missing_signal_skips_full_and_empty_columns(df):
    full = df.withColumn("none", F.lit(None).cast("int"))
    found = [r["column"] for r in profile.missing_as_signal(full, ["none", "id", "gap", "kind"], "y").collect()]
    assert sorted(found) == ["gap", "kind"]


def test_numeric_summary(df):
    pdf = df.toPandas()
    for r in profile.numeric_summary(df, ["x", "gap"], "y").collect():
        v = pdf.loc[pdf.y == r.y, r["column"]]
        assert (r.n, r.missing) == (len(v), v.isna().sum())
        for got, want in ((r.mean, v.mean()), (r.median, v.median()), (r.p25, v.quantile(0.25)), (r.p99, v.quantile(0.99)), (r.max, v.max())):
            assert math.isclose(got, want, rel_tol=1e-9)


def test_chi_square_p_values_are_known():
    for statistic, dof, p in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (18.307038, 10, 0.05), (0.0, 3, 1.0), (2.0, 2, math.exp(-1))):
        assert abs(stats.chi_square_p(statistic, dof) - p) < 1e-6
    assert stats.chi_square_p(2000.0, 3) < 1e-300 or stats.chi_square_p(2000.0, 3) >= 0


def test_chi_square_pools_rare_levels_and_needs_two(spark, df):
    row = {r["column"]: r for r in stats.chi_square(df, ["kind", "rare"], "y", min_count=50).collect()}
    pdf = df.toPandas()
    level = pdf.kind.fillna("__missing__")
    table = np.array([[((level == l) & (pdf.y == c)).sum() for c in (0, 1)] for l in sorted(level.unique())], dtype=float)
    expected = table.sum(1, keepdims=True) * table.sum(0) / table.sum()
    chi = ((table - expected) ** 2 / expected).sum()
    assert math.isclose(row["kind"].statistic, chi) and row["kind"].dof == 2
    assert math.isclose(row["kind"].effect_size, math.sqrt(chi / 3000))
    assert "rare" not in row  # every level is pooled into one


def test_rank_test_matches_pair_counting(df):
    pdf = df.toPandas()
    r = stats.rank_test(df, ["x"], "y").first()
    a, b = pdf.x[pdf.y == 1].to_numpy()[:, None], pdf.x[pdf.y == 0].to_numpy()[None, :]
    u = (a > b).sum() + (a == b).sum() / 2
    assert math.isclose(r.statistic, u) and math.isclose(r.effect_size, 2 * u / a.size / b.size - 1)
    n1, n0 = a.size, b.size
    ties = sum(int(c) ** 3 - int(c) for c in pdf.x.value_counts())
    sd = math.sqrt(n1 * n0 / 12 * ((n1 + n0 + 1) - ties / ((n1 + n0) * (n1 + n0 - 1))))
    assert math.isclose(r.z, (abs(u - n1 * n0 / 2) - 0.5) / sd)
    assert stats.rank_test(df.limit(30), ["x"], "y").count() == 0


def test_battery_is_ranked_by_effect(df):
    rows = stats.test_battery(df, "y", ["kind", "absent"], ["x", "gap"]).collect()
    sizes = [abs(r.effect_size) for r in rows]
    assert sizes == sorted(sizes, reverse=True) and rows[0].feature == "x"
    assert rows[0].interpretation == "large difference"


def test_psi(df):
    ref, cur = F.col("id") < 1500, F.col("id") >= 1500
    moved = df.withColumn("x", F.col("x") + F.when(cur, 2.0).otherwise(0.0)).withColumn("flat", F.lit(1.0))
    rows = {r["column"]: r for r in drift.psi_table(moved, ["x", "gap", "flat"], ref, cur).collect()}
    pdf = moved.toPandas()
    for c in ("x", "gap"):
        e, a = pdf.loc[pdf.id < 1500, c].dropna(), pdf.loc[pdf.id >= 1500, c].dropna()
        edges = np.unique(np.quantile(e, np.linspace(0, 1, 11)))
        edges[0], edges[-1] = -np.inf, np.inf
        pe, pa = (np.clip(np.histogram(v, bins=edges)[0] / len(v), 1e-6, None) for v in (e, a))
        assert math.isclose(rows[c].psi, ((pa - pe) * np.log(pa / pe)).sum(), rel_tol=1e-9)
    assert rows["x"].verdict == "MAJOR SHIFT" and rows["flat"].psi == 0.0
    same = drift.psi_table(df, ["x"], F.lit(True), F.lit(True)).first()
    assert same.psi == 0 and same.verdict == "stable"


def test_rates_over_time(df):
    rows = sorted(profile.rate_over_time(df.withColumn("t", F.col("t") + 12345), "t", "y", 7).collect())
    assert [r.day for r in rows] == [0, 7, 14] and sum(r.n for r in rows) == 3000
    assert sum(r.n for r in profile.hour_profile(df, "t", "y").collect()) == 3000
    b = profile.class_balance(df, "y").first()
    assert math.isclose(b.imbalance_weight, b.negatives / b.positives)
