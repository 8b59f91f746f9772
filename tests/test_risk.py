import numpy as np
import pytest
from pyspark.sql import functions as F

from causalrisk.operators import calibrate as cal, evaluate as ev


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(0)
    y = (rng.random(4000) < 0.035).astype(int)
    score = np.clip(rng.beta(2, 6, 4000) + y * rng.uniform(0.15, 0.5, 4000), 0, 1).round(6)
    amount = rng.lognormal(4.2, 1.1, 4000).round(2)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(y, score, amount)]
    return spark.createDataFrame(rows, "y int, p double, amount double").cache()


def arrays(df):
    pdf = df.toPandas()
    return pdf.y.to_numpy(), pdf.p.to_numpy(), pdf.amount.to_numpy()


def test_ranking_metrics_by_definition(scored):
    y, p, _ = arrays(scored)
    m = ev.ranking_metrics(ev.score_curve(scored, "y", "p"), "p").first()
    cuts = np.unique(p)[::-1]
    recall = [0.0] + [((p >= c) & (y == 1)).sum() / y.sum() for c in cuts]
    precision = [((p >= c) & (y == 1)).sum() / (p >= c).sum() for c in cuts]
    assert abs(m.pr_auc - sum((b - a) * q for a, b, q in zip(recall, recall[1:], precision))) < 1e-12
    pos, neg = p[y == 1][:, None], p[y == 0][None, :]
    assert abs(m.roc_auc - ((pos > neg).mean() + (pos == neg).mean() / 2)) < 1e-12
    assert abs(m.brier - ((p - y) ** 2).mean()) < 1e-12
    assert (m.n, m.n_positive) == (4000, y.sum())
    assert m.pr_auc > m.base_rate and abs(m.pr_auc_lift - m.pr_auc / m.base_rate) < 1e-12


def test_confusion_and_cost_at_thresholds(scored):
    y, p, a = arrays(scored)
    cuts = [0.0, 0.3, float(p[7]), 1.5]
    for r in ev.expected_cost(ev.confusion_rates(ev.at_thresholds(scored, "y", "p", cuts, "amount"))).collect():
        f = p >= r.threshold
        assert (r.tp, r.fp, r.fn, r.tn) == ((f & (y == 1)).sum(), (f & (y == 0)).sum(), (~f & (y == 1)).sum(), (~f & (y == 0)).sum())
        caught, missed = a[f & (y == 1)].sum(), a[~f & (y == 1)].sum()
        assert abs(r.net_cost - (missed + caught * 0.1 + 15 * r.fp)) < 1e-6 and r.net_cost >= 0
    nothing = ev.expected_cost(ev.at_thresholds(scored, "y", "p", [1.5], "amount")).first()
    assert abs(nothing.net_cost - a[y == 1].sum()) < 1e-6 and nothing.fp == 0


def test_dearer_alarms_flag_less(scored):
    cheap = ev.best_threshold(ev.cost_sweep(scored, "y", "p", "amount", fp_cost=1.0)).first().threshold
    dear = ev.best_threshold(ev.cost_sweep(scored, "y", "p", "amount", fp_cost=200.0)).first().threshold
    assert cheap <= dear


def test_best_threshold_is_the_cheapest_of_the_grid(scored):
    y, p, a = arrays(scored)
    grid = np.unique(np.quantile(p, np.linspace(0.5, 0.9995, 200)))
    costs = [round(a[(p < t) & (y == 1)].sum() + 0.1 * a[(p >= t) & (y == 1)].sum() + 15 * ((p >= t) & (y == 0)).sum(), 2) for t in grid]
    assert ev.best_threshold(ev.cost_sweep(scored, "y", "p", "amount")).first().threshold == round(float(grid[int(np.argmin(costs))]), 6)


def test_budget_and_precision_thresholds(scored):
    y, p, _ = arrays(scored)
    for r in ev.budget_thresholds(scored, "p").collect():
        assert abs(r.threshold - np.quantile(p, 1 - r.goal)) < 1e-12
        assert abs((p >= r.threshold).mean() - r.goal) < 0.002
    curve = ev.score_curve(scored, "y", "p")
    for r in ev.precision_thresholds(curve, "p", (0.1, 0.5, 2.0)).collect():
        fits = [c for c in np.unique(p) if y[p >= c].mean() >= r.goal]
        assert r.threshold == (min(fits) if fits else p.max())


def test_full_evaluation_is_consistent(scored):
    rows = {(r.section, r.metric): r.value for r in ev.full_evaluation(scored, "y", "p", "amount").collect()}
    assert rows["value added", "pct_avoided"] <= 100
    assert abs(rows["value added", "net_saving"] - (rows["value added", "do_nothing"] - rows["cost optimal", "net_cost"])) < 1e-6
    assert rows["precision 50%", "precision"] >= 0.5
    assert {s for s, _ in rows} == {"ranking", "value added", "cost optimal", "precision 50%", "precision 70%", "precision 90%",
                                    "budget 0.5%", "budget 1.0%", "budget 2.0%", "budget 5.0%"}


@pytest.fixture(scope="module")
def overconfident(spark):
    rng = np.random.default_rng(3)
    latent = rng.beta(1, 12, 8000)
    y = (rng.random(8000) < latent).astype(int)
    rows = [(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, latent**0.45))]
    return spark.createDataFrame(rows, "id long, y int, s double").cache()


def test_calibration_helps_and_keeps_the_order(overconfident):
    early, late = overconfident.filter("id < 4000"), overconfident.filter("id >= 4000")
    chosen, table = cal.fit_and_compare(early, late, "y", "s")
    for method in ("isotonic", "sigmoid"):
        assert table[method]["inversions"] == 0
        assert table[method]["brier"] < table["raw"]["brier"]
        assert table[method]["ece"] < table["raw"]["ece"]
    assert table["isotonic"]["distinct_values"] < table["sigmoid"]["distinct_values"]
    gain = 1 - table["isotonic"]["brier"] / table["sigmoid"]["brier"]
    assert chosen.method == ("isotonic" if gain > 0.1 else "sigmoid")
    assert cal.fit_and_compare(early, late, "y", "s", margin=-1.0)[0].method == "isotonic"


def test_calibrated_values_stay_in_range_and_bad_method_fails(spark, overconfident):
    outside = spark.createDataFrame([(-5.0,), (9.0,)], "s double")
    for method in ("isotonic", "sigmoid"):
        made = cal.Calibrator.fit(overconfident, "y", "s", method).transform(outside, "s", "p").collect()
        assert all(0 <= r.p <= 1 for r in made)
    with pytest.raises(ValueError, match="unknown method"):
        cal.Calibrator.fit(overconfident, "y", "s", "beta")


def test_reliability_bins(spark, overconfident):
    pdf = overconfident.toPandas()
    edges = np.unique(np.quantile(pdf.s, np.linspace(0, 1, 11)))
    bins = np.digitize(pdf.s, edges[1:-1], right=True)
    found = {r.bin: r for r in cal.reliability_table(overconfident, "y", "s").collect()}
    assert sum(r.n for r in found.values()) == 8000
    for b in np.unique(bins):
        assert found[b].n == (bins == b).sum()
        assert abs(found[b].gap - (pdf.s[bins == b].mean() - pdf.y[bins == b].mean())) < 1e-9
    flat = spark.createDataFrame([(1, 0.5), (0, 0.5)], "y int, s double")
    assert cal.reliability_table(flat, "y", "s").count() == 0
    assert cal.calibration_error(flat, "y", "s").first().ece == 0.0


def test_rows_without_a_score_are_not_flagged(spark):
    df = spark.createDataFrame([(1, 0.9), (1, None), (0, float("nan")), (0, 0.1)], "y int, p double")
    r = ev.at_thresholds(df, "y", "p", [0.5]).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (1, 0, 1, 2)
