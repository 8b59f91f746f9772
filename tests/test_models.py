import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from causalrisk.operators import explain as ex, models as md
from causalrisk.operators.anomaly import IsolationForest, evaluate_anomalies, mean_path
from causalrisk.operators.evaluate import ranking_metrics, score_curve
from causalrisk.operators.typology import choose_k, cluster_cases, describe_clusters
from causalrisk.plans import build_cases, build_features, calibrate_and_test, investigate, train_models
from causalrisk.spec import DatasetSpec, EntityKey

SPEC = DatasetSpec(
    "id", "t", "amount", "y", entity_keys=(EntityKey("card", ("card",)),), missing_flags=("gap",),
    frequency_columns=("card", "kind"),
)


@pytest.fixture(scope="module")
def facts(spark):
    rng = np.random.default_rng(11)
    rows = []
    for i in range(2400):
        gap = float(rng.normal()) if rng.random() < 0.7 else None
        kind = ["web", "app", "shop", None][int(rng.integers(4))] if i % 50 else f"odd{i}"
        z = -2 + 1.5 * (gap or 0) + (1.2 if kind == "web" else 0) + (0.8 if gap is None else 0)
        rows.append((i, 86400 + i * 1000, float(rng.lognormal(3, 1).__round__(2)), int(rng.random() < 1 / (1 + np.exp(-z))), int(rng.integers(40)), kind, gap))
    return spark.createDataFrame(rows, "id long, t long, amount double, y int, card int, kind string, gap double")


@pytest.fixture(scope="module")
def features(facts):
    return build_features(facts, SPEC)


@pytest.fixture(scope="module")
def models(features):
    return train_models(features, "y", maxIter=10, maxDepth=3, stepSize=0.2)


def quality(model, rows):
    scored = md.score_rows(model, rows, "p", ["id", "y"])
    return ranking_metrics(score_curve(scored, "y", "p"), "p").first()


def test_models_beat_the_base_rate_and_survive_unseen_levels(features, models):
    for name, model in models.items():
        m = quality(model, features.part("test"))
        assert m.pr_auc > 1.4 * m.base_rate and m.roc_auc > 0.7, name
    strange = features.part("test").withColumn("kind", F.lit("never seen")).withColumn("gap", F.lit(None).cast("double"))
    for model in models.values():
        assert md.score_rows(model, strange, "p", ["id"]).filter(F.col("p").isNull() | F.isnan("p")).count() == 0


def test_models_are_saved_and_loaded(models, features, tmp_path):
    for name, model in models.items():
        model.write().save(str(tmp_path / name))
        again = PipelineModel.load(str(tmp_path / name))
        rows = features.part("val")
        a = {r.id: r.p for r in md.score_rows(model, rows, "p", ["id"]).collect()}
        assert a == {r.id: r.p for r in md.score_rows(again, rows, "p", ["id"]).collect()}


def test_reasons_add_up_to_the_margin(features, models):
    names = {"baseline": md.baseline_terms(models["baseline"], features.numeric, features.categorical),
             "trees": [*features.numeric, *features.categorical]}
    means = ex.training_means(models["baseline"], features.part("train"))
    raw = [*features.numeric, *features.categorical]
    for name, explain in (("baseline", lambda *a: ex.explain_baseline(*a, means)), ("trees", ex.explain_trees)):
        rows = md.score_rows(models[name], features.part("val"), "p", list(dict.fromkeys(["id", *raw])))
        explained, base = explain(models[name], rows, names[name])
        for r in explained.limit(50).collect():
            for x in r.reasons:
                own = r[x.feature if x.feature in r else x.feature.partition("=")[0]]
                if own is None:
                    assert (x.value, x.shown) == (None, "not recorded")
                elif isinstance(own, (str, int)):
                    assert x.shown == str(own)
                else:
                    assert x.value == own
        for r in explained.select("p", "reasons").limit(200).collect():
            assert len(r.reasons) == len(names[name])
            margin = base + sum(x.contribution for x in r.reasons)
            assert abs(1 / (1 + np.exp(-margin)) - r.p) < 1e-9
    top = explained.select("id", ex.top_reasons(F.col("reasons"), 3).alias("reasons"))
    sizes = [abs(x.contribution) for x in top.first().reasons]
    assert len(sizes) == 3 and sizes == sorted(sizes, reverse=True)


def test_importance_and_audit(spark):
    def audit(values):
        df = spark.createDataFrame([([(f, 1.0, "1", c) for f, c in values],)], "reasons " + ex.REASON)
        return ex.leakage_audit(ex.global_importance(df)).first()

    assert audit([("a", -9.0), ("b", 1.0)]).suspects == "a"
    assert audit([("a", 1.0), ("b", 1.0), ("c", 1.0)]).verdict.startswith("healthy")
    assert audit([("a", 0.0)]).verdict == "no signal"


def test_history_ablation_uses_the_same_protocol(facts):
    plain = build_features(facts, SPEC, with_history=False)
    assert not [c for c in plain.numeric if c.startswith("card_") and c.endswith("_prior")]


def test_calibrated_test_report(features, models):
    calibrator, threshold, report = calibrate_and_test(features, models["baseline"], SPEC)
    r = report.first()
    assert calibrator.method in ("isotonic", "sigmoid") and 0 <= threshold <= 1
    assert r.tp + r.fp + r.fn + r.tn == features.part("test").count()


def test_request_rows_are_aligned(spark):
    raw = spark.createDataFrame([("12.5", "visa", 1), ("oops", "new", 2)], "amount string, card4 string, extra int")
    schema = {"card4": "string", "amount": "double", "dist1": "float"}
    out = md.align_to_schema(raw, schema, {"card4": ["visa"]})
    assert out.columns == list(schema)
    assert [tuple(r) for r in out.collect()] == [("visa", 12.5, None), (None, None, None)]
    filled = md.with_serving_defaults(spark.createDataFrame([(None,)], "t long"), "id", "t").first()
    assert (filled.t, filled.id) == (86400, 0)


def test_decisions(spark):
    df = spark.createDataFrame([(0.95,), (0.92,), (0.5,), (0.1,)], "p double")
    assert [r[0] for r in df.select(md.decision(F.col("p"), 0.3)).collect()] == ["DECLINE", "DECLINE", "REVIEW", "APPROVE"]
    assert [r[0] for r in df.select(md.decision(F.col("p"), 0.94)).collect()] == ["DECLINE", "APPROVE", "APPROVE", "APPROVE"]


def test_rare_draws_give_samples_of_the_wanted_size(spark):
    df = spark.range(200_000).select("id", (F.col("id") % 97).alias("a"))
    forest = IsolationForest.fit(df, ["a"], "id", trees=20, sample=256)
    used = [r.used for r in forest.nodes.select("tree", "used").distinct().collect()]
    assert len(used) == 20 and 180 < min(used) and max(used) < 340


@pytest.mark.parametrize("sample, nodes", [(256_000, 8_000_000), (256, 600)])
def test_isolation_forest_ranks_outliers_first(spark, monkeypatch, sample, nodes, tmp_path):
    from causalrisk.operators import anomaly

    monkeypatch.setattr(anomaly, "BROADCAST_NODES", nodes)
    rng = np.random.default_rng(4)
    rows = [(i, *map(float, rng.normal(size=2)), 0) for i in range(1500)] + [(2000 + i, 9.0 + i, -9.0, 1) for i in range(15)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y int").withColumn("c", F.lit(None).cast("double"))
    forest = IsolationForest.fit(df, ["a", "b", "c"], "id", trees=25, sample=sample)
    scored = forest.score(df)
    m = evaluate_anomalies(scored, "y", "anomaly").first()
    assert m.roc_auc > 0.99 and m.pr_auc > 0.8
    assert scored.filter("anomaly <= 0 or anomaly > 1").count() == 0
    again = IsolationForest.fit(df.repartition(7), ["a", "b", "c"], "id", trees=25, sample=sample).score(df)
    key = lambda d: sorted((r.id, round(r.anomaly, 12)) for r in d.collect())
    assert key(again) == key(scored)
    forest.save(str(tmp_path / "forest"))
    assert key(IsolationForest.load(spark, str(tmp_path / "forest"), ["a", "b", "c"]).score(df)) == key(scored)


def test_mean_path():
    assert (mean_path(1), mean_path(2)) == (0.0, 1.0) and 10.2 < mean_path(256) < 10.3


def test_typologies_separate_planted_groups(spark):
    rng = np.random.default_rng(6)
    rows = [(float(rng.normal(c * 10)), float(rng.normal(-c * 10)), 5.0, float(c + 1), c) for c in range(3) for _ in range(60)]
    df = spark.createDataFrame(rows, "a double, b double, flat double, amount double, truth int")
    made, _, _ = cluster_cases(df, ["a", "b", "flat"], k=3, restarts=3)
    assert made.groupBy("cluster").agg(F.countDistinct("truth").alias("n")).filter("n > 1").count() == 0
    told = describe_clusters(made, "cluster", ["a", "b", "flat"], "amount").collect()
    assert sorted(r.n_cases for r in told) == [60, 60, 60] and abs(sum(r.share for r in told) - 1) < 1e-9
    assert {"high a, low b", "low a, high b"} <= {", ".join(sorted(r.label.split(", "), key=lambda s: s[-1])) for r in told}
    assert all("flat" not in r.label for r in told)
    ks = choose_k(df, ["a", "b"], range(2, 5), restarts=2).collect()
    assert max(ks, key=lambda r: r.silhouette).k == 3
    assert [r.inertia for r in ks] == sorted((r.inertia for r in ks), reverse=True)


def test_case_files(spark):
    reasons = "array(struct('hour' as feature, 3D as value, '3' as shown, 0.5D as contribution), struct('dist1' as feature, 1D as value, '1' as shown, -0.1D as contribution))"
    rows = spark.range(30).select(
        "id", (F.col("id") / 30).alias("p"), (F.col("id") * 10.0).alias("amount"), (F.col("id") % 2).alias("y"), F.expr(reasons).alias("reasons"))
    docs = spark.createDataFrame([("review.md", "High risk transaction review requirements and evidence standards"), ("other.md", "Lunch menu")], "source string, text string")
    base = build_cases(rows, "id", "p", "amount", "y", "reasons", docs, n=20)
    files = {r.id: r for r in investigate(rows, base, ("amount",), "id", "p", "reasons", n=10).collect()}
    assert set(files) == set(range(20, 30))
    top = files[29]
    assert top.risk_band == "CRITICAL" and top.owner == "Fraud Operations" and all(top.found.asDict().values())
    assert top.drivers[0].factor == "the hour of day" and top.drivers[1].direction == "decreases risk"
    assert len(top.similar) == 3 and all(len(s.summary) <= 280 for s in top.similar)
    assert top.passages[0].source == "review.md" and top.similar_query == "fraud alert driven by the hour of day"
