import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from causalrisk.operators import boosting as bo, models as md, stages as st
from causalrisk.operators.evaluate import ranking_metrics, score_curve
from causalrisk.operators.trees import compact_trees, tree_nodes


def average_precision(y, score):
    total, out, seen, hits = y.sum(), 0.0, 0, 0
    for s in np.unique(score)[::-1]:
        here = score == s
        seen, hits = seen + here.sum(), hits + y[here].sum()
        out += y[here].sum() / total * hits / seen
    return out


def rows(spark, n=1500, seed=3):
    draw = np.random.default_rng(seed)
    data = []
    for i in range(n):
        a, level = float(draw.normal()), ["x", "y", "z", None][int(draw.integers(4))]
        data.append((i, a if i % 7 else None, level, int(draw.random() < 1 / (1 + np.exp(2 - a - (level == "x"))))))
    return spark.createDataFrame(data, "id long, a double, level string, y int").repartition(4)


def test_the_stage_equals_a_plain_loop_over_all_prefixes(spark):
    train, held_out = rows(spark), rows(spark, 700, seed=4)
    full = md.fit_boosted_trees(train, ["a"], ["level"], "y", maxIter=30, maxDepth=4, stepSize=0.4)
    cut = md.fit_boosted_trees(train, ["a"], ["level"], "y", held_out, patience=6, maxIter=30, maxDepth=4, stepSize=0.4)
    n = len(cut.stages[-1].trees)
    trees = compact_trees(tree_nodes(full, spark), list(full.stages[-1].treeWeights))
    made = full.transform(held_out)
    pdf = made.select("id", "y", "features").toPandas().sort_values("id")
    margins = bo.staged_margins(trees, np.stack([v.toArray() for v in pdf.features]))
    plain = [average_precision(pdf.y.to_numpy(), margins[:, s]) for s in range(30)]
    by_stage = {r.stage: r.pr_auc for r in bo.precision_by_stage(bo.staged_scores(trees, made, "y", 1, 30), "y").collect()}
    assert all(abs(by_stage[s + 1] - p) < 1e-12 for s, p in enumerate(plain))
    want, best = 1, -1.0
    for s, p in enumerate(plain, 1):
        if p > best:
            best, want = p, s
        elif s - want >= 6:
            break
    assert n == want == bo.stopping_stage(trees, made, "y", 6)[0] < 30
    p = np.array([r.p for r in md.score_rows(cut, held_out, "p", ["id"]).orderBy("id").collect()])
    assert np.allclose(p, 1 / (1 + np.exp(-margins[:, n - 1])), atol=1e-9)


def test_patience():
    assert bo.best_stage([0.1, 0.3, 0.2, 0.3, 0.1], 3) == (2, True)
    assert bo.best_stage([0.1, 0.3, 0.2], 3) == (2, False)
    assert bo.best_stage([None, None], 1) == (1, True) and bo.best_stage([], 5) == (1, False)


def test_a_cut_model_is_saved_and_loaded(spark, tmp_path):
    train = rows(spark, 600)
    model = md.fit_boosted_trees(train, ["a"], ["level"], "y", rows(spark, 300, seed=9), patience=2, maxIter=8, maxDepth=3)
    model.write().save(str(tmp_path / "model"))
    key = lambda m: sorted((r.id, r.p) for r in md.score_rows(m, train.withColumn("level", F.when(F.col("id") % 2 == 0, "new").otherwise(F.col("level"))), "p", ["id"]).collect())
    assert key(PipelineModel.load(str(tmp_path / "model"))) == key(model)


def test_rates_are_out_of_fold_and_defined_for_missing_and_unseen(spark):
    df = rows(spark, 900)
    maker = st.TargetStatistics(inputCols=["level"], outputCols=["rate"], labelCol="y", smoothing=5.0, folds=3)
    model, out = maker.fit_out_of_fold(df)
    folds = {r.id: (r.level, r.y, r["_fold"]) for r in maker._in_folds(df).collect()}
    for r in out.collect():
        level, _, fold = folds[r.id]
        others = [y for lv, y, f in folds.values() if f != fold]
        same = [y for lv, y, f in folds.values() if f != fold and lv == level]
        assert abs(r.rate - (sum(same) + 5 * np.mean(others)) / (len(same) + 5)) < 1e-12
    mean = np.mean([y for _, y, _ in folds.values()])
    asked = spark.createDataFrame([("x",), (None,), ("new",)], "level string")
    for row in model.transform(asked).collect():
        same = [y for lv, y, _ in folds.values() if lv == row.level]
        assert abs(row.rate - ((sum(same) + 5 * mean) / (len(same) + 5))) < 1e-12


def test_a_hundred_thousand_levels_without_leakage(spark, monkeypatch):
    monkeypatch.setattr(st, "BROADCAST_LEVELS", 1000)
    # four rows a level; the level tells the label in one column, nothing in the other
    df = spark.range(400_000).select(
        "id", F.concat(F.lit("told"), F.col("id") % 100_000).alias("told"), F.concat(F.lit("mute"), F.pmod(F.xxhash64("id"), F.lit(100_000))).alias("mute"),
        ((F.pmod(F.xxhash64(F.col("id") % 100_000, F.lit(5)), F.lit(10)) < 3)).cast("int").alias("y"),
    )
    train, test = df.where("id < 300000"), df.where("id >= 300000")
    told = md.fit_boosted_trees(train, [], ["told"], "y", maxIter=3, maxDepth=2)
    mute = md.fit_boosted_trees(train, [], ["mute"], "y", maxIter=3, maxDepth=2)
    quality = {name: ranking_metrics(score_curve(md.score_rows(m, test, "p", ["id", "y"]), "y", "p"), "p").first() for name, m in (("told", told), ("mute", mute))}
    assert quality["told"].pr_auc > 0.9
    assert abs(quality["mute"].pr_auc - quality["mute"].base_rate) < 0.02
    _, seen = st.TargetStatistics(inputCols=["mute"], outputCols=["rate"], labelCol="y").fit_out_of_fold(train)
    inside = ranking_metrics(score_curve(seen.select("y", "rate"), "y", "rate"), "rate").first()
    assert abs(inside.roc_auc - 0.5) < 0.02


def test_maps_stand_in_a_pipeline(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 1), ("a", 2, 0), ("b", None, 1), (None, 2, 0)], "k string, n int, y int")
    pipeline = Pipeline(stages=[
        st.FrequencyMap(inputCols=["k", "n"], outputCols=["k_freq", "n_freq"]), st.TargetStatistics(inputCols=["k"], outputCols=["k_rate"], labelCol="y", smoothing=1.0),
    ])
    pipeline.write().save(str(tmp_path / "pipeline"))
    model = Pipeline.load(str(tmp_path / "pipeline")).fit(df)
    model.write().save(str(tmp_path / "model"))
    asked = spark.createDataFrame([("a", 2), ("c", 9), (None, None)], "k string, n int")
    for m in (model, PipelineModel.load(str(tmp_path / "model"))):
        got = {r.k: (round(r.k_freq, 6), round(r.n_freq, 6), round(r.k_rate, 6)) for r in m.transform(asked).collect()}
        assert got == {"a": (round(2 / 3, 6), round(2 / 3, 6), 0.5), "c": (0.0, 0.0, 0.5), None: (0.0, 0.0, 0.25)}
    assert model.transform(asked.select("k")).where("n_freq != 0").isEmpty()
