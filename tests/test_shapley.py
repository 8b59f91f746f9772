from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalrisk.functions.rowwise import add_row_features
from causalrisk.operators import models as md, shapley as sh
from causalrisk.spec import DatasetSpec
from causalrisk.streaming import Scorer

FEATURES = 8


def random_tree(draw, depth):
    """A tree over 8 features with thresholds and level sets; features may repeat on a path."""
    nodes = []

    def grow(level):
        at = len(nodes)
        nodes.append(None)
        if level == 0 or draw.random() < 0.1:
            nodes[at] = (draw.normal(), -1, -1, -1, np.nan, None)
            return at
        f = int(draw.integers(FEATURES))
        left, right = grow(level - 1), grow(level - 1)
        members = draw.choice(5, 2, replace=False).astype(float) if f >= 6 else None
        nodes[at] = (0.0, left, right, f, float(draw.normal()), members)
        return at

    grow(depth)
    value, left, right, feature, number, sets = zip(*nodes, strict=True)
    return {"value": np.array(value), "left": np.array(left), "right": np.array(right), "feature": np.array(feature), "number": np.array(number),
            "sets": {i: s for i, s in enumerate(sets) if s is not None}}


def score(trees, row):
    total = 0.0
    for t in trees:
        at = 0
        while t["left"][at] >= 0:
            seen = row[t["feature"][at]]
            goes = seen in t["sets"][at] if at in t["sets"] else seen <= t["number"][at]
            at = t["left"][at] if goes else t["right"][at]
        total += t["value"][at]
    return total


def enumerated(trees, row, background):
    """Shapley values by all subsets of features."""
    def worth(subset):
        mixed = background.copy()
        mixed[:, list(subset)] = row[list(subset)]
        return np.mean([score(trees, m) for m in mixed])

    worths = {s: worth(s) for n in range(FEATURES + 1) for s in combinations(range(FEATURES), n)}
    out = np.zeros(FEATURES)
    for f in range(FEATURES):
        for s, v in worths.items():
            if f not in s:
                out[f] += factorial(len(s)) * factorial(FEATURES - 1 - len(s)) / factorial(FEATURES) * (worths[tuple(sorted((*s, f)))] - v)
    return out, worths[()]


@pytest.mark.parametrize("table_features", [8, 2])
def test_contributions_equal_all_subsets(monkeypatch, table_features):
    monkeypatch.setattr(sh, "TABLE_FEATURES", table_features)
    draw = np.random.default_rng(5)
    trees = [random_tree(draw, d) for d in (0, 2, 4, 7)]
    rows = np.column_stack([draw.normal(size=(9, 6)), draw.integers(0, 5, (9, 2))])
    background = rows[:4]
    counts = {at: (p, n / len(background)) for at, (p, n) in
              enumerate(np.unique(pattern, return_counts=True) for _, pattern in sh.leaf_patterns(trees, background))}
    explainer = sh.Explainer(trees, counts, len(background))
    got = explainer.contributions(rows)
    for row, own in zip(rows[3:6], got[3:6], strict=True):
        want, base = enumerated(trees, row, background)
        assert np.allclose(own, want, atol=1e-12) and abs(explainer.base() - base) < 1e-12
        assert abs(explainer.base() + own.sum() - score(trees, row)) < 1e-12


def test_fitted_trees_are_explained_against_all_training_rows(spark, tmp_path):
    rows = [(i, float(i % 37), "ab c"[i % 4] if i % 9 else None, None if i % 5 == 0 else float(i % 11), int((i % 37 > 20) ^ (i % 4 == 1))) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, a double, level string, b double, y int").repartition(5)
    model = md.fit_boosted_trees(df, ["a", "b"], ["level"], "y", maxIter=6, maxDepth=4)
    names = ["a", "b", "level"]
    shapley = sh.TreeShapley.fit(model, df)
    scored = md.score_rows(model, df, "p")
    shapley.save(str(tmp_path / "counts"))
    for made in (shapley, sh.TreeShapley.load(spark, str(tmp_path / "counts"), model)):
        told = made.explain(scored, names).select("p", "a", "reasons").collect()
        margins = [made.base + sum(x.contribution for x in r.reasons) for r in told]
        assert len(told) == 900 and all(abs(1 / (1 + np.exp(-m)) - r.p) < 1e-9 for m, r in zip(margins, told, strict=True))
        assert abs(np.mean(margins) - made.base) < 1e-9
        assert all([x.feature for x in r.reasons] == names and r.reasons[0].value == r.a for r in told)
    with pytest.raises(ValueError, match="no rows"):
        sh.TreeShapley.fit(model, df.where(F.col("id") < 0))


def test_a_scorer_explains_by_shapley_values_and_keeps_them(spark, tmp_path):
    spec = DatasetSpec("id", "t", "amount", "y")
    df = spark.createDataFrame([(i, i * 60, float(i % 41), i % 3, int(i % 41 > 30)) for i in range(400)], "id long, t long, amount double, b int, y int")
    train = add_row_features(df, spec)
    names = ["amount", "hour", "b"]
    model = md.fit_boosted_trees(train, names, [], "y", maxIter=5, maxDepth=3)
    scorer = Scorer(spec, md.training_schema(train, names), model, 0.5, term_names=names, shapley=sh.TreeShapley.fit(model, train))
    told = sorted(map(tuple, scorer.explain(df).collect()))
    assert len(told) == 400
    scorer.save(str(tmp_path / "scorer"))
    assert sorted(map(tuple, Scorer.load(spark, str(tmp_path / "scorer")).explain(df).collect())) == told
