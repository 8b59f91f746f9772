"""Early stopping of boosted trees by average precision: all prefixes of the ensemble scored in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkContext
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from causalrisk.operators.evaluate import ranking_metrics, score_curve

PATIENCE = 50


def staged_margins(trees: list[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Per row the margin after each tree."""
    out = np.empty((len(x), len(trees)))
    for i, t in enumerate(trees):
        node = np.zeros(len(x), dtype=int)
        active = np.flatnonzero(t["left"][node] >= 0)
        while len(active):
            at = node[active]
            seen = x[active, t["feature"][at]]
            left = seen <= t["number"][at]
            for n, members in t["sets"].items():
                here = at == n
                left[here] = np.isin(seen[here], members)
            node[active] = np.where(left, t["left"][at], t["right"][at])
            active = active[t["left"][node[active]] >= 0]
        out[:, i] = t["value"][node]
    return np.cumsum(out, axis=1)


def staged_scores(trees: list[dict[str, np.ndarray]], rows: DataFrame, target: str, first: int, last: int) -> DataFrame:
    """(stage, target, margin) of the prefixes of `first` to `last` trees, for rows with `features`."""
    sent = rows.sparkSession.sparkContext.broadcast(trees[:last])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                margins = staged_margins(sent.value, np.stack(pdf["x"].to_numpy()))[:, first - 1 :]
                yield pd.DataFrame({target: pdf[target], "margins": list(margins)})

    made = rows.select(F.col(target).cast("long").alias(target), vector_to_array("features").alias("x")).mapInPandas(score, f"`{target}` long, margins array<double>")
    return made.select(target, F.posexplode("margins").alias("stage", "margin")).withColumn("stage", F.col("stage") + first)


def precision_by_stage(scores: DataFrame, target: str) -> DataFrame:
    """(stage, pr_auc, ...): one ranking per prefix, all by the same running totals."""
    return ranking_metrics(score_curve(scores, target, "margin", by=("stage",)), "margin", by=("stage",))


def best_stage(precisions: list[float], patience: int = PATIENCE) -> tuple[int, bool]:
    """The first stage (from 1) that none of the next `patience` ones beats, and whether so many were seen."""
    best, at = -np.inf, 0
    for stage, value in enumerate(precisions, 1):
        if value is not None and value > best:
            best, at = value, stage
        elif stage - at >= patience:
            return max(at, 1), True
    return max(at, 1), False


def stopping_stage(trees: list[dict[str, np.ndarray]], rows: DataFrame, target: str, patience: int = PATIENCE) -> tuple[int, bool]:
    """`best_stage` of the ensemble on `rows`; prefixes are looked at `patience` at a time, until it is known."""
    seen: list[float] = []
    for first in range(1, len(trees) + 1, patience):
        last = min(first + patience - 1, len(trees))
        # One number per prefix.
        found = {r.stage: r.pr_auc for r in precision_by_stage(staged_scores(trees, rows, target, first, last), target).collect()}
        seen += [found.get(s) for s in range(first, last + 1)]
        stage, known = best_stage(seen, patience)
        if known:
            return stage, True
    return best_stage(seen, patience)


def first_trees(model: GBTClassificationModel, n: int) -> GBTClassificationModel:
    """The fitted model with its first `n` trees only."""
    context = SparkContext._active_spark_context
    jvm, gateway = context._jvm, context._gateway
    kept = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n)
    weights = gateway.new_array(jvm.double, n)
    for i, tree in enumerate(list(model._java_obj.trees())[:n]):
        kept[i], weights[i] = tree, float(model.treeWeights[i])
    cut = jvm.org.apache.spark.ml.classification.GBTClassificationModel(model.uid, kept, weights, model.numFeatures, model.numClasses)
    made = GBTClassificationModel(cut)
    made._resetUid(model.uid)
    model._copyValues(made)
    made._transfer_params_to_java()
    return made


def cut_pipeline(model: PipelineModel, n: int) -> PipelineModel:
    return PipelineModel(stages=[*model.stages[:-1], first_trees(model.stages[-1], n)])
