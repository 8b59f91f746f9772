"""From the fact table to fitted models, a decision threshold and one test report."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from causalrisk.functions.rowwise import add_entity_keys, add_reference_days, add_row_features, model_features
from causalrisk.operators import calibrate as cal, evaluate as ev
from causalrisk.operators.encode import FrequencyEncoder
from causalrisk.operators.entity import entity_history, history_names
from causalrisk.operators.models import fit_baseline, fit_boosted_trees, score_rows
from causalrisk.operators.split import temporal_split
from causalrisk.session import materialise
from causalrisk.sources.files import split_column_types
from causalrisk.spec import DatasetSpec


@dataclass
class Features:
    rows: DataFrame
    encoder: FrequencyEncoder
    numeric: list[str]
    categorical: list[str]

    def part(self, name: str) -> DataFrame:
        return self.rows.filter(F.col("split") == name)


def build_features(facts: DataFrame, spec: DatasetSpec, with_history: bool = True, **fractions: float) -> Features:
    """Row features, entity history, split, and frequencies learned on the training part.

    Only frequency encoding looks across rows without regard to time, and it
    sees the training part alone. The result is stored once; later steps read
    the columns and parts they need.
    """
    made = add_reference_days(add_row_features(facts, spec), spec)
    made = add_entity_keys(made, spec)
    if with_history and spec.entity_keys:
        made = entity_history(made, spec.entity_keys, spec.time, spec.amount, (spec.id,))
        ratios = [history_names(k)[3] for k in spec.entity_keys]
        # No model takes a ratio to a mean of 0.
        made = made.withColumns({c: F.when(F.abs(c) < float("inf"), F.col(c)) for c in ratios})
    made, _ = temporal_split(made, spec.time, spec.target, **fractions)
    encoder = FrequencyEncoder(list(spec.frequency_columns)).fit(made.filter(F.col("split") == "train"))
    names = [c for c in model_features(made, spec) if c != "split"]
    rows = materialise(encoder.transform(made), "features")
    kinds = split_column_types(rows, [*names, *[f"{c}_freq" for c in encoder.columns]])
    return Features(rows, encoder, kinds["numeric"], kinds["categorical"])


def without_history(features: Features, spec: DatasetSpec) -> Features:
    """The same rows and encoder, with entity history hidden from the models."""
    made = {name for key in spec.entity_keys for name in history_names(key)}
    return replace(features, numeric=[c for c in features.numeric if c not in made], categorical=[c for c in features.categorical if c not in made])


def train_models(features: Features, target: str, trees: bool = True, **boosting) -> dict[str, PipelineModel]:
    """The logistic baseline and, if wanted, boosted trees stopped early on the validation part."""
    train = features.part("train")
    models = {"baseline": fit_baseline(train, features.numeric, features.categorical, target)}
    if trees:
        models["trees"] = fit_boosted_trees(
            train, features.numeric, features.categorical, target, features.part("val"), **boosting
        )
    return models


def calibrate_and_test(
    features: Features, model: PipelineModel, spec: DatasetSpec, **costs: float
) -> tuple[cal.Calibrator, float, DataFrame]:
    """Calibrator, threshold and the single test report.

    Early validation rows fit the calibrators, late ones choose between them and
    set the threshold; test rows are only read with both fixed.
    """
    keep = [spec.id, spec.time, spec.target, spec.amount, "split"]
    held_out = features.rows.filter(F.col("split").isin("val", "test"))
    scored = materialise(score_rows(model, held_out, "score", keep).drop("features"), "held-out")
    halves = cal.halve_by_time(scored.filter(F.col("split") == "val"), spec.time, spec.id)
    early, late = halves.filter(F.col("half") == "early"), halves.filter(F.col("half") == "late")
    calibrator, _ = cal.fit_and_compare(early, late, spec.target, "score")
    late = materialise(calibrator.transform(late, "score", "p"), "late")
    threshold = ev.best_threshold(ev.cost_sweep(late, spec.target, "p", spec.amount, **costs)).first().threshold
    test = calibrator.transform(scored.filter(F.col("split") == "test"), "score", "p")
    test = materialise(test, "test")
    ranking = ev.ranking_metrics(ev.score_curve(test, spec.target, "p"), "p").select("pr_auc", "roc_auc", "brier")
    at = ev.evaluate_at(test, spec.target, "p", spec.amount, {"test": threshold}, **costs)
    report = at.withColumns({c: ranking.select(c).scalar() for c in ranking.columns})
    return calibrator, threshold, report
