"""Scoring of arriving rows: the same plan for a batch and for a stream."""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from causalrisk.functions.rowwise import add_row_features
from causalrisk.operators.calibrate import Calibrator
from causalrisk.operators.encode import FrequencyEncoder
from causalrisk.operators.explain import explain_baseline, explain_trees, top_reasons
from causalrisk.operators.models import align_to_schema, decision, risk_band, score_rows, with_serving_defaults
from causalrisk.operators.narrative import narrate
from causalrisk.operators.shapley import TreeShapley
from causalrisk.session import shared_folder
from causalrisk.spec import DatasetSpec, EntityKey


@dataclass
class Scorer:
    """Everything fitted that a sparse incoming row needs to become a decision.

    `threshold` must be on the scale of the score it is compared with, so it is
    the calibrated one when a calibrator is given.
    """

    spec: DatasetSpec
    schema: dict[str, str]
    model: PipelineModel
    threshold: float
    encoder: FrequencyEncoder | None = None
    levels: dict[str, list[str]] = field(default_factory=dict)
    calibrator: Calibrator | None = None
    term_names: list[str] = field(default_factory=list)
    term_means: list[float] = field(default_factory=list)
    shapley: TreeShapley | None = None

    def _scored(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        spec = self.spec
        made = add_row_features(with_serving_defaults(rows, spec.id, spec.time), spec)
        if self.encoder is not None:
            made = self.encoder.transform(made)
        carried = [F.col(c).alias(f"_in_{c}") for c in keep]
        inputs = made.select("*", *carried)
        kinds = dict(inputs.dtypes)
        aligned = align_to_schema(
            inputs, {**{f"_in_{c}": kinds[f"_in_{c}"] for c in keep}, **self.schema}, self.levels
        )
        scored = score_rows(self.model, aligned, "raw_score")
        if self.calibrator is not None:
            scored = self.calibrator.transform(scored, "raw_score", "probability")
        else:
            scored = scored.withColumn("probability", F.col("raw_score"))
        p = F.col("probability")
        return scored.withColumns({"risk_band": risk_band(p), "decision": decision(p, self.threshold)})

    def transform(self, rows: DataFrame) -> DataFrame:
        """(id, probability, risk_band, decision, threshold)."""
        id = self.spec.id
        return self._scored(rows, [id]).select(
            F.col(f"_in_{id}").alias(id), F.bround("probability", 4).alias("probability"),
            "risk_band", "decision", F.lit(round(self.threshold, 4)).alias("threshold"),
        )

    def explain(self, rows: DataFrame, k: int = 6) -> DataFrame:
        """The score with its strongest reasons and the narrative; `term_names` are those of the model's inputs.

        A logistic model also needs `term_means`, its `training_means`. Trees have
        exact Shapley reasons where `shapley` is given, else path contributions.
        """
        spec = self.spec
        scored = self._scored(rows, [spec.id, spec.amount])
        if hasattr(self.model.stages[-1], "trees"):
            if self.shapley is not None:
                explained = self.shapley.explain(scored, self.term_names)
            else:
                explained, _ = explain_trees(self.model, scored, self.term_names)
        else:
            explained, _ = explain_baseline(self.model, scored, self.term_names, self.term_means)
        scored = explained
        reasons = top_reasons(F.col("reasons"), k)
        slim = scored.select(
            F.col(f"_in_{spec.id}").alias(spec.id), F.col(f"_in_{spec.amount}").alias(spec.amount),
            "probability", "decision", reasons.alias("reasons"),
        )
        return narrate(slim, spec.id, "probability", spec.amount, "reasons")

    def save(self, path: str) -> None:
        """Everything under one folder: settings as text, model, encoder map and calibrator beside it."""
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        if self.encoder is not None:
            self.encoder.save(f"{path}/encoder")
        if self.calibrator is not None:
            self.calibrator.save(f"{path}/calibrator")
        if self.shapley is not None:
            self.shapley.save(f"{path}/shapley")
        settings = {
            "spec": asdict(self.spec), "schema": self.schema, "threshold": self.threshold, "levels": self.levels,
            "term_names": self.term_names, "term_means": [float(m) for m in self.term_means],
            "encoder": None if self.encoder is None else {"columns": self.encoder.columns, "unseen": self.encoder.unseen},
            "calibrator": None if self.calibrator is None else self.calibrator.method,
            "shapley": self.shapley is not None,
        }
        spark.createDataFrame([(json.dumps(settings),)], "settings string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Scorer:
        s = json.loads(spark.read.text(f"{path}/settings").first()[0])
        keys = tuple(EntityKey(k["name"], tuple(k["columns"]), k["missing"]) for k in s["spec"].pop("entity_keys"))
        spec = DatasetSpec(entity_keys=keys, **{k: tuple(v) if isinstance(v, list) else v for k, v in s["spec"].items()})
        encoder = s["encoder"] and FrequencyEncoder.load(spark, f"{path}/encoder", s["encoder"]["columns"], s["encoder"]["unseen"])
        calibrator = s["calibrator"] and Calibrator.load(f"{path}/calibrator", s["calibrator"])
        model = PipelineModel.load(f"{path}/model")
        shapley = TreeShapley.load(spark, f"{path}/shapley", model) if s.get("shapley") else None
        return Scorer(
            spec, s["schema"], model, s["threshold"], encoder, s["levels"], calibrator, s["term_names"], s["term_means"], shapley,
        )


def read_files(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet",
               files_per_batch: int = 100) -> DataFrame:
    """A stream of the Parquet files that arrive in a folder."""
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def run_available(stream: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Process what has arrived so far, append it to Parquet files, and read them back.

    A second run with the same `path` goes on where the first one stopped.
    """
    spark = stream.sparkSession
    target = path or f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", f"{target}/_progress").trigger(availableNow=True)
        .start(f"{target}/rows")
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{target}/rows")
