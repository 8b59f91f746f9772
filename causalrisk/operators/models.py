"""Supervised models as ordinary `pyspark.ml` pipelines, fitted on the training part."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import (
    OneHotEncoder, SQLTransformer, StandardScaler, StringIndexer, StringIndexerModel, VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.operators.boosting import PATIENCE, cut_pipeline, stopping_stage
from causalrisk.operators.ordered import exact_quantiles
from causalrisk.operators.stages import TargetStatistics
from causalrisk.operators.trees import compact_trees, tree_nodes
from causalrisk.operators.unpivot import long_form
from causalrisk.session import materialise

# Model settings.
RARE_SHARE = 0.01
INFREQUENT = "__infrequent__"
ABSENT_NUMBER = -999.0
BOOSTING = dict(
    maxIter=600, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8",
    minInstancesPerNode=5, seed=42,
)


def imbalance_weight(train: DataFrame, target: str) -> float:
    """Negatives per positive, with at least one positive assumed."""
    row = train.agg(F.sum(target).alias("p"), F.count(F.lit(1)).alias("n")).first()
    return (row.n - row.p) / max(row.p, 1)


def frequent_levels(train: DataFrame, columns: list[str], share: float = RARE_SHARE) -> dict[str, list[str]]:
    """Levels with at least `share` of a column's non-null rows, most frequent first.

    A column has at most 1 / share such levels, so they fit on the driver.
    """
    if not columns:
        return {}
    counts = (
        long_form(train, columns, "string").filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    kept = (
        counts.join(F.broadcast(totals), "column").filter(F.col("n") >= F.col("total") * share)
        .orderBy("column", F.desc("n"), "value").collect()
    )
    levels: dict[str, list[str]] = {c: [] for c in columns}
    for r in kept:
        levels[r["column"]].append(r["value"])
    return levels


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def pooling_stage(levels: dict[str, list[str]]) -> SQLTransformer:
    """Missing becomes the most frequent level, a level outside the list becomes infrequent."""
    made = []
    for c, kept in levels.items():
        listed = ", ".join(map(_quoted, kept)) or "NULL"
        first = _quoted(kept[0] if kept else INFREQUENT)
        made.append(
            f"CASE WHEN `{c}` IS NULL THEN {first} WHEN CAST(`{c}` AS STRING) IN ({listed}) "
            f"THEN CAST(`{c}` AS STRING) ELSE {_quoted(INFREQUENT)} END AS `{c}__level`"
        )
    return SQLTransformer(statement="SELECT *, " + ", ".join(made) + " FROM __THIS__")


def doubles_stage(columns: list[str], absent: float | None = None) -> SQLTransformer:
    """Numeric inputs as doubles under `<c>__num`; `absent` replaces NULL when given."""
    def cast(c: str) -> str:
        value = f"CAST(`{c}` AS DOUBLE)"
        return f"COALESCE({value}, {absent}D)" if absent is not None else value

    return SQLTransformer(
        statement="SELECT *, " + ", ".join(f"{cast(c)} AS `{c}__num`" for c in columns) + " FROM __THIS__"
    )


def exact_medians(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Median of each column's known values, all columns in one pass; 0 for a column without any."""
    if not columns:
        return {}
    values = long_form(df, columns, "double").where("value is not null and not isnan(value)")
    found = {r["column"]: r["value"] for r in exact_quantiles(values, "value", [0.5], ("column",)).collect()}
    return {c: float(found.get(c, 0.0)) for c in columns}


def median_stage(medians: dict[str, float]) -> SQLTransformer:
    """`<c>__num` with the median where it is missing, as `<c>__fill`."""
    made = [f"COALESCE(NANVL(`{c}__num`, NULL), {m!r}D) AS `{c}__fill`" for c, m in medians.items()]
    return SQLTransformer(statement="SELECT *, " + ", ".join(made) + " FROM __THIS__")


def with_balanced_weight(train: DataFrame, target: str) -> tuple[DataFrame, int]:
    """Row weights that give both classes the same total and sum to the row count, and that count."""
    row = train.agg(F.sum(target).alias("p"), F.count(F.lit(1)).alias("n")).first()
    positive, negative = row.n / (2.0 * max(row.p, 1)), row.n / (2.0 * max(row.n - row.p, 1))
    return train.withColumn("_weight", F.when(F.col(target) == 1, positive).otherwise(negative)), row.n


def fit_baseline(train: DataFrame, numeric: list[str], categorical: list[str], target: str) -> PipelineModel:
    """Logistic regression: median fill, scaling, one-hot of the frequent levels, balanced classes."""
    levels = frequent_levels(train, categorical)
    filled = [f"{c}__fill" for c in numeric]
    stages = [
        doubles_stage(numeric),
        median_stage(exact_medians(train, numeric)),
        VectorAssembler(inputCols=filled, outputCol="_numeric"),
        StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True, withStd=True),
    ]
    inputs = ["_scaled"]
    if levels:
        indexed = [f"{c}__index" for c in levels]
        indexer = StringIndexer(
            inputCols=[f"{c}__level" for c in levels], outputCols=indexed, handleInvalid="keep"
        )
        hot = [f"{c}__hot" for c in levels]
        stages += [pooling_stage(levels), indexer, OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=False)]
        inputs += hot
    weighted, n = with_balanced_weight(train, target)
    stages += [
        VectorAssembler(inputCols=inputs, outputCol="features"),
        LogisticRegression(
            labelCol=target, weightCol="_weight", maxIter=1000, standardization=False,
            # One unit of squared penalty against the summed loss.
            regParam=1.0 / max(n, 1),
        ),
    ]
    return Pipeline(stages=stages).fit(weighted)


def baseline_terms(model: PipelineModel, numeric: list[str], categorical: list[str]) -> list[str]:
    """Names of the baseline's vector slots, in order."""
    indexers = [s for s in model.stages if isinstance(s, StringIndexerModel)]
    hot = [
        f"{c}={level}" for c, labels in zip(categorical, indexers[0].labelsArray) for level in [*labels, "__unseen__"]
    ] if indexers else []
    return [*numeric, *hot]


def fit_boosted_trees(
    train: DataFrame, numeric: list[str], categorical: list[str], target: str, validation: DataFrame | None = None,
    patience: int = PATIENCE, **overrides,
) -> PipelineModel:
    """Boosted trees with class weights; with a validation part they stop early by its average precision.

    A missing number becomes a value below all others, so a split can set it
    apart. A level of a text column becomes its smoothed positive rate, so trees
    order any number of levels; training rows get the rates of other folds.

    An ensemble of 2 * `patience` trees is fitted, and one twice as large as long
    as the last `patience` trees still raised the best average precision; the
    trees after the best prefix are cut off.
    """
    settings = {**BOOSTING, **overrides}
    stages = [doubles_stage(numeric, ABSENT_NUMBER)] if numeric else []
    inputs, rows = [f"{c}__num" for c in numeric], train
    if categorical:
        rates = [f"{c}__rate" for c in categorical]
        levels, rows = TargetStatistics(inputCols=categorical, outputCols=rates, labelCol=target).fit_out_of_fold(train)
        stages.append(levels)
        inputs += rates
    assembler = VectorAssembler(inputCols=inputs, outputCol="features")
    weight = imbalance_weight(train, target)
    rows = rows.withColumn("_weight", F.when(F.col(target) == 1, F.lit(float(weight))).otherwise(1.0))
    rows = assembler.transform(stages[0].transform(rows) if numeric else rows)
    rows = materialise(rows.select("features", target, "_weight"), "boosting")
    prepared = PipelineModel(stages=[*stages, assembler])
    most = settings.pop("maxIter")
    if validation is None:
        return PipelineModel(stages=[*prepared.stages, GBTClassifier(labelCol=target, weightCol="_weight", maxIter=most, **settings).fit(rows)])
    held_out = materialise(prepared.transform(validation).select("features", target), "held-out")
    size = min(most, 2 * patience)
    while True:
        model = PipelineModel(stages=[*prepared.stages, GBTClassifier(labelCol=target, weightCol="_weight", maxIter=size, **settings).fit(rows)])
        trees = compact_trees(tree_nodes(model, train.sparkSession), list(model.stages[-1].treeWeights))
        stage, known = stopping_stage(trees, held_out, target, patience)
        if known or size >= most:
            return cut_pipeline(model, stage)
        size = min(most, 2 * size)


def score_rows(model: PipelineModel, df: DataFrame, output: str = "probability", keep: list[str] | None = None) -> DataFrame:
    """`df` with the positive-class probability and the assembled feature vector."""
    columns = keep or df.columns
    made = model.transform(df.select("*"))
    return made.select(*columns, F.col("features"), vector_to_array("probability")[1].alias(f"_{output}")).withColumnRenamed(
        f"_{output}", output
    )


def risk_band(probability: Column) -> Column:
    # Lower limits of the bands.
    return (
        F.when(probability >= 0.90, "CRITICAL").when(probability >= 0.70, "HIGH")
        .when(probability >= 0.40, "MEDIUM").when(probability >= 0.15, "LOW").otherwise("MINIMAL")
    )


def decision(probability: Column, threshold: float) -> Column:
    """Decline from the higher of 0.90 and the threshold, review from the threshold."""
    return (
        F.when(probability >= max(threshold, 0.90), "DECLINE").when(probability >= threshold, "REVIEW").otherwise("APPROVE")
    )


def align_to_schema(df: DataFrame, schema: dict[str, str], levels: dict[str, list[str]] | None = None) -> DataFrame:
    """Exactly the training columns in training order and type.

    An absent column is NULL, a value that does not fit the type is NULL, and so
    is a category outside the training levels.
    """
    levels = levels or {}
    out = []
    for c, kind in schema.items():
        value = F.col(c).try_cast(kind) if c in df.columns else F.lit(None).cast(kind)
        if c in levels:
            value = F.when(value.isin(levels[c]), value) if levels[c] else F.lit(None).cast(kind)
        out.append(value.alias(c))
    return df.select(*out)


def training_schema(train: DataFrame, features: list[str]) -> dict[str, str]:
    kinds = dict(train.dtypes)
    return {c: kinds[c] for c in features}


def with_serving_defaults(df: DataFrame, id: str, time: str) -> DataFrame:
    """A request without id gets 0, without time the first day."""
    # Defaults of a sparse request.
    defaults = {id: 0, time: 86400}
    return df.withColumns({
        c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()
    })
