"""Kinds of confirmed cases: clusters of the positive rows and what sets each apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from causalrisk.operators.kmeans import Fit, fit_together, silhouettes, store_points
from causalrisk.operators.models import doubles_stage, exact_medians, median_stage
from causalrisk.operators.unpivot import long_form
from causalrisk.session import materialise

#: Rows of the plain silhouette's sample, and rows of a block of its distances.
SILHOUETTE_ROWS, BLOCK = 4000, 250


def fit_scaling(rows: DataFrame, columns: list[str]) -> PipelineModel:
    """Median fill and scaling, so no feature dominates the distance."""
    filled = [f"{c}__fill" for c in columns]
    return Pipeline(stages=[
        doubles_stage(columns),
        median_stage(exact_medians(rows, columns)),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True),
    ]).fit(rows)


def weighted_points(positives: DataFrame, columns: list[str]) -> DataFrame:
    """(columns..., _weight): equal rows as one point that weighs as many.

    k-means moves and costs the same either way. Where a pass tells that rows
    hardly repeat, they are left as they are, with weight 1.
    """
    rows = positives.select(*columns)
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*columns)).alias("points")).first()
    if found.n < 2 * found.points:
        return rows.withColumn("_weight", F.lit(1.0))
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("_weight"))


def best_kmeans(points: DataFrame, ks: list[int], seed: int = 42, restarts: int = 10) -> list[Fit]:
    """Per k the k-means fit with the lowest cost among several seeds; `points` are stored by `store_points`."""
    wanted = [(k, seed + i) for k in ks for i in range(restarts)]
    fits = fit_together(points, wanted)
    return [min(fits[at : at + restarts], key=lambda f: f.cost) for at in range(0, len(fits), restarts)]


def cluster_cases(
    positives: DataFrame, columns: list[str], k: int = 5, seed: int = 42, restarts: int = 10
) -> tuple[DataFrame, PipelineModel, object]:
    """Positive rows with their `cluster`, the fitted scaling and the k-means model."""
    scaling = fit_scaling(positives, columns)
    # The fits go over these points many times.
    points = store_points(scaling.transform(weighted_points(positives, columns)), len(columns))
    model = best_kmeans(points, [k], seed, restarts)[0].model()
    rows = model.transform(scaling.transform(positives)).select(*positives.columns, F.col("prediction").alias("cluster"))
    # Whoever describes the clusters reads the rows several times.
    return materialise(rows, "clustered"), scaling, model


def describe_clusters(rows: DataFrame, cluster: str, columns: list[str], amount: str, top: int = 4) -> DataFrame:
    """Per cluster: size, share, mean amount, and the features furthest from the overall mean.

    Distance is in overall sample standard deviations. A constant feature says nothing.
    """
    long = long_form(rows, columns, "double", (cluster,))
    overall = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("spread"))
    by_cluster = long.groupBy(cluster, "column").agg(F.avg("value").alias("here"))
    z = F.try_divide(F.col("here") - F.col("mean"), F.nullif(F.col("spread"), F.lit(0.0)))
    strongest = (
        by_cluster.join(F.broadcast(overall), "column").withColumn("z", z).filter(F.col("z").isNotNull())
        .groupBy(cluster)
        .agg(F.slice(F.sort_array(F.collect_list(
            F.struct((-F.abs("z")).alias("size"), F.col("column").alias("feature"), "z"))), 1, top).alias("s"))
    )
    label = F.array_join(F.transform("s", lambda r: F.concat(
        F.when(r["z"] > 0, "high ").otherwise("low "), r["feature"])), ", ")
    signature = F.transform("s", lambda r: F.struct(r["feature"].alias("feature"), r["z"].alias("z")))
    total = rows.agg(F.count(F.lit(1))).scalar()
    sizes = rows.groupBy(cluster).agg(F.count(F.lit(1)).alias("n_cases"), F.avg(amount).alias("avg_amount"))
    return sizes.join(strongest, cluster, "left").select(
        cluster, "n_cases", (F.col("n_cases") / total).alias("share"), "avg_amount",
        F.coalesce(F.nullif(label, F.lit("")), F.lit("undifferentiated")).alias("label"),
        signature.alias("signature"),
    )


def least_hashed(points: DataFrame, features: str = "features", sample: int = SILHOUETTE_ROWS, seed: int = 42) -> DataFrame:
    """The `sample` rows of least hash, stored: any clustering of the rows has its plain silhouette over these.

    A point of weight n is n rows, of which no more than `sample` can be wanted.
    """
    x = vector_to_array(F.col(features))
    order = [F.xxhash64(x, F.lit(seed)), x]
    first = points.orderBy(*order).limit(sample)
    copies = F.array_repeat(F.col(features), F.least(F.col("_weight"), F.lit(sample)).cast("int"))
    return materialise(first.select(F.explode(copies).alias(features)).orderBy(*order).limit(sample), "least-hashed")


def euclidean_silhouette(rows: DataFrame, features: str = "features", cluster: str = "prediction", sample: int = SILHOUETTE_ROWS, seed: int = 42) -> float | None:
    """Mean silhouette by plain Euclidean distance over at most `sample` rows, all pairs of them.

    The sample (rows of least hash, at most 4,000 by default) is what every task
    gets; tasks take blocks of it, so no task holds the whole matrix of distances.
    A row alone in its cluster counts 0, as does a row with all distances 0; fewer
    than two clusters have no silhouette.
    """
    spark = rows.sparkSession
    x = vector_to_array(F.col(features))
    kept = rows.select(x.alias("x"), F.col(cluster).alias("c")).orderBy(F.xxhash64("x", F.lit(seed)), "x").limit(sample)
    kept = materialise(kept.withColumn("block", F.floor(F.rand(seed) * -(-sample // BLOCK)).cast("int")), "silhouette")
    local = kept.select("x", "c").toPandas()
    if local.c.nunique() < 2:
        return None
    points = spark.sparkContext.broadcast((np.stack(local.x.to_numpy()), local.c.to_numpy()))

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        others, named = points.value
        names, place = np.unique(named, return_inverse=True)
        size = np.bincount(place)
        members = np.zeros((len(named), len(names)))
        members[np.arange(len(named)), place] = 1.0
        for pdf in batches:
            for at in range(0, len(pdf), BLOCK):
                part = pdf.iloc[at : at + BLOCK]
                near = np.stack(part.x.to_numpy())
                apart = np.sqrt(np.maximum(((near[:, None, :] - others[None, :, :]) ** 2).sum(axis=2), 0.0))
                own = np.searchsorted(names, part.c.to_numpy())
                sums, here = apart @ members, np.arange(len(part))
                inside = sums[here, own] / np.maximum(size[own] - 1, 1)
                means = sums / size
                means[here, own] = np.inf
                outside = means.min(axis=1)
                top = np.maximum(inside, outside)
                value = np.where((size[own] > 1) & (top > 0), (outside - inside) / np.where(top > 0, top, 1.0), 0.0)
                yield pd.DataFrame({"value": value})

    return kept.repartition("block").select("x", "c").mapInPandas(score, "value double").agg(F.avg("value")).first()[0]


def choose_k(positives: DataFrame, columns: list[str], ks: range = range(2, 9), seed: int = 42, restarts: int = 10) -> DataFrame:
    """(k, silhouette, silhouette_euclidean, inertia).

    `silhouette` is Spark's, by squared Euclidean distance over all rows in linear
    time; `silhouette_euclidean` is by plain distance over a sample.
    """
    scaling = fit_scaling(positives, columns)
    points = store_points(scaling.transform(weighted_points(positives, columns)), len(columns))
    sample = least_hashed(points, seed=seed)
    fits = best_kmeans(points, [*ks], seed, restarts)
    found = silhouettes(points, [f.centres for f in fits])
    rows = [
        (k, value, euclidean_silhouette(fit.model().transform(sample), seed=seed), fit.cost)
        for k, fit, value in zip(ks, fits, found, strict=True)
    ]
    return positives.sparkSession.createDataFrame(rows, "k int, silhouette double, silhouette_euclidean double, inertia double")
