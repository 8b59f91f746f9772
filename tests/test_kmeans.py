"""Fits that share every reading of the points, against Spark's own k-means and silhouette."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from causalrisk.catalog import models
from causalrisk.operators import kmeans as km, typology as ty


def test_fits_together_are_the_fits_of_spark_and_read_the_points_together(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 1.5, size=(120, 3)) for c in (-4, 0, 5)])
    weights = rng.integers(1, 4, len(x))
    points = spark.createDataFrame([(Vectors.dense(p), float(w)) for p, w in zip(x.tolist(), weights.tolist(), strict=True)], ["features", "_weight"])
    stored = km.store_points(points, 3)
    readings, sums = [], km.cluster_sums
    monkeypatch.setattr(km, "cluster_sums", lambda p, f: readings.append(len(f)) or sums(p, f))
    wanted = [(2, 42), (3, 42), (3, 43), (6, 42)]
    fits = km.fit_together(stored, wanted)
    assert len(readings) == max(f.steps for f in fits) < sum(f.steps for f in fits) == sum(readings)
    rows = points.select(F.explode(F.array_repeat("features", F.col("_weight").cast("int"))).alias("features"))
    for (k, seed), fit, value in zip(wanted, fits, km.silhouettes(stored, [f.centres for f in fits]), strict=True):
        plain = KMeans(k=k, seed=seed, maxIter=100, weightCol="_weight").fit(stored)
        assert np.allclose(fit.centres, plain.clusterCenters(), atol=1e-9) and abs(fit.cost - plain.summary.trainingCost) < 1e-6
        told = fit.model().transform(rows)
        assert np.allclose(fit.model().clusterCenters(), fit.centres)
        assert abs(ClusteringEvaluator().evaluate(told) - value) < 1e-9


def test_one_cluster_and_empty_clusters(spark):
    points = km.store_points(spark.createDataFrame([(Vectors.dense([1.0, 2.0]), 1.0), (Vectors.dense([4.0, 6.0]), 1.0)], ["features", "_weight"]), 2)
    far = np.array([[1.0, 2.0], [4.0, 6.0], [90.0, 90.0]])
    sums = km.cluster_sums(points, {0: far})[0]
    assert sums.tolist() == [[1.0, 5.0, 1.0, 2.0], [1.0, 52.0, 4.0, 6.0], [0.0] * 4]
    assert km.silhouettes(points, [far, far[2:]]) == [0.0, None]


def test_copies_count_in_the_sample_of_least_hash(spark):
    points = spark.createDataFrame([(Vectors.dense([float(i)]), float(1 + i % 3)) for i in range(40)], ["features", "_weight"])
    rows = points.select(F.explode(F.array_repeat("features", F.col("_weight").cast("int"))).alias("features"), F.lit(1.0).alias("_weight"))
    for sample in (7, 50, 500):
        a, b = (sorted(r.features[0] for r in ty.least_hashed(d, sample=sample).collect()) for d in (points, rows))
        assert a == b and len(a) == min(sample, rows.count())


def test_typologies_keep_the_best_of_ten_fits(spark, tmp_path, monkeypatch):
    """The query makes all restarts of the reference, and the clusters are those of the one with the lowest cost."""
    rng = np.random.default_rng(2)
    rows = [(i, 1, i, i, *map(float, rng.integers(1, 50, 4)), "RA"[i % 5 == 0], "F") for i in range(120)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, "
        "l_discount double, l_tax double, l_returnflag string, l_linestatus string").withColumn("l_shipdate", F.lit("2024-01-01").cast("timestamp_ntz")
        ).write.parquet(str(tmp_path / "lineitem.parquet"))
    asked, made = [], km.fit_together

    def together(points, wanted):
        fits = made(points, wanted)
        asked.append((wanted, fits))
        return fits

    monkeypatch.setattr(ty, "fit_together", together)
    told = models.CATALOG["typologies"].run(spark, str(tmp_path)).collect()
    [(wanted, fits)] = asked
    assert wanted == [(5, 42 + i) for i in range(10)]
    best = min(fits, key=lambda f: f.cost)
    assert sum(r.n_cases for r in told) == sum(r[8] == "R" for r in rows) and len(told) == len(best.centres) == 5
