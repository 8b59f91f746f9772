"""Many k-means fits and their silhouettes that share every reading of the points.

Spark's `KMeans` gives the starts (k-means||). From there all fits, whatever
their k and seed, move together: one reading of the points is one step of every
fit that still moves, and sends one row per task and cluster. The steps, the
tolerance and the cost (of the last step's centres, before they move) are those
of `KMeans`, so the centres are the same up to rounding.

Points are rows of `features` (dense vectors) and `_weight`, as `store_points` stores them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from causalrisk.session import materialise

MAX_STEPS, TOLERANCE = 100, 1e-4


@dataclass
class Fit:
    """Centres of one fit, the cost of the points to the centres before the last step, and the steps taken."""

    start: KMeansModel
    centres: np.ndarray
    cost: float = 0.0
    steps: int = 0

    def model(self) -> KMeansModel:
        context = SparkContext._active_spark_context
        jvm, gateway = context._jvm, context._gateway
        vectors = jvm.java.util.ArrayList()
        for c in self.centres:
            numbers = gateway.new_array(jvm.double, len(c))
            for i, v in enumerate(c):
                numbers[i] = float(v)
            vectors.add(jvm.org.apache.spark.mllib.linalg.Vectors.dense(numbers))
        made = KMeansModel(jvm.org.apache.spark.ml.clustering.KMeansModel(self.start.uid, jvm.org.apache.spark.mllib.clustering.KMeansModel(vectors)))
        made._resetUid(self.start.uid)
        self.start._copyValues(made)
        made._transfer_params_to_java()
        return made


def store_points(points: DataFrame, dimensions: int) -> DataFrame:
    """`features`, `_weight` and every coordinate as a column, which steps read without unpacking vectors."""
    x = vector_to_array("features")
    return materialise(points.select("features", "_weight", *[x[i].alias(f"_x{i}") for i in range(dimensions)]), "points")


def _coordinates(points: DataFrame) -> DataFrame:
    return points.select("_weight", *[c for c in points.columns if c.startswith("_x")])


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Number of the nearest centre of every point, the first of equally near ones; `x` has a row per coordinate."""
    apart = (centres * centres).sum(axis=1)[:, None] - 2.0 * (centres @ x)
    at, least = np.zeros(x.shape[1], dtype=np.intp), apart[0]
    for j in range(1, len(centres)):
        closer = apart[j] < least
        at[closer] = j
        least = np.minimum(least, apart[j])
    return at


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Weights, and a row of numbers per coordinate."""
    numbers = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
    return numbers[0], np.stack(numbers[1:])


def cluster_sums(points: DataFrame, fits: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """Per fit a row per cluster: weight, sum of squares, and sum of each coordinate of the points nearest to it."""
    shared = points.sparkSession.sparkContext.broadcast(fits)
    numbers = [f"s{i}" for i in range(next(iter(fits.values())).shape[1] + 2)]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {f: np.zeros((len(c), len(numbers))) for f, c in shared.value.items()}
        for batch in batches:
            if batch.num_rows:
                w, x = _matrix(batch)
                measures = [w, w * (x * x).sum(axis=0), *(w * x)]
                for f, centres in shared.value.items():
                    at = nearest(x, centres)
                    total[f] += np.stack([np.bincount(at, m, len(centres)) for m in measures], axis=1)
        rows = [(f, c, *sums) for f, t in total.items() for c, sums in enumerate(t.tolist())]
        columns = [pa.array(v, pa.int32()) if i < 2 else pa.array(v, pa.float64()) for i, v in enumerate(zip(*rows, strict=True))]
        yield pa.RecordBatch.from_arrays(columns, names=["fit", "cluster", *numbers])

    made = _coordinates(points).mapInArrow(add, "fit int, cluster int, " + ", ".join(f"{n} double" for n in numbers))
    # One row per fit and cluster.
    found = made.groupBy("fit", "cluster").agg(*[F.sum(n).alias(n) for n in numbers]).collect()
    shared.unpersist()
    out = {f: np.zeros((len(c), len(numbers))) for f, c in fits.items()}
    for r in found:
        out[r.fit][r.cluster] = list(r)[2:]
    return out


def fit_together(points: DataFrame, wanted: list[tuple[int, int]], steps: int = MAX_STEPS, tolerance: float = TOLERANCE) -> list[Fit]:
    """The fit of every (k, seed)."""
    fits = []
    for k, seed in wanted:
        start = KMeans(k=k, seed=seed, maxIter=0, weightCol="_weight").fit(points)
        fits.append(Fit(start, np.stack(start.clusterCenters())))
    moving = dict(enumerate(fits))
    while moving:
        found = cluster_sums(points, {i: f.centres for i, f in moving.items()})
        for i, f in [*moving.items()]:
            n, squares, sums = found[i][:, 0], found[i][:, 1], found[i][:, 2:]
            c = f.centres
            f.cost = float((squares - 2.0 * (c * sums).sum(axis=1) + n * (c * c).sum(axis=1)).sum())
            f.steps += 1
            # A centre without points stays.
            f.centres = np.where(n[:, None] > 0, sums / np.where(n > 0, n, 1.0)[:, None], c)
            if f.steps >= steps or (((f.centres - c) ** 2).sum(axis=1) <= tolerance * tolerance).all():
                del moving[i]
    return fits


def silhouettes(points: DataFrame, fits: list[np.ndarray]) -> list[float | None]:
    """Mean silhouette of every fit by squared Euclidean distance over all rows, a point of weight n being n rows.

    As `ClusteringEvaluator` has it for the rows: a row leaves out itself only and
    counts 0 alone in its cluster. Fewer than two clusters have no silhouette.
    """
    sums = cluster_sums(points, dict(enumerate(fits)))
    shared = points.sparkSession.sparkContext.broadcast((fits, sums))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fits, sums = shared.value
        total = np.zeros(len(fits))
        for batch in batches:
            if batch.num_rows:
                w, x = _matrix(batch)
                squares, here = (x * x).sum(axis=0), np.arange(len(w))
                for f, centres in enumerate(fits):
                    n = sums[f][:, 0]
                    size = np.where(n > 0, n, np.nan)[:, None]
                    at = nearest(x, centres)
                    apart = squares + sums[f][:, 1:2] / size - 2.0 * (sums[f][:, 2:] @ x) / size
                    own = apart[at, here] * n[at] / np.maximum(n[at] - 1.0, 1.0)
                    apart[at, here] = np.nan
                    other = np.fmin.reduce(apart, axis=0)
                    top = np.maximum(own, other)
                    value = np.where((n[at] > 1) & (top > 0), (other - own) / np.where(top > 0, top, 1.0), 0.0)
                    total[f] += float(w @ value)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(fits)), pa.int32()), pa.array(total)], names=["fit", "value"])

    found = _coordinates(points).mapInArrow(add, "fit int, value double").groupBy("fit").agg(F.sum("value").alias("value")).collect()
    value = {r.fit: r.value for r in found}
    return [float(value[f] / sums[f][:, 0].sum()) if np.count_nonzero(sums[f][:, 0]) > 1 else None for f in range(len(fits))]
