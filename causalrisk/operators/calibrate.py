"""From a score to an honest probability, and how honest it is."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import DataFrame, Window, functions as F

from causalrisk.operators.ordered import ALL, SEGMENT, count_above, in_segments, quantile_edges, with_row_index

ISOTONIC_MARGIN = 0.10


def reliability_bins(df: DataFrame, target: str, score: str, bins: int) -> DataFrame:
    """Per quantile bin (upper edge included): size, mean score, observed rate, gap.

    With fewer than three distinct edges all rows share one bin, numbered -1.
    """
    edges = quantile_edges(df, score, bins)
    bin_no = count_above(F.col(score), edges[1:-1], inclusive=False) if len(edges) >= 3 else F.lit(-1)
    return (
        df.select(bin_no.alias("bin"), target, score).groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg(score).alias("mean_predicted"),
            F.avg(target).alias("observed_rate"),
        )
        .withColumn("gap", F.col("mean_predicted") - F.col("observed_rate"))
    )


def reliability_table(df: DataFrame, target: str, score: str, bins: int = 10) -> DataFrame:
    return reliability_bins(df, target, score, bins).filter(F.col("bin") >= 0)


def calibration_error(df: DataFrame, target: str, score: str, bins: int = 15) -> DataFrame:
    """Size-weighted mean gap between mean score and observed rate over the bins."""
    return reliability_bins(df, target, score, bins).agg(
        (F.sum(F.col("n") * F.abs("gap")) / F.sum("n")).alias("ece")
    )


def inversions(df: DataFrame, raw: str, calibrated: str) -> DataFrame:
    """How often the calibrated value drops while the raw score rises.

    Equal pairs cannot be an inversion, so they are merged before the sort. The
    first row of a segment is compared with the last row before that segment.
    """
    pairs = df.select(F.col(raw).alias("_score"), F.col(calibrated).alias("_mapped")).distinct()
    order = [F.col("_score"), F.col("_mapped")]
    segments = in_segments(pairs.withColumn(ALL, F.lit(0)), order)
    ends = segments.groupBy(ALL, SEGMENT).agg(
        F.max_by("_mapped", F.struct("_score", "_mapped")).alias("end")
    )
    # One row per segment.
    previous = ends.withColumn("end", F.lag("end").over(Window.partitionBy(ALL).orderBy(SEGMENT))).drop(ALL)
    inside = Window.partitionBy(SEGMENT).orderBy(*order)
    before = F.coalesce(F.lag("_mapped").over(inside), F.col("end"))
    return (
        segments.join(F.broadcast(previous), SEGMENT)
        .withColumn("step", F.col("_mapped") - before)
        .agg(F.count_if(F.col("step") < -1e-12).alias("inversions"))
    )


def halve_by_time(df: DataFrame, time: str, id: str) -> DataFrame:
    """`df` with `half` = early or late; an odd row out goes to the late half."""
    order = [time, id]
    cut = with_row_index(df.select(*order), [F.col(c) for c in order]).filter(
        F.col("row_index") == F.floor(F.col("rows") / 2)
    ).first()
    if cut is None:
        return df.withColumn("half", F.lit("late"))
    t = F.col(time)
    early = (t < cut[time]) | ((t == cut[time]) & (F.col(id) < cut[id]))
    return df.withColumn("half", F.when(early, "early").otherwise("late"))


def spread_sample(df: DataFrame, score: str, id: str) -> DataFrame:
    """Rows across the score range: top eight, six from a third down, last four."""
    indexed = with_row_index(df.select(score, id), [F.col(score).desc(), F.col(id)])
    i, n = F.col("row_index"), F.col("rows")
    start, step = F.floor(n / 3), F.greatest(F.floor(n / 12), F.lit(1))
    middle = (i >= start) & (i < start + 6 * step) & ((i - start) % step == 0)
    picked = indexed.filter((i < 8) | middle | (i >= n - 4)).select(id, "row_index")
    # Eighteen rows at most.
    return df.join(F.broadcast(picked), id)


@dataclass
class Calibrator:
    """A monotone map fitted on held-out scores; `method` is isotonic or sigmoid."""

    method: str
    model: object

    @staticmethod
    def fit(df: DataFrame, target: str, score: str, method: str) -> Calibrator:
        rows = df.select(F.col(target).cast("double").alias("label"), F.col(score).alias("_score"))
        if method == "isotonic":
            return Calibrator(method, IsotonicRegression(featuresCol="_score", labelCol="label").fit(rows))
        if method == "sigmoid":
            vectors = VectorAssembler(inputCols=["_score"], outputCol="features").transform(rows)
            return Calibrator(method, LogisticRegression(regParam=0.0, maxIter=200, tol=1e-10).fit(vectors))
        raise ValueError(f"unknown method {method!r}")

    def transform(self, df: DataFrame, score: str, output: str) -> DataFrame:
        if self.method == "isotonic":
            made = self.model.setFeaturesCol(score).setPredictionCol("_calibrated").transform(df)
            value = F.col("_calibrated")
        else:
            vectors = VectorAssembler(inputCols=[score], outputCol="_score_vector").transform(df)
            model = self.model.setFeaturesCol("_score_vector").setProbabilityCol("_calibrated")
            model = model.setRawPredictionCol("_raw").setPredictionCol("_class")
            made = model.transform(vectors)
            value = vector_to_array("_calibrated")[1]
        bounded = F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0))
        return made.withColumn(output, bounded).drop("_calibrated", "_score_vector", "_raw", "_class")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str, method: str) -> Calibrator:
        kind = IsotonicRegressionModel if method == "isotonic" else LogisticRegressionModel
        return Calibrator(method, kind.load(path))


def judge(df: DataFrame, target: str, raw: str, calibrated: str) -> dict[str, float]:
    gap = F.col(calibrated) - F.col(target)
    basic = df.agg(
        F.avg(gap * gap).alias("brier"),
        F.max(calibrated).alias("max_prob"),
    ).first()
    return {
        "brier": basic.brier,
        "max_prob": basic.max_prob,
        "ece": calibration_error(df, target, calibrated).first().ece,
        "distinct_values": df.select(calibrated).distinct().count(),
        "inversions": inversions(df, raw, calibrated).first().inversions,
    }


def fit_and_compare(
    early: DataFrame, late: DataFrame, target: str, score: str, margin: float = ISOTONIC_MARGIN
) -> tuple[Calibrator, dict[str, dict[str, float]]]:
    """Fit both methods on `early`, judge on `late`, and choose.

    Isotonic is taken only for a relative Brier gain above `margin`, because it
    merges many scores into few values.
    """
    fitted = {m: Calibrator.fit(early, target, score, m) for m in ("isotonic", "sigmoid")}
    table = {"raw": judge(late, target, score, score)}
    for method, calibrator in fitted.items():
        table[method] = judge(calibrator.transform(late, score, "_p"), target, score, "_p")
    sigmoid = table["sigmoid"]["brier"]
    gain = (sigmoid - table["isotonic"]["brier"]) / sigmoid if sigmoid else 0.0
    return fitted["isotonic" if gain > margin else "sigmoid"], table


def comparison_table(spark, table: dict[str, dict[str, float]], chosen: str) -> DataFrame:
    rows = [
        (m, float(s["brier"]), float(s["ece"]), float(s["max_prob"]), int(s["distinct_values"]),
         int(s["inversions"]), int(m == chosen))
        for m, s in table.items()
    ]
    return spark.createDataFrame(
        rows,
        "method string, brier double, ece double, max_prob double, distinct_values long, inversions long, chosen int",
    )
