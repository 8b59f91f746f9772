"""How well a score ranks, where to cut it, and what a cut costs.

Everything follows from one curve: the distinct scores from high to low with
the rows, positives and positive amounts at or above each.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from causalrisk.operators.ordered import exact_quantiles, running_totals

# Default costs and operating points.
FALSE_ALARM_COST = 15.0
RECOVERY_RATE = 0.9
PRECISION_TARGETS = (0.5, 0.7, 0.9)
ALERT_BUDGETS = (0.005, 0.01, 0.02, 0.05)
COST_GRID = 200
COST_GRID_RANGE = (0.50, 0.9995)


def score_curve(df: DataFrame, target: str, score: str, amount: str | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct scores, highest first, with cumulative rows, positives and positive amount."""
    y = F.col(target)
    money = y * F.col(amount) if amount else F.lit(0.0)
    return running_totals(
        df, score, {"n": F.lit(1), "pos": y.cast("long"), "lost": money}, by=by, descending=True
    )


def ranking_metrics(curve: DataFrame, score: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Average precision, ROC area, Brier score, base rate and lift of one curve per group."""
    p = F.col(score)
    negatives = F.col("n") - F.col("pos")
    better = F.col("cum_pos") - F.col("pos") / 2
    out = curve.groupBy(*by).agg(
        F.sum(F.try_divide(F.col("pos"), F.col("tot_pos")) * F.col("cum_pos") / F.col("cum_n")).alias("pr_auc"),
        F.try_divide(
            F.sum(negatives * better),
            F.max(F.col("tot_pos").cast("double") * (F.col("tot_n") - F.col("tot_pos"))),
        ).alias("roc_auc"),
        (F.sum(F.col("pos") * (1 - p) * (1 - p) + negatives * p * p) / F.max("tot_n")).alias("brier"),
        F.max("tot_n").alias("n"),
        F.max("tot_pos").alias("n_positive"),
    )
    base = F.col("n_positive") / F.col("n")
    return out.withColumn("base_rate", base).withColumn("pr_auc_lift", F.try_divide("pr_auc", base))


def curve_points(curve: DataFrame, score: str) -> DataFrame:
    """Precision, recall and false-positive rate at every distinct score."""
    negatives = F.col("tot_n") - F.col("tot_pos")
    return curve.select(
        F.col(score).alias("threshold"),
        (F.col("cum_pos") / F.col("cum_n")).alias("precision"),
        F.try_divide(F.col("cum_pos"), F.col("tot_pos")).alias("recall"),
        F.try_divide(F.col("cum_n") - F.col("cum_pos"), negatives).alias("false_positive_rate"),
    )


def precision_thresholds(curve: DataFrame, score: str, targets: tuple[float, ...] = PRECISION_TARGETS) -> DataFrame:
    """(goal, threshold): the lowest score that keeps the precision, else the highest score."""
    p, precision = F.col(score), F.col("cum_pos") / F.col("cum_n")
    found = [
        F.struct(F.lit(t).alias("goal"), F.coalesce(F.min(F.when(precision >= t, p)), F.max(p)).alias("threshold"))
        for t in targets
    ]
    return curve.agg(F.array(*found).alias("t")).select(F.inline("t"))


def budget_thresholds(df: DataFrame, score: str, budgets: tuple[float, ...] = ALERT_BUDGETS) -> DataFrame:
    """(goal, threshold): the score quantile that flags the given share of rows."""
    by_prob = {1.0 - b: b for b in budgets}
    goal = F.element_at(F.create_map(*[x for p, b in by_prob.items() for x in (F.lit(p), F.lit(b))]), F.col("prob"))
    return exact_quantiles(df, score, list(by_prob)).select(goal.alias("goal"), F.col("value").alias("threshold"))


def at_thresholds(
    df: DataFrame, target: str, score: str, thresholds: list[float], amount: str | None = None,
    by: tuple[str, ...] = (),
) -> DataFrame:
    """Counts and positive amounts at or above each threshold, in one pass.

    Rows are summed between neighbouring thresholds first; the running sum then
    runs over that small table.
    """
    cuts = sorted({float(t) for t in thresholds})
    y = F.col(target)
    never = F.lit(float("-inf"))  # a row without a score is not flagged, and counts as such
    rows = df.select(
        *by, F.coalesce(F.nanvl(F.col(score).cast("double"), never), never).alias("_p"), y.cast("long").alias("_y"),
        (y * F.col(amount) if amount else F.lit(0.0)).alias("_a"),
    )
    bucketed = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")], inputCol="_p", outputCol="_bucket"
    ).transform(rows)
    between = bucketed.groupBy(*by, F.col("_bucket").cast("int").alias("_bucket")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("_y").alias("pos"), F.sum("_a").alias("lost")
    )
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_bucket"), F.lit(c).alias("threshold")) for i, c in enumerate(cuts)])
    return (
        between.withColumn("_t", F.explode(grid))
        .groupBy(*by, F.col("_t.threshold").alias("threshold"))
        .agg(*_split_sums(F.col("_bucket") >= F.col("_t._bucket")))
    )


def _split_sums(flagged: Column) -> list[Column]:
    negatives = F.col("n") - F.col("pos")

    def total(value: Column, keep: Column) -> Column:
        return F.sum(F.when(keep, value).otherwise(F.lit(0)))

    return [
        total(F.col("pos"), flagged).alias("tp"),
        total(negatives, flagged).alias("fp"),
        total(F.col("pos"), ~flagged).alias("fn"),
        total(negatives, ~flagged).alias("tn"),
        total(F.col("lost"), flagged).alias("caught"),
        total(F.col("lost"), ~flagged).alias("missed"),
    ]


def confusion_rates(counts: DataFrame) -> DataFrame:
    """Precision, recall, F1 and alert rate; an empty denominator gives 0."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.withColumns({
        "precision": precision,
        "recall": recall,
        "f1": ratio(2 * precision * recall, precision + recall),
        "alert_rate": ratio(tp + fp, tp + fp + fn + tn),
    })


def expected_cost(
    counts: DataFrame, fp_cost: float = FALSE_ALARM_COST, recovery: float = RECOVERY_RATE
) -> DataFrame:
    """Money still lost after acting: missed value, unrecovered value, cost of false alarms."""
    recovered = F.col("caught") * recovery
    unrecovered = F.col("caught") - recovered
    alarms = F.col("fp") * fp_cost
    return counts.withColumns({
        "recovered": recovered,
        "unrecovered": unrecovered,
        "false_alarm_cost": alarms,
        "net_cost": F.col("missed") + unrecovered + alarms,
    })


def cost_grid(df: DataFrame, score: str, points: int = COST_GRID) -> list[float]:
    """Distinct score quantiles that the cost sweep tries."""
    low, high = COST_GRID_RANGE
    probs = [low + (high - low) * i / (points - 1) for i in range(points)]
    return sorted({r.value for r in exact_quantiles(df, score, probs).collect()})


def cost_sweep(df: DataFrame, target: str, score: str, amount: str, points: int = COST_GRID, **costs: float) -> DataFrame:
    """Net cost at every point of the grid, thresholds shown to six digits."""
    swept = expected_cost(at_thresholds(df, target, score, cost_grid(df, score, points), amount), **costs)
    return swept.withColumn("threshold", F.bround("threshold", 6))


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The cheapest threshold; the lowest one when several cost the same to the cent."""
    cheapest = F.struct(F.bround("net_cost", 2), "threshold")
    return sweep.agg(
        F.min_by("threshold", cheapest).alias("threshold"),
        F.min_by("net_cost", cheapest).alias("net_cost"),
    )


def evaluate_at(
    df: DataFrame, target: str, score: str, amount: str, thresholds: dict[str, float], **costs: float
) -> DataFrame:
    """(point, threshold, counts, rates, cost) at named thresholds."""
    names = df.sparkSession.createDataFrame(list(thresholds.items()), "point string, threshold double")
    counts = at_thresholds(df, target, score, list(thresholds.values()), amount)
    return names.join(expected_cost(confusion_rates(counts), **costs), "threshold")


def apply_once(
    validation: DataFrame, test: DataFrame, target: str, score: str, amount: str, **costs: float
) -> DataFrame:
    """The cost-optimal validation threshold on the test rows, and the loss of ranking quality."""
    chosen = best_threshold(cost_sweep(validation, target, score, amount, **costs)).first().threshold
    before = ranking_metrics(score_curve(validation, target, score), score).first().pr_auc
    after = ranking_metrics(score_curve(test, target, score), score)
    result = evaluate_at(test, target, score, amount, {"test": chosen}, **costs)
    return result.withColumns({
        "validation_pr_auc": F.lit(before),
        "test_pr_auc": after.select("pr_auc").scalar(),
    }).withColumn("gap", F.col("test_pr_auc") - F.col("validation_pr_auc"))


def compare_variants(variants: dict[str, DataFrame], target: str, score: str) -> DataFrame:
    """Ranking metrics of several scored sets under one protocol, one row per variant."""
    stacked = None
    for name, df in variants.items():
        rows = df.select(F.lit(name).alias("variant"), target, score)
        stacked = rows if stacked is None else stacked.unionByName(rows)
    return ranking_metrics(score_curve(stacked, target, score, by=("variant",)), score, by=("variant",))


def full_evaluation(df: DataFrame, target: str, score: str, amount: str, **costs: float) -> DataFrame:
    """(section, metric, value): ranking, operating points, cost optimum, value added."""
    from causalrisk.session import materialise

    rows = materialise(df.select(target, score, amount), "scores")
    curve = score_curve(rows, target, score, amount)
    points = {f"precision {r.goal:.0%}": r.threshold for r in precision_thresholds(curve, score).collect()}
    points |= {f"budget {r.goal:.1%}": r.threshold for r in budget_thresholds(rows, score).collect()}
    points["cost optimal"] = best_threshold(cost_sweep(rows, target, score, amount, **costs)).first().threshold
    metrics = ranking_metrics(curve, score)
    operating = evaluate_at(rows, target, score, amount, points, **costs)
    nothing = rows.agg(F.sum(F.col(target) * F.col(amount))).scalar()
    saved = operating.filter(F.col("point") == "cost optimal").select(
        F.lit("value added").alias("section"), nothing.alias("do_nothing"), "net_cost"
    ).withColumn("net_saving", F.col("do_nothing") - F.col("net_cost")).withColumn(
        "pct_avoided", F.coalesce(F.try_divide(F.col("net_saving") * 100, "do_nothing"), F.lit(0.0))
    )
    return (
        _melt(metrics.withColumn("section", F.lit("ranking")), "section")
        .unionByName(_melt(operating.withColumnRenamed("point", "section"), "section"))
        .unionByName(_melt(saved, "section"))
    )


def _melt(df: DataFrame, key: str) -> DataFrame:
    metrics = [c for c in df.columns if c != key]
    pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]
    return df.select(key, F.inline(F.array(*pairs)))
