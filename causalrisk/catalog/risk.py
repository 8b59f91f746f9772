"""Ranking quality, thresholds, money and calibration of the closed-form score."""

from __future__ import annotations

from pyspark.sql import functions as F

from causalrisk.catalog.common import Catalog, q4, r4, rounded, with_tables
from causalrisk.operators import calibrate as cal, evaluate as ev, split as sp
from causalrisk.sources.tables import planted, scored

CATALOG = Catalog()
add = CATALOG.add

CURVE = """
    g AS (SELECT score, count(*) AS n, sum(label) AS pos FROM {source} GROUP BY score),
    c AS (SELECT *, sum(n) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER (ORDER BY score DESC) AS cp,
                 sum(n) OVER () AS tn, sum(pos) OVER () AS tp FROM g)
"""
METRICS = f"""
    {q4('sum(pos / tp * (cp / cn))')} AS pr_auc, {q4('sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp))')} AS roc_auc,
    {q4('sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score) / max(tn)')} AS brier,
    max(tn)::BIGINT AS n, max(tp)::BIGINT AS n_positive, {q4('max(tp) / max(tn)')} AS base_rate,
    {q4('sum(pos / tp * (cp / cn)) / (max(tp) / max(tn))')} AS pr_auc_lift
"""
COUNTS = """
    sum(label) FILTER (score >= threshold) AS tp, count(*) FILTER (score >= threshold AND label = 0) AS fp,
    sum(label) FILTER (score < threshold) AS fn, count(*) FILTER (score < threshold AND label = 0) AS tn,
    sum(label * amount) FILTER (score >= threshold) AS caught, sum(label * amount) FILTER (score < threshold) AS missed
"""


def grid_sql(points: int = ev.COST_GRID) -> str:
    low, high = ev.COST_GRID_RANGE
    return "[" + ", ".join(repr(low + (high - low) * i / (points - 1)) for i in range(points)) + "]"


def sweep_sql(source: str) -> str:
    return f"""
    grid AS (SELECT DISTINCT unnest(quantile_cont(score, {grid_sql()})) AS threshold FROM {source}),
    swept AS (SELECT threshold, {COUNTS} FROM {source}, grid GROUP BY threshold),
    costed AS (SELECT round_even(threshold, 6) AS threshold, coalesce(tp, 0) AS tp, fp, coalesce(fn, 0) AS fn, tn,
        coalesce(caught, 0) AS caught, coalesce(missed, 0) AS missed,
        coalesce(missed, 0) + coalesce(caught, 0) - coalesce(caught, 0) * 0.9::DOUBLE + fp * 15.0::DOUBLE AS net_cost FROM swept)
    """


@add(with_tables(f"WITH {CURVE.format(source='scored')} SELECT {METRICS} FROM c", "scored"))
def ranking_metrics(spark, folder):
    curve = ev.score_curve(scored(spark, folder), "label", "score")
    return rounded(ev.ranking_metrics(curve, "score"))


@add(with_tables(f"""WITH {CURVE.format(source='scored')}
    SELECT {q4('score', 6)} AS threshold, {q4('cp / cn')} AS precision, {q4('cp / tp')} AS recall,
           {q4('(cn - cp) / (tn - tp)')} AS false_positive_rate FROM c""", "scored"))
def curve_points(spark, folder):
    curve = ev.score_curve(scored(spark, folder), "label", "score")
    return rounded(ev.curve_points(curve, "score"), threshold=6)


@add(with_tables(f"""WITH {CURVE.format(source='scored')}, t AS (SELECT unnest([0.2, 0.3, 0.5, 0.9]) AS goal)
    SELECT goal::DOUBLE AS goal, {q4('coalesce(min(score) FILTER (cp / cn >= goal), max(score))', 6)} AS threshold FROM c, t GROUP BY goal""", "scored"))
def precision_thresholds(spark, folder):
    curve = ev.score_curve(scored(spark, folder), "label", "score")
    return rounded(ev.precision_thresholds(curve, "score", (0.2, 0.3, 0.5, 0.9)), threshold=6)


@add(with_tables(" UNION ALL ".join(
    f"SELECT {b}::DOUBLE AS goal, {q4(f'quantile_cont(score, {1.0 - b!r})', 6)} AS threshold FROM scored" for b in ev.ALERT_BUDGETS
), "scored"))
def budget_thresholds(spark, folder):
    return rounded(ev.budget_thresholds(scored(spark, folder), "score"), threshold=6)


RATES = f"""{q4('coalesce(tp / nullif(tp + fp, 0), 0)')} AS precision, {q4('coalesce(tp / nullif(tp + fn, 0), 0)')} AS recall,
    {q4('coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)')} AS f1, {q4('(tp + fp) / (tp + fp + fn + tn)')} AS alert_rate"""
INTS = "tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, tn::BIGINT AS tn"
FILLED = """(SELECT threshold, coalesce(tp, 0) AS tp, fp, coalesce(fn, 0) AS fn, tn, coalesce(caught, 0) AS caught,
    coalesce(missed, 0) AS missed FROM (SELECT threshold, {counts} FROM {source} GROUP BY threshold))"""


@add(with_tables(f"""WITH th AS (SELECT unnest([0.1, 0.2, 0.3, 0.5, 0.99]) AS threshold)
    SELECT threshold::DOUBLE AS threshold, {INTS}, {q4('caught')} AS caught, {q4('missed')} AS missed, {RATES}
    FROM {FILLED.format(counts=COUNTS, source='scored, th')}""", "scored"))
def confusion_at_thresholds(spark, folder):
    counts = ev.at_thresholds(scored(spark, folder), "label", "score", [0.1, 0.2, 0.3, 0.5, 0.99], "amount")
    return rounded(ev.confusion_rates(counts))


@add(with_tables(f"""WITH th AS (SELECT unnest([0.15, 0.25, 0.6]) AS threshold)
    SELECT threshold::DOUBLE AS threshold, {INTS}, {q4('caught')} AS caught, {q4('missed')} AS missed,
           {q4('caught * 0.9')} AS recovered, {q4('caught - caught * 0.9')} AS unrecovered, {q4('fp * 15.0')} AS false_alarm_cost,
           {q4('missed + caught - caught * 0.9 + fp * 15.0')} AS net_cost
    FROM {FILLED.format(counts=COUNTS, source='scored, th')}""", "scored"))
def expected_cost(spark, folder):
    counts = ev.at_thresholds(scored(spark, folder), "label", "score", [0.15, 0.25, 0.6], "amount")
    return rounded(ev.expected_cost(counts))


@add(with_tables(f"""WITH {sweep_sql('scored')} SELECT {q4('threshold', 6)} AS threshold, tp::BIGINT AS tp, fp, {q4('net_cost')} AS net_cost FROM costed""", "scored"))
def cost_sweep(spark, folder):
    sweep = ev.cost_sweep(scored(spark, folder), "label", "score", "amount")
    return rounded(sweep.select("threshold", "tp", "fp", "net_cost"), threshold=6)


@add(with_tables(f"""WITH {sweep_sql('scored')}
    SELECT {q4('threshold', 6)} AS threshold, {q4('net_cost')} AS net_cost FROM costed ORDER BY round_even(net_cost, 2), threshold LIMIT 1""", "scored"))
def cost_optimal_threshold(spark, folder):
    sweep = ev.cost_sweep(scored(spark, folder), "label", "score", "amount")
    return rounded(ev.best_threshold(sweep), threshold=6)


def _points_sql() -> str:
    goals = ", ".join(str(p) for p in ev.PRECISION_TARGETS)
    budget = " UNION ALL ".join(
        f"SELECT 'budget {b:.1%}' AS section, quantile_cont(score, {1.0 - b!r}) AS threshold FROM scored" for b in ev.ALERT_BUDGETS
    )
    return f"""
    pts AS (SELECT 'precision ' || (goal * 100)::INT || '%' AS section, coalesce(min(score) FILTER (cp / cn >= goal), max(score)) AS threshold
            FROM c, (SELECT unnest([{goals}]) AS goal) GROUP BY goal
        UNION ALL {budget}
        UNION ALL SELECT 'cost optimal', threshold FROM (SELECT threshold FROM costed ORDER BY round_even(net_cost, 2), threshold LIMIT 1)),
    pt AS (SELECT section, threshold, coalesce(sum(label) FILTER (score >= threshold), 0) AS tp,
        count(*) FILTER (score >= threshold AND label = 0) AS fp, coalesce(sum(label) FILTER (score < threshold), 0) AS fn,
        count(*) FILTER (score < threshold AND label = 0) AS tn, coalesce(sum(label * amount) FILTER (score >= threshold), 0) AS caught,
        coalesce(sum(label * amount) FILTER (score < threshold), 0) AS missed FROM scored, pts GROUP BY section, threshold),
    op AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall,
        coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, (tp + fp) / (tp + fp + fn + tn) AS alert_rate,
        caught * 0.9 AS recovered, caught - caught * 0.9 AS unrecovered, fp * 15.0 AS false_alarm_cost,
        missed + caught - caught * 0.9 + fp * 15.0 AS net_cost FROM pt),
    rk AS (SELECT 'ranking' AS section, sum(pos / tp * (cp / cn)) AS pr_auc, sum((n - pos) * (cp - pos / 2)) / max(tp * (tn - tp)) AS roc_auc,
        sum(pos * (1 - score) * (1 - score) + (n - pos) * score * score) / max(tn) AS brier, max(tn) AS n, max(tp) AS n_positive,
        max(tp) / max(tn) AS base_rate, sum(pos / tp * (cp / cn)) / (max(tp) / max(tn)) AS pr_auc_lift FROM c),
    va AS (SELECT 'value added' AS section, d AS do_nothing, net_cost, d - net_cost AS net_saving, (d - net_cost) * 100 / d AS pct_avoided
        FROM op, (SELECT sum(label * amount) AS d FROM scored) WHERE section = 'cost optimal')
    """


def _unpivot_sql(table: str, metrics: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT section, '{m}' AS metric, {q4(m)} AS value FROM {table}" for m in metrics)


@add(with_tables(
    f"WITH {CURVE.format(source='scored')}, {sweep_sql('scored')}, {_points_sql()} "
    + _unpivot_sql("rk", ["pr_auc", "roc_auc", "brier", "n", "n_positive", "base_rate", "pr_auc_lift"]) + " UNION ALL "
    + _unpivot_sql("op", ["threshold", "tp", "fp", "fn", "tn", "caught", "missed", "precision", "recall", "f1", "alert_rate",
                          "recovered", "unrecovered", "false_alarm_cost", "net_cost"]) + " UNION ALL "
    + _unpivot_sql("va", ["do_nothing", "net_cost", "net_saving", "pct_avoided"]),
    "scored",
))
def full_evaluation(spark, folder):
    return rounded(ev.full_evaluation(scored(spark, folder), "label", "score", "amount"))


def _scored_parts(spark, folder):
    rows = scored(spark, folder)
    return sp.with_split(rows, "t", sp.boundaries(rows, "t"))


@add(with_tables(f"""
    WITH sp AS (SELECT scored.*, CASE WHEN t <= te THEN 'train' WHEN t > vs AND t <= ve THEN 'val' WHEN t > ts0 THEN 'test' END AS part FROM scored, cuts),
    val AS (SELECT * FROM sp WHERE part = 'val'), test AS (SELECT * FROM sp WHERE part = 'test'),
    {sweep_sql('val')}, best AS (SELECT threshold FROM costed ORDER BY round_even(net_cost, 2), threshold LIMIT 1),
    cv AS (SELECT part, score, count(*) AS n, sum(label) AS pos FROM sp WHERE part IN ('val', 'test') GROUP BY 1, 2),
    ap AS (SELECT part, sum(pos / tp * (cp / cn)) AS ap FROM (SELECT *, sum(pos) OVER (PARTITION BY part ORDER BY score DESC) AS cp,
        sum(n) OVER (PARTITION BY part ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY part) AS tp FROM cv) GROUP BY part),
    r AS (SELECT * FROM {FILLED.format(counts=COUNTS, source='test, best')})
    SELECT 'test' AS point, {q4('threshold', 6)} AS threshold, {INTS}, {RATES}, {q4('missed + caught - caught * 0.9 + fp * 15.0')} AS net_cost,
        {q4("(SELECT ap FROM ap WHERE part = 'val')")} AS validation_pr_auc, {q4("(SELECT ap FROM ap WHERE part = 'test')")} AS test_pr_auc,
        {q4("(SELECT ap FROM ap WHERE part = 'test') - (SELECT ap FROM ap WHERE part = 'val')")} AS gap FROM r
""", "scored", "cuts"))
def test_applied_once(spark, folder):
    rows = _scored_parts(spark, folder)
    made = ev.apply_once(rows.filter(F.col("split") == "val"), rows.filter(F.col("split") == "test"), "label", "score", "amount")
    return rounded(made.drop("caught", "missed", "recovered", "unrecovered", "false_alarm_cost"), threshold=6)


@add(with_tables(f"""
    WITH v AS (SELECT 'with hour' AS variant, label, score FROM scored
        UNION ALL SELECT 'amount only', label, floor(amount * 2) / 1000 FROM scored),
    g AS (SELECT variant, score, count(*) AS n, sum(label) AS pos FROM v GROUP BY 1, 2),
    c AS (SELECT *, sum(n) OVER (PARTITION BY variant ORDER BY score DESC) AS cn, sum(pos) OVER (PARTITION BY variant ORDER BY score DESC) AS cp,
                 sum(n) OVER (PARTITION BY variant) AS tn, sum(pos) OVER (PARTITION BY variant) AS tp FROM g)
    SELECT variant, {METRICS} FROM c GROUP BY variant
""", "scored"))
def feature_set_comparison(spark, folder):
    rows = scored(spark, folder)
    plain = rows.withColumn("score", F.floor(F.col("amount") * 2) / 1000)
    return rounded(ev.compare_variants({"with hour": rows, "amount only": plain}, "label", "score"))


# --------------------------------------------------------------- calibration ---
def _bins_sql(bins: int) -> str:
    probs = "[" + ", ".join(repr(i / bins) for i in range(bins + 1)) + "]"
    return f"""
    e AS (SELECT DISTINCT unnest(quantile_cont(score, {probs})) AS q FROM scored),
    inner_e AS (SELECT q FROM e WHERE q > (SELECT min(q) FROM e) AND q < (SELECT max(q) FROM e)),
    b AS (SELECT bin, count(*) AS n, avg(score) AS p, avg(label) AS o FROM (
        SELECT score, label, (SELECT count(*) FROM inner_e WHERE q < score) AS bin FROM scored) GROUP BY bin)
    """


@add(with_tables(f"""WITH {_bins_sql(10)} SELECT bin, n, {q4('p')} AS mean_predicted, {q4('o')} AS observed_rate, {q4('p - o')} AS gap FROM b""", "scored"))
def reliability_table(spark, folder):
    return rounded(cal.reliability_table(scored(spark, folder), "label", "score"))


@add(with_tables(f"""WITH {_bins_sql(15)} SELECT {q4('sum(n * abs(p - o)) / sum(n)')} AS ece FROM b""", "scored"))
def calibration_error(spark, folder):
    return rounded(cal.calibration_error(scored(spark, folder), "label", "score"))


@add(with_tables("""
    WITH p AS (SELECT DISTINCT score, score + ((score * 1000000)::BIGINT % 7) * 0.001::DOUBLE AS c FROM scored)
    SELECT count_if(c - prev < -1e-12)::BIGINT AS inversions FROM (SELECT c, lag(c) OVER (ORDER BY score, c) AS prev FROM p)
""", "scored"))
def inversion_count(spark, folder):
    wiggle = F.round(F.col("score") * 1000000).cast("long") % 7 * 0.001
    return cal.inversions(scored(spark, folder).withColumn("c", F.col("score") + wiggle), "score", "c")


@add(with_tables(f"""
    SELECT CASE WHEN r <= n // 2 THEN 'early' ELSE 'late' END AS half, count(*) AS n, min(t) AS t_min, max(t) AS t_max, {q4('avg(label)')} AS rate
    FROM (SELECT t, label, row_number() OVER (ORDER BY t, txn_id) AS r, count(*) OVER () AS n FROM parted WHERE part = 'val') GROUP BY 1
""", "parted"))
def halved_validation(spark, folder):
    val = _scored_parts(spark, folder).filter(F.col("split") == "val")
    halves = cal.halve_by_time(val, "t", "txn_id").groupBy("half").agg(
        F.count(F.lit(1)).alias("n"), F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.avg("label").alias("rate"))
    return rounded(halves)


@add(with_tables(f"""
    WITH i AS (SELECT txn_id, score, row_number() OVER (ORDER BY score DESC, txn_id) - 1 AS i, count(*) OVER () AS n FROM scored)
    SELECT txn_id, {q4('score', 6)} AS score, i AS row_index FROM i
    WHERE i < 8 OR (i >= n // 3 AND i < n // 3 + 6 * (n // 12) AND (i - n // 3) % (n // 12) = 0) OR i >= n - 4
""", "scored"))
def spread_sample(spark, folder):
    rows = scored(spark, folder).select("txn_id", "score")
    return rounded(cal.spread_sample(rows, "score", "txn_id"), score=6)


def _overconfident(spark, folder):
    """Validation rows whose label follows the score, with the score pushed towards 1."""
    rows = planted(spark, folder).withColumn("raw", F.pow(F.col("score"), F.lit(0.45)))
    return sp.with_split(rows, "t", sp.boundaries(rows, "t")).filter(F.col("split") != "train")


@add()
def calibration_comparison(spark, folder):
    """Both calibrators fitted on early held-out rows and judged on the late ones."""
    held_out = cal.halve_by_time(_overconfident(spark, folder), "t", "txn_id")
    chosen, table = cal.fit_and_compare(
        held_out.filter(F.col("half") == "early"), held_out.filter(F.col("half") == "late"), "label", "raw"
    )
    return cal.comparison_table(spark, table, chosen.method)


@add(with_tables("""
    SELECT m AS method, (SELECT count(*) FROM parted WHERE part <> 'train') AS n_rows, CAST(0 AS BIGINT) AS inversions, CAST(0 AS BIGINT) AS outside
    FROM (SELECT unnest(['isotonic', 'sigmoid']) AS m)
""", "parted"))
def calibration_is_monotone(spark, folder):
    """Rows, order changes and values outside [0, 1] after each calibrator."""
    rows = _overconfident(spark, folder)
    out = None
    for method in ("isotonic", "sigmoid"):
        made = cal.Calibrator.fit(rows, "label", "raw", method).transform(rows, "raw", "p")
        row = made.agg(
            F.lit(method).alias("method"), F.count("p").alias("n_rows"),
            F.count_if(~F.col("p").between(0, 1)).alias("outside"),
        ).withColumn("inversions", cal.inversions(made, "raw", "p").scalar())
        out = row if out is None else out.unionByName(row)
    return out
