"""Fitted models, reasons, anomalies and typologies on the given tables."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from causalrisk.catalog.common import Catalog, q4, r4, rounded, with_tables
from causalrisk.catalog.intake import parted
from causalrisk.operators import boosting as bo, evaluate as ev, explain as ex, models as md
from causalrisk.operators.anomaly import IsolationForest, evaluate_anomalies
from causalrisk.operators.casefile import find_row
from causalrisk.operators.shapley import TreeShapley
from causalrisk.operators.typology import choose_k, cluster_cases, describe_clusters
from causalrisk.plans.train import build_features, calibrate_and_test, train_models, without_history
from causalrisk.session import materialise
from causalrisk.sources.tables import lineitems, planted, read_table, scored, transactions
from causalrisk.spec import EVENT_STREAM

CATALOG = Catalog()
add = CATALOG.add

SPEC = replace(EVENT_STREAM, frequency_columns=("client", "channel"), entity_keys=EVENT_STREAM.entity_keys[:1])
WEIGHTS = {"amount": (0.006, 50.0), "hour": (0.04, 12.0), "k": (-0.002, 50.0), "dist": (0.003, 40.0)}


def facts(spark, folder):
    """Transactions with the planted label; the score itself is not a feature."""
    return planted(spark, folder).drop("score", "k")


@add()
def baseline_model_quality(spark, folder):
    features = build_features(facts(spark, folder), SPEC)
    model = train_models(features, SPEC.target, trees=False)["baseline"]
    rows = md.score_rows(model, features.part("val"), "score", [SPEC.id, SPEC.target])
    return ev.ranking_metrics(ev.score_curve(rows, SPEC.target, "score"), "score")


@add()
def boosted_trees_quality(spark, folder):
    """Boosted trees against the logistic baseline on the validation part."""
    features = build_features(facts(spark, folder), SPEC)
    models = train_models(features, SPEC.target, maxIter=20, stepSize=0.1, maxDepth=4)
    variants = {
        name: md.score_rows(m, features.part("val"), "score", [SPEC.id, SPEC.target]) for name, m in models.items()
    }
    return ev.compare_variants(variants, SPEC.target, "score")


@add()
def calibrated_test_report(spark, folder):
    features = build_features(facts(spark, folder), SPEC)
    model = train_models(features, SPEC.target, trees=False)["baseline"]
    return calibrate_and_test(features, model, SPEC)[2]


@add()
def history_feature_comparison(spark, folder):
    """The same model and protocol with and without entity history."""
    features = build_features(facts(spark, folder), SPEC)
    variants = {}
    # Both read one stored table; history changes no other column.
    for name, used in (("with history", features), ("without history", without_history(features, SPEC))):
        model = train_models(used, SPEC.target, trees=False)["baseline"]
        variants[name] = md.score_rows(model, used.part("val"), "score", [SPEC.id, SPEC.target])
    return ev.compare_variants(variants, SPEC.target, "score")


@add(with_tables(f"""
    SELECT floor(count_if(label = 0) / greatest(count_if(label = 1), 1) * 10000 + 0.500001) / 10000 AS weight FROM parted WHERE part = 'train'
""", "parted"))
def imbalance_weight(spark, folder):
    train = parted(spark, folder).filter(F.col("split") == "train")
    return rounded(spark.createDataFrame([(float(md.imbalance_weight(train, "label")),)], "weight double"))


@add("""
    WITH l AS (SELECT 'o_orderpriority' AS "column", o_orderpriority AS value FROM orders
        UNION ALL SELECT 'month', strftime(o_orderdate, '%Y-%m') FROM orders),
    c AS (SELECT "column", value, count(*) AS n, sum(count(*)) OVER (PARTITION BY "column") AS total FROM l GROUP BY 1, 2)
    SELECT "column", string_agg(value, ',' ORDER BY n DESC, value) AS levels FROM c WHERE n >= total * 0.01 GROUP BY 1
""")
def frequent_levels(spark, folder):
    """Levels that keep their own indicator; the rest are pooled."""
    orders = read_table(spark, folder, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    levels = md.frequent_levels(orders, ["o_orderpriority", "month"])
    return spark.createDataFrame([(c, ",".join(v)) for c, v in levels.items()], "column string, levels string")


@add(with_tables("""
    SELECT txn_id, score, CASE WHEN score >= 0.9 THEN 'CRITICAL' WHEN score >= 0.7 THEN 'HIGH' WHEN score >= 0.4 THEN 'MEDIUM'
           WHEN score >= 0.15 THEN 'LOW' ELSE 'MINIMAL' END AS risk_band,
           CASE WHEN score >= 0.9 THEN 'DECLINE' WHEN score >= 0.35 THEN 'REVIEW' ELSE 'APPROVE' END AS decision FROM scored
""", "scored"))
def bands_and_decisions(spark, folder):
    p = F.col("score")
    return scored(spark, folder).select(
        "txn_id", "score", md.risk_band(p).alias("risk_band"), md.decision(p, 0.35).alias("decision"))


@add(with_tables("""
    SELECT txn_id, t, CAST(NULL AS VARCHAR) AS browser, TRY_CAST(channel AS DOUBLE) AS amount,
           CASE WHEN channel IN ('click', 'view') THEN channel END AS channel FROM txn
""", "txn"))
def aligned_request_rows(spark, folder):
    """Rows that lack a column, hold text for a number and carry unseen categories."""
    rows = transactions(spark, folder).select("channel", "t", "txn_id", F.col("channel").alias("amount"))
    schema = {"txn_id": "bigint", "t": "bigint", "browser": "string", "amount": "double", "channel": "string"}
    return md.align_to_schema(rows, schema, {"channel": ["click", "view"]})


@add(with_tables("""
    SELECT coalesce(CASE WHEN k % 2 <> 0 THEN txn_id END, 0) AS txn_id, coalesce(CASE WHEN k % 3 <> 0 THEN t END, 86400) AS t, amount FROM txn
""", "txn"))
def serving_defaults(spark, folder):
    """Requests of which some lack the id and some the time."""
    k = F.col("k")
    rows = transactions(spark, folder).select(
        F.when(k % 2 != 0, F.col("txn_id")).alias("txn_id"), F.when(k % 3 != 0, F.col("t")).alias("t"), "amount")
    return md.with_serving_defaults(rows, "txn_id", "t")


@add(with_tables("SELECT txn_id, t, amount, channel FROM txn WHERE txn_id = (SELECT max(txn_id) FROM txn WHERE label = 1)", "txn"))
def case_lookup(spark, folder):
    """The newest confirmed case, looked up by its id."""
    rows = transactions(spark, folder)
    newest = rows.where("label = 1").agg(F.max("txn_id")).first()[0]
    return find_row(rows.select("txn_id", "t", "amount", "channel"), "txn_id", newest)


# ------------------------------------------------------------------ reasons ---
def with_reasons(spark, folder):
    """The closed-form score with the reasons of its linear margin."""
    rows = scored(spark, folder, spread=True).withColumn("hour", F.floor(F.col("t") / 3600) % 24)
    return rows.withColumn("reasons", ex.scorecard_reasons(WEIGHTS, dict(rows.dtypes)))


REASONS = f"""
    h AS (SELECT *, CAST(floor(t / 3600) AS BIGINT) % 24 AS hour FROM scored),
    r AS (SELECT txn_id, 'amount' AS feature, amount::DOUBLE AS value, coalesce((amount - 50.0::DOUBLE) * 0.006::DOUBLE, 0) AS c FROM h
        UNION ALL SELECT txn_id, 'hour', hour, coalesce((hour - 12.0::DOUBLE) * 0.04::DOUBLE, 0) FROM h
        UNION ALL SELECT txn_id, 'k', k, coalesce((k - 50.0::DOUBLE) * -0.002::DOUBLE, 0) FROM h
        UNION ALL SELECT txn_id, 'dist', dist, coalesce((dist - 40.0::DOUBLE) * 0.003::DOUBLE, 0) FROM h),
    top AS (SELECT *, row_number() OVER (PARTITION BY txn_id ORDER BY abs(c) DESC, feature) AS position FROM r)
"""


@add(with_tables(f"""WITH {REASONS}
    SELECT txn_id, position, feature, {q4('value')} AS value, {q4('c')} AS contribution,
           CASE WHEN c > 0 THEN 'increases risk' ELSE 'decreases risk' END AS direction FROM top WHERE position <= 3""", "scored"))
def top_reasons(spark, folder):
    rows = with_reasons(spark, folder)
    top = rows.select("txn_id", ex.top_reasons(F.col("reasons"), 3).alias("reasons"))
    return rounded(ex.reason_rows(top, "txn_id"))


@add(with_tables(f"""WITH {REASONS} SELECT feature, {q4('avg(abs(c))')} AS importance FROM r GROUP BY feature""", "scored"))
def global_importance(spark, folder):
    return rounded(ex.global_importance(with_reasons(spark, folder)))


@add(with_tables(f"""WITH {REASONS}, g AS (SELECT feature, avg(abs(c)) AS i FROM r GROUP BY feature)
    SELECT arg_max(feature, i) AS top_feature, {q4('max(i) / sum(i)')} AS top_feature_share,
           coalesce(string_agg(feature, ', ' ORDER BY i DESC) FILTER (i > 0.35 * (SELECT sum(i) FROM g)), '') AS suspects,
           CASE WHEN max(i) / sum(i) > 0.35 THEN 'LEAKAGE SUSPECT - one feature dominates; verify it is knowable at prediction time'
                ELSE 'healthy - importance is spread across many features, which is what genuine fraud signal looks like' END AS verdict FROM g""", "scored"))
def leakage_audit(spark, folder):
    return rounded(ex.leakage_audit(ex.global_importance(with_reasons(spark, folder))))


def explained_models(spark, folder, show):
    """Name, explained validation rows and base value of both fitted models; values of `show` are put into words."""
    features = build_features(facts(spark, folder), SPEC, with_history=False)
    models = train_models(features, SPEC.target, maxIter=10, stepSize=0.1, maxDepth=4)
    raw = [SPEC.id, *features.numeric, *features.categorical]
    rows = {n: materialise(md.score_rows(m, features.part("val"), "p", raw), "scored") for n, m in models.items()}
    terms = md.baseline_terms(models["baseline"], features.numeric, features.categorical)
    means = ex.training_means(models["baseline"], features.part("train"))
    yield "baseline", *ex.explain_baseline(models["baseline"], rows["baseline"], terms, means, show)
    yield "trees", *ex.explain_trees(models["trees"], rows["trees"], [*features.numeric, *features.categorical], show)


@add(with_tables("SELECT m AS model, (SELECT count(*) FROM parted WHERE part = 'val') AS n_rows, CAST(0 AS BIGINT) AS off FROM (SELECT unnest(['baseline', 'trees']) AS m)", "parted"))
def reasons_add_up(spark, folder):
    """Rows whose base value and reasons do not sum to the model's log-odds."""
    out = None
    for name, explained, base in explained_models(spark, folder, ()):
        total = F.aggregate("reasons", F.lit(base), lambda s, r: s + r["contribution"])
        row = explained.agg(
            F.lit(name).alias("model"), F.count(F.lit(1)).alias("n_rows"),
            F.count_if(F.abs(F.lit(1.0) / (1 + F.exp(-total)) - F.col("p")) > 1e-6).alias("off"),
        )
        out = row if out is None else out.unionByName(row)
    return out


@add(with_tables(f"""
    WITH st AS (SELECT unnest([1, 2, 3, 4]) AS stage),
    x AS (SELECT stage, label, CAST(floor(score * power(4, stage)) AS BIGINT) AS m FROM scored CROSS JOIN st),
    g AS (SELECT stage, m, count(*) AS n, sum(label) AS pos FROM x GROUP BY ALL),
    c AS (SELECT *, sum(n) OVER w AS cn, sum(pos) OVER w AS cp, sum(pos) OVER (PARTITION BY stage) AS tp FROM g WINDOW w AS (PARTITION BY stage ORDER BY m DESC))
    SELECT CAST(stage AS BIGINT) AS stage, {q4('sum(pos / tp * cp / cn)')} AS pr_auc FROM c GROUP BY stage
""", "scored"))
def precision_by_stage(spark, folder):
    """Average precision of each stage of a score that gets finer from stage to stage, as early stopping reads it."""
    stages = F.explode(F.array(*map(F.lit, range(1, 5)))).alias("stage")
    staged = scored(spark, folder).select("label", "score", stages).withColumn("margin", F.floor(F.col("score") * F.pow(F.lit(4.0), "stage")))
    return rounded(bo.precision_by_stage(staged, "label").select("stage", "pr_auc"))


@add(with_tables("SELECT 'trees' AS model, (SELECT count(*) FROM parted WHERE part = 'val') AS n_rows, CAST(0 AS BIGINT) AS off, 1 AS base_is_mean", "parted"))
def shapley_reasons_add_up(spark, folder):
    """Rows whose base value and exact Shapley values do not sum to the log-odds; the base is the training rows' mean margin."""
    features = build_features(facts(spark, folder), SPEC, with_history=False)
    inputs = [*features.numeric, *features.categorical]
    train = features.part("train")
    model = md.fit_boosted_trees(train, features.numeric, features.categorical, SPEC.target, maxIter=10, stepSize=0.1, maxDepth=4)
    shapley = TreeShapley.fit(model, train)
    explained = shapley.explain(md.score_rows(model, features.part("val"), "p", [SPEC.id, *inputs]), inputs, show=())
    total = F.aggregate("reasons", F.lit(shapley.base), lambda s, r: s + r["contribution"])
    mean = md.score_rows(model, train, "p", [SPEC.id]).agg(F.avg(F.log(F.col("p") / (1 - F.col("p"))))).scalar()
    return explained.agg(
        F.lit("trees").alias("model"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.abs(F.lit(1.0) / (1 + F.exp(-total)) - F.col("p")) > 1e-6).alias("off"),
    ).withColumn("base_is_mean", (F.abs(mean - shapley.base) < 1e-6).cast("int"))


@add(with_tables("""
    SELECT model, txn_id, feature, shown FROM (SELECT unnest(['baseline', 'trees']) AS model), (
        SELECT txn_id, 'k_obs' AS feature, coalesce(CAST(k_obs AS VARCHAR), 'not recorded') AS shown FROM parted WHERE part = 'val'
        UNION ALL SELECT txn_id, 'hour', CAST(CAST(floor(t / 3600) AS BIGINT) % 24 AS VARCHAR) FROM parted WHERE part = 'val'
        UNION ALL SELECT txn_id, 'channel', channel FROM parted WHERE part = 'val'
        UNION ALL SELECT txn_id, 'k_obs_isna', CASE WHEN k_obs IS NULL THEN '1' ELSE '0' END FROM parted WHERE part = 'val')
""", "parted"))
def reasons_show_own_values(spark, folder):
    """What the reasons of both models say about whole numbers, missing values, flags and texts."""
    out = None
    columns = ("k_obs", "hour", "channel", "k_obs_isna")
    for name, explained, _ in explained_models(spark, folder, columns):
        shown = ex.shown_reasons(explained, SPEC.id, columns=columns).select(F.lit(name).alias("model"), SPEC.id, "feature", "shown")
        out = shown if out is None else out.unionByName(shown)
    return out


# ------------------------------------------------- anomalies and typologies ---
ANOMALY_COLUMNS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@add()
def anomaly_detection(spark, folder):
    """How well an unsupervised score finds the most expensive discounted lines."""
    lines = lineitems(spark, folder).select(*ANOMALY_COLUMNS, "l_orderkey", "l_partkey", "l_linenumber")
    lines = lines.withColumn("id", F.xxhash64(*lines.columns)).withColumn(
        "rare", ((F.col("l_quantity") >= 48) & (F.col("l_discount") >= 0.09)).cast("int"))
    forest = IsolationForest.fit(lines, ANOMALY_COLUMNS, "id", trees=50, sample=4096)
    return evaluate_anomalies(materialise(forest.score(lines.select("rare", *ANOMALY_COLUMNS)).select("rare", "anomaly"), "anomaly"), "rare", "anomaly")


@add()
def typologies(spark, folder):
    """Kinds of returned line items."""
    returned = lineitems(spark, folder).filter(F.col("label") == 1).select(*ANOMALY_COLUMNS)
    rows, _, _ = cluster_cases(returned, ANOMALY_COLUMNS, k=5)
    return describe_clusters(rows, "cluster", ANOMALY_COLUMNS, "l_extendedprice")


_DESC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@add(f"""
    WITH f AS (SELECT *, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END AS cluster FROM lineitem WHERE l_returnflag = 'R'),
    z AS ({' UNION ALL '.join(f"SELECT cluster, '{c}' AS feature, (avg({c}) - (SELECT avg({c}) FROM f)) / (SELECT nullif(stddev_samp({c}), 0) FROM f) AS z FROM f GROUP BY cluster" for c in _DESC)}),
    o AS (SELECT cluster, feature, z, row_number() OVER (PARTITION BY cluster ORDER BY abs(z) DESC, feature) AS p FROM z WHERE z IS NOT NULL),
    s AS (SELECT cluster, string_agg(CASE WHEN z > 0 THEN 'high ' ELSE 'low ' END || feature, ', ' ORDER BY p) AS label, max(z) FILTER (p = 1) AS top_z FROM o WHERE p <= 4 GROUP BY cluster)
    SELECT cluster::BIGINT AS cluster, count(*) AS n_cases, {q4('count(*) / (SELECT count(*) FROM f)')} AS share, {q4('avg(l_extendedprice)')} AS avg_amount,
           any_value(label) AS label, {q4('any_value(top_z)')} AS top_z FROM f JOIN s USING (cluster) GROUP BY cluster
""")
def typology_description(spark, folder):
    """The description step on groups given by a fixed rule."""
    rows = lineitems(spark, folder).filter(F.col("label") == 1).withColumn(
        "cluster", (F.col("l_quantity") > 25).cast("int") + (F.col("l_discount") > 0.05).cast("int") * 2)
    made = describe_clusters(rows, "cluster", _DESC, "l_extendedprice")
    return rounded(made.withColumn("top_z", F.col("signature")[0]["z"]).drop("signature"))


@add()
def number_of_clusters(spark, folder):
    returned = lineitems(spark, folder).filter(F.col("label") == 1).select(*ANOMALY_COLUMNS)
    return choose_k(returned, ANOMALY_COLUMNS, range(2, 9), restarts=1)
