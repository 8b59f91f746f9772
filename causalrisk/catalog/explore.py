"""Profiles, association tests and drift on the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from causalrisk.catalog.common import Catalog, q4, r4, rounded, with_tables
from causalrisk.catalog.intake import parted
from causalrisk.operators import drift, profile, sketches, stats
from causalrisk.operators.ordered import exact_quantiles
from causalrisk.session import materialise
from causalrisk.sources.files import column_levels
from causalrisk.sources.tables import lineitems, read_table, transactions

CATALOG = Catalog()
add = CATALOG.add


def labelled_documents(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    return docs.join(read_table(spark, folder, "labels"), "doc_id", "left")


_RATES = f"count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, {q4('avg(label)')} AS rate"


@add(f"""
    WITH d AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
    s AS (SELECT 'doc_id' AS "column", 'bigint' AS dtype, count(doc_id) AS p, count(DISTINCT doc_id) AS u, count(*) AS n FROM d
        UNION ALL SELECT 'lang', 'string', count(lang), count(DISTINCT lang), count(*) FROM d
        UNION ALL SELECT 'source', 'string', count(source), count(DISTINCT source), count(*) FROM d
        UNION ALL SELECT 'n_chars', 'bigint', count(n_chars), count(DISTINCT n_chars), count(*) FROM d
        UNION ALL SELECT 'quality', 'int', count(quality), count(DISTINCT quality), count(*) FROM d
        UNION ALL SELECT 'toxic', 'int', count(toxic), count(DISTINCT toxic), count(*) FROM d)
    SELECT "column", dtype, {q4('(n - p) * 100.0 / n')} AS pct_missing, n - p AS n_missing, u AS n_unique FROM s
""")
def missingness_report(spark, folder):
    return rounded(profile.missingness_report(labelled_documents(spark, folder)))


@add("""
    SELECT 'user_id' AS "column", count(*) AS n_rows, count(*) - count(user_id) AS n_missing, 1 AS within, 1 AS near_by_any_cut FROM events
    UNION ALL SELECT 'event_type', count(*), count(*) - count(event_type), 1, 1 FROM events
    UNION ALL SELECT 'value', count(*), count(*) - count(value), 1, 1 FROM events
""")
def merged_distinct_sketches(spark, folder):
    """Distinct values per column from stored sketches of each day: within the stated error of the exact count, and as near to each other however the rows are cut."""
    events = read_table(spark, folder, "events")
    columns = ["user_id", "event_type", "value"]
    days = materialise(sketches.column_sketches(events, columns, F.to_date("ts")), "sketches")
    whole = sketches.merged(sketches.column_sketches(events, columns, F.pmod(F.xxhash64("event_id"), F.lit(3)))).select("column", F.col("n_unique").alias("other_cut"))
    exact = column_levels(events, columns).select("column", "levels")
    out = sketches.merged(days).join(whole, "column").join(exact, "column")
    return rounded(out.select(
        "column", "n_rows", "n_missing", (F.abs(F.col("n_unique") - F.col("levels")) <= F.greatest(F.col("levels") * sketches.ERROR, F.lit(1.0))).cast("int").alias("within"),
        (F.abs(F.col("n_unique") - F.col("other_cut")) <= F.greatest(F.col("levels") * sketches.ERROR, F.lit(1.0))).cast("int").alias("near_by_any_cut"),
    ))



@add(f"""
    WITH d AS (SELECT d.doc_id, lang, source, quality, toxic, CASE WHEN doc_id % 3 = 0 THEN lang END AS third,
                      CASE WHEN doc_id % 3 = 1 THEN lang END AS other FROM documents d LEFT JOIN labels USING (doc_id))
    SELECT CAST(2 AS BIGINT) AS n_columns, {q4('100.0 * (count(*) - count(quality)) / count(*)')} AS pct_missing, 'quality, toxic' AS "columns" FROM d
    UNION ALL SELECT 2, 0.0, 'lang, source'
    UNION ALL SELECT 1, {q4('100.0 * (count(*) - count(third)) / count(*)')}, 'third' FROM d
    UNION ALL SELECT 1, {q4('100.0 * (count(*) - count(other)) / count(*)')}, 'other' FROM d
""")
def missingness_blocks(spark, folder):
    """Two columns with nearly equal counts but different rows stay apart."""
    docs = labelled_documents(spark, folder).withColumns({
        "third": F.when(F.col("doc_id") % 3 == 0, F.col("lang")),
        "other": F.when(F.col("doc_id") % 3 == 1, F.col("lang")),
    })
    return rounded(profile.missingness_blocks(docs, ["lang", "source", "quality", "toxic", "third", "other"], "doc_id"))


@add(with_tables(f"""
    SELECT bucket, {_RATES}, bucket * 7 AS day FROM (
        SELECT CAST(floor((t - (SELECT min(t) FROM txn)) / (7 * 86400)) AS BIGINT) AS bucket, label FROM txn)
    GROUP BY bucket
""", "txn"))
def rate_over_time(spark, folder):
    return rounded(profile.rate_over_time(transactions(spark, folder), "t", "label", bucket_days=7))


@add(with_tables(f"""
    WITH b AS (SELECT avg(label) AS rate, sum(label) AS pos, count(*) AS n FROM txn
               GROUP BY floor((t - (SELECT min(t) FROM txn)) / 86400))
    SELECT {q4('sum(pos) / sum(n)')} AS period_mean, {q4('min(rate)')} AS lowest, {q4('max(rate)')} AS highest,
           {q4('max(rate) / min(rate)')} AS swing FROM b
""", "txn"))
def rate_stability(spark, folder):
    """Lowest, highest and mean positive rate over daily buckets."""
    daily = profile.rate_over_time(transactions(spark, folder), "t", "label")
    return rounded(daily.agg(
        F.try_divide(F.sum("positives"), F.sum("n")).alias("period_mean"), F.min("rate").alias("lowest"),
        F.max("rate").alias("highest"), F.try_divide(F.max("rate"), F.min("rate")).alias("swing"),
    ))


@add(with_tables(f"""
    SELECT CAST(floor(t / 3600) AS BIGINT) % 24 AS hour, {_RATES} FROM txn GROUP BY 1
""", "txn"))
def hour_profile(spark, folder):
    return rounded(profile.hour_profile(transactions(spark, folder), "t", "label"))


@add(f"""
    WITH f AS (SELECT l_returnflag, l_linestatus, l_quantity, CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END AS label FROM lineitem),
    l AS (SELECT 'l_returnflag' AS "column", l_returnflag AS value, label FROM f
        UNION ALL SELECT 'l_linestatus', l_linestatus, label FROM f
        UNION ALL SELECT 'tier', CASE WHEN l_quantity >= 10 THEN CASE WHEN l_quantity >= 40 THEN 'large' ELSE 'medium' END END, label FROM f),
    g AS (SELECT "column", value, {_RATES}, {q4('avg(label) / (SELECT avg(label) FROM f)')} AS lift,
                 row_number() OVER (PARTITION BY "column" ORDER BY avg(label) DESC, value) AS position
          FROM l WHERE value IS NOT NULL GROUP BY "column", value HAVING count(*) >= 500)
    SELECT * FROM g WHERE position <= 8
""")
def category_rates(spark, folder):
    lines = lineitems(spark, folder).select(
        "l_returnflag", "l_linestatus",
        F.when(F.col("l_quantity") >= 40, "large").when(F.col("l_quantity") >= 10, "medium").alias("tier"),
        (F.col("l_discount") > 0.05).cast("int").alias("label"),
    )
    return rounded(profile.category_rates(lines, ["l_returnflag", "l_linestatus", "tier"], "label", min_count=500, top=8))


@add(with_tables(f"""
    WITH s AS (
        SELECT 'k_obs' AS "column", avg((k_obs IS NULL)::INT) AS m, avg(label) FILTER (k_obs IS NULL) AS a, avg(label) FILTER (k_obs IS NOT NULL) AS b FROM txn
        UNION ALL SELECT 'dist', avg((dist IS NULL)::INT), avg(label) FILTER (dist IS NULL), avg(label) FILTER (dist IS NOT NULL) FROM txn
        UNION ALL SELECT 'band', avg((band IS NULL)::INT), avg(label) FILTER (band IS NULL), avg(label) FILTER (band IS NOT NULL) FROM txn
        UNION ALL SELECT 'amount', avg((amount IS NULL)::INT), avg(label) FILTER (amount IS NULL), avg(label) FILTER (amount IS NOT NULL) FROM txn)
    SELECT "column", {q4('m * 100')} AS pct_missing, {q4('a')} AS rate_missing, {q4('b')} AS rate_present,
           {q4('abs(a - b)')} AS abs_gap, {q4('a / b')} AS ratio FROM s WHERE m > 0 AND m < 1
""", "txn"))
def missing_as_signal(spark, folder):
    return rounded(profile.missing_as_signal(transactions(spark, folder), ["k_obs", "dist", "band", "amount"], "label"))


def _summary_sql(columns: list[str]) -> str:
    one = """SELECT '{c}' AS "column", label::BIGINT AS label, count(*) AS n, count(*) - count({c}) AS missing, {mean} AS mean, {top} AS max,
        {p25} AS p25, {median} AS median, {p75} AS p75, {p99} AS p99 FROM txn GROUP BY label"""
    return " UNION ALL ".join(
        one.format(
            c=c, mean=q4(f"avg({c})"), top=q4(f"max({c})"),
            **{n: q4(f"quantile_cont({c}::DOUBLE, {p})") for p, n in ((0.25, "p25"), (0.5, "median"), (0.75, "p75"), (0.99, "p99"))},
        )
        for c in columns
    )


@add(with_tables(_summary_sql(["amount", "k_obs", "dist"]), "txn"))
def numeric_summary(spark, folder):
    return rounded(profile.numeric_summary(transactions(spark, folder), ["amount", "k_obs", "dist"], "label"))


@add(" UNION ALL ".join(
    f"SELECT {p}::DOUBLE AS prob, {q4(f'quantile_cont(l_extendedprice, {p})')} AS value FROM lineitem"
    for p in (0.01, 0.25, 0.5, 0.75, 0.99)
))
def exact_quantile_table(spark, folder):
    return rounded(exact_quantiles(lineitems(spark, folder), "l_extendedprice", [0.01, 0.25, 0.5, 0.75, 0.99]))


@add(with_tables(f"""
    SELECT count_if(label = 0)::BIGINT AS negatives, count_if(label = 1)::BIGINT AS positives, {q4('avg(label)')} AS rate,
           {q4('count_if(label = 0) / greatest(count_if(label = 1), 1)')} AS imbalance_weight FROM txn
""", "txn"))
def class_balance(spark, folder):
    return rounded(profile.class_balance(transactions(spark, folder), "label"))


@add(with_tables(f"""
    WITH b AS (SELECT label, least(CAST(floor(log10(amount) / step) AS BIGINT), 58) AS bin, step
               FROM txn, (SELECT log10(max(amount)) / 59 AS step FROM txn) WHERE amount >= 1),
    c AS (SELECT label, bin, count(*) AS n, max(step) AS step FROM b GROUP BY 1, 2)
    SELECT CAST(label AS BIGINT) AS label, bin, n, {q4('pow(10.0, bin * step)')} AS low, {q4('pow(10.0, (bin + 1) * step)')} AS high,
           {q4('n / (sum(n) OVER (PARTITION BY label)) / (pow(10.0, (bin + 1) * step) - pow(10.0, bin * step))')} AS density FROM c
""", "txn"))
def amount_histogram(spark, folder):
    return rounded(profile.log_histogram(transactions(spark, folder), "amount", "label"))


@add("""
    WITH d AS (SELECT d.doc_id, lang, source, n_chars, quality, toxic FROM documents d LEFT JOIN labels USING (doc_id)),
    m AS (SELECT unnest([0.0, 0.0, 0.0, 0.0, 100.0 * (count(*) - count(quality)) / count(*), 100.0 * (count(*) - count(toxic)) / count(*)]) AS p FROM d)
    SELECT CAST(CASE WHEN p = 0 THEN 0 ELSE 39 END AS BIGINT) AS bin, count(*) AS n_columns,
           floor(min(p)::DOUBLE * 10000 + 0.500001) / 10000 AS least, floor(max(p)::DOUBLE * 10000 + 0.500001) / 10000 AS most
    FROM m GROUP BY 1
""")
def missingness_histogram(spark, folder):
    return rounded(profile.missingness_histogram(profile.missingness_report(labelled_documents(spark, folder))))


# ---------------------------------------------------------------- statistics ---
_LINE_LEVELS = """
    f AS (SELECT l_linestatus, l_quantity, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
                 CASE WHEN l_linenumber <> 3 THEN l_linenumber::VARCHAR END AS line, (l_suppkey * 7919 + l_partkey) % 400 AS rare FROM lineitem),
    l AS (SELECT 'l_linestatus' AS "column", l_linestatus AS v, label FROM f
        UNION ALL SELECT 'line', coalesce(line, '__missing__'), label FROM f
        UNION ALL SELECT 'rare', CASE WHEN rare < 390 THEN 'common' ELSE rare::VARCHAR END, label FROM f),
    k AS (SELECT "column", v, CASE WHEN count(*) >= 160 THEN v ELSE '__other__' END AS level FROM l GROUP BY 1, 2),
    cell AS (SELECT "column", level, y, sum((label = y)::INT)::BIGINT AS n
             FROM l JOIN k USING ("column", v), (SELECT unnest([0, 1]) AS y) GROUP BY 1, 2, 3),
    e AS (SELECT *, sum(n) OVER (PARTITION BY "column", level)::DOUBLE * sum(n) OVER (PARTITION BY "column", y)
                    / sum(n) OVER (PARTITION BY "column") AS expected FROM cell),
    chi AS (SELECT "column", sum(pow(n - expected, 2) / expected) AS statistic, count(DISTINCT level) - 1 AS dof, sum(n)::BIGINT AS n
            FROM e WHERE expected > 0 GROUP BY 1 HAVING count(DISTINCT level) > 1)
"""


def _line_levels(spark, folder):
    mixed = (F.col("l_suppkey") * 7919 + F.col("l_partkey")) % 400
    return lineitems(spark, folder).select(
        "l_linestatus", "label", "l_quantity", "l_discount", "l_extendedprice",
        F.when(F.col("l_linenumber") != 3, F.col("l_linenumber")).alias("line"),
        F.when(mixed < 390, "common").otherwise(mixed.cast("string")).alias("rare"),
    )


@add(f'WITH {_LINE_LEVELS} SELECT "column", level, CAST(y AS BIGINT) AS y, n FROM cell')
def contingency_table(spark, folder):
    return rounded(stats.contingency(_line_levels(spark, folder), ["l_linestatus", "line", "rare"], "label", min_count=160))


@add(f"""WITH {_LINE_LEVELS} SELECT "column", {q4('statistic')} AS statistic, dof, n, {q4('sqrt(statistic / n)')} AS effect_size FROM chi""")
def chi_square_test(spark, folder):
    return rounded(stats.chi_square(_line_levels(spark, folder), ["l_linestatus", "line", "rare"], "label", min_count=160))


def _ranks_sql(columns: list[str]) -> str:
    long = " UNION ALL ".join(f"""SELECT '{c}' AS "column", {c}::DOUBLE AS v, label FROM f WHERE {c} IS NOT NULL""" for c in columns)
    return f"""
    f AS (SELECT l_quantity, l_discount, l_extendedprice, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
    l AS ({long}),
    g AS (SELECT "column", v, count(*) AS n, sum(label) AS n1 FROM l GROUP BY 1, 2),
    m AS (SELECT *, sum(n) OVER (PARTITION BY "column" ORDER BY v) - (n - 1) / 2.0::DOUBLE AS mid FROM g),
    a AS (SELECT "column", sum(n1 * mid)::DOUBLE AS r1, sum(n::DOUBLE * n * n - n) AS ties, sum(n)::DOUBLE AS total, sum(n1)::DOUBLE AS n1 FROM m GROUP BY 1),
    u AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS stat, total - n1 AS n0 FROM a),
    mw AS (SELECT *, (abs(stat - n1 * n0 / 2) - 0.5) / sqrt(n1 * n0 / 12 * ((total + 1) - ties / (total * (total - 1)))) AS z FROM u)
    """


@add(f"""WITH {_ranks_sql(['l_quantity', 'l_discount', 'l_extendedprice'])}
    SELECT "column", {q4('stat')} AS statistic, n1::BIGINT AS n1, n0::BIGINT AS n0, {q4('z')} AS z,
           {q4('stat * 2 / (n1 * n0) - 1')} AS effect_size FROM mw""")
def rank_test(spark, folder):
    return rounded(stats.rank_test(_line_levels(spark, folder), ["l_quantity", "l_discount", "l_extendedprice"], "label"))


@add()
def test_battery(spark, folder):
    return stats.test_battery(
        _line_levels(spark, folder), "label", ["l_linestatus", "line", "rare"], ["l_quantity", "l_discount", "l_extendedprice"]
    )


# --------------------------------------------------------------------- drift ---
def _psi_sql(columns: list[str], source: str, ref: str, cur: str, bins: int = 10) -> str:
    parts = []
    for c in columns:
        probs = ", ".join(repr(i / bins) for i in range(bins + 1))
        parts.append(f"""
        SELECT '{c}' AS "column", CASE WHEN (SELECT count(*) FROM e_{c}) < 3 THEN 0.0 ELSE
            sum((greatest(a, 1e-6) - greatest(e, 1e-6)) * ln(greatest(a, 1e-6) / greatest(e, 1e-6))) END AS psi FROM (
            SELECT bin, count(*) FILTER ({cur})::DOUBLE / sum(count(*) FILTER ({cur})) OVER () AS a,
                   count(*) FILTER ({ref})::DOUBLE / sum(count(*) FILTER ({ref})) OVER () AS e
            FROM (SELECT *, (SELECT count(*) FROM e_{c} WHERE q > (SELECT min(q) FROM e_{c}) AND q < (SELECT max(q) FROM e_{c}) AND q <= {c}) AS bin
                  FROM {source} WHERE {c} IS NOT NULL) GROUP BY bin)""")
    edges = ", ".join(
        f"e_{c} AS (SELECT DISTINCT unnest(quantile_cont({c}::DOUBLE, [{', '.join(repr(i / bins) for i in range(bins + 1))}])) AS q FROM {source} WHERE {ref})"
        for c in columns
    )
    return f"""WITH {edges}, p AS ({' UNION ALL '.join(parts)})
    SELECT "column", {q4('psi')} AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate shift' ELSE 'MAJOR SHIFT' END AS verdict FROM p"""


@add(with_tables(_psi_sql(["amount", "k_obs", "dist", "label"], "parted", "part = 'train'", "part = 'test'"), "parted"))
def psi_train_test(spark, folder):
    rows = parted(spark, folder)
    part = F.col("split")
    return rounded(drift.psi_table(rows, ["amount", "k_obs", "dist", "label"],
                                   F.coalesce(part == "train", F.lit(False)), F.coalesce(part == "test", F.lit(False))))


@add("WITH f AS (SELECT *, l_shipdate < TIMESTAMP '1998-01-01' AS old FROM lineitem), z AS (SELECT 1) SELECT * FROM ("
     + _psi_sql(["l_quantity", "l_extendedprice", "l_discount", "l_shipkey"], "f2", "old", "NOT old").replace(
         "WITH e_", "WITH f2 AS (SELECT *, l_orderkey + l_quantity * 10 + CASE WHEN old THEN 0 ELSE 5000 END AS l_shipkey FROM f), e_", 1) + ")")
def psi_lineitem(spark, folder):
    """Two periods of line items; `l_shipkey` is shifted on purpose in the later one."""
    old = F.col("t") < 883612800
    lines = lineitems(spark, folder).withColumn(
        "l_shipkey", F.col("l_orderkey") + F.col("l_quantity") * 10 + F.when(old, 0).otherwise(5000)
    )
    return rounded(drift.psi_table(lines, ["l_quantity", "l_extendedprice", "l_discount", "l_shipkey"], old, ~old))
