"""Sources, contract checks, enrichment, row features, split and entity history."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from causalrisk.catalog.common import Catalog, long, q4, r4, rounded, with_tables
from causalrisk.functions.rowwise import (
    add_entity_keys, add_reference_days, add_row_features, domain_features,
)
from causalrisk.operators import contracts, enrich as en, split as sp
from causalrisk.operators.encode import FrequencyEncoder, fit_frequencies, select_recent
from causalrisk.operators.entity import entity_history
from causalrisk.session import shared_folder
from causalrisk.sources.bucketed import exchanges, write_bucketed
from causalrisk.sources.files import low_cardinality_columns, read_csv
from causalrisk.sources.sinks import write_fact, write_section
from causalrisk.sources.tables import lineitems, read_table, transactions
from causalrisk.spec import EVENT_STREAM, DatasetSpec, EntityKey

CATALOG = Catalog()
add = CATALOG.add


def identity(spark, folder):
    """A sparse one-to-one side table drawn from the events: a quarter of them have a device."""
    return transactions(spark, folder).filter(F.col("k") % 4 == 0).select(
        "txn_id",
        F.when(F.col("k") < 50, "mobile").otherwise("desktop").alias("device"),
        (F.col("k") * 0.5).alias("signal"),
    )


def parted(spark, folder):
    txns = transactions(spark, folder)
    return sp.with_split(txns, "t", sp.boundaries(txns, "t"))


# ---------------------------------------------------------------- contract ---
@add("""
    SELECT count(*) AS n_rows, count(DISTINCT line_key) AS n_keys,
           count(line_key) - count(DISTINCT line_key) AS duplicates, count(*) - count(line_key) AS null_keys
    FROM (SELECT l_orderkey * 10 + l_linenumber AS line_key FROM lineitem)
""")
def contract_line_key(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    return contracts.key_report(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key")), "line_key")


@add("""
    SELECT line_key, count(*) AS n FROM (SELECT l_orderkey * 10 + l_linenumber AS line_key FROM lineitem)
    GROUP BY line_key HAVING count(*) > 1
""")
def contract_duplicate_keys(spark, folder):
    lines = read_table(spark, folder, "lineitem")
    return contracts.duplicate_keys(lines.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line_key")), "line_key")


@add(with_tables("""
    WITH c AS (SELECT count(txn_id) - count(DISTINCT txn_id) AS a, count(*) - count(txn_id) AS b,
           count(*) - count(label) AS c, count_if(label NOT IN (0, 1)) AS d, count(*) - count(t) AS e,
           count_if(t < 0) AS f, CASE WHEN abs(avg(label) - 0.2) > 0.01 THEN 1 ELSE 0 END AS g FROM txn),
    r AS (SELECT 'unique_key' AS "check", a AS violations FROM c UNION ALL SELECT 'null_key', b FROM c
          UNION ALL SELECT 'label_present', c FROM c UNION ALL SELECT 'label_allowed', d FROM c
          UNION ALL SELECT 'time_present', e FROM c UNION ALL SELECT 'time_not_negative', f FROM c
          UNION ALL SELECT 'positive_rate', g FROM c)
    SELECT "check", CAST(violations AS BIGINT) AS violations, CAST(violations = 0 AS BIGINT) AS ok FROM r
""", "txn"))
def contract_events(spark, folder):
    report = contracts.fact_report(
        transactions(spark, folder), "txn_id", "label", "t", expected_rate=0.2, tolerance=0.01
    )
    return rounded(report)


@add("""
    WITH j AS (SELECT l_orderkey * 10 + l_linenumber AS k, CASE l_linestatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 END AS y,
                      CAST(epoch(l_shipdate) AS BIGINT) - 946684800 AS t FROM lineitem),
    c AS (SELECT count(k) - count(DISTINCT k) AS a, count_if(y NOT IN (0, 1)) AS b, count_if(t < 0) AS c FROM j)
    SELECT "check", CAST(violations AS BIGINT) AS violations, CAST(violations = 0 AS BIGINT) AS ok FROM (
        SELECT 'unique_key' AS "check", a AS violations FROM c UNION ALL SELECT 'null_key', 0
        UNION ALL SELECT 'label_present', 0 UNION ALL SELECT 'label_allowed', b FROM c
        UNION ALL SELECT 'time_present', 0 UNION ALL SELECT 'time_not_negative', c FROM c)
""")
def contract_violations(spark, folder):
    """The negative case: repeated keys, a label outside the domain, times before the origin."""
    bad = lineitems(spark, folder).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"),
        F.when(F.col("l_linestatus") == "O", 2).otherwise(0).alias("y"),
        (F.col("t") - 946684800).alias("t"),
    )
    return rounded(contracts.fact_report(bad, "k", "y", "t"))


@add("""
    SELECT count(*) AS orphans FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')
""")
def orphan_labels(spark, folder):
    english = read_table(spark, folder, "documents").filter(F.col("lang") == "en")
    return contracts.orphan_count(read_table(spark, folder, "labels"), english, "doc_id")


@add("SELECT count(*) AS orphans FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def orphan_lineitems(spark, folder):
    orders = read_table(spark, folder, "orders").filter(F.col("o_orderstatus") == "F")
    lines = read_table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return contracts.orphan_count(lines, orders, "o_orderkey")


# -------------------------------------------------------------- enrichment ---
@add("""
    SELECT d.doc_id, d.lang, CAST(l.quality AS BIGINT) AS quality, CAST(l.toxic AS BIGINT) AS toxic,
           CAST(l.doc_id IS NOT NULL AS BIGINT) AS matched
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def enrich_documents(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id", "lang")
    joined = en.enrich(docs, read_table(spark, folder, "labels"), "doc_id")
    return rounded(joined.withColumnRenamed(en.MATCHED, "matched"))


@add(f"""
    SELECT count(l.doc_id) AS matched, count(*) AS n_rows, {q4('count(l.doc_id) / count(*)')} AS coverage
    FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def enrich_coverage(spark, folder):
    docs = read_table(spark, folder, "documents").select("doc_id")
    return rounded(en.coverage(en.enrich(docs, read_table(spark, folder, "labels").select("doc_id"), "doc_id", check=False)))


@add("SELECT count(*) AS rows_before, count(*) AS rows_after, CAST(1 AS BIGINT) AS ok FROM orders")
def enrich_row_count(spark, folder):
    orders = read_table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = en.enrich(orders, read_table(spark, folder, "customer"), "c_custkey", check=False)
    return rounded(en.row_count_change(joined, orders))


@add(with_tables(f"""
    WITH i AS (SELECT txn_id FROM txn WHERE k % 4 = 0)
    SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives, count_if(label = 0)::BIGINT AS negatives,
           {q4('avg(label)')} AS positive_rate, {q4('count_if(label = 0) / greatest(sum(label), 1)')} AS imbalance_ratio,
           min(t) AS t_min, max(t) AS t_max, {q4('(max(t) - min(t)) / 86400')} AS span_days,
           count(i.txn_id) AS matched, {q4('count(i.txn_id) / count(*)')} AS coverage
    FROM txn LEFT JOIN i USING (txn_id)
""", "txn"))
def ingest_manifest(spark, folder):
    joined = en.enrich(transactions(spark, folder), identity(spark, folder), "txn_id")
    return rounded(en.manifest(joined, "label", "t"))


@add()
def table_fingerprint(spark, folder):
    return en.table_fingerprint(read_table(spark, folder, "lineitem"))


@add("""
    WITH s AS (SELECT 'o_orderstatus' AS "column", count(DISTINCT o_orderstatus) AS levels, count(*) AS n FROM orders
        UNION ALL SELECT 'o_orderpriority', count(DISTINCT o_orderpriority), count(*) FROM orders)
    SELECT "column", levels, n AS rows, CAST(levels <= n * 0.5 AS BIGINT) AS categorical FROM s
""")
def low_cardinality(spark, folder):
    return rounded(low_cardinality_columns(read_table(spark, folder, "orders")))


@add("""
    WITH s AS (SELECT 'c_name' AS "column", count(DISTINCT c_name) AS levels, count(*) AS n FROM customer
        UNION ALL SELECT 'c_mktsegment', count(DISTINCT c_mktsegment), count(*) FROM customer)
    SELECT "column", levels, n AS rows, CAST(levels <= n * 0.5 AS BIGINT) AS categorical FROM s
""")
def low_cardinality_unique_name(spark, folder):
    return rounded(low_cardinality_columns(read_table(spark, folder, "customer")))


@add("""
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority AS o_order_priority FROM orders
""")
def csv_round_trip(spark, folder):
    """`orders` written as CSV with a hyphenated header and read back by an explicit schema."""
    orders = read_table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_orderpriority").alias("o_order-priority"))
    path = f"{shared_folder(spark).rstrip('/')}/orders-{uuid.uuid4().hex}"
    orders.write.csv(path, header=True)
    return read_csv(spark, path, orders.schema)


@add(with_tables("SELECT count(*) AS n_rows, min(t) AS t_min, max(t) AS t_max, CAST(0 AS BIGINT) AS overlaps FROM txn", "txn"))
def time_ordered_fact_table(spark, folder):
    """The fact table written in time order, and how many of its files overlap in time."""
    path = f"{shared_folder(spark).rstrip('/')}/fact-{uuid.uuid4().hex}"
    write_fact(transactions(spark, folder), path, "t", "txn_id")
    key = F.struct("t", "txn_id")
    files = spark.read.parquet(path).groupBy(F.input_file_name().alias("file")).agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))
    listed = files.agg(F.sort_array(F.collect_list(F.struct("low", "high", "n"))).alias("f"))
    pairs = F.zip_with(F.slice("f", 1, F.size("f") - 1), F.slice("f", 2, F.size("f") - 1), lambda a, b: (a["high"] >= b["low"]).cast("long"))
    return listed.select(
        F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_rows"),
        F.array_min("f")["low"]["t"].alias("t_min"), F.array_max(F.transform("f", lambda x: x["high"]["t"])).alias("t_max"),
        F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x).alias("overlaps"),
    )


@add("""
    SELECT 'lineitem' AS section, l_returnflag AS name, count(*) AS n FROM lineitem GROUP BY l_returnflag
    UNION ALL SELECT 'orders', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority
""")
def section_merge(spark, folder):
    """Two result sections, the second one written again: the first stays."""
    path = f"{shared_folder(spark).rstrip('/')}/sections-{uuid.uuid4().hex}"

    def counts(section, table, column):
        rows = read_table(spark, folder, table).groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("n"))
        return rows.withColumn("section", F.lit(section))

    write_section(counts("lineitem", "lineitem", "l_returnflag").unionByName(counts("orders", "orders", "o_orderstatus")), path)
    write_section(counts("orders", "orders", "o_orderpriority"), path)
    return spark.read.schema("name string, n long, section string").parquet(path)


# ------------------------------------------------------------ row features ---
@add(with_tables(f"""
    SELECT txn_id, {q4('ln(1 + amount)')} AS amt_log, {q4('amount - floor(amount)')} AS amt_cents,
           CAST(amount = floor(amount) AS BIGINT) AS amt_is_round,
           CAST(floor(t / 3600) AS BIGINT) % 24 AS hour, CAST(floor(t / 86400) AS BIGINT) % 7 AS dayofweek,
           CAST(CAST(floor(t / 3600) AS BIGINT) % 24 <= 6 AS BIGINT) AS is_night,
           CAST(k_obs IS NULL AS BIGINT) AS k_obs_isna, CAST(dist IS NULL AS BIGINT) AS dist_isna,
           CAST((k_obs IS NULL)::INT + (dist IS NULL)::INT + (band IS NULL)::INT AS BIGINT) AS n_missing
    FROM txn
""", "txn"))
def row_features(spark, folder):
    made = add_row_features(transactions(spark, folder), EVENT_STREAM)
    return rounded(made.select(
        "txn_id", "amt_log", "amt_cents", "amt_is_round", "hour", "dayofweek", "is_night",
        "k_obs_isna", "dist_isna", "n_missing",
    ))


@add("""
    WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS payer,
                      CASE WHEN url NOT LIKE '%#%' THEN regexp_replace(regexp_extract(url, '^https?://([^/?#]+)', 1), '^(m|www)[.]', '') END AS receiver
               FROM pages)
    SELECT page_id, split_part(payer, '.', 1) AS payer_provider, split_part(payer, '.', -1) AS payer_suffix,
           coalesce(split_part(receiver, '.', 1), '__missing__') AS receiver_provider,
           coalesce(split_part(receiver, '.', -1), '__missing__') AS receiver_suffix,
           CAST(payer = receiver AS BIGINT) AS email_domains_match
    FROM p
""")
def domain_parts(spark, folder):
    host = F.regexp_extract("url", r"^https?://([^/?#]+)", 1)
    pages = read_table(spark, folder, "pages").select(
        "page_id", host.alias("payer"),
        F.when(~F.col("url").contains("#"), F.regexp_replace(host, r"^(m|www)[.]", "")).alias("receiver"),
    )
    made = pages.withColumns(domain_features(pages.columns, ("payer", "receiver")))
    return rounded(made.drop("payer", "receiver"))


@add(with_tables(f"""
    SELECT txn_id, {q4('t / 86400')} AS day, CAST(floor(t / 86400 - k_obs) AS BIGINT) AS k_obsn FROM txn
""", "txn"))
def reference_days(spark, folder):
    spec = DatasetSpec("txn_id", "t", "amount", "label", day_offsets=("k_obs",))
    made = add_reference_days(transactions(spark, folder), spec)
    return rounded(made.select("txn_id", "day", "k_obsn"))


@add(with_tables("""
    SELECT txn_id, concat_ws('_', client::VARCHAR, coalesce(band, 'na'), coalesce(k_obs::VARCHAR, 'na')) AS uid,
           concat_ws('_', client::VARCHAR, coalesce(band, 'na'), coalesce(k_obs::VARCHAR, 'na'), channel, 'na') AS uid2
    FROM txn
""", "txn"))
def entity_keys(spark, folder):
    spec = DatasetSpec("txn_id", "t", "amount", "label", entity_keys=(
        EntityKey("uid", ("client", "band", "k_obs"), "na"),
        EntityKey("uid2", ("client", "band", "k_obs", "channel", "absent"), "na"),
    ))
    return add_entity_keys(transactions(spark, folder), spec).select("txn_id", "uid", "uid2")


# ------------------------------------------------------------------- split ---
@add(with_tables("SELECT te AS train_end, vs AS val_start, ve AS val_end, ts0 AS test_start, CAST(86400 AS BIGINT) AS embargo FROM cuts", "cuts"))
def split_boundaries(spark, folder):
    cut = sp.boundaries(transactions(spark, folder), "t")
    return spark.createDataFrame([vars(cut)], "train_end long, val_start long, val_end long, test_start long, embargo long")


@add(with_tables("""
    SELECT p.part, r.rule, CASE r.rule WHEN 'has rows' THEN n > 0 WHEN 'has positives' THEN y > 0 ELSE coalesce(low > before, true) END AS ok
    FROM (SELECT *, lag(high) OVER (ORDER BY place) AS before FROM (
        SELECT q.part, place, count(txn_id) AS n, coalesce(sum(label), 0) AS y, min(t) AS low, max(t) AS high
        FROM (VALUES (0, 'train'), (1, 'val'), (2, 'test')) q(place, part) LEFT JOIN parted ON parted.part = q.part GROUP BY ALL)) p,
        (SELECT unnest(['has rows', 'has positives', 'follows the part before']) AS rule) r
""", "parted"))
def split_safety(spark, folder):
    """The rules that every part of the split has to keep."""
    return sp.split_report(sp.split_summary(parted(spark, folder), "label", "t"))


@add(with_tables("SELECT txn_id, part FROM parted", "parted"))
def split_assignment(spark, folder):
    return parted(spark, folder).select("txn_id", F.col("split").alias("part"))


@add(with_tables(f"""
    SELECT coalesce(part, 'dropped') AS part, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives,
           {q4('avg(label)')} AS positive_rate, min(t) AS t_min, max(t) AS t_max,
           {q4('(max(t) - min(t)) / 86400')} AS span_days, {q4('count(*) / (SELECT count(*) FROM txn)')} AS share
    FROM parted GROUP BY 1
""", "parted"))
def split_summary(spark, folder):
    return rounded(sp.split_summary(parted(spark, folder), "label", "t"))


# ---------------------------------------------------------- entity history ---
def _history_sql(key: str, by: str, order: str, t: str, amount: str) -> str:
    w = f"PARTITION BY {by} ORDER BY {order}"
    prior = f"({w} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
        row_number() OVER ({w}) - 1 AS {key}_count_prior,
        {q4(f'avg({amount}) OVER {prior}')} AS {key}_amt_mean_prior,
        {q4(f'stddev_pop({amount}) OVER {prior}')} AS {key}_amt_std_prior,
        {q4(f'{amount} / avg({amount}) OVER {prior}')} AS {key}_amt_ratio,
        {t} - lag({t}) OVER ({w}) AS {key}_secs_since_last,
        count(*) OVER (PARTITION BY {by} ORDER BY {t} RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS {key}_txns_last_day"""


@add(with_tables(f"""
    SELECT txn_id, {_history_sql('client', 'client', 't, txn_id', 't', 'amount')},
           {_history_sql('pair', 'client, channel', 't, txn_id', 't', 'amount')}
    FROM txn
""", "txn"))
def entity_history_events(spark, folder):
    made = entity_history(transactions(spark, folder), EVENT_STREAM.entity_keys, "t", "amount", ("txn_id",))
    names = [c for c in made.columns if c.startswith(("client_", "pair_"))]
    return rounded(made.select("txn_id", *names))


@add(with_tables(f"""
    SELECT txn_id, {_history_sql('client', 'client', 't, txn_id', 't', 'amount')},
           {_history_sql('pair', 'client, channel', 't, txn_id', 't', 'amount')}, CAST(0 AS BIGINT) AS exchanges
    FROM txn
""", "txn"))
def entity_history_of_buckets(spark, folder):
    """Entity history over the transactions laid out by client, and how many exchanges its plan has."""
    path = f"{shared_folder(spark).rstrip('/')}/bucketed-{uuid.uuid4().hex}"
    facts = transactions(spark, folder).select("txn_id", "t", "amount", "client", "channel")
    facts = write_bucketed(facts, f"facts_{uuid.uuid4().hex}", path, "client", ("t", "txn_id"), buckets=8)
    made = entity_history(facts, EVENT_STREAM.entity_keys, "t", "amount", ("txn_id",))
    names = [c for c in made.columns if c.startswith(("client_", "pair_"))]
    return rounded(made.select("txn_id", *names).withColumn("exchanges", F.lit(exchanges(made)).cast("long")))



@add(with_tables(f"""
    SELECT txn_id, {_history_sql('client', 'client', 't, txn_id', 't', 'amount')} FROM txn
""", "txn"))
def entity_history_segmented(spark, folder):
    """The same history when every entity counts as too large for one task."""
    made = entity_history(
        transactions(spark, folder), EVENT_STREAM.entity_keys[:1], "t", "amount", ("txn_id",), rows_per_task=20
    )
    return rounded(made.select("txn_id", *[c for c in made.columns if c.startswith("client_")]))


LINE_ORDER = ("l_orderkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount", "l_tax")


@add(f"""
    WITH f AS (SELECT *, CAST(epoch(l_shipdate) AS BIGINT) AS t FROM lineitem), h AS (
    SELECT *, {_history_sql('supplier', 'l_suppkey', 't, ' + ', '.join(LINE_ORDER), 't', 'l_extendedprice')},
        {_history_sql('supply', 'l_suppkey, l_partkey', 't, ' + ', '.join(LINE_ORDER), 't', 'l_extendedprice')} FROM f)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, supplier_count_prior, supplier_amt_mean_prior, supplier_secs_since_last,
        supplier_txns_last_day, supply_count_prior, supply_amt_mean_prior, supply_amt_ratio, supply_secs_since_last,
        supply_txns_last_day FROM h
""")
def entity_history_lineitem(spark, folder):
    keys = (EntityKey("supplier", ("l_suppkey",)), EntityKey("supply", ("l_suppkey", "l_partkey")))
    made = entity_history(lineitems(spark, folder), keys, "t", "l_extendedprice", LINE_ORDER)
    return rounded(made.select(
        "l_orderkey", "l_linenumber", "l_partkey", "supplier_count_prior", "supplier_amt_mean_prior",
        "supplier_secs_since_last", "supplier_txns_last_day", "supply_count_prior", "supply_amt_mean_prior",
        "supply_amt_ratio", "supply_secs_since_last", "supply_txns_last_day",
    ))


@add(with_tables(f"""
    WITH h AS (SELECT part, label, count(*) OVER (PARTITION BY client ORDER BY t, txn_id) - 1 AS prior,
                      count(*) OVER (PARTITION BY client ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS burst
               FROM parted)
    SELECT coalesce(part, 'dropped') AS part, count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS positives,
           {q4('avg(label)')} AS positive_rate, {q4('avg(prior)')} AS mean_prior, {q4('avg(burst)')} AS mean_burst
    FROM h GROUP BY 1
""", "parted"))
def split_history_summary(spark, folder):
    """Per part: size, positive rate and how much history its rows have."""
    made = entity_history(parted(spark, folder), EVENT_STREAM.entity_keys[:1], "t", "amount", ("txn_id",))
    return rounded(made.groupBy(F.coalesce("split", F.lit("dropped")).alias("part")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("label").alias("positives"), F.avg("label").alias("positive_rate"),
        F.avg("client_count_prior").alias("mean_prior"), F.avg("client_txns_last_day").alias("mean_burst"),
    ))


# ------------------------------------------------------ frequency encoding ---
_FREQ = f"""
    WITH l AS (SELECT 'client' AS "column", client::VARCHAR AS value FROM parted WHERE part = 'train'
        UNION ALL SELECT 'channel', channel FROM parted WHERE part = 'train'
        UNION ALL SELECT 'k_obs', k_obs::VARCHAR FROM parted WHERE part = 'train'),
    f AS (SELECT "column", value, count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY "column")) AS freq
          FROM l WHERE value IS NOT NULL GROUP BY 1, 2)
"""


@add(with_tables(_FREQ + f"""SELECT "column", value, n, {q4('freq')} AS freq FROM f""", "parted"))
def frequency_table(spark, folder):
    train = parted(spark, folder).filter(F.col("split") == "train")
    return rounded(fit_frequencies(train, list(EVENT_STREAM.frequency_columns)))


@add(with_tables(_FREQ + f"""
    SELECT txn_id, {q4('coalesce(a.freq, 0)')} AS client_freq, {q4('coalesce(b.freq, 0)')} AS channel_freq,
           {q4('coalesce(c.freq, 0)')} AS k_obs_freq
    FROM parted p LEFT JOIN f a ON a."column" = 'client' AND a.value = p.client::VARCHAR
        LEFT JOIN f b ON b."column" = 'channel' AND b.value = p.channel
        LEFT JOIN f c ON c."column" = 'k_obs' AND c.value = p.k_obs::VARCHAR
""", "parted"))
def frequency_encoding(spark, folder):
    rows = parted(spark, folder)
    encoder = FrequencyEncoder(list(EVENT_STREAM.frequency_columns)).fit(rows.filter(F.col("split") == "train"))
    return rounded(encoder.transform(rows).select("txn_id", "client_freq", "channel_freq", "k_obs_freq"))


@add(with_tables("""
    SELECT txn_id, t FROM (SELECT txn_id, t, row_number() OVER (ORDER BY t DESC, txn_id DESC) AS r, count(*) OVER () AS n FROM txn)
    WHERE r <= n // 5
""", "txn"))
def most_recent_rows(spark, folder):
    """The latest fifth of the rows, as used to bound a slow baseline fit."""
    rows = transactions(spark, folder).select("txn_id", "t")
    return rounded(select_recent(rows, "t", "txn_id", rows.count() // 5))
