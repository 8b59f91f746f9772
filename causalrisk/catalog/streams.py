"""Streams over the event files, checked against the batch result."""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import functions as F

from causalrisk.catalog.common import Catalog, q4, rounded, with_tables
from causalrisk.catalog.intake import _history_sql, parted
from causalrisk.catalog.models import SPEC
from causalrisk.operators import models as md
from causalrisk.operators.encode import FrequencyEncoder
from causalrisk.operators.explain import training_means
from causalrisk.functions.rowwise import add_row_features
from causalrisk.sources.tables import epoch_seconds, transactions
from causalrisk.spec import EntityKey
from causalrisk.session import shared_folder
from causalrisk.streaming import Scorer, event_history, read_files, run_available, stream_history

CATALOG = Catalog()
add = CATALOG.add


def arriving(spark, folder):
    """`events` as a stream of transactions."""
    schema = spark.read.parquet(f"{folder}/events.parquet").schema
    k = F.get_json_object("props", "$.k").cast("long")
    return read_files(spark, folder, schema, "events.parquet").select(
        F.col("event_id").alias("txn_id"), epoch_seconds("ts").alias("t"), F.col("value").alias("amount"),
        F.col("user_id").alias("client"), F.when(k % 7 != 0, k).alias("k_obs"), F.when(k < 60, k * 1.5).alias("dist"),
    )


@add(with_tables(f"SELECT txn_id, {_history_sql('client', 'client', 't, txn_id', 't', 'amount')} FROM txn", "txn"))
def stream_entity_history(spark, folder):
    rows = run_available(stream_history(arriving(spark, folder), EntityKey("client", ("client",)), "t", "amount", "txn_id"), "history")
    return rounded(rows.select("txn_id", *[c for c in rows.columns if c.startswith("client_")]))


DELAY = 2 * 86_400
#: Rows of a file of arrivals, about.
ROWS_PER_FILE = 250_000


def arrive(rows, target, files):
    """Append the rows as exactly `files` files, so that a batch of as many files holds these rows and no others."""
    spark = rows.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(spark._jsc.hadoopConfiguration())
    count = lambda: sum(f.getPath().getName().endswith(".parquet") for f in store.listStatus(path)) if store.exists(path) else 0
    wanted = count() + files
    (rows.coalesce(1) if files == 1 else rows.repartition(files)).write.mode("append").parquet(target)
    # A part without rows has no file.
    for _ in range(wanted - count()):
        spark.createDataFrame([], rows.schema).coalesce(1).write.mode("append").parquet(target)


@add(with_tables(f"""
    SELECT h.*, false AS late FROM (SELECT txn_id, {_history_sql('client', 'client', 't, txn_id', 't', 'amount')} FROM txn) h JOIN txn USING (txn_id)
    WHERE t < (SELECT max(t) FROM txn) - {DELAY} OR client IS NULL
""", "txn"))
def stream_event_history(spark, folder):
    """History of transactions that arrive up to two days out of order, in four batches, for those that the watermark has passed."""
    rows = transactions(spark, folder).select("txn_id", "t", "amount", "client")
    arrival = F.col("t") + F.pmod(F.xxhash64("txn_id"), F.lit(DELAY))
    rows = rows.withColumn("at", arrival)
    span = rows.agg(F.min("at").alias("low"), F.max("at").alias("high"), F.count(F.lit(1)).alias("n")).first()
    quarter = F.least(F.floor((F.col("at") - span.low) * 4 / (span.high - span.low + 1)), F.lit(3))
    target = f"{shared_folder(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    files = max(1, -(-span.n // (4 * ROWS_PER_FILE)))
    for i in range(4):
        arrive(rows.where(quarter == i).drop("at"), target, files)
    stream = event_history(
        read_files(spark, target, rows.drop("at").schema, files_per_batch=files), EntityKey("client", ("client",)), "t", "amount", "txn_id", DELAY
    )
    out = run_available(stream, "event_history")
    return rounded(out.select("txn_id", *[c for c in out.columns if c.startswith("client_")], "late"))


def fitted_scorer(spark, folder) -> Scorer:
    spec = replace(SPEC, frequency_columns=("client",), entity_keys=())
    train = add_row_features(
        parted(spark, folder).filter(F.col("split") == "train").select("txn_id", "t", "amount", "client", "k_obs", "dist", "label"), spec)
    encoder = FrequencyEncoder(["client"]).fit(train)
    train = encoder.transform(train)
    features = ["amount", "amt_log", "hour", "is_night", "k_obs", "dist", "k_obs_isna", "dist_isna", "client_freq"]
    model = md.fit_baseline(train, features, [], "label")
    return Scorer(spec, md.training_schema(train, features), model, threshold=0.5, encoder=encoder,
                  term_names=features, term_means=training_means(model, train))


@add(with_tables("SELECT count(*) AS n_rows, count(*) AS same FROM txn", "txn"))
def stream_scores_equal_batch(spark, folder):
    """Rows scored by the stream, and how many of them the batch scores the same."""
    scorer = fitted_scorer(spark, folder)
    streamed = run_available(scorer.transform(arriving(spark, folder)), "scores")
    batch = scorer.transform(transactions(spark, folder).select("txn_id", "t", "amount", "client", "k_obs", "dist"))
    same = streamed.alias("s").join(batch.alias("b"), "txn_id").filter(
        F.col("s.probability").eqNullSafe(F.col("b.probability")) & (F.col("s.decision") == F.col("b.decision")))
    return streamed.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("same", same.agg(F.count(F.lit(1))).scalar())


@add(with_tables("SELECT count(*) AS n_rows, count(*) AS explained FROM txn", "txn"))
def stream_explanations(spark, folder):
    """Narratives written by the stream for all rows."""
    rows = run_available(fitted_scorer(spark, folder).explain(arriving(spark, folder)), "explained")
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("narrative").startswith("ALERT ")).alias("explained"))
