"""Parquet tables and the transaction view over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalrisk.session import prepare


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def spread_table(spark: SparkSession, folder: str, name: str, key: str) -> DataFrame:
    """A table for costly per-row work: few large input splits are spread over all cores.

    A table with at least as many splits as cores is left as it is.
    """
    df = read_table(spark, folder, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def epoch_seconds(column: str):
    return F.unix_seconds(F.col(column).cast("timestamp"))


def transactions(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """`events` in the roles of `EVENT_STREAM`.

    The table has no missing values, so two columns with gaps are derived by
    rule: `k_obs` lacks every multiple of seven, `dist` is known below 60.
    """
    k = F.get_json_object("props", "$.k").cast("long")
    events = spread_table(spark, folder, "events", "event_id") if spread else read_table(spark, folder, "events")
    return events.select(
        F.col("event_id").alias("txn_id"),
        epoch_seconds("ts").alias("t"),
        F.col("value").alias("amount"),
        (F.col("event_type") == "error").cast("int").alias("label"),
        F.col("user_id").alias("client"),
        F.col("event_type").alias("channel"),
        k.alias("k"),
        F.when(k % 7 != 0, k).alias("k_obs"),
        F.when(k < 60, k * 1.5).alias("dist"),
        F.when(k < 10, "b0").when(k < 40, "b1").when(k < 90, "b2").alias("band"),
    )


def scored(spark: SparkSession, folder: str, spread: bool = False) -> DataFrame:
    """Transactions with a closed-form score, so any engine can repeat it."""
    hour = F.floor(F.col("t") / 3600) % 24
    z = F.lit(-1.8) + F.col("amount") * 0.006 + (hour - 12) * 0.04
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-z))
    return transactions(spark, folder, spread).withColumn("score", F.floor(p * 1000000 + 0.5) / 1000000)


def planted(spark: SparkSession, folder: str) -> DataFrame:
    """Scored transactions whose label really follows the score, drawn by a fixed rule of the id."""
    draw = (F.col("txn_id") * 7919 + 13) % 10007 / F.lit(10007.0)
    return scored(spark, folder).withColumn("label", (draw < F.col("score")).cast("int"))


def lineitems(spark: SparkSession, folder: str) -> DataFrame:
    """`lineitem` as a second fact table; `label` marks a returned line."""
    return read_table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_discount", "l_tax",
        "l_returnflag", "l_linestatus",
        epoch_seconds("l_shipdate").alias("t"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
