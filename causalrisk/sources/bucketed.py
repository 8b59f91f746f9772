"""Fact tables laid out by key: bucketed and sorted once, so that later work on the key moves no rows.

A bucket holds all rows of its keys. Windows per entity (and per finer keys that
contain it), counts per key and joins of two tables with the same key and number
of buckets then read their bucket in one task and plan no exchange. A bucket with
a hot key is as large as the key; entity history cuts such keys in time segments,
which does move their rows, and theirs only. The key must be a stored column: a
key in which missing values are replaced on the fly has no layout.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BUCKETS = 200


def write_bucketed(df: DataFrame, name: str, path: str, key: str, order: tuple[str, ...] = (), buckets: int = BUCKETS) -> DataFrame:
    """Write `df` to `path` as table `name`, by hash of `key` and sorted by key and `order`, and return a reader.

    The number of buckets bounds the tasks that read the table, so it should
    follow the table's size, and two tables to be joined must agree in it. Rows
    go to their bucket before the write, so a bucket is one file.
    """
    spark = df.sparkSession
    spread = df.repartition(buckets, key)
    (
        spread.write.mode("overwrite").format("parquet").option("path", path).option("compression", "snappy")
        .bucketBy(buckets, key).sortBy(key, *order).saveAsTable(name)
    )
    return read_bucketed(spark, name)


def read_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def exchanges(df: DataFrame) -> int:
    """Shuffles and broadcasts in the plan before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\b(?:Broadcast)?Exchange\b", plan))
