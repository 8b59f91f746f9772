"""Optional one-to-one enrichment of a fact table and what it tells about the source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from causalrisk.operators.contracts import DataContractError, key_report

MATCHED = "_matched"


def enrich(left: DataFrame, right: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Left join that must keep the row count; `_matched` marks rows that found a partner.

    The join is given no hint: both sides may be large, and Spark broadcasts
    one only when its measured size allows it.
    """
    if check:
        sides = [key_report(df, key).withColumn("side", F.lit(side)) for side, df in (("left", left), ("right", right))]
        repeated = [r for r in sides[0].unionByName(sides[1]).collect() if r.duplicates or r.null_keys > 1]
        if repeated:
            raise DataContractError("; ".join(f"{r.side}: {r.duplicates} rows repeat a {key}, {r.null_keys} have none" for r in repeated))
    marked = right.withColumn(MATCHED, F.lit(1))
    return left.join(marked, key, "left").withColumn(MATCHED, F.coalesce(F.col(MATCHED), F.lit(0)))


def row_count_change(joined: DataFrame, left: DataFrame) -> DataFrame:
    """(rows_before, rows_after, ok) of a join that should not multiply rows."""
    before = left.agg(F.count(F.lit(1))).scalar()
    return joined.agg(F.count(F.lit(1)).alias("rows_after")).select(
        before.alias("rows_before"), "rows_after"
    ).withColumn("ok", (F.col("rows_before") == F.col("rows_after")).cast("int"))


def coverage(joined: DataFrame) -> DataFrame:
    """Share of rows that found a partner, from the marker of `enrich`."""
    return joined.agg(
        F.sum(MATCHED).alias("matched"),
        F.count(F.lit(1)).alias("n_rows"),
        F.avg(MATCHED).alias("coverage"),
    )


def manifest(joined: DataFrame, target: str, time: str) -> DataFrame:
    """One row of provenance: size, class balance, time range and coverage."""
    y, t = F.col(target), F.col(time)
    positives, negatives = F.sum(y), F.count_if(y == 0)
    return joined.agg(
        F.count(F.lit(1)).alias("n_rows"),
        positives.alias("positives"),
        negatives.alias("negatives"),
        F.avg(y).alias("positive_rate"),
        (negatives / F.greatest(positives, F.lit(1))).alias("imbalance_ratio"),
        F.min(t).alias("t_min"),
        F.max(t).alias("t_max"),
        ((F.max(t) - F.min(t)) / 86400).alias("span_days"),
        F.sum(MATCHED).alias("matched"),
        F.avg(MATCHED).alias("coverage"),
    )


def with_inputs(row: DataFrame, paths: tuple[str, ...]) -> DataFrame:
    """A manifest row with path, size and SHA-256 of every input file as `inputs`."""
    files = reduce(DataFrame.unionByName, [file_fingerprints(row.sparkSession, p) for p in paths])
    listed = files.agg(F.array_sort(F.collect_list(F.struct("path", "bytes", "sha256"))).alias("inputs"))
    return row.withColumn("inputs", listed.scalar())


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-insensitive 64-bit hash of the whole content."""
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.bit_xor(F.xxhash64(*df.columns)).alias("content_xor"),
        F.sum(F.pmod(F.xxhash64(*df.columns), F.lit(1 << 31))).alias("content_sum"),
    )


def file_fingerprints(spark, path: str) -> DataFrame:
    """SHA-256 of every input file (each must fit in one row, below 2 GB)."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
