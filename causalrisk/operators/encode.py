"""Frequency encoding: how common a value was among the training rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalrisk.operators.ordered import with_row_index
from causalrisk.operators.unpivot import as_text, long_form
from causalrisk.session import materialise

#: A column's map is broadcast up to so many levels and so many bytes of their texts.
BROADCAST_LEVELS, BROADCAST_BYTES = 500_000, 64_000_000


def fit_frequencies(train: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n, freq): share of each value among the column's non-null rows."""
    present = [c for c in columns if c in train.columns]
    counts = (
        long_form(train, present, "string")
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    )
    totals = counts.groupBy("column").agg(F.sum("n").alias("total"))
    # One row per encoded column.
    return counts.join(F.broadcast(totals), "column").select(
        "column", "value", "n", (F.col("n") / F.col("total")).alias("freq")
    )


@dataclass
class FrequencyEncoder:
    """Fit on training rows, apply anywhere; unseen, missing and absent give `unseen`."""

    columns: list[str]
    unseen: float = 0.0
    table: DataFrame | None = None

    def fit(self, train: DataFrame) -> FrequencyEncoder:
        # Every encoded column reads the map again.
        table = materialise(fit_frequencies(train, self.columns), "frequencies")
        kept = [c for c in self.columns if c in train.columns]
        return FrequencyEncoder(kept, self.unseen, table)

    def save(self, path: str) -> None:
        self.table.write.mode("overwrite").partitionBy("column").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str, columns: list[str], unseen: float = 0.0) -> FrequencyEncoder:
        return FrequencyEncoder(columns, unseen, spark.read.parquet(path))

    def transform(self, df: DataFrame) -> DataFrame:
        """Add `<c>_freq` for every fitted column.

        A column's map is broadcast only when it has few levels. A larger one
        is joined by shuffle, where missing values are given their own random
        keys first, so they do not all meet in one task.
        """
        size = F.sum(F.octet_length("value") + 16)
        sizes = {r["column"]: r for r in self.table.groupBy("column").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).collect()}
        out = df
        for c in self.columns:
            name = f"{c}_freq"
            if c not in df.columns:
                out = out.withColumn(name, F.lit(self.unseen))
                continue
            value = as_text(df, c)
            lookup = self.table.filter(F.col("column") == c).select(
                F.col("value").alias("_value"), F.col("freq").alias(name)
            )
            if c not in sizes or sizes[c].n <= BROADCAST_LEVELS and sizes[c].bytes <= BROADCAST_BYTES:
                lookup, on = F.broadcast(lookup), value
            else:
                lookup = lookup.withColumn("_value", F.concat(F.lit("v"), F.col("_value")))
                spread = F.pmod(F.xxhash64(*df.columns), F.lit(1 << 20)).cast("string")
                on = F.coalesce(F.concat(F.lit("v"), value), F.concat(F.lit("n"), spread))
            out = (
                out.withColumn("_on", on)
                .join(lookup, F.col("_on") == F.col("_value"), "left")
                .withColumn(name, F.coalesce(F.col(name), F.lit(self.unseen)))
                .drop("_on", "_value")
            )
        return out


def select_recent(df: DataFrame, time: str, id: str, n: int) -> DataFrame:
    """The latest `n` rows.

    Only the order columns are sorted, by range, to find the first row to keep;
    no task sorts or holds the `n` rows.
    """
    first = with_row_index(df.select(time, id), [F.col(time), F.col(id)]).filter(
        F.col("row_index") == F.greatest(F.col("rows") - n, F.lit(0))
    ).first()
    if first is None or n <= 0:
        return df.limit(0)
    t = F.col(time)
    return df.filter((t > first[time]) | ((t == first[time]) & (F.col(id) >= first[id])))
