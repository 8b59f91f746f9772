"""Reading, spreading and storing tables for the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causalrisk.session import materialise, prepare, scratch  # noqa: F401

#: Fixed value: A-Z and what they become; other letters keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

BATCH_BYTES = 8_000_000


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """`row`: all columns as one struct, so that added columns never clash with those of the input."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("row.*")


def bounded_batches(spark: SparkSession) -> None:
    """Let tasks pass texts to Python in batches of at most BATCH_BYTES, however long the texts are.

    Spark's own limit counts rows; ten thousand long texts would not fit a small executor.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back: lineage ends, row numbers and hashes stay as written."""
    return materialise(df, label)
