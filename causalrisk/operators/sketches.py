"""Distinct counts that can be added up: one sketch per column and day, stored, and merged instead of reading the rows again.

The sketches are HyperLogLog with 2**PRECISION registers, so a new day costs a
read of that day. The relative standard error is about 1.04 / sqrt(2**PRECISION),
0.8%; three times that is exceeded once in about 370 counts. A small part of it
depends on how the rows were cut into sketches, as the estimate remembers whether
a sketch was merged while still small. Exact counts are those of
`missingness_report`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.operators.unpivot import long_form

PRECISION = 14
#: Three standard errors.
ERROR = 3 * 1.04 / 2 ** (PRECISION / 2)


def column_sketches(df: DataFrame, columns: list[str], day: Column) -> DataFrame:
    """(day, column, n_rows, n_missing, sketch); an all-missing column has an empty sketch."""
    long = long_form(df.withColumn("_day", day), columns, "string", keep=("_day",))
    return long.groupBy(F.col("_day").alias("day"), "column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_missing"), F.hll_sketch_agg("value", F.lit(PRECISION)).alias("sketch"),
    )


def merged(sketches: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows, missing values and estimated distinct values per column (and `by`) over all stored sketches given."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_missing").alias("n_missing"), F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_unique"),
    )
