"""Many columns as (column, value) rows, so one aggregation serves them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T


def as_text(df: DataFrame, column: str) -> Column:
    """The value as text; both zeros of a floating column read the same."""
    value = F.col(column)
    if isinstance(df.schema[column].dataType, (T.FloatType, T.DoubleType)):
        value = F.when(value == 0, F.abs(value)).otherwise(value)
    return value.cast("string")


def long_form(df: DataFrame, columns: list[str], kind: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep..., column, value) with every value cast to `kind`."""
    values = {c: as_text(df, c) if kind == "string" else F.col(c).cast(kind) for c in columns}
    pairs = [F.struct(F.lit(c).alias("column"), v.alias("value")) for c, v in values.items()]
    return df.select(*keep, F.inline(F.array(*pairs)))
