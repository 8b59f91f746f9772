"""Data-contract checks: a report of violations and a hard failure on demand."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


class DataContractError(ValueError):
    """The data break a rule that later steps rely on."""


def require_columns(df: DataFrame, required: tuple[str, ...], name: str = "table") -> None:
    absent = [c for c in required if c not in df.columns]
    if absent:
        raise DataContractError(f"{name} lacks {', '.join(absent)}")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def key_report(df: DataFrame, key: str) -> DataFrame:
    """Row, distinct, duplicate and NULL counts of a key in one row.

    Rows are counted per key first, so a frequent key shrinks before the shuffle.
    """
    per_key = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    present = F.col(key).isNotNull()
    return per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        F.count_if(present).alias("n_keys"),
        F.coalesce(F.sum(F.when(present, F.col("n") - 1)), F.lit(0)).alias("duplicates"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("null_keys"),
    )


def orphan_count(right: DataFrame, left: DataFrame, key: str) -> DataFrame:
    """How many `right` rows refer to a key that `left` does not have."""
    known = left.select(key).distinct()
    return right.join(known, key, "left_anti").agg(F.count(F.lit(1)).alias("orphans"))


def fact_report(
    df: DataFrame,
    key: str,
    target: str,
    time: str,
    allowed: tuple[int, ...] = (0, 1),
    expected_rate: float | None = None,
    tolerance: float = 0.005,
) -> DataFrame:
    """(check, violations, ok) for key, target, time and positive rate.

    Rows are first counted per key; one aggregation over that answers every check.
    """
    y, t = F.col(target), F.col(time)
    per_key = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(y.isNull()).alias("no_label"),
        F.count_if(y.isNotNull() & ~y.isin(*allowed)).alias("bad_label"),
        F.count_if(t.isNull()).alias("no_time"),
        F.count_if(t < 0).alias("bad_time"),
        F.sum(y).alias("positives"),
        F.count(y).alias("labelled"),
    )
    present = F.col(key).isNotNull()
    totals = per_key.agg(
        F.sum(F.when(present, F.col("n") - 1)).alias("unique_key"),
        F.sum(F.when(~present, F.col("n"))).alias("null_key"),
        F.sum("no_label").alias("label_present"),
        F.sum("bad_label").alias("label_allowed"),
        F.sum("no_time").alias("time_present"),
        F.sum("bad_time").alias("time_not_negative"),
        F.try_divide(F.sum("positives"), F.sum("labelled")).alias("rate"),
    )
    checks = ["unique_key", "null_key", "label_present", "label_allowed", "time_present", "time_not_negative"]
    if expected_rate is not None:
        off = F.abs(F.col("rate") - expected_rate) > tolerance
        totals = totals.withColumn("positive_rate", F.coalesce(off, F.lit(True)).cast("long"))
        checks.append("positive_rate")
    violations = [
        F.struct(F.lit(c).alias("check"), F.coalesce(F.col(c), F.lit(0)).alias("violations")) for c in checks
    ]
    return totals.select(F.inline(F.array(*violations))).withColumn("ok", (F.col("violations") == 0).cast("int"))


def enforce(report: DataFrame, name: str = "table") -> None:
    """Raise for every failed check of a (check, violations, ok) report."""
    failed = report.filter(F.col("ok") == 0).orderBy("check").collect()
    if failed:
        raise DataContractError(f"{name}: " + "; ".join(f"{r.check} ({r.violations})" for r in failed))
