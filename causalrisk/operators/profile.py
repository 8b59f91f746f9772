"""What the training rows look like: gaps, rates over time and by category, class summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.functions.rowwise import hour_of_cycle
from causalrisk.operators.ordered import exact_quantiles
from causalrisk.operators.unpivot import long_form
from causalrisk.sources.files import column_levels

DAY = 86400


def _rate_columns(target: str) -> list[Column]:
    y = F.col(target)
    return [F.count(F.lit(1)).alias("n"), F.sum(y).alias("positives"), F.avg(y).alias("rate")]


def missingness_report(df: DataFrame) -> DataFrame:
    """Per column: type, share and number of missing values, distinct values."""
    total = df.agg(F.count(F.lit(1))).scalar()
    types = df.sparkSession.createDataFrame(df.dtypes, "column string, dtype string")
    missing = F.col("n_rows") - F.coalesce("present", F.lit(0))
    return (
        types.join(column_levels(df, df.columns), "column", "left")
        .withColumn("n_rows", total)
        .select(
            "column",
            "dtype",
            F.coalesce(F.try_divide(missing * 100.0, "n_rows"), F.lit(0.0)).alias("pct_missing"),
            missing.alias("n_missing"),
            F.coalesce("levels", F.lit(0)).alias("n_unique"),
        )
        .orderBy(F.desc("pct_missing"), "column")
    )


def missingness_blocks(df: DataFrame, columns: list[str], id: str) -> DataFrame:
    """Groups of columns that are missing on exactly the same rows, largest first.

    Each column's set of missing rows is condensed to a count and two hashes
    built from the row ids, so equal counts alone do not make columns equal.
    """
    present = [c for c in columns if c in df.columns]
    marks = []
    for c in present:
        gone = F.col(c).isNull()
        marks.append(F.struct(
            F.lit(c).alias("column"),
            F.count_if(gone).alias("n_missing"),
            F.bit_xor(F.when(gone, F.xxhash64(F.col(id)))).alias("h1"),
            F.bit_xor(F.when(gone, F.xxhash64(F.col(id), F.lit(1)))).alias("h2"),
            F.count(F.lit(1)).alias("n_rows"),
        ))
    masks = df.agg(F.array(*marks).alias("m")).select(F.inline("m"))
    return (
        masks.groupBy("n_missing", "h1", "h2", "n_rows")
        .agg(F.array_sort(F.collect_list("column")).alias("names"))
        .select(
            F.size("names").alias("n_columns"),
            F.coalesce(F.try_divide(F.col("n_missing") * 100.0, "n_rows"), F.lit(0.0)).alias("pct_missing"),
            F.array_join("names", ", ").alias("columns"),
        )
        .orderBy(F.desc("n_columns"), "columns")
    )


def rate_over_time(df: DataFrame, time: str, target: str, bucket_days: int = 1) -> DataFrame:
    """Rows and positive rate per bucket of days since the first row."""
    start = df.agg(F.min(time)).scalar()
    bucket = F.floor((F.col(time) - start) / (bucket_days * DAY))
    return (
        df.select(bucket.alias("bucket"), target).groupBy("bucket").agg(*_rate_columns(target))
        .withColumn("day", F.col("bucket") * bucket_days)
    )


def hour_profile(df: DataFrame, time: str, target: str) -> DataFrame:
    return df.select(hour_of_cycle(F.col(time)).alias("hour"), target).groupBy("hour").agg(*_rate_columns(target))


def category_rates(df: DataFrame, columns: list[str], target: str, min_count: int = 100, top: int = 15) -> DataFrame:
    """Per column the `top` categories by positive rate that have `min_count` rows.

    Lift compares with all rows, including those that lack the category.
    """
    from pyspark.sql import Window

    overall = df.agg(F.avg(target)).scalar()
    ranked = Window.partitionBy("column").orderBy(F.desc("rate"), "value")
    return (
        long_form(df, columns, "string", (target,))
        .filter(F.col("value").isNotNull())
        .groupBy("column", "value").agg(*_rate_columns(target))
        .filter(F.col("n") >= min_count)
        .withColumn("lift", F.try_divide("rate", overall))
        # Levels, not rows, are ranked: one row per category that passed the floor.
        .withColumn("position", F.row_number().over(ranked))
        .filter(F.col("position") <= top)
    )


def missing_as_signal(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Positive rate where a column is missing against where it is present."""
    present = [c for c in columns if c in df.columns]
    y = F.col(target)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.avg(F.col(c).isNull().cast("int")).alias("missing"),
            F.avg(F.when(F.col(c).isNull(), y)).alias("rate_missing"),
            F.avg(F.when(F.col(c).isNotNull(), y)).alias("rate_present"),
        )
        for c in present
    ]
    return (
        df.agg(F.array(*stats).alias("s")).select(F.inline("s"))
        .filter((F.col("missing") > 0) & (F.col("missing") < 1))
        .select(
            "column",
            (F.col("missing") * 100).alias("pct_missing"),
            "rate_missing",
            "rate_present",
            F.abs(F.col("rate_missing") - F.col("rate_present")).alias("abs_gap"),
            F.try_divide("rate_missing", "rate_present").alias("ratio"),
        )
        .orderBy(F.desc("abs_gap"), "column")
    )


def numeric_summary(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """Per column and class: size, missing, mean, quartiles, 99th percentile, maximum."""
    long = long_form(df, columns, "double", (target,)).filter(F.col(target).isNotNull())
    basic = long.groupBy("column", target).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("value").isNull()).alias("missing"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
    )
    probs = {0.25: "p25", 0.5: "median", 0.75: "p75", 0.99: "p99"}
    quantiles = (
        exact_quantiles(long, "value", list(probs), by=("column", target))
        .groupBy("column", target)
        .agg(*[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(n) for p, n in probs.items()])
    )
    return basic.join(quantiles, ["column", target], "left")


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Rows per class, their share, and the weight that balances the positive class."""
    y = F.col(target)
    negatives, positives = F.count_if(y == 0), F.count_if(y == 1)
    return df.agg(
        negatives.alias("negatives"),
        positives.alias("positives"),
        F.avg(y).alias("rate"),
        (negatives / F.greatest(positives, F.lit(1))).alias("imbalance_weight"),
    )


def log_histogram(df: DataFrame, column: str, target: str, edges: int = 60) -> DataFrame:
    """Density per class over log-spaced bins from 1 to the maximum.

    Values below 1 fall outside; the last bin includes the maximum.
    """
    x = F.col(column)
    top = df.agg(F.max(column)).scalar()
    bins = edges - 1
    binned = (
        df.filter(x >= 1).select(x.alias("x"), target, top.alias("top"))
        .withColumn("step", F.log10("top") / bins)
        .withColumn("bin", F.least(F.floor(F.coalesce(F.try_divide(F.log10("x"), F.col("step")), F.lit(0.0))), F.lit(bins - 1)))
    )
    counts = binned.groupBy(target, "bin").agg(F.count(F.lit(1)).alias("n"), F.max("step").alias("step"))
    totals = counts.groupBy(target).agg(F.sum("n").alias("total"))
    low = F.pow(F.lit(10.0), F.col("bin") * F.col("step"))
    high = F.pow(F.lit(10.0), (F.col("bin") + 1) * F.col("step"))
    return counts.join(F.broadcast(totals), target).select(
        target, "bin", "n", low.alias("low"), high.alias("high"),
        F.try_divide(F.col("n") / F.col("total"), high - low).alias("density"),
    )


def missingness_histogram(report: DataFrame, bins: int = 40) -> DataFrame:
    """How many columns fall in each equal-width bin between the least and most missing."""
    share = F.col("pct_missing")
    low, high = report.agg(F.min(share)).scalar(), report.agg(F.max(share)).scalar()
    width = (F.col("high") - F.col("low")) / bins
    place = F.coalesce(F.floor(F.try_divide(share - F.col("low"), width)), F.lit(0))
    return (
        report.select(share, low.alias("low"), high.alias("high"))
        .withColumn("bin", F.least(place, F.lit(bins - 1)))
        .groupBy("bin").agg(F.count(F.lit(1)).alias("n_columns"), F.min(share).alias("least"), F.max(share).alias("most"))
    )
