"""Association with a binary target: chi-square and rank tests for many columns at once."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.functions.rowwise import MISSING
from causalrisk.operators.ordered import running_totals
from causalrisk.operators.unpivot import long_form

# Names and limits of the effect bands.
OTHER = "__other__"
CHI_SQUARE_BANDS = (
    (0.1, "significant but negligible - large n, tiny effect"),
    (0.3, "weak but usable association"),
    (math.inf, "moderate-to-strong association"),
)
RANK_BANDS = (
    (0.147, "significant but negligible - large n, tiny effect"),
    (0.33, "small but real difference"),
    (0.474, "medium difference"),
    (math.inf, "large difference"),
)


def pooled_levels(df: DataFrame, columns: list[str], target: str, min_count: int = 50) -> DataFrame:
    """(column, level, n0, n1) after pooling levels below `min_count` rows."""
    y = F.col(target)
    levels = (
        long_form(df, columns, "string", (target,))
        .groupBy("column", F.coalesce("value", F.lit(MISSING)).alias("level"))
        .agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"), F.count(F.lit(1)).alias("n"))
    )
    return levels.groupBy(
        "column", F.when(F.col("n") >= min_count, F.col("level")).otherwise(OTHER).alias("level")
    ).agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))


def contingency(df: DataFrame, columns: list[str], target: str, min_count: int = 50) -> DataFrame:
    """(column, level, y, n): the table of level counts per class."""
    return pooled_levels(df, columns, target, min_count).select("column", "level", F.inline(F.array(
        F.struct(F.lit(0).alias("y"), F.col("n0").alias("n")),
        F.struct(F.lit(1).alias("y"), F.col("n1").alias("n")),
    )))


def chi_square(df: DataFrame, columns: list[str], target: str, min_count: int = 50) -> DataFrame:
    """(column, statistic, dof, n, effect_size) with Cramer's V as the effect.

    A column with fewer than two levels or classes gives no row.
    """
    pooled = pooled_levels(df, columns, target, min_count).filter(F.col("n0") + F.col("n1") > 0)
    totals = pooled.groupBy("column").agg(
        F.sum("n0").alias("all0"), F.sum("n1").alias("all1"), F.count(F.lit(1)).alias("levels")
    )
    n = F.col("all0") + F.col("all1")
    here = (F.col("n0") + F.col("n1")) / n

    def part(seen: str, whole: str) -> Column:
        expected = here * F.col(whole)
        return F.pow(F.col(seen) - expected, F.lit(2)) / expected

    return (
        # One row per tested column.
        pooled.join(F.broadcast(totals), "column")
        .filter((F.col("levels") >= 2) & (F.col("all0") > 0) & (F.col("all1") > 0))
        .groupBy("column")
        .agg(
            F.sum(part("n0", "all0") + part("n1", "all1")).alias("statistic"),
            (F.max("levels") - 1).alias("dof"),
            F.max(n).alias("n"),
        )
        .withColumn("effect_size", F.sqrt(F.col("statistic") / F.col("n")))
    )


def chi_square_p(statistic: float, dof: int) -> float:
    """Upper tail of the chi-square distribution for one result row.

    Series below the mean, continued fraction above it.
    """
    a, x = dof / 2.0, statistic / 2.0
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1.0 - total * lead)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def rank_test(df: DataFrame, columns: list[str], target: str, min_size: int = 20) -> DataFrame:
    """(column, statistic, n1, n0, z, effect_size): Mann-Whitney U and Cliff's delta.

    Ties share their mean rank. All columns are ranked in one range-sorted job.
    """
    y = F.col(target)
    long = long_form(df.filter(y.isin(0, 1)), columns, "double", (target,))
    ranks = running_totals(
        long, "value",
        {"n": F.lit(1), "n1": F.col(target).cast("long")},
        by=("column",),
    )
    n = F.col("n").cast("double")
    midrank = F.col("cum_n") - (n - 1) / 2
    rank_sums = ranks.groupBy("column").agg(
        F.sum(F.col("n1") * midrank).alias("r1"),
        F.sum(n * n * n - n).alias("ties"),
        F.max("tot_n").cast("double").alias("total"),
        F.max("tot_n1").cast("double").alias("n1"),
    )
    n1, n0, total = F.col("n1"), F.col("n0"), F.col("total")
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n0 / 12 * ((total + 1) - F.col("ties") / (total * (total - 1))))
    return (
        rank_sums.withColumn("n0", total - n1)
        .filter((n1 >= min_size) & (n0 >= min_size))
        .withColumn("statistic", u)
        # Distance from the mean, half a unit closer for continuity.
        .withColumn("z", F.try_divide(F.abs(F.col("statistic") - n1 * n0 / 2) - 0.5, spread))
        .select(
            "column", "statistic",
            n1.cast("long").alias("n1"), n0.cast("long").alias("n0"), "z",
            (F.col("statistic") * 2 / (n1 * n0) - 1).alias("effect_size"),
        )
    )


def rank_test_p(z: float | None) -> float:
    return 1.0 if z is None else min(1.0, math.erfc(max(z, 0.0) / math.sqrt(2)))


def _banded(effect: Column, p: Column, bands: tuple, nothing: str) -> Column:
    chain = F.when(p >= 0.05, nothing)
    return reduce(lambda c, b: c.when(F.abs(effect) < F.lit(b[0]), b[1]), bands, chain)


def test_battery(df: DataFrame, target: str, categorical: list[str], numeric: list[str]) -> DataFrame:
    """Every applicable test as one table, strongest effect first.

    The statistics are computed on the cluster; p-values are added to the
    result rows, one per tested column.
    """
    spark = df.sparkSession
    rows = []
    for r in chi_square(df, [c for c in categorical if c in df.columns], target).collect():
        rows.append((r["column"], "chi-square", float(r.statistic), chi_square_p(r.statistic, r.dof),
                     "cramers_v", float(r.effect_size), int(r.n)))
    for r in rank_test(df, [c for c in numeric if c in df.columns], target).collect():
        rows.append((r["column"], "mann-whitney-u", float(r.statistic), rank_test_p(r.z),
                     "cliffs_delta", float(r.effect_size), int(r.n1 + r.n0)))
    table = spark.createDataFrame(
        rows, "feature string, test string, statistic double, p_value double, effect string, effect_size double, n long"
    )
    effect, p = F.col("effect_size"), F.col("p_value")
    return table.withColumn(
        "interpretation",
        F.when(F.col("test") == "chi-square", _banded(effect, p, CHI_SQUARE_BANDS, "no detectable association"))
        .otherwise(_banded(effect, p, RANK_BANDS, "no detectable difference")),
    ).orderBy(F.abs(effect).desc(), "feature")


test_battery.__test__ = False
