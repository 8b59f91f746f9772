"""Population stability index between a reference and a current set of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.operators.ordered import count_above, exact_quantiles
from causalrisk.operators.unpivot import long_form

FLOOR = 1e-6


def inner_edges(df: DataFrame, columns: list[str], bins: int) -> dict[str, list[float]]:
    """Distinct quantile edges of each column without the two outer ones.

    Columns with fewer than three distinct edges are left out of the result's
    bins: they map to an empty list.
    """
    probs = [i / bins for i in range(bins + 1)]
    found: dict[str, set] = {c: set() for c in columns}
    for r in exact_quantiles(long_form(df, columns, "double"), "value", probs, by=("column",)).collect():
        found[r["column"]].add(r.value)
    return {c: sorted(e)[1:-1] for c, e in found.items() if e}


def psi_table(
    df: DataFrame, columns: list[str], is_reference: Column, is_current: Column, bins: int = 10
) -> DataFrame:
    """(column, psi, verdict), largest shift first; NULL values do not take part.

    Bins come from the reference rows alone. One pass counts all columns.
    """
    reference = df.filter(is_reference)
    edges = inner_edges(reference, columns, bins)
    used = [c for c in columns if c in edges]
    binned = [
        F.struct(
            F.lit(c).alias("column"),
            F.when(F.col(c).isNotNull(), count_above(F.col(c), edges[c], inclusive=True)).alias("bin"),
        )
        for c in used
    ]
    counts = (
        df.withColumns({"_ref": is_reference.cast("int"), "_cur": is_current.cast("int")})
        .select("_ref", "_cur", F.inline(F.array(*binned)))
        .filter(F.col("bin").isNotNull())
        .groupBy("column", "bin").agg(F.sum("_ref").alias("ref"), F.sum("_cur").alias("cur"))
    )
    totals = counts.groupBy("column").agg(F.sum("ref").alias("all_ref"), F.sum("cur").alias("all_cur"))
    e = F.greatest(F.col("ref") / F.col("all_ref"), F.lit(FLOOR))
    a = F.greatest(F.col("cur") / F.col("all_cur"), F.lit(FLOOR))
    flat = [c for c in used if not edges[c]]
    psi = F.sum((a - e) * F.ln(a / e))
    return (
        # Both tables have at most one row per column and bin.
        counts.join(totals, "column").filter((F.col("all_ref") > 0) & (F.col("all_cur") > 0))
        .groupBy("column").agg(psi.alias("psi"))
        .withColumn("psi", F.when(F.col("column").isin(flat), 0.0).otherwise(F.col("psi")))
        .withColumn("verdict", verdict(F.col("psi")))
        .orderBy(F.desc("psi"), "column")
    )


def verdict(psi: Column) -> Column:
    return F.when(psi < 0.10, "stable").when(psi < 0.25, "moderate shift").otherwise("MAJOR SHIFT")
