"""Writers for the fact table and for report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def write_fact(df: DataFrame, path: str, time: str, id: str, partitions: int | None = None) -> None:
    """Snappy Parquet in time order: each file covers one time range.

    Range partitioning gives the files disjoint min/max statistics, so a filter
    on time or on a split reads only the files it needs.
    """
    order = [F.col(time), F.col(id)]
    spread = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    spread.sortWithinPartitions(*order).write.mode("overwrite").option("compression", "snappy").parquet(path)


def write_report(df: DataFrame, folder: str, section: str, fmt: str = "parquet") -> None:
    """One report table under `<folder>/<section>` as parquet, json or csv."""
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(f"{folder}/{section}")


def write_section(results: DataFrame, path: str) -> None:
    """Replace only the `section` values present in `results`, keep the others."""
    (
        results.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("section")
        .parquet(path)
    )
