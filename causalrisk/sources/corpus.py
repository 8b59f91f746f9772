"""A folder of Markdown files as one row per document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def title_of(text):
    """First line without the leading heading marks."""
    return F.trim(F.regexp_replace(F.regexp_extract(text, r"^([^\r\n]*)", 1), r"^[# ]+", ""))


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """(source, title, text) of every `*.md` file in the folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*.md")
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    return files.select(
        name.alias("source"),
        F.coalesce(F.nullif(title_of(F.col("value")), F.lit("")), F.regexp_replace(name, r"\.md$", "")).alias("title"),
        F.col("value").alias("text"),
    )
