"""All evidence about every alert in one row: facts, score, drivers, precedents, action, passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.functions.fixed_values import POLICY_QUESTION
from causalrisk.functions.text import plain_name
from causalrisk.operators.explain import direction
from causalrisk.operators.models import risk_band
from causalrisk.operators.narrative import required_action, similarity_text
from causalrisk.operators.retrieve import cosine_top_k, text_vectors


def find_row(df: DataFrame, id: str, value) -> DataFrame:
    """The row with this id, if any; the filter reaches the Parquet scan."""
    return df.filter(F.col(id) == F.lit(value))


def shown_drivers(reasons: Column) -> Column:
    return F.transform(reasons, lambda r: F.struct(
        plain_name(r["feature"]).alias("factor"),
        r["feature"].alias("raw_feature"),
        F.bround(r["value"], 4).alias("value"),
        F.bround(r["contribution"], 4).alias("impact"),
        direction(r["contribution"]).alias("direction"),
    ))


def case_files(
    alerts: DataFrame, facts: tuple[str, ...], id: str, probability: str, reasons: str,
    cases: DataFrame, case_model, passages: DataFrame, passage_model, k_cases: int = 3, k_passages: int = 4,
) -> DataFrame:
    """One row per alert with each piece of evidence and whether it was found.

    `cases` has (case_id, risk_band, label, narrative, vector), `passages` has
    (passage_id, source, text, vector). Searches run once per distinct text.
    """
    p = F.col(probability)
    base = alerts.select(
        F.col(id).alias("id"),
        F.struct(*facts).alias("facts"),
        F.bround(p, 4).alias("probability"),
        risk_band(p).alias("risk_band"),
        shown_drivers(F.col(reasons)).alias("drivers"),
        similarity_text(F.col(reasons)).alias("similar_query"),
    )
    base = required_action(base, "risk_band").withColumn(
        "policy_query", F.concat(F.lit(POLICY_QUESTION[0]), F.col("risk_band"), F.lit(POLICY_QUESTION[1]))
    )
    similar = _search(base, "similar_query", case_model, cases, "case_id", k_cases).groupBy("text").agg(
        F.sort_array(F.collect_list(F.struct(
            "rank", F.col("corpus_id").alias("case_id"), F.bround("similarity", 3).alias("similarity"),
            "risk_band", "label", F.substring("narrative", 1, 280).alias("summary"),
        ))).alias("similar")
    )
    policy = _search(base, "policy_query", passage_model, passages, "passage_id", k_passages).groupBy("text").agg(
        F.array_sort(F.collect_set("source")).alias("sources"),
        F.sort_array(F.collect_list(F.struct("rank", "source", F.col("passage").alias("text")))).alias("passages"),
    )
    out = (
        base.join(similar, base.similar_query == similar.text, "left").drop("text")
        .join(policy, F.col("policy_query") == policy.text, "left").drop("text")
    )
    return out.withColumn("found", F.struct(
        F.col("facts").isNotNull().alias("facts"),
        F.col("probability").isNotNull().alias("score"),
        (F.size("drivers") > 0).alias("drivers"),
        F.col("similar").isNotNull().alias("similar"),
        F.col("error").isNull().alias("action"),
        F.col("passages").isNotNull().alias("passages"),
    ))


def _search(base: DataFrame, text: str, model, corpus: DataFrame, corpus_id: str, k: int) -> DataFrame:
    """Nearest corpus rows of every distinct query text, with the corpus columns.

    There are as many hits as k times distinct texts, so the corpus is reduced
    by the join on its id.
    """
    queries = text_vectors(model, base.select(F.col(text).alias("text")).distinct(), "text")
    hits = cosine_top_k(queries, corpus, "text", corpus_id, k).withColumnRenamed("query_id", "text")
    details = corpus.drop("vector").withColumnRenamed(corpus_id, "corpus_id")
    if "text" in details.columns:
        details = details.withColumnRenamed("text", "passage")
    return hits.join(details, "corpus_id")
