"""Vectors for text, exact cosine search, prompts and groundedness."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from causalrisk.functions.fixed_values import (
    CORRECT_REFUSAL, EMPTY_ANSWER, GROUNDED_VERDICTS, OVERLAP_METHOD, PROMPT_HEAD, PROMPT_TASK, REFUSAL_LENGTH,
    REFUSAL_MARKERS, REFUSAL_METHOD,
)
from causalrisk.functions.text import content_words

DIMENSIONS = 384
#: Vectors of a block, and how far a block may grow where there are more pairs of blocks than tasks want.
QUERY_BATCH, LARGEST_BATCH = 4096, 16_384
#: Queries whose similarities are held at once, and neighbours that share one maximum.
STRIP, TOGETHER = 256, 64


def unit_length(vector: Column) -> Column:
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(vector, lambda x: F.try_divide(x.cast("double"), norm))


def fit_text_vectors(corpus: DataFrame, text: str, dimensions: int = DIMENSIONS) -> PipelineModel:
    """Hashed, weighted word counts of unit length.

    They match on shared words, not on meaning; a column of learned vectors can
    be used in their place.
    """
    return Pipeline(stages=[
        RegexTokenizer(inputCol=text, outputCol="_words", pattern="[^\\p{L}\\p{N}]+", toLowercase=True),
        HashingTF(inputCol="_words", outputCol="_counts", numFeatures=dimensions),
        IDF(inputCol="_counts", outputCol="_weighted"),
        Normalizer(inputCol="_weighted", outputCol="_unit"),
    ]).fit(corpus)


def text_vectors(model: PipelineModel, df: DataFrame, text: str, output: str = "vector") -> DataFrame:
    source = model.stages[0].getInputCol()
    named = df if source == text else df.withColumn(source, F.col(text))
    keep = [c for c in df.columns]
    return model.transform(named).select(*keep, vector_to_array("_unit", "float32").alias(output))


def _blocks(n: int, rows: int) -> int:
    return max(1, -(-n // rows))


def _in_pairs(df: DataFrame, id: str, own: str, n_own: int, other: str, n_other: int) -> DataFrame:
    """Each row in its own block, once for every block of the other side."""
    others = F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)
    return df.withColumn(own, F.pmod(F.xxhash64(id), F.lit(n_own)).cast("int")).select("*", others)


def cosine_top_k(
    queries: DataFrame, corpus: DataFrame, query_id: str, corpus_id: str, k: int = 5,
    query_vector: str = "vector", corpus_vector: str = "vector", batch: int = QUERY_BATCH,
) -> DataFrame:
    """(query_id, corpus_id, similarity, rank): the exact `k` nearest of every query.

    Both sides are cut in blocks of about `batch` vectors (up to four times as
    many, where there are many pairs of blocks) on the executors, every
    pair of blocks meets in one task for one matrix product, and only the best
    `k` of a query go on from there. No vector passes the driver; a vector that
    is NULL is never a hit and has none. Similarities are rounded to ten digits,
    so equal vectors tie and the smaller id comes first.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("_v"))
    c = corpus.select(F.col(corpus_id).alias("corpus_id"), F.col(corpus_vector).alias("_v"))
    # Counted without the vectors; a filter on them here or below would make all of them once more.
    sizes, tasks = (queries.count(), corpus.count()), 8 * queries.sparkSession.sparkContext.defaultParallelism
    n_q, n_c = (_blocks(n, batch) for n in sizes)
    while n_q * n_c > tasks and batch < LARGEST_BATCH:
        batch *= 2
        n_q, n_c = (_blocks(n, batch) for n in sizes)
    pair = ["_q", "_c"]
    left = _in_pairs(q, "query_id", "_q", n_q, "_c", n_c).groupBy(*pair)
    right = _in_pairs(c, "corpus_id", "_c", n_c, "_q", n_q).groupBy(*pair)
    schema = T.StructType([
        T.StructField("query_id", q.schema["query_id"].dataType),
        T.StructField("corpus_id", c.schema["corpus_id"].dataType),
        T.StructField("similarity", T.DoubleType()),
    ])

    def nearest(asked: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        asked, known = asked[asked["_v"].notna()], known[known["_v"].notna()]
        if not len(asked) or not len(known):
            return pd.DataFrame({"query_id": asked["query_id"][:0], "corpus_id": known["corpus_id"][:0], "similarity": np.zeros(0)})
        # On ordered ids, so among equals the smaller id wins.
        known = known.sort_values("corpus_id", kind="stable")
        row, at, similar = best_products(_unit_rows(asked["_v"]), _unit_rows(known["_v"]), k)
        return pd.DataFrame({
            "query_id": asked["query_id"].to_numpy()[row], "corpus_id": known["corpus_id"].to_numpy()[at], "similarity": similar,
        })

    found = left.cogroup(right).applyInPandas(nearest, schema)
    ranked = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "corpus_id")
    # At most k rows per query and corpus block are left here.
    return found.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= k)


def best_products(left: np.ndarray, right: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of left, row of right, product): the k largest of each left row, rounded to ten digits, equal ones by number.

    The k-th largest of the maxima of neighbouring products is no larger than the
    k-th largest product, so only products that reach it are sorted. A strip of
    left rows is held at a time.
    """
    found = [(np.zeros(0, dtype=int), np.zeros(0, dtype=int), np.zeros(0))]
    n = len(right)
    finite = np.isfinite(left).all() and np.isfinite(right).all()
    for a in range(0, len(left), STRIP):
        products = left[a : a + STRIP] @ right.T
        maxima = products
        if n >= 4 * k * TOGETHER:
            maxima = products[:, : n // TOGETHER * TOGETHER].reshape(len(products), -1, TOGETHER).max(axis=2)
        if finite and n > k:
            bound = np.partition(maxima, -k, axis=1)[:, -k]
            # The margin holds all that may round to the bound.
            row, at = np.nonzero(products >= bound[:, None] - 1e-9)
        else:
            row, at = (i.ravel() for i in np.indices(products.shape))
        similar = np.round(products[row, at], 10)
        order = np.lexsort((at, -similar, row))
        row, at, similar = row[order], at[order], similar[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        found.append((row[first] + a, at[first], similar[first]))
    row, at, similar = (np.concatenate(x) for x in zip(*found))
    return row, at, similar


def _unit_rows(vectors) -> np.ndarray:
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    norm = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, norm, out=np.zeros_like(m), where=norm > 0)


def prompts(hits: DataFrame, question_id: str, question: str, rank: str, source: str, text: str) -> DataFrame:
    """One prompt per question: its ranked sources as labelled blocks, then the task.

    `hits` holds at most k rows per question, so a group is small by construction.
    """
    block = F.concat(
        F.lit("--- SOURCE "), F.col(rank).cast("string"), F.lit(": ["), F.col(source), F.lit("] ---\n"), F.col(text)
    )
    gathered = hits.groupBy(question_id).agg(
        F.sort_array(F.collect_list(F.struct(F.col(rank).alias("rank"), block.alias("block")))).alias("b"),
        F.first(question).alias("_question"),
        F.array_sort(F.collect_set(source)).alias("sources"),
        F.count(F.lit(1)).alias("chunks_used"),
    )
    context = F.array_join(F.transform("b", lambda x: x["block"]), "\n\n")
    return gathered.select(
        question_id,
        F.concat(F.lit(PROMPT_HEAD), context, F.lit(PROMPT_TASK), F.col("_question"), F.lit("\n")).alias("prompt"),
        "sources", "chunks_used",
    )


def _is_refusal(answer: Column) -> Column:
    low = F.lower(F.trim(answer))
    marked = reduce(lambda a, b: a | b, [low.contains(m) for m in REFUSAL_MARKERS])
    return marked & (F.length(low) < REFUSAL_LENGTH)


def groundedness(
    answers: DataFrame, contexts: DataFrame, id: str, answer: str, group: str, text: str,
    answer_order: str | None = None, context_order: str | None = None,
) -> DataFrame:
    """Share of an answer's content words that its context contains.

    The context of an answer is every `contexts` row of the same `group`, or
    with order columns those that come before the answer. Each word is kept
    once per group with the first place it occurs, and answers meet it by group
    and word, so a long context is never gathered in one row or one task.
    """
    order = F.col(context_order) if context_order else F.lit(0)
    context_words = (
        contexts.select(group, order.alias("_at"), F.explode(F.array_distinct(content_words(F.col(text)))).alias("word"))
        .groupBy(group, "word").agg(F.min("_at").alias("_first"))
    )
    place = F.col(answer_order) if answer_order else F.lit(1)
    answer_words = (
        answers.select(id, group, place.alias("_place"), F.explode(content_words(F.col(answer))).alias("word"))
        .groupBy(id, group, "_place", "word").agg(F.count(F.lit(1)).alias("uses"))
    )
    supported = F.coalesce(F.col("_first") < F.col("_place"), F.lit(False))
    per_answer = (
        answer_words.join(context_words, [group, "word"], "left")
        .groupBy(id)
        .agg(
            F.sum("uses").alias("words"),
            F.coalesce(F.sum(F.when(supported, F.col("uses"))), F.lit(0)).alias("overlap"),
            F.array_sort(F.collect_set(F.when(~supported, F.col("word")))).alias("missing"),
        )
    )
    ratio = F.col("overlap") / F.col("words")
    verdict = reduce(
        lambda c, v: c.when(ratio >= v[0], v[1]), GROUNDED_VERDICTS,
        F.when(F.col("_refused"), CORRECT_REFUSAL).when(F.col("words").isNull(), EMPTY_ANSWER),
    )
    none = F.array().cast("array<string>")
    return (
        answers.select(id, _is_refusal(F.col(answer)).alias("_refused"))
        .join(per_answer, id, "left")
        .select(
            id,
            F.when(F.col("_refused"), 1.0).when(F.col("words").isNull(), 0.0).otherwise(F.bround(ratio, 3)).alias("grounded_ratio"),
            F.when(F.col("_refused") | F.col("words").isNull(), none).otherwise(F.slice("missing", 1, 10)).alias("unsupported_terms"),
            verdict.alias("verdict"),
            F.when(F.col("_refused"), REFUSAL_METHOD).when(F.col("words").isNotNull(), OVERLAP_METHOD).alias("method"),
        )
    )
