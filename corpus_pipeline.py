"""A training-data pipeline over `documents`: STAGES in order, each on all rows that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
as Parquet before the next one reads it. All but the last return the columns of
`documents`; the last adds the shard. A stage's own stored tables go when the
next one starts, as its result has been written by then.

Rows without an id are documents like others; rows that share id and text are
copies, of which the second stage leaves one. Null and empty texts have no words,
so the first stage drops them. Texts of any length are judged and cut as a whole.
An empty table passes all stages and stays empty. Columns of any name are kept;
the last stage gives its own a free one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, functions as F

from causalrisk import discard, owner, prepare, release
from causalrisk.llm.catalog import MIX_RARE, MIX_TARGETS, SHARDS
from causalrisk.llm.common import read, stored
from causalrisk.llm.decontaminate import decontaminate
from causalrisk.llm.jaccard import PICKED, jaccard_components, text_key
from causalrisk.llm.mixing import mix_documents
from causalrisk.llm.quality import judge_documents
from causalrisk.llm.shards import shard_documents

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(work: Stage) -> Stage:
    """The tables of the stage before go, those of this one stay for its result."""

    @wraps(work)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "corpus_pipeline")
        with owner("corpus_pipeline"):
            return work(spark, docs, sf_dir)

    return call


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule, or whose host nearly always fails, go."""
    return judge_documents(docs).where("kept").select("row.*")


@_stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the least id stays, and of its copies one.

    Documents are told apart by id and text, so rows that share an id, or have
    none, are thinned like others and lost like none. Only what goes or repeats
    is joined to the documents, so most texts are not shuffled: up to PICKED of
    these keys are broadcast.
    """
    found = jaccard_components(docs).where("component is not null").groupBy("component", "doc_id", "text_key").agg(F.count("*").alias("n"))
    found = stored(found, "found")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first"))
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_key") == F.col("first.text_key"))
    touched = found.join(least, "component").select("doc_id", "text_key", "n", first.alias("stays")).where("n > 1 or not stays")
    touched = stored(touched.select(F.col("doc_id").alias("_of"), F.col("text_key").alias("_text"), "stays"), "touched")
    keys = F.broadcast(touched) if touched.count() <= PICKED else touched
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("_id"), text_key(F.col("text")).alias("_key"))
    same = F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_key") == F.col("_text"))
    others = rows.join(keys, same, "left_anti").select("row")
    repeated = rows.join(keys.where("stays"), same).groupBy("_id", "_key").agg(F.min_by("row", F.xxhash64("row")).alias("row")).select("row")
    return others.unionByName(repeated).select("row.*")


@_stage
def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of test items are cut out; documents that consist of them by more than half go."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


@_stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics have their target weights; cells of few tokens do not set the scale."""
    return mix_documents(docs, MIX_TARGETS, rare=MIX_RARE).where("sampled").select("row.*")


@_stage
def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the number of the document's shard as `shard`, with lines before the name where the input has such a column."""
    label = "shard"
    while label in map(str.lower, docs.columns):
        label = "_" + label
    return shard_documents(docs, SHARDS, label=label)


STAGES = [
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: Connected components, span removal and the k-d tree have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; a stage's result is stored, and goes when the next one's is."""
    docs, before = read(prepare(spark), sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            discard(before)
        before = docs
    release(spark, "corpus_pipeline")
    return docs
