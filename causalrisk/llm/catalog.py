"""The registered queries of the corpus operators, each with its SQL where one exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from causalrisk.catalog.common import Catalog, Query
from causalrisk.llm import sql
from causalrisk.llm.common import read
from causalrisk.llm.decontaminate import find_leaks
from causalrisk.llm.extract import extract_pages
from causalrisk.llm.hard_negatives import mine_negatives
from causalrisk.llm.jaccard import jaccard_components
from causalrisk.llm.licenses import TEMPLATES, find_licenses
from causalrisk.llm.mixing import mix_documents
from causalrisk.llm.personal_data import KINDS, find_personal_data
from causalrisk.llm.quality import MEASURES, judge_documents
from causalrisk.llm.repeats import remove_repeats
from causalrisk.llm.secret_scan import KINDS as SECRET_KINDS, find_secrets
from causalrisk.llm.shards import kd_shards
from causalrisk.llm.turn_trie import trie_nodes, turn_steps, with_shared_starts
from causalrisk.llm.url_reputation import judge_urls

CATALOG = Catalog()

#: Production targets of the mix: the hot source is taken back to a quarter of all tokens, small languages come forward.
MIX_TARGETS = {
    "source": {"src0": 0.25},
    "lang": {"en": 0.57, "de": 0.15, "fr": 0.15, "es": 0.12},
    "topic": {"prose": 0.895, "table": 0.03, "symbols": 0.03, "capitals": 0.03, "short": 0.015},
}
#: In the pipeline, cells that together hold at most this share of the tokens are taken whole and do not set the scale.
MIX_RARE = 0.02
SHARDS = 24


def llm_queries() -> dict[str, Query]:
    """The queries of the operators, and the pipeline made of five of them."""
    import corpus_pipeline

    return {**CATALOG, "pipeline": Query(corpus_pipeline.run, corpus_pipeline.ORACLE_SQL)}


@CATALOG.add(sql.OP1)
def op1_url_reputation(spark, folder):
    """A page's outcome is the label with its number: bad if toxic or of low quality."""
    labels = read(spark, folder, "labels").select(
        F.col("doc_id").alias("page_id"), F.greatest(1 - F.col("quality"), F.col("toxic")).alias("bad"),
    )
    return judge_urls(read(spark, folder, "pages"), labels).select("page_id", "host", "path", "rule", "verdict")


@CATALOG.add(sql.OP2)
def op2_suffix_automaton_decontamination(spark, folder):
    found = find_leaks(read(spark, folder, "documents").select("doc_id", "text"), read(spark, folder, "benchmark"))
    items = F.array_join(F.array_sort(F.transform("leak.items", lambda i: i.cast("string"))), ",")
    return found.select(
        "row.doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(items, 256).alias("items_sha256"), (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


@CATALOG.add()
def op3_kd_tree_sharding(spark, folder):
    return kd_shards(read(spark, folder, "documents"), SHARDS).withColumns(
        {"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}
    )


@CATALOG.add(sql.OP4)
def op4_prefix_tree_jaccard(spark, folder):
    return jaccard_components(read(spark, folder, "documents")).select("doc_id", "n_shingles", "component_id")


@CATALOG.add(sql.op5(TEMPLATES))
def op5_diagonal_license_scan(spark, folder):
    return find_licenses(read(spark, folder, "documents")).drop("spans")


def _digest(spans, order):
    """kind:start:end of sorted spans, comma-joined."""
    ranked = F.array_sort(F.transform(spans, lambda s: F.struct(*order(s), s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(ranked, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _n_of(spans, kind):
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


@CATALOG.add()
def op6_bootstrapped_personal_data(spark, folder):
    def order(s):
        return F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("a"), s["start"].alias("b")

    found = find_personal_data(read(spark, folder, "documents"), ["doc_id"])
    counts = [_n_of("base", k).alias(f"n_{k}") for k in KINDS]
    return found.select(
        "row.doc_id", *counts, F.sha2(_digest("base", order), 256).alias("base_sha256"), _digest(F.concat("base", "added"), order).alias("spans"),
    )


@CATALOG.add()
def op7_guess_cost_secrets(spark, folder):
    def order(s):
        return s["start"].alias("a"), F.array_position(F.array(*map(F.lit, SECRET_KINDS)), s["kind"]).alias("b")

    found = find_secrets(read(spark, folder, "documents"), ["doc_id"])
    counts = [_n_of("base", k).alias(f"n_{k}") for k in SECRET_KINDS[:3]]
    return found.select(
        "row.doc_id", *counts, F.sha2(_digest("base", order), 256).alias("base_sha256"), _digest(F.concat("base", "added"), order).alias("spans"),
    )


@CATALOG.add(sql.OP8)
def op8_host_quality_rules(spark, folder):
    return judge_documents(read(spark, folder, "documents"), keep=["doc_id"]).select("row.doc_id", *MEASURES, "base_failed", "kept")


@CATALOG.add()
def op9_consensus_extraction(spark, folder):
    found = extract_pages(read(spark, folder, "pages"), ["page_id", "url"])
    return found.select("row.page_id", "row.url", "text", F.length("text").cast("long").alias("n_chars"))


@CATALOG.add(sql.op10(MIX_TARGETS))
def op10_proportional_mixing(spark, folder):
    mixed = mix_documents(read(spark, folder, "documents"), MIX_TARGETS, keep=["doc_id"])
    return mixed.select("row.doc_id", "tokens", "source", "lang", "topic", F.round("probability", 6).alias("probability"), "sampled")


@CATALOG.add(sql.OP11)
def op11_burst_trie(spark, folder):
    steps, convs = with_shared_starts(turn_steps(read(spark, folder, "conversations")))
    return trie_nodes(steps, convs)


@CATALOG.add(sql.OP12)
def op12_difference_cover_dedup(spark, folder):
    found = remove_repeats(read(spark, folder, "documents"), ["doc_id"])
    return found.select("row.doc_id", "kept.n_words", "kept.n_removed", F.sha2("kept.text", 256).alias("kept_sha256"))


@CATALOG.add(sql.OP13)
def op13_residue_hard_negatives(spark, folder):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(read(spark, folder, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)
