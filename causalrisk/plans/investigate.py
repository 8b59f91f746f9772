"""From scored rows with reasons to narratives, a searchable case base and case files."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F

from causalrisk.functions.text import chunk_rows
from causalrisk.operators.casefile import case_files
from causalrisk.operators.explain import top_reasons
from causalrisk.operators.narrative import narrative_corpus, top_alerts
from causalrisk.operators.retrieve import fit_text_vectors, text_vectors
from causalrisk.session import materialise


@dataclass
class CaseBase:
    cases: DataFrame
    case_model: PipelineModel
    passages: DataFrame
    passage_model: PipelineModel


def build_cases(
    scored: DataFrame, id: str, probability: str, amount: str, target: str, reasons: str, documents: DataFrame,
    context: tuple[str, ...] = (), n: int = 2000,
) -> CaseBase:
    """Vectors for the narratives of the top alerts and for the chunks of `documents`.

    `documents` has (source, text).
    """
    corpus = narrative_corpus(scored, id, probability, amount, reasons, context, n).select(
        F.col(id).alias("case_id"), "risk_band", F.col(target).alias("label"), "narrative"
    )
    corpus = materialise(corpus, "narratives")
    case_model = fit_text_vectors(corpus, "narrative")
    passages = chunk_rows(documents, "text", ["source"]).withColumn(
        "passage_id", F.concat_ws("#", "source", F.format_string("%05d", "chunk"))
    )
    passage_model = fit_text_vectors(passages, "text")
    return CaseBase(
        materialise(text_vectors(case_model, corpus, "narrative"), "case-vectors"), case_model,
        materialise(text_vectors(passage_model, passages, "text"), "passage-vectors"), passage_model,
    )


def investigate(
    scored: DataFrame, base: CaseBase, facts: tuple[str, ...], id: str, probability: str, reasons: str, n: int = 2000,
) -> DataFrame:
    """A case file for each of the `n` highest alerts."""
    alerts = top_alerts(scored, probability, id, n).withColumn(reasons, top_reasons(F.col(reasons)))
    return case_files(
        alerts, facts, id, probability, reasons, base.cases, base.case_model, base.passages, base.passage_model
    )
