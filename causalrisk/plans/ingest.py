"""From two raw tables to one trusted fact table with its provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from causalrisk.operators import contracts, enrich as en
from causalrisk.session import materialise
from causalrisk.sources.sinks import write_fact
from causalrisk.spec import DatasetSpec


def ingest(
    facts: DataFrame, side: DataFrame, spec: DatasetSpec, path: str | None = None,
    expected_rate: float | None = None, tolerance: float = 0.005, sources: tuple[str, ...] = (),
) -> tuple[DataFrame, DataFrame]:
    """The checked, joined and typed table, and its one-row manifest.

    Rules that fail raise before anything is written to `path`. `sources` are the
    paths that the tables were read from; the manifest lists their files.
    """
    contracts.require_columns(facts, spec.required, "facts")
    side_keys = contracts.key_report(side, spec.id).first()
    if side_keys.duplicates or side_keys.null_keys:
        raise contracts.DataContractError(f"side key '{spec.id}' is not unique or has gaps")
    contracts.enforce(
        contracts.fact_report(facts, spec.id, spec.target, spec.time, expected_rate=expected_rate, tolerance=tolerance),
        "facts",
    )
    orphans = contracts.orphan_count(side, facts, spec.id).first().orphans
    if orphans:
        raise contracts.DataContractError(f"{orphans} side rows refer to a {spec.id} the fact table does not have")
    joined = en.enrich(facts, side, spec.id, check=False).withColumns({
        spec.id: F.col(spec.id).cast("long"),
        spec.target: F.col(spec.target).cast("int"),
        spec.time: F.col(spec.time).cast("long"),
        spec.amount: F.col(spec.amount).cast("double"),
    })
    if path:
        write_fact(joined, path, spec.time, spec.id)
        joined = facts.sparkSession.read.parquet(path)
    else:
        joined = materialise(joined, "joined")
    provenance = en.manifest(joined, spec.target, spec.time)
    return joined.drop(en.MATCHED), en.with_inputs(provenance, sources) if sources else provenance
