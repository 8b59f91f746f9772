"""Features of a single row: safe on any partition, in batch and in a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.spec import DatasetSpec, EntityKey

DAY = 86400
# Fixed value: stands for an absent category.
MISSING = "__missing__"


def hour_of_cycle(time: Column) -> Column:
    return F.pmod(F.floor(time / 3600), F.lit(24)).cast("int")


def day_of_cycle(time: Column) -> Column:
    return F.pmod(F.floor(time / DAY), F.lit(7)).cast("int")


def amount_features(amount: Column) -> dict[str, Column]:
    cents = amount - F.floor(amount)
    return {
        "amt_log": F.log1p(amount),
        "amt_cents": F.bround(cents, 4),
        "amt_is_round": (cents == 0).cast("int"),
    }


def time_features(time: Column) -> dict[str, Column]:
    hour = hour_of_cycle(time)
    return {
        "hour": hour,
        "dayofweek": day_of_cycle(time),
        "is_night": hour.between(0, 6).cast("int"),
    }


def missing_features(columns: list[str], flags: tuple[str, ...]) -> dict[str, Column]:
    """`<c>_isna` for the flagged columns that exist, and how many columns are NULL."""
    isna = {c: F.col(c).isNull().cast("int") for c in columns}
    return {
        **{f"{c}_isna": isna[c] for c in flags if c in isna},
        "n_missing": reduce(lambda a, b: a + b, isna.values()),
    }


def domain_features(columns: list[str], domains: tuple[str, ...]) -> dict[str, Column]:
    """First and last dot-separated piece of each domain; whether the two domains agree."""
    made: dict[str, Column] = {}
    for c in domains:
        if c in columns:
            pieces = F.split(F.col(c), "[.]")
            made[f"{c}_provider"] = F.coalesce(F.element_at(pieces, 1), F.lit(MISSING))
            made[f"{c}_suffix"] = F.coalesce(F.element_at(pieces, -1), F.lit(MISSING))
    if len(domains) == 2 and set(domains) <= set(columns):
        made["email_domains_match"] = (F.col(domains[0]) == F.col(domains[1])).cast("int")
    return made


def add_row_features(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """All row-wise features. Missing counts look at the incoming columns only."""
    return df.withColumns(
        {
            **amount_features(F.col(spec.amount)),
            **time_features(F.col(spec.time)),
            **missing_features(df.columns, spec.missing_flags),
            **domain_features(df.columns, spec.domains),
        }
    )


def add_reference_days(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Turn "days since X" into the day X happened, which is the same on every row."""
    day = F.col(spec.time) / DAY
    made = {f"{c}n": F.floor(day - F.col(c)) for c in spec.day_offsets if c in df.columns}
    return df.withColumns({"day": day, **made})


def key_columns(key: EntityKey, available: list[str]) -> list[Column]:
    """The key's parts as text, with the stand-in for missing or absent parts."""
    parts = [F.col(c).cast("string") if c in available else F.lit(None).cast("string") for c in key.columns]
    return [F.coalesce(p, F.lit(key.missing)) for p in parts] if key.missing is not None else parts


def add_entity_keys(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Each composite key as one readable column, its parts joined by underscores."""
    made = {k.name: F.concat_ws("_", *key_columns(k, df.columns)) for k in spec.entity_keys if len(k.columns) > 1}
    return df.withColumns(made) if made else df


def model_features(df: DataFrame, spec: DatasetSpec, drop: tuple[str, ...] = ()) -> list[str]:
    """Columns a model may see: not the id, raw time, target or raw entity ids."""
    hidden = {spec.id, spec.time, spec.target, *drop}
    hidden |= {k.name for k in spec.entity_keys if len(k.columns) > 1}
    return [c for c in df.columns if c not in hidden]
