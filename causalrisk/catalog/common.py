"""Shared pieces of the registered queries and of their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from causalrisk.session import prepare


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


class Catalog(dict[str, Query]):
    def add(self, sql: str | None = None):
        def register(fn):
            self[fn.__name__] = Query(lambda spark, folder: fn(prepare(spark), folder), sql)
            return fn

        return register


def r4(value: Column | str, digits: int = 4) -> Column:
    """Round with the same arithmetic in both engines; exact ties always go up.

    Infinite numbers and NaN stay, which a floor to a whole number would make large or 0.
    """
    c = F.col(value) if isinstance(value, str) else value
    scale = float(10**digits)
    return F.when(F.abs(c * scale) < 2.0**62, F.floor(c * scale + 0.500001) / scale).otherwise(c * scale / scale)


def q4(expression: str, digits: int = 4) -> str:
    """SQL text of `r4`."""
    scale = f"{float(10**digits)!r}::DOUBLE"
    return f"(floor(({expression})::DOUBLE * {scale} + 0.500001::DOUBLE) / {scale})"


def long(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("long")


def rounded(df: DataFrame, digits: int = 4, **as_digits: int) -> DataFrame:
    """Every floating column by `r4`, every integer column as long."""
    out = []
    for f in df.schema.fields:
        kind = f.dataType.typeName()
        if kind in ("double", "float"):
            out.append(r4(F.col(f.name), as_digits.get(f.name, digits)).alias(f.name))
        elif kind in ("integer", "short", "byte", "long"):
            out.append(long(f.name).alias(f.name))
        else:
            out.append(F.col(f.name))
    return df.select(*out)


TXN = """
    SELECT event_id AS txn_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, value AS amount,
           CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label, user_id AS client, event_type AS channel,
           k, CASE WHEN k % 7 <> 0 THEN k END AS k_obs, CASE WHEN k < 60 THEN k * 1.5::DOUBLE END AS dist,
           CASE WHEN k < 10 THEN 'b0' WHEN k < 40 THEN 'b1' WHEN k < 90 THEN 'b2' END AS band
    FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM events)
"""

SPLIT = """
    SELECT lo, hi, te, te + 86400 AS vs, ve, ve + 86400 AS ts0 FROM (
        SELECT lo, hi, lo + CAST(floor((hi - lo) * 0.70::DOUBLE) AS BIGINT) AS te,
               lo + CAST(floor((hi - lo) * (0.70::DOUBLE + 0.15::DOUBLE)) AS BIGINT) AS ve
        FROM (SELECT min(t) AS lo, max(t) AS hi FROM txn))
"""

PARTED = """
    SELECT txn.*, CASE WHEN t <= te THEN 'train' WHEN t > vs AND t <= ve THEN 'val' WHEN t > ts0 THEN 'test' END AS part
    FROM txn CROSS JOIN cuts
"""

SCORED = """
    SELECT *, floor(1000000 * (1.0::DOUBLE / (1.0::DOUBLE + exp(-(-1.8::DOUBLE + amount * 0.006::DOUBLE
        + (CAST(floor(t / 3600) AS BIGINT) % 24 - 12) * 0.04::DOUBLE)))) + 0.5::DOUBLE) / 1000000 AS score
    FROM txn
"""


def with_tables(sql: str, *names: str) -> str:
    """Prefix `sql` with the named common tables and what they build on."""
    parts = {"txn": TXN, "cuts": SPLIT, "parted": PARTED, "scored": SCORED}
    needs = {"txn": (), "cuts": ("txn",), "parted": ("txn", "cuts"), "scored": ("txn",)}
    wanted: list[str] = []

    def want(name: str) -> None:
        for n in needs[name]:
            want(n)
        if name not in wanted:
            wanted.append(name)

    for n in names:
        want(n)
    ctes = ",\n".join(f"{n} AS ({parts[n]})" for n in wanted)
    body = sql.strip()
    return f"WITH {ctes}{', ' + body[5:] if body.upper().startswith('WITH ') else ' ' + body}"
