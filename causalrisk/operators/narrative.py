"""Case narratives: a fixed text per alert, built from its score and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.functions.fixed_values import (
    ACTION_PHRASE, BAND_ACTIONS, DISCLAIMER, DRIVER_PHRASE, MITIGATOR_PHRASE, SIMILAR_FALLBACK, SIMILAR_PHRASE,
)
from causalrisk.functions.text import fixed_point, joined_list, plain_name
from causalrisk.operators.explain import top_reasons
from causalrisk.operators.models import risk_band


def _lookup(position: int, band: Column) -> Column:
    table = F.create_map(*[F.lit(x) for b, row in BAND_ACTIONS.items() for x in (b, row[position])])
    return F.try_element_at(table, band)


def required_action(df: DataFrame, band: str) -> DataFrame:
    """Action and owner of each band; an unknown band gets an error and the valid names."""
    clean = F.upper(F.trim(F.coalesce(F.col(band), F.lit(""))))
    known = _lookup(0, clean).isNotNull()
    return df.withColumns({
        "required_action": _lookup(0, clean),
        "owner": _lookup(1, clean),
        "error": F.when(~known, F.concat(
            F.lit("unknown risk band '"), F.coalesce(F.col(band), F.lit("None")),
            F.lit("'; valid: " + ", ".join(sorted(BAND_ACTIONS))),
        )),
    })


def reason_texts(reasons: Column, k: int, increasing: bool) -> Column:
    """`name = value` of the first `k` reasons that push the score up, or down."""
    chosen = F.filter(reasons, lambda r: r["contribution"] > 0 if increasing else r["contribution"] < 0)
    return F.transform(F.slice(chosen, 1, k), lambda r: F.concat(plain_name(r["feature"]), F.lit(" = "), r["shown"]))


def narrate(
    df: DataFrame, id: str, probability: str, amount: str, reasons: str, context: tuple[str, ...] = ()
) -> DataFrame:
    """Add `risk_band`, `drivers` and `narrative`."""
    p, a = F.col(probability), F.col(amount)
    band = risk_band(p)
    drivers = reason_texts(F.col(reasons), 4, increasing=True)
    mitigators = reason_texts(F.col(reasons), 2, increasing=False)
    head = F.concat(
        F.lit("ALERT "), F.col(id).cast("string"), F.lit(" | risk "), F.col("risk_band"),
        F.lit(" ("), fixed_point(p * 100, 1), F.lit("%) | amount "), fixed_point(a, 2, grouped=True),
    )
    bits = F.concat_ws(", ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in context])

    def sentence(phrase: str, items: str) -> Column:
        return F.when(F.size(items) > 0, F.concat(F.lit(phrase), joined_list(F.col(items)), F.lit(".")))

    lines = [head]
    if context:
        lines.append(F.when(bits != "", F.concat(F.lit("Context: "), bits, F.lit("."))))
    lines += [
        sentence(DRIVER_PHRASE, "drivers"),
        sentence(MITIGATOR_PHRASE, "_mitigators"),
        F.concat(F.lit(ACTION_PHRASE), _lookup(0, F.col("risk_band")), F.lit(".")),
        F.lit(DISCLAIMER),
    ]
    return (
        df.withColumns({"risk_band": band, "drivers": drivers, "_mitigators": mitigators})
        .withColumn("narrative", F.concat_ws(" ", *lines)).drop("_mitigators")
    )


def top_alerts(df: DataFrame, probability: str, id: str, n: int = 2000) -> DataFrame:
    """The `n` highest scores; equal scores by id.

    The lowest of them is found by the scores alone, so that other columns of
    `df` are worked out for the rows from there on only.
    """
    p = F.col(probability)
    lowest = df.select(p.alias("p")).orderBy(F.desc("p")).limit(n).agg(F.count("p").alias("n"), F.min("p").alias("p")).first()
    if lowest.n == n:
        df = df.where(p >= lowest.p)
    return df.orderBy(p.desc(), F.col(id)).limit(n)


def narrative_corpus(
    df: DataFrame, id: str, probability: str, amount: str, reasons: str,
    context: tuple[str, ...] = (), n: int = 2000, k: int = 6,
) -> DataFrame:
    """Narratives of the top alerts, all from one plan."""
    alerts = top_alerts(df, probability, id, n).withColumn(reasons, top_reasons(F.col(reasons), k))
    return narrate(alerts, id, probability, amount, reasons, context)


def similarity_text(reasons: Column) -> Column:
    """What to search for: the three strongest reasons that raised the score."""
    up = F.filter(reasons, lambda r: r["contribution"] > 0)
    names = F.transform(F.slice(up, 1, 3), lambda r: plain_name(r["feature"]))
    return F.when(F.size(names) > 0, F.concat(F.lit(SIMILAR_PHRASE), F.array_join(names, ", "))).otherwise(SIMILAR_FALLBACK)
