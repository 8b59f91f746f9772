"""Mixing to target weights: token weights are raked to source, language and topic marginals, then documents are drawn.

Documents are summed to cells, one for each combination of the categories that
have a target and one remainder per dimension, so the cells are bounded by the
targets and not by the data. Iterative proportional fitting runs on the cells:
each step sums the weights along one dimension in Spark and multiplies that
dimension's factors by target / sum, until no marginal is off. A document's
probability is its cell's factor over the largest factor (all marginals then
hold in expectation), or such that a token budget is met with probabilities of
at most one. With `rare`, the cells of the largest factors that together hold at
most that share of the tokens are taken whole and do not set the scale; the
other cells are raked again to what the targets leave besides them, so that a
cell of a few documents cannot scale down the whole corpus. The draw is a hash
of the id, so it repeats.

Defined results: null or unlisted categories belong to the remainder, which
takes what the listed targets leave. Targets of categories without tokens go to
the others in proportion. Texts without tokens weigh nothing, but are drawn
like their cell. Repeated rows share their draw. Texts of any length count with
all their tokens. An empty table stays empty. Columns of any name are kept in
`row`.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.llm.common import stored

WORD = r"[^\x20\x09-\x0D]+"
OTHER = "(other)"
SWEEPS, EXACT = 60, 1e-10

Targets = dict[str, dict[str, float]]


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def with_layout_topic(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds `tokens` and `topic`, what kind of text it is, for tables without a topic column: table, symbols, capitals, short or prose.

    The counts of a text are written as a generated row: filters are not moved
    below a generator, so they are computed once however often the topic is named.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rest = [c for c in df.columns if c != text]
    counts = F.struct(
        n_tokens(t).alias("tokens"), F.length(t).alias("_size"), (F.length(t) - F.length(F.replace(t, F.lit("|")))).alias("_bars"),
        F.regexp_count(t, F.lit("[#*$%&<>]")).alias("_symbols"), F.regexp_count(t, F.lit("[A-Z]")).alias("_capitals"),
    )
    counted = df.select(*rest, F.inline(F.array(counts)))
    topic = (
        F.when(F.col("_bars") * 5 > F.col("tokens"), "table").when(F.col("_symbols") * 20 > F.col("_size"), "symbols")
        .when(F.col("_capitals") * 3 > F.col("_size"), "capitals").when(F.col("tokens") < 100, "short").otherwise("prose")
    )
    return counted.select(*rest, "tokens", topic.alias("topic"))


def category(value: Column, targets: dict[str, float]) -> Column:
    return F.when(value.isin(*targets), value).otherwise(OTHER) if targets else F.lit(OTHER)


def _wanted(targets: dict[str, float], present: dict[str, float]) -> dict[str, float]:
    """Target shares of the categories that have tokens; the remainder takes what the targets leave."""
    shares = {**targets, OTHER: max(0.0, 1.0 - sum(targets.values()))}
    live = {c: shares.get(c, 0.0) for c, n in present.items() if n > 0}
    total = sum(live.values())
    return {c: s / total if total else 1.0 / len(live) for c, s in live.items()}


def _by_category(column: str, factors: dict[str, float]) -> Column:
    out = F.lit(1.0)
    for name, value in factors.items():
        out = F.when(F.col(column) == name, F.lit(value)).otherwise(out)
    return out


def rake(cells: DataFrame, targets: Targets) -> dict[str, dict[str, float]]:
    """Factors per dimension and category such that cells * factors have the target shares; cells: the dimensions and `tokens`."""
    factors: dict[str, dict[str, float]] = {d: {} for d in targets}
    wanted: dict[str, dict[str, float]] = {}
    for _ in range(SWEEPS):
        off = 0.0
        for d in targets:
            weight = F.col("tokens").cast("double")
            for other in targets:
                weight = weight * _by_category(other, factors[other])
            sums = {r[d]: r.w for r in cells.groupBy(d).agg(F.sum(weight).alias("w")).collect()}
            if not wanted.get(d):
                wanted[d] = _wanted(targets[d], sums)
            total = sum(sums.values())
            for c, share in wanted[d].items():
                now = sums[c] / total if total else 0.0
                off = max(off, abs(now - share))
                factors[d][c] = factors[d].get(c, 1.0) * (share / now if now else 1.0)
        if off < EXACT:
            break
    return factors


def _scale(cells: list, budget: float | None) -> float:
    """What a cell's factor is multiplied by: the largest that leaves every probability at most one, or that meets the budget."""
    top = max((r.factor for r in cells if r.tokens > 0), default=0.0)
    if not top:
        return 1.0
    if budget is None:
        return 1.0 / top
    low, high = 0.0, 1.0 / min(r.factor for r in cells if r.tokens > 0 and r.factor > 0)
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if sum(r.tokens * min(1.0, middle * r.factor) for r in cells) < budget else (low, middle)
    return high


def _rare_cells(cells: list, rare: float) -> int:
    """How many of the cells, largest factor first, hold together at most `rare` of the tokens."""
    held, most = 0, rare * sum(r.tokens for r in cells)
    for n, r in enumerate(cells):
        held += r.tokens
        if held > most:
            return n
    return 0


def _around(cells: list, targets: Targets, whole: int) -> list[float]:
    """Probabilities of cells, largest factor first, of which the first `whole` are taken whole: the others are raked
    to what the marginals lack besides those, at the largest scale that leaves every probability at most one."""
    tokens = np.array([r.tokens for r in cells], dtype=float)
    factor = np.array([r.factor for r in cells])
    fixed, free = tokens[:whole], tokens[whole:]
    sides = []
    for d, listed in targets.items():
        wanted = _wanted(listed, {c: sum(r.tokens for r in cells if r[d] == c) for c in {r[d] for r in cells}})
        names = sorted({r[d] for r in cells[whole:]})
        place = np.array([names.index(r[d]) for r in cells[whole:]])
        taken = np.array([sum(r.tokens for r in cells[:whole] if r[d] == c) for c in names], dtype=float)
        least = np.bincount(place, free * factor[whole:], len(names)) / (tokens @ factor)
        sides.append((place, np.array([wanted[c] for c in names]), taken, least))

    def fitted(total: float) -> np.ndarray:
        weight = free * factor[whole:]
        for _ in range(SWEEPS):
            for place, wanted, taken, least in sides:
                goal = np.maximum(wanted * total - taken, least * total)
                now = np.bincount(place, weight, len(goal))
                goal = goal / goal.sum() * (total - fixed.sum())
                weight = weight * np.divide(goal, now, out=np.ones_like(goal), where=now > 0)[place]
        return weight / free

    low, high = float(fixed.sum()), float(tokens.sum())
    for _ in range(50):
        middle = (low + high) / 2
        low, high = (middle, high) if fitted(middle).max() <= 1.0 else (low, middle)
    return [1.0] * whole + np.minimum(1.0, fitted(low)).tolist()


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only."""
    digest = F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def mix(
    classed: DataFrame, counted: DataFrame, targets: Targets, budget: float | None = None, seed: str = "mix", rare: float = 0.0,
) -> DataFrame:
    """`classed` (the dimensions, `doc_id`, anything else) with `probability` and `sampled`.

    counted: the dimensions and `tokens` of the same rows. Its sums per cell are
    the only thing that is gathered; `budget` is a share of all tokens. `rare`
    holds where there is no budget.
    """
    dims = list(targets)
    cells = stored(counted.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "cells")
    factors = rake(cells, targets)
    factor = F.lit(1.0)
    for d in dims:
        factor = factor * _by_category(d, factors[d])
    table = cells.select(*dims, "tokens", factor.alias("factor")).collect()
    scale = _scale(table, None if budget is None else budget * sum(r.tokens for r in table))
    probability = F.least(F.lit(1.0), factor * F.lit(scale))
    if rare and budget is None:
        ranked = sorted((r for r in table if r.tokens > 0 and r.factor > 0), key=lambda r: (-r.factor, *(r[d] for d in dims)))
        whole = _rare_cells(ranked, rare)
        for r, p in zip(ranked, _around(ranked, targets, whole) if whole else [], strict=False):
            here = F.lit(True)
            for d in dims:
                here = here & (F.col(d) == r[d])
            probability = F.when(here, F.lit(p)).otherwise(probability)
    return classed.withColumn("probability", probability).withColumn("sampled", draw(F.col("doc_id"), seed) < F.col("probability"))


def classes(docs: DataFrame, targets: Targets, keep: list[str] | None = None) -> DataFrame:
    """`row` (the columns `keep`, all by default), doc_id, tokens, and the three dimensions of `documents`."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), "doc_id", "source", "lang", "text")
    return with_layout_topic(rows).select("row", "doc_id", "tokens", *[category(F.col(d), targets[d]).alias(d) for d in ("source", "lang", "topic")])


def mix_documents(
    docs: DataFrame, targets: Targets, budget: float | None = None, keep: list[str] | None = None, seed: str = "mix", rare: float = 0.0,
) -> DataFrame:
    """`row`, tokens, source, lang, topic, probability and sampled of every document.

    Narrow rows (`keep`) are stored, so the texts are read once; whole documents
    are read twice rather than written.
    """
    classed = classes(docs, targets, keep)
    if keep:
        classed = stored(classed, "classed")
    return mix(classed, classed.drop("row"), targets, budget, seed, rare)
