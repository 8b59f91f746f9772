"""Quality rules per document, and per host: failing rates shrunk by a beta prior decide about whole hosts.

All measures of a text come from column expressions on its own row, so the
texts are read once and not shuffled. The row with its measures is written
once; failures are then counted per host with partial sums, and one verdict per
host joins back, broadcast if adaptive execution finds it small.

Repeated eight-word windows: every window gets a 64-bit hash built by doubling
(two words, four, eight). Only texts whose window hashes are not all different
are sorted to find the places of the repeats.

Defined results: a null or empty text has no words, and fails as too short. A
null host has no verdict, so its documents stand for themselves. Repeated rows
are judged one by one, each counting for its host. Texts of any length are
measured whole. An empty table stays empty. Columns of any name are kept in `row`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.llm.common import stored
from causalrisk.llm.shrinkage import lower_bound, prior_strength

#: Fixed values of the base rule: what a word is, what a symbol is, the window, and the limits.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _pair_hashes(df: DataFrame, source: str, step: int, out: str) -> DataFrame:
    """Hash of each entry with the one `step` places later (none at the end)."""
    return df.withColumn(out, F.transform(source, lambda x, i: F.xxhash64(x, F.get(F.col(source), i + step))))


def measured(rows: DataFrame, text: str = "text") -> DataFrame:
    """Adds the five measures of the text; columns of `rows` may not begin with `_`."""
    kept = [c for c in rows.columns if c != text]
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(WORD))
    df = rows.select(
        *kept, F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)).alias("_words"), lines.alias("_lines"),
        F.length(F.translate(t, SPACE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
    )
    df = df.select(
        *kept, "word_chars", "n_symbols", F.size("_words").cast("long").alias("n_words"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_one"),
    )
    df = _pair_hashes(_pair_hashes(_pair_hashes(df, "_one", 1, "_two").drop("_one"), "_two", 2, "_four").drop("_two"), "_four", 4, "_eight").drop("_four")
    df = df.withColumn("_eight", F.slice("_eight", F.lit(1), F.greatest(F.size("_eight") - (WINDOW - 1), F.lit(0))))
    repeats = F.size(F.array_distinct("_eight")) < F.size("_eight")
    df = df.withColumn("_sorted", F.when(repeats, F.array_sort(F.transform("_eight", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))).drop("_eight")

    def same(e: Column, j: Column) -> Column:
        return F.coalesce(F.get(F.col("_sorted"), j)["h"] == e["h"], F.lit(False))

    marked = F.transform("_sorted", lambda e, j: F.when(same(e, j - 1) | same(e, j + 1), e["i"]))
    df = df.withColumn("_places", F.array_sort(F.array_compact(marked))).drop("_sorted")
    reach = F.transform("_places", lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_places"), j + 1), x + WINDOW) - x))
    covered = F.aggregate(reach, F.lit(0), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_places")


def base_failed() -> Column:
    n, repeated = F.col("n_words"), F.col("n_repeat_words")
    return (n < LEAST_WORDS) | (repeated * 100 > n * MOST_REPEATED)


def rule_failed() -> Column:
    """The rules counted per host: the base rule, symbols, repeated lines and word length."""
    n, chars = F.col("n_words"), F.col("word_chars")
    return (
        base_failed() | (F.col("n_symbols") * 10 > chars) | (F.col("n_dup_lines") * 5 > n) | (chars < n * 2) | (chars > n * 20)
    )


def host_verdicts(judged: DataFrame, max_rate: float, z: float) -> DataFrame:
    """Per host of `judged` (`host`, `failed`): documents, failures, and whether the lower bound of the shrunk rate is too high."""
    hosts = judged.where("host is not null").groupBy("host").agg(
        F.count("*").cast("double").alias("n"), F.sum(F.col("failed").cast("double")).alias("k"),
    )
    total = hosts.agg(F.sum("n").alias("n"), F.sum("k").alias("k")).first()
    overall = F.lit(total.k / total.n if total.n else 0.0)
    strength = prior_strength(hosts, "n", "k", overall)
    return hosts.select("host", "n", "k", (lower_bound(F.col("n"), F.col("k"), overall, strength, z) > max_rate).alias("rejected"))


def judge_documents(
    docs: DataFrame, host: str = "source", keep: list[str] | None = None, max_rate: float = 0.9, z: float = 1.645,
) -> DataFrame:
    """`row` (the columns `keep` of the document, all by default), the measures, `base_failed` and `kept`.

    A document is kept unless it fails the base rule or its host is rejected: a
    host goes only where nearly all of its documents fail some rule.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep or docs.columns]).alias("row"), F.col(host).alias("host"), F.col("text"))
    judged = stored(
        measured(rows).select("row", "host", *MEASURES, base_failed().alias("base_failed"), rule_failed().alias("failed")), "measured"
    )
    # stored, so that its size is known before the join: a small table is broadcast and no text is shuffled
    verdicts = stored(host_verdicts(judged, max_rate, z), "verdicts")
    return judged.join(verdicts.select("host", "rejected"), "host", "left").select(
        "row", *MEASURES, "base_failed", (~F.col("base_failed") & ~F.coalesce("rejected", F.lit(False))).alias("kept"),
    )
