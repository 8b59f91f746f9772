"""Text expressions: number formats, plain names, chunks and words."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from causalrisk.functions.fixed_values import CHUNK_OVERLAP, CHUNK_WORDS, GLOSSARY, STOP_WORDS

# The white space characters of Unicode, and the four separator controls.
SPACE = r"[\s\x0b\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def once(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def rounded_whole(down: Column, beyond_half: Column) -> Column:
    """`down`, or the next number when past the half; a true tie goes to the even one."""
    return down + ((beyond_half > 0) | ((beyond_half == 0) & (down % 2 != 0))).cast("double")


def nearest(value: Column, places: Column | int) -> Column:
    """`value` times ten to the `places` (0 to 22) as the nearest whole number.

    Decided on the exact binary value; Spark's own rounding looks at the
    shortest decimal form instead. The value is split in two short parts whose
    products are exact.
    """
    scale = F.pow(F.lit(10.0), places if isinstance(places, Column) else F.lit(places))
    high = value.cast("float").cast("double")
    parts = F.struct(
        F.floor(value * scale).cast("double").alias("down"),
        (high * scale).alias("high"), ((value - high) * scale).alias("low"),
    )
    return once(parts, lambda p: rounded_whole(p["down"], (p["high"] - (p["down"] + 0.5)) + p["low"]))


def fixed_point(value: Column, places: int, grouped: bool = False) -> Column:
    """The value with a fixed number of decimals, with thousands separators if `grouped`."""
    return F.format_string(f"%{',' if grouped else ''}.{places}f", nearest(value, places) / 10.0**places)


def three_digits(value: Column) -> Column:
    """A number with three significant digits, in exponent form outside 1e-4 to 1e3."""
    exponent = F.regexp_extract(F.format_string("%.17e", F.abs(value)), r"e([+-]\d+)$", 1).cast("int")
    known = F.struct(F.abs(value).alias("size"), exponent.alias("exponent"), (value < 0).alias("minus"))
    return F.when(value == 0, "0").otherwise(once(known, _three_digits_of))


def _three_digits_of(v: Column) -> Column:
    size, exponent = v["size"], v["exponent"]
    large = F.pow(F.lit(10.0), exponent - 2)
    long_number = once(
        F.struct(F.floor(size / large).cast("double").alias("down"), large.alias("unit"), size.alias("size")),
        lambda p: rounded_whole(p["down"], p["size"] - (p["down"] + 0.5) * p["unit"]),
    )
    digits = F.when(exponent > 2, long_number).otherwise(nearest(size, 2 - exponent))
    shown = F.struct(digits.alias("digits"), exponent.alias("exponent"), v["minus"].alias("minus"))
    carried = once(shown, lambda s: F.struct(
        F.when(s["digits"] >= 1000, 100.0).otherwise(s["digits"]).alias("digits"),
        (s["exponent"] + (s["digits"] >= 1000).cast("int")).alias("exponent"), s["minus"].alias("minus"),
    ))
    return once(carried, _digits_as_text)


def _digits_as_text(s: Column) -> Column:
    digits, exponent = s["digits"], s["exponent"]
    exponential = (exponent < -4) | (exponent >= 3)
    number = reduce(
        lambda chain, d: chain.when(exponent == 2 - d, F.format_string(f"%.{d}f", digits / 10.0**d)),
        range(7), F.when(exponential, F.format_string("%.2f", digits / 100)),
    )
    trimmed = once(number, lambda n: F.when(n.contains("."), F.regexp_replace(n, r"\.?0+$", "")).otherwise(n))
    return F.concat(
        F.when(s["minus"], "-").otherwise(""), trimmed,
        F.when(exponential, F.format_string("e%+03d", exponent)).otherwise(""),
    )


def shown_value(value: Column, kind: str = "double") -> Column:
    """A feature value for a reader: missing, yes/no, whole number, short number or text."""
    if kind == "boolean":
        text = F.when(value, "yes").otherwise("no")
    elif kind in ("double", "float"):
        text = three_digits(value.cast("double"))
        return F.when(value.isNull() | F.isnan(value), "not recorded").otherwise(text)
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "not recorded").otherwise(text)


def plain_name(feature: Column) -> Column:
    """What a feature column means, by the glossary and the naming rules."""
    glossary = F.create_map(*[F.lit(x) for pair in GLOSSARY.items() for x in pair])
    base = F.regexp_replace(feature, "_(isna|freq)$", "")
    found = F.struct(feature.alias("name"), base.alias("base"))
    names = once(found, lambda f: F.struct(
        f["name"].alias("name"), F.try_element_at(glossary, f["name"]).alias("exact"),
        F.coalesce(F.try_element_at(glossary, f["base"]), f["base"]).alias("root"),
    ))
    return once(names, lambda n: (
        F.when(n["exact"].isNotNull(), n["exact"])
        .when(n["name"].endswith("_isna"), F.concat(F.lit("missing "), n["root"]))
        .when(n["name"].endswith("_freq"), F.concat(F.lit("how common "), n["root"], F.lit(" is")))
        .when(n["name"].startswith("V"), F.concat(F.lit("anonymised behavioural signal "), n["name"]))
        .otherwise(n["name"])
    ))


def joined_list(items: Column) -> Column:
    """`a, b and c`."""
    n = F.size(items)
    head = F.array_join(F.slice(items, 1, F.greatest(n - 1, F.lit(1))), ", ")
    return F.when(n == 1, F.element_at(items, 1)).when(
        n > 1, F.concat(head, F.lit(" and "), F.element_at(items, -1))
    )


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{SPACE}|{SPACE}\\z", "")


def chunks(text: Column, words: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping windows of `words` words; a short text stays as it is, a blank one gives none."""
    return once(stripped(text), lambda clean: F.when(
        clean == "", F.array().cast("array<string>")
    ).otherwise(once(F.split(clean, SPACE), lambda tokens: _windows(clean, tokens, words, overlap))))


def _windows(clean: Column, tokens: Column, words: int, overlap: int) -> Column:
    step = max(1, words - overlap)
    last = F.ceil((F.size(tokens) - words) / F.lit(step)).cast("int")
    return F.when(F.size(tokens) <= words, F.array(clean)).otherwise(F.transform(
        F.sequence(F.lit(0), F.greatest(last, F.lit(0))),
        lambda k: F.array_join(F.slice(tokens, k * step + 1, F.lit(words)), " "),
    ))


def chunk_rows(df: DataFrame, text: str, keep: list[str], **sizes: int) -> DataFrame:
    """(keep..., chunk, text): every document of `df` cut into numbered chunks."""
    return df.select(*keep, F.posexplode(chunks(F.col(text), **sizes)).alias("chunk", "text"))


def content_words(text: Column) -> Column:
    """Lower-case words of four or more plain letters without the stop words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z]{4,})"), 1)
    return F.filter(words, lambda w: ~w.isin(*STOP_WORDS))
