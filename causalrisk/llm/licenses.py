"""License scan by diagonal voting.

Tasks turn each text into the hashes of its word pairs, one per place. Spark
joins all of them to the places of the same pairs in the license templates (a
fixed small table, broadcast), and every match votes for a diagonal: the place
in the text less the place in the template. A diagonal with a vote from every
place of a base phrase is an occurrence of it. For the longer templates
neighbouring diagonals are merged, so that a word put in or left out does not
split a span, and a span is verified by the share of template places it has, by its length in the
text, and by the word pair that tells the license from its neighbours: without
`gnu lesser` a span is not the LGPL's, however much of the rest it has.

Each text also carries one mark that always matches, so texts without any
license come out of the same join with their number of words, and nothing has
to be joined back.

Defined results: a null or empty text has no words, no labels and score 0.
Repeated rows are all returned with the same findings. Documents that share an
id but not the text are kept apart by the hash of the text. Texts of any length
are read whole. Labels of equal cover are all given. An empty table gives no
rows. Only the two named columns are read, so others may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from causalrisk.llm.common import bounded_batches
from causalrisk.llm.words import ALNUM, gram_hashes, text_chunks

#: Diagonals at most this far apart are merged; share of a template's places that a span needs; longest span for a template's length.
SHIFT, COVER, STRETCH = 2, 0.6, 1.5
MARK = -1


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    base: bool = False
    need: str = ""  # the word pair without which a span is another license's


#: Phrases that must be found, and wordings of common licenses with the pair that tells each from its neighbours.
TEMPLATES = (
    Template("cc-by", "cc by", True),
    Template("gpl", "general public license", True),
    Template("reserved", "all rights reserved", True),
    Template("cc-by-nc", "licensed under cc by nc 4 0", need="by nc"),
    Template("cc-by-sa", "licensed under cc by sa 4 0", need="by sa"),
    Template("apache", "licensed under the apache license version 2 0", need="apache license"),
    Template("mit", "licensed under the mit license", need="mit license"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy"),
    Template("mit", "the software is provided as is without warranty of any kind express or implied"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    Template("gpl", "this work is licensed under the gnu general public license version 3", need="gnu general"),
    Template("gpl", "this program is free software you can redistribute it and or modify it"),
    Template("lgpl", "licensed under the gnu lesser general public license", need="gnu lesser"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license", need="mozilla public"),
    Template("mpl", "mozilla public license version 2 0", need="mozilla public"),
    Template("public-domain", "this is free and unencumbered software released into the public domain"),
    Template("apache", "spdx license identifier apache 2 0", need="identifier apache"),
    Template("bsd", "spdx license identifier bsd 3 clause", need="identifier bsd"),
    Template("gpl", "spdx license identifier gpl 3 0", need="identifier gpl"),
    Template("lgpl", "spdx license identifier lgpl 3 0", need="identifier lgpl"),
    Template("mit", "spdx license identifier mit", need="identifier mit"),
    Template("mpl", "spdx license identifier mpl 2 0", need="identifier mpl"),
)


def _pairs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after, words per text, offsets, values): the pair hashes of each text, its last word's place void, then the mark."""
    for a, b, words in text_chunks(texts, ALNUM):
        n = np.diff(words.first)
        hashes = gram_hashes(words.hashes(), 2).view(np.int64)
        hashes = np.append(hashes, np.int64(0))[: len(words.start)]
        hashes[(hashes == MARK)] = 0
        hashes[words.first[1:][n > 0] - 1] = 0
        offsets = np.concatenate([[0], np.cumsum(n + 1)])
        values = np.full(int(offsets[-1]), MARK, dtype=np.int64)
        values[np.arange(len(hashes)) + words.text] = hashes
        yield a, b, n, offsets, values


def _gram_table(templates: tuple[Template, ...]) -> list[tuple[int, int, int, int, bool]]:
    """(pair hash, template, place in it, places of it, whether a span needs no other pair than this one)."""
    rows = [(MARK, -1, 0, 0, True)]
    for i, t in enumerate(templates):
        (_, _, n, _, values), = _pairs(pa.array([t.text]))
        words = t.text.split()
        rows += [(int(v), i, at, int(n[0]) - 1, t.need in ("", " ".join(words[at : at + 2]))) for at, v in enumerate(values[: int(n[0]) - 1])]
    return rows


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, n, offsets, values in _pairs(batch.column("text")):
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array(n, pa.int64()),
                 pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int64()))],
                names=["doc_id", "text_key", "n_words", "pairs"],
            )


def find_licenses(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """Per document (`doc_id`, `text`): n_words, n_base, first_word, last_word, base_labels, labels, score, and the verified `spans`."""
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    text = F.coalesce("text", F.lit(""))
    grams = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key")).mapInArrow(
        _scan, f"doc_id {id_type}, text_key bigint, n_words bigint, pairs array<bigint>"
    )
    table = F.broadcast(spark.createDataFrame(_gram_table(templates), "pair bigint, template int, place int, places int, decides boolean"))
    names = F.broadcast(spark.createDataFrame([(-1, "", False), *((i, t.label, t.base) for i, t in enumerate(templates))], "template int, label string, base boolean"))
    doc = ["doc_id", "text_key", "n_words"]
    votes = grams.select(*doc, F.posexplode("pairs").alias("at", "pair")).join(table, "pair")
    votes = votes.select(*doc, "template", "places", "place", "decides", F.when(F.col("template") >= 0, F.col("at") - F.col("place")).alias("diagonal"))
    # counted in the tasks before the shuffle, so equal rows of a hot text are few votes
    votes = votes.groupBy(*doc, "template", "places", "diagonal").agg(
        F.count("*").alias("n"), F.collect_set("place").alias("seen"), F.max("decides").alias("decides"),
    )
    same = W.partitionBy(*doc, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(same) > SHIFT, F.lit(True))
    votes = votes.withColumn("span", F.sum(apart.cast("int")).over(same)).join(names, "template")
    spans = votes.groupBy(*doc, "template", "places", "label", "base", "span").agg(
        F.when(F.col("template") < 0, F.max("n")).alias("rows"),
        F.array_sort(F.collect_list(F.when(F.col("base") & (F.size("seen") == F.col("places")), F.col("diagonal")))).alias("exact"),
        F.size(F.array_distinct(F.flatten(F.collect_list("seen")))).alias("covered"), F.max("decides").alias("decides"),
        F.min(F.col("diagonal") + F.array_min("seen")).alias("start"), (F.max(F.col("diagonal") + F.array_max("seen")) + 1).alias("end"),
    )
    long_enough = F.col("decides") & (F.col("covered") >= F.col("places") * COVER) & (F.col("end") - F.col("start") < (F.col("places") + 1) * STRETCH)
    spans = spans.withColumn("cover", F.when(F.col("base"), (F.size("exact") > 0).cast("double")).when(
        (F.col("template") >= 0) & long_enough, F.col("covered") / F.col("places")).otherwise(0.0))
    found = F.col("cover") > 0
    result = spans.groupBy(*doc).agg(
        F.max("rows").alias("rows"), F.flatten(F.collect_list("exact")).alias("exact"),
        F.array_sort(F.collect_set(F.when(found & F.col("base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set(F.when(found, F.col("label")))).alias("labels"), F.max("cover").alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct("start", "end", "label", "cover")))).alias("spans"),
    )
    result = result.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return result.select(
        "doc_id", "n_words", F.size("exact").cast("long").alias("n_base"), F.array_min("exact").cast("long").alias("first_word"),
        F.array_max("exact").cast("long").alias("last_word"), F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"), "spans",
    )
