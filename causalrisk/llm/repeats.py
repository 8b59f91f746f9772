"""Removal of long repeats by difference-cover anchors.

The places of a text are numbered from 0. COVER is a difference cover modulo
PERIOD: for any two places there is a shift below PERIOD that brings both to a
place whose remainder lies in it. So two equal windows of `window` words share
an anchor, a run of window - PERIOD + 1 words that starts at a cover place in
both texts, wherever the windows start. Only the anchors (5 of 21 places) are
hashed and shuffled. An anchor that occurs twice is extended to the PERIOD
windows around it, and only these windows are compared.

A repeat needs no pairs: an anchor or a window is repeated if its number of
occurrences is at least two. Tasks count what repeats within a batch of texts
first, so that of a passage in a third of all texts each batch passes on one
row; the others of the batch are known to be repeated and go on under numbers
of their own, spread over all tasks. Equal texts are compared once, with their
number of copies.

Anchors have 64-bit hashes, as they only select; windows have 128 bits, made of
64-bit hashes of their words. Texts are known by 128 bits.

Defined results: words are runs of other than ASCII white space, case counts.
A null or empty text has no words, a text of fewer than `window` words loses
none. Windows are judged on the input, so all copies of a passage go, the first
one too. Repeated rows are copies of each other. A text of any length is read
whole; its words are held as arrays of numbers, and as bytes by pieces. An empty
table gives no rows. Columns of the input with any name are kept inside `row`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from causalrisk.llm.common import bounded_batches, stored
from causalrisk.llm.words import NOT_SPACE, mix, rolling_hashes, text_chunks

WINDOW = 35
#: Fixed value: a perfect difference set; each of 1 to 20 is the difference of exactly one pair modulo 21.
COVER, PERIOD = (0, 1, 4, 14, 16), 21
#: Bytes of a text whose words are held as single objects at once.
PIECE = 1_000_000

KEPT = "struct<n_words:bigint,n_removed:bigint,text:string,spans:array<struct<first:bigint,last:bigint>>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_KEPT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string()), ("spans", _SPANS)])
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def _slots(keys: list[np.ndarray], weight: np.ndarray, own: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers to count by, and weights of at most 2, of a batch's rows.

    The first of equal rows stands for all under their common number, with the
    sum of their weights; the others, already known as repeated, get a number of
    their own from `own`.
    """
    order = np.lexsort(keys[::-1])
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    group = np.cumsum(fresh) - 1
    total = np.bincount(group, weights=weight[order], minlength=1)[group] if len(order) else np.zeros(0)
    summed = np.empty(len(order), dtype=np.int32)
    summed[order] = np.minimum(total, 2)
    alone = np.empty(len(order), dtype=bool)
    alone[order] = ~fresh
    return [np.where(alone, mix(k ^ own), k).view(np.int64) for k in keys], summed


def _anchors(window: int):
    """(slot, key, place, n) of all anchors of texts with a window."""
    size, cover = window - PERIOD + 1, np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text_key = batch.column("key").to_numpy()
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, _, words in text_chunks(batch.column("text"), NOT_SPACE, lower=False):
                hashes = rolling_hashes(words.hashes(), size)
                text = words.text[: len(hashes)]
                count = np.diff(words.first)
                place = np.arange(len(hashes)) - words.first[text]
                at = np.flatnonzero(cover[place % PERIOD] & (place + size <= count[text]) & (count[text] >= window))
                found.append((hashes[at], text_key[a + text[at]], place[at]))
            hashes, keys, place = map(np.concatenate, zip(*found, strict=True))
            own = mix(keys.view(np.uint64)) + place.astype(np.uint64)
            (slot,), n = _slots([hashes], np.ones(len(hashes)), own)
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(keys), pa.array(place.astype(np.int32)), pa.array(n)], names=["slot", "key", "place", "n"])

    return run


def _windows(window: int):
    """(slot_a, slot_b, uid, start, n) of the windows around the repeated anchors of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uid, copies = batch.column("uid").to_numpy(), batch.column("copies").to_numpy()
            places = batch.column("places")
            bounds, flat = places.offsets.to_numpy() - places.offsets[0].as_py(), places.flatten().to_numpy().astype(np.int64)
            found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
            for a, b, words in text_chunks(batch.column("text"), NOT_SPACE, lower=False):
                word_hashes = words.hashes()
                first, second = rolling_hashes(word_hashes, window), rolling_hashes(word_hashes, window, seed=1)
                place = flat[bounds[a] : bounds[b]]
                text = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
                low = np.maximum(place - PERIOD + 1, 0)
                high = np.minimum(place, np.diff(words.first)[text] - window)
                there = low <= high
                begin = words.first[text]
                marks = np.bincount((begin + low)[there], minlength=len(first) + 1) - np.bincount((begin + high)[there] + 1, minlength=len(first) + 1)
                at = np.flatnonzero(np.cumsum(marks)[: len(first)])
                own = words.text[at]
                found.append((first[at], second[at], a + own, at - words.first[own]))
            first, second, row, start = map(np.concatenate, zip(*found, strict=True))
            own = mix(uid[row].astype(np.uint64)) + start.astype(np.uint64)
            (one, two), n = _slots([first, second], copies[row].astype(float), own)
            columns = [pa.array(one), pa.array(two), pa.array(uid[row]), pa.array(start.astype(np.int32)), pa.array(n)]
            yield pa.RecordBatch.from_arrays(columns, names=["slot_a", "slot_b", "uid", "start", "n"])

    return run


def _without(data: bytes, spans: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Number of words, number of removed words, and the others joined by a space."""
    at, n, removed, nth, out = 0, 0, 0, 0, []
    while at < len(data):
        cut = _SPACE.search(data, at + PIECE) if len(data) - at > PIECE else None
        stop = cut.start() if cut else len(data)
        own = data[at:stop].split()
        begin, k = n, 0
        n, at = n + len(own), stop
        while nth < len(spans) and spans[nth][0] < n:
            first, last = max(spans[nth][0] - begin, 0), min(spans[nth][1] + 1 - begin, len(own))
            out += own[k:first]
            removed, k = removed + last - first, last
            if spans[nth][1] >= n:
                break
            nth += 1
        out = [b" ".join(out + own[k:])] if out or own[k:] else []
    return n, removed, b"".join(out)


def _cut(window: int):
    """`row` and `kept` from the text, `whole` (all of it repeats) and the runs of starts of repeated windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            out = []
            for text, whole, runs in zip(texts, batch.column("whole"), batch.column("runs"), strict=True):
                data, whole, spans = text.as_py() or b"", whole.as_py(), []
                for r in runs.as_py() or []:
                    if spans and r["first"] <= spans[-1][1] + 1:
                        spans[-1] = (spans[-1][0], r["last"] + window - 1)
                    else:
                        spans.append((r["first"], r["last"] + window - 1))
                n, removed, kept = _without(data, [(0, len(data))] if whole else spans)
                if whole:
                    spans = [(0, n - 1)]
                out.append({"n_words": n, "n_removed": removed, "text": kept.decode(), "spans": [{"first": f, "last": t} for f, t in spans]})
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(out, _KEPT)], names=["row", "kept"])

    return run


def repeated_runs(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(key, key2, whole, runs) of every different text with a repeated window: runs of starts of such windows, or all of it."""
    if window <= PERIOD:
        raise ValueError(f"a window needs more than {PERIOD} words")
    bounded_batches(docs.sparkSession)
    keyed = docs.select(F.xxhash64("text").alias("key"), F.col("text").cast("string").alias("text")).where("text is not null")
    anchors = keyed.mapInArrow(_anchors(window), "slot bigint, key bigint, place int, n int")
    twice = anchors.withColumn("total", F.sum("n").over(W.partitionBy("slot"))).where("total >= 2")
    repeated = stored(twice.groupBy("key").agg(F.collect_set("place").alias("places")), "repeated_anchors")
    keys = stored(repeated.select("key"), "repeated_keys")
    texts = keyed.join(keys, "key", "left_semi").groupBy("key", "text").agg(F.count("*").alias("copies")).join(repeated, "key")
    texts = stored(texts.withColumn("uid", F.monotonically_increasing_id()), "repeated_texts")
    windows = texts.mapInArrow(_windows(window), "slot_a bigint, slot_b bigint, uid bigint, start int, n int")
    twice = windows.withColumn("total", F.sum("n").over(W.partitionBy("slot_a", "slot_b"))).where("total >= 2")
    # starts of neighbouring windows as runs
    starts = twice.groupBy("uid").agg(F.array_sort(F.collect_list("start")).alias("s"))
    firsts = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1) < x - 1))
    lasts = F.filter("s", lambda x, i: (i == F.size("s") - 1) | (F.get("s", i + 1) > x + 1))
    runs = starts.select("uid", F.arrays_zip(firsts.alias("first"), lasts.alias("last")).alias("runs"))
    named = texts.select("uid", "key", F.xxhash64(F.lit(1), "text").alias("key2"), (F.col("copies") > 1).alias("whole"))
    found = named.join(runs, "uid", "left").where("whole or runs is not null")
    return stored(found.select("key", "key2", "whole", F.when(~F.col("whole"), F.col("runs")).alias("runs")), "repeated_runs")


def remove_repeats(docs: DataFrame, keep: list[str] | None = None, window: int = WINDOW) -> DataFrame:
    """`row` (columns of the document, all or those to keep) and `kept` of every document.

    kept: words of the text, words in a window that occurs elsewhere too, the
    other words joined by one space, and the removed spans (first and last word).
    """
    found = repeated_runs(docs, window)
    columns = docs.columns if keep is None else keep
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text")).withColumn("key2", F.xxhash64(F.lit(1), "text"))
    joined = rows.join(found, ["key", "key2"], "left").select("row", "text", "whole", "runs")
    return joined.mapInArrow(_cut(window), f"row {rows.schema['row'].dataType.simpleString()}, kept {KEPT}")
