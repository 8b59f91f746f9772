"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The automaton of all items is built once on the driver and sent to the tasks.
Tasks stream the words of their texts through it and follow the longest match
that ends at each word. A match of at least a window's length makes the window's
words hit.

The size of an automaton is bounded by ITEM_WORDS. More items are dealt to
several, an item above the bound to overlapping pieces of it; the texts run
through one automaton after the other, so that a task holds one at a time. What
each finds is kept by the text's hash, united, and joined back to the documents;
cut texts run through all of them again until nothing is left. `longest` is then
the longest match in one part.

Defined results: a null or empty text has no words and no hits; an item without
words has no windows; repeated documents are judged row by row; items with the
same id count as one; ids of any type are carried as text; the windows of an item
without id hit words, but it is not listed; an empty benchmark hits nothing, an
empty table of documents gives no rows; a very long text runs through the
automaton word by word, at the cost of its length; columns of the input with any
name are kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causalrisk.llm.common import bounded_batches, stored
from causalrisk.llm.words import ALNUM, gram_hashes, text_chunks

WINDOW = 10
#: Words of test items in one automaton (a state has about 0.5 KB on the driver).
ITEM_WORDS = 1_000_000
_ITEMS_SPANS = "items array<string>, spans array<struct<first:bigint,last:bigint,longest:bigint>>"
_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("longest", pa.int64())]))
LEAK = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<first:bigint,last:bigint,longest:bigint>>>"


@dataclass
class Automaton:
    """States are numbers, 0 is the start. `longest` and `link` are the usual ones of a suffix automaton."""

    moves: list[dict[int, int]]
    link: list[int]
    longest: list[int]
    window_items: dict[int, list[int]]  # per state that stands for one window's length: the items that hold it
    window_state: list[int]  # per state: the ancestor that stands for its last WINDOW words, or -1
    short_items: list[list[tuple[int, int]]]  # per state: (words, item) of whole short items that end here
    vocabulary: np.ndarray  # sorted word hashes; a word's place is its number
    pairs: np.ndarray  # sorted numbers of neighbouring words, first * len(vocabulary) + second
    least: int  # words of the shortest window
    names: list[str | None]  # per item number: its id

    def listed(self, found: set[int]) -> list[str]:
        """Ids of items, in order; an item without id is not listed."""
        return sorted(self.names[i] for i in found if self.names[i] is not None)


def build(items: list[tuple[str | None, np.ndarray]], window: int = WINDOW) -> Automaton:
    """items: (item id, hashes of its words); items are numbers inside, equal ids the same one."""
    numbers: dict[str | None, int] = {}
    items = [(numbers.setdefault(i, len(numbers)), h) for i, h in items]
    known = [h for _, h in items if len(h)]
    vocabulary = np.unique(np.concatenate(known)) if known else np.zeros(0, dtype=np.uint64)
    moves: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def split(p: int, q: int, word: int) -> int:
        """A copy of q that keeps only the contexts as long as those of p and one word."""
        new = len(moves)
        moves.append(dict(moves[q]))
        longest.append(longest[p] + 1)
        link.append(link[q])
        link[q] = new
        while p != -1 and moves[p].get(word) == q:
            moves[p][word] = new
            p = link[p]
        return new

    def extend(last: int, word: int) -> int:
        q = moves[last].get(word)
        if q is not None:
            return q if longest[q] == longest[last] + 1 else split(last, q, word)
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p != -1 and word not in moves[p]:
            moves[p][word] = new
            p = link[p]
        if p != -1:
            q = moves[p][word]
            link[new] = q if longest[q] == longest[p] + 1 else split(p, q, word)
        return new

    numbered = [(i, np.searchsorted(vocabulary, h)) for i, h in items if len(h)]
    for _, words in numbered:
        last = 0
        for w in words.tolist():
            last = extend(last, w)
    window_items: dict[int, set[int]] = {}
    ends: dict[int, list[tuple[int, int]]] = {}
    for item, words in numbered:
        state = 0
        for at, w in enumerate(words.tolist(), 1):
            state = moves[state][w]
            if at >= window:
                s = state
                while longest[link[s]] >= window:
                    s = link[s]
                window_items.setdefault(s, set()).add(item)
        if len(words) < window:
            s = state
            while longest[link[s]] >= len(words):
                s = link[s]
            ends.setdefault(s, []).append((len(words), item))
    window_state, short_items = [-1] * len(moves), [[] for _ in moves]
    for s in sorted(range(1, len(moves)), key=longest.__getitem__):
        up = link[s]
        if longest[s] >= window:
            window_state[s] = s if longest[up] < window else window_state[up]
        short_items[s] = (short_items[up] if up > 0 else []) + ends.get(s, [])
    width = max(1, len(vocabulary))
    pairs = np.unique(np.concatenate([w[:-1] * width + w[1:] for _, w in numbered])) if numbered else np.zeros(0, dtype=np.int64)
    least = min([min(len(w), window) for _, w in numbered], default=window)
    return Automaton(moves, link, longest, {s: sorted(i) for s, i in window_items.items()}, window_state, short_items, vocabulary, pairs, least, list(numbers))


def _runs(words: np.ndarray, automaton: Automaton) -> list[tuple[int, int]]:
    """Stretches of known words, each next to the one before as in some item: no longer match leaves them."""
    good = words >= 0
    joined = np.zeros(len(words) + 1, dtype=bool)
    if len(words) > 1:
        pair = words[:-1] * max(1, len(automaton.vocabulary)) + words[1:]
        at = np.minimum(np.searchsorted(automaton.pairs, pair), max(0, len(automaton.pairs) - 1))
        joined[1:-1] = good[:-1] & good[1:] & (automaton.pairs[at] == pair if len(automaton.pairs) else False)
    start = np.flatnonzero(good & ~joined[:-1])
    stop = np.flatnonzero(good & ~joined[1:]) + 1
    long = stop - start >= automaton.least
    return list(zip(start[long].tolist(), stop[long].tolist(), strict=True))


def matches(words: np.ndarray, automaton: Automaton, window: int = WINDOW) -> tuple[list[list[int]], set[int]]:
    """Hit spans [first, last, longest match in it] of one text's word numbers (-1: in no item), and the items found."""
    moves, link, longest = automaton.moves, automaton.link, automaton.longest
    spans: list[list[int]] = []
    states: set[int] = set()
    found: set[int] = set()
    for start, stop in _runs(words, automaton):
        state = length = 0
        for at, w in enumerate(words[start:stop].tolist(), start):
            step = moves[state].get(w)
            while step is None and state:
                state = link[state]
                length = longest[state]
                step = moves[state].get(w)
            if step is None:
                continue
            state, length = step, length + 1
            reach = 0
            if length >= window:
                reach = window
                states.add(automaton.window_state[state])
            for size, item in automaton.short_items[state]:
                if size <= length:
                    found.add(item)
                    reach = max(reach, size)
            if reach:
                first = at - reach + 1
                best = length
                while spans and spans[-1][1] >= first - 1:
                    before = spans.pop()
                    first, best = min(first, before[0]), max(best, before[2])
                spans.append([first, at, best])
    for s in states:
        found.update(automaton.window_items[s])
    return spans, found


def word_numbers(hashes: np.ndarray, vocabulary: np.ndarray) -> np.ndarray:
    if not len(vocabulary):
        return np.full(len(hashes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == hashes, at, -1).astype(np.int64)


def _item_words(ids: list, texts: pa.Array) -> list[tuple[str | None, np.ndarray]]:
    out = []
    for a, b, words in text_chunks(texts, ALNUM):
        h = words.hashes()
        out += [(ids[r], h[words.first[r - a] : words.first[r - a + 1]]) for r in range(a, b)]
    return out


def _removable(spans: list[list[int]], max_words: int) -> list[list[int]]:
    return [s for s in spans if s[2] >= max_words]


def _cut(text: str, automaton: Automaton, window: int, max_words: int) -> str:
    """The text without its removable spans; repeated, as what is left on both sides may join to a new match."""
    while True:
        (_, _, words), = text_chunks(pa.array([text]), ALNUM)
        spans = _removable(matches(word_numbers(words.hashes(), automaton.vocabulary), automaton, window)[0], max_words)
        if not spans:
            return text
        text = _without(text, words, spans)


def _without(text: str, words, spans: list[list[int]]) -> str:
    data, kept, at = text.encode(), [], 0
    for first, last, _ in spans:
        kept.append(data[at : words.start[first]])
        at = int(words.end[last])
    return b"".join([*kept, data[at:]]).decode()


def _scan(sent, window: int, cut_from: int | None, max_coverage: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = sent.value
        for batch in batches:
            texts = batch.column("text")
            n_words, n_hit, items, spans, cut = [], [], [], [], []
            for a, b, words in text_chunks(texts, ALNUM):
                number = word_numbers(words.hashes(), automaton.vocabulary)
                for r in range(b - a):
                    own = number[words.first[r] : words.first[r + 1]]
                    hit, found = matches(own, automaton, window) if len(own) else ([], set())
                    n_words.append(len(own))
                    n_hit.append(sum(last - first + 1 for first, last, _ in hit))
                    items.append(automaton.listed(found))
                    spans.append([{"first": f, "last": t, "longest": k} for f, t, k in hit])
                    if cut_from is not None:
                        removable = _removable(hit, cut_from) and n_hit[-1] <= max_coverage * len(own)
                        cut.append(_cut(texts[a + r].as_py(), automaton, window, cut_from) if removable else None)
            leak = pa.StructArray.from_arrays(
                [pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)],
                names=["n_words", "n_hit", "items", "spans"],
            )
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
            if cut_from is not None:
                rest += [("text", texts), ("cut_text", pa.array(cut, pa.string()))]
            yield pa.RecordBatch.from_arrays([*(c for _, c in rest), leak], names=[*(n for n, _ in rest), "leak"])

    return run


def _parts(items: DataFrame, item_words: int, least: int) -> list[list[tuple[str | None, np.ndarray]]]:
    """The items' words in parts of at most `item_words`; longer items are cut in pieces that share all but one of `least` words."""
    bounded_batches(items.sparkSession)
    if item_words < least:
        raise ValueError(f"items cannot be scanned in parts of {item_words} words, as a match has up to {least}")
    table = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).toArrow()
    parts: list[list[tuple[str | None, np.ndarray]]] = [[]]
    size, step = 0, item_words - least + 1
    for item, words in _item_words(table["item_id"].to_pylist(), table["text"]):
        for at in range(0, max(1, len(words) - least + 1), step):
            piece = words[at : at + item_words]
            if size + len(piece) > item_words:
                parts.append([])
                size = 0
            parts[-1].append((item, piece))
            size += len(piece)
    return parts


def _part_scan(sent, window: int):
    """(text_key, items, spans) of the texts that one part's items hit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton: Automaton = sent.value
        for batch in batches:
            keys = batch.column("text_key")
            rows, items, spans = [], [], []
            for a, b, words in text_chunks(batch.column("text"), ALNUM):
                number = word_numbers(words.hashes(), automaton.vocabulary)
                for r in range(b - a):
                    hit, found = matches(number[words.first[r] : words.first[r + 1]], automaton, window)
                    if hit:
                        rows.append(a + r)
                        items.append(automaton.listed(found))
                        spans.append([{"first": f, "last": t, "longest": k} for f, t, k in hit])
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(rows, pa.int64())), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], names=["text_key", "items", "spans"],
            )

    return run


def _part_hits(texts: DataFrame, parts: list, window: int) -> DataFrame:
    """(text_key, items, spans) of the different texts (`text_key`, `text`) with a hit, all parts together."""
    found = None
    for part in parts:
        sent = texts.sparkSession.sparkContext.broadcast(build(part, window))
        hits = texts.select("text_key", "text").mapInArrow(_part_scan(sent, window), f"text_key string, {_ITEMS_SPANS}")
        hits = stored(hits.groupBy("text_key").agg(F.first("items").alias("items"), F.first("spans").alias("spans")), "hits")
        sent.unpersist()
        found = hits if found is None else found.unionByName(hits)
    both = [F.flatten(F.collect_list(c)).alias(c) for c in ("items", "spans")]
    return stored(found.groupBy("text_key").agg(*both), "part_hits")


def _united(spans: list[dict]) -> list[list[int]]:
    """Spans of several parts, those that meet as one."""
    out: list[list[int]] = []
    for first, last, best in sorted((s["first"], s["last"], s["longest"]) for s in spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = [out[-1][0], max(last, out[-1][1]), max(best, out[-1][2])]
        else:
            out.append([first, last, best])
    return out


def _unite_scan(cut_from: int | None, max_coverage: float):
    """`leak`, and the text after one cut, from the hits of all parts; the other columns but text, items and spans as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            leaks, cut = [], []
            for a, b, words in text_chunks(texts, ALNUM):
                for r in range(a, b):
                    hit = _united(batch.column("spans")[r].as_py() or [])
                    n_words, n_hit = int(words.first[r - a + 1] - words.first[r - a]), sum(last - first + 1 for first, last, _ in hit)
                    leaks.append({
                        "n_words": n_words, "n_hit": n_hit, "items": sorted(set(batch.column("items")[r].as_py() or [])),
                        "spans": [{"first": f, "last": t, "longest": k} for f, t, k in hit],
                    })
                    removable = _removable(hit, cut_from) if cut_from is not None and n_hit <= max_coverage * n_words else []
                    if removable:
                        text = texts[r].as_py()
                        (_, _, own), = text_chunks(pa.array([text]), ALNUM)
                        cut.append(_without(text, own, removable))
                    else:
                        cut.append(None)
            rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n not in ("text", "items", "spans")]
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", _SPANS)])
            more = [("cut_text", pa.array(cut, pa.string())), ("leak", pa.array(leaks, kind))]
            yield pa.RecordBatch.from_arrays([c for _, c in [*rest, *more]], names=[n for n, _ in [*rest, *more]])

    return run


def _final_cuts(texts: DataFrame, hits: DataFrame, parts: list, window: int, max_words: int, max_coverage: float) -> DataFrame:
    """(text_key, cut_text) of the texts with removable spans: cut until no part finds any."""
    spark = texts.sparkSession
    now, done = texts.join(hits, "text_key").dropDuplicates(["text_key"]).withColumn("whole", F.col("text_key")), None
    while True:
        cut = now.select("whole", "text", "items", "spans").mapInArrow(_unite_scan(max_words, max_coverage), f"whole string, cut_text string, leak {LEAK}")
        cut = stored(cut.where("cut_text is not null").select("whole", F.col("cut_text").alias("text"), _text_key("cut_text")), "cuts")
        # what is cut again replaces what it was before
        again = cut.select("whole", "text")
        done = again if done is None else stored(done.join(again, "whole", "left_anti").unionByName(again), "cut_texts")
        if cut.isEmpty():
            return done.select(F.col("whole").alias("text_key"), F.col("text").alias("cut_text"))
        max_coverage = 1.0
        now = cut.join(_part_hits(cut, parts, window), "text_key")


def _text_key(name: str):
    return F.sha2(F.coalesce(F.col(name), F.lit("")), 256).alias("text_key")


def _scanned(docs: DataFrame, items: DataFrame, window: int, max_words: int | None, max_coverage: float, item_words: int) -> DataFrame:
    """`row` (all columns but the text), `text`, `cut_text` (null where nothing is cut; both only with `max_words`) and `leak`."""
    parts = _parts(items, item_words, max(window, max_words or 0))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]).alias("row"), F.col("text"))
    kind = rows.schema["row"].dataType.simpleString()
    if len(parts) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(build(parts[0], window))
        texts = "" if max_words is None else "text string, cut_text string, "
        return rows.mapInArrow(_scan(sent, window, max_words, max_coverage), f"row {kind}, {texts}leak {LEAK}")
    keyed = rows.select("row", "text", _text_key("text"))
    hits = _part_hits(keyed, parts, window)
    counted = keyed.join(hits, "text_key", "left")
    if max_words is None:
        counted = counted.select("row", "text", "items", "spans").mapInArrow(_unite_scan(None, 1.0), f"row {kind}, cut_text string, leak {LEAK}")
        return counted.select("row", "leak")
    counted = counted.select("row", "text_key", F.col("text").alias("own_text"), "text", "items", "spans").mapInArrow(
        _unite_scan(None, 1.0), f"row {kind}, text_key string, own_text string, cut_text string, leak {LEAK}"
    )
    counted = counted.select("row", F.col("own_text").alias("text"), "text_key", "leak")
    cuts = _final_cuts(keyed.select("text_key", "text"), hits, parts, window, max_words, max_coverage)
    return counted.join(cuts, "text_key", "left").select("row", "text", "cut_text", "leak")


def find_leaks(docs: DataFrame, items: DataFrame, window: int = WINDOW, item_words: int = ITEM_WORDS) -> DataFrame:
    """`row` (all columns of the document) and `leak` of every document; items: `item_id`, `text`.

    leak: words of the text, hit words, ids of the items with a window in it, and
    the hit spans (first and last word, longest match that ends in the span).
    """
    return _scanned(docs, items, window, None, 1.0, item_words)


def decontaminate(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = WINDOW, max_coverage: float = 0.5, item_words: int = ITEM_WORDS,
) -> DataFrame:
    """The documents without the spans in which a match of `max_words` words or more ends.

    A document of whose words more than `max_coverage` are hit goes as a whole.
    `n_chars`, where there is such a column, follows a cut text.
    """
    found = _scanned(docs, items, window, max_words, max_coverage, item_words)
    kept = found.where(F.col("leak.n_hit") <= F.lit(max_coverage) * F.col("leak.n_words"))
    out = []
    for c in docs.columns:
        if c.lower() == "text":
            out.append(F.coalesce("cut_text", "text").alias(c))
        elif c.lower() == "n_chars":
            own = docs.schema[c].dataType
            out.append(F.when(F.col("cut_text").isNotNull(), F.length("cut_text").cast(own)).otherwise(F.col("row").getField(c)).alias(c))
        else:
            out.append(F.col("row").getField(c).alias(c))
    return kept.select(*out)
