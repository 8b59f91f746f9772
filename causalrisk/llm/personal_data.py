"""Personal data: fixed patterns, and bootstrapped extraction from the contexts that they stand in.

Entities that the fixed patterns find are seeds. The word and the two words
before a seed, and those after it, are its lexical patterns. Spark counts how many different seeds each pattern stands
beside; patterns with enough of them are searched in the whole corpus, together
with all that stands beside them: seeds, other identifier-like words, and plain
words. Neighbouring words with a digit or an `@` make one identifier. This graph of patterns and instances is scored in turns: a pattern by the
mean confidence of what stands beside it, an instance by its best pattern. Patterns
that end above the limit extract the identifier-like words beside them.

Texts are read three times and never shuffled; counts are summed in the tasks
first. All patterns are scored, PATTERNS of them in one reading of the texts; the
sure ones go to the tasks as nine bytes each.

Defined results: a null or empty text has no entities. Repeated rows are
returned one by one. Places are code points, ends are exclusive. Of kinds with equal
scores the later name wins. Texts of any length are read whole. An empty table
gives no rows. Kept columns lie inside `row` and may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causalrisk.llm.common import bounded_batches, stored
from causalrisk.llm.words import NOT_SPACE, byte_class, gram_hashes, mix, text_chunks

KINDS = ("email", "ip", "card", "phone")
#: Patterns that one reading of the texts looks for; seeds a pattern needs; weight of the doubt; rounds; confidence from which a pattern extracts.
PATTERNS, SEEDS, DOUBT, ROUNDS, SURE = 100_000, 5, 2.0, 3, 0.8

# The four kinds. Look-behinds and possessive repeats only keep the
# search linear; what is found is the leftmost longest match of each kind.
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: What an identifier that no fixed pattern knows may look like: four digits or more, or an `@`.
_LIKE = re.compile(r"(?:[^0-9]*[0-9]){4}|[^@]+@", re.S)
_MARK, _STOP = byte_class([(0x30, 0x39), (0x40, 0x40)]), byte_class([(ord(c), ord(c)) for c in ".,;:!?"])

_EDGE = ".,;:!?()[]{}<>\"'"


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Around each `@` with a domain: back over the letters of the local part, at most to the end of the match before."""
    out, free = [], 0
    if "@" not in text:
        return out
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            out.append((start, m.end()))
            free = m.end()
    return out


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m.groups())]


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    if "+" not in text:
        return []
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m.group())) <= 15]


def entities(text: str) -> list[tuple[str, int, int]]:
    """The spans of the fixed patterns by kind, then start."""
    found = [("email", *s) for s in emails(text)]
    if _DIGIT.search(text):
        found += [("ip", *s) for s in ips(text)] + [("card", *s) for s in cards(text)] + [("phone", *s) for s in phones(text)]
    return found


class _Contexts:
    """Per chunk of texts: the word of a byte place, the patterns beside each word, and runs of words that may be one identifier."""

    def __init__(self, words, taken: dict[int, list[tuple[str, int, int]]], texts: list):
        """taken: the entities of each row."""
        self.words = words
        n = len(words.start)
        h = words.hashes()
        two = gram_hashes(h, 2)
        at = np.arange(n)
        before, after = at - words.first[words.text], words.first[words.text + 1] - 1 - at
        #: (hash of the pattern, whether there is one) per word; the first two stand before it, the others after it.
        self.beside = []
        for shift, source, have in ((1, h, before >= 1), (2, two, before >= 2), (-1, h, after >= 1), (-2, two, after >= 2)):
            hashes = np.zeros(n, dtype=np.uint64)
            salt = np.uint64(shift + 2)
            if shift > 0:
                hashes[shift:] = mix(source[: max(0, n - shift)] + salt)
            else:
                hashes[:shift] = mix(source[1:] + salt)
            self.beside.append((hashes.view(np.int64), have))
        #: Per row and entity: (kind, value, first word, last word).
        self.own: dict[int, list[tuple[str, str, int, int]]] = {}
        covered = np.zeros(n, dtype=bool)
        for r, found in taken.items():
            for kind, start, end in found:
                first, last = self.word_at(r, texts[r], start), self.word_at(r, texts[r], end - 1)
                covered[first : last + 1] = True
                self.own.setdefault(r, []).append((kind, texts[r][start:end], first, last))
        self.covered = covered
        marks = np.concatenate([[0], np.cumsum(_MARK[words.bytes])])
        self.marked = (marks[words.end] > marks[words.start]) & ~covered
        joined = np.zeros(n + 1, dtype=bool)  # the word goes on from the one before
        if n > 1:
            stop = _STOP[words.bytes[words.end - 1]]
            joined[1:-1] = self.marked[1:] & self.marked[:-1] & (words.text[1:] == words.text[:-1]) & ~stop[:-1]
        self.run_first = np.maximum.accumulate(np.where(joined[:-1], 0, at)) if n else at
        self.run_last = np.minimum.accumulate(np.where(joined[1:], n, at)[::-1])[::-1] if n else at

    def word_at(self, row: int, text: str, place: int) -> int:
        byte = int(self.words.offsets[row]) + len(text[:place].encode())
        return int(np.searchsorted(self.words.start, byte, side="right")) - 1

    def around(self, first: int, last: int) -> list[int]:
        """The patterns beside the words from first to last."""
        return [int(hashes[w]) for (hashes, have), w in zip(self.beside, (first, first, last, last), strict=True) if have[w]]

    def instance(self, side: int, word: int) -> tuple[int, str]:
        """(first byte in the chunk, lower-cased text) of the identifier that begins (left patterns) or ends with the word; empty if it is none."""
        first, last = (word, int(self.run_last[word])) if side < 2 else (int(self.run_first[word]), word)
        begin = int(self.words.start[first])
        piece = self.words.bytes[begin : self.words.end[last]].tobytes().decode()
        text = piece.strip(_EDGE)
        lead = piece[: len(piece) - len(piece.lstrip(_EDGE))]
        if lead.endswith("(") and ")" in text and "(" not in text:
            lead, text = lead[:-1], "(" + text
        return begin + len(lead), text if _LIKE.match(text) else ""


def _contexts(texts: list, words) -> tuple[list[list[tuple[str, int, int]]], _Contexts]:
    own = [entities(t) if t else [] for t in texts]
    return own, _Contexts(words, {r: found for r, found in enumerate(own) if found}, texts)


def _value_hash(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "big", signed=True)


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _seed_scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pattern, kind, value) of every seed."""
    for batch in batches:
        texts = batch.column(0)
        for a, b, words in text_chunks(texts, NOT_SPACE):
            chunk = texts.slice(a, b - a).to_pylist()
            own = {r: found for r, t in enumerate(chunk) if t and (found := entities(t))}
            out = set()
            if own:
                seen = _Contexts(words, own, chunk)
                for kind, value, first, last in (e for found in seen.own.values() for e in found):
                    out.update((p, KINDS.index(kind), _value_hash(value)) for p in seen.around(first, last))
            yield _batch(list(out), ["pattern", "kind", "value"], [pa.int64(), pa.int32(), pa.int64()])


def _found(patterns: np.ndarray, hashes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, numbers of their patterns) of those words `of` that stand beside a pattern."""
    if not len(patterns) or not len(of):
        return of[:0], of[:0]
    at = np.minimum(np.searchsorted(patterns, hashes[of]), len(patterns) - 1)
    hit = patterns[at] == hashes[of]
    return of[hit], at[hit]


def _edge_scan(sent):
    """(pattern, kind or null, value, n) of what stands beside the patterns; all plain words beside a pattern are one value, 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = sent.value
        plain = np.zeros(len(patterns), dtype=np.int64)
        names, kinds = ["pattern", "kind", "value", "n"], [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        for batch in batches:
            texts = batch.column(0)
            for a, b, words in text_chunks(texts, NOT_SPACE):
                _, seen = _contexts(texts.slice(a, b - a).to_pylist(), words)
                begins, ends = {}, {}
                for kind, value, first, last in (e for found in seen.own.values() for e in found):
                    edge = KINDS.index(kind), _value_hash(value)
                    begins.setdefault(first, edge)
                    ends.setdefault(last, edge)
                count: dict[tuple, int] = {}
                for side, (hashes, have) in enumerate(seen.beside):
                    own = begins if side < 2 else ends
                    for word, at in zip(*(x.tolist() for x in _found(patterns, hashes, np.flatnonzero(have & (seen.marked | seen.covered)))), strict=True):
                        if word in own:
                            kind, value = own[word]
                        elif seen.marked[word] and (piece := seen.instance(side, word)[1]):
                            kind, value = -1, _value_hash(piece)
                        else:
                            plain[at] += 1
                            continue
                        key = int(patterns[at]), kind, value
                        count[key] = count.get(key, 0) + 1
                    at = _found(patterns, hashes, np.flatnonzero(have & ~seen.marked & ~seen.covered))[1]
                    plain += np.bincount(at, minlength=len(patterns))
                yield _batch([(*k, n) for k, n in count.items()], names, kinds)
        some = np.flatnonzero(plain)
        nothing = np.zeros(len(some), dtype=np.int64)
        columns = (patterns[some], nothing - 1, nothing, plain[some])
        yield pa.RecordBatch.from_arrays([pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def seed_patterns(docs: DataFrame, least: int = SEEDS) -> DataFrame:
    """Patterns with at least `least` different seeds."""
    seeds = docs.select("text").mapInArrow(_seed_scan, "pattern bigint, kind int, value bigint").distinct()
    return seeds.groupBy("pattern").agg(F.count_distinct("value").alias("seeds")).where(F.col("seeds") >= least)


def scored_patterns(edges: DataFrame, rounds: int = ROUNDS, doubt: float = DOUBT) -> DataFrame:
    """(pattern, kind, score) from edges (pattern, kind or -1, value, n).

    Different seeds of the kind count one each, other instances by their
    confidence, other kinds and plain words nothing; plain words weigh by their
    number.
    """
    kinds = edges.where("kind >= 0").select("pattern", F.col("kind").alias("as")).distinct()
    base = stored(edges.join(kinds, "pattern").select("pattern", "as", "value", "kind", F.when(F.col("value") == 0, F.col("n")).otherwise(1).alias("weight")), "edges")
    confidence = F.when(F.col("kind") == F.col("as"), 1.0).otherwise(0.0)
    scores = None
    for _ in range(rounds):
        now = base
        if scores is not None:
            unknown = base.where("kind = -1 and value != 0").join(scores, ["pattern", "as"])
            best = unknown.groupBy("as", "value").agg(F.max("score").alias("known"))
            now = base.join(best, ["as", "value"], "left")
            confidence = F.when(F.col("kind") == F.col("as"), 1.0).when(F.col("kind") == -1, F.coalesce("known", F.lit(0.0))).otherwise(0.0)
        scores = stored(
            now.groupBy("pattern", "as").agg((F.sum(confidence) / (F.sum("weight") + F.lit(doubt))).alias("score")), "scores"
        )
    return scores.select("pattern", F.col("as").alias("kind"), "score")


def _final_scan(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns, kinds = sent.value
        for batch in batches:
            texts = batch.column("text")
            for a, b, words in text_chunks(texts, NOT_SPACE):
                chunk = texts.slice(a, b - a).to_pylist()
                own, seen = _contexts(chunk, words)
                spans: dict[int, set] = {}
                for side, (hashes, have) in enumerate(seen.beside):
                    for word, at in zip(*(x.tolist() for x in _found(patterns, hashes, np.flatnonzero(have & seen.marked))), strict=True):
                        begin, piece = seen.instance(side, word)
                        if piece:
                            spans.setdefault(int(words.text[word]), set()).add((begin, -len(piece.encode()), int(kinds[at])))
                added: dict[int, list] = {}
                for r, found in spans.items():
                    data, free = chunk[r].encode(), 0
                    for begin, size, kind in sorted(found):
                        begin -= int(words.offsets[r])
                        start = len(data[:begin].decode())
                        end = start + len(data[begin : begin - size].decode())
                        if start >= free and all(end <= s or start >= e for _, s, e in own[r]):
                            added.setdefault(r, []).append((KINDS[kind], start, end))
                            free = end
                base = [[{"kind": k, "start": s, "end": e} for k, s, e in spans] for spans in own]
                more = [[{"kind": k, "start": s, "end": e} for k, s, e in added.get(r, [])] for r in range(b - a)]
                kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
                rest = [(n, batch.column(n).slice(a, b - a)) for n in batch.schema.names if n != "text"]
                yield pa.RecordBatch.from_arrays(
                    [*(c for _, c in rest), pa.array(base, kind), pa.array(more, kind)], names=[*(n for n, _ in rest), "base", "added"]
                )

    return run


def find_personal_data(docs: DataFrame, keep: list[str], sure: float = SURE) -> DataFrame:
    """`row` (the columns `keep`), `base` and `added` spans (kind, start, end) of every document."""
    spark = docs.sparkSession
    bounded_batches(spark)
    patterns = np.sort(seed_patterns(docs).select("pattern").toArrow()["pattern"].to_numpy())
    edges = None
    for at in range(0, max(1, len(patterns)), PATTERNS):
        sent = spark.sparkContext.broadcast(patterns[at : at + PATTERNS])
        part = docs.select("text").mapInArrow(_edge_scan(sent), "pattern bigint, kind int, value bigint, n bigint")
        edges = part if edges is None else edges.unionByName(part)
    scores = scored_patterns(edges.groupBy("pattern", "kind", "value").agg(F.sum("n").alias("n")))
    taken = scores.where(F.col("score") >= sure).groupBy("pattern").agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")).orderBy("pattern").toArrow()
    final = spark.sparkContext.broadcast((taken["pattern"].to_numpy(), taken["kind"].to_numpy().astype(np.int8)))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(_final_scan(final), f"row {rows.schema['row'].dataType.simpleString()}, base {span}, added {span}")
