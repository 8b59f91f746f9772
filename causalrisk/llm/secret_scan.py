"""Secrets: fixed patterns, and values in a credential context judged by what they would cost to guess.

The cost of a value is that of its cheapest cut into words of a list, dates,
repeats, keyboard walks, runs of the alphabet, and single characters tried by
brute force (log10 of the guesses, added up). Values that only follow a rule
are cheap however long they are, random ones are not.

Each text is judged on its own row, so nothing is shuffled.

Defined results: a null or empty text has no secrets. Repeated rows are returned
one by one. Places are code points, ends are exclusive. A text or value of any
length is judged whole. Cuts of equal cost have the same verdict. An empty table
gives no rows. Kept columns lie inside `row` and may have any name.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from causalrisk.llm.common import bounded_batches

KINDS = ("assign", "access", "hex", "context")
#: log10 of the guesses from which a value in context is a secret; longest listed word; starts tried in a run.
COSTLY, LONGEST_WORD, RUN_STARTS = 9.0, 16, 16

# The three patterns. The look-behind keeps the search linear.
_ASSIGN = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?([A-Za-z0-9+/_.=-]++)", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]++")
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
#: Words that announce a value, what may stand between, and the value.
_CONTEXT = re.compile(
    r"(?:pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?|(?:api|access|private|secret|auth)[ _-]?key)"
    r"[\"']?(?:\x20{0,3}(?::=|=>|->|[:=])\x20{0,3}|\x20(?:is|was)\x20)[\"'`<(]?([^\s\"'`<>(),;]{6,}+)", re.I | re.A,
)
#: Words that passwords are made of, most usual first.
WORDS = (
    "password qwerty dragon monkey letmein football baseball welcome master shadow superman michael jennifer jordan hunter ranger soccer hockey "
    "killer george charlie andrew michelle love sunshine jessica pepper daniel access joshua maggie starwars silver william dallas yankees "
    "ashley robert thomas summer winter spring autumn freedom whatever ginger secret cookie computer internet princess nicole thunder cheese "
    "matrix diamond orange banana purple yellow flower monster tigger batman trustno login admin root user guest test demo default changeme "
    "public private server database oracle mysql google windows apple linux system manager service account temp temporary example sample "
    "token pass key api secure security correct horse battery staple money happy lucky angel heaven forever family friend mother father "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday saturday "
    "sunday the and for you with from this that your none null true false string value here placeholder required optional enter changes"
).split()
_RANK = {w: i + 1 for i, w in reversed(list(enumerate(WORDS)))}
_KEYS = ("`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./")
_PLACE = {c: (r, i + (0, 0.5, 0.75, 1.25)[r]) for r, row in enumerate(_KEYS) for i, c in enumerate(row)}
_DATE = re.compile(r"(?:19|20)[0-9]{2}(?:[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:0[1-9]|[12][0-9]|3[01]))?|(?:0[1-9]|[12][0-9]|3[01])[-/._]?(?:0[1-9]|1[0-2])[-/._]?(?:19|20)?[0-9]{2}")
_LEET = str.maketrans("0134578@$!", "oleastbasi")


def _near(a: str, b: str) -> bool:
    p, q = _PLACE.get(a), _PLACE.get(b)
    return p is not None and q is not None and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1.0


def _letters(c: str) -> float:
    return 10.0 if c.isdigit() else 26.0 if c.isalpha() else 33.0


def guess_cost(value: str) -> float:
    """log10 of the guesses of the cheapest cut of the value."""
    low, n = value.lower(), len(value)
    if len(low) != n:
        low = value
    plain = low.translate(_LEET)
    cost = [0.0] + [math.inf] * n
    runs: dict[str, list[int]] = {"repeat": [0] * n, "order": [0] * n, "keys": [0] * n}
    for i in range(1, n):
        step = ord(low[i]) - ord(low[i - 1])
        runs["repeat"][i] = runs["repeat"][i - 1] if step == 0 else i
        steady = abs(step) == 1 and (i < 2 or runs["order"][i - 1] == i - 1 or ord(low[i - 1]) - ord(low[i - 2]) == step)
        runs["order"][i] = (i - 1 if runs["order"][i - 1] == i - 1 else runs["order"][i - 1]) if steady else i - 1 if abs(step) == 1 else i
        runs["keys"][i] = runs["keys"][i - 1] if _near(low[i - 1], low[i]) else i
    dates: dict[int, list[int]] = {}
    for i in range(n):
        m = _DATE.match(low, i)
        if m and m.end() - i >= 4:
            dates.setdefault(m.end(), []).append(i)
    for end in range(1, n + 1):
        c = value[end - 1]
        best = cost[end - 1] + math.log10(_letters(c) * (2.0 if c.isupper() else 1.0))
        for start in range(max(0, end - LONGEST_WORD), end - 2):
            rank, swapped = _RANK.get(low[start:end]), 1.0
            if rank is None:
                rank, swapped = _RANK.get(plain[start:end]), 8.0
            if rank:
                upper = sum(x.isupper() for x in value[start:end])
                best = min(best, cost[start] + math.log10((rank + 1) * swapped * (1.0 if not upper else 2.0 if upper in (1, end - start) else 2.0**upper)))
        for start in dates.get(end, ()):
            best = min(best, cost[start] + math.log10(365.0 * 120))
        for kind, least, weight in (("repeat", 3, 1.0), ("order", 3, 2.0), ("keys", 4, 8.0)):
            first = runs[kind][end - 1]
            for start in range(first, min(first + RUN_STARTS, end - least + 1)):
                best = min(best, cost[start] + math.log10(_letters(low[start]) * weight * (end - start)))
        cost[end] = best
    return cost[n]


def _kinds_of_letters(value: str) -> int:
    return sum(any(f(c) for c in value) for f in (str.islower, str.isupper, str.isdigit, lambda c: not c.isalnum()))


def base_secrets(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns by start, then kind."""
    found = []
    if ":" in text or "=" in text:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def context_secrets(text: str, base: list[tuple[str, int, int]], costly: float = COSTLY) -> list[tuple[str, int, int]]:
    """Values in a credential context that no base span touches, mix at least two kinds of letters, and are costly to guess."""
    found = []
    for m in _CONTEXT.finditer(text):
        value = m.group(1).rstrip(".:!?")
        start, end = m.start(1), m.start(1) + len(value)
        if len(value) >= 6 and _kinds_of_letters(value) >= 2 and all(end <= s or start >= e for _, s, e in base) and guess_cost(value) >= costly:
            found.append(("context", start, end))
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        base, added = [], []
        for cell in batch.column("text"):
            text = cell.as_py() or ""
            own = base_secrets(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in own])
            added.append([{"kind": k, "start": s, "end": e} for k, s, e in context_secrets(text, own)])
        rest = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "text"]
        yield pa.RecordBatch.from_arrays([*(c for _, c in rest), pa.array(base, kind), pa.array(added, kind)], names=[*(n for n, _ in rest), "base", "added"])


def find_secrets(docs: DataFrame, keep: list[str]) -> DataFrame:
    """`row` (the columns `keep`), `base` and `added` spans (kind, start, end) of every document."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), "text")
    span = "array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(_scan, f"row {rows.schema['row'].dataType.simpleString()}, base {span}, added {span}")
