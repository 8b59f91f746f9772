"""Awkward documents and plain counterparts of the corpus operators."""

from __future__ import annotations

import random
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NOT_SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: Columns with names that the operators use inside, besides those of `documents`.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `row` string, n_words long, kept string, tokens int, `_c` string, shard int"


def words(text: str | None, pattern=ALNUM) -> list[str]:
    return pattern.findall((text or "").translate(LOWER))


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    syllables = "the an er on re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve".split()
    return " ".join("".join(draw.choice(syllables) for _ in range(draw.randint(1, 4))) for _ in range(n))


def documents() -> list[tuple]:
    """Null and empty columns, blanks, very long texts, exact and near copies, repeated rows and repeated ids."""
    base = prose(1, 60)
    near = base.split()
    near[30] = "changed"
    texts = [
        None, "", " \t\n ", "one", "one two three", "One TWO three", base, base, " ".join(near), base.upper(), prose(2, 30000),
        "a b c d e f g h " * 40, "ÀÉ ñ 中文字 \U0001f600 x", "line one\nline one\nline two\n\nline one", "#*$ | " * 50, prose(3, 8), prose(4, 9), prose(5, 400),
    ]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[6], rows[6], (None, base, None, None, None), (None, None, None, None, None), (17, "other text with the same id", "fr", "src0", 5)]
    return [(*r, "x", 7, "no", 1, "c", 3) for r in rows]


ROWS_AWKWARD = documents()
