"""Burst tries, difference-cover repeats and residue hard negatives against plain counterparts, awkward tables included."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from causalrisk.llm.hard_negatives import LONGEST, exact_scores, mine_negatives
from causalrisk.llm.repeats import COVER, PERIOD, _without, remove_repeats
from causalrisk.llm.turn_trie import conversation_trie, trie_nodes, turn_steps, with_shared_starts
from tests.llm.cases import NOT_SPACE, ROWS_AWKWARD as ROWS, SCHEMA, prose

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
TURN = "conv_id long, turn long, role string, text string, depth string, head int, `_segment` long, ends double"


def plain_trie(rows, rebuilt):
    own = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own[c].append((t is not None, t or 0, hashlib.md5(f"{len(r)}:{r}{x}".encode()).digest(), (r, x)))
    own = {c: [x[3] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9 if rebuilt else 0
        seqs[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:])
    members, kids = defaultdict(list), defaultdict(set)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                kids[s[: d - 1]].add(s[:d])
    leaves, saved, out = {}, {}, Counter()
    for n in sorted(members, key=len, reverse=True):
        leaves[n] = sum(leaves[k] for k in kids[n]) or 1
        saved[n] = sum(saved[k] for k in kids[n]) + ((len(members[n]) - 1) * len(n[-1][1].encode()) if n else 0)
    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if seqs[c] == n)))
        parent = min(members[n[:-1]]) if n else None
        out[(min(m), len(n), parent, len(m), len(kids[n]), leaves[n], saved[n], hashlib.sha256(ends.encode()).hexdigest())] += 1
    return out


def conversations(seed):
    draw = random.Random(seed)
    rows = []
    for c in [*range(-7, 60), 10**12]:
        shared = draw.choice([0, 1, 1, 1, 4, 9])
        turns = [("system" if i == 0 else "user", f"turn {i} é {'x' * (i % 4)}") for i in range(shared)]
        turns += [(draw.choice(["user", "assistant", None]), draw.choice(["a", "b", "", None])) for _ in range(draw.choice([0, 1, 3, 6]))]
        rows += [(c, i if draw.random() < 0.95 else None, r, t) for i, (r, t) in enumerate(turns)]
    rows += [(3, 2, "user", "tie"), (3, 2, "assistant", "tie"), (4, 1, "user", "again"), (4, 1, "user", "again"), (None, 0, "user", "nobody"), (100, None, None, None)]
    rows += [(200 + k, i, "user", "same") for k in range(30) for i in range(12)]
    return rows


@pytest.mark.parametrize("burst", [1, 4, 40, 10_000])
def test_trie_nodes_equal_a_plain_trie(spark, burst):
    rows = conversations(burst)
    df = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], TURN).repartition(5)
    steps, convs = with_shared_starts(turn_steps(df))
    got = Counter(tuple(r) for r in trie_nodes(steps, convs, burst).select(*NODE).collect())
    assert got == plain_trie(rows, rebuilt=True)
    if burst != 1:
        assert Counter(tuple(r) for r in conversation_trie(df, burst).select(*NODE).collect()) == plain_trie(rows, rebuilt=False)


def test_long_chains_and_empty_tables(spark):
    rows = [(1, i, "user", f"t{i % 7} {i}") for i in range(700)] + [(2, i, "user", f"t{i % 7} {i}") for i in range(700)]
    rows += [(3, i, "user", f"t{i % 7} {i}" if i < 2 else f"other {i}" + "y" * 9) for i in range(300)] + [(4, 0, "user", "z" * 300_000)]
    df = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], TURN).repartition(4)
    assert Counter(tuple(r) for r in conversation_trie(df, 50).select(*NODE).collect()) == plain_trie(rows, rebuilt=False)
    none = spark.createDataFrame([], TURN)
    assert conversation_trie(none).collect() == []
    steps, convs = with_shared_starts(turn_steps(none))
    assert trie_nodes(steps, convs).collect() == []


def plain_repeats(texts, n=35):
    own = [NOT_SPACE.findall(t or "") for t in texts]
    count = Counter(tuple(w[i : i + n]) for w in own for i in range(len(w) - n + 1))
    out = []
    for w in own:
        hit = {i + k for i in range(len(w) - n + 1) if count[tuple(w[i : i + n])] > 1 for k in range(n)}
        out.append((len(w), len(hit), " ".join(x for i, x in enumerate(w) if i not in hit)))
    return out


def test_the_cover_brings_any_two_places_to_an_anchor():
    assert all(any((i + k) % PERIOD in COVER and (j + k) % PERIOD in COVER for k in range(PERIOD)) for i in range(PERIOD) for j in range(PERIOD))


def test_repeats_equal_a_plain_search(spark):
    texts = [r[1] for r in ROWS]
    draw = random.Random(4)
    passage = prose(77, 60).split()
    for k in range(60):
        own = prose(1000 + k, draw.randint(0, 90)).split()
        at = draw.randint(0, len(own))
        length = draw.choice([0, 20, 34, 35, 36, 50, 60])
        begin = draw.randint(0, 60 - length)
        texts.append(" ".join([*own[:at], *passage[begin : begin + length], *own[at:]]))
    texts += [prose(5, 40).upper(), prose(5, 40), "  ".join(prose(6, 50).split()), " ".join([*prose(8, 35).split(), *prose(8, 35).split()])]
    texts += [" ".join(f"w{i}" for i in range(35)) + " tail", "head " + " ".join(f"w{i}" for i in range(35)), "a " * 36, "ab\r\nc\vd\fe\tg\x1fh"]
    rows = [(i, t, "x", 3) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `row` string, key int").repartition(7)
    got = Counter((r.row.doc_id, r.kept.n_words, r.kept.n_removed, r.kept.text) for r in remove_repeats(df, ["doc_id"]).collect())
    assert got == Counter((i, *w) for i, w in enumerate(plain_repeats(texts)))
    for r in remove_repeats(df, window=40).collect():
        assert sum(s.last - s.first + 1 for s in r.kept.spans) == r.kept.n_removed and tuple(r.row) == rows[r.row.doc_id]
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert Counter(tuple(r.row) for r in remove_repeats(docs).collect()) == Counter(ROWS)
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []
    with pytest.raises(ValueError):
        remove_repeats(docs, window=21)


def test_cutting_by_pieces(monkeypatch):
    monkeypatch.setattr("causalrisk.llm.repeats.PIECE", 20)
    words = [f"w{i}" for i in range(200)]
    for spans in ([], [(0, 199)], [(3, 40), (60, 60), (150, 199)], [(10, 12)]):
        gone = {i for f, t in spans for i in range(f, t + 1)}
        want = (200, len(gone), " ".join(w for i, w in enumerate(words) if i not in gone).encode())
        assert _without(("  " + " \n ".join(words) + " ").encode(), spans) == want


def test_residue_scores_are_exact():
    draw = np.random.default_rng(2)
    for size in (1, 100, 40_000, 2**24, 2**28):
        for width in (1, 64, 270, 600):
            a, b = (draw.integers(-size, size + 1, (n, width)) for n in (7, 9))
            bound = math.sqrt((a.astype(float) ** 2).sum(1).max() * (b.astype(float) ** 2).sum(1).max())
            if bound < LONGEST:
                assert (exact_scores(a.astype(np.int32), b.astype(np.int32), bound) == a.astype(object) @ b.astype(object).T).all()


def plain_negatives(rows, anchors):
    part = []
    for i, lab, v in rows:
        if lab is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole = [math.floor(256 * x) for x in v]
            if sum(x * x for x in whole) < LONGEST * 0.999:
                part.append((i, lab, whole))

    def first(found, k):
        return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1] or 0))[:k]

    out = Counter()
    for i, lab, v in part:
        if i is None or not anchors(i):
            continue
        scored = [(sum(x * y for x, y in zip(v, w, strict=False)), j, m) for j, m, w in part]
        for p, j, _ in first([s for s in scored if s[2] == lab and s[1] != i], 5):
            for rank, (s, k, _) in enumerate(first([s for s in scored if s[2] != lab and 30 * p <= 100 * s[0] <= 90 * p], 10), 1):
                out[(i, j, rank, k, p, s)] += 1
    return out


def test_hard_negatives_equal_all_scores(spark, monkeypatch):
    draw = random.Random(9)
    rows = [(i, i % 3, [draw.uniform(-0.2, 1) for _ in range(6)]) for i in range(160)]
    rows += [(i, i % 2, [0.5, 0.25, 0.125, 0.0, 0.0, 0.0]) for i in range(160, 200)]
    rows += [(300, 1, [float("nan")] * 6), (301, None, [1.0] * 6), (302, 1, None), (303, 2, [1.0, None, 1.0]), (304, 0, [float("inf")] * 6), (305, 1, [])]
    rows += [(306, 2, [0.9, 0.9]), (307, 2, [0.3] * 9), (None, 1, [0.7] * 6), (None, 2, [0.7] * 6), (308, 1, [1e300, 0.0]), rows[10], rows[10], (310, 0, [3e5] * 6), (320, 1, [-3e5] * 6)]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, label int, embedding array<double>, block string, place int").repartition(6)
    want = plain_negatives(rows, lambda i: i % 10 == 0)
    for size in (2_000_000, 400):
        monkeypatch.setattr("causalrisk.llm.hard_negatives.BLOCK_BYTES", size)
        monkeypatch.setattr("causalrisk.llm.hard_negatives.SCORES", size)
        out = mine_negatives(df, F.col("vec_id") % 10 == 0).collect()
        assert Counter((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in out) == want
    assert mine_negatives(df, F.col("vec_id") < 0).collect() == []
    assert mine_negatives(df.limit(0), F.col("vec_id") % 10 == 0).collect() == []
