"""Cases of the second review."""

from __future__ import annotations

import random

import pytest

from causalrisk.llm.decontaminate import decontaminate, find_leaks
from causalrisk.llm.extract import page_text
from causalrisk.llm import personal_data
from causalrisk.llm.licenses import find_licenses
from causalrisk.llm.mixing import mix_documents
from tests.llm.cases import prose


def test_a_cell_of_few_documents_does_not_scale_down_the_others(spark):
    draw = random.Random(8)
    rows = [(i, prose(i, draw.randint(20, 200)), draw.choice(["en", "en", "de"]), f"src{i % 3}") for i in range(2000)]
    rows += [(5000 + i, prose(i, 40), None, "src1") for i in range(3)]
    targets = {"source": {"src0": 0.25}, "lang": {"en": 0.6, "de": 0.35}, "topic": {"prose": 0.8, "short": 0.2}}
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = mix_documents(df, targets, rare=0.02).collect()
    total = sum(r.tokens * r.probability for r in out)
    assert total > 0.5 * sum(r.tokens for r in out) and all(r.probability == 1 and r.sampled for r in out if r.lang == "(other)")
    assert max(r.probability for r in out) <= 1 and max(r.probability for r in out if r.lang != "(other)") == pytest.approx(1.0, abs=1e-6)
    for d, c, share in (("source", "src0", 0.25), ("topic", "short", 0.2), ("lang", "en", 0.6 / 0.95), ("lang", "de", 0.35 / 0.95)):
        assert sum(r.tokens * r.probability for r in out if r[d] == c) / total == pytest.approx(share, abs=0.002)
    plain = mix_documents(df, targets).collect()
    assert sum(r.tokens * r.probability for r in plain) < 0.1 * sum(r.tokens for r in plain)


LONG = prose(1, 200)


@pytest.mark.parametrize("source, path, text", [
    (f"<body><article><h1>Title</h1><p>lead</p><div class=content><p>{LONG}</div></article>", None, f"Title\nlead\n{LONG}"),
    (f"<body><article><h1>Title</h1><div class=content><p>{LONG}</div></article>", ">body>article>div.content", f"Title\n{LONG}"),
    (f"<body><div><div><p>{LONG}</div><div><p>second part</div></div>", None, f"{LONG}\nsecond part"),
    (f"<body><div><h1>T</h1><div class=content><p>{LONG}</div><div><a href=x>a list</a> <a href=y>of links</a></div></div>", None, f"T\n{LONG}"),
    (f"<body><h1>T</h1><div class=content><p>{LONG}</div>", None, f"T\n{LONG}"),
    (f"<body><div class=x><p>{LONG}</div><div class=y><p>short</div>", ">body>div.y", f"{LONG}\nshort"),
])
def test_text_beside_the_chosen_container_stays(source, path, text):
    assert page_text(source, path) == text


def test_more_items_than_one_automaton_holds_are_scanned_in_parts(spark):
    draw = random.Random(5)
    letters = ["a", "b", "c", "d", "é"]
    items = [(i, " ".join(draw.choice(letters) for _ in range(draw.choice([2, 6, 10, 14, 30, 90])))) for i in range(9)]
    texts = [" ".join(draw.choice([*letters, "zz"]) for _ in range(draw.randint(0, 40))) for _ in range(12)]
    for _, t in items:
        w = t.split()
        texts += [f"{prose(len(texts), 40)} {' '.join([*w[:7], *w, *w[7:]])} {prose(len(texts) + 90, 40)}"] * 2
    texts += [items[0][1], "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    table = spark.createDataFrame(items, "item_id long, text string")

    def leaks(found):
        return {r.row.doc_id: (r.leak.n_words, r.leak.n_hit, list(r.leak["items"]), [(s.first, s.last) for s in r.leak.spans]) for r in found.collect()}

    assert leaks(find_leaks(docs, table, item_words=60)) == leaks(find_leaks(docs, table))
    got = {r.doc_id: r.text for r in decontaminate(docs, table, item_words=60).collect()}
    assert got == {r.doc_id: r.text for r in decontaminate(docs, table).collect()} and sum(got[i] != texts[i] for i in got) > 5


def test_bootstrap_takes_all_patterns_short_and_right_hand_ones_and_long_instances(spark, monkeypatch):
    monkeypatch.setattr(personal_data, "PATTERNS", 1)
    rows = [(i, f"{prose(i, 20)} odd{prose(i, 2)[:1]}{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10]} tel: +44 20 7946 {1000 + i} {prose(i + 99, 20)}") for i in range(60)]
    rows += [(100 + i, f"{prose(i + 300, 20)} user{i}@mail.example.org replies promptly {prose(i + 400, 20)}") for i in range(60)]
    long = "id" + "0123456789" * 7
    planted = {
        200: ("tel: {} then", "020 7946 0958"), 201: ("words before tel: {} then", "(555) 123-4567"), 202: ("tel: {}, then", "AB-1234"),
        203: ("some tel: {} then", long), 204: ("from {} replies promptly", "4471-99-10332x"), 205: ("the number {} alone", ""),
    }
    rows += [(i, t.format(v or "4471-99-10333x")) for i, (t, v) in planted.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.row.doc_id: r for r in personal_data.find_personal_data(df, ["doc_id"]).collect()}
    texts = dict(rows)
    got = {i: "".join(texts[i][s.start : s.end] for s in out[i].added) for i in planted}
    assert got == {i: v for i, (_, v) in planted.items()} and not any(out[i].added for i in range(160) if i in out)


@pytest.mark.parametrize("text, labels", [
    ("This work is licensed under the GNU General Public License version 3.", "gpl"),
    ("licensed under the GNU Lesser General Public License", "gpl,lgpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"), ("licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), ("licensed under CC BY 4.0", "cc-by"),
    ("licensed under the MIT license", "mit"), ("Mozilla Public License 2.0", "mpl"), ("SPDX-License-Identifier: MIT", "mit"),
    ("SPDX-License-Identifier: Apache-2.0", "apache"), ("SPDX-License-Identifier: GPL-3.0-only", "gpl"), ("a general public notice on licenses", ""),
])
def test_labels_are_those_that_the_text_carries(spark, text, labels):
    df = spark.createDataFrame([(1, f"{prose(3, 30)} {text} {prose(4, 30)}")], "doc_id long, text string")
    assert find_licenses(df).first().labels == labels
