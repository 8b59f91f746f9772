"""Nulls, empty and long texts, repeats, empty tables and clashing names, for every operator, against plain counterparts."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from causalrisk.llm.decontaminate import decontaminate, find_leaks
from causalrisk.llm.extract import extract_pages
from causalrisk.llm.jaccard import jaccard_components
from causalrisk.llm.licenses import find_licenses
from causalrisk.llm.mixing import mix_documents
from causalrisk.llm.personal_data import find_personal_data
from causalrisk.llm.quality import judge_documents
from causalrisk.llm.secret_scan import find_secrets
from causalrisk.llm.shards import kd_shards, shard_documents
from causalrisk.llm.url_reputation import judge_urls
from tests.llm.cases import NOT_SPACE, SCHEMA, documents, prose, words

ROWS = documents()
TARGETS = {"source": {"src0": 0.5}, "lang": {"en": 0.5}, "topic": {"prose": 0.9}}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_row(rows, *columns):
    return Counter(tuple(getattr(r, c) for c in columns) for r in rows)


def windows(item: list[str], n: int = 10) -> set[tuple]:
    return {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if len(item) >= n else {tuple(item)} if item else set()


def leaks(text, items: dict[int, str]):
    own, hit, found = words(text), set(), set()
    for item, wording in items.items():
        for w in windows(words(wording)):
            for i in range(len(own) - len(w) + 1):
                if tuple(own[i : i + len(w)]) == w:
                    hit |= set(range(i, i + len(w)))
                    if item is not None:
                        found.add(item)
    return len(own), len(hit), sorted(map(str, found))


def test_leaks_equal_a_plain_search(spark):
    draw = random.Random(5)
    vocabulary = ["a", "b", "c", "é"]
    items = {i: " ".join(draw.choice(vocabulary) for _ in range(draw.choice([1, 3, 6, 10, 12, 30]))) for i in range(2, 9)}
    texts = [" ".join(draw.choice([*vocabulary, "zz"]) for _ in range(draw.randint(0, 200))) for _ in range(40)]
    texts += [f"start {items[3].upper()}, {items[4]} end", "", None]
    items |= {None: "a zz b", 90: None, 91: ""}
    table = spark.createDataFrame([*items.items(), (2, items[2])], "item_id long, text string")
    got = find_leaks(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), table).collect()
    assert {r.row.doc_id: (r.leak.n_words, r.leak.n_hit, list(r.leak["items"])) for r in got} == {i: leaks(t, items) for i, t in enumerate(texts)}
    for r in got:
        assert sum(s.last - s.first + 1 for s in r.leak.spans) == r.leak.n_hit


def test_decontaminate_cuts_until_nothing_is_left(spark, docs):
    passage = prose(9, 14)
    half = passage.split()
    inner = " ".join([*half[:7], *half, *half[7:]])
    rows = [(1, f"Before it. {passage.upper()}! After it {prose(10, 20)}"), (2, f"{prose(11, 60)} {inner} {prose(12, 30)}"), (3, passage), (4, prose(13, 40))]
    df = spark.createDataFrame([(i, t, len(t), "k") for i, t in rows], "doc_id long, text string, n_chars long, leak string")
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate(df, items).collect()}
    assert set(out) == {1, 2, 4} and out[4].text == rows[3][1] and out[1].text.startswith("Before it. ! After it") and out[1].leak == "k"
    assert all(leaks(r.text, {1: passage})[1] == 0 and r.n_chars == len(r.text) for r in out.values())
    assert by_row(decontaminate(docs, items).collect(), *docs.columns) == Counter(ROWS)
    names = spark.createDataFrame([("a-1", passage), ("1.7", passage + " more"), (None, prose(13, 12))], "item_id string, text string")
    got = {r.row.doc_id: list(r.leak["items"]) for r in find_leaks(df, names).collect()}
    assert got[3] == ["1.7", "a-1"] and got[4] == [] and {r.row.doc_id: r.leak.n_hit for r in find_leaks(df, names).collect()}[4] == 12
    with pytest.raises(ValueError, match="in parts"):
        find_leaks(df, items, item_words=5)


def shingles(text):
    own = words(text, NOT_SPACE)
    return {tuple(own[i : i + 5]) for i in range(len(own) - 4)} if len(own) >= 5 else {tuple(own)} if own else set()


def plain_components(rows):
    """Rows with equal texts or linked sets share a component, named by its least id."""
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                name[root(i)] = root(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[root(i)].append(doc)
    return Counter(
        (doc, len(s), min((d for d in least[root(i)] if d is not None), default=None) if s else doc) for i, ((doc, _), s) in enumerate(zip(rows, sets, strict=True))
    )


def test_components_equal_all_pairs(spark, docs):
    rows = [r[:2] for r in ROWS]
    assert by_row(jaccard_components(docs).collect(), "doc_id", "n_shingles", "component_id") == plain_components(rows)
    draw = random.Random(3)
    rows = []
    for group in range(12):
        text = prose(100 + group, draw.choice([6, 20, 45, 90])).split()
        for _ in range(draw.randint(1, 9)):
            if draw.random() < 0.7:
                text = list(text)
                text[draw.randrange(len(text))] = prose(draw.randint(0, 10**6), 1)
            rows.append((len(rows), " ".join(text) + (" " + prose(7, 30) if draw.random() < 0.3 else "")))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert by_row(jaccard_components(df).collect(), "doc_id", "n_shingles", "component_id") == plain_components(rows)


def test_shards_are_even_and_gapless(spark, docs, none):
    rows = [(i, prose(i, 20 + i % 60) if i % 3 else "hot text " * 10, ["en", "de", None][i % 3], f"src{i % 7 * (i % 2)}") for i in range(3000)]
    out = kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), 24).collect()
    assert sorted(r.doc_id for r in out) == list(range(3000))
    size, slots = Counter(), defaultdict(list)
    for r in out:
        text = rows[r.doc_id][1].encode()
        assert (r.size, r.text_crc32) == (len(text) + 8, zlib.crc32(text))
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
    mean = sum(size.values()) / 24
    assert set(size) == set(range(24)) and all(abs(v - mean) < 0.05 * mean for v in size.values())
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    got = kd_shards(docs, 3).collect()
    assert by_row(got, "doc_id", "size") == Counter((r[0], len((r[1] or "").encode()) + 8) for r in ROWS)
    assert by_row(shard_documents(docs, 3, label="of").collect(), *docs.columns) == Counter(ROWS)
    by_id = {(r.doc_id, r.text_crc32): r.shard for r in got}
    assert all(by_id[r.doc_id, zlib.crc32((r.text or "").encode())] == r.of for r in shard_documents(docs, 3, label="of").collect())
    assert kd_shards(none, 3).collect() == [] and shard_documents(none, 3).collect() == []
    whole = len(b"".join((r[1] or "").encode() for r in ROWS)) + 8 * len(ROWS)
    assert {r.shard for r in kd_shards(docs, target_bytes=whole).collect()} == {0}


def measures(text):
    text = text or ""
    own = NOT_SPACE.findall(text)
    seen = [ln for ln in text.split("\n") if NOT_SPACE.search(ln)]
    grams = [tuple(own[i : i + 8]) for i in range(len(own) - 7)]
    count = Counter(grams)
    twice = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(8)}
    return len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text), len(seen) - len(set(seen)), len(twice)


def test_quality_measures_and_verdicts(docs, none):
    out = judge_documents(docs).collect()
    want = Counter()
    for r in ROWS:
        m = measures(r[1])
        failed = m[0] < 20 or 100 * m[4] > 30 * m[0]
        want[r[:2] + m + (failed, not failed)] += 1
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert Counter((r.row.doc_id, r.row.text, *(r[n] for n in names)) for r in out) == want
    assert Counter(tuple(r.row) for r in out) == Counter(ROWS) and judge_documents(none).collect() == []


def test_a_host_goes_only_if_nearly_all_of_it_fails(spark):
    good, junk = prose(1, 60), "a b c d e f g h " * 20
    rows = [(i, junk if i % 50 else good, "bad") for i in range(500)] + [(500 + i, junk if i % 2 else good, "mixed") for i in range(200)]
    rows += [(1000 + i, good, "fine") for i in range(300)]
    out = judge_documents(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    kept = Counter(r.row.source for r in out if r.kept)
    assert kept == {"mixed": 100, "fine": 300}


def test_raked_weights_meet_their_targets(spark, docs, none):
    draw = random.Random(8)
    rows = [(i, prose(i, draw.randint(20, 200)), draw.choice(["en", "en", "de"]), "src0" if draw.random() < 0.4 else f"src{i % 9}") for i in range(4000)]
    targets = {"source": {"src0": 0.2}, "lang": {"en": 0.5, "de": 0.5}, "topic": {"prose": 0.8, "short": 0.2}}
    out = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), targets).collect()
    total = sum(r.tokens * r.probability for r in out)
    for d in targets:
        for c, share in targets[d].items():
            assert sum(r.tokens * r.probability for r in out if r[d] == c) / total == pytest.approx(share, abs=1e-8)
    drawn = sum(r.tokens for r in out if r.sampled)
    assert max(r.probability for r in out) == pytest.approx(1.0) and drawn == pytest.approx(total, rel=0.05)
    half = mix_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), targets, budget=0.3).collect()
    assert sum(r.tokens * r.probability for r in half) == pytest.approx(0.3 * sum(r.tokens for r in half), rel=1e-6)
    assert Counter(tuple(r.row) for r in mix_documents(docs, TARGETS).collect()) == Counter(ROWS)
    assert mix_documents(none, TARGETS).collect() == []


def test_licenses(spark, docs, none):
    texts = [
        "CC-BY! cc by cc by", "the GNU General Public License, version 3. General public license", "All rights reserved.",
        "Licensed under the (shiny) Apache License, Version 2.0.", "Permission is hereby granted, free of charge, to any legal person obtaining a copy",
        "licensed under the apple", "", None, "all rights, reserved all rights not reserved",
    ]
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in find_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    base = {i: (r.n_base, r.first_word, r.last_word, r.base_labels) for i, r in got.items()}
    assert base == {
        0: (3, 0, 4, "cc-by"), 1: (2, 2, 7, "gpl"), 2: (1, 0, 0, "reserved"), 3: (0, None, None, ""), 4: (0, None, None, ""), 5: (0, None, None, ""),
        6: (0, None, None, ""), 7: (0, None, None, ""), 8: (1, 0, 0, "reserved"),
    }
    assert (got[3].labels, got[4].labels, got[5].labels, got[0].labels) == ("apache", "mit", "", "cc-by")
    assert got[5].score == 0 and 0.6 <= got[3].score < 1 and got[2].score == 1
    assert by_row(find_licenses(docs).collect(), "doc_id", "n_words") == Counter((r[0], len(words(r[1]))) for r in ROWS)
    assert find_licenses(none).collect() == []


def test_personal_data_and_secrets_keep_rows(docs, none):
    for find in (find_personal_data, find_secrets):
        out = find(docs, docs.columns).collect()
        assert Counter(tuple(r.row) for r in out) == Counter(ROWS) and find(none, none.columns).collect() == []
        assert all(not r.base and not r.added for r in out if not (r.row.text or "").strip())


def test_bootstrap_finds_identifiers_after_sure_patterns_only(spark):
    rows = [(i, f"{prose(i, 30)} write to member user{i}@mail.example.org {prose(i + 999, 20)}") for i in range(60)]
    rows += [(100, f"{prose(7, 30)} write to member 4471-99-10332x now"), (101, f"{prose(8, 30)} the number 4471-99-10333x now")]
    rows += [(200 + i, f"{prose(i, 9)} often seen word x{i}@mail.example.org") for i in range(8)] + [(300 + i, f"{prose(i, 9)} often seen word plain") for i in range(60)]
    rows += [(400, "often seen word 4471-99-10334x")]
    out = {r.row.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"), ["doc_id"]).collect()}
    assert {i for i, r in out.items() if r.added} == {100}
    span = out[100].added[0]
    assert span.kind == "email" and rows[60][1][span.start : span.end] == "4471-99-10332x"


def test_pages_of_a_host_agree(spark):
    body = "<html><body><nav><a href=x>Menu</a></nav><div class='content'><h1>T {i}</h1><p>{a}</p><p>{b} &amp; more</p></div><div class='junk'><p>{c}</p></div></body></html>"
    rows = [(i, "http://a.example/" + str(i), body.format(i=i, a=prose(i, 80), b=prose(i + 50, 60), c=prose(i + 90, 10))) for i in range(9)]
    rows += [(9, "http://a.example/9", body.format(i=9, a=prose(9, 12), b=prose(59, 12), c=prose(99, 60)))]  # its own best would be the other
    rows += [(10, None, None), (11, "x", ""), (12, "http://b.example/", "plain <b>text</b>\n only"), rows[0]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("path", F.lit("mine"))
    out = extract_pages(df, df.columns).collect()
    assert len(out) == len(rows) and all(r.row.path == "mine" for r in out)
    text = {r.row.page_id: r.text for r in out}
    assert all(text[i] == f"T {i}\n{prose(i, 80)}\n{prose(i + 50, 60)} & more" for i in range(9))
    assert text[9] == f"T 9\n{prose(9, 12)}\n{prose(59, 12)} & more"
    assert (text[10], text[11], text[12]) == ("", "", "plain text only")
    assert extract_pages(df.limit(0), ["page_id"]).collect() == []


def test_urls(spark):
    rows = [
        (1, "http://A.Example.NET/en/x?y"), (2, "http://example.net/de/"), (3, "https://b.example.com/de/1#z"), (4, "ftp://x.org/fr/"), (5, None), (6, "no scheme"),
        (7, "http://net"), (8, "http://bad.site.com/q"), (9, "http://xexample.com/de/"), (10, "a://b://c/d"), (1, "http://A.Example.NET/en/x?y"), (None, "http://k.net/"),
    ]
    rows += [(100 + i, f"http://bad.site.com/{i}") for i in range(40)] + [(200 + i, f"http://good{i % 9}.other.com/{i}") for i in range(90)]
    labels = [(100 + i, 1) for i in range(40)] + [(200 + i, int(i % 30 == 0)) for i in range(90)] + [(None, 1), (100, None), (1, 0), (1, 0)]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("rules", F.lit(1))
    out = judge_urls(pages, spark.createDataFrame(labels, "page_id long, bad int")).collect()
    assert by_row(out, "page_id") == Counter((r[0],) for r in rows)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out}
    assert [got[i] for i in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10)] == [
        ("a.example.net", "/en/x", "example.net/en/", "allow"), ("example.net", "/de/", "net/", "block"), ("b.example.com", "/de/1", "example.com/de/", "block"),
        ("x.org", "/fr/", "org/fr/", "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("net", "", None, "allow"),
        ("bad.site.com", "/q", None, "block"), ("xexample.com", "/de/", None, "allow"), ("b:", "//c/d", None, "allow"),
    ]
    assert got[210][3] == "allow" and judge_urls(pages, spark.createDataFrame([], "page_id long, bad int")).where("verdict = 'block'").count() == 3


def test_sha_of_nothing_is_that_of_the_empty_text(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    r = find_leaks(df, spark.createDataFrame([], "item_id long, text string")).first()
    assert r.leak.n_hit == 0 and hashlib.sha256(b"").hexdigest().startswith("e3b0")
