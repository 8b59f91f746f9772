"""The pipeline against a plain version of each stage, stage by stage and as a whole."""

from __future__ import annotations

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from tests.llm.cases import prose
from tests.llm.test_awkward import leaks, measures, shingles


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    passage = prose(77, 30)
    rows = []
    for i in range(400):
        text = prose(i // 2 if i % 10 == 0 else i + 1000, 30 + i % 120)
        if i % 10 == 1:
            text = rows[-1][1] + " " + prose(i, 1)  # a near copy of the one before
        if i % 25 == 7:
            text = f"{text[:40]} {passage.upper()} {text[40:]}"
        if i % 17 == 3:
            text = "junk again and again for ever more now " * 9
        if i % 40 == 11:
            text = passage
        rows.append((i, text, ["en", "en", "de", "fr", None][i % 5], f"src{i % 4}", len(text)))
    rows += [rows[12], rows[12], (12, prose(9000, 50), "en", "src1", 9), (2, rows[13][1], "en", "src1", 9), (None, prose(5, 50), "en", "src1", 3), (None, prose(5, 50), "en", "src1", 3), (500, None, "en", "src0", 0), (501, "", None, None, 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, {1: passage}


def plain_quality(rows):
    kept = []
    for r in rows:
        n, *_, repeated = measures(r[1])
        if n >= 20 and 100 * repeated <= 30 * n:
            kept.append(r)
    return kept


def plain_dedup(rows):
    """Of each linked group the row with the least (id, text) stays once, whatever other rows share its id."""
    sets = [shingles(r[1]) for r in rows]
    name = list(range(len(rows)))

    def root(i):
        while name[i] != i:
            i = name[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                name[root(i)] = root(j)
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root(i) if sets[i] else ("none", i), []).append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


def topic_of(text):
    n = measures(text)[0]
    size, text = len(text or ""), text or ""
    if text.count("|") * 5 > n:
        return "table"
    if sum(c in "#*$%&<>" for c in text) * 20 > size:
        return "symbols"
    if sum("A" <= c <= "Z" for c in text) * 3 > size:
        return "capitals"
    return "short" if n < 100 else "prose"


def plain_mix(rows, targets):
    def cell(r):
        found = {"source": r[3], "lang": r[2], "topic": topic_of(r[1])}
        return tuple(found[d] if found[d] in targets[d] else "(other)" for d in targets)

    tokens = Counter()
    for r in rows:
        tokens[cell(r)] += measures(r[1])[0]
    weight = {c: float(n) for c, n in tokens.items() if n}
    for _ in range(200):
        for i, d in enumerate(targets):
            own = Counter()
            for c, w in weight.items():
                own[c[i]] += w
            goal = {c: targets[d].get(c, max(0.0, 1 - sum(targets[d].values())) if c == "(other)" else 0.0) for c in own}
            total, all_goals = sum(own.values()), sum(goal.values())
            weight = {c: w * goal[c[i]] / all_goals * total / own[c[i]] if own[c[i]] else w for c, w in weight.items()}
    top = max(weight[c] / tokens[c] for c in weight)
    chance = {c: weight[c] / tokens[c] / top for c in weight}

    def drawn(r):
        digest = hashlib.md5(f"{'' if r[0] is None else r[0]}|mix".encode()).hexdigest()
        return int(digest[:8], 16) / 2**32 < chance.get(cell(r), 0.0)

    return [r for r in rows if drawn(r)]


def test_every_stage_and_the_whole(spark, folder):
    path, rows, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    steps = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["quality_rules", "jaccard_join", "benchmark_decontamination", "mixing", "sharding"]

    def held(name, df):
        out = [tuple(r) for r in steps[name](spark, df, path).collect()]
        return spark.createDataFrame(out, docs.schema), out

    docs2, good = held("quality_rules", docs)
    assert Counter(good) == Counter(plain_quality(rows)) and len(good) < len(rows)
    docs3, once = held("jaccard_join", docs2)
    assert Counter(once) == Counter(plain_dedup(good)) and len(once) < len(good)
    docs4, clean = held("benchmark_decontamination", docs3)
    found = {r[:1] + r[2:4]: leaks(r[1], items) for r in once}
    want = {r for r in once if not found[r[:1] + r[2:4]][1]}
    whole = {r[0] for r in once if found[r[:1] + r[2:4]][1] > 0.5 * found[r[:1] + r[2:4]][0]}
    assert want < set(clean) and whole and {r[0] for r in once} - {r[0] for r in clean} == whole
    assert all(leaks(r[1], items)[1] == 0 and r[4] == len(r[1]) for r in set(clean) - want) and len(set(clean) - want) > 5
    docs5, mixed = held("mixing", docs4)
    assert Counter(mixed) == Counter(plain_mix(clean, cp.MIX_TARGETS)) and 0 < len(mixed) < len(clean)
    last = cp.sharding(spark, docs5, path).collect()
    assert Counter(tuple(r)[:5] for r in last) == Counter(mixed) and {r.shard for r in last} <= set(range(24))
    whole_run = cp.run(spark, path)
    assert whole_run.columns == [*docs.columns, "shard"]
    assert Counter(tuple(r) for r in whole_run.collect()) == Counter(tuple(r) for r in last)


def test_clashing_columns_pass_all_stages(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    plain = [n for n in docs.columns]
    for c in ("shard", "row", "kept", "_key", "of", "cut_text"):
        docs = docs.withColumn(c, F.lit(c))
    columns = docs.columns
    for _, stage in cp.STAGES:
        out = stage(spark, docs, folder[0])
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.columns == [*columns, "_shard"] and docs.count() == cp.run(spark, folder[0]).select(*plain).count() > 0
    assert docs.where("shard != 'shard' or row != 'row' or _key != '_key'").isEmpty()


def test_an_empty_table_passes_all_stages(spark, tmp_path, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        out = stage(spark, docs, folder[0])
        docs = spark.createDataFrame(out.collect(), out.schema)
    assert docs.count() == 0
