import re

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from causalrisk.functions.fixed_values import BAND_ACTIONS, DISCLAIMER, STOP_WORDS
from causalrisk.functions.text import chunks, fixed_point, joined_list, plain_name, shown_value, three_digits
from causalrisk.operators import narrative as nr, retrieve as rt
from causalrisk.operators.casefile import find_row
from causalrisk.operators.models import risk_band

SLOW = dict(deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


@settings(max_examples=5, **SLOW)
@given(st.lists(st.one_of(st.floats(-1e15, 1e15), st.sampled_from([63.65, 27.15, 0.5, 999.5, 9.995, 0.00012345, 0.125, 1e-4, 9.9995e-5, 0.0])).filter(
    lambda v: v == 0 or 1e-12 < abs(v)), min_size=30, max_size=60))
def test_numbers_are_shown_as_by_format(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", three_digits(F.col("v")).alias("s"), fixed_point(F.col("v") % 1000, 1).alias("f")).collect():
        assert r.s == f"{r.v:.3g}".replace("-0", "-0") or r.v == 0, (r.v, r.s)


def test_values_and_names(spark):
    df = spark.createDataFrame([(None, True, 7, 1234.5, "x")], "n double, b boolean, i int, d double, s string")
    r = df.select(*[shown_value(F.col(c), k).alias(c) for c, k in (("n", "double"), ("b", "boolean"), ("i", "int"), ("d", "double"), ("s", "string"))]).first()
    assert tuple(r) == ("not recorded", "yes", "7", "1.23e+03", "x")
    names = {"hour": "the hour of day", "D1_isna": "missing days since the card was first seen", "q_isna": "missing q",
             "id_31_freq": "how common this browser is", "id_30_freq": "how common id_30 is", "V7": "anonymised behavioural signal V7", "zz": "zz"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", plain_name(F.col("n")).alias("p")).collect()
    assert {r.n: r.p for r in rows} == names


def test_lists(spark):
    df = spark.createDataFrame([(["a"],), (["a", "b"],), (["a", "b", "c"],)], "x array<string>")
    assert [r[0] for r in df.select(joined_list(F.col("x"))).collect()] == ["a", "a and b", "a, b and c"]


def windows(text, size, overlap):
    words = text.split()
    if len(words) <= size:
        return [text.strip()] if text.strip() else []
    out, at = [], 0
    while True:
        out.append(" ".join(words[at:at + size]))
        if at + size >= len(words):
            return out
        at += size - overlap


@settings(max_examples=5, **SLOW)
@given(st.lists(st.text(st.sampled_from("ab \t\n  \x1c\x85"), max_size=60), min_size=10, max_size=20))
def test_chunks(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chunks(F.col("t"), 5, 2).alias("c")).collect():
        assert r.c == windows(r.t, 5, 2)


def test_long_text_is_chunked_to_its_end(spark):
    text = " ".join(f"w{i}" for i in range(20_003))
    made = spark.createDataFrame([(text,)], "t string").select(chunks(F.col("t"))).first()[0]
    assert made == windows(text, 180, 40) and made[-1].endswith("w20002")


def narrative(spark, reasons, p=0.95, amount=1234.5, context=()):
    df = spark.createDataFrame([(7, p, amount, reasons, None, "visa")],
                               "id long, p double, amount double, reasons array<struct<feature:string,value:double,shown:string,contribution:double>>, a string, b string")
    return nr.narrate(df, "id", "p", "amount", "reasons", context).first()


def test_narrative_text(spark):
    reasons = [("hour", 3.0, "3", 0.5), ("D15", None, "not recorded", 0.4), ("dist1", 0.25, "0.25", -0.3), ("n_missing", 12.0, "12", 0.2)]
    r = narrative(spark, reasons, context=("a", "b"))
    assert r.narrative == (
        "ALERT 7 | risk CRITICAL (95.0%) | amount 1,234.50 Context: b=visa. "
        "The model raised this alert primarily because of the hour of day = 3, "
        "days since a prior related transaction = not recorded and the amount of missing data on this record = 12. "
        "Reducing the score: the distance between billing and transaction location = 0.25. "
        f"Recommended action: {BAND_ACTIONS['CRITICAL'][0]}. {DISCLAIMER}")
    assert len(r.drivers) == 3
    bare = narrative(spark, [], p=0.01).narrative
    assert "Reducing" not in bare and "Context" not in bare and "approve" in bare


def test_bands_and_actions(spark):
    df = spark.createDataFrame([(0.9,), (0.899,), (0.7,), (0.4,), (0.15,), (0.149,)], "p double")
    assert [r[0] for r in df.select(risk_band(F.col("p"))).collect()] == ["CRITICAL", "HIGH", "HIGH", "MEDIUM", "LOW", "MINIMAL"]
    bands = spark.createDataFrame([(" high ",), ("odd",), (None,)], "b string")
    rows = nr.required_action(bands, "b").collect()
    assert rows[0].required_action == BAND_ACTIONS["HIGH"][0] and rows[0].error is None
    assert "odd" in rows[1].error and "CRITICAL, HIGH, LOW, MEDIUM, MINIMAL" in rows[2].error


def test_point_lookup_reaches_the_scan(spark, tmp_path):
    spark.range(100).write.parquet(str(tmp_path / "t"))
    found = find_row(spark.read.parquet(str(tmp_path / "t")), "id", 42)
    assert found.count() == 1 and find_row(spark.range(3), "id", 9).count() == 0
    assert "EqualTo(id,42)" in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("batch", [4096, 3])
def test_cosine_search_is_exact(spark, batch):
    rng = np.random.default_rng(1)
    corpus, queries = rng.normal(size=(200, 8)), rng.normal(size=(9, 8))
    corpus[50] = corpus[20] * 3  # same direction: a tie, won by the smaller id
    queries[0] = corpus[20]
    c = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(corpus)] + [(999, None)], "id long, vector array<double>").repartition(5)
    q = spark.createDataFrame([(f"q{i}", v.tolist()) for i, v in enumerate(queries)] + [("none", None)], "id string, vector array<double>")
    found = {}
    for r in rt.cosine_top_k(q, c, "id", "id", 4, batch=batch).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.corpus_id, r.similarity)
    sims = np.round((queries / np.linalg.norm(queries, axis=1, keepdims=True)) @ (corpus / np.linalg.norm(corpus, axis=1, keepdims=True)).T, 10)
    assert "none" not in found
    for i in range(9):
        want = sorted(range(200), key=lambda j: (-sims[i, j], j))[:4]
        assert [found[f"q{i}"][k][0] for k in (1, 2, 3, 4)] == want
    assert found["q0"][1][0] == 20 and found["q0"][2][0] == 50
    few = rt.cosine_top_k(q, c.limit(2), "id", "id", 5).groupBy("query_id").count().collect()
    assert all(r["count"] <= 2 for r in few)


def ground(answer, contexts):
    words = [w for w in re.findall(r"[a-z]{4,}", answer.lower()) if w not in STOP_WORDS]
    known = set(re.findall(r"[a-z]{4,}", " ".join(contexts).lower()))
    if not words:
        return 0.0, []
    return round(sum(w in known for w in words) / len(words), 3), sorted({w for w in words if w not in known})[:10]


def test_groundedness(spark):
    context = {"g1": ["The reviewer must decline the transaction.", "Notify the cardholder within one hour."], "g2": []}
    answers = {
        "a1": ("g1", "Decline the transaction and notify the cardholder; cardholder review."),
        "a2": ("g1", "Bananas often dance under purple moons, said nobody."),
        "a3": ("g1", "The provided policy does not cover this."),
        "a4": ("g1", "it is as of"),
        "a5": ("g2", "Decline the transaction"),
        "a6": ("g1", "does not cover this " + "padding " * 40),
    }
    a = spark.createDataFrame([(k, g, t) for k, (g, t) in answers.items()], "id string, g string, answer string")
    c = spark.createDataFrame([(g, t) for g, ts in context.items() for t in ts], "g string, text string")
    rows = {r.id: r for r in rt.groundedness(a, c, "id", "answer", "g", "text").collect()}
    for k, (g, t) in answers.items():
        if k != "a3":
            assert (rows[k].grounded_ratio, rows[k].unsupported_terms) == ground(t, context[g]), k
    assert rows["a1"].verdict == "well grounded" and rows["a2"].verdict.startswith("POSSIBLE HALLUCINATION")
    assert rows["a3"].grounded_ratio == 1.0 and rows["a3"].verdict.startswith("correct refusal")
    assert rows["a4"].verdict == "empty answer"


def test_text_vectors_find_the_matching_text(spark):
    docs = spark.createDataFrame([(1, "refund the customer quickly"), (2, "device fingerprint and browser checks"), (3, "quarterly governance report")], "id long, text string")
    model = rt.fit_text_vectors(docs, "text")
    ask = spark.createDataFrame([("q", "browser fingerprint")], "id string, question string")
    hit = rt.cosine_top_k(rt.text_vectors(model, ask, "question"), rt.text_vectors(model, docs, "text"), "id", "id", 1).first()
    assert hit.corpus_id == 2
    units = docs.select(rt.unit_length(F.array(F.lit(3.0), F.lit(4.0)))).first()[0]
    assert units == [0.6, 0.8]


def test_prompt_orders_sources_and_counts(spark):
    hits = spark.createDataFrame([("q", "Why?", 2, "b.md", "second"), ("q", "Why?", 1, "a.md", "first"), ("q", "Why?", 3, "a.md", "third")],
                                 "q string, question string, rank int, source string, text string")
    r = rt.prompts(hits, "q", "question", "rank", "source", "text").first()
    assert r.sources == ["a.md", "b.md"] and r.chunks_used == 3
    assert r.prompt.index("SOURCE 1: [a.md] ---\nfirst") < r.prompt.index("SOURCE 2: [b.md]") < r.prompt.index("QUESTION: Why?")


def test_cosine_search_makes_each_vector_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def vector(i):
        made.add(1)
        return [1.0, float(i)]

    rows = spark.range(50).select("id", vector("id").alias("vector"))
    assert rt.cosine_top_k(spark.createDataFrame([(1, [1.0, 3.0])], "id long, vector array<double>"), rows, "id", "id", 2).count() == 2
    assert made.value == 50
