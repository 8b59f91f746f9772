import random

import numpy as np
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from causalrisk.operators import latent
from causalrisk.operators.latent import LatentVectors
from causalrisk.operators.retrieve import cosine_top_k, fit_text_vectors, text_vectors

TOPICS = {
    "cars": "engine wheel brake motor gear clutch tyre road driver fuel".split(), "sea": "boat wave sail harbour anchor tide crew deck storm fish".split(),
    "kitchen": "pan oven knife flour sugar butter stove recipe spoon dough".split(),
}


def texts(n, seed=1):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        topic = list(TOPICS)[i % 3]
        words = draw.sample(TOPICS[topic], 5) + [draw.choice("the of and to in is it".split()) for _ in range(6)]
        draw.shuffle(words)
        out.append((i, topic, " ".join(words)))
    return out


def test_singular_values_equal_a_full_decomposition(spark):
    df = spark.createDataFrame([*texts(300), (900, "none", None), (901, "none", "")], "id long, topic string, text string").repartition(5)
    made = LatentVectors.fit(df, "text", dimensions=8, terms=256, passes=6)
    plain = df.select(F.coalesce("text", F.lit("")).alias("_text"))
    a = np.stack([r.v for r in made.weights.transform(plain).select(vector_to_array("_weighted").alias("v")).collect()])
    want = np.linalg.svd(a, compute_uv=False)[:8]
    assert np.allclose(made.strengths, want, rtol=0.01) and np.allclose(made.basis.T @ made.basis, np.eye(8), atol=1e-8)
    few = LatentVectors.fit(df.limit(3), "text", dimensions=8, terms=64)
    assert np.isfinite(few.basis).all() and (few.strengths[4:] < 1e-6).all()
    none = LatentVectors.fit(df.limit(0), "text", dimensions=4, terms=64)
    assert {tuple(r.vector) for r in none.transform(df.limit(5), "text").collect()} == {(0.0,) * 4}


def test_a_text_finds_its_topic_without_sharing_words(spark, tmp_path):
    corpus = spark.createDataFrame(texts(600), "id long, topic string, text string").repartition(4)
    # a question has two words of its topic; passages that hold neither are compared
    asked = [(i, t, " ".join(TOPICS[t][2 * (i // 3) : 2 * (i // 3) + 2])) for i, t in enumerate(list(TOPICS) * 4)]
    questions = spark.createDataFrame(asked, "q long, asked string, question string")
    made = LatentVectors.fit(corpus, "text", dimensions=6, terms=1 << 10)
    made.save(str(tmp_path / "latent"))
    lexical = fit_text_vectors(corpus, "text")

    def share(left, right):
        hits = cosine_top_k(left, right, "q", "id", 200).join(corpus, F.col("corpus_id") == F.col("id")).join(questions, F.col("query_id") == F.col("q"))
        strange = hits.where(~F.arrays_overlap(F.split("text", " "), F.split("question", " ")))
        return strange.agg(F.avg((F.col("topic") == F.col("asked")).cast("int"))).first()[0]

    for model in (made, LatentVectors.load(spark, str(tmp_path / "latent"))):
        assert share(model.transform(questions, "question"), model.transform(corpus, "text")) > 0.9
    assert (share(text_vectors(lexical, questions, "question"), text_vectors(lexical, corpus, "text")) or 0) < 0.7


def test_terms_come_from_the_text_alone(spark):
    """The stored terms are those of the dense vector, without an array of all terms for every text."""
    df = spark.createDataFrame([*texts(30), (900, "none", None), (901, "none", "")], "id long, topic string, text string")
    made = LatentVectors.fit(df, "text", dimensions=4, terms=256, passes=1)
    plain = df.select("id", F.coalesce("text", F.lit("")).alias("_text"))
    sparse = LatentVectors._sparse(made.weights, plain, ["id"])
    dense = {r.id: r.v for r in made.weights.transform(plain).select("id", vector_to_array("_weighted").alias("v")).collect()}
    for r in sparse.collect():
        assert dict(zip(r.i, r.x, strict=True)) == {i: x for i, x in enumerate(dense[r.id]) if x}
    assert "unwrap_udt" in sparse._jdf.queryExecution().analyzed().toString()


def test_products_of_dense_slices_and_words_cut_once(spark, monkeypatch):
    """A pass and the last one are the products of the whole matrix, and the fit cuts the texts into words once."""
    df = spark.createDataFrame([*texts(100), (900, "none", None), (901, "none", "")], "id long, topic string, text string").repartition(3)
    stored, materialise = [], latent.materialise
    monkeypatch.setattr(latent, "materialise", lambda d, label: stored.append((label, d.inputFiles())) or materialise(d, label))
    made = LatentVectors.fit(df, "text", dimensions=4, terms=1 << 12, passes=1)
    # The matrix is made from the stored counts and not from the texts.
    assert [label for label, _ in stored] == ["counts", "terms"] and stored[1][1] and "counts-" in stored[1][1][0]
    plain = df.select(F.coalesce("text", F.lit("")).alias("_text"))
    a = np.stack([r.v for r in made.weights.transform(plain).select(vector_to_array("_weighted").alias("v")).collect()])
    rows, q = LatentVectors._sparse(made.weights, plain, []), np.random.default_rng(4).normal(size=(1 << 12, 7))
    assert np.allclose(LatentVectors._pass(spark, rows, q), a.T @ (a @ q)) and np.allclose(LatentVectors._gram(spark, rows, q), (a @ q).T @ (a @ q))
    # Columns that are not asked for are not made, so the text passes no Python.
    vectors = made.transform(df, "text").select("id", "vector")
    sent = vectors._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInPandas" not in sent and {tuple(r.vector) for r in vectors.where("id >= 900").collect()} == {(0.0,) * 4}


def test_passages_are_made_by_all_tasks(spark, tmp_path):
    """A file with one row group is one task's work, whatever the number of its splits."""
    from causalrisk.catalog.text import _passages

    draw = random.Random(4)
    rows = [(None if i % 2 else i, " ".join("".join(draw.choices("abcdefgh", k=6)) for _ in range(60))) for i in range(400)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        made = _passages(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(made) >= 4 and max(r[1] for r in made) < 200
