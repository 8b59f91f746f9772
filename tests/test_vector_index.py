import numpy as np
import pytest
from pyspark.sql import functions as F

from causalrisk.operators import vector_index as vi
from causalrisk.operators.retrieve import best_products, cosine_top_k

SCHEMA = "id long, v array<double>"


def clustered(n, seed=1):
    draw = np.random.default_rng(seed)
    centres = np.random.default_rng(99).normal(size=(30, 16)) * 4
    return [(i, (centres[i % 30] + draw.normal(size=16)).tolist()) for i in range(n)]


def hits(df):
    return sorted((r.query_id, r["rank"], r.corpus_id, round(r.similarity, 8)) for r in df.collect())


@pytest.fixture(scope="module")
def corpus(spark):
    rows = clustered(3000) + [(9000, None), (9001, [0.0] * 16), (9002, clustered(1)[0][1]), (9003, clustered(1)[0][1])]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


def test_all_cells_give_the_exact_hits(spark, corpus, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 37)
    monkeypatch.setattr(vi, "QUERY_ROWS", 5)
    queries = spark.createDataFrame([*clustered(40, seed=2), (50, None), (51, [0.0] * 16), (52, clustered(1)[0][1])], SCHEMA)
    index = vi.VectorIndex.fit(corpus, "id", "v")
    assert hits(index.search(queries, "id", "v", 10, index.cells)) == hits(cosine_top_k(queries, corpus, "id", "id", 10, "v", "v"))
    assert sum(r.n for r in index.sizes().collect()) == 3003 and index.cells > 30


def test_few_cells_find_clustered_neighbours(spark, corpus, tmp_path):
    queries = spark.createDataFrame(clustered(200, seed=3), SCHEMA)
    index = vi.VectorIndex.fit(corpus, "id", "v", cells=30, path=str(tmp_path / "index"))
    probes = index.probes_for(corpus, "id", "v", queries, "id", "v", 10)
    exact = cosine_top_k(queries, corpus, "id", "id", 10, "v", "v")
    read = index.rows_read(queries, "id", "v", probes).first()
    assert index.recall(exact, queries, "id", "v", 10, probes) >= 0.9
    assert read.queries == 200 and read.mean_rows < 0.3 * 3000
    again = vi.VectorIndex.load(spark, str(tmp_path / "index"))
    assert hits(again.search(queries, "id", "v", 10, probes)) == hits(index.search(queries, "id", "v", 10, probes))


def test_small_and_empty_corpora(spark, corpus):
    queries = spark.createDataFrame(clustered(3), SCHEMA)
    for n in (0, 1, 2):
        few = corpus.where(F.col("id") < n)
        index = vi.VectorIndex.fit(few, "id", "v")
        assert hits(index.search(queries, "id", "v", 5, index.cells)) == hits(cosine_top_k(queries, few, "id", "id", 5, "v", "v"))


def test_a_query_is_sent_once_per_shelf(spark, corpus, monkeypatch):
    """All cells probed: as many copies of a query as shelves, not as cells; a cell larger than a shelf is cut."""
    monkeypatch.setattr(vi, "BLOCK_ROWS", 37)
    for shelf_rows in (40, 700, 16_384):
        monkeypatch.setattr(vi, "SHELF_ROWS", shelf_rows)
        queries = spark.createDataFrame(clustered(40, seed=2), SCHEMA)
        index = vi.VectorIndex.fit(corpus, "id", "v", cells=20)
        shelves = index._shelves(set(range(20)))
        sent = index._asked(queries, "id", "v", 20, shelves).agg(F.sum(F.size("asked"))).first()[0]
        assert sent == 40 * sum(s[3] for s in shelves)
        assert shelf_rows == 40 or sent <= 40 * (2 * 3003 // shelf_rows + 1)
        assert hits(index.search(queries, "id", "v", 10, 20)) == hits(cosine_top_k(queries, corpus, "id", "id", 10, "v", "v"))


@pytest.mark.parametrize("n", [3, 300, 5000])
def test_best_products_sort_as_a_full_sort(n):
    draw = np.random.default_rng(n)
    left, right = draw.normal(size=(300, 4)), draw.normal(size=(n, 4))
    right[n // 2 :: 2] = right[0]  # many ties
    row, at, similar = best_products(left, right, 7)
    full = np.round(left @ right.T, 10)
    want = np.argsort(-full, axis=1, kind="stable")[:, :7]
    assert (at.reshape(300, -1) == want).all() and (row.reshape(300, -1) == np.arange(300)[:, None]).all()
    assert np.allclose(similar.reshape(300, -1), np.take_along_axis(full, want, axis=1), atol=1e-9)
