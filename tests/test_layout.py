"""Bucketed tables plan no exchange; sketches add up; the plain silhouette equals a loop."""

import uuid

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from causalrisk.operators import sketches as sk
from causalrisk.operators import typology as ty
from causalrisk.operators.enrich import enrich
from causalrisk.operators.entity import entity_history
from causalrisk.sources.bucketed import exchanges, write_bucketed
from causalrisk.spec import EntityKey

KEYS = (EntityKey("card", ("card",)), EntityKey("pair", ("card", "kind")))


@pytest.fixture
def table(spark, tmp_path):
    def write(df, key, order=()):
        return write_bucketed(df, f"t_{uuid.uuid4().hex}", str(tmp_path / uuid.uuid4().hex), key, order, buckets=6)

    return write


def test_history_and_joins_over_buckets_move_no_rows(spark, table):
    draw = np.random.default_rng(1)
    rows = [(i, int(draw.integers(10**6)), float(draw.integers(100)), int(draw.integers(12)), ["a", "b", None][i % 3]) for i in range(2000)]
    facts = spark.createDataFrame(rows, "id long, t long, amount double, card int, kind string")
    laid = table(facts, "card", ("t", "id"))
    made = entity_history(laid, KEYS, "t", "amount", ("id",))
    plain = entity_history(facts, KEYS, "t", "amount", ("id",))
    assert exchanges(made) == 0 < exchanges(plain)
    key = lambda df: sorted(map(repr, df.select(sorted(df.columns)).collect()))
    assert key(made) == key(plain)
    right = spark.createDataFrame([(i, f"x{i}") for i in range(0, 2000, 3)], "id long, extra string")
    left_by_id, right_by_id = table(facts, "id"), table(right, "id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        joined = enrich(left_by_id, right_by_id, "id", check=False)
        assert exchanges(joined) == 0
        assert key(joined) == key(enrich(facts, right, "id"))
        assert exchanges(left_by_id.groupBy("id").count()) == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_sketches_of_days_add_up(spark):
    df = spark.range(60_000).select((F.col("id") % 30).alias("day"), (F.col("id") * 7919 % 20_011).alias("wide"), (F.col("id") % 13).cast("string").alias("few"),
                                    F.lit(None).cast("string").alias("none"), F.when(F.col("id") % 4 > 0, F.col("id") % 997).alias("gaps"))
    days = sk.column_sketches(df, ["wide", "few", "none", "gaps"], F.col("day"))
    got = {r["column"]: r for r in sk.merged(days).collect()}
    assert got["none"].n_unique == 0 and got["few"].n_unique == 13 and got["gaps"].n_missing == 15_000 and got["wide"].n_rows == 60_000
    assert abs(got["wide"].n_unique - 20_011) < 20_011 * sk.ERROR and abs(got["gaps"].n_unique - 997) < 997 * sk.ERROR
    some = sk.merged(days.where("day < 3")).where("column = 'wide'").first()
    assert abs(some.n_unique - df.where("day < 3").select("wide").distinct().count()) < 6000 * sk.ERROR
    assert sk.merged(days.where("day < 0")).collect() == []


def test_plain_silhouette_equals_a_loop(spark, monkeypatch):
    monkeypatch.setattr(ty, "BLOCK", 7)
    draw = np.random.default_rng(2)
    points = [(draw.normal(size=3) + 3 * c, c) for c in (0, 0, 0, 1, 1, 2) for _ in range(9)] + [(np.full(3, 40.0), 5), (np.zeros(3), 6), (np.zeros(3), 6)]
    df = spark.createDataFrame([(Vectors.dense(p.tolist()), c) for p, c in points], ["features", "prediction"])
    x, c = np.stack([p for p, _ in points]), np.array([c for _, c in points])
    total = 0.0
    for i in range(len(x)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        own = (c == c[i]) & (np.arange(len(x)) != i)
        if own.any():
            a, b = d[own].mean(), min(d[c == o].mean() for o in set(c.tolist()) - {c[i]})
            total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    assert abs(ty.euclidean_silhouette(df) - total / len(x)) < 1e-9
    assert ty.euclidean_silhouette(df.where("prediction = 0")) is None
    assert -1 <= ty.euclidean_silhouette(df, sample=20) <= 1
