import numpy as np
from pyspark.sql import functions as F

from causalrisk.functions.rowwise import add_row_features
from causalrisk.operators import models as md
from causalrisk.operators.encode import FrequencyEncoder
from causalrisk.operators.entity import entity_history, history_names
from causalrisk.spec import DatasetSpec, EntityKey
from causalrisk.streaming import Scorer, read_files, run_available, stream_history

CARD = EntityKey("card", ("card",))
SPEC = DatasetSpec("id", "t", "amount", "y", missing_flags=("gap",), frequency_columns=("card",))


def rows(spark, n=600):
    rng = np.random.default_rng(8)
    return spark.createDataFrame(
        [(i, 1000 + int(i // 3 * 2000), float(rng.integers(1, 9999)) / 100 if i % 11 else None, int(i % 4 == 0), [1, int(rng.integers(2, 9)), None][i % 3],
          float(rng.normal()) if i % 5 else None) for i in range(n)],
        "id long, t long, amount double, y int, card int, gap double")


def write_parts(df, folder, n):
    """Files of increasing time, one micro-batch each."""
    for i in range(n):
        df.filter((F.col("id") >= i * 200) & (F.col("id") < (i + 1) * 200)).coalesce(1).write.mode("append").parquet(folder)


def test_history_over_several_batches_equals_the_batch_windows(spark, tmp_path):
    df = rows(spark)
    folder = str(tmp_path / "in")
    write_parts(df, folder, 3)
    stream = stream_history(read_files(spark, folder, df.schema, files_per_batch=1), CARD, "t", "amount", "id")
    got = {r.id: r for r in run_available(stream, "history", str(tmp_path / "out")).collect()}
    want = {r.id: r for r in entity_history(df, (CARD,), "t", "amount", ("id",)).collect()}
    assert set(got) == set(want) and len(got) == 600
    for i, r in want.items():
        for name in history_names(CARD):
            a, b = got[i][name], r[name]
            assert (a is None or a != a) == (b is None), (i, name, a, b)
            assert b is None or abs(a - b) < 1e-6, (i, name, a, b)


def test_a_late_row_has_no_gap_and_leaves_the_newest_time(spark, tmp_path):
    folder = str(tmp_path / "in")
    for part in ([(1, 100_000, None, 7), (2, 100_050, 10.0, 7)], [(3, 50_000, 20.0, 7)], [(4, 100_060, 30.0, 7), (5, 100_060, None, None)]):
        spark.createDataFrame(part, "id long, t long, amount double, card int").coalesce(1).write.mode("append").parquet(folder)
    stream = read_files(spark, folder, spark.read.parquet(folder).schema, files_per_batch=1)
    got = {r.id: r for r in run_available(stream_history(stream, CARD, "t", "amount", "id"), "history", str(tmp_path / "out")).collect()}
    assert [got[i].card_count_prior for i in (1, 2, 3, 4, 5)] == [0, 1, 2, 3, None]
    assert [got[i].card_amt_mean_prior for i in (2, 3, 4)] == [None, 10.0, 15.0]
    assert [got[i].card_secs_since_last for i in (1, 2, 3, 4)] == [None, 50, None, 10]
    assert [got[i].card_txns_last_day for i in (2, 3, 4)] == [1, None, 3]


def test_stream_scores_equal_batch_and_continue(spark, tmp_path):
    df = rows(spark)
    train = add_row_features(df, SPEC)
    encoder = FrequencyEncoder(["card"]).fit(train)
    train = encoder.transform(train)
    features = ["amount", "amt_log", "hour", "gap", "gap_isna", "card_freq"]
    model = md.fit_baseline(train, features, [], "y")
    scorer = Scorer(SPEC, md.training_schema(train, features), model, 0.5, encoder, term_names=features, term_means=[0.0] * 6)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    requests = df.drop("y")
    write_parts(requests, folder, 2)
    run_available(scorer.transform(read_files(spark, folder, requests.schema)), "s", out)
    requests.filter("id >= 400").coalesce(1).write.mode("append").parquet(folder)
    streamed = run_available(scorer.transform(read_files(spark, folder, requests.schema)), "s", out)
    key = lambda d: sorted((r.id, r.probability, r.risk_band, r.decision) for r in d.collect())
    assert key(streamed) == key(scorer.transform(requests)) and streamed.count() == 600
    scorer.save(str(tmp_path / "scorer"))
    again = Scorer.load(spark, str(tmp_path / "scorer"))
    assert again.spec == SPEC and key(again.transform(requests)) == key(scorer.transform(requests))
    told = run_available(scorer.explain(read_files(spark, folder, requests.schema)), "e", str(tmp_path / "told"))
    assert told.count() == 600 and told.first().narrative.startswith("ALERT ")
    sparse = spark.createDataFrame([(5.0,)], "amount double")
    assert scorer.transform(sparse).first().id == 0
