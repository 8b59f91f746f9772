import math

from pyspark.sql import functions as F

from causalrisk import CARD_PAYMENTS
from causalrisk.functions.rowwise import add_entity_keys, add_reference_days, add_row_features, model_features
from causalrisk.operators.encode import FrequencyEncoder, select_recent

SCHEMA = "TransactionID long, TransactionDT long, TransactionAmt double, isFraud int, P_emaildomain string, R_emaildomain string, id_31 string, card1 double, addr1 double, D1 double"


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def test_row_features(spark):
    r = add_row_features(rows(
        spark, (1, 86400 * 8 + 3600 * 6, 10.55, 0, "gmail.com", "live.com.mx", None, 5.0, None, 3.0)), CARD_PAYMENTS).first()
    assert abs(r.amt_log - math.log1p(10.55)) < 1e-12
    assert (r.amt_cents, r.amt_is_round, r.hour, r.dayofweek, r.is_night) == (0.55, 0, 6, 1, 1)
    assert (r.id_31_isna, r.addr1_isna, r.D1_isna, r.P_emaildomain_isna) == (1, 1, 0, 0)
    assert r.n_missing == 2
    assert (r.P_emaildomain_provider, r.P_emaildomain_suffix, r.R_emaildomain_suffix) == ("gmail", "com", "mx")
    assert r.email_domains_match == 0
    assert "dist1_isna" not in r


def test_missing_domains(spark):
    r = add_row_features(rows(spark, (1, 0, 5.0, 0, None, "a.b", "x", 1.0, 1.0, 1.0)), CARD_PAYMENTS).first()
    assert (r.P_emaildomain_provider, r.email_domains_match, r.amt_is_round) == ("__missing__", None, 1)


def test_offsets_become_the_same_day_and_keys_fold_gaps(spark):
    df = rows(
        spark, (1, 86400 * 100, 1.0, 0, None, None, None, 13926.0, 10.0, 30.0),
        (2, 86400 * 110, 1.0, 0, None, None, None, None, 10.0, 40.0))
    made = add_entity_keys(add_reference_days(df, CARD_PAYMENTS), CARD_PAYMENTS).orderBy("TransactionID").collect()
    assert [r.D1n for r in made] == [70, 70]
    assert [r.uid for r in made] == ["13926.0_10.0_70", "na_10.0_70"]
    assert made[0].uid2 == "13926.0_10.0_70_na_na"


def test_model_features_hide_identity_and_time(spark):
    made = add_entity_keys(rows(spark), CARD_PAYMENTS)
    names = model_features(made, CARD_PAYMENTS, drop=("id_31",))
    assert not {"TransactionID", "TransactionDT", "isFraud", "uid", "uid2", "id_31"} & set(names)
    assert {"card1", "TransactionAmt"} <= set(names)


def test_frequencies_come_from_training_rows_only(spark):
    train = spark.createDataFrame([(1, "chrome"), (1, "chrome"), (1, "safari"), (2, "ie"), (None, None)], "card1 int, id_31 string")
    encoder = FrequencyEncoder(["card1", "id_31", "absent"]).fit(train)
    assert encoder.columns == ["card1", "id_31"]
    sparse = spark.createDataFrame([(1,), (999,), (None,)], "card1 int")
    made = encoder.transform(sparse).collect()
    assert sorted((r.card1_freq, r.id_31_freq) for r in made) == [(0.0, 0.0), (0.0, 0.0), (0.75, 0.0)]


def test_large_maps_are_joined_by_shuffle(spark, monkeypatch, tmp_path):
    from causalrisk.operators import encode

    train = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "c string")
    encoder = FrequencyEncoder(["c"]).fit(train)
    small = {(r.c, r.c_freq) for r in encoder.transform(train).collect()}
    monkeypatch.setattr(encode, "BROADCAST_LEVELS", 0)
    assert {(r.c, r.c_freq) for r in encoder.transform(train).collect()} == small
    encoder.save(str(tmp_path / "map"))
    again = FrequencyEncoder.load(spark, str(tmp_path / "map"), ["c"])
    assert {(r.c, r.c_freq) for r in again.transform(train).collect()} == small


def test_most_recent_rows(spark):
    df = spark.range(100).select(F.col("id"), F.floor(F.col("id") / 7).alias("t"))
    for n in (0, 1, 13, 100, 150):
        kept = sorted(r.id for r in select_recent(df, "t", "id", n).collect())
        assert kept == list(range(max(0, 100 - n), 100))
