"""Amounts of zero before a row: its ratio is infinite or NaN, as in SQL, in every kind of history."""

import datetime as dt

import duckdb
import pytest

import __spark_entry__ as entry
from tests.compare import compare

from causalrisk.catalog.common import r4


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("zero"))
    start = dt.datetime(2024, 1, 1)
    rows = []
    for user in range(6):
        for i in range(60):
            value = 0.0 if i < user * 5 else round((i * 37 + user) % 101 + 0.25, 2)
            rows.append((user * 100 + i, start + dt.timedelta(hours=i, minutes=user), user, "view" if i % 3 else "click", value, f'{{"k": {i}}}'))
    con = duckdb.connect()
    con.execute("CREATE TABLE events (event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type VARCHAR, value DOUBLE, props VARCHAR)")
    con.executemany("INSERT INTO events VALUES (?, ?, ?, ?, ?, ?)", rows)
    con.execute(f"COPY events TO '{path}/events.parquet' (FORMAT parquet)")
    return path


@pytest.mark.parametrize("name", [
    "entity_history_events", "entity_history_of_buckets", "entity_history_segmented", "stream_entity_history", "stream_event_history",
])
def test_ratio_to_a_mean_of_zero(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{folder}/events.parquet')")
    made = entry.queries()[name](spark, folder)
    found = {str(r[0]) for r in made.select("client_amt_ratio").collect()}
    assert {"inf", "nan"} <= found
    same, note = compare(spark, con, folder, entry.queries()[name], entry.oracle_sql()[name])
    assert same, note


def test_rounding_keeps_what_is_not_finite(spark):
    rows = spark.createDataFrame([(float("inf"),), (float("-inf"),), (float("nan"),), (None,), (2.00005,), (1e300,)], "x double")
    inf, minus, nan, none, two, large = [r[0] for r in rows.select(r4("x")).collect()]
    assert (inf, minus, none, two) == (float("inf"), float("-inf"), None, 2.0001)
    assert nan != nan and large == pytest.approx(1e300)
