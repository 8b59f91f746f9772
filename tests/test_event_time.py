import random

import pytest
from pyspark.sql import functions as F

from causalrisk.catalog import streams
from causalrisk.operators.entity import entity_history, history_names
from causalrisk.spec import EntityKey
from causalrisk.streaming import event_history, read_files, run_available

CARD = EntityKey("card", ("card",))
SCHEMA = "id long, t long, amount double, card int"


def arrive(spark, folder, parts):
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(f"{folder}/part{i}")
        yield spark.read.schema(SCHEMA).parquet(f"{folder}/part{i}")


def run(spark, tmp_path, parts, **settings):
    """Files one after the other, a micro-batch each."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, part in enumerate(parts):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        stream = read_files(spark, folder, spark.createDataFrame([], SCHEMA).schema)
        rows = run_available(event_history(stream, CARD, "t", "amount", "id", **settings), "history", out)
    return {r.id: r for r in rows.collect()}


def same(got, want):
    for name in history_names(CARD):
        a, b = got[name], want[name]
        assert (a is None or a != a) == (b is None), (got, want)
        assert b is None or abs(a - b) < 1e-6, (got, want)


def test_rows_shuffled_within_the_delay_have_the_batch_history(spark, tmp_path):
    draw = random.Random(3)
    rows = [(i, 1000 + i // 2 * 500, draw.choice([None, 5.0, 7.5, 100.0]), draw.choice([1, 1, 2, 3, None])) for i in range(300)]
    shuffled = sorted(rows, key=lambda r: r[1] + draw.uniform(0, 4000))
    got = run(spark, tmp_path, [shuffled[i : i + 60] for i in range(0, 300, 60)], delay=5000)
    want = {r.id: r for r in entity_history(spark.createDataFrame(rows, SCHEMA), (CARD,), "t", "amount", ("id",)).collect()}
    line = max(r[1] for r in rows) - 5000
    assert set(got) == {r[0] for r in rows if r[1] < line or r[3] is None} and not any(r.late for r in got.values())
    for i, r in got.items():
        same(r, want[i])


def test_later_rows_go_to_the_side_output(spark, tmp_path):
    parts = [[(1, 1000, 10.0, 7), (2, 9000, 20.0, 7)], [(3, 500, 99.0, 7), (4, 8500, 30.0, 7), (5, None, 1.0, 7)], [(6, 30_000, 1.0, 8)]]
    got = run(spark, tmp_path, parts, delay=1000)
    assert got[3].late and got[3].card_count_prior is None and not got[4].late
    assert [got[i].card_count_prior for i in (1, 4, 2, 5)] == [0, 1, 2, None]
    assert [got[i].card_secs_since_last for i in (1, 4, 2)] == [None, 7500, 500]
    assert got[2].card_amt_mean_prior == 20.0 and 6 not in got


def test_silent_entities_are_forgotten(spark, tmp_path):
    parts = [[(1, 1000, 10.0, 7), (2, 1100, 20.0, 7), (3, 1000, 5.0, 9)], [(4, 50_000, 1.0, 8)], [(5, 51_000, 30.0, 7), (6, 51_100, 40.0, 7), (7, 1500, 1.0, 7)], [(8, 90_000, 1.0, 8)]]
    got = run(spark, tmp_path, parts, delay=100, ttl=10_000)
    assert [got[i].card_count_prior for i in (1, 2, 3, 4, 5, 6)] == [0, 1, 0, 0, 0, 1]
    assert got[5].card_secs_since_last is None and got[6].card_amt_mean_prior == 30.0 and got[7].late
    # the same rows in one batch: the gap itself starts the entity anew
    again = run(spark, tmp_path / "again", [[r for part in parts for r in part if r[0] != 7], [(9, 200_000, 1.0, 8)]], delay=100, ttl=10_000)
    for i in (1, 2, 3, 4, 5, 6):
        same(again[i], got[i])
    assert again[8].card_count_prior == 0


@pytest.mark.parametrize("ttl", [None, 3000])
def test_entities_share_the_state_of_their_group(spark, tmp_path, ttl):
    """As many states as groups, whatever the number of entities, and the same rows."""
    draw = random.Random(5)
    rows = [(i, 1000 + i // 3 * 200, draw.choice([None, 5.0, 7.5, 100.0]), draw.randrange(60)) for i in range(240)]
    shuffled = sorted(rows, key=lambda r: r[1] + draw.uniform(0, 900))
    parts = [shuffled[i : i + 80] for i in range(0, 240, 80)]
    few, many = (run(spark, tmp_path / str(n), parts, delay=1000, ttl=ttl, groups=n) for n in (2, 500))
    names = history_names(CARD)
    plain = lambda got: {i: repr([r[n] for n in names]) for i, r in got.items()}
    assert plain(few) == plain(many) and len({r.card for r in few.values()}) > 50
    if ttl is None:
        want = {r.id: r for r in entity_history(spark.createDataFrame(rows, SCHEMA), (CARD,), "t", "amount", ("id",)).collect()}
        for i, r in few.items():
            same(r, want[i])
        assert spark.read.format("statestore").load(str(tmp_path / "2" / "out" / "_progress")).count() == 2


def test_a_key_that_is_no_number_is_one_entity(spark, tmp_path):
    folder, out, schema = str(tmp_path / "in"), str(tmp_path / "out"), "id long, t long, amount double, card double"
    for part in ([(1, 1000, 10.0, float("nan")), (2, 1100, 20.0, 0.0)], [(3, 5000, 30.0, float("nan")), (4, 5100, 1.0, -0.0)], [(5, 90_000, 1.0, 5.0)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = read_files(spark, folder, spark.createDataFrame([], schema).schema)
        rows = run_available(event_history(stream, CARD, "t", "amount", "id", delay=100), "history", out)
    assert {r.id: r.card_amt_mean_prior for r in rows.collect()} == {1: None, 2: None, 3: 10.0, 4: 20.0}


def test_arrivals_fill_whole_batches(spark, tmp_path):
    """The rows of an arrival are in as many files as asked for, even where there are fewer rows than files."""
    folder = str(tmp_path / "in")
    for rows, files in ((500, 3), (1, 3), (0, 2), (7, 1)):
        before = set(spark.read.schema("id long").parquet(folder).inputFiles()) if (tmp_path / "in").exists() else set()
        streams.arrive(spark.range(rows), folder, files)
        now = set(spark.read.schema("id long").parquet(folder).inputFiles())
        assert len(now - before) == files and spark.read.schema("id long").parquet(*now - before).count() == rows
