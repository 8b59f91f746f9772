import math

import numpy as np
import pandas as pd
import pytest

from causalrisk.operators.entity import entity_history
from causalrisk.spec import EntityKey

CARD = EntityKey("card1", ("card1",))
UID = EntityKey("uid", ("card1", "addr1"), "na")
ROWS = [  # id, seconds, amount, card1, addr1
    (1, 0, 100.0, 1, 10), (2, 100, 200.0, 1, 10), (3, 200, 300.0, 1, 10),
    (4, 300, 50.0, 2, 20), (5, 400, 1000.0, 1, 10), (6, 500, 60.0, 2, 20),
]
SCHEMA = "id long, t long, amount double, card1 int, addr1 int"


def history(spark, rows, keys=(UID,), **kw):
    df = spark.createDataFrame([(i, 86400 + t, a, c, d) for i, t, a, c, d in rows], SCHEMA)
    return {r.id: r for r in entity_history(df, keys, "t", "amount", ("id",), **kw).collect()}


def column(found, name):
    return [found[i][name] for i in sorted(found)]


def test_hand_computed_history(spark):
    h = history(spark, ROWS)
    assert column(h, "uid_count_prior") == [0, 1, 2, 0, 3, 1]
    assert column(h, "uid_amt_mean_prior") == [None, 100.0, 150.0, None, 200.0, 50.0]
    assert column(h, "uid_secs_since_last") == [None, 100, 100, None, 200, 200]
    assert h[5].uid_amt_ratio == 5.0
    assert (h[2].uid_amt_std_prior, h[3].uid_amt_std_prior) == (0.0, 50.0)
    assert column(h, "uid_txns_last_day") == [0, 1, 2, 0, 3, 1]


def test_later_rows_change_nothing_before(spark):
    before, after = history(spark, ROWS), history(spark, [*ROWS, (7, 600, 999999.0, 1, 10)])
    assert all(before[i] == after[i] for i in before)


def test_same_second_counts_by_order_but_not_in_the_trailing_day(spark):
    h = history(spark, [(1, 0, 1.0, 1, 1), (2, 0, 2.0, 1, 1), (3, 86400, 3.0, 1, 1), (4, 86401, 4.0, 1, 1)])
    assert column(h, "uid_count_prior") == [0, 1, 2, 3]
    assert column(h, "uid_txns_last_day") == [0, 0, 2, 1]


def test_absent_entity_has_no_history(spark):
    rows = [(1, 0, 1.0, None, 5), (2, 10, 2.0, None, 5), (3, 20, 2.0, 7, None), (4, 30, 5.0, 7, None)]
    h = history(spark, rows, (CARD, UID))
    assert column(h, "card1_count_prior") == [None, None, 0, 1]
    assert column(h, "uid_count_prior") == [0, 1, 0, 1]


def brute(rows, key):
    out = {}
    seen = {}
    for i, t, a, *parts in sorted(rows, key=lambda r: (r[1], r[0])):
        k = parts[0] if key == "card1" else tuple("na" if p is None else p for p in parts)
        if key == "card1" and k is None:
            out[i] = (None,) * 6
            continue
        past = seen.setdefault(k, [])
        amounts = np.array([x[1] for x in past])
        mean = amounts.mean() if past else None
        out[i] = (
            len(past), mean, amounts.std() if past else None, a / mean if past and mean else None,
            t - past[-1][0] if past else None, sum(t - 86400 <= s < t for s, _ in past),
        )
        past.append((t, a))
    return out


@pytest.mark.parametrize("limit, partitions", [(10**9, 4), (30, 1), (30, 7), (200, 16)])
def test_all_plans_agree_with_brute_force(spark, limit, partitions):
    """One card holds a third of the rows, another third has no card; many rows share a second."""
    rng = np.random.default_rng(limit % 97 + partitions)
    rows = []
    for i in range(900):
        card = [1, None, int(rng.integers(2, 40))][i % 3]
        t = 40_000 if rng.random() < 0.1 else int(rng.integers(0, 400_000))
        rows.append((i, t, float(rng.integers(1, 100_000)) / 100, card, int(rng.integers(0, 3)) or None))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        found = history(spark, rows, (CARD, UID), rows_per_task=limit)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(found) == 900
    names = ("count_prior", "amt_mean_prior", "amt_std_prior", "amt_ratio", "secs_since_last", "txns_last_day")
    for key in ("card1", "uid"):
        want = brute(rows, key)
        for i, values in want.items():
            for name, value in zip(names, values):
                got = found[i][f"{key}_{name}"]
                assert (got is None) == (value is None), (key, i, name, got, value)
                assert value is None or math.isclose(got, value, rel_tol=1e-9, abs_tol=1e-6), (key, i, name, got, value)


def test_windows_share_one_exchange(spark):
    df = spark.createDataFrame([(i, i, 1.0, i % 5, i % 2) for i in range(50)], SCHEMA)
    supplier, pair = EntityKey("a", ("card1",)), EntityKey("b", ("card1", "addr1"))
    plan = entity_history(df, (supplier, pair), "t", "amount", ("id",))._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("Exchange hashpartitioning") == 1
