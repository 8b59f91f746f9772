import pytest

from causalrisk.operators import contracts as ct
from causalrisk.operators.enrich import coverage, enrich, row_count_change
from causalrisk.plans.ingest import ingest
from causalrisk.spec import DatasetSpec

SPEC = DatasetSpec("id", "t", "amount", "y")


def facts(spark, rows):
    return spark.createDataFrame(rows, "id long, y int, t long, amount double")


def test_required_columns(spark):
    with pytest.raises(ct.DataContractError, match="amount"):
        ct.require_columns(spark.range(1), ("id", "amount"))


def test_key_report_counts_duplicates_and_null_keys(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (2,), (None,), (None,)], "id int")
    row = ct.key_report(df, "id").first()
    assert (row.n_rows, row.n_keys, row.duplicates, row.null_keys) == (6, 2, 2, 2)
    assert ct.duplicate_keys(df.dropna(), "id").collect() == [(2, 3)]


@pytest.mark.parametrize("rows, check", [
    ([(1, 0, 5, 1.0), (1, 1, 6, 1.0)], "unique_key"),
    ([(1, None, 5, 1.0), (2, 1, 6, 1.0)], "label_present"),
    ([(1, 2, 5, 1.0), (2, 1, 6, 1.0)], "label_allowed"),
    ([(1, 0, None, 1.0), (2, 1, 6, 1.0)], "time_present"),
    ([(1, 0, -5, 1.0), (2, 1, 6, 1.0)], "time_not_negative"),
    ([(1, 0, 5, 1.0), (2, 0, 6, 1.0)], "positive_rate"),
])
def test_each_violation_is_reported_and_raises(spark, rows, check):
    report = ct.fact_report(facts(spark, rows), "id", "y", "t", expected_rate=0.5, tolerance=0.1)
    bad = {r.check for r in report.collect() if not r.ok}
    assert check in bad
    with pytest.raises(ct.DataContractError, match=check):
        ct.enforce(report)


def test_enrich_keeps_rows_and_marks_matches(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, v string")
    right = spark.createDataFrame([(2, 0.5)], "id long, w double")
    joined = enrich(left, right, "id")
    assert sorted((r.id, r.w, r._matched) for r in joined.collect()) == [(1, None, 0), (2, 0.5, 1), (3, None, 0)]
    assert coverage(joined).first().matched == 1
    assert row_count_change(joined, left).first().ok == 1
    with pytest.raises(ct.DataContractError, match="right: 1 rows"):
        enrich(left, right.union(right), "id")


def test_row_multiplication_is_seen(spark):
    left = spark.createDataFrame([(1,), (2,)], "id long")
    doubled = left.union(left)
    assert row_count_change(doubled, left).first().ok == 0


def test_ingest_end_to_end(spark, tmp_path):
    rows = [(1000 + i, int(i % 10 == 0), 86400 + (i * 7919 % 200) * 60, float(i)) for i in range(200)]
    side = spark.createDataFrame([(1000 + i * 4, "chrome") for i in range(50)], "id long, browser string")
    table, manifest = ingest(facts(spark, rows), side, SPEC, str(tmp_path / "joined"), expected_rate=0.1)
    m = manifest.first()
    assert (m.n_rows, m.positives, m.negatives, m.matched, m.coverage) == (200, 20, 180, 50, 0.25)
    assert m.imbalance_ratio == 9.0
    assert table.count() == 200 and "browser" in table.columns
    side.coalesce(1).write.parquet(str(tmp_path / "side"))
    listed = ingest(facts(spark, rows), side, SPEC, expected_rate=0.1, sources=(str(tmp_path / "side"),))[1].first().inputs
    assert [len(f.sha256) for f in listed] == [64] and listed[0].bytes > 0 and listed[0].path.endswith(".parquet")
    with pytest.raises(ct.DataContractError, match="positive_rate"):
        ingest(facts(spark, rows), side, SPEC, expected_rate=0.5)
    orphan = side.union(spark.createDataFrame([(5, "ie")], side.schema))
    with pytest.raises(ct.DataContractError, match="side rows"):
        ingest(facts(spark, rows), orphan, SPEC)
