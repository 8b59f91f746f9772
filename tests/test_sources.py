import pytest
from pyspark.sql import functions as F

from causalrisk.operators.enrich import file_fingerprints, table_fingerprint
from causalrisk.sources import canonical_names, low_cardinality_columns, read_csv, read_markdown, split_column_types
from causalrisk.sources.files import propose_schema
from causalrisk.sources.sinks import write_fact, write_report, write_section


def test_only_hyphenated_names_change():
    assert canonical_names(["id-01", "id_02", "a-b-c"]) == {"id-01": "id_01", "a-b-c": "a_b_c"}


def test_csv_keeps_exact_columns_and_turns_nan_into_null(spark, tmp_path):
    path = tmp_path / "side.csv"
    path.write_text("TransactionID,id-01,amount\n1,2.5,10.55\n2,NaN,3.25\n3,,7\n")
    schema = propose_schema(spark, str(path), exact=("TransactionID", "amount"), sampling_ratio=1.0)
    kinds = {f.name: f.dataType.typeName() for f in schema.fields}
    assert kinds == {"TransactionID": "integer", "id-01": "float", "amount": "double"}
    df = read_csv(spark, str(path), schema)
    assert df.columns == ["TransactionID", "id_01", "amount"]
    assert [r.id_01 for r in df.orderBy("TransactionID").collect()] == [2.5, None, None]


def test_malformed_csv_and_absent_file_are_errors(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("a,b\n1,2\nx,3\n")
    with pytest.raises(Exception):
        read_csv(spark, str(path), "a int, b int").collect()
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_csv(spark, str(tmp_path / "none.csv"), "a int").collect()


def test_low_cardinality_and_column_types(spark):
    df = spark.createDataFrame([("a", "u1", 1), ("a", "u2", 2), (None, "u3", 3), ("b", "u4", 4)], "kind string, name string, n int")
    found = {r["column"]: r.categorical for r in low_cardinality_columns(df).collect()}
    assert found == {"kind": 1, "name": 0}
    assert split_column_types(df, ["n", "kind", "absent"]) == {"numeric": ["n"], "categorical": ["kind"]}


def test_markdown_corpus(spark, tmp_path):
    (tmp_path / "one.md").write_text("# First title\n\nBody text.\n")
    (tmp_path / "two.md").write_text("##  Second\nMore.")
    (tmp_path / "skip.txt").write_text("# Not this")
    rows = {r.source: (r.title, r.text) for r in read_markdown(spark, str(tmp_path)).collect()}
    assert rows == {"one.md": ("First title", "# First title\n\nBody text.\n"), "two.md": ("Second", "##  Second\nMore.")}


def test_fact_files_cover_disjoint_time_ranges(spark, tmp_path):
    path = str(tmp_path / "fact")
    write_fact(spark.range(1000).select(F.col("id"), (F.col("id") * 7919 % 1000).alias("t")), path, "t", "id", 4)
    files = spark.read.parquet(path).groupBy(F.input_file_name()).agg(F.min("t").alias("a"), F.max("t").alias("b"))
    ranges = sorted((r.a, r.b) for r in files.collect())
    assert len(ranges) > 1
    assert all(x[1] < y[0] for x, y in zip(ranges, ranges[1:]))
    assert spark.read.parquet(path).count() == 1000


def test_section_write_keeps_other_sections(spark, tmp_path):
    path = str(tmp_path / "results")
    write_section(spark.createDataFrame([("a", 1), ("b", 2)], "section string, v int"), path)
    write_section(spark.createDataFrame([("b", 3)], "section string, v int"), path)
    assert sorted((r.section, r.v) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 3)]


@pytest.mark.parametrize("fmt", ["parquet", "json", "csv"])
def test_report_formats(spark, tmp_path, fmt):
    write_report(spark.range(3), str(tmp_path), "r", fmt)
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / "r"))
    assert back.count() == 3


def test_fingerprints(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes(b"abc")
    assert file_fingerprints(spark, str(path)).first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"
    df = spark.range(100)
    same = table_fingerprint(df.orderBy(F.rand(1)).repartition(7)).first()
    assert table_fingerprint(df).first() == same
    assert table_fingerprint(df.filter("id <> 5")).first() != same


def test_stored_tables_go_with_their_block_or_on_release(spark, tmp_path):
    import os

    from causalrisk import materialise, release, scratch
    from causalrisk.session import shared_folder

    release(spark)
    folder = shared_folder(spark).removeprefix("file://")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    with scratch(spark) as keep:
        inner = materialise(spark.range(3), "inner")
        kept = keep(inner.selectExpr("id + 1 as id"), "kept")
    assert {n.split("-")[0] for n in set(os.listdir(folder)) - before} == {"kept"}
    assert kept.count() == 3
    release(spark)
    assert set(os.listdir(folder)) == before
