import pytest
from pyspark.errors import AnalysisException

from labelloom.operators.profile import column_profile, schema_diff, table_diff
from labelloom.plans import checks
from labelloom.plans.invoices import invoices, rejects
from labelloom.session import shared_folder, stage
from labelloom.sources import tables
from labelloom.sources.inventory import folder_listing


def test_invoices(spark):
    df = spark.createDataFrame([
        (1, 100.0, 0.0), (2, 100.0, 10.0), (3, 80.0, 100.0), (4, 19.99, None), (5, 0.0, 1.0),
        (6, -5.0, 1.0), (7, 10.0, 101.0), (8, None, 1.0), (9, 10.0, -1.0), (10, float("nan"), 1.0),
        (11, 10.0, float("nan")), (12, 2.675, 0.0),
    ], "id int, subtotal double, discount_percent double")
    good = {r.id: tuple(r)[1:] for r in invoices(df).collect()}
    assert good == {1: (100.0, 0.0, 0.0, 100.0), 2: (100.0, 10.0, 10.0, 90.0),
                    3: (80.0, 100.0, 80.0, 0.0), 4: (19.99, 0.0, 0.0, 19.99),
                    12: (2.67, 0.0, 0.0, 2.67)}
    bad = {r.id: r.reject_reason for r in rejects(df).collect()}
    assert bad == {5: "subtotal not positive", 6: "subtotal not positive",
                   7: "discount outside 0 to 100", 8: "subtotal missing",
                   9: "discount outside 0 to 100", 10: "subtotal missing",
                   11: "discount outside 0 to 100"}


def test_column_profile(spark):
    df = spark.createDataFrame([("x" * 100, ["a"], 1), ("x" * 100, ["a"], None), (None, None, 2)],
                               "t string, l array<string>, n int")
    got = {r.column_name: tuple(r)[1:] for r in column_profile(df).collect()}
    assert got == {"t": (3, 1, 1, 1), "l": (3, 1, 1, 1), "n": (3, 1, 2, 0)}


def test_schema_and_table_diff(spark):
    left = spark.createDataFrame([(1, "a", None)], "k int, v string, l string")
    right = spark.createDataFrame([(1, 2, "r")], "k int, v int, r string")
    got = {r.column_name: r.status for r in schema_diff(left, right).collect()}
    assert got == {"k": "same", "v": "changed", "l": "only left", "r": "only right"}
    nulls = {r.column_name: (r.left_nulls, r.right_nulls) for r in table_diff(left, right).collect()}
    assert nulls == {"k": (0, 0), "v": (0, 0), "l": (1, None), "r": (None, 0)}


def test_overwrite_replaces_rows_and_schema(spark):
    assert tables.overwrite_table(spark.range(5), "kept") == 5
    assert tables.overwrite_table(spark.range(3).selectExpr("id", "id * 2 AS twice"), "kept") == 3
    assert tables.stored_rows(spark, "kept") == 3
    assert tables.table(spark, "kept").columns == ["id", "twice"]
    view = tables.named_view(tables.table(spark, "kept"), "kept_view")
    assert spark.table("kept_view").count() == view.count() == 3


def test_stage_uses_the_named_folder(spark):
    staged = stage(spark.range(10), "numbers")
    assert staged.count() == 10
    assert all(shared_folder(spark) in f for f in staged.inputFiles())


def test_folder_listing(spark, tmp_path):
    for name in ("b.PDF", "a.pdf", "c.txt", "d.pdfx"):
        (tmp_path / name).write_bytes(b"x" * (3 if name == "a.pdf" else 5))
    listing = folder_listing(spark, str(tmp_path))
    got = [(r.path.rsplit("/", 1)[1], r.bytes) for r in listing.collect()]
    assert got == [("a.pdf", 3), ("b.PDF", 5)]


def test_missing_table_raises(spark):
    with pytest.raises(AnalysisException):
        tables.table(spark, "no_such_table").count()


def test_repeated_documents_and_leakage(spark):
    rows = [("1", "t", "Law", "f1", "about law"), ("1", "t", "Tax", "f1", "about law"),
            ("2", "t", "Law", "f1", "x"), ("2", "t", "Law", "f2", "x"), ("3", "t", "Law", "f1", "y")]
    df = spark.createDataFrame(rows, "source_id string, title string, label string, "
                                     "filename string, feature_text string")
    got = [(r.source_id, r.labels, r.row_count, r.label_count)
           for r in checks.repeated_documents(df).collect()]
    assert got == [("1", ["Law", "Tax"], 2, 2), ("2", ["Law"], 2, 1)]
    flags = {r.label: (r.n, r.with_label_in_text) for r in checks.leakage_flags(df).collect()}
    assert flags == {"Law": (4, 1), "Tax": (1, 0)}


def test_profile_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    rows = {r.column_name: tuple(r)[1:] for r in column_profile(empty).collect()}
    assert rows == {"a": (0, 0, 0, 0), "b": (0, 0, 0, 0)}
