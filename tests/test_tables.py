"""Typed tables keep their schema through a write and a read."""

from gleaner.sources import tables


def test_round_trip_and_enumerations(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, "u", "5", "completed"), (2, 2, "u", None, "lost")], tables.schema_of("user_submissions"))
    tables.write_table(rows, str(tmp_path / "user_submissions"), partition_by=["status"])
    read = tables.read_tables(spark, str(tmp_path), ["user_submissions"])["user_submissions"]
    assert sorted(read.columns) == sorted(rows.columns) and read.count() == 2
    assert [r["submission_id"] for r in tables.valid_rows(read, "user_submissions").collect()] == [1]
