"""Readers S1-S6 on the FIXTURES.md micro-fixtures."""
import pytest
from pyspark.sql import functions as F

from tableprep.errors import TablePrepError
from tableprep.operators.order import ROW_ORDER
from tableprep.sources.files import dedupe_header, format_of, read_csv, read_files, read_json, read_xml
from tableprep.sources.xlsx import read_xlsx


def ordered(df, *cols):
    return [tuple(r) for r in df.orderBy(*ROW_ORDER).select(*cols).collect()]


def test_csv_na_types_padding_and_file_order(spark, files):
    df = read_csv(spark, files["people.csv"])
    types = dict(df.dtypes)
    assert types["age"] == "string"          # 'x' and '2.5' keep it text
    assert types["price"] == "double"
    rows = ordered(df, "name", "age", "city", "price")
    assert rows[0] == (" Ann ", "30", "Oslo", 10.5)       # padding kept
    assert rows[1] == ("Bob", None, "\t Rome ", 7.0)      # NA -> null, tab kept
    assert rows[2] == (None, None, None, None)            # ',,,,' row; blank line skipped
    assert [r[0] for r in rows] == [" Ann ", "Bob", None, "Ann ", "Cid", "Dee", "Eve"]
    assert set(df.columns) >= {"source_file", *ROW_ORDER}
    assert df.select("source_file").distinct().collect()[0][0] == "people.csv"


def test_csv_headers_differ_union_by_name(spark, files):
    df = read_csv(spark, [files["people.csv"], files["reordered.csv"], files["extra_col.csv"], files["clash.csv"]])
    got = dict((r["name"], r) for r in df.where(F.col("name").isin("Fay", "Gus", "Hal")).collect())
    assert got["Fay"]["city"] == "Bergen" and got["Fay"]["age"] == "44"      # by name, not by position
    assert got["Gus"]["country"] == "NO" and got["Fay"]["country"] is None
    assert got["Hal"]["age"] == "forty"                                      # widened to text
    # file order spans the request
    firsts = df.groupBy("source_file").agg(F.min("_pos_file").alias("p")).collect()
    assert {r["source_file"]: r["p"] for r in firsts} == {
        "people.csv": 0, "reordered.csv": 1, "extra_col.csv": 2, "clash.csv": 3}


def test_csv_duplicate_headers_and_quotes(spark, files):
    assert dedupe_header(["a", "a", "b", "a"]) == ["a", "a.1", "b", "a.2"]
    df = read_csv(spark, files["dup_header.csv"])
    assert [c for c in df.columns if not c.startswith("_") and c != "source_file"] == ["a", "a.1", "b"]
    q = read_csv(spark, files["quoted.csv"])
    assert ordered(q, "id", "note") == [(1, "a, b"), (2, 'say "hi"'), (3, "two\nlines")]


def test_csv_empty_files_skipped_or_refused(spark, files):
    df = read_csv(spark, [files["empty.csv"], files["people.csv"], files["header_only.csv"]])
    assert df.count() == 7
    with pytest.raises(TablePrepError):
        read_csv(spark, [files["empty.csv"]])


def test_json_array_of_objects(spark, files):
    df = read_json(spark, files["people.json"])
    assert set(["name", "age", "tags", "addr", "z"]) <= set(df.columns)
    rows = ordered(df, "name", "age", "z")
    assert rows == [("Ann", 30, 1), ("Bob", None, None), ("Cid", 41, 3)]
    assert dict(df.dtypes)["tags"].startswith("array")


def test_xml_records(spark, files):
    df = read_xml(spark, files["people.xml"])
    rows = ordered(df, "name", "age", "city")
    assert rows[0] == (" Ann ", "30", "Oslo")        # attribute ignored, padding kept
    assert rows[1] == ("Bob", "22", "Rome")          # repeated tag: last wins
    assert "id" not in df.columns and "_id" not in df.columns
    with pytest.raises(TablePrepError):
        read_xml(spark, files["no_records.xml"])


def test_format_dispatch(files):
    assert format_of(files["A.CSV"]) == "csv"
    with pytest.raises(TablePrepError):
        format_of("foocsv")
    with pytest.raises(TablePrepError):
        format_of("old.xls")


def test_xlsx_workbook(spark, files):
    book = read_xlsx(spark, files["book.xlsx"])
    sheets = sorted(r[0] for r in book.select("sheet").distinct().collect())
    assert sheets == ["Data1", "Data2", "Notes"]                 # Empty sheet has no rows
    d1 = [tuple(r) for r in book.where("sheet = 'Data1'").orderBy("row_pos")
          .select("row_pos", "name", "age", "joined").collect()]
    assert d1[0] == (0, "Ann", 30.0, "2024-01-05 00:00:00")   # serial 45292 is 2024-01-01
    assert d1[1] == (1, "Bob", None, "2024-01-06 12:00:00")
    assert d1[2] == (2, None, None, None)                        # a row missing from the part
    assert d1[3] == (3, "Cid", 41.0, None)                       # inline string, missing cell
    notes = book.where("sheet = 'Notes'").orderBy("row_pos").select("note", "flag").collect()
    assert [tuple(r) for r in notes] == [("hello", True), (None, False)]
    assert dict(book.dtypes)["sheet_pos"] == "int"


def test_read_files_mixed_formats(spark, files):
    df = read_files(spark, [files["people.csv"], files["people.json"], files["people.xml"]], lower_names=True)
    by_src = dict((r[0], r[1]) for r in df.groupBy("source_file").count().collect())
    assert by_src == {"people.csv": 7, "people.json": 3, "people.xml": 3}
    pos = dict((r[0], r[1]) for r in df.groupBy("source_file").agg(F.min("_pos_file")).collect())
    assert pos == {"people.csv": 0, "people.json": 1, "people.xml": 2}


def test_csv_same_header_mode(spark, files, tmp_path):
    same = tmp_path / "people2.csv"
    same.write_text(open(files["people.csv"]).read())
    df = read_csv(spark, [files["people.csv"], str(same)], headers="same")
    assert df.count() == 14
    with pytest.raises(Exception, match="does not conform"):   # Spark's header check, no silent shift
        read_csv(spark, [files["people.csv"], files["reordered.csv"]], headers="same").collect()
