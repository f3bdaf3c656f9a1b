"""Sheets (H1-H7), validation (V1-V7), sinks and batch plans (K1-K8)."""
import glob
import os

import pytest
from fixtures import write_book
from pyspark.sql import functions as F

from tableprep.errors import TablePrepError
from tableprep.operators import sheets as H
from tableprep.operators import validate as V
from tableprep.plans.batch import batch_clean, batch_convert, convert
from tableprep.sinks.writers import write, write_parts
from tableprep.sources.files import read_csv, read_json, read_xml
from tableprep.sources.xlsx import read_xlsx


@pytest.fixture(scope="module")
def book(spark, files):
    return read_xlsx(spark, files["book.xlsx"])


def sheet_rows(df):
    return sorted((r["sheet"], r["sheet_pos"], r["row_pos"]) for r in df.select("sheet", "sheet_pos", "row_pos").collect())


def test_sheet_ops(book):
    comb = H.combine(book, "All")
    assert sorted(r[0] for r in comb.select("row_pos").collect()) == list(range(book.count()))
    split = H.split_to_sheets(book, 2)
    assert sorted({r[0] for r in split.select("sheet").collect()}) == ["Sheet_1", "Sheet_2", "Sheet_3", "Sheet_4"]
    ren = H.rename(book, ["A", "B", "C"])
    assert {r[0]: r[1] for r in ren.select("sheet", "sheet_pos").distinct().collect()} == {"A": 0, "B": 1, "C": 2}
    with pytest.raises(TablePrepError):
        H.rename(book, ["A", "B"])
    with pytest.raises(TablePrepError):
        H.rename(book, ["A", "A", "C"])
    with pytest.raises(TablePrepError):
        H.rename(book, ["A", "B", "x" * 32])
    reo = H.reorder(book, ["Notes", "0", "Data2"])
    assert {r[0]: r[1] for r in reo.select("sheet", "sheet_pos").distinct().collect()} == {
        "Notes": 0, "Data1": 1, "Data2": 2}
    with pytest.raises(TablePrepError):
        H.reorder(book, ["Notes", "Notes", "Data2"])
    ext = H.extract_sheets(book, ["Notes", "1"])
    assert {r[0]: r[1] for r in ext.select("sheet", "sheet_pos").distinct().collect()} == {"Notes": 0, "Sheet_1": 1}
    cp = H.copy(book.where("sheet = 'Notes'"), book.where("sheet != 'Notes'"), ["Notes"])
    assert {r[0]: r[1] for r in cp.select("sheet", "sheet_pos").distinct().collect()} == {
        "Data1": 0, "Data2": 1, "Notes": 2}
    with pytest.raises(TablePrepError):
        H.copy(book, book, ["Notes"])
    assert H.first_sheet(book).select("sheet").distinct().collect()[0][0] == "Data1"
    meta = {r["sheet"]: r["row_count"] for r in H.sheet_metadata(book).collect()}
    assert meta == {"Data1": 4, "Data2": 1, "Notes": 2}


def test_schema_sets(spark, book, files):
    sig = V.column_sets_by_group(book.drop("sheet_pos", "row_pos"), "sheet").collect()
    assert {r["sheet"]: r["columns"] for r in sig}["Notes"] == ["flag", "note"]
    assert all(not r["consistent"] for r in sig)
    a = read_csv(spark, files["people.csv"])
    b = read_csv(spark, files["reordered.csv"])
    c = read_csv(spark, files["extra_col.csv"])
    assert V.schema_sets_consistent([a, b])
    assert not V.schema_sets_consistent([a, c])


def test_format_checks(spark, files):
    js = V.validate_json_files(spark, [files["people.json"], files["not_array.json"],
                                       files["mixed_array.json"], files["broken.json"]])
    got = {os.path.basename(r["path"]): (r["is_json"], r["valid"]) for r in js.collect()}
    assert got == {"people.json": (True, True), "not_array.json": (True, False),
                   "mixed_array.json": (True, False), "broken.json": (False, False)}
    cs = V.validate_csv_files(spark, [files["people.csv"], files["one_column.csv"], files["blank.csv"]])
    got = {os.path.basename(r["path"]): r["valid"] for r in cs.collect()}
    assert got == {"people.csv": True, "one_column.csv": False, "blank.csv": False}
    empty = [os.path.basename(r[0]) for r in V.empty_inputs(spark, [files["empty.csv"], files["people.csv"]]).collect()]
    assert empty == ["empty.csv"]


def test_rename_manifest(spark):
    files = spark.createDataFrame([(0, "a.csv"), (1, "b c.csv"), (2, "a.csv"), (3, "README")], "id long, name string")
    m = {r["id"]: (r["new_name"], r["valid"], r["same_name"]) for r in
         V.rename_manifest(files, "name", "data_{index}_{filename}", ["id"]).collect()}
    assert m[0] == ("data_0_a.csv", True, 1)
    assert m[1] == ("data_1_b c.csv", False, 1)
    assert m[3] == ("data_3_README", True, 1)
    dup = V.rename_manifest(files, "name", "{filename}", ["id"]).where("same_name > 1").count()
    assert dup == 2


def test_csv_round_trip_keeps_padding_and_order(spark, files, outdir):
    df = read_csv(spark, [files["people.csv"], files["quoted.csv"]])
    write(df, outdir + "/csv", "csv")
    back = read_csv(spark, sorted(glob.glob(outdir + "/csv/*.csv")))
    cols = [c for c in df.columns if not c.startswith("_") and c != "source_file"]
    a = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    b = sorted((tuple(r) for r in back.select(*cols).collect()), key=repr)
    assert a == b


def test_json_xml_parts_and_batches(spark, files, outdir):
    df = read_csv(spark, files["people.csv"])
    write(df, outdir + "/j", "json")
    assert read_json(spark, glob.glob(outdir + "/j/*.json"), lines=True).count() == 7
    write(df, outdir + "/x", "xml", compression="gzip")
    assert glob.glob(outdir + "/x/*.xml.gz")
    write_parts(df, outdir + "/p", "csv", 3, None)
    parts = sorted(os.path.basename(p) for p in glob.glob(outdir + "/p/part=*"))
    assert parts == ["part=1", "part=2", "part=3"]
    batch_convert(spark, [files["people.csv"], files["reordered.csv"]], outdir + "/bc", "csv", "json")
    assert sorted(os.path.basename(p) for p in glob.glob(outdir + "/bc/file_pos=*")) == ["file_pos=0", "file_pos=1"]
    cleaned = batch_clean(spark, [files["people.csv"], files["A.CSV"]],
                          {"remove_duplicates": True, "remove_empty_rows": True}, outdir + "/bk")
    assert cleaned.count() == 12          # duplicates judged per file: each file keeps its 6 rows
    convert(spark, files["people.xml"], outdir + "/cv", "xml", "csv")
    assert read_csv(spark, glob.glob(outdir + "/cv/*.csv")).count() == 3
    with pytest.raises(TablePrepError):
        convert(spark, files["people.xml"], outdir + "/cv2", "csv", "json")
    with pytest.raises(TablePrepError):
        write(df.withColumnRenamed("name", "first name"), outdir + "/bad", "xml")
    x = read_xml(spark, files["people.xml"])
    write(x, outdir + "/xx", "xml")
    assert read_xml(spark, glob.glob(outdir + "/xx/*.xml")).count() == 3
    book = read_xlsx(spark, files["book.xlsx"])
    write(book.withColumn("sheet_pos", F.col("sheet_pos")), outdir + "/bk2", "parquet", partition_by="sheet")
    assert sorted(os.path.basename(p) for p in glob.glob(outdir + "/bk2/sheet=*")) == [
        "sheet=Data1", "sheet=Data2", "sheet=Notes"]


def test_merge_json_keep_case_and_absent_keys(spark, outdir):
    import json as _json
    import os as _os
    from tableprep.operators.merge import merge

    a = _os.path.join(outdir, "a.json")
    b = _os.path.join(outdir, "b.json")
    with open(a, "w") as f:
        _json.dump([{"Name": "Ann", "Age": 30}], f)
    with open(b, "w") as f:
        _json.dump([{"Name": "Bob", "City": "Rome"}], f)
    merged = merge([read_json(spark, a), read_json(spark, b)], lower=False)
    assert {"Name", "Age", "City", "source_file"} <= set(merged.columns)      # case kept
    write(merged.drop("source_file"), outdir + "/mj", "json", keep_absent_keys=True)
    lines = [_json.loads(x) for p in glob.glob(outdir + "/mj/*.json") for x in open(p)]
    bob = [x for x in lines if x["Name"] == "Bob"][0]
    assert "Age" not in bob and bob["City"] == "Rome"                          # absent key stays absent
    lowered = merge([read_json(spark, a)], lower=True)
    assert "name" in lowered.columns


def test_check_inputs_flags(spark, files):
    V.check_inputs(spark, [files["people.csv"], files["people.json"]])
    with pytest.raises(TablePrepError) as e:
        V.check_inputs(spark, [files["people.csv"], files["one_column.csv"], files["empty.csv"],
                               files["mixed_array.json"]])
    msg = str(e.value)
    assert "one_column.csv is not a valid CSV" in msg and "empty.csv is empty" in msg
    assert "mixed_array.json must contain an array of objects" in msg


def test_sheets_are_units_of_work(spark, files, tmp_path):
    from tableprep.sources.xlsx import read_cells, read_sheets, read_xlsx

    book = {f"s{i}": [["a", "b"], *[[j, "x" * 50] for j in range(400)]] for i in range(6)}
    path = write_book(str(tmp_path / "many.xlsx"), book)
    packed = read_sheets(spark, path).collect()
    assert [(r.sheet, r.sheet_pos) for r in packed] == [(f"s{i}", i) for i in range(6)]
    assert all(len(r.part) < 0.2 * 400 * 90 for r in packed)  # still deflated
    cells = read_cells(spark, path).where("row_pos >= 0")
    tasks = cells.groupBy(F.spark_partition_id()).agg(F.countDistinct("sheet")).collect()
    assert len(tasks) > 2
    some = read_xlsx(spark, [path, files["book.xlsx"]], sheets=["s4", "Data1"])
    assert {tuple(r) for r in some.select("source_file", "sheet").distinct().collect()} == {("many.xlsx", "s4"), ("book.xlsx", "Data1")}
    assert some.where("sheet = 's4'").orderBy("row_pos").select("a").collect() == [(j,) for j in range(400)]


def test_many_small_workbooks(spark, tmp_path, monkeypatch):
    from tableprep.sources import xlsx

    for i in range(60):
        write_book(str(tmp_path / f"w{i:02}.xlsx"), {"only": [["n", "extra" if i % 2 else "other"], [i, i * i]], "none": []})
    monkeypatch.setattr(xlsx, "MAX_SHEETS", 20)  # a bound of one workbook, not of the request
    got = xlsx.read_xlsx(spark, str(tmp_path)).orderBy("_pos_file").select("n", "extra", "other", "_pos_file").collect()
    assert [tuple(r) for r in got] == [(i, i * i if i % 2 else None, None if i % 2 else i * i, i) for i in range(60)]
    monkeypatch.setattr(xlsx, "MAX_HEADERS", 1)
    with pytest.raises(TablePrepError):
        xlsx.read_xlsx(spark, str(tmp_path))


def test_parts_are_read_as_streams(spark, tmp_path):
    import tracemalloc
    import zipfile

    from tableprep.sources import xlsx

    path = write_book(str(tmp_path / "tall.xlsx"), {"s": [["a"], *[[float(j)] for j in range(60_000)]]})
    with zipfile.ZipFile(path) as z:
        size = z.getinfo("xl/worksheets/sheet1.xml").file_size
    (_, _, part, strings, styles, date1904), = xlsx.cut_workbook(open(path, "rb").read())
    tracemalloc.start()
    n = sum(len(cells) for _, cells in xlsx.sheet_rows(part, strings, styles, date1904))
    assert n == 60_001 and tracemalloc.get_traced_memory()[1] < 6e6 and size > 1.5e6
    tracemalloc.stop()
    stored = bytes([zipfile.ZIP_STORED]) + b"".join(xlsx._stream(part))
    assert list(xlsx.sheet_rows(stored, strings, styles, date1904)) == list(xlsx.sheet_rows(part, strings, styles, date1904))


def test_named_parts_of_files(spark, tmp_path):
    import csv
    import json

    from tableprep.plans.batch import split_files
    from tableprep.sinks.named import leftovers

    for name, n in (("b", 25), ("a", 7)):
        (tmp_path / f"{name}.csv").write_text(f"v,{name}\n" + "".join(f'{i},"{name}\n{i}"\n' for i in range(n)))
    out = str(tmp_path / "out")
    paths = [str(tmp_path / f) for f in ("b.csv", "a.csv")]
    names = split_files(spark, paths, out, 10)
    want = {"split_b.csv_part_1.csv": range(10), "split_b.csv_part_2.csv": range(10, 20), "split_b.csv_part_3.csv": range(20, 25), "split_a.csv_part_1.csv": range(7)}
    assert names == sorted(want) == sorted(f for f in os.listdir(out) if not f.startswith(".")) and leftovers(spark, out) == []
    for name, values in want.items():
        kind = name[6]
        with open(f"{out}/{name}", newline="") as f:
            assert list(csv.reader(f)) == [["v", kind], *[[str(i), f"{kind}\n{i}"] for i in values]]
    with pytest.raises(TablePrepError, match="already there"):
        split_files(spark, paths, out, 10)
    assert split_files(spark, paths, out, 10, overwrite=True) == names and leftovers(spark, out) == []
    (tmp_path / "x.json").write_text(json.dumps([{"k": i} for i in range(5)]))
    split_files(spark, [str(tmp_path / "x.json")], out, 3)
    assert [json.loads(x)["k"] for x in open(f"{out}/split_x.json_part_2.json")] == [3, 4]
    with pytest.raises(TablePrepError):
        split_files(spark, [paths[0], paths[0]], out, 3)


def test_a_failed_write_publishes_nothing(spark, tmp_path):
    from tableprep.sinks.named import NamedOutput, leftovers

    out = str(tmp_path / "out")
    rows = spark.range(40).select("id", (F.col("id") % 4).alias("part"))
    broken = rows.withColumn("id", F.when(F.col("id") < 39, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("long")))
    with pytest.raises(Exception, match="lost"):
        with NamedOutput(spark, out) as named:
            named.add(broken, "csv", ["part"], ["id"], lambda part: f"p{part}")
            named.publish()
    assert leftovers(spark, out) == [] and glob.glob(out + "/*") == []
    with NamedOutput(spark, out) as named:
        named.add(rows, "json", ["part"], ["id"], lambda part: f"p{part}", compression="gzip")
        assert leftovers(spark, out) and not os.path.exists(out + "/p0.json.gz")  # nothing before it is whole
        assert named.publish() == [f"p{i}.json.gz" for i in range(4)]
    assert [r.id for r in spark.read.json(out + "/p3.json.gz").collect()] == list(range(3, 40, 4))
    with pytest.raises(TablePrepError, match="two files"):
        with NamedOutput(spark, out) as named:
            named.add(rows, "csv", ["part"], ["id"], lambda part: "same")
            named.publish()


def test_named_batches(spark, files, tmp_path):
    out = str(tmp_path / "out")
    batch_convert(spark, [files["people.csv"], files["clash.csv"]], out, "csv", "json", named=True)
    assert sorted(f for f in os.listdir(out) if f.endswith(".json")) == ["converted_0.json", "converted_1.json"]
    assert spark.read.json(out + "/converted_1.json").columns == ["age", "name"]
    batch_clean(spark, [files["people.csv"], files["clash.csv"]], {"trim_whitespace": True}, out, named=True)
    assert open(out + "/cleaned_1.csv").read() == "name,age\nHal,forty\n"
    assert open(out + "/cleaned_0.csv").read().splitlines()[1].startswith("Ann,30,Oslo")
