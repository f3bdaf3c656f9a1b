"""K6 with V1-V4 inside: one read of the input, the files that ``check_inputs`` names, rows set aside."""
import glob
import json
import os
import re
import subprocess
import sys

import pytest

from tableprep.errors import TablePrepError
from tableprep.operators import validate as V
from tableprep.plans import checked
from tableprep.plans.batch import convert
from tableprep.plans.checked import convert_checked

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def rows_of(spark, path):
    return sorted((tuple(sorted(r.asDict().items())) for r in spark.read.parquet(path).collect()), key=str)


@pytest.mark.parametrize("names", [["people.csv"], ["people.csv", "reordered.csv", "extra_col.csv"], ["quoted.csv"],
                                   ["people.csv", "quoted.csv", "people.csv"], ["dup_header.csv", "headers.csv"], ["clash.csv", "people.csv"]])
def test_same_rows_as_convert(spark, files, outdir, names):
    paths = [files[n] for n in names]
    report = convert_checked(spark, paths, f"{outdir}/a", "csv", "parquet")
    convert(spark, paths, f"{outdir}/b", "csv", "parquet")
    assert rows_of(spark, f"{outdir}/a") == rows_of(spark, f"{outdir}/b")
    assert dict(spark.read.parquet(f"{outdir}/a").dtypes) == dict(spark.read.parquet(f"{outdir}/b").dtypes)
    assert report.rows == spark.read.parquet(f"{outdir}/a").count() and not report.refused and not report.rejected


@pytest.mark.parametrize("whole", [checked.WHOLE_JSON, 0])
def test_json_as_convert(spark, files, outdir, whole, monkeypatch):
    monkeypatch.setattr(checked, "WHOLE_JSON", whole)
    convert_checked(spark, [files["people.json"]], f"{outdir}/a", "json", "parquet")
    convert(spark, [files["people.json"]], f"{outdir}/b", "json", "parquet")
    assert rows_of(spark, f"{outdir}/a") == rows_of(spark, f"{outdir}/b")


@pytest.mark.parametrize("fmt,names", [
    ("csv", ["people.csv", "one_column.csv", "empty.csv", "blank.csv"]), ("json", ["people.json", "not_array.json", "mixed_array.json", "broken.json"])])
def test_refuses_the_files_that_check_inputs_names(spark, files, outdir, fmt, names):
    paths = [files[n] for n in names]
    with pytest.raises(TablePrepError) as a:
        V.check_inputs(spark, paths)
    with pytest.raises(TablePrepError) as b:
        convert_checked(spark, paths, f"{outdir}/out", fmt, "parquet")

    def said(e):
        return sorted(re.sub(r"^\S*/", "", x) for x in str(e.value).split("; "))

    assert said(a) == said(b) and len(said(a)) == len(names) - 1
    assert not os.path.exists(f"{outdir}/out")
    report = convert_checked(spark, paths, f"{outdir}/out", fmt, "parquet", rejects=f"{outdir}/rej")
    assert {p.rpartition("/")[2] for p in report.refused} == set(names[1:])
    convert(spark, paths[:1], f"{outdir}/only", fmt, "parquet")
    assert rows_of(spark, f"{outdir}/out") == rows_of(spark, f"{outdir}/only")
    assert sorted(r.source_file for r in spark.read.parquet(f"{outdir}/rej").collect()) == sorted(names[1:])


def test_long_rows_are_set_aside_and_headers_that_come_again_are_rows(spark, tmp_path, outdir):
    p = tmp_path / "x.csv"
    p.write_text("\n \na,b\n1,2\n1,2,3\na,b\n\n4,\n5,6,\n7\n")
    with pytest.raises(TablePrepError, match="more than 2 fields in x.csv"):
        convert_checked(spark, str(p), f"{outdir}/o", "csv", "json")
    report = convert_checked(spark, str(p), f"{outdir}/o", "csv", "json", rejects=f"{outdir}/r")
    got = [json.loads(x) for f in glob.glob(f"{outdir}/o/*.json") for x in open(f)]
    assert sorted(((r["a"], r["b"]) for r in got), key=str) == sorted([("1", "2"), ("a", "b"), ("4", None), ("5", "6"), ("7", None)], key=str)
    assert report.rows == 5 and report.rejected == 1
    (row,) = spark.read.parquet(f"{outdir}/r").collect()
    assert row.text == "1,2,3" and row.reason == "a row has more than 2 fields" and row.source_file == "x.csv"


def test_columns_of_files_with_rows_agree(spark, files, tmp_path, outdir):
    ok = [files["people.csv"], files["reordered.csv"], files["header_only.csv"]]
    convert_checked(spark, ok, f"{outdir}/a", "csv", "parquet", same_columns=True)
    for fmt, bad in (("csv", [files["people.csv"], files["extra_col.csv"]]), ("json", [files["people.json"], str(tmp_path / "o.json")])):
        (tmp_path / "o.json").write_text('[{"other": 1}]')
        with pytest.raises(TablePrepError, match="same columns"):
            convert_checked(spark, bad, f"{outdir}/b", fmt, "parquet", same_columns=True)


def test_bytes_that_are_no_utf8_and_many_files(spark, tmp_path, outdir, monkeypatch):
    monkeypatch.setattr(checked, "BITMAP", 8)  # several bitmaps
    paths = []
    for i in range(21):
        paths.append(str(tmp_path / f"f{i:02}.csv"))
        with open(paths[-1], "wb") as f:
            f.write(b"a,b\n%d,\xff\n" % i if i in (7, 8, 20) else b"a,b\n%d,x\n" % i)
    report = convert_checked(spark, paths, f"{outdir}/o", "csv", "parquet", rejects=f"{outdir}/r")
    assert {p.rpartition("/")[2] for p in report.refused} == {"f07.csv", "f08.csv", "f20.csv"}
    assert sorted(r.a for r in spark.read.parquet(f"{outdir}/o").collect()) == [i for i in range(21) if i not in (7, 8, 20)]


SCRIPT = """
import sys
from pyspark.sql import SparkSession
from tableprep.plans.checked import convert_checked
s = (SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.eventLog.enabled", "true")
     .config("spark.eventLog.dir", sys.argv[1]).config("spark.eventLog.compress", "false").config("spark.checkpoint.dir", sys.argv[1] + "/ckpt").getOrCreate())
convert_checked(s, sys.argv[2], sys.argv[3], "csv", "parquet", rejects=sys.argv[3] + "-rejects", same_columns=True)
s.stop()
"""


def test_event_log_shows_one_read(tmp_path):
    data, log = tmp_path / "in", tmp_path / "log"
    data.mkdir(), log.mkdir()
    for k in range(3):
        (data / f"p{k}.csv").write_text("a,b\n" + "".join(f"{i},{'x' * 50}\n" for i in range(2000)))
    subprocess.run([sys.executable, "-c", SCRIPT, str(log), str(data), str(tmp_path / "out")], check=True, timeout=300,
                   env=os.environ | {"PYTHONPATH": ROOT})
    text_scans = []
    events = [f for f in glob.glob(f"{log}/**/*", recursive=True) if os.path.isfile(f) and "/ckpt/" not in f and ".crc" not in f and "appstatus" not in f]
    for name in events:
        for line in open(name, errors="ignore"):
            event = json.loads(line)
            if event["Event"].endswith("SQLExecutionStart") and "/in/" in event["physicalPlanDescription"]:
                text_scans.append("CollectLimit" in event["physicalPlanDescription"])
    assert text_scans.count(False) == 1 and text_scans.count(True) == 3  # the job, and the first lines
