"""Readers and sheet operations keep every row, or say so; numbers, dates and names as pandas reads them."""
import datetime as dt
import glob
import json
import os

import pandas as pd
import pytest
from fixtures import write_book
from pyspark.sql import functions as F

from tableprep.errors import TablePrepError
from tableprep.functions import predicates as P
from tableprep.functions.predicates import c, where
from tableprep.operators import clean as C
from tableprep.operators import sheets as H
from tableprep.operators import validate as V
from tableprep.operators.merge import union_by_name
from tableprep.operators.order import slice_rows
from tableprep.plans.batch import batch_clean, batch_convert, convert
from tableprep.sources.files import list_files, read_csv, read_json, read_xml
from tableprep.sources.xlsx import read_xlsx, sheet_names


@pytest.fixture()
def put(outdir):
    def _put(name, text, encoding="utf-8"):
        path = os.path.join(outdir, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding=encoding) as f:
            f.write(text)
        return path
    return _put


# ------------------------------------------------------------------ paths
def test_paths_of_all_kinds(spark, put, outdir):
    put("d/a b.csv", "x,y\n1,2\n3,4\n")
    put("d/é.csv", "x,y\n5,6\n7,8\n")
    d = f"{outdir}/d"
    for request in ([f"{d}/a b.csv", f"{d}/é.csv"], [d], [f"{d}/*.csv"], [f"file://{d}/*.csv"], f"file:{d}"):
        got = read_csv(spark, request)
        assert sorted(r.x for r in got.collect()) == [1, 3, 5, 7], request
        assert {r.source_file: r._pos_file for r in got.collect()} == {"a b.csv": 0, "é.csv": 1}
    twice = read_csv(spark, [f"{d}/a b.csv", f"{d}/a b.csv"]).collect()
    assert sorted((r.x, r._pos_file) for r in twice) == [(1, 0), (1, 1), (3, 0), (3, 1)]
    put("j/p q.json", json.dumps([{"a": 1}, {"a": 2}]))
    assert read_json(spark, f"{outdir}/j").count() == 2
    with pytest.raises(TablePrepError):
        list_files(spark, f"{d}/none.csv")


# ------------------------------------------------------------------ broken input
def test_broken_json_raises(spark, put):
    good = put("good.json", '[{"a": 1}, {"a": 2}]')
    for name, text in (("cut.json", '[{"a": 1}, {"a": '), ("object.json", '{"a": 1}'), ("mixed.json", '[{"a": 1}, 2]')):
        with pytest.raises(Exception):
            read_json(spark, [good, put(name, text)]).collect()
    kept = read_json(spark, [good, put("cut.json", '[{"a": 1}, {"a": ')], rejects="keep")
    assert sum(r["_corrupt_record"] is not None for r in kept.collect()) == 1
    case = put("case.json", '[{"Name": 1, "name": 2}]')
    with pytest.raises(TablePrepError):
        read_json(spark, case)


def test_rows_longer_than_the_header_raise(spark, put):
    short = read_csv(spark, put("short.csv", "a,b\n1\n2,3\n")).orderBy("a")
    assert [(r.a, r.b) for r in short.collect()] == [(1, None), (2, 3)]
    long = put("long.csv", "a,b\n1,2\n3,4,5\n")
    for read in (lambda: read_csv(spark, long, infer=False).select("a").collect(),
                 lambda: read_csv(spark, long, headers="same", infer=False).collect()):
        with pytest.raises(Exception, match="more than 2 fields|MALFORMED|FAILED_READ_FILE"):
            read()


def test_xml_underscore_names_and_truncation(spark, put):
    df = read_xml(spark, put("a.xml", '<records><record k="1"><_id>7</_id><n>x</n></record></records>'))
    assert [(r["_id"], r["n"]) for r in df.collect()] == [("7", "x")]
    with pytest.raises(Exception):
        read_xml(spark, put("cut.xml", "<records><record><n>x</n></record><record><n>y")).collect()


def test_names_that_differ_in_case(spark, put):
    with pytest.raises(TablePrepError, match="differ only in case"):
        read_csv(spark, put("case.csv", "Name,name\n1,2\n"))
    with pytest.raises(TablePrepError, match="differ only in case"):
        union_by_name([spark.range(1).select(F.lit(1).alias("Name")), spark.range(1).select(F.lit(1).alias("name"))])


def test_plain_csv_is_split_and_convert_does_not_shuffle(spark, put, outdir):
    text = "a,b\n" + "".join(f"{i},{'x' * 90}\n" for i in range(60_000))
    big, quoted = put("big.csv", text), put("quoted.csv", 'a,b\n1,"two\nlines"\n2,z\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        df = read_csv(spark, [big, quoted], infer=False)
        assert df.count() == 60_002 and df.rdd.getNumPartitions() > 3
        assert df.where("b = 'two\\nlines'").count() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    from tableprep.sinks.writers import _prepare
    assert "rangepartitioning" not in _prepare(df)._jdf.queryExecution().executedPlan().toString()
    convert(spark, big, outdir + "/conv", "csv", "json")
    first = sorted(glob.glob(outdir + "/conv/*.json"))[0]
    assert json.loads(open(first).readline())["a"] == 0


# ------------------------------------------------------------------ numbers, formulas, predicates, dates
def test_numbers_as_pandas_reads_them(spark, put):
    cols = {"a": ["1D", "2F", "10d"], "b": ["0x1p3", "1", "2"], "c": ["12345678901234567890123", "1", "2"], "d": ["1e3", ".5", "-2."],
            "e": ["1", "-7", "+3"], "f": ["inf", "1.5", "-Infinity"]}
    path = put("n.csv", ",".join(cols) + "\n" + "".join(",".join(v[i] for v in cols.values()) + "\n" for i in range(3)))
    got = dict(read_csv(spark, path).select(*cols).dtypes)
    want = {k: {"object": "string", "str": "string", "float64": "double", "int64": "bigint"}[str(t)] for k, t in pd.read_csv(path).dtypes.items()}
    assert got == want
    df = spark.createDataFrame([(x,) for x in ["12d", "0x1p3", "12345678901234567890123", "1e3", " 7 ", "2.5", "x", None]], "x string")
    ints = [r.x for r in C.cast_columns(df, {"x": "int"}).collect()]
    assert ints == [None, None, None, 1000, 7, None, None, None]
    floats = [r.x for r in C.cast_columns(df, {"x": "float"}).collect()]
    assert floats == [None, None, 1.2345678901234568e22, 1000.0, 7.0, 2.5, None, None]
    big = spark.createDataFrame([(2**62,), (3,)], "n bigint")
    assert [r.m for r in C.apply_formulas(big, {"m": "n * 4"}).collect()] == [None, 12]


def test_remainder_and_floor_division(spark):
    xs = [(7, 3), (7, -3), (-7, 3), (-7, -3), (6, 3), (-6, 3), (5, 0), (0, 4)]
    df = spark.createDataFrame(xs, "a bigint, b bigint")
    for a, b in [(x, y) for x, y in xs if y]:
        one = where(df, (c("a") == a) & (c("b") == b) & (c("a") % c("b") == a % b) & (c("a") // c("b") == a // b))
        assert one.count() == 1, (a, b)
    assert where(df, (c("a") % c("b")).isnull()).count() == 1
    assert where(df, c("a") % -3 == -2).count() == sum(a % -3 == -2 for a, _ in xs)
    assert where(df, 10 % c("b") == 1).count() == sum(b != 0 and 10 % b == 1 for _, b in xs)
    assert where(df, 2 ** c("b") == 8).count() == sum(b == 3 for _, b in xs)
    assert where(df, 10 // c("b") == 3).count() == sum(b == 3 for _, b in xs)
    assert where(df, P.expm1(P.log1p("b")) > 2.5).count() == sum(b >= 3 for _, b in xs)


def test_date_forms(spark):
    texts = ["2024-01-15T10:30:00Z", "2024-01-15 10:30:00.250", "2024-01-15 10:30", "2024-1-5", "January 15, 2024", "15 January 2024",
             "15 Jan 2024", "1/5/2024", "2024-01-15T10:30:00+02:00"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = [r.d for r in C.normalize_dates(df, "d", "%Y-%m-%d %H:%M").collect()]
    want = [pd.to_datetime(t) for t in texts]
    want = [(x.tz_convert("UTC") if x.tzinfo else x).strftime("%Y-%m-%d %H:%M") for x in want]
    assert got == want and dt.datetime.strptime(got[0], "%Y-%m-%d %H:%M")


def test_slice_without_an_order_is_refused(spark):
    with pytest.raises(TablePrepError):
        slice_rows(spark.range(5).toDF("x"), 0, 1, None)


# ------------------------------------------------------------------ sheets
BOOK = {"A": [["k", "v"], [1, "a"]], "E": [], "B": [["k", None, "v"], [2, "extra", "b", "more"]], "Blank": [None, ["x", 1]], "C": [["k"], [3]]}


def test_sheets_keep_their_positions_and_cells(spark, outdir):
    path = write_book(f"{outdir}/my book.xlsx", BOOK)
    names = sheet_names(spark, path)
    assert names == [("A", 0), ("E", 1), ("B", 2), ("Blank", 3), ("C", 4)]
    book = read_xlsx(spark, path)
    b = book.where("sheet = 'B'").first()
    assert (b["Unnamed: 1"], b["Unnamed: 3"], b["v"]) == ("extra", "more", "b")
    assert book.where("sheet = 'Blank'").count() == 1
    got = H.extract_sheets(book, ["2", "C"], names)
    assert {(r.sheet, r.sheet_pos, r.k) for r in got.collect()} == {("Sheet_2", 0, 2), ("C", 1, 3)}
    assert {r.sheet for r in H.extract_sheets(book, ["4"], names).collect()} == {"Sheet_4"}
    new = H.rename(book, ["n1", "n2", "n3", "n4", "n5"], names)
    assert {r.sheet for r in new.collect()} == {"n1", "n3", "n4", "n5"}
    order = H.reorder(book, ["C", "E", "A", "B", "Blank"], names)
    assert {(r.sheet, r.sheet_pos) for r in order.select("sheet", "sheet_pos").distinct().collect()} == {
        ("C", 0), ("A", 2), ("B", 3), ("Blank", 4)}
    with pytest.raises(TablePrepError):
        H.rename(book, ["n1", "n2", "n3"], names)
    copied = H.copy(book, book.where("sheet = 'A'"), ["C"], names, [("A", 0), ("E", 1)])
    assert {(r.sheet, r.sheet_pos) for r in copied.collect()} == {("A", 0), ("C", 2)}


def test_gaps_and_several_workbooks(spark, outdir):
    df = spark.range(20).select("id", F.when(F.col("id") < 12, "a").otherwise("b").alias("s"))
    book = H.as_sheets(df, "s", ["id"])
    odd = book.where("id % 2 = 0")
    with pytest.raises(Exception, match="have gaps"):
        H.combine(odd, "all").collect()
    dense = H.renumber(odd)
    assert sorted((r.row_pos, r.id) for r in H.combine(dense, "all").collect()) == [(i, 2 * i) for i in range(10)]
    count = H.combine(dense, "all").groupBy().count()  # what only counts rows does not number them again
    assert "row_number" not in count._jdf.queryExecution().optimizedPlan().toString()
    far = odd.withColumn("row_pos", F.when(F.col("id") < 16, F.col("row_pos") * 10**7).otherwise(F.col("row_pos") + 10**12))
    assert sorted((r.sheet, r.row_pos, r.id) for r in H.renumber(far).collect()) == [("a", i, 2 * i) for i in range(6)] + [
        ("b", i, 12 + 2 * i) for i in range(4)]
    parts = H.split_to_sheets(dense, 3).groupBy("sheet").count().collect()
    assert {r["sheet"]: r["count"] for r in parts} == {"Sheet_1": 3, "Sheet_2": 3, "Sheet_3": 3, "Sheet_4": 1}
    one = write_book(f"{outdir}/one.xlsx", {"A": [["k"], [1], [2]], "B": [["k"], [3]]})
    two = write_book(f"{outdir}/two.xlsx", {"A": [["k"], [4]]})
    both = H.combine(read_xlsx(spark, [one, two]), "all")
    assert sorted((r.row_pos, r.k) for r in both.collect()) == [(0, 1), (1, 2), (2, 3), (3, 4)]


def test_rows_without_a_sheet_are_refused(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "id int, s string")
    with pytest.raises(TablePrepError, match="belong to no sheet"):
        H.as_sheets(df, "s", ["id"])
    with pytest.raises(TablePrepError, match="missing from sheet_order"):
        H.as_sheets(df.where("s is not null"), "s", ["id"], sheet_order=["a"])


# ------------------------------------------------------------------ batches and manifests
def test_batch_files_keep_their_own_columns(spark, put, outdir):
    a, b = put("a.csv", "x,y,e\n1,2,\n1,2,\n"), put("b.csv", "p,q,e\nk,,7\n")
    batch_convert(spark, [a, b], outdir + "/json", "csv", "json")

    def keys(kind, i):
        return [set(json.loads(line)) for p in glob.glob(f"{outdir}/{kind}/file_pos={i}/*.json") for line in open(p)]

    assert keys("json", 0) == [{"x", "y", "e"}] * 2 and keys("json", 1) == [{"p", "q", "e"}]
    batch_clean(spark, [a, b], {"remove_empty_columns": True, "remove_duplicates": True}, outdir + "/clean", "json")
    assert keys("clean", 0) == [{"x", "y"}] and keys("clean", 1) == [{"p", "e"}]
    batch_clean(spark, [a, b], {"standardize_columns": {"format": "lowercase"}}, outdir + "/csv", "csv")
    heads = {i: open(glob.glob(f"{outdir}/csv/file_pos={i}/*.csv")[0]).readline().strip() for i in (0, 1)}
    assert heads == {0: "x,y,e", 1: "p,q,e"}


def test_manifest_names(spark):
    files = spark.createDataFrame([("é.csv",), ("b.csv",)], "name string")
    out = V.rename_manifest(files, "name", "f_{index:03d}_{filename}", ["name"]).orderBy("name").collect()
    assert [(r.new_name, r.valid) for r in out] == [("f_000_b.csv", True), ("f_001_é.csv", True)]


def test_json_checks_without_a_size_limit(spark):
    texts = ['[{"a": 1}, {"b": [2]}]', '[{"a": 1}, 2]', "[]", '{"a": 1}', "3", '["{"]', '[{"a": 1}', "[null]"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.is_json, r.is_array, r.is_object, r.array_of_objects) for r in V.validate_json_texts(df, "t", ["t"]).collect()}
    assert got == {texts[0]: (True, True, False, True), texts[1]: (True, True, False, False), texts[2]: (True, True, False, True),
                   texts[3]: (True, False, True, False), texts[4]: (True, False, False, False), texts[5]: (True, True, False, False),
                   texts[6]: (False, False, False, False), texts[7]: (True, True, False, False)}


def test_csv_checks_know_all_white_space(spark, put):
    df = spark.createDataFrame([(" \t\n",), ("a,b",)], "t string")
    assert [r.non_blank for r in df.select(V.csv_text_checks(F.col("t"))["non_blank"].alias("non_blank")).collect()] == [False, True]
    bad = put("bad.csv", "a,b\n\xe9,1\n", "latin-1")
    fine = put("fine.csv", "a,b\n�,1\n")
    got = {r.path.rpartition("/")[2]: r.valid for r in V.validate_csv_files(spark, [bad, fine]).collect()}
    assert got == {"bad.csv": False, "fine.csv": True}
