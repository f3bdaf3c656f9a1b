"""Columns of mixed types as VARIANT."""
import glob
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tableprep import c, clean
from tableprep.errors import TablePrepError
from tableprep.functions.predicates import where
from tableprep.operators.clean import cast_columns, dedupe, drop_empty_columns, drop_empty_rows, fill_nulls, trim_whitespace
from tableprep.operators.merge import union_by_name
from tableprep.sinks.writers import write
from tableprep.sources.files import read_files


@pytest.fixture(scope="module")
def mixed(spark):
    numbers = spark.createDataFrame([(1, 1), (2, 9007199254740993), (3, None)], "id int, v bigint")
    texts = spark.createDataFrame([(4, "1"), (5, " b "), (6, None)], "id int, v string")
    halves = spark.createDataFrame([(7, 1.0), (8, float("nan")), (9, 2.5)], "id int, v double")
    return union_by_name([numbers, texts, halves.withColumn("v", F.col("v").cast(T.VariantType()))], mixed="variant")


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_values_keep_their_types(mixed):
    assert isinstance(mixed.schema["v"].dataType, T.VariantType)
    got = {r["id"]: (r["t"], r["j"]) for r in mixed.select("id", F.schema_of_variant("v").alias("t"), F.to_json("v").alias("j")).collect()}
    assert got[1] == ("BIGINT", "1") and got[2] == ("BIGINT", "9007199254740993")
    assert got[4] == ("STRING", '"1"') and got[3] == (None, None) == got[6]


def test_text_stays_the_default(spark):
    a, b = spark.createDataFrame([(1,)], "v int"), spark.createDataFrame([("x",)], "v string")
    assert isinstance(union_by_name([a, b]).schema["v"].dataType, T.StringType)
    with pytest.raises(TablePrepError):
        union_by_name([a, b], mixed="any")


@pytest.mark.parametrize("cond, want", [
    (c("v") == 1, [1, 7]), (c("v") == "1", [4]), (c("v") != 1, [2, 3, 4, 5, 6, 8, 9]), (c("v") > 1, [2, 9]),
    (c("v") == 9007199254740993, [2]), (c("v") == 9007199254740992, []), (c("v") >= "1", [4]),
    (c("v").isin([1, " b "]), [1, 5, 7]), (c("v").not_in([1]), [2, 3, 4, 5, 6, 8, 9]), (c("v").isin([]), []),
    (c("v").isnull(), [3, 6, 8]), (c("v").notnull(), [1, 2, 4, 5, 7, 9]), (c("v").contains("1"), [4]),
    (c("v").startswith(" b"), [5]), (c("v").endswith("1"), [4]), (c("v") * 2 == 5, [9]), (c("v") == c("id"), [1]),
    (c("v") == True, []), (~(c("v") > 1), [1, 3, 4, 5, 6, 7, 8]),  # noqa: E712
])
def test_filters_go_by_the_type_of_the_value(mixed, cond, want):
    assert ids(where(mixed, cond)) == want


def test_dedupe(mixed):
    assert ids(dedupe(mixed, ["v"], order_by=["id"])) == [1, 2, 3, 4, 5, 9]
    assert ids(dedupe(mixed, ["v"], order_by=["id"], keep="last")) == [2, 4, 5, 7, 8, 9]
    kept = dedupe(mixed, ["v"], order_by=["id"])
    assert kept.columns == mixed.columns and isinstance(kept.schema["v"].dataType, T.VariantType)
    assert dedupe(mixed.select("v")).count() == 6


def test_fill_keeps_numbers(spark, mixed):
    df = spark.createDataFrame([(1, 5, 1.5), (2, None, 2.5)], "id int, a int, b double")
    out = fill_nulls(df, "none", numeric="variant")
    assert [f.dataType.typeName() for f in out.schema.fields] == ["integer", "variant", "double"]  # b and id miss nothing
    assert [r[0] for r in out.orderBy("id").select(F.to_json("a")).collect()] == ["5", '"none"']
    out = fill_nulls(mixed, "-", columns=["v"])
    assert ids(where(out, c("v") == "-")) == [3, 6, 8]
    assert ids(where(fill_nulls(mixed, 0, columns=["v"]), c("v") == 0)) == [3, 6, 8]
    assert ids(where(clean(df, {"replace_nulls": {"value": "x", "numeric": "variant"}}), c("a") == 5)) == [1]
    with pytest.raises(TablePrepError):
        fill_nulls(df, "x", numeric="any")


def test_other_steps(mixed):
    assert ids(where(trim_whitespace(mixed), c("v") == "b")) == [5]
    assert ids(where(trim_whitespace(mixed), c("v") == 2.5)) == [9]
    assert ids(drop_empty_rows(mixed, ["v"])) == [1, 2, 4, 5, 7, 9]
    assert "v" not in drop_empty_columns(where(mixed, c("v").isnull())).columns
    got = {r["id"]: r["v"] for r in cast_columns(mixed, {"v": "int"}).collect()}
    assert got == {1: 1, 2: 9007199254740993, 3: None, 4: 1, 5: None, 6: None, 7: 1, 8: None, 9: None}
    got = {r["id"]: r["v"] for r in cast_columns(mixed, {"v": "float"}).collect()}
    assert got[9] == 2.5 and got[4] == 1.0 and got[5] is None and got[8] is None
    got = {r["id"]: r["w"] for r in clean(mixed, {"apply_formulas": {"w": "v * 2"}}).collect()}
    assert got[9] == 5.0 and got[4] == 2.0


def lines(path):
    return [x for p in glob.glob(path + "/part-*") for x in open(p).read().splitlines()]


def test_files_in_and_out(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,v\n1,10\n2,20\n")
    (tmp_path / "b.json").write_text(json.dumps([{"id": 3, "v": "x"}, {"id": 4, "v": "10"}, {"id": 5, "v": None}]))
    df = read_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.json")], mixed="variant").select("id", "v")
    write(df, str(tmp_path / "json"), "json")
    assert {json.loads(x)["id"]: json.loads(x)["v"] for x in lines(str(tmp_path / "json"))} == {1: 10, 2: 20, 3: "x", 4: "10", 5: None}
    write(df, str(tmp_path / "csv"), "csv")
    assert sorted(x for x in lines(str(tmp_path / "csv")) if x != "id,v") == ["1,10", "2,20", "3,x", "4,10", "5,"]
    write(df, str(tmp_path / "pq"), "parquet")
    assert ids(where(spark.read.parquet(str(tmp_path / "pq")), c("v") == 10)) == [1]
