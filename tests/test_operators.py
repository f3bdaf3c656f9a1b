"""Predicates (F2), cleaning (C1-C9), extract (F1-F4), order invariants."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tableprep import clean, extract
from tableprep.errors import TablePrepError
from tableprep.functions import predicates as P
from tableprep.functions.predicates import c
from tableprep.functions.text import strftime_to_spark
from tableprep.operators import clean as C
from tableprep.operators.order import ROW_ORDER, slice_rows, with_row_index
from tableprep.operators.split import part_sizes, with_parts
from tableprep.sources.files import read_csv

SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def nulls(spark):
    return spark.createDataFrame(
        [(0, 1.0, "xy"), (1, None, None), (2, 3.0, "z")], "i long, a double, s string")


def kept(df, cond):
    return sorted(r[0] for r in P.where(df, cond).select("i").collect())


# Expected positions from FIXTURES.md (pandas query semantics).
def test_two_valued_predicates(nulls):
    assert kept(nulls, c("a") != 1) == [1, 2]
    assert kept(nulls, c("a").isin([1, 2])) == [0]
    assert kept(nulls, c("a").not_in([1, 2])) == [1, 2]
    assert kept(nulls, c("a").between(0, 3)) == [0]
    assert kept(nulls, ~(c("a") > 2)) == [0, 1]
    assert kept(nulls, c("s") != "xy") == [1, 2]
    assert kept(nulls, (c("s") == "xy") | (c("a") > 2)) == [0, 2]
    assert kept(nulls, c("a").isnull()) == [1]
    assert kept(nulls, c("i") > 0) == [1, 2]


def test_nan_is_missing_and_division(spark):
    df = spark.createDataFrame([(0, float("nan")), (1, 5.0), (2, 0.0)], "i long, a double")
    assert kept(df, c("a") > 1) == [1]                  # Spark alone would keep NaN
    assert kept(df, c("a") != 5) == [0, 2]
    assert kept(df, (c("a") / c("a")) > 0) == [1]       # 0/0 is missing, not an error
    assert kept(df, P.sqrt(c("a")) >= 0) == [1, 2]
    assert kept(df, (c("a") % 3) == 2) == [1]


def test_triples_and_sql_opt_in(nulls):
    assert kept(nulls, [("a", ">", 0), ("s", "!=", "z")]) == [0]
    with pytest.raises(TablePrepError):
        P.where_sql(nulls, "a > 0")
    assert sorted(r[0] for r in P.where_sql(nulls, "a > 0", trusted=True).select("i").collect()) == [0, 2]


@pytest.fixture(scope="module")
def people(spark, files):
    return read_csv(spark, files["people.csv"])


def test_clean_steps(people):
    out = clean(people, {"remove_empty_rows": True})
    assert out.count() == 6
    out = clean(people, {"remove_duplicates": {"columns": ["name", "city"]}})
    names = [r[0] for r in out.orderBy(*ROW_ORDER).select("age").collect()]
    assert names[0] == "30"              # first ' Ann ' kept; 'Ann ' differs by padding
    trimmed = clean(people, {"trim_whitespace": True, "remove_duplicates": {"columns": ["name", "city"]}})
    # dedupe runs before trim (fixed order): both Anns survive
    assert trimmed.where("name = 'Ann'").count() == 2
    t2 = clean(clean(people, {"trim_whitespace": True}), {"remove_duplicates": {"columns": ["name", "city"]}})
    assert [tuple(r) for r in t2.where("name = 'Ann'").select("age").collect()] == [("30",)]
    assert t2.where("city = 'Rome'").count() == 1   # tab and spaces stripped


def test_fill_and_casts(people):
    filled = clean(people, {"replace_nulls": {"value": "Unknown"}})
    assert dict(filled.dtypes)["price"] == "string"  # numeric column holding a null -> text
    assert filled.where("name = 'Cid'").select("price").first()[0] == "Unknown"
    cast = clean(people, {"change_data_types": {"age": "int", "price": "str"}})
    ages = dict((r[0], r[1]) for r in cast.select("name", "age").collect() if r[0])
    assert ages["Cid"] == 1000 and ages["Dee"] is None and ages["Eve"] is None and ages[" Ann "] == 30
    with pytest.raises(TablePrepError):
        C.cast_columns(people, {"age": "int"}, on_fraction="error")
    with pytest.raises(TablePrepError):
        C.cast_columns(people, {"age": "decimal"})


def test_names_formulas_dates(spark, files):
    h = read_csv(spark, files["headers.csv"])
    with pytest.raises(TablePrepError):
        clean(h, {"standardize_columns": {"format": "lowercase_underscore"}})  # 'first_name' twice
    low = clean(h, {"standardize_columns": {"format": "lowercase"}})
    assert [x for x in low.columns if not x.startswith("_") and x != "source_file"] == ["first name", "age", "first  name"]
    people = read_csv(spark, files["people.csv"])
    out = clean(people, {"apply_formulas": {"name_up": "uppercase(name)", "p2": "price * 2"},
                         "normalize_dates": {"column": "date", "format": "%d/%m/%Y"}})
    r = out.where("name = 'Bob'").first()
    assert (r["name_up"], r["p2"], r["date"]) == ("BOB", 14.0, "10/02/2024")
    assert out.where("name = 'Cid'").first()["date"] is None
    with pytest.raises(TablePrepError):
        clean(people, {"apply_formulas": {"x": "name + 1"}})
    assert strftime_to_spark("%Y-%m-%d at %H:%M") == "yyyy-MM-dd' at 'HH:mm"


def test_row_index_matches_global_order(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    ref = li.withColumn("r", F.row_number().over(Window.orderBy(*key)) - 1)
    for parts in (1, 4, 64):
        got = with_row_index(li.repartition(parts), key, index_col="i", rows_per_bucket=5000)
        diff = got.join(ref, key).where("i != r").count()
        assert diff == 0 and got.count() == li.count()
    stats = with_row_index(li, key, index_col="i").agg(
        F.min("i"), F.max("i"), F.countDistinct("i")).first()
    assert tuple(stats) == (0, li.count() - 1, li.count())


def test_hot_leading_key_is_split(spark):
    # a third of the rows share one leading value: buckets must still balance
    df = spark.range(0, 30000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), F.col("id").alias("id"))
    import tableprep.operators.order as O
    n = df.count()
    bounds = O._sample_bounds(df, ["k", "id"], n, 16, 32, 7)
    width = O._prefix_width(bounds)
    assert width == 2
    b = O._dedupe([x[:width] for x in bounds])
    sizes = [r[1] for r in df.groupBy(O.bucket_expr(df, ["k", "id"], b)).count().collect()]
    assert max(sizes) < n / 4
    got = with_row_index(df, ["k", "id"], index_col="i")
    ref = df.withColumn("r", F.row_number().over(Window.orderBy("k", "id")) - 1)
    assert got.join(ref, ["k", "id"]).where("i != r").count() == 0


def test_partitioned_index_and_parts(spark):
    li = spark.read.parquet(f"{SF01}/lineitem.parquet")
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    got = with_parts(li, 700, key, partition_by="l_returnflag", keep_index=True)
    ref = li.withColumn("r", F.row_number().over(Window.partitionBy("l_returnflag").orderBy(*key)) - 1)
    assert got.join(ref, key + ["l_returnflag"]).where("row_idx != r").count() == 0
    sizes = part_sizes(with_parts(li, 7000, key)).orderBy("part").collect()
    assert [r["rows"] for r in sizes[:-1]] == [7000] * (len(sizes) - 1)
    assert sum(r["rows"] for r in sizes) == li.count()


def test_slice_and_extract(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    s = slice_rows(o, 5, 9, ["o_orderkey"])
    assert sorted(r[0] for r in s.select("o_orderkey").collect()) == list(range(5, 10))
    with pytest.raises(TablePrepError):
        slice_rows(o, 0, o.count(), ["o_orderkey"])
    with pytest.raises(TablePrepError):
        slice_rows(o, 3, 2, ["o_orderkey"])
    out = extract(o, {"extract_rows_by_index": {"start": 0, "end": 99},
                      "extract_rows_by_condition": {"condition": c("o_orderstatus") == "F"},
                      "extract_columns": {"columns": ["o_orderkey", "o_totalprice"]},
                      "apply_filter": {"condition": c("o_totalprice") > 100000}}, order_by=["o_orderkey"])
    assert out.columns == ["o_orderkey", "o_totalprice"]
    ref = o.where("o_orderkey < 100 and o_orderstatus = 'F' and o_totalprice > 100000").count()
    assert out.count() == ref
    with pytest.raises(TablePrepError):  # the second filter sees projected columns only
        extract(o, {"extract_columns": {"columns": ["o_orderkey"]},
                    "apply_filter": {"condition": c("o_totalprice") > 1}}).count()


def test_index_operand_in_conditions(spark):
    o = spark.read.parquet(f"{SF01}/orders.parquet")
    out = extract(o, {"extract_rows_by_condition": {"condition": (c("index") >= 10) & (c("index") < 15)}},
                  order_by=["o_orderkey"])
    assert sorted(r[0] for r in out.select("o_orderkey").collect()) == list(range(10, 15))
    assert "index" not in out.columns
    with pytest.raises(TablePrepError):
        extract(o, {"extract_rows_by_condition": {"condition": c("nope") > 1}}, order_by=["o_orderkey"])


def test_dedupe_keeps_first_with_map_payload(spark):
    df = spark.createDataFrame(
        [(1, 2, {"a": 1}), (1, 1, {"b": 2}), (2, 5, None)], "k long, pos long, m map<string,int>")
    out = {r["k"]: (r["pos"], r["m"]) for r in C.dedupe(df, ["k"], order_by=["pos"]).collect()}
    assert out == {1: (1, {"b": 2}), 2: (5, None)}
    last = {r["k"]: r["pos"] for r in C.dedupe(df, ["k"], order_by=["pos"], keep="last").collect()}
    assert last == {1: 2, 2: 5}


def test_dates_of_a_column_are_read_by_one_pattern(spark):
    from tableprep.operators.clean import column_date_format, normalize_dates

    def read(values, per, **kw):
        df = spark.createDataFrame(list(enumerate(values)), "i int, d string").repartition(4, "d")
        return [r.d for r in normalize_dates(df, "d", per=per, order_by=["i"], **kw).orderBy("i").collect()]

    day_first = ["13/01/2024", None, "02/01/2024", "", "x"]
    assert read(day_first, "column") == read(day_first, "first") == ["2024-01-13", None, "2024-01-02", None, None]
    unclear = ["02/01/2024", "13/01/2024"]  # the first value alone says month first
    assert read(unclear, "first") == ["2024-02-01", None] and read(unclear, "column") == ["2024-01-02", "2024-01-13"]
    assert read(["2024-01-05", "13/01/2024"], "column") == ["2024-01-05", None]  # nothing fits all: the first value's
    assert read(["x", "2024-01-05"], "column") == [None, None] and read([None], "first") == [None]
    df = spark.createDataFrame([("1.2.2024",)], "d string")
    with pytest.raises(TablePrepError):
        column_date_format(df, "d")
    assert column_date_format(df, "d", ["d"], ["M.d.yyyy", "d.M.yyyy"]) == "M.d.yyyy"
