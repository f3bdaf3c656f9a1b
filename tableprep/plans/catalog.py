"""Registered queries over the driver's tables, each with its DuckDB oracle.

Every query reads whole tables (``{sf_dir}/<table>.parquet``) and goes
through the library's operators.  Nulls are made with ``nullif`` (or a
``CASE``) identically on both sides, since the tables hold none.  Output
columns carry the same names in Spark and SQL.
"""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.predicates import c
from ..operators import clean as C
from ..operators import sheets as H
from ..operators import validate as V
from ..operators.merge import merge, tag_source, union_by_name
from ..operators.order import ROW_ORDER, slice_rows, with_row_index
from ..operators.split import part_sizes, with_parts
from ..session import checkpoint_dir
from ..sources.files import infer_types, na_to_null
from ..sources.indexed import IndexedTable
from ..sources.tables import read_ordered, read_tables
from .tasks import clean, extract

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# ---------------------------------------------------------------- C10
@query("clean_tasks", """
with src as (select o_orderkey, o_custkey, o_orderdate,
                    nullif(o_orderpriority, '5-LOW') as priority from orders),
     first as (select *, row_number() over (partition by o_custkey
                         order by o_orderdate, o_orderkey) as rn from src)
select o_orderkey, o_custkey, strftime(o_orderdate, '%d/%m/%Y') as order_day,
       coalesce(priority, 'Unknown') as priority, o_custkey * 2 as double_key
from first where rn = 1
""")
def clean_tasks(spark, d):
    src = _t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    spec = {
        "remove_duplicates": {"columns": ["o_custkey"]},
        "replace_nulls": {"value": "Unknown"},
        "apply_formulas": {"double_key": "o_custkey * 2"},
        "normalize_dates": {"column": "o_orderdate", "format": "%d/%m/%Y"},
    }
    return clean(src, spec, order_by=["o_orderdate", "o_orderkey"]).withColumnRenamed("o_orderdate", "order_day")


# ---------------------------------------------------------------- C1-C9
@query("clean_dedupe_first", """
select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as rn
      from orders) where rn = 1
""")
def clean_dedupe_first(spark, d):
    return C.dedupe(_t(spark, d, "orders"), ["o_custkey"], order_by=["o_orderdate", "o_orderkey"])


@query("clean_dedupe_all", """
select distinct l_returnflag, l_linestatus, l_linenumber, l_tax from lineitem
""")
def clean_dedupe_all(spark, d):
    src = _t(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_tax")
    return clean(src, {"remove_duplicates": True})


@query("clean_fill_nulls", """
select c_custkey, c_name, coalesce(cast(nullif(c_nationkey, 3) as varchar), 'Unknown') as c_nationkey,
       c_acctbal, coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown') as c_mktsegment
from customer
""")
def clean_fill_nulls(spark, d):
    src = _t(spark, d, "customer").select(
        "c_custkey", "c_name", F.expr("nullif(c_nationkey, 3)").alias("c_nationkey"), "c_acctbal",
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return clean(src, {"replace_nulls": {"value": "Unknown"}})


@query("clean_fill_default", """
select c_custkey, c_name, coalesce(nullif(c_mktsegment, 'BUILDING'), '') as c_mktsegment from customer
""")
def clean_fill_default(spark, d):
    src = _t(spark, d, "customer").select(
        "c_custkey", "c_name", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return clean(src, {"replace_nulls": True})


@query("clean_fill_per_column", """
select c_custkey, coalesce(case when c_acctbal < 0 then null else c_acctbal end, 0.0) as c_acctbal,
       coalesce(nullif(c_mktsegment, 'BUILDING'), 'Unknown') as c_mktsegment
from customer
""")
def clean_fill_per_column(spark, d):
    src = _t(spark, d, "customer").select(
        "c_custkey", F.expr("case when c_acctbal < 0 then null else c_acctbal end").alias("c_acctbal"),
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("c_mktsegment"))
    return clean(src, {"replace_nulls": {"value": {"c_acctbal": 0.0, "c_mktsegment": "Unknown"}}})


@query("clean_trim", """
select c_custkey, c_name, c_mktsegment from customer
""")
def clean_trim(spark, d):
    src = _t(spark, d, "customer").select(
        "c_custkey",
        F.concat(F.lit(" \t"), "c_name", F.lit("\n ")).alias("c_name"),
        F.concat(F.lit("　"), "c_mktsegment", F.lit("  ")).alias("c_mktsegment"))
    return clean(src, {"trim_whitespace": True})


@query("clean_empty_rows", """
select seg, nk from (
  select nullif(c_mktsegment, 'BUILDING') as seg,
         case when c_acctbal < 0 then null else c_nationkey end as nk from customer)
where not (seg is null and nk is null)
""")
def clean_empty_rows(spark, d):
    src = _t(spark, d, "customer").select(
        F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"),
        F.expr("case when c_acctbal < 0 then null else c_nationkey end").alias("nk"))
    return clean(src, {"remove_empty_rows": True})


@query("clean_empty_cols", """
select l_orderkey, l_linenumber, nullif(l_discount, 0.0) as l_discount, l_tax from lineitem
""")
def clean_empty_cols(spark, d):
    src = _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.expr("nullif(l_returnflag, l_returnflag)").alias("l_note"),
        F.expr("nullif(l_discount, 0.0)").alias("l_discount"), "l_tax")
    return clean(src, {"remove_empty_columns": True})


@query("clean_std_columns", """
select n_nationkey as nation_key, n_name as nation_name, n_regionkey as region_key from nation
""")
def clean_std_columns(spark, d):
    src = _t(spark, d, "nation").toDF(" Nation Key", "NATION\tName ", "Region  KEY")
    return clean(src, {"standardize_columns": {"format": "lowercase_underscore"}})


_BRAND_TEXT = """case when p_size > 45 then 'n/a'
     when p_size % 5 = 0 then concat(regexp_extract(p_brand, '#(\\\\d+)', 1), '.5')
     when p_size % 7 = 0 then concat(regexp_extract(p_brand, '#(\\\\d+)', 1), 'e1')
     when p_size % 3 = 0 then concat(' ', regexp_extract(p_brand, '#(\\\\d+)', 1), '.0')
     else regexp_extract(p_brand, '#(\\\\d+)', 1) end"""


@query("clean_cast_int", """
select p_partkey,
       case when p_size > 45 then null
            when p_size % 5 = 0 then null
            when p_size % 7 = 0 then cast(regexp_extract(p_brand, '#(\\d+)', 1) as bigint) * 10
            else cast(regexp_extract(p_brand, '#(\\d+)', 1) as bigint) end as brand_num
from part
""")
def clean_cast_int(spark, d):
    src = _t(spark, d, "part").select("p_partkey", F.expr(_BRAND_TEXT).alias("brand_num"))
    return clean(src, {"change_data_types": {"brand_num": "int"}})


@query("clean_cast_float", """
select p_partkey, case when p_size > 45 then null else p_retailprice end as price from part
""")
def clean_cast_float(spark, d):
    src = _t(spark, d, "part").select(
        "p_partkey", F.expr("case when p_size > 45 then 'abc' else cast(p_retailprice as string) end").alias("price"))
    return clean(src, {"change_data_types": {"price": "float"}})


@query("clean_cast_str", """
select cast(p_partkey as varchar) as p_partkey, cast(p_size as varchar) as p_size, p_name from part
""")
def clean_cast_str(spark, d):
    src = _t(spark, d, "part").select("p_partkey", "p_size", "p_name")
    return clean(src, {"change_data_types": {"p_partkey": "str", "p_size": "str"}})


@query("clean_formula_mul", """
select p_partkey, p_size, p_retailprice, cast(p_size as bigint) * 3 as size_x3, p_retailprice * 2 as price_x2
from part
""")
def clean_formula_mul(spark, d):
    src = _t(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    return clean(src, {"apply_formulas": {"size_x3": "p_size * 3", "price_x2": "p_retailprice * 2"}})


@query("clean_formula_upper", """
select p_partkey, p_name, upper(p_name) as name_upper, upper(p_brand) as p_brand from part
""")
def clean_formula_upper(spark, d):
    src = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand")
    return clean(src, {"apply_formulas": {"name_upper": "uppercase(p_name)", "p_brand": "uppercase(p_brand)"}})


@query("clean_dates", """
select o_orderkey,
       case when o_orderstatus = 'P' then null else strftime(o_orderdate, '%d/%m/%Y') end as order_day
from orders
""")
def clean_dates(spark, d):
    src = _t(spark, d, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(F.col("o_orderstatus") == "O", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .otherwise(F.lit("not a date")).alias("order_day"))
    return clean(src, {"normalize_dates": {"column": "order_day", "format": "%d/%m/%Y"}})


_TEXT_DAYS = "select *, strftime(o_orderdate, '%d/%m/%Y') as day from orders where o_orderstatus <> 'P'"


@query("clean_dates_column", f"""
with t as ({_TEXT_DAYS}), u as (
  select *, try_strptime(day, '%m/%d/%Y') is not null as month_first, row_number() over (order by o_orderkey) as n from t),
f as (select max(case when n = 1 then month_first end) as first_month_first, bool_and(month_first) as all_month_first from u)
select o_orderkey,
  strftime(case when all_month_first then strptime(day, '%m/%d/%Y') else strptime(day, '%d/%m/%Y') end, '%Y-%m-%d') as order_day,
  strftime(case when first_month_first then try_strptime(day, '%m/%d/%Y') else strptime(day, '%d/%m/%Y') end, '%Y-%m-%d') as by_first
from u cross join f
""")
def clean_dates_column(spark, d):
    orders = _t(spark, d, "orders").where("o_orderstatus <> 'P'")
    src = orders.select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("order_day"))
    src = src.withColumn("by_first", F.col("order_day"))
    out = clean(src, {"normalize_dates": {"column": "order_day", "per": "column"}}, order_by=["o_orderkey"])
    return clean(out, {"normalize_dates": {"column": "by_first", "per": "first"}}, order_by=["o_orderkey"])


# ---------------------------------------------------------------- F1-F4
_ORDERS_COLS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


@query("slice_rows", f"""
select {_ORDERS_COLS} from (select *, row_number() over (order by o_orderkey) - 1 as i from orders)
where i between 100 and 4099
""")
def slice_rows_q(spark, d):
    return extract(_t(spark, d, "orders"), {"extract_rows_by_index": {"start": 100, "end": 4099}},
                   order_by=["o_orderkey"])


@query("slice_head", f"""
select {_ORDERS_COLS} from (select *, row_number() over (order by o_orderkey) - 1 as i from orders)
where i between 0 and 99
""")
def slice_head(spark, d):
    return slice_rows(_t(spark, d, "orders"), 0, 99, ["o_orderkey"])


@query("filter_index", f"""
select {_ORDERS_COLS} from (select *, row_number() over (order by o_orderkey) - 1 as i from orders)
where i > 10000
""")
def filter_index(spark, d):
    idx = with_row_index(_t(spark, d, "orders"), ["o_orderkey"], index_col="index")
    return P.where(idx, c("index") > 10000).drop("index")


def _customer_seg(spark, d):
    return _t(spark, d, "customer").select(
        "c_custkey", F.expr("nullif(c_mktsegment, 'BUILDING')").alias("seg"))


@query("filter_eq", """
select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer
where coalesce(nullif(c_mktsegment, 'BUILDING') = 'AUTOMOBILE', false)
""")
def filter_eq(spark, d):
    return P.where(_customer_seg(spark, d), c("seg") == "AUTOMOBILE")


@query("filter_ne_nulls", """
select c_custkey, nullif(c_mktsegment, 'BUILDING') as seg from customer
where nullif(c_mktsegment, 'BUILDING') is distinct from 'MACHINERY'
""")
def filter_ne_nulls(spark, d):
    return P.where(_customer_seg(spark, d), c("seg") != "MACHINERY")


def _line_disc(spark, d):
    return _t(spark, d, "lineitem").select(
        *LINE_KEY, "l_quantity", "l_extendedprice", "l_returnflag",
        F.expr("nullif(l_discount, 0.05)").alias("d"))


@query("filter_range", f"""
select {LINE_KEY_SQL}, l_quantity, l_extendedprice, l_returnflag, nullif(l_discount, 0.05) as d
from lineitem where coalesce(0.02 < nullif(l_discount, 0.05) and nullif(l_discount, 0.05) <= 0.08, false)
""")
def filter_range(spark, d):
    return P.where(_line_disc(spark, d), c("d").between(0.02, 0.08, inclusive="right"))


@query("filter_bool", f"""
select {LINE_KEY_SQL}, l_quantity, l_extendedprice, l_returnflag, nullif(l_discount, 0.05) as d
from lineitem
where (l_quantity > 30 and l_returnflag = 'R') or not coalesce(nullif(l_discount, 0.05) > 0.04, false)
""")
def filter_bool(spark, d):
    return P.where(_line_disc(spark, d), ((c("l_quantity") > 30) & (c("l_returnflag") == "R")) | ~(c("d") > 0.04))


@query("filter_in", """
select p_partkey, nullif(p_size, 10) as sz from part
where coalesce(nullif(p_size, 10) in (1, 2, 3, 10, 20, 30), false)
""")
def filter_in(spark, d):
    src = _t(spark, d, "part").select("p_partkey", F.expr("nullif(p_size, 10)").alias("sz"))
    return P.where(src, c("sz").isin([1, 2, 3, 10, 20, 30]))


@query("filter_not_in", """
select p_partkey, nullif(p_size, 10) as sz from part
where not coalesce(nullif(p_size, 10) in (1, 2, 3, 10, 20, 30), false)
""")
def filter_not_in(spark, d):
    src = _t(spark, d, "part").select("p_partkey", F.expr("nullif(p_size, 10)").alias("sz"))
    return P.where(src, c("sz").not_in([1, 2, 3, 10, 20, 30]))


@query("filter_arith", f"""
select {LINE_KEY_SQL}, l_quantity, l_extendedprice, l_returnflag, nullif(l_discount, 0.05) as d
from lineitem
where coalesce(l_extendedprice * (1 - nullif(l_discount, 0.05)) > 20000, false)
  and coalesce(l_linenumber % 3 = 1, false)
  and coalesce(l_extendedprice / nullif(l_quantity, 1.0) > 1500, false)
""")
def filter_arith(spark, d):
    q = c(F.expr("nullif(l_quantity, 1.0)"))
    cond = (c("l_extendedprice") * (1 - c("d")) > 20000) & (c("l_linenumber") % 3 == 1) \
        & (c("l_extendedprice") / q > 1500)
    return P.where(_line_disc(spark, d), cond)


@query("filter_null", """
select o_orderkey, nullif(o_orderpriority, '5-LOW') as priority from orders
where nullif(o_orderpriority, '5-LOW') is null
""")
def filter_null(spark, d):
    src = _t(spark, d, "orders").select("o_orderkey", F.expr("nullif(o_orderpriority, '5-LOW')").alias("priority"))
    return P.where(src, c("priority").isnull())


@query("filter_str", """
select c_custkey, nullif(c_name, 'Customer#000000001') as name from customer
where coalesce(contains(nullif(c_name, 'Customer#000000001'), '00001'), false)
   or coalesce(starts_with(nullif(c_name, 'Customer#000000001'), 'Customer#00000099'), false)
""")
def filter_str(spark, d):
    src = _t(spark, d, "customer").select("c_custkey", F.expr("nullif(c_name, 'Customer#000000001')").alias("name"))
    return P.where(src, c("name").contains("00001", regex=False) | c("name").startswith("Customer#00000099"))


@query("filter_math", """
select c_custkey, case when c_acctbal > 9000 then null else c_acctbal end as bal from customer
where coalesce(abs(case when c_acctbal > 9000 then null else c_acctbal end) > 500, false)
  and coalesce(sqrt(abs(case when c_acctbal > 9000 then null else c_acctbal end)) < 60, false)
""")
def filter_math(spark, d):
    src = _t(spark, d, "customer").select(
        "c_custkey", F.expr("case when c_acctbal > 9000 then null else c_acctbal end").alias("bal"))
    return P.where(src, (P.abs_("bal") > 500) & (P.sqrt(P.abs_("bal")) < 60))


@query("project_columns", """
select c_name, c_acctbal, c_custkey from customer
""")
def project_columns(spark, d):
    return extract(_t(spark, d, "customer"), {"extract_columns": {"columns": ["c_name", "c_acctbal", "c_custkey"]}})


@query("project_then_filter", """
select c_custkey, c_acctbal from customer where c_acctbal > 5000
""")
def project_then_filter(spark, d):
    return extract(_t(spark, d, "customer"), {
        "extract_columns": {"columns": ["c_custkey", "c_acctbal"]},
        "apply_filter": {"condition": c("c_acctbal") > 5000},
    })


@query("extract_tasks", """
with idx as (select *, row_number() over (order by o_orderkey) - 1 as i from orders),
     sliced as (select * from idx where i between 1001 and 9999),
     cond as (select * from sliced where o_orderstatus <> 'P' and (i % 2) = 0)
select o_orderkey, o_totalprice, o_orderpriority from cond where o_totalprice > 150000
""")
def extract_tasks(spark, d):
    return extract(_t(spark, d, "orders"), {
        "extract_rows_by_index": {"start": 1001, "end": 9999},
        "extract_rows_by_condition": {"condition": (c("o_orderstatus") != "P") & (c("index") % 2 == 0)},
        "extract_columns": {"columns": ["o_orderkey", "o_totalprice", "o_orderpriority"]},
        "apply_filter": {"condition": c("o_totalprice") > 150000},
    }, order_by=["o_orderkey"])


# ---------------------------------------------------------------- U1-U6
@query("merge_union", """
select c_custkey as key, c_name as name, c_nationkey as nationkey, c_acctbal as acctbal,
       c_mktsegment as mktsegment from customer
union all by name
select s_suppkey as key, s_name as name, s_nationkey as nationkey, s_acctbal as acctbal from supplier
""")
def merge_union(spark, d):
    cust = _t(spark, d, "customer").toDF("key", "name", "nationkey", "acctbal", "mktsegment")
    supp = _t(spark, d, "supplier").toDF("key", "name", "nationkey", "acctbal")
    return union_by_name([cust, supp])


@query("merge_with_source", """
select *, 'customer.parquet' as source_file from customer
union all by name select *, 'supplier.parquet' as source_file from supplier
union all by name select *, 'nation.parquet' as source_file from nation
""")
def merge_with_source(spark, d):
    parts = read_tables(spark, [f"{d}/customer.parquet", f"{d}/supplier.parquet", f"{d}/nation.parquet"])
    return merge(parts, lower=True)


@query("merge_lower_names", """
select c_custkey as "key", c_name as "name", c_acctbal as "acct bal", 'customer.parquet' as source_file
from customer
union all by name
select s_suppkey as "key", s_name as "name", s_acctbal as "acct bal", s_nationkey as "nation",
       'supplier.parquet' as source_file from supplier
""")
def merge_lower_names(spark, d):
    cust, supp = read_tables(spark, [f"{d}/customer.parquet", f"{d}/supplier.parquet"])
    cust = cust.select(F.col("c_custkey").alias(" KEY"), F.col("c_name").alias("Name "),
                       F.col("c_acctbal").alias("ACCT BAL"), "source_file")
    supp = supp.select(F.col("s_suppkey").alias("Key"), F.col("s_name").alias(" name"),
                       F.col("s_acctbal").alias("Acct Bal "), F.col("s_nationkey").alias("NATION"), "source_file")
    return merge([cust, supp], lower=True)


@query("merge_type_widen", """
select cast(n_nationkey as bigint) as key, n_name as label from nation
union all select s_suppkey as key, cast(s_nationkey as varchar) as label from supplier
union all select cast(r_regionkey as bigint) as key, r_name as label from region
""")
def merge_type_widen(spark, d):
    nation = _t(spark, d, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("label"))
    supp = _t(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("label"))
    region = _t(spark, d, "region").select(F.col("r_regionkey").alias("key"), F.col("r_name").alias("label"))
    return union_by_name([nation, supp, region])


@query("merge_sheets_with_source", f"""
select {LINE_KEY_SQL}, l_quantity, null::varchar as o_orderstatus, 'lineitem.parquet' as source_file, l_returnflag as source_sheet
from lineitem
union all
select o_orderkey, null, null, null, o_totalprice, o_orderstatus, 'orders.parquet', o_orderpriority from orders
""")
def merge_sheets_with_source(spark, d):
    def tagged(name, sheet_col, columns):
        book = H.as_sheets(tag_source(_t(spark, d, name).selectExpr(*columns, sheet_col)), sheet_col, order_by=None)
        return book.withColumn("source_sheet", F.col("sheet")).drop("sheet", "sheet_pos", "row_pos", sheet_col)

    lines = tagged("lineitem", "l_returnflag", [*LINE_KEY, "l_quantity"])
    orders = tagged("orders", "o_orderpriority", ["o_orderkey as L_ORDERKEY", "o_totalprice as ` l_quantity `", "o_orderstatus"])
    return merge([lines, orders], lower=True)


@query("merge_json_keep_case", """
select c_custkey as "Key", c_name as "Name", c_acctbal as balance, null::varchar as "Segment", 'customer.parquet' as source_file from customer
union all select s_suppkey, s_name, null, 'supplier', 'supplier.parquet' from supplier
""")
def merge_json_keep_case(spark, d):
    """U4: names keep their case; a name that differs only in case is refused."""
    a = tag_source(_t(spark, d, "customer").selectExpr("c_custkey as Key", "c_name as Name", "c_acctbal as balance"), "customer.parquet")
    b = tag_source(_t(spark, d, "supplier").selectExpr("s_suppkey as Key", "s_name as Name", "'supplier' as Segment"), "supplier.parquet")
    return merge([a, b], lower=False)


@query("merge_mixed", """
select cast(n_nationkey as varchar) as key, n_name as name, null::double as balance, 'nation.parquet' as source_file from nation
union all select cast(c_custkey as varchar), c_name, c_acctbal, 'customer.parquet' from customer
union all select 'R' || cast(r_regionkey as varchar), r_name, null, 'region.parquet' from region
""")
def merge_mixed(spark, d):
    """U6: inputs of different kinds: integer, long and text keys widen to text; names are lower-cased."""
    parts = [("nation", ["n_nationkey as Key", "n_name as ` Name`"]), ("customer", ["c_custkey as key", "c_name as NAME", "c_acctbal as balance"]),
             ("region", ["concat('R', cast(r_regionkey as string)) as key", "r_name as name"])]
    return merge([tag_source(_t(spark, d, t).selectExpr(*cols), f"{t}.parquet") for t, cols in parts], lower=True)


@query("infer_text_types", """
select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case when l_tax > 0.05 then l_tax end as l_tax,
       l_returnflag = 'R' as returned, l_linestatus || 'D' as status, cast(l_quantity as integer)::varchar || 'd' as suffixed
from lineitem
""")
def infer_text_types(spark, d):
    """S1: text columns become the narrowest type; NA texts become null; ``17d`` stays text."""
    li = _t(spark, d, "lineitem")
    text = li.select(*[F.col(c).cast("string").alias(c) for c in LINE_KEY], F.col("l_quantity").cast("string").alias("l_quantity"),
                     F.when(F.col("l_tax") > 0.05, F.col("l_tax").cast("string")).otherwise("N/A").alias("l_tax"),
                     F.when(F.col("l_returnflag") == "R", "True").otherwise("False").alias("returned"),
                     F.concat("l_linestatus", F.lit("D")).alias("status"),
                     F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("d")).alias("suffixed"))
    return infer_types(text.withColumn("l_tax", na_to_null(F.col("l_tax"))))


# ---------------------------------------------------------------- P1-P3
@query("split_parts", f"""
select {LINE_KEY_SQL}, (row_number() over (order by {LINE_KEY_SQL}) - 1) // 1000 + 1 as part from lineitem
""")
def split_parts(spark, d):
    return with_parts(_t(spark, d, "lineitem").select(*LINE_KEY), 1000, LINE_KEY)


@query("split_file_order", f"""
select {LINE_KEY_SQL}, row_idx, row_idx // 1000 + 1 as part
from (select *, row_number() over () - 1 as row_idx from lineitem)
""")
def split_file_order(spark, d):
    lines = read_ordered(spark, f"{d}/lineitem.parquet").select(*LINE_KEY, *ROW_ORDER)
    return with_parts(lines, 1000, ROW_ORDER, keep_index=True).drop(*ROW_ORDER)


@query("slice_file_order", f"""
select {LINE_KEY_SQL}, row_idx from (
  select *, row_number() over () - 1 as row_idx from (select * from lineitem where l_quantity > 20))
where row_idx between 300 and 2299
""")
def slice_file_order(spark, d):
    some = read_ordered(spark, f"{d}/lineitem.parquet").where("l_quantity > 20")
    return slice_rows(some, 300, 2299, ROW_ORDER, keep_index=True).select(*LINE_KEY, "row_idx")


@query("slice_indexed_table", f"""
select {LINE_KEY_SQL}, row_idx from (select *, row_number() over (order by {LINE_KEY_SQL}) - 1 as row_idx from lineitem)
where row_idx between 1200 and 3499
""")
def slice_indexed_table(spark, d):
    path = f"{checkpoint_dir(spark)}/indexed-{uuid.uuid4().hex}"
    table = IndexedTable.build(_t(spark, d, "lineitem").select(*LINE_KEY), path, LINE_KEY, rows_per_zone=1000)
    return table.slice(1200, 3499)


@query("split_part_sizes", f"""
select part, count(*) as rows from (
  select (row_number() over (order by {LINE_KEY_SQL}) - 1) // 1000 + 1 as part from lineitem)
group by part
""")
def split_part_sizes(spark, d):
    return part_sizes(with_parts(_t(spark, d, "lineitem").select(*LINE_KEY), 1000, LINE_KEY))


@query("split_per_sheet", f"""
select l_returnflag, {LINE_KEY_SQL},
       (row_number() over (partition by l_returnflag order by {LINE_KEY_SQL}) - 1) // 5000 + 1 as part
from lineitem
""")
def split_per_sheet(spark, d):
    src = _t(spark, d, "lineitem").select("l_returnflag", *LINE_KEY)
    return with_parts(src, 5000, LINE_KEY, partition_by=["l_returnflag"])


# ---------------------------------------------------------------- H1-H7
def _line_book(spark, d):
    src = _t(spark, d, "lineitem").select("l_returnflag", *LINE_KEY)
    return H.as_sheets(src, "l_returnflag", order_by=LINE_KEY).drop("l_returnflag")


_BOOK_SQL = f"""
with book as (
  select l_returnflag as sheet, cast(dense_rank() over (order by l_returnflag) - 1 as integer) as sheet_pos,
         row_number() over (partition by l_returnflag order by {LINE_KEY_SQL}) - 1 as row_pos,
         {LINE_KEY_SQL} from lineitem)"""


@query("sheets_combine", _BOOK_SQL + f"""
select 'All' as sheet, 0 as sheet_pos, row_number() over (order by sheet_pos, row_pos) - 1 as row_pos,
       {LINE_KEY_SQL} from book
""")
def sheets_combine(spark, d):
    return H.combine(_line_book(spark, d), "All")


@query("sheets_combine_filtered", _BOOK_SQL + f"""
select 'Odd' as sheet, 0 as sheet_pos, row_number() over (order by sheet_pos, row_pos) - 1 as row_pos,
       {LINE_KEY_SQL} from book where l_orderkey % 2 = 1
""")
def sheets_combine_filtered(spark, d):
    """A filter leaves gaps in the positions; they are closed before sheets are combined."""
    return H.combine(H.renumber(_line_book(spark, d).where("l_orderkey % 2 = 1")), "Odd")


@query("sheets_split", _BOOK_SQL + f""",
 idx as (select *, row_number() over (order by sheet_pos, row_pos) - 1 as i from book)
select 'Sheet_' || cast(i // 7000 + 1 as varchar) as sheet, cast(i // 7000 as integer) as sheet_pos,
       i - (i // 7000) * 7000 as row_pos, {LINE_KEY_SQL} from idx
""")
def sheets_split(spark, d):
    return H.split_to_sheets(_line_book(spark, d), 7000)


@query("sheets_rename", _BOOK_SQL + f"""
select case sheet when 'A' then 'Accepted' when 'N' then 'None' else 'Returned' end as sheet,
       sheet_pos, row_pos, {LINE_KEY_SQL} from book
""")
def sheets_rename(spark, d):
    return H.rename(_line_book(spark, d), ["Accepted", "None", "Returned"])


@query("sheets_reorder", _BOOK_SQL + f"""
select sheet, case sheet when 'R' then 0 when 'A' then 1 else 2 end as sheet_pos, row_pos, {LINE_KEY_SQL}
from book
""")
def sheets_reorder(spark, d):
    return H.reorder(_line_book(spark, d), ["R", "0", "N"])


@query("sheets_copy", _BOOK_SQL + """,
 target as (
  select o_orderstatus as sheet, dense_rank() over (order by o_orderstatus) - 1 as sheet_pos,
         row_number() over (partition by o_orderstatus order by o_orderkey) - 1 as row_pos,
         o_orderkey, o_custkey from orders)
select sheet, cast(sheet_pos as integer) as sheet_pos, row_pos, o_orderkey, o_custkey,
       null::bigint as l_orderkey, null::integer as l_linenumber, null::bigint as l_partkey,
       null::bigint as l_suppkey from target
union all
select sheet, case sheet when 'R' then 3 else 4 end as sheet_pos, row_pos, null::bigint, null::bigint,
       l_orderkey, l_linenumber, l_partkey, l_suppkey from book where sheet in ('R', 'A')
""")
def sheets_copy(spark, d):
    target = H.as_sheets(_t(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey"),
                         "o_orderstatus", order_by=["o_orderkey"]).drop("o_orderstatus")
    return H.copy(_line_book(spark, d), target, ["R", "0"])


@query("sheets_extract", _BOOK_SQL + f"""
select case sheet when 'R' then 'Sheet_2' else sheet end as sheet,
       case sheet when 'N' then 0 else 1 end as sheet_pos, row_pos, {LINE_KEY_SQL}
from book where sheet in ('N', 'R')
""")
def sheets_extract(spark, d):
    return H.extract_sheets(_line_book(spark, d), ["N", "2"])


@query("sheets_first", _BOOK_SQL + f"""
select sheet, sheet_pos, row_pos, {LINE_KEY_SQL} from book where sheet_pos = 0
""")
def sheets_first(spark, d):
    return H.first_sheet(_line_book(spark, d))


@query("table_metadata", """
select 'Sheet1' as sheet_names, count(*) as row_count, 11 as column_count from lineitem
""")
def table_metadata(spark, d):
    meta = H.table_metadata(_t(spark, d, "lineitem"))
    return meta.select(F.array_join("sheet_names", ",").alias("sheet_names"), "row_count", "column_count")


@query("sheet_metadata", """
select l_returnflag as sheet, cast(dense_rank() over (order by l_returnflag) - 1 as integer) as sheet_pos,
       count(*) as row_count, 10 as column_count from lineitem group by l_returnflag
""")
def sheet_metadata(spark, d):
    book = H.as_sheets(_t(spark, d, "lineitem"), "l_returnflag", order_by=None).drop("l_returnflag")
    return H.sheet_metadata(book)


# ---------------------------------------------------------------- V1-V7
_SCHEMA_SRC = """case when o_orderstatus = 'P' then null else o_orderpriority end"""


@query("validate_schema_sets", f"""
with g as (
  select o_orderstatus,
         concat_ws(',', case when count(o_comment) > 0 then 'o_comment' end,
                        case when count(o_custkey) > 0 then 'o_custkey' end,
                        case when count(o_orderkey) > 0 then 'o_orderkey' end) as columns
  from (select o_orderstatus, o_orderkey, o_custkey, {_SCHEMA_SRC} as o_comment from orders)
  group by o_orderstatus)
select o_orderstatus, columns, (select count(distinct columns) from g) <= 1 as consistent from g
""")
def validate_schema_sets(spark, d):
    src = _t(spark, d, "orders").select("o_orderstatus", "o_orderkey", "o_custkey",
                                         F.expr(_SCHEMA_SRC).alias("o_comment"))
    out = V.column_sets_by_group(src, "o_orderstatus")
    return out.select("o_orderstatus", F.array_join("columns", ",").alias("columns"), "consistent")


_PROPS = "case when event_type = 'error' then substr(props, 2) else props end"


@query("validate_corrupt_json", f"""
select event_id, json_valid({_PROPS}) as is_json,
       coalesce(case when json_valid({_PROPS}) then json_type(({_PROPS})::json) = 'OBJECT' end, false) as is_object
from events
""")
def validate_corrupt_json(spark, d):
    src = _t(spark, d, "events").select("event_id", F.expr(_PROPS).alias("props"))
    checks = V.json_text_checks(F.col("props"))
    return src.select("event_id", checks["is_json"].alias("is_json"), checks["is_object"].alias("is_object"))


@query("validate_csv_shape", """
select doc_id, coalesce(regexp_matches(text, '\\S'), false) as non_blank,
       coalesce(contains(text, ','), false) as has_comma,
       coalesce(regexp_matches(text, '\\S'), false) and coalesce(contains(text, ','), false) as valid
from documents
""")
def validate_csv_shape(spark, d):
    src = _t(spark, d, "documents")
    checks = V.csv_text_checks(F.col("text"))
    return src.select("doc_id", *[e.alias(k) for k, e in checks.items()])


@query("validate_empty_inputs", """
select doc_id, length(text) as n_chars, coalesce(length(text) = 0, true) as is_empty from documents
""")
def validate_empty_inputs(spark, d):
    return V.empty_texts(_t(spark, d, "documents"), "text", keep=["doc_id"])


_SEGMENT = "regexp_extract(url, '([^/?#]+)(?:[?#].*)?$', 1) || '.html'"


@query("rename_manifest", f"""
with f as (select page_id, {_SEGMENT} as file_name,
                  row_number() over (order by page_id) - 1 as "index" from pages),
     n as (select *, regexp_replace(file_name, '\\.[^.]*$', '') || '_copy.' ||
                     regexp_extract(file_name, '[^.]*$', 0) as new_name from f)
select page_id, file_name, "index", new_name, regexp_matches(new_name, '^[A-Za-z0-9_.-]+$') as valid,
       count(*) over (partition by new_name) as same_name
from n
""")
def rename_manifest(spark, d):
    files = _t(spark, d, "pages").select("page_id", F.expr(_SEGMENT).alias("file_name"))
    return V.rename_manifest(files, "file_name", "{filename}_copy", order_by=["page_id"]).select(
        "page_id", "file_name", "index", "new_name", "valid", "same_name")
