"""Cleaning steps C1-C9 as DataFrame -> DataFrame functions.

Data columns are all columns except provenance (``source_file``,
``source_sheet``, ``file_pos``), sheet keys and the reader's order columns;
steps that look at "all columns" look at data columns only.
"""
from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError
from ..functions.text import (COLUMN_DATE_INPUTS, DEFAULT_DATE_INPUTS, WHITESPACE, is_integer, number, pattern_guard, standard_name,
                              strftime_to_spark)
from ..functions.variant import is_variant, key_of, map_text, missing as variant_missing, to_variant, views
from .order import ROW_ORDER, file_order_columns

META_COLUMNS = {"source_file", "source_sheet", "file_pos", "sheet", "sheet_pos", "row_pos", *ROW_ORDER}
_FLOATS = (T.FloatType, T.DoubleType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_NUMERIC = (T.NumericType,)


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in META_COLUMNS]


def _q(name: str) -> Column:
    return F.col(f"`{name}`")


def _missing(col: Column, dtype: T.DataType) -> Column:
    """pandas' notion of a missing value: null, or NaN for floats."""
    if is_variant(dtype):
        return variant_missing(col)
    if isinstance(dtype, _FLOATS):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def _require(df: DataFrame, cols) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise TablePrepError(f"no such columns: {missing}")


# C1 ---------------------------------------------------------------------
def drop_empty_rows(df: DataFrame, subset=None) -> DataFrame:
    """Drop rows whose data columns are all missing (null or NaN)."""
    cols = list(subset) if subset else data_columns(df)
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if any(is_variant(types.get(c)) for c in cols):  # na.drop doesn't look into variants
        return df.where(~reduce(lambda a, b: a & b, [_missing(_q(c), types[c]) for c in cols]))
    return df.na.drop(how="all", subset=cols) if cols else df


# C2 ---------------------------------------------------------------------
def empty_columns(df: DataFrame, subset=None) -> list[str]:
    """Data columns with no present value: one aggregate pass (an action)."""
    cols = list(subset) if subset else data_columns(df)
    if not cols:
        return []
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    aggs = [F.count(F.when(~_missing(_q(c), types[c]), F.lit(1))).alias(f"c{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).collect()[0]
    return [c for i, c in enumerate(cols) if row[f"c{i}"] == 0]


def drop_empty_columns(df: DataFrame, subset=None) -> DataFrame:
    empty = set(empty_columns(df, subset))
    return df.select(*[_q(c) for c in df.columns if c not in empty])


# C3 ---------------------------------------------------------------------
def dedupe(df: DataFrame, columns=None, order_by=None, keep: str = "first") -> DataFrame:
    """Keep the first (or last) row of every group of equal ``columns``.

    Nulls are equal to each other, as in pandas.  "First" follows
    ``order_by`` (default: the reader's file order).  The row is chosen with
    ``min_by(struct(rest), struct(order))`` per group: an aggregate with map-side partial
    aggregation, so a key holding a third of all rows is reduced in every map
    task before the shuffle instead of landing whole in one window task.
    Values of a variant column are equal by type and value (``variant.key_of``).
    """
    data_cols = data_columns(df)
    cols = data_cols if columns in (None, True) or columns == {} else list(columns)
    _require(df, cols)
    order = list(order_by) if order_by else file_order_columns(df)
    if keep not in ("first", "last"):
        raise TablePrepError(f"Unsupported keep: {keep}")
    variants = [f.name for f in df.schema.fields if f.name in cols and is_variant(f.dataType)]
    plain = [c for c in cols if c not in variants]
    stand_ins = {f"_tp_key{i}": key_of(_q(c)) for i, c in enumerate(variants)}
    if not order:
        if set(cols) >= set(data_cols):
            if variants:
                return df.withColumns(stand_ins).dropDuplicates(plain + list(stand_ins)).drop(*stand_ins)
            return df.dropDuplicates(cols)  # equal rows: any of them is "first"
        raise TablePrepError("order_by is required to keep the first row of a subset")
    _require(df, order)
    rest = [c for c in df.columns if c not in plain]
    payload = F.struct(*[_q(c) for c in rest])
    key = F.struct(*[_q(c) for c in order])  # compared; the payload may hold any type
    pick = F.min_by(payload, key) if keep == "first" else F.max_by(payload, key)
    grouped = df.groupBy(*[_q(c) for c in plain], *[k.alias(n) for n, k in stand_ins.items()]).agg(pick.alias("_tp_pick"))
    return grouped.select(*[_q(c) if c in plain else F.col(f"_tp_pick.`{c}`").alias(c) for c in df.columns])


# C4 ---------------------------------------------------------------------
def columns_with_missing(df: DataFrame, cols) -> set[str]:
    """Which of ``cols`` hold a missing value: one aggregate pass."""
    cols = list(cols)
    if not cols:
        return set()
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    aggs = [F.max(_missing(_q(c), types[c]).cast("int")).alias(f"m{i}") for i, c in enumerate(cols)]
    row = df.agg(*aggs).collect()[0]
    return {c for i, c in enumerate(cols) if row[f"m{i}"] == 1}


def _fill_one(col: Column, dtype: T.DataType, value, to_text: bool, mixed: bool = False) -> Column:
    missing = _missing(col, dtype)
    if is_variant(dtype) or (mixed and to_text):
        return F.when(missing, F.lit(value).cast(T.VariantType())).otherwise(to_variant(col, dtype))
    if isinstance(value, str) or to_text:
        if isinstance(dtype, T.StringType):
            return F.when(missing, F.lit(str(value))).otherwise(col)
        return F.when(missing, F.lit(_text(value))).otherwise(col.cast("string"))
    if isinstance(value, bool):
        return F.when(missing, F.lit(value).cast(dtype) if isinstance(dtype, T.BooleanType) else F.lit(value)).otherwise(col)
    if isinstance(dtype, _INTEGRAL) and isinstance(value, float) and not value.is_integer():
        return F.when(missing, F.lit(value)).otherwise(col.cast("double"))
    return F.when(missing, F.lit(value).cast(dtype)).otherwise(col)


def _text(value) -> str:
    return value if isinstance(value, str) else str(value)


def fill_nulls(df: DataFrame, value="", columns=None, numeric: str = "auto", precheck: DataFrame | None = None) -> DataFrame:
    """Replace missing values.

    ``value`` is a scalar for every data column or a dict per column; ``None``
    is refused.  A text value cannot live in a numeric column: with
    ``numeric="auto"`` the numeric columns that actually hold a missing value
    become text (found by one aggregate pass), as pandas turns them into mixed
    objects; ``numeric="variant"`` makes them variants instead, so that their
    numbers stay numbers beside the text; ``numeric="skip"`` leaves numeric columns alone and needs no
    pass.  In a variant column the value keeps its own type.  NaN counts as missing.  ``precheck`` is an upstream frame with a
    superset of the rows (before de-duplication): a column without missing
    values there has none here, so the pass over ``df`` -- which would re-run
    the upstream shuffle -- is needed only for the remaining columns.
    """
    if value is None:
        raise TablePrepError("value cannot be null")
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if isinstance(value, dict):
        _require(df, value.keys())
        plan = dict(value)
    else:
        cols = list(columns) if columns else data_columns(df)
        _require(df, cols)
        plan = {c: value for c in cols}
    if any(v is None for v in plan.values()):
        raise TablePrepError("value cannot be null")

    def mismatched(c, v):
        t = types[c]
        if isinstance(v, str):
            return not isinstance(t, T.StringType)
        if isinstance(v, (int, float)) and not isinstance(v, bool):
            return not isinstance(t, _NUMERIC)
        return False

    if numeric not in ("auto", "variant", "skip"):
        raise TablePrepError(f"numeric must be 'auto', 'variant' or 'skip', not {numeric!r}")
    candidates = [c for c, v in plan.items() if mismatched(c, v) and not isinstance(types[c], (T.ArrayType, T.MapType, T.StructType))]
    candidates = [c for c in candidates if not is_variant(types[c])]
    to_text: set[str] = set()
    if candidates and numeric != "skip":
        if precheck is not None and all(c in precheck.columns for c in candidates):
            candidates_left = sorted(columns_with_missing(precheck, candidates))
            to_text = columns_with_missing(df, candidates_left) if candidates_left else set()
        else:
            to_text = columns_with_missing(df, candidates)
    exprs = {}
    for c, v in plan.items():
        t = types[c]
        if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            continue
        if c in candidates and c not in to_text:
            continue
        exprs[c] = _fill_one(_q(c), t, v, c in to_text, numeric == "variant")
    return df.withColumns(exprs) if exprs else df


# C5 ---------------------------------------------------------------------
def trim_whitespace(df: DataFrame, columns=None) -> DataFrame:
    """Strip leading and trailing whitespace (every character str.strip()
    removes, tabs and newlines included) from text columns and from the text values of
    variant columns; null stays null."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = list(columns) if columns else [c for c in data_columns(df) if isinstance(types[c], (T.StringType, T.VariantType))]
    _require(df, cols)
    ws = F.lit(WHITESPACE)
    trim = lambda x: F.btrim(x, ws)
    return df.withColumns({c: map_text(_q(c), trim) if is_variant(types[c]) else trim(_q(c)) for c in cols}) if cols else df


# C6 ---------------------------------------------------------------------
def standardize_columns(df: DataFrame, style: str = "lowercase_underscore") -> DataFrame:
    mapping = {c: standard_name(c, style) for c in data_columns(df)}
    new_names = [mapping.get(c, c) for c in df.columns]
    seen: dict[str, str] = {}
    for old, new in zip(df.columns, new_names):
        if new in seen:
            raise TablePrepError(f"Columns {seen[new]!r} and {old!r} both become {new!r}")
        seen[new] = old
    return df.withColumnsRenamed({o: n for o, n in mapping.items() if o != n})


# C7 ---------------------------------------------------------------------
def to_int(col: Column, dtype: T.DataType, on_fraction: str = "null") -> Column:
    """Number parse to bigint; text like ``1e3`` is accepted, bad text gives
    null, a fractional value gives null (``on_fraction="null"``)."""
    if isinstance(dtype, _INTEGRAL):
        return col.cast("bigint")
    if isinstance(dtype, T.BooleanType):
        return col.cast("bigint")
    if is_variant(dtype):  # whole numbers and truth values as they are, the rest by its text
        v = views(col, dtype)
        return F.coalesce(v["whole"], v["truth"].cast("bigint"), to_int(col.try_cast("string"), T.StringType()))
    text = isinstance(dtype, T.StringType)
    d = number(col) if text else col.try_cast("double")
    whole = F.when((d == F.floor(d)) & ~F.isnan(d), d).try_cast("bigint")
    return F.coalesce(F.when(is_integer(col), col.try_cast("bigint")), whole) if text else whole


def _as_double(col: Column, dtype: T.DataType) -> Column:
    if is_variant(dtype):
        v = views(col, dtype)
        return F.coalesce(v["number"], v["truth"].cast("double"), number(v["text"]))
    return number(col) if isinstance(dtype, T.StringType) else col.try_cast("double")


def cast_columns(df: DataFrame, types_spec: dict, on_fraction: str = "null") -> DataFrame:
    """``{"col": "int" | "float" | "str"}``; bad values become null.

    ``on_fraction="error"`` refuses a fractional value in an int cast, which
    costs one counting pass.
    """
    _require(df, types_spec.keys())
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    exprs = {}
    for c, kind in types_spec.items():
        col, t = _q(c), types[c]
        if kind == "int":
            exprs[c] = to_int(col, t)
            if on_fraction == "error":
                d = _as_double(col, t)
                bad = df.where((d != F.floor(d)) & ~F.isnan(d)).limit(1).count()
                if bad:
                    raise TablePrepError(f"{c} holds values that are no whole numbers")
        elif kind == "float":
            d = _as_double(col, t)
            exprs[c] = F.nanvl(d, F.lit(None).cast("double"))  # NaN is pandas' missing value
        elif kind == "str":
            exprs[c] = col.cast("string")
        else:
            raise TablePrepError(f"cannot cast to {kind!r}: use int, float or str")
    return df.withColumns(exprs)


# C8 ---------------------------------------------------------------------
# Fixed value: the formula grammar.
_MUL = re.compile(r"^(\w+)\s*\*\s*(\d+)$")


def formula_column(df: DataFrame, formula: str) -> Column:
    """``uppercase(col)`` or ``col * n``."""
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    if formula.startswith("uppercase(") and formula.endswith(")"):
        src = formula[len("uppercase("):-1]
        _require(df, [src])
        return F.upper(_q(src).cast("string"))
    m = _MUL.match(formula)
    if m:
        src, mult = m.group(1), int(m.group(2))
        _require(df, [src])
        t = types[src]
        if isinstance(t, (_INTEGRAL + (T.BooleanType,))):
            return F.try_multiply(_q(src).cast("bigint"), F.lit(mult).cast("bigint"))  # beyond 64 bits: null
        if isinstance(t, T.NumericType):
            return F.try_multiply(_q(src), F.lit(mult))
        return (_as_double(_q(src), t) if is_variant(t) else number(_q(src))) * F.lit(mult)
    raise TablePrepError(f"formula not understood: {formula!r}")


def apply_formulas(df: DataFrame, formulas: dict) -> DataFrame:
    """New or overwritten columns, applied in the given order."""
    for new_col, formula in formulas.items():
        df = df.withColumn(new_col, formula_column(df, formula))
    return df


# C9 ---------------------------------------------------------------------
def parse_datetime(col: Column, dtype: T.DataType, input_formats=None) -> Column:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return col
    if not isinstance(dtype, T.StringType):
        raise TablePrepError("Date normalization needs a text or date column")
    fmts = list(input_formats) if input_formats else DEFAULT_DATE_INPUTS
    # a failed parse is expensive; a lenient shape test first skips hopeless ones
    return F.coalesce(*[F.when(col.rlike(pattern_guard(f)), F.try_to_timestamp(col, F.lit(f))) for f in fmts])


def column_date_format(df: DataFrame, column: str, order_by=None, input_formats=None, rule: str = "column") -> str | None:
    """The one input pattern that a text column is read by, or None if its first value has none.

    One aggregate, merged from every task's share of the rows: a bit for each pattern that all
    present values satisfy so far, and the first present value in row order.  ``rule``:
    ``"first"`` takes the first pattern of the list that the first value satisfies;
    ``"column"`` the first of those that every value satisfies as well, if there is one."""
    order = list(order_by) if order_by else file_order_columns(df)
    if not order:
        raise TablePrepError("the first value of a column needs a row order: pass order_by")
    _require(df, [column, *order])
    fmts, x = list(input_formats) if input_formats else COLUMN_DATE_INPUTS, _q(column)

    def fits(f: str, value: Column) -> Column:
        return F.coalesce(value.rlike(pattern_guard(f)) & F.try_to_timestamp(value, F.lit(f)).isNotNull(), F.lit(False))

    bits = [F.when(fits(f, x), F.lit(1 << i)).otherwise(F.lit(0)) for i, f in enumerate(fmts)]
    present = df.where(x.isNotNull() & (F.trim(x) != "")).select(
        x.alias("value"), F.struct(*[_q(c) for c in order]).alias("place"), reduce(lambda a, b: a.bitwiseOR(b), bits).alias("fits"))
    row = present.agg(F.min_by("value", "place").alias("first"), F.min_by("fits", "place").alias("first_fits"), F.bit_and("fits").alias("all_fit")).first()
    if row["first_fits"] is None:
        return None
    allowed = row["first_fits"] & row["all_fit"] if rule == "column" and row["first_fits"] & row["all_fit"] else row["first_fits"]
    return next((f for i, f in enumerate(fmts) if allowed >> i & 1), None)


def normalize_dates(df: DataFrame, column: str, fmt: str = "%Y-%m-%d", input_formats=None, output_col=None, *,
                    per: str = "value", order_by=None) -> DataFrame:
    """Parse with an ordered list of patterns and format with a strftime format; the
    result is text, null where the pattern doesn't fit.

    ``per="value"``: each value by the first pattern that fits it.  ``per="column"`` and
    ``per="first"``: the whole column by one pattern (``column_date_format``), so that a
    day-first column isn't read month first where both would do; the first value is
    that of ``order_by``, else of the readers' file order."""
    if per not in ("value", "column", "first"):
        raise TablePrepError(f"per is 'value', 'column' or 'first', not {per!r}")
    if column not in df.columns:
        raise TablePrepError(f"no column {column} to read dates from")
    dtype = dict((f.name, f.dataType) for f in df.schema.fields)[column]
    if per != "value" and isinstance(dtype, T.StringType):
        one = column_date_format(df, column, order_by, input_formats, per)
        if one is None:
            return df.withColumn(output_col or column, F.lit(None).cast("string"))
        input_formats = [one]
    parsed = parse_datetime(_q(column), dtype, input_formats)
    return df.withColumn(output_col or column, F.date_format(parsed, strftime_to_spark(fmt)))
