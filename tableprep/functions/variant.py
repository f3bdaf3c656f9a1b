"""Columns that hold values of several types, as VARIANT: numbers stay numbers beside text.

Every value keeps its own type.  Comparisons look at it by *views*: one typed column for each
kind of value, null for values of other kinds, so ``5`` never equals ``"5"``.  Missing are null,
the variant null and NaN, as in other columns.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_NESTED = (T.ArrayType, T.MapType, T.StructType)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_TIMES = (T.DateType, T.TimestampType, T.TimestampNTZType)
KINDS = ("whole", "number", "text", "truth", "time")


def is_variant(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.VariantType)


def to_variant(col: Column, dtype: T.DataType) -> Column:
    """The same values as variants; null stays null."""
    if is_variant(dtype):
        return col
    return F.to_variant_object(col) if isinstance(dtype, _NESTED) else col.cast(T.VariantType())


def views(col: Column, dtype: T.DataType) -> dict[str, Column]:
    """The kinds of value that ``col`` may hold, each as a typed column.  A whole number has
    both number views; as ``number`` it is a double."""
    if is_variant(dtype):
        kind = F.schema_of_variant(col)

        def of(like: str, as_type: str) -> Column:
            return F.when(kind.rlike(like), F.try_variant_get(col, "$", as_type))

        return {"whole": of("^BIGINT$", "bigint"), "number": of("^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "double"),
                "text": of("^STRING", "string"), "truth": of("^BOOLEAN$", "boolean"), "time": of("^(DATE|TIMESTAMP)", "timestamp")}
    if isinstance(dtype, _INTEGRAL):
        return {"whole": col.cast("bigint"), "number": col.cast("double")}
    if isinstance(dtype, T.NumericType):
        return {"number": col.cast("double")}
    if isinstance(dtype, T.BooleanType):
        return {"truth": col}
    if isinstance(dtype, _TIMES):
        return {"time": col.cast("timestamp")}
    return {"text": col} if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)) else {}


def compare(left: dict[str, Column], right: dict[str, Column], op) -> Column:
    """``op`` on the first kind that both sides hold; null where they share none.  Whole numbers
    are compared exactly, other numbers as doubles."""
    shared = [op(left[k], right[k]) for k in KINDS if k in left and k in right]
    return F.coalesce(*shared) if shared else F.lit(None).cast("boolean")


def missing(col: Column) -> Column:
    return col.isNull() | F.is_variant_null(col) | F.coalesce(F.isnan(views(col, T.VariantType())["number"]), F.lit(False))


def present(col: Column) -> Column:
    """``col`` with every missing value as null."""
    return F.when(~missing(col), col)


def key_of(col: Column) -> Column:
    """Something to group by (Spark does not group variants): equal for equal values, missing
    ones included.  ``1`` and ``1.0`` are equal; decimals and nested values go by their JSON text."""
    v = views(col, T.VariantType())
    kind = F.schema_of_variant(col)
    exact = F.when(~kind.rlike("^DECIMAL"), v["number"])
    whole = F.coalesce(v["whole"], F.when((exact == F.floor(exact)) & (F.abs(exact) < 2.0**62), exact.cast("bigint")))
    other = F.when(kind.rlike("^(DECIMAL|OBJECT|ARRAY|BINARY|INTERVAL|UUID)"), F.to_json(col))
    key = F.struct(whole.alias("whole"), F.when(whole.isNull(), exact).alias("number"), v["text"].alias("text"),
                   v["truth"].alias("truth"), v["time"].alias("time"), other.alias("other"))
    return F.when(~missing(col), key)


def map_text(col: Column, fn) -> Column:
    """``fn`` on the values that are text; the others stay."""
    text = views(col, T.VariantType())["text"]
    return F.when(text.isNotNull(), fn(text).cast(T.VariantType())).otherwise(col)
