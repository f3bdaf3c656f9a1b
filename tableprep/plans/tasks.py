"""Task specs -> one composed plan (C10 clean, extract).

A spec is the plain dict the reference's form produces.  Steps always run in
the fixed order below, whatever the order of keys.  ``True`` and ``{}`` mean
"with defaults" for every step.
"""
from __future__ import annotations

from pyspark.sql import DataFrame

from ..errors import TablePrepError
from ..functions.predicates import Cond, where, where_sql
from ..operators import clean as C
from ..operators.order import file_order_columns, slice_rows, with_row_index

CLEAN_STEPS = (
    "remove_empty_rows",
    "remove_empty_columns",
    "remove_duplicates",
    "replace_nulls",
    "trim_whitespace",
    "standardize_columns",
    "change_data_types",
    "apply_formulas",
    "normalize_dates",
)


def _opts(value) -> dict | None:
    """None when the step is off, else its options (True / {} -> defaults)."""
    if value is None or value is False:
        return None
    if value is True:
        return {}
    if isinstance(value, dict):
        return value
    raise TablePrepError(f"step options must be an object, got {value!r}")


def clean(df: DataFrame, tasks: dict, order_by=None, numeric_fill: str = "auto") -> DataFrame:
    """Apply C1..C9 from one spec.

    Only ``remove_empty_columns`` (schema depends on data) and a text
    ``replace_nulls`` over numeric columns (which of them hold nulls) run a
    pass over the data before the result is returned; all else stays lazy.
    """
    unknown = set(tasks) - set(CLEAN_STEPS)
    if unknown:
        raise TablePrepError(f"Unknown clean tasks: {sorted(unknown)}")
    if (o := _opts(tasks.get("remove_empty_rows"))) is not None:
        df = C.drop_empty_rows(df)
    if (o := _opts(tasks.get("remove_empty_columns"))) is not None:
        df = C.drop_empty_columns(df)
    before_dedupe = None
    if (o := _opts(tasks.get("remove_duplicates"))) is not None:
        before_dedupe = df
        df = C.dedupe(df, o.get("columns"), order_by=o.get("order_by", order_by), keep=o.get("keep", "first"))
    if (o := _opts(tasks.get("replace_nulls"))) is not None:
        df = C.fill_nulls(df, o.get("value", ""), o.get("columns"), numeric=o.get("numeric", numeric_fill),
                          precheck=before_dedupe)
    if (o := _opts(tasks.get("trim_whitespace"))) is not None:
        df = C.trim_whitespace(df, o.get("columns"))
    if (o := _opts(tasks.get("standardize_columns"))) is not None:
        df = C.standardize_columns(df, o.get("format", "lowercase_underscore"))
    if (o := _opts(tasks.get("change_data_types"))) is not None:
        df = C.cast_columns(df, o)
    if (o := _opts(tasks.get("apply_formulas"))) is not None:
        df = C.apply_formulas(df, o)
    if (o := _opts(tasks.get("normalize_dates"))) is not None:
        if "column" not in o:
            raise TablePrepError("normalize_dates needs a column")
        df = C.normalize_dates(df, o["column"], o.get("format", "%Y-%m-%d"), o.get("input_formats"),
                               per=o.get("per", "value"), order_by=o.get("order_by", order_by))
    return df


INDEX = "index"


def _condition(df: DataFrame, cond, allow_sql: bool) -> DataFrame:
    if cond is None or cond == "":
        return df
    if isinstance(cond, str):
        return where_sql(df, cond, trusted=allow_sql)
    return where(df, cond)


def _uses_index(df: DataFrame, *conds) -> bool:
    return INDEX not in df.columns and any(isinstance(x, Cond) and INDEX in x.refs for x in conds)


def extract(df: DataFrame, tasks: dict, order_by=None, allow_sql: bool = False) -> DataFrame:
    """F1 slice -> F2 filter -> F3 projection -> F4 filter, as one plan.

    Conditions are ``Cond`` objects (two-valued logic) or triples; SQL text
    only with ``allow_sql=True``.  The second filter sees projected columns
    only.  ``c("index")`` (F2j) is the row's position in the *input*, as
    pandas keeps the original labels through a slice: when a condition uses
    it, the index is computed once on the input, the slice reuses it, and it
    is dropped at the end.
    """
    rows = _opts(tasks.get("extract_rows_by_index"))
    first = _opts(tasks.get("extract_rows_by_condition"))
    cols = _opts(tasks.get("extract_columns"))
    second = _opts(tasks.get("apply_filter"))
    order = order_by or file_order_columns(df)
    with_index = _uses_index(df, (first or {}).get("condition"), (second or {}).get("condition"))
    if rows is not None:
        df = slice_rows(df, rows.get("start"), rows.get("end"), order, keep_index=with_index, index_col=INDEX)
    elif with_index:
        df = with_row_index(df, order, index_col=INDEX)
    if first is not None:
        df = _condition(df, first.get("condition"), allow_sql)
    if cols is not None and cols.get("columns"):
        names = list(cols["columns"])
        missing = [c for c in names if c not in df.columns]
        if missing:
            raise TablePrepError(f"no such columns: {missing}")
        df = df.select(*[f"`{c}`" for c in names + ([INDEX] if with_index and INDEX not in names else [])])
    if second is not None:
        df = _condition(df, second.get("condition"), allow_sql)
    return df.drop(INDEX) if with_index else df


__all__ = ["clean", "extract", "CLEAN_STEPS", "Cond"]
