"""tableprep: table preparation on Spark DataFrames.

Read many files with provenance, merge by column name, clean with a fixed
nine-step spec, filter with pandas-style null logic, slice and chunk by an
explicit row order, treat workbooks as sheet-keyed tables, validate, and
write partitioned datasets.
"""
from .errors import TablePrepError
from .functions.predicates import c, where
from .operators.clean import (apply_formulas, cast_columns, dedupe, drop_empty_columns, drop_empty_rows,
                              fill_nulls, normalize_dates, standardize_columns, trim_whitespace)
from .operators.merge import merge, union_by_name
from .operators.order import slice_rows, with_row_index
from .operators.split import part_sizes, with_parts
from .plans.tasks import clean, extract

__all__ = [
    "TablePrepError", "c", "where", "apply_formulas", "cast_columns", "dedupe", "drop_empty_columns",
    "drop_empty_rows", "fill_nulls", "normalize_dates", "standardize_columns", "trim_whitespace", "merge",
    "union_by_name", "slice_rows", "with_row_index", "part_sizes", "with_parts", "clean", "extract",
]
