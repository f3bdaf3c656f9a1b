"""Ordered chunking (P1-P3): consecutive runs of n rows, numbered from 1."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TablePrepError
from .order import with_row_index


def with_parts(df: DataFrame, rows_per_part: int, order_by, partition_by=None,
               part_col: str = "part", keep_index: bool = False, index_col: str = "row_idx") -> DataFrame:
    """``part = index // n + 1`` over the explicit order; with
    ``partition_by`` (sheets) numbering restarts in every group."""
    if rows_per_part is None or int(rows_per_part) <= 0:
        raise TablePrepError("rows_per_part must be at least 1")
    n = int(rows_per_part)
    out = with_row_index(df, order_by, partition_by=partition_by, index_col=index_col)
    out = out.withColumn(part_col, (F.floor(F.col(index_col) / F.lit(n)) + 1).cast("long"))
    return out if keep_index else out.drop(index_col)


def part_sizes(parts: DataFrame, part_col: str = "part", partition_by=None) -> DataFrame:
    keys = ([partition_by] if isinstance(partition_by, str) else list(partition_by or [])) + [part_col]
    return parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
