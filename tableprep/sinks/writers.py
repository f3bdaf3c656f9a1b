"""Sinks (K1-K8): partitioned datasets written by Spark tasks.

Outputs are directories of part files.  Helper columns (file order key) are
dropped.  Rows are written as the scan delivers them -- in order inside each
split, without a shuffle; an explicit ``order_by`` sorts them by a range exchange,
so that file names follow the order.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import TablePrepError
from ..functions.variant import is_variant
from ..operators.order import ROW_ORDER, file_order_columns

FORMATS = ("csv", "json", "xml", "parquet")


def _prepare(df: DataFrame, order_by=None, partition_by=None) -> DataFrame:
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    if order_by:
        df = df.orderBy(*parts, *order_by)
    return df.drop(*[c for c in ROW_ORDER if c in df.columns])


def write(df: DataFrame, path: str, fmt: str, *, mode: str = "overwrite", order_by=None,
          partition_by=None, compression: str | None = None, keep_absent_keys: bool = False) -> None:
    """K1-K3 (+K4 with ``compression``, K5/K7 with ``partition_by``).

    csv: header, RFC-4180 quoting, values written untrimmed (padding and
    newlines round-trip), null as empty, variants as their text.  json: JSON Lines with explicit
    nulls (``keep_absent_keys=True`` drops them, keeping keys absent), every value of a
    variant column by its own type.
    xml: ``<records><record><col>`` with empty elements for null.
    """
    fmt = fmt.lower()
    if fmt not in FORMATS:
        raise TablePrepError(f"{fmt} is none of the formats written: {FORMATS}")
    parts = [partition_by] if isinstance(partition_by, str) else list(partition_by or [])
    out = _prepare(df, order_by, parts)
    mixed = [c for c in out.columns if is_variant(out.schema[c].dataType)] if fmt == "csv" else []
    if mixed:  # CSV has text only
        out = out.withColumns({c: F.col(f"`{c}`").cast("string") for c in mixed})
    w = out.write.mode(mode)
    if parts:
        w = w.partitionBy(*parts)
    if compression:
        w = w.option("compression", compression)
    if fmt == "csv":
        bad = [c for c in out.columns if out.schema[c].dataType.typeName() in ("array", "map", "struct")]
        if bad:
            out = out.withColumns({c: F.to_json(c) for c in bad})
            w = out.write.mode(mode).partitionBy(*parts) if parts else out.write.mode(mode)
            if compression:
                w = w.option("compression", compression)
        (w.option("header", True).option("quote", '"').option("escape", '"')
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path))
    elif fmt == "json":
        w.option("ignoreNullFields", str(keep_absent_keys).lower()).json(path)
    elif fmt == "xml":
        bad = [c for c in out.columns if any(ch.isspace() for ch in c)]
        if bad:
            raise TablePrepError(f"XML element names cannot hold spaces: {bad}; standardize columns first")
        w.format("xml").option("rootTag", "records").option("rowTag", "record").option("nullValue", "").save(path)
    else:
        w.parquet(path)


def write_parts(df: DataFrame, path: str, fmt: str, rows_per_part: int, order_by, **kw) -> None:
    """K5: consecutive chunks of ``rows_per_part`` rows, one directory per
    ``part`` (numbered from 1) with one file in it, in order.

    One shuffle by part and a sort inside each task: a task has its parts whole, so
    nothing is sampled or sorted as a whole.  In file order it is the only shuffle."""
    from ..operators.split import with_parts

    order = list(order_by) if order_by else file_order_columns(df)
    parted = with_parts(df, rows_per_part, order).repartition("part").sortWithinPartitions("part", *order)
    write(parted, path, fmt, partition_by="part", **kw)
