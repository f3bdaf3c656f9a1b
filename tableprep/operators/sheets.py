"""Workbook operations (H1-H7) on a sheet-keyed DataFrame.

A workbook is one DataFrame with ``sheet`` (name), ``sheet_pos`` (0-based
position in the workbook), ``row_pos`` (0-based row within the sheet) and the
data columns, unioned by name.  Sheet-level decisions need the list of sheets,
which is tiny (a workbook holds at most a few thousand) and is checked against
``MAX_SHEETS`` before it is brought to the driver; it returns to the executors
as a broadcast mapping.  Row-level work stays distributed.

Rows cannot show a sheet that has none.  Operations that count sheets or take
them by position accept ``all_sheets``, the workbook's own list of (name,
position) as ``sources.xlsx.sheet_names`` reads it; without it, the sheets that
have rows count, at the positions they carry.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import TablePrepError
from .clean import data_columns
from .merge import union_by_name
from .order import MAX_BUCKETS, ROWS_PER_BUCKET, with_row_index

MAX_SHEETS = 10_000
SHEET_KEYS = ["sheet", "sheet_pos", "row_pos"]


def _mapping(spark, rows, schema: str) -> DataFrame:
    # built from a driver list of at most MAX_SHEETS entries: size is bounded
    return F.broadcast(spark.createDataFrame(rows, schema))


def sheet_list(sheets: DataFrame, all_sheets=None) -> list[tuple[str, int]]:
    """``[(name, pos), ...]`` in workbook order: ``all_sheets``, or the sheets with rows."""
    if all_sheets is not None:
        return sorted(((n, p) for n, p in all_sheets), key=lambda x: x[1])
    rows = sheets.select("sheet", "sheet_pos").distinct().limit(MAX_SHEETS + 1).collect()
    if len(rows) > MAX_SHEETS:
        raise TablePrepError(f"more than {MAX_SHEETS} sheets")
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: x[1])


def as_sheets(df: DataFrame, sheet_col: str, order_by, sheet_order=None) -> DataFrame:
    """View a table as a workbook: one sheet per value of ``sheet_col``.

    Sheet positions follow ``sheet_order`` or the sorted names; ``row_pos``
    follows ``order_by`` within each sheet.
    """
    spark = df.sparkSession
    # sheet names and the row total from one aggregate (one row per sheet)
    per_sheet = (df.groupBy(F.col(sheet_col).cast("string").alias("_tp_name")).count()
                 .limit(MAX_SHEETS + 1).collect())
    if len(per_sheet) > MAX_SHEETS:
        raise TablePrepError(f"more than {MAX_SHEETS} sheets")
    names = [r[0] for r in per_sheet]
    total = sum(r[1] for r in per_sheet)
    if None in names:
        raise TablePrepError(f"{sheet_col} is null in some rows: they belong to no sheet")
    ordered = list(sheet_order) if sheet_order else sorted(names)
    if set(names) - set(ordered):
        raise TablePrepError(f"sheets missing from sheet_order: {sorted(set(names) - set(ordered))}")
    mapping = _mapping(spark, [(n, i) for i, n in enumerate(ordered)], "sheet string, sheet_pos int")
    out = df.withColumn("sheet", F.col(sheet_col).cast("string")).join(mapping, "sheet", "inner")
    if order_by:
        # sheet and sheet_pos are 1:1; both as window keys let filters on either
        # one move below the window
        out = with_row_index(out, order_by, partition_by=["sheet", "sheet_pos"], index_col="row_pos",
                             total_rows=total)
    else:  # sheet-level work only: no row order needed, no shuffle
        out = out.withColumn("row_pos", F.lit(None).cast("long"))
    return out.select("sheet", "sheet_pos", "row_pos", *[c for c in df.columns if c not in SHEET_KEYS])


def renumber(sheets: DataFrame) -> DataFrame:
    """Close the gaps that a filter leaves in ``row_pos``.

    The positions themselves deal the rows into buckets of ``ROWS_PER_BUCKET`` places, so
    neither a count nor a sample of them is needed.  One aggregate counts the rows of each
    bucket; the numbers of rows before each are an array a sheet, broadcast.  They join by
    sheet alone: what only counts the sheets' rows (``combine``) never makes ``row_pos``."""
    keys = [k for k in ("_pos_file",) if k in sheets.columns] + ["sheet", "sheet_pos"]
    data = sheets.withColumn("_tp_bucket", F.floor(F.col("row_pos") / ROWS_PER_BUCKET).cast("long"))
    counts = data.groupBy(*keys, "_tp_bucket").count().limit(MAX_BUCKETS + 1).collect()
    held = [r[-2] for r in counts]
    if len(counts) > MAX_BUCKETS or None in held or any(None in r[:-2] for r in counts) or held and max(held) - min(held) >= MAX_BUCKETS:
        out = with_row_index(sheets, ["row_pos"], partition_by=keys, index_col="_tp_row")
        return out.withColumn("row_pos", F.col("_tp_row")).select(sheets.columns)
    low, before = min(held, default=0), {}
    for *key, bucket, n in sorted(tuple(r) for r in counts):
        run, total = before.setdefault(tuple(key), ([], [0]))
        run += [total[0]] * (bucket - low + 1 - len(run))
        total[0] += n
    kinds = {f.name: f.dataType.simpleString() for f in sheets.schema.fields}
    table = _mapping(sheets.sparkSession, [(*k, run) for k, (run, _) in before.items()],
                     ", ".join(f"{k} {kinds[k]}" for k in keys) + ", _tp_before array<long>")
    within = Window.partitionBy(*keys, "_tp_bucket").orderBy("row_pos")
    start = F.element_at("_tp_before", (F.col("_tp_bucket") - low + 1).cast("int"))
    out = (data.join(table, keys, "inner").withColumn("_tp_start", start).drop("_tp_before")
           .withColumn("row_pos", (F.col("_tp_start") + F.row_number().over(within) - 1).cast("long")))
    return out.select(sheets.columns)


def _combined(sheets: DataFrame) -> DataFrame:
    """Index in the combined order (workbook, sheet_pos, row_pos).

    ``row_pos`` is dense within each sheet, so the index is the sheet's
    offset (rows in earlier sheets) plus ``row_pos``: one count per sheet --
    Catalyst prunes the row-order work from that aggregate -- and a
    projection, no second ordering pass.  Distinct positions with a gap must
    reach beyond the sheet's row count, so gaps are met while the rows go by and
    raise; ``renumber`` closes them.
    """
    keys = [k for k in ("_pos_file",) if k in sheets.columns] + ["sheet_pos"]
    counts = sheets.groupBy(*keys).count().limit(MAX_SHEETS + 1).collect()
    if len(counts) > MAX_SHEETS:
        raise TablePrepError(f"more than {MAX_SHEETS} sheets")
    rows, run = [], 0
    for *key, n in sorted(tuple(r) for r in counts):
        rows.append((*key, run, n))
        run += n
    offsets = _mapping(sheets.sparkSession, rows, ", ".join(f"{k} int" for k in keys) + ", _tp_off long, _tp_n long")
    out = sheets.join(offsets, keys, "inner")
    gap = F.raise_error(F.concat(F.lit("row positions have gaps in sheet "), F.col("sheet"), F.lit(": use renumber first")))
    index = F.when(F.col("row_pos") < F.col("_tp_n"), F.col("_tp_off") + F.col("row_pos")).otherwise(gap.cast("long"))
    return out.withColumn("_tp_idx", index).drop("_tp_off", "_tp_n")


def combine(sheets: DataFrame, target: str) -> DataFrame:
    """H1: all non-empty sheets become one sheet named ``target``."""
    if not target:
        raise TablePrepError("no target sheet name given")
    out = _combined(sheets)
    return out.select(
        F.lit(target).alias("sheet"), F.lit(0).alias("sheet_pos"), F.col("_tp_idx").alias("row_pos"),
        *data_columns(sheets),
    )


def split_to_sheets(sheets: DataFrame, rows_per_sheet: int) -> DataFrame:
    """H2: combine, then ``Sheet_<k>`` holds rows k*n .. k*n+n-1 (k from 1)."""
    if not rows_per_sheet or int(rows_per_sheet) <= 0:
        raise TablePrepError("rows_per_sheet must be at least 1")
    n = int(rows_per_sheet)
    out = _combined(sheets)
    part = F.floor(F.col("_tp_idx") / n).cast("long")
    return out.select(
        F.format_string("Sheet_%d", part + 1).alias("sheet"),
        part.cast("int").alias("sheet_pos"),
        (F.col("_tp_idx") - part * n).alias("row_pos"),
        *data_columns(sheets),
    )


def _check_name(name) -> None:
    if not name or not isinstance(name, str) or len(name) > 31:
        raise TablePrepError(f"Invalid sheet name: {name}")


def rename(sheets: DataFrame, new_names: list[str], all_sheets=None) -> DataFrame:
    """H3: new names by position; counts must match; 1-31 characters; unique."""
    if not new_names:
        raise TablePrepError("no new sheet names given")
    current = sheet_list(sheets, all_sheets)
    if len(new_names) != len(current):
        raise TablePrepError(f"{len(new_names)} new names for {len(current)} sheets")
    for n in new_names:
        _check_name(n)
    if len(set(new_names)) != len(new_names):
        raise TablePrepError("Sheet names must be unique")
    mapping = _mapping(sheets.sparkSession, [(pos, new) for (_, pos), new in zip(current, new_names)],
                       "sheet_pos int, _tp_new string")
    out = sheets.join(mapping, "sheet_pos", "inner")
    return out.select(F.col("_tp_new").alias("sheet"), "sheet_pos", "row_pos", *data_columns(sheets))


def _resolve(entry, names: list[str]):
    """A sheet by name, else a digit string as 0-based index."""
    if entry in names:
        return entry, False
    if isinstance(entry, str) and entry.isdigit() and int(entry) < len(names):
        return names[int(entry)], True
    if isinstance(entry, int) and 0 <= entry < len(names):
        return names[entry], True
    raise TablePrepError(f"no sheet is named or numbered {entry}")


def reorder(sheets: DataFrame, order: list, all_sheets=None) -> DataFrame:
    """H4: every sheet exactly once, by name or index."""
    if not order:
        raise TablePrepError("no sheet order given")
    names = [n for n, _ in sheet_list(sheets, all_sheets)]
    chosen = [_resolve(e, names)[0] for e in order]
    if len(chosen) != len(names) or set(chosen) != set(names):
        raise TablePrepError("the order must name every sheet, each once")
    mapping = _mapping(sheets.sparkSession, [(n, i) for i, n in enumerate(chosen)], "sheet string, _tp_pos int")
    out = sheets.join(mapping, "sheet", "inner")
    return out.select("sheet", F.col("_tp_pos").alias("sheet_pos"), "row_pos", *data_columns(sheets))


def copy(source: DataFrame, target: DataFrame, chosen: list, source_sheets=None, target_sheets=None) -> DataFrame:
    """H5: target's sheets first, then the chosen source sheets; a name that
    already exists in the target is refused."""
    if not chosen:
        raise TablePrepError("no sheets chosen")
    src_names = [n for n, _ in sheet_list(source, source_sheets)]
    tgt = sheet_list(target, target_sheets)
    picked = [_resolve(e, src_names)[0] for e in chosen]
    clash = sorted(set(picked) & {n for n, _ in tgt})
    if clash or len(set(picked)) != len(picked):
        raise TablePrepError(f"Sheet names already present: {clash or picked}")
    start = (max(p for _, p in tgt) + 1) if tgt else 0
    mapping = _mapping(source.sparkSession, [(n, start + i) for i, n in enumerate(picked)], "sheet string, _tp_pos int")
    moved = source.join(mapping, "sheet", "inner").drop("sheet_pos").withColumnRenamed("_tp_pos", "sheet_pos")
    return union_by_name([target, moved.select("sheet", "sheet_pos", "row_pos", *data_columns(source))])


def extract_sheets(sheets: DataFrame, chosen: list, all_sheets=None) -> DataFrame:
    """H6: chosen sheets in request order; a sheet picked by index is named
    ``Sheet_<index>``."""
    names = [n for n, _ in sheet_list(sheets, all_sheets)]
    rows = []
    for i, e in enumerate(chosen):
        name, by_index = _resolve(e, names)
        rows.append((name, f"Sheet_{e}" if by_index else name, i))
    if len({r[0] for r in rows}) != len(rows):
        raise TablePrepError("a sheet is requested twice")
    mapping = _mapping(sheets.sparkSession, rows, "sheet string, _tp_new string, _tp_pos int")
    out = sheets.join(mapping, "sheet", "inner")
    return out.select(F.col("_tp_new").alias("sheet"), F.col("_tp_pos").alias("sheet_pos"), "row_pos",
                      *data_columns(sheets))


def first_sheet(sheets: DataFrame) -> DataFrame:
    """H7: the sheet at position 0, as a plain table."""
    return sheets.where(F.col("sheet_pos") == 0)


def sheet_metadata(sheets: DataFrame) -> DataFrame:
    """V6 per sheet: name, position, rows, data columns."""
    ncols = len(data_columns(sheets))
    return sheets.groupBy("sheet", "sheet_pos").agg(
        F.count(F.lit(1)).alias("row_count"), F.lit(ncols).alias("column_count")
    )


def table_metadata(df: DataFrame) -> DataFrame:
    """V6 for a plain table: one sheet named ``Sheet1``."""
    ncols = len(data_columns(df))
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.array(F.lit("Sheet1")).alias("sheet_names"), "row_count", F.lit(ncols).alias("column_count")
    )


__all__ = [
    "as_sheets", "combine", "split_to_sheets", "rename", "reorder", "copy", "extract_sheets",
    "first_sheet", "sheet_metadata", "table_metadata", "sheet_list", "renumber",
]
