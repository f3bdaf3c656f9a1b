"""Convert (K6), batch convert (K7) and batch clean (K8) as single jobs.

A batch is one multi-file read; per-file outputs are partition directories
``file_pos=<i>``, written once for every distinct set of columns among the files,
not once a file.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TablePrepError
from ..functions.text import standard_name
from ..operators.clean import data_columns
from ..operators.order import ROW_ORDER
from ..operators.split import with_parts
from ..sinks.named import NamedOutput
from ..sinks.writers import write
from ..sources.files import csv_header, dedupe_header, first_lines, format_of, list_files, read_files
from .tasks import clean

_OUT = {"excel": "parquet", "csv": "csv", "json": "json", "xml": "xml", "parquet": "parquet"}


def _in_format(kind: str) -> str:
    return {"excel": "xlsx"}.get(kind, kind)


def convert(spark: SparkSession, paths, out_path: str, input_format: str, output_format: str) -> DataFrame:
    """K6: read (sheets of a workbook unioned) and write in another format.

    Excel output is not produced (one workbook is one zip from one process):
    it is written as Parquet.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    if input_format == output_format:
        raise TablePrepError(f"nothing to convert: input and output are both {input_format}")
    for p in paths:
        if format_of(p) != _in_format(input_format):
            raise TablePrepError(f"{p} is not named like a {input_format} file")
    df = read_files(spark, paths)
    df = df.drop(*[c for c in ("sheet_pos", "row_pos", "source_sheet") if c in df.columns])
    if df.isEmpty():  # one limit(1) probe
        raise TablePrepError(f"no rows to convert in {paths}")
    write(df.drop("source_file"), out_path, _OUT[output_format])
    return df


HELPERS = ("sheet_pos", "row_pos", "source_sheet", "source_file")


def column_sets(spark: SparkSession, df: DataFrame, paths, names: list[str], *, by_header: bool) -> dict[tuple, list[int]]:
    """``{columns: [file position, ...]}``: what each file itself has of ``names``.

    CSV files say it in their header; of other formats a column belongs to a file
    that holds a value in it -- one aggregate for all files, one row each."""
    listed = list_files(spark, paths)
    own: dict[int, list] = {}
    if by_header and all(format_of(n) == "csv" for n in listed.names):
        lines = first_lines(spark, listed, listed.distinct(lambda i: listed.sizes[i] > 0))
        own = {i: dedupe_header(csv_header(lines[n])) for i, n in enumerate(listed.names) if lines.get(n) is not None}
    else:
        held = [F.max(F.col(f"`{c}`").isNotNull()).alias(f"c{i}") for i, c in enumerate(names)]
        for row in df.groupBy("_pos_file").agg(*held).collect():
            own[row["_pos_file"]] = [c for i, c in enumerate(names) if row[f"c{i}"]]
    sets: dict[tuple, list[int]] = {}
    for at, have in sorted(own.items()):
        sets.setdefault(tuple(c for c in have if c in names), []).append(at)
    return sets


def _write_sets(df: DataFrame, sets: dict[tuple, list[int]], out_path: str, fmt: str, named: str | None = None) -> None:
    """One write for each distinct set of columns, partitioned by ``file_pos``; with ``named``
    one file ``<named>_<i>`` for each input file instead, from 0."""
    if named is not None:
        order = [c for c in ROW_ORDER if c in df.columns]
        with NamedOutput(df.sparkSession, out_path) as out:
            for columns, files in sets.items():
                if columns:
                    part = df.where(F.col("_pos_file").isin(files)).select(*[F.col(f"`{c}`") for c in columns], *order)
                    out.add(part.withColumn("file_pos", F.col("_pos_file")), fmt, ["file_pos"], order[1:], lambda i: f"{named}_{i}")
            out.publish(overwrite=True)
        return
    mode = "overwrite"
    for columns, files in sets.items():
        if columns:
            part = df.where(F.col("_pos_file").isin(files)).select(*[F.col(f"`{c}`") for c in columns], F.col("_pos_file").alias("file_pos"))
            write(part, out_path, fmt, partition_by="file_pos", mode=mode)
            mode = "append"


def split_files(spark: SparkSession, paths, out_path: str, rows_per_file: int, *, overwrite: bool = False) -> list[str]:
    """K5 over files: each input file's rows in consecutive runs of ``rows_per_file``, one file
    ``split_<name>_part_<n>`` each, of the input's format and columns.

    Rows are numbered per file in the map tasks where the reader's order allows it
    (``order.split_index``), then dealt out once, by part."""
    if rows_per_file is None or int(rows_per_file) <= 0:
        raise TablePrepError("rows_per_file must be at least 1")
    listed = list_files(spark, paths)
    formats = {format_of(n) for n in listed.names}
    if formats - {"csv", "json", "xml"} or len(formats) != 1:
        raise TablePrepError(f"files of one format (csv, json or xml) are split together, not {sorted(formats)}")
    (fmt,) = formats
    stems = [n.rpartition("/")[2] for n in listed.names]
    if len(set(stems)) < len(stems):
        raise TablePrepError("two input files have one name, so would their parts")
    df = read_files(spark, paths)
    names = [c for c in data_columns(df) if c not in HELPERS]
    parted = with_parts(df, rows_per_file, ROW_ORDER, partition_by=ROW_ORDER[:1], part_col="_tp_part")
    with NamedOutput(spark, out_path) as out:
        for columns, files in column_sets(spark, df, paths, names, by_header=True).items():
            if columns:
                part = parted.where(F.col("_pos_file").isin(files)).select(*[F.col(f"`{c}`") for c in columns], *ROW_ORDER, "_tp_part")
                part = part.withColumn("file_pos", F.col("_pos_file"))
                out.add(part, fmt, ["file_pos", "_tp_part"], ROW_ORDER[1:], lambda file, n: f"split_{stems[file]}_part_{n}")
        return out.publish(overwrite)


def batch_convert(spark: SparkSession, paths, out_path: str, input_format: str, output_format: str, *, named: bool = False) -> None:
    """K7: one read; every file keeps its own columns, in ``file_pos=<i>`` (``named``: as one
    file ``converted_<i>``, which one task writes)."""
    paths = list(paths)
    if input_format == output_format:
        raise TablePrepError(f"nothing to convert: input and output are both {input_format}")
    df = read_files(spark, paths)
    df = df.drop(*[c for c in HELPERS if c in df.columns])
    _write_sets(df, column_sets(spark, df, paths, data_columns(df), by_header=True), out_path, _OUT[output_format], "converted" if named else None)


def batch_clean(spark: SparkSession, paths, tasks: dict, out_path: str, output_format: str = "csv", *, named: bool = False) -> DataFrame:
    """K8 (``named``: as one file ``cleaned_<i>`` each): the same clean spec over every file, judged per file: duplicates (the
    file position joins the de-duplication key), empty columns, and the columns
    a file has at all.  ``standardize_columns`` renames, so it is applied to the
    column sets too."""
    paths = list(paths)
    df = read_files(spark, paths)
    tasks = dict(tasks)
    drop_empty = tasks.pop("remove_empty_columns", None) not in (None, False)
    dd = tasks.get("remove_duplicates")
    names = [c for c in data_columns(df) if c not in HELPERS]
    if dd:
        opts = dict(dd) if isinstance(dd, dict) else {}
        opts["columns"] = list(opts.get("columns") or names) + ["_pos_file"]
        tasks["remove_duplicates"] = opts
    sets = column_sets(spark, df, paths, names, by_header=not drop_empty)
    cleaned = clean(df, tasks)
    style = tasks.get("standardize_columns")
    renamed = {c: c for c in names}
    if style not in (None, False):
        kind = (style if isinstance(style, dict) else {}).get("format", "lowercase_underscore")
        renamed = {c: standard_name(c, kind) for c in names}
    added = [c for c in data_columns(cleaned) if c not in set(renamed.values()) and c not in HELPERS]
    sets = {tuple([renamed[c] for c in columns] + added): files for columns, files in sets.items()}
    _write_sets(cleaned, sets, out_path, _OUT[output_format], "cleaned" if named else None)
    return cleaned
