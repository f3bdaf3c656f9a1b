"""Conversion with its checks inside (K6 with V1-V4): the input is read once.

``check_inputs`` followed by ``convert`` scans every file for the checks, again for
the types and again for the rows.  Here one job reads the files: it counts what the checks
ask, parses the rows and stages them as Parquet, rows that don't fit beside the others.
Types are found, and the output is written, from the staged table.

What a check says of a file is one bit at the file's position: a bitmap of fixed size for
each check, built by an aggregate on the scan (``Observation``).  Setting a bit twice changes
nothing, so a task that runs again doesn't change a check.

Read more than once: the first line of each CSV file; CSV files with a line break inside quotes,
and JSON files over ``WHOLE_JSON`` bytes, whose records the splitting reader cuts.
"""
from __future__ import annotations

from dataclasses import dataclass, field
from uuid import uuid4

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError
from ..functions.text import WHITESPACE
from ..operators.merge import check_case, union_by_name
from ..operators.order import ROW_ORDER, typed_array
from ..operators.validate import json_text_checks
from ..session import checkpoint_dir
from ..sinks.writers import write
from ..sources.files import (Listed, csv_header, dedupe_header, first_lines, format_of, infer_json_schema, infer_types,
                             json_elements, list_files, na_to_null, read_csv, with_positions)

WHOLE_JSON = 64 << 20
BITMAP = 32_768  # file positions of one bitmap
KIND = "_tp_kind"

REJECTS = "source_file string, _pos_file int, _pos_block bigint, _pos_row bigint, text string, reason string"


@dataclass
class Checked:
    """What a checked conversion did: rows written, rows set aside, and the problem of each refused file."""

    rows: int = 0
    rejected: int = 0
    refused: dict[str, str] = field(default_factory=dict)


def file_flags(name: str, holds: Column, n_files: int) -> list[Column]:
    """Aggregates: the positions of the files with a row for which ``holds`` is true."""
    at = F.col("_pos_file")
    return [F.bitmap_construct_agg(F.when(holds & (at >= lo) & (at < lo + BITMAP), at - lo).cast("bigint")).alias(f"{name}:{lo}")
            for lo in range(0, n_files, BITMAP)]


def flagged(found: dict, name: str) -> set[int]:
    out: set[int] = set()
    for key, bits in found.items():
        what, _, lo = key.partition(":")
        if what == name and bits is not None:
            out |= {int(lo) + int(i) for i in np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little"))}
    return out


def convert_checked(spark: SparkSession, paths, out_path: str, input_format: str, output_format: str, *,
                    rejects: str | None = None, same_columns: bool = False) -> Checked:
    """Convert CSV or JSON files to ``output_format`` with all their checks.

    A file is refused that is empty, is no valid CSV (nothing but blanks, no comma, bytes that
    are no UTF-8) or holds no JSON array of objects; a CSV row is set aside that has more
    fields than its header.  Without ``rejects`` either raises, naming every refused file
    as ``check_inputs`` does, and nothing is written.  With it the other rows are
    converted, and the table at that path (Parquet) takes each row that was set aside, with its place
    and text, and a row for each refused file.  ``same_columns`` (V1) raises unless all
    files with rows have the same columns.

    Missing values and types are those of ``read_csv`` and ``read_json``.  In files with line
    breaks inside quotes, and in JSON files over ``WHOLE_JSON`` bytes, a row or element that
    doesn't fit raises even with ``rejects``.
    """
    if input_format not in ("csv", "json"):
        raise TablePrepError(f"checks inside the conversion are there for csv and json, not {input_format}")
    if input_format == output_format:
        raise TablePrepError(f"nothing to convert: input and output are both {input_format}")
    listed = list_files(spark, paths)
    wrong = [n for n in listed.names if format_of(n) != input_format]
    if wrong:
        raise TablePrepError(f"{wrong[0]} is not named like a {input_format} file")
    staging = f"{checkpoint_dir(spark)}/checked-{uuid4().hex}"
    try:
        return _run(spark, listed, staging, out_path, input_format, output_format, rejects, same_columns)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(staging)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _run(spark, listed: Listed, staging: str, out_path: str, input_format: str, output_format: str, rejects, same_columns) -> Checked:
    report = Checked(refused={n: f"{n} is empty" for n, size in zip(listed.names, listed.sizes) if not size})
    files = listed.distinct(lambda i: listed.sizes[i] > 0)
    if files:
        stage = _stage_csv if input_format == "csv" else _stage_json
        df, long, column_sets = stage(spark, listed, files, staging, report)
    if report.refused and rejects is None:
        raise TablePrepError("; ".join(sorted(report.refused.values())))
    if not files or df is None:
        raise TablePrepError("no rows to convert")
    if same_columns and len(column_sets()) > 1:
        raise TablePrepError("files do not all have the same columns")
    left_out = [i for i, n in enumerate(listed.names) if n in report.refused]
    if long is not None:
        if left_out:
            long = long.where(~F.col("_pos_file").isin(left_out))
        if rejects is None:
            first = long.orderBy(*ROW_ORDER).select("source_file", "reason").first()
            if first:
                raise TablePrepError(f"{first['reason']} in {first['source_file']}")
    if left_out:
        df = df.where(~F.col("_pos_file").isin(left_out))
    names = [c for c in df.columns if c not in (*ROW_ORDER, "source_file")]
    if input_format == "csv":
        df = infer_types(df, names)
    counted = Observation()
    out = df.select(*[F.col(f"`{c}`") for c in names]).observe(counted, F.count(F.lit(1)).alias("rows"))
    if df.isEmpty():
        raise TablePrepError("no rows to convert")
    write(out, out_path, "parquet" if output_format == "excel" else output_format)
    report.rows = counted.get["rows"]
    if rejects is not None:
        whole = [(n.rpartition("/")[2], i, None, None, None, report.refused[n]) for i, n in enumerate(listed.names) if n in report.refused]
        aside = spark.createDataFrame(whole, REJECTS)
        counted = Observation()
        if long is not None:
            aside = long.select(*aside.columns).observe(counted, F.count(F.lit(1)).alias("rows")).unionByName(aside)
        aside.write.mode("overwrite").parquet(rejects)
        report.rejected = counted.get["rows"] if long is not None else 0
    return report


def _placed_lines(spark: SparkSession, raw: DataFrame, listed: Listed) -> DataFrame:
    """(value, source_file, file order) of text files."""
    tagged = raw.select("value", F.col("_metadata.file_path").alias("_tp_path"), F.col("_metadata.file_block_start").alias("_pos_block"),
                        F.monotonically_increasing_id().alias("_pos_row"))
    return with_positions(spark, tagged, listed).withColumnRenamed("_tp_file", "source_file")


def _stage_csv(spark: SparkSession, listed: Listed, files: list[str], staging: str, report: Checked):
    """(rows as text, rows to set aside, the files' column sets) of the CSV files."""
    heads = first_lines(spark, listed, files)
    lines = list(dict.fromkeys(x for x in heads.values() if x is not None))
    headers = [dedupe_header(csv_header(x)) for x in lines]
    place = {x: i for i, x in enumerate(lines)}
    group = [place.get(heads.get(n)) for n in listed.names]
    width = max((len(h) for h in headers), default=0)

    at = F.col("_pos_file") + 1
    text = F.col("value")
    quotes = F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))
    raw = _placed_lines(spark, spark.read.text(files), listed)
    n = len(listed.names)
    checks, full = Observation(), F.length(F.btrim(text, F.lit(WHITESPACE))) > 0
    raw = raw.observe(checks, *file_flags("comma", text.contains(","), n), *file_flags("full", full, n),
                      *file_flags("bad", ~F.is_valid_utf8(text), n), *file_flags("open", quotes % 2 == 1, n))
    cells = [f"c{i}" for i in range(width + 1)]
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    rows = (raw.where(text.rlike(r"[^\x00-\x20]"))
            .withColumn("g", F.element_at(typed_array(group, T.IntegerType()), at))
            .withColumn("v", F.from_csv(text, ", ".join(f"{c} string" for c in cells), options)))
    # a first line may come again as a row, so it is told apart below, by its place
    head = (F.col("_pos_block") == 0) & (text == F.element_at(typed_array(lines, T.StringType()), F.col("g") + 1))
    beyond = F.element_at(F.array(*[F.col("v")[c] for c in cells]), F.element_at(typed_array([len(h) for h in headers], T.IntegerType()), F.col("g") + 1) + 1)
    kind = F.when(head, "head").when(beyond.isNotNull(), "long").otherwise("row")
    rows.select(kind.alias(KIND), "source_file", *ROW_ORDER, "g", F.when(kind == "long", text).alias("text"),
                *[na_to_null(F.col("v")[c]).alias(c) for c in cells[:width]]).write.partitionBy(KIND).parquet(f"{staging}/rows")
    found = checks.get
    good = (flagged(found, "comma") & flagged(found, "full")) - flagged(found, "bad")
    report.refused.update({p: f"{p} is not a valid CSV" for i, p in enumerate(listed.names) if listed.sizes[i] and i not in good})
    cut = sorted(flagged(found, "open") & good)
    if not good:
        return None, None, None

    schema = T.StructType([T.StructField(KIND, T.StringType()), T.StructField("source_file", T.StringType()),
                           T.StructField("_pos_file", T.IntegerType()), T.StructField("_pos_block", T.LongType()),
                           T.StructField("_pos_row", T.LongType()), T.StructField("g", T.IntegerType()),
                           *[T.StructField(c, T.StringType()) for c in ("text", *cells[:width])]])
    staged = spark.read.schema(schema).parquet(f"{staging}/rows")
    if cut:
        staged = staged.where(~F.col("_pos_file").isin(cut))
    first: list[int | None] = [None] * n
    for row in staged.where(F.col(KIND) == "head").groupBy("_pos_file").agg(F.min("_pos_row").alias("r")).collect():  # one a file
        first[row["_pos_file"]] = row["r"]
    lost = [listed.names[i] for i in good if first[i] is None and i not in cut]
    if lost:
        raise TablePrepError(f"no header found in the first split of {lost[:5]}")
    first_row = F.element_at(typed_array(first, T.LongType()), at)
    rows = staged.where((F.col(KIND) == "row") | ((F.col(KIND) == "head") & (F.col("_pos_row") > first_row)))
    width_of = F.element_at(typed_array([len(h) for h in headers], T.IntegerType()), F.col("g") + 1)
    long = staged.where(F.col(KIND) == "long").select("source_file", *ROW_ORDER, "text", F.concat(
        F.lit("a row has more than "), width_of.cast("string"), F.lit(" fields")).alias("reason"))

    used = sorted({group[i] for i in good if i not in cut})
    where: dict[str, dict[int, list[int]]] = {}
    for g in used:
        for i, name in enumerate(headers[g]):
            where.setdefault(name, {}).setdefault(i, []).append(g)
    check_case(spark, list(where))
    columns = []
    for name, by in where.items():
        if len(by) == 1 and len(next(iter(by.values()))) == len(used):
            columns.append(F.col(f"c{next(iter(by))}").alias(name))
        else:  # files have it in different places, or not at all
            columns.append(F.coalesce(*[F.when(F.col("g").isin(gs), F.col(f"c{i}")) for i, gs in by.items()]).alias(name))
    parts = [rows.select(*columns, rows["source_file"].alias("source_file"), *ROW_ORDER)] if used else []
    if cut:
        again = read_csv(spark, [listed.names[i] for i in cut], infer=False, multiline="detect")
        parts.append(again.withColumn("_pos_file", F.element_at(typed_array(cut, T.IntegerType()), at)))
    df = union_by_name(parts)

    def column_sets() -> set:
        held = {r[0] for r in df.select("_pos_file").distinct().collect()}  # one a file
        plain = {i: headers[group[i]] for i in held - set(cut)}
        more = {i: dedupe_header(csv_header(heads[listed.names[i]])) for i in held & set(cut)}
        return {frozenset(names) for names in (plain | more).values()}

    return df, long, column_sets


def _stage_json(spark: SparkSession, listed: Listed, files: list[str], staging: str, report: Checked):
    """(rows, nothing, the files' column sets) of the JSON files."""
    size = dict(zip(listed.names, listed.sizes))
    small, large = [f for f in files if size[f] <= WHOLE_JSON], [f for f in files if size[f] > WHOLE_JSON]
    n, refused, text = len(listed.names), set(), F.col("value")
    columns = ["source_file", *ROW_ORDER, "text"]
    if small:
        checks = Observation()
        raw = _placed_lines(spark, spark.read.option("wholetext", True).text(small), listed).withColumn(
            "ok", json_text_checks(text)["array_of_objects"])
        raw = raw.observe(checks, *file_flags("other", ~F.col("ok"), n))
        # what is not as it should be is staged too, as nothing: no filter may hide it from the checks
        elements = raw.select("source_file", "_pos_file", "_pos_block", F.posexplode(F.from_json(F.when(F.col("ok"), text), "array<string>")).alias("_pos_row", "text"))
        elements.withColumn("_pos_row", F.col("_pos_row").cast("bigint")).select(*columns).write.parquet(f"{staging}/elements")
        refused |= flagged(checks.get, "other")
    if large:
        checks = Observation()
        elements = json_elements(spark, large, listed).withColumn("keys", F.json_object_keys("text"))
        elements.observe(checks, *file_flags("other", F.col("keys").isNull(), n)).select(*columns).write.mode("append").parquet(f"{staging}/elements")
        refused |= flagged(checks.get, "other")
    report.refused.update({listed.names[i]: f"{listed.names[i]} must contain an array of objects" for i in refused})
    staged = spark.read.schema("source_file string, _pos_file int, _pos_block bigint, _pos_row bigint, text string").parquet(f"{staging}/elements")
    if refused:
        staged = staged.where(~F.col("_pos_file").isin(sorted(refused)))
    if staged.isEmpty():
        return None, None, None
    schema = infer_json_schema(spark, staged.select("text"))
    check_case(spark, schema.names)
    parsed = staged.withColumn("v", F.from_json("text", schema, {"mode": "FAILFAST"}))
    df = parsed.select(*[F.col("v").getField(c).alias(c) for c in schema.names if c.lower() != "source_file"], "source_file", *ROW_ORDER)

    def column_sets() -> set:
        keys = staged.select("_pos_file", F.explode(F.json_object_keys("text")).alias("k")).distinct()
        sets = keys.groupBy("_pos_file").agg(F.sort_array(F.collect_set("k")).alias("ks")).select("ks").distinct()
        return {frozenset(r[0]) for r in sets.limit(2).collect()}

    return df, None, column_sets
