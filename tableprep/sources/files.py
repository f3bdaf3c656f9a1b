"""File sources (S1-S3, S5, S6): CSV, JSON and XML with provenance and order.

Every reader returns one DataFrame for many files with
``source_file`` (its name) and the order key
``_pos_file, _pos_block, _pos_row`` (position of the file in the request,
split start, position within the split), attached right after the scan so
that "file order" is an explicit, deterministic key.

Requested paths (files, directories, globs, on any file system Spark knows) are
listed once through Hadoop; each listed file is read once, and a file that is
requested twice gives its rows at both positions.  A file that is read but not
in the list stops the job: rows are never dropped for a path that looks
different.  Input that is not what it says it is -- broken JSON, a row longer than
its header, a truncated document -- raises.

Text formats are read as strings first; the NA set is mapped to null and the
narrowest type is chosen per column in one aggregate pass (``infer=True``),
or an explicit ``schema`` skips that pass.
"""
from __future__ import annotations

import csv
import io
import json
import os
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.errors import AnalysisException

from ..errors import TablePrepError
from ..functions.text import is_integer, number
from ..operators.merge import check_case, union_by_name
from ..operators.order import typed_array
from .records import CsvGrammar, JsonGrammar, XmlGrammar, later_heads, not_blank, records, scan, split_records

# The strings pandas reads as missing by default.
NA_VALUES = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
# The texts pandas reads as booleans.
TRUE_VALUES = ["True", "TRUE", "true"]
FALSE_VALUES = ["False", "FALSE", "false"]

FORMATS = {".csv": "csv", ".json": "json", ".xml": "xml", ".xlsx": "xlsx"}


def format_of(path: str) -> str:
    """S6: dispatch on the exact, lower-cased suffix."""
    ext = os.path.splitext(path)[1].lower()
    if ext == ".xls":
        raise TablePrepError("legacy .xls workbooks are not supported")
    if ext not in FORMATS:
        raise TablePrepError(f"{path} has none of the suffixes read: {sorted(FORMATS)}")
    return FORMATS[ext]


class Listed:
    """The files of a request, in its order: ``names[i]`` is the path Spark
    reports, ``sizes[i]`` its length; a path requested twice is there twice."""

    def __init__(self, names: list[str], encoded: list[str], sizes: list[int]):
        self.names, self.encoded, self.sizes, self._plain = names, encoded, sizes, None

    def plain(self, path: str) -> str:
        """The name of a file that Spark reports under its plain or its encoded path."""
        if self._plain is None:
            self._plain = dict(zip(self.encoded, self.names)) | {n: n for n in self.names}
        return self._plain[path]

    def distinct(self, keep=None) -> list[str]:
        return list(dict.fromkeys(n for i, n in enumerate(self.names) if keep is None or keep(i)))


def list_files(spark: SparkSession, paths) -> Listed:
    """Expand files, directories and globs through Hadoop's file systems;
    directories and globs in the order of their names."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    new_path = spark._jvm.org.apache.hadoop.fs.Path
    names, encoded, sizes = [], [], []
    for p in [paths] if isinstance(paths, str) else list(paths):
        path = new_path(p)
        fs = path.getFileSystem(conf)
        path = fs.makeQualified(path)
        # a name with glob characters that exists is that file
        found = [fs.getFileStatus(path)] if fs.exists(path) else list(fs.globStatus(path) or [])
        if not found:
            raise TablePrepError(f"no such file: {p}")
        for status in sorted(found, key=lambda x: x.getPath().toString()):
            files = [status]
            if status.isDirectory():
                files, walk = [], fs.listFiles(status.getPath(), True)
                while walk.hasNext():
                    files.append(walk.next())
                files.sort(key=lambda x: x.getPath().toString())
            for f in files:
                if not f.getPath().getName().startswith(("_", ".")):
                    names.append(f.getPath().toString())
                    encoded.append(new_path(f.getPath().toString()).toUri().toString())
                    sizes.append(f.getLen())
    return Listed(names, encoded, sizes)


def positions(spark: SparkSession, listed: Listed) -> DataFrame:
    """(path, name, _pos_file): where each file stands in the request, under the
    plain and the encoded form of its path.  Bounded: the caller's own list."""
    rows = {(form, both[0].rpartition("/")[2], i) for i, both in enumerate(zip(listed.names, listed.encoded)) for form in both}
    return F.broadcast(spark.createDataFrame(sorted(rows, key=lambda r: r[2]), "_tp_path string, _tp_file string, _pos_file int"))


def with_positions(spark: SparkSession, df: DataFrame, listed: Listed) -> DataFrame:
    """Add ``_tp_file`` (the plain name) and ``_pos_file`` by ``_tp_path``; a path outside the list raises."""
    joined = df.join(positions(spark, listed), "_tp_path", "left")
    known = F.col("_pos_file").isNotNull() | F.raise_error(
        F.concat(F.lit("file was read but not listed: "), F.col("_tp_path"))).isNotNull()
    return joined.where(known).drop("_tp_path")


def _with_order(spark: SparkSession, df: DataFrame, listed: Listed) -> DataFrame:
    """Attach provenance and the file-order key right after the scan."""
    df = df.drop("source_file")  # provenance overwrites a data column of that name
    tagged = df.select(
        "*",
        F.col("_metadata.file_path").alias("_tp_path"),
        F.col("_metadata.file_block_start").alias("_pos_block"),
        F.monotonically_increasing_id().alias("_pos_row"),
    )
    out = with_positions(spark, tagged, listed).withColumnRenamed("_tp_file", "source_file")
    return out.select(*[F.col(f"`{c}`") for c in df.columns], "source_file", "_pos_file", "_pos_block", "_pos_row")


def na_to_null(col: Column, na_values=NA_VALUES) -> Column:
    """Missing-value texts as null."""
    return F.when(col.isin(list(na_values)), F.lit(None).cast("string")).otherwise(col)


def infer_types(df: DataFrame, columns=None) -> DataFrame:
    """Narrowest of bigint, double, boolean, string per text column; numbers are
    written in decimal (``1D`` and ``0x1p3`` are text).

    One aggregate pass counts, per column, the present values that fail each
    candidate type (map-side partial aggregation, one row to the driver).
    """
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    cols = [c for c in (columns or df.columns) if isinstance(types.get(c), T.StringType)]
    if not cols:
        return df
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        present = x.isNotNull()
        aggs += [
            F.sum((present & (~is_integer(x) | x.try_cast("bigint").isNull())).cast("long")).alias(f"i{i}"),
            F.sum((present & number(x).isNull()).cast("long")).alias(f"d{i}"),
            F.sum((present & ~is_integer(x)).cast("long")).alias(f"f{i}"),
            F.sum((present & ~x.isin(TRUE_VALUES + FALSE_VALUES)).cast("long")).alias(f"b{i}"),
            F.count(x).alias(f"n{i}"),
        ]
    row = df.agg(*aggs).collect()[0]
    exprs = {}
    for i, c in enumerate(cols):
        x = F.col(f"`{c}`")
        if row[f"n{i}"] == 0:
            continue  # all missing: pandas would say float; text keeps it neutral
        if row[f"i{i}"] == 0:
            exprs[c] = x.try_cast("bigint")
        elif row[f"d{i}"] == 0 and row[f"f{i}"]:  # whole numbers beyond 64 bits stay text
            exprs[c] = number(x)
        elif row[f"b{i}"] == 0:
            exprs[c] = x.isin(TRUE_VALUES)
    return df.withColumns(exprs) if exprs else df


def dedupe_header(names: list[str]) -> list[str]:
    """pandas' rule for repeated headers: ``a, a.1, a.2``."""
    out: list[str] = []
    seen: dict[str, int] = {}
    for n in names:
        if n in seen:
            k = seen[n]
            cand = f"{n}.{k}"
            while cand in seen:
                k += 1
                cand = f"{n}.{k}"
            seen[n] = k + 1
            seen[cand] = 1
            out.append(cand)
        else:
            seen[n] = 1
            out.append(n)
    return out


HEADER_PROBES = 16
EXTRA = "_tp_extra"  # what a row has beyond its header


def first_line(spark: SparkSession, path: str) -> str | None:
    """First non-blank line of one file.  ``limit(1)`` runs as a collect-limit
    that reads the first split and stops at the first match: bytes, not the
    file."""
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0).limit(1).collect()
    return rows[0][0] if rows else None


def first_lines(spark: SparkSession, listed: Listed, paths: list[str]) -> dict[str, str | None]:
    """The first non-blank line of every file.

    A few files are probed by one tiny job each, which reads bytes, not the file.  More
    than ``HEADER_PROBES`` take one job together: the lines of their first splits pass a
    task that keeps one a file.
    """
    if len(paths) <= HEADER_PROBES:
        with ThreadPoolExecutor(max(1, len(paths))) as pool:
            return dict(zip(paths, pool.map(lambda p: first_line(spark, p), paths)))

    def first(batches):
        seen = None
        for batch in batches:
            for i, path in enumerate(batch.column("path").to_pylist()):
                if path != seen:
                    seen = path
                    yield batch.slice(i, 1)

    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value").where(
        (F.length(F.trim("value")) > 0) & (F.col("_metadata.file_block_start") == 0))
    found = {listed.plain(r["path"]): r["value"] for r in lines.mapInArrow(first, lines.schema).collect()}
    return {p: found.get(p) for p in paths}


def _placed(spark: SparkSession, df: DataFrame, columns: dict[str, Column], listed: Listed) -> DataFrame:
    """``columns`` of records cut out of files, with the file-order key and provenance,
    which takes the place of a column of its name."""
    tagged = df.select(*[c.alias(n) for n, c in columns.items() if n.lower() != "source_file"], F.col("path").alias("_tp_path"), F.col("block").alias("_pos_block"), F.col("row").alias("_pos_row"))
    return with_positions(spark, tagged, listed).withColumnRenamed("_tp_file", "source_file")


def _csv_records(spark: SparkSession, paths: list[str], splits: list, heads: dict, names: list[str], listed: Listed) -> DataFrame:
    """Files with line breaks inside of quotes, read by as many tasks as they have splits:
    text columns ``names`` and ``EXTRA``."""
    if len(paths) < len(heads):  # how Spark splits files depends on those it reads with them
        splits, heads = scan(spark, paths, CsvGrammar())
        if len(heads) < len(paths):
            heads = later_heads(spark, paths, CsvGrammar(), splits)
    pieces = records(spark, paths, CsvGrammar(), splits)
    header = F.broadcast(spark.createDataFrame(
        [(path, block, row) for path, (_, block, row) in heads.items()], "h_path string, h_block bigint, h_row bigint"))
    body = pieces.join(header, F.col("path") == F.col("h_path"), "left").where(
        (F.struct("block", "row") > F.struct(F.col("h_block").alias("block"), F.col("h_row").alias("row"))) & not_blank())
    fields = [f"c{i}" for i in range(len(names) + 1)]
    parsed = body.withColumn("v", F.from_csv(
        F.regexp_replace("text", r"\r\z", ""), ", ".join(f"{f} string" for f in fields),
        {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}))
    return _placed(spark, parsed, {n: F.col("v")[f] for f, n in zip(fields, [*names, EXTRA])}, listed)


def csv_header(line: str) -> list[str]:
    return next(csv.reader(io.StringIO(line)))


def files_with_quoted_newlines(spark: SparkSession, paths: list[str]) -> set[str]:
    """Files in which a line leaves a quote open, from one scan of plain lines
    (splittable).  Only those need to be read whole."""
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return {r[0] for r in lines.groupBy("path").agg(F.max((quotes % 2).cast("int")).alias("odd")).where("odd = 1").select("path").collect()}


def read_csv(spark: SparkSession, paths, *, infer: bool = True, schema: T.StructType | None = None,
             na_values=NA_VALUES, multiline: bool | str = "detect", headers: str = "detect") -> DataFrame:
    """S1 + S5: many CSV files, grouped by header, one read per distinct header.

    Files with different headers are never read together (a multi-path CSV read
    would assign columns by position under the first header); groups are
    unioned by name.  Zero-byte files are skipped, as Spark never lists them.
    A row with more fields than the header raises; one with fewer is filled up
    with missing values.

    ``headers="detect"`` probes every file's first line (tiny concurrent
    jobs).  ``headers="same"`` -- the usual case for large batches from one
    producer -- probes the first file only and reads everything in one scan
    with ``enforceSchema=false``: Spark checks each file's header during that
    scan and fails on a mismatch, or on a row of any other length.

    ``multiline="detect"`` finds, in one scan of plain lines, the files that hold
    a line break inside quotes; a scan of their splits then tells where records begin
    (``records``), so that they too are read by many tasks.
    """
    listed = list_files(spark, paths)
    nonempty = listed.distinct(lambda i: listed.sizes[i] > 0)
    if headers not in ("detect", "same"):
        raise TablePrepError(f"headers must be 'detect' or 'same', not {headers!r}")
    groups: dict[tuple, list[str]] = {}
    if headers == "same":
        line = next((x for x in (first_line(spark, p) for p in nonempty[:8]) if x is not None), None)
        if line is not None:
            groups[tuple(csv_header(line)), None] = nonempty
    elif nonempty:
        whole = {listed.plain(p) for p in files_with_quoted_newlines(spark, nonempty)} if multiline == "detect" else set()
        splits, heads = scan(spark, sorted(whole), CsvGrammar()) if whole else ([], {})
        if len(heads) < len(whole):
            heads = later_heads(spark, sorted(whole), CsvGrammar(), splits)
        lines = first_lines(spark, listed, [p for p in nonempty if p not in whole])
        lines |= {listed.plain(p): text.removesuffix("\r") for p, (text, *_) in heads.items()}
        for p in nonempty:
            if lines.get(p) is not None:  # else a blank file
                groups.setdefault((tuple(csv_header(lines[p])), p in whole), []).append(p)
        groups = {k: sorted(v) if k[1] else v for k, v in groups.items()}
    parts = []
    for (header, whole), group in groups.items():
        names = dedupe_header(list(header))
        check_case(spark, names)
        checked = headers == "same" and len(set(header)) == len(header)
        text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names + ([] if checked else [EXTRA])])
        if whole:
            raw = _csv_records(spark, group, splits, heads, names, listed)
        else:
            raw = (spark.read.schema(text_schema)
                   .option("header", True).option("enforceSchema", not checked)
                   .option("multiLine", multiline is True or (multiline == "detect" and whole is not False))
                   .option("quote", '"').option("escape", '"')
                   .option("mode", "FAILFAST" if checked else "PERMISSIVE")
                   .csv(group))
            raw = _with_order(spark, raw, listed)
        if not checked:  # a filter: no projection prunes it
            raw = raw.where(F.col(EXTRA).isNull() | F.raise_error(F.concat(
                F.lit(f"a row has more than {len(names)} fields in "), F.col("source_file"))).isNotNull()).drop(EXTRA)
        raw = raw.withColumns({n: na_to_null(F.col(f"`{n}`"), na_values) for n in names})
        parts.append(raw)
    if not parts:
        raise TablePrepError("none of the CSV files holds any data")
    df = union_by_name(parts)
    if schema is not None:
        return df.withColumns({f.name: F.col(f"`{f.name}`").try_cast(f.dataType) for f in schema.fields
                               if f.name in df.columns})
    return infer_types(df, [c for c in df.columns if c not in ("source_file",)]) if infer else df


def infer_json_schema(spark: SparkSession, texts: DataFrame, sampling_ratio: float = 1.0) -> T.StructType:
    """The schema of the objects in a text column, from one pass."""
    reader = spark.read.option("mode", "FAILFAST").option("samplingRatio", sampling_ratio)
    as_text = getattr(texts._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    try:
        return T.StructType.fromJson(json.loads(reader._jreader.json(as_text).schema().json()))
    except AnalysisException as e:
        raise TablePrepError(f"column names differ only in case: {e}") if "COLUMN_ALREADY_EXISTS" in str(e) else e
    except Exception as e:  # inference meets a broken element first
        raise TablePrepError(f"broken JSON: {str(e)[:300]}")


def json_elements(spark: SparkSession, files: list[str], listed: Listed) -> DataFrame:
    """The elements of files that each hold an array, as text, with the file-order key and provenance."""
    return _placed(spark, _array_elements(spark, files), {"text": F.col("text")}, listed)


def _array_elements(spark: SparkSession, files: list[str]) -> DataFrame:
    grammar = JsonGrammar()
    splits, _ = scan(spark, files, grammar)
    return split_records(records(spark, files, grammar, splits), grammar)


def _json_arrays(spark: SparkSession, files: list[str], listed: Listed, schema: T.StructType | None, sampling_ratio: float) -> DataFrame:
    elements = _array_elements(spark, files)
    if schema is None:
        schema = infer_json_schema(spark, elements.select("text"), sampling_ratio)
    check_case(spark, schema.names)
    parsed = elements.withColumn("v", F.from_json("text", schema, {"mode": "FAILFAST"}))
    return _placed(spark, parsed, {n: F.col("v").getField(n) for n in schema.names}, listed)


def read_json(spark: SparkSession, paths, *, lines: bool = False, schema: T.StructType | None = None,
              sampling_ratio: float = 1.0, rejects: str = "raise") -> DataFrame:
    """S2: files that each hold one array of objects (``lines=True``: JSON
    Lines).  Columns are the union of keys; absent keys are null.
    Spark orders inferred fields by name.  Inference reads the input once;
    ``schema`` skips that pass and ``sampling_ratio`` shortens it.

    An array is read by as many tasks as its file has splits: a scan of the splits tells
    where its elements begin (``records``), each task parses its own.

    Broken JSON and files that are not an array raise; ``rejects="keep"`` returns
    unreadable records instead, as rows whose text is in ``_corrupt_record`` (a file
    with an array is then one task).
    """
    if rejects not in ("raise", "keep"):
        raise TablePrepError(f"rejects must be 'raise' or 'keep', not {rejects!r}")
    listed = list_files(spark, paths)
    files = listed.distinct(lambda i: listed.sizes[i] > 0)
    if not files:
        raise TablePrepError("none of the JSON files holds any data")
    if not lines and rejects == "raise":
        return _json_arrays(spark, files, listed, schema, sampling_ratio)
    if not lines:
        other = [p for p, line in first_lines(spark, listed, files).items() if line is None or not line.lstrip("\ufeff \t\r\n").startswith("[")]
        if other:
            raise TablePrepError(f"not an array of objects: {other}")
    mode = "FAILFAST" if rejects == "raise" else "PERMISSIVE"
    reader = spark.read.option("multiLine", not lines).option("mode", mode)
    if schema is not None:
        reader = reader.schema(schema)
    elif sampling_ratio < 1.0:
        reader = reader.option("samplingRatio", sampling_ratio)
    try:
        df = reader.json(files)
    except AnalysisException as e:
        raise TablePrepError(f"column names differ only in case: {e}") if "COLUMN_ALREADY_EXISTS" in str(e) else e
    except Exception as e:  # inference meets a broken record first
        raise TablePrepError(f"broken JSON: {str(e)[:300]}")
    return _with_order(spark, df, listed)


def read_xml(spark: SparkSession, paths, *, row_tag: str = "record", infer: bool = False,
             columns: list[str] | None = None, sampling_ratio: float = 1.0) -> DataFrame:
    """S3: every ``<record>`` child of the root is a row, every child element a text
    column; attributes are ignored, the last of repeated tags wins, padding is
    kept and an empty element is null.  Records further down are no rows, and one
    inside of a record is a field.  A truncated document raises.

    A document is read by as many tasks as its file has splits: a scan of the splits
    tells how deep each begins (``records``).  Finding the element names reads the
    records once; ``columns`` skips that pass, ``sampling_ratio`` shortens it."""
    listed = list_files(spark, paths)
    files = listed.distinct(lambda i: listed.sizes[i] > 0)
    if not files:
        raise TablePrepError("no records in the XML files")
    grammar = XmlGrammar(row_tag)
    splits, _ = scan(spark, files, grammar)
    found = split_records(records(spark, files, grammar, splits), grammar)

    def child_names(batches):
        seen: set[str] = set()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                new = grammar.child_names(text) - seen
                if new:
                    seen |= new
                    yield pa.RecordBatch.from_arrays([pa.array(sorted(new))], ["name"])

    names = list(columns or [])
    if not names:
        some = found if sampling_ratio >= 1.0 else found.sample(False, sampling_ratio, 7)
        names = sorted(r[0] for r in some.select("text").mapInArrow(child_names, "name string").distinct().collect())
    if not names:
        raise TablePrepError("no records in the XML files")
    check_case(spark, names)
    text_schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    parsed = found.withColumn("v", F.from_xml("text", text_schema, {
        "rowTag": row_tag, "excludeAttribute": "true", "mode": "FAILFAST", "ignoreSurroundingSpaces": "false", "nullValue": ""}))
    df = _placed(spark, parsed, {n: F.col("v").getField(n) for n in names}, listed)
    return infer_types(df, [n for n in names if n.lower() != "source_file"]) if infer else df


def read_files(spark: SparkSession, paths, *, lower_names: bool = False, mixed: str = "text", **kw) -> DataFrame:
    """S5 + S6 + U6: any mix of formats; each format read once, then unioned by
    name with widening.  ``lower_names`` applies the merge rule (strip, lower);
    with ``mixed="variant"`` a column that is a number in one format and text in another
    keeps both (``merge.widen``)."""
    from ..operators.merge import lower_names as lower
    from .xlsx import read_xlsx

    by_fmt: dict[str, list[str]] = {}
    where: dict[str, list[int]] = {}
    for i, p in enumerate(list_files(spark, paths).names):
        by_fmt.setdefault(format_of(p), []).append(p)
        where.setdefault(format_of(p), []).append(i)
    parts = []
    for fmt, group in by_fmt.items():
        if fmt == "csv":
            d = read_csv(spark, group, **kw)
        elif fmt == "json":
            d = read_json(spark, group)
        elif fmt == "xml":
            d = read_xml(spark, group)
        else:
            d = read_xlsx(spark, group).drop("sheet_pos", "row_pos").withColumnRenamed("sheet", "source_sheet")
        # positions refer to the full request, not to the format group
        remap = F.element_at(typed_array(where[fmt], T.IntegerType()), F.col("_pos_file") + 1)
        if "_pos_file" in d.columns:
            d = d.withColumn("_pos_file", remap.cast("int"))
        parts.append(lower(d) if lower_names else d)
    if mixed != "text":  # all at once: a number is not widened on its way into a variant
        return union_by_name(parts, mixed=mixed)
    return reduce(lambda a, b: union_by_name([a, b]), parts)
