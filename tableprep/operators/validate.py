"""Validation and metadata (V1-V4, V7), each a distributed job.

Format checks work on text: a column of a table, or files read with
``spark.read.text`` / ``binaryFile`` and grouped by ``_metadata.file_path``.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TablePrepError
from ..functions.text import WHITESPACE
from .clean import data_columns
from .order import with_row_index


# V1 ---------------------------------------------------------------------
def column_sets_by_group(df: DataFrame, group_col: str) -> DataFrame:
    """Per group (sheet or file): which data columns hold any value.

    One aggregate (partial per map task); returns ``group, columns`` with the
    names sorted, plus ``consistent``: whether all non-empty groups agree.
    """
    cols = [c for c in data_columns(df) if c != group_col]
    floats = {f.name for f in df.schema.fields if f.dataType.typeName() in ("float", "double")}

    def held(c: str) -> Column:  # NaN is a missing value
        x = F.col(f"`{c}`")
        return x.isNotNull() & ~F.isnan(x) if c in floats else x.isNotNull()

    present = [F.max(held(c).cast("int")).alias(f"p{i}") for i, c in enumerate(cols)]
    per = df.groupBy(group_col).agg(*present)
    names = F.array_compact(F.array(*[F.when(F.col(f"p{i}") == 1, F.lit(c)) for i, c in enumerate(cols)]))
    sig = per.select(F.col(group_col), F.array_sort(names).alias("columns"))
    # one scalar: how many distinct column sets (partial aggregation, one row back)
    kinds = sig.agg(F.countDistinct(F.concat_ws("\u0001", "columns"))).first()[0]
    return sig.withColumn("consistent", F.lit(kinds <= 1))


def schema_sets_consistent(dfs: list[DataFrame]) -> bool:
    """Column-name sets of non-empty inputs agree (order and type ignored).

    Emptiness is one cheap ``limit(1)`` probe per input; names come from the
    schemas (no data read).
    """
    sets = {frozenset(data_columns(d)) for d in dfs if not d.isEmpty()}
    return len(sets) <= 1


def require_consistent_schema(dfs: list[DataFrame], what: str = "files") -> None:
    if not schema_sets_consistent(dfs):
        raise TablePrepError(f"{what} do not all have the same columns")


# V2 ---------------------------------------------------------------------
_STRICT_JSON = {"allowSingleQuotes": "false"}


def _arity(text: Column, left: str, right: str) -> Column:
    wrapped = F.concat(F.lit(left), text, F.lit(right))
    return F.size(F.from_json(wrapped, "array<string>", _STRICT_JSON))


def json_text_checks(text: Column) -> dict[str, Column]:
    """Is the text one JSON document, an array, an array of objects only, an
    object.

    Spark's JSON readers stop after the first value and ignore what follows.
    Wrapping the text as ``[x,0]`` and ``[0,x,0,0]`` and requiring 2 and 4
    elements rejects trailing data: a prefix that closes early cannot give
    both counts.  Everything stays JVM-side.
    """
    valid = F.coalesce((_arity(text, "[", ",0]") == 2) & (_arity(text, "[0,", ",0,0]") == 4), F.lit(False))
    # valid JSON is told by its first character; elements that are no object
    # come out null as maps (no variant: its size limit would refuse large files)
    first = F.substring(F.ltrim(F.translate(text, "\t\r\n", "   ")), 1, 1)
    is_array = valid & F.coalesce(first == "[", F.lit(False))
    items = F.from_json(F.when(is_array, text), "array<map<string,string>>", _STRICT_JSON)
    all_objects = F.coalesce(F.forall(items, lambda e: e.isNotNull()), F.lit(False))
    return {
        "is_json": valid,
        "is_array": is_array,
        "is_object": valid & F.coalesce(first == "{", F.lit(False)),
        "array_of_objects": is_array & all_objects,
    }


def validate_json_texts(df: DataFrame, text_col: str, keep=()) -> DataFrame:
    checks = json_text_checks(F.col(text_col))
    return df.select(*keep, *[e.alias(k) for k, e in checks.items()])


def validate_json_files(spark, paths: list[str]) -> DataFrame:
    """Per file: parses, is an array of objects.  Whole-file text per task
    (a JSON document cannot be split)."""
    raw = spark.read.option("wholetext", True).text(paths)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value"))
    checks = json_text_checks(F.col("value"))
    return out.select("path", checks["is_json"].alias("is_json"), checks["array_of_objects"].alias("valid"))


# V3 ---------------------------------------------------------------------
def csv_text_checks(text: Column) -> dict[str, Column]:
    """Non-blank and holds a comma (a one-column CSV is thus refused)."""
    non_blank = F.coalesce(F.length(F.btrim(text, F.lit(WHITESPACE))) > 0, F.lit(False))
    has_comma = F.coalesce(text.contains(","), F.lit(False))
    return {"non_blank": non_blank, "has_comma": has_comma, "valid": non_blank & has_comma}


def validate_csv_files(spark, paths: list[str]) -> DataFrame:
    """Per file from line-split text (splittable): any comma, any non-blank
    line; bytes that are no UTF-8 (a written U+FFFD is fine) are reported."""
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return lines.groupBy("path").agg(
        F.max(F.col("value").contains(",")).alias("has_comma"),
        F.max(F.length(F.btrim("value", F.lit(WHITESPACE))) > 0).alias("non_blank"),
        F.max(~F.is_valid_utf8("value")).alias("bad_utf8"),
    ).withColumn("valid", F.col("has_comma") & F.col("non_blank") & ~F.col("bad_utf8"))


# V4 ---------------------------------------------------------------------
def is_empty(size: Column) -> Column:
    """The rule for an empty input: no bytes, or no input at all (null)."""
    return F.coalesce(size == 0, F.lit(True))


def empty_inputs(spark, paths: list[str]) -> DataFrame:
    """Requested files that are empty, from the file listing (Spark's readers
    skip zero-byte files)."""
    from ..sources.files import list_files

    listed = list_files(spark, paths)
    files = spark.createDataFrame(list(zip(listed.names, listed.sizes)), "path string, length bigint")
    return files.where(is_empty(F.col("length"))).select("path")


def empty_texts(df: DataFrame, text_col: str, keep=()) -> DataFrame:
    """The same rule for inputs held as a text column: ``keep``, ``n_chars``, ``is_empty``."""
    return df.select(*keep, F.length(text_col).cast("bigint").alias("n_chars"), is_empty(F.octet_length(text_col)).alias("is_empty"))


# V7 ---------------------------------------------------------------------
# Fixed value: what a file name may hold (any letters and digits, - _ .).
NAME_OK = r"(?U)^[\w\-\_\.]+$"


def rename_manifest(files: DataFrame, name_col: str, pattern: str, order_by) -> DataFrame:
    """New name per file: ``pattern`` with ``{index}`` and ``{filename}``
    (name without extension), plus the extension; validity against
    ``NAME_OK`` and a collision count.  Nothing is moved."""
    pieces = _pattern_columns(pattern)
    idx = with_row_index(files, order_by, index_col="index")
    name = F.col(name_col)
    dot = F.length(name) - F.locate(".", F.reverse(name)) + 1  # 1-based position of last dot
    has_dot = F.locate(".", name) > 0
    base = F.when(has_dot, F.substring(name, F.lit(1), dot - 1)).otherwise(name)
    ext = F.when(has_dot, F.substring_index(name, ".", -1))
    stem = F.concat(*[_index_text(p) if p.startswith("{index") else base if p == "{filename}" else F.lit(p)
                      for p in pieces]) if pieces else F.lit("")
    new = F.when(ext.isNotNull(), F.concat(stem, F.lit("."), ext)).otherwise(stem)
    out = idx.withColumn("new_name", new).withColumn("valid", F.col("new_name").rlike(NAME_OK))
    # hot names: partial aggregation, then a join AQE may split on skew
    dup = out.groupBy("new_name").agg(F.count(F.lit(1)).alias("same_name"))
    return out.join(dup, "new_name", "left")


def _index_text(field: str) -> Column:
    """``{index}``, or padded to a width: ``{index:03d}`` with zeros, ``{index:3d}`` with spaces."""
    spec = field[len("{index"):-1].lstrip(":").rstrip("d")
    text = F.col("index").cast("string")
    if not spec or not int(spec):
        return text
    width, fill = int(spec), "0" if spec.startswith("0") else " "
    return F.when(F.length(text) >= width, text).otherwise(F.lpad(text, width, fill))


def _pattern_columns(pattern: str) -> list[str]:
    if not pattern:
        raise TablePrepError("no rename pattern given")
    out, i = [], 0
    while i < len(pattern):
        field = re.compile(r"\{filename\}|\{index(:0?\d*d?)?\}").match(pattern, i)
        if field:
            out.append(field[0])
            i = field.end()
        else:
            if pattern[i] in "{}":
                raise TablePrepError(f"Unsupported placeholder in pattern: {pattern}")
            if out and not out[-1].startswith("{"):
                out[-1] += pattern[i]
            else:
                out.append(pattern[i])
            i += 1
    return out


def check_inputs(spark, paths, *, formats: bool = True, empty: bool = True) -> None:
    """The request flags ``check_corrupt_empty`` and ``validate_format`` as
    one call: raise ``TablePrepError`` naming every empty file and every
    CSV/JSON file that fails its format rule (one job per check)."""
    from ..sources.files import list_files

    listed = list_files(spark, paths)
    problems = []
    if empty:
        problems += [f"{p} is empty" for p, n in zip(listed.names, listed.sizes) if not n]
    nonempty = listed.distinct(lambda i: listed.sizes[i] > 0)
    if formats:
        csvs = [p for p in nonempty if p.lower().endswith(".csv")]
        jsons = [p for p in nonempty if p.lower().endswith(".json")]
        if csvs:
            problems += [f"{r['path']} is not a valid CSV"
                         for r in validate_csv_files(spark, csvs).where("not valid").collect()]
        if jsons:
            problems += [f"{r['path']} must contain an array of objects"
                         for r in validate_json_files(spark, jsons).where("not valid").collect()]
    if problems:
        raise TablePrepError("; ".join(sorted(problems)))
