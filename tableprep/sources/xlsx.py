"""Workbook source (S4): .xlsx files as a sheet-keyed DataFrame.

Spark's ``binaryFile`` source lists and reads the files (any Hadoop file
system).  An .xlsx is a zip of XML parts, and its directory says where each sheet
lies: a first step cuts a workbook into its sheets without inflating any, and deals the
sheets out, so that one sheet is one unit of work and a sheet that a filter drops is
never inflated.  The second step inflates and parses a sheet as a stream, with the
standard library, and emits its cells in chunks as ``(path, sheet, sheet_pos, row_pos,
cells)``.

The DataFrame layer then takes each sheet's first row as its header and
projects ``cells[i]`` to named columns: one projection per distinct header,
unioned by name.  Empty sheets have no rows and vanish, as in the merge.
"""
from __future__ import annotations

import datetime as dt
import io
import itertools
import posixpath
import re
import struct
import zipfile
import zlib
import xml.etree.ElementTree as ET

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TablePrepError
from ..operators.sheets import MAX_SHEETS
from ..session import checkpoint_dir
from .files import NA_VALUES, na_to_null, dedupe_header, infer_types, list_files, with_positions

# OOXML namespaces.
NS_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
NS_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
NS_PKG = "http://schemas.openxmlformats.org/package/2006/relationships"
# Built-in number formats that show dates or times.
DATE_FORMAT_IDS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}

CELLS_SCHEMA = "path string, sheet string, sheet_pos int, row_pos long, cells array<string>"
CHUNK_ROWS = 10_000
MAX_HEADERS = 10_000  # each distinct header is a branch of the plan


def _q(tag: str) -> str:
    return f"{{{NS_MAIN}}}{tag}"


def _col_index(ref: str) -> int:
    n = 0
    for ch in ref:
        if ch.isalpha():
            n = n * 26 + (ord(ch.upper()) - 64)
        else:
            break
    return n - 1


def _is_date_code(code: str) -> bool:
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code)
    return bool(re.search(r"[dmyhs]", code, re.I))


def _date_styles(styles: bytes | None) -> set[int]:
    if styles is None:
        return set()
    root = ET.fromstring(styles)
    custom = {}
    fmts = root.find(_q("numFmts"))
    if fmts is not None:
        for f in fmts.findall(_q("numFmt")):
            custom[int(f.get("numFmtId"))] = f.get("formatCode", "")
    out = set()
    xfs = root.find(_q("cellXfs"))
    if xfs is not None:
        for i, xf in enumerate(xfs.findall(_q("xf"))):
            fid = int(xf.get("numFmtId", "0"))
            if fid in DATE_FORMAT_IDS or (fid in custom and _is_date_code(custom[fid])):
                out.add(i)
    return out


def _raw(content: bytes, member: zipfile.ZipInfo) -> bytes:
    """A member as it lies in the archive, behind one byte for its method."""
    if member.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or member.flag_bits & 1:
        raise ValueError(f"{member.filename} is packed or encrypted in a way that workbooks don't use")
    at = member.header_offset
    name, extra = struct.unpack_from("<HH", content, at + 26)  # lengths that the member's own header gives
    at += 30 + name + extra
    return bytes([member.compress_type]) + content[at:at + member.compress_size]


def _stream(raw: bytes, step: int = 1 << 16):
    """The content of what ``_raw`` took, inflated piece by piece."""
    unpack = zlib.decompressobj(-15) if raw[0] == zipfile.ZIP_DEFLATED else None
    for at in range(1, len(raw), step):
        piece = raw[at:at + step]
        if unpack is None:
            yield piece
        else:
            while piece:  # a small piece may hold a long run
                yield unpack.decompress(piece, step)
                piece = unpack.unconsumed_tail
    if unpack is not None:
        yield unpack.flush()


def _elements(raw: bytes, tag: str):
    """Elements named ``tag`` in the order they end; each leaves the tree behind itself."""
    parser, inside = ET.XMLPullParser(["start", "end"]), []
    for piece in _stream(raw):
        parser.feed(piece)
        for event, el in parser.read_events():
            if event == "start":
                inside.append(el)
                continue
            inside.pop()
            if el.tag == tag:
                yield el
                if inside:
                    inside[-1].remove(el)
    parser.close()


def _shared_strings(raw: bytes | None) -> list[str]:
    if raw is None:
        return []
    return ["".join(t.text or "" for t in el.iter(_q("t"))) for el in _elements(raw, _q("si"))]


def _serial_to_text(value: float, base: dt.datetime) -> str:
    stamp = base + dt.timedelta(days=value)
    stamp = stamp.replace(microsecond=0) if abs(stamp.microsecond) < 1000 else stamp
    return stamp.strftime("%Y-%m-%d %H:%M:%S")


def workbook_sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """``[(sheet name, part path)]`` in workbook order."""
    wb = ET.fromstring(z.read("xl/workbook.xml"))
    rels = ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))
    targets = {r.get("Id"): r.get("Target") for r in rels.findall(f"{{{NS_PKG}}}Relationship")}
    out = []
    sheets = wb.find(_q("sheets"))
    for s in (sheets.findall(_q("sheet")) if sheets is not None else []):
        target = targets[s.get(f"{{{NS_REL}}}id")]
        part = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
        out.append((s.get("name"), part))
    return out


def cut_workbook(content: bytes):
    """Yield ``(sheet, sheet_pos, part, strings, styles, date1904)`` of each sheet: the sheet's
    part and the shared strings as they lie in the archive."""
    z = zipfile.ZipFile(io.BytesIO(content))
    members = {m.filename: m for m in z.infolist()}
    strings = members.get("xl/sharedStrings.xml")
    strings = _raw(content, strings) if strings is not None else None
    styles = z.read("xl/styles.xml") if "xl/styles.xml" in members else None
    pr = ET.fromstring(z.read("xl/workbook.xml")).find(_q("workbookPr"))
    date1904 = pr is not None and pr.get("date1904") in ("1", "true")
    for pos, (name, part) in enumerate(workbook_sheets(z)):
        if pos >= MAX_SHEETS:
            raise ValueError(f"a workbook has more than {MAX_SHEETS} sheets")
        yield name, pos, _raw(content, members[part]), strings, styles, date1904


def sheet_rows(part: bytes, strings: bytes | None, styles: bytes | None, date1904: bool):
    """Yield ``(row_pos, cells)``; row_pos 0 is the first sheet row; rows missing from the
    part come out empty.  A marker comes first, row_pos -1 without cells: an empty sheet
    is a sheet too."""
    texts, dates = None, _date_styles(styles)
    base = dt.datetime(1904, 1, 1) if date1904 else dt.datetime(1899, 12, 30)
    yield -1, []
    next_row = 0
    for el in _elements(part, _q("row")):
        r = int(el.get("r", next_row + 1)) - 1
        while next_row < r:
            yield next_row, []
            next_row += 1
        cells: list = []
        for c in el.findall(_q("c")):
            idx = _col_index(c.get("r")) if c.get("r") else len(cells)
            t = c.get("t", "n")
            v = c.find(_q("v"))
            if t == "inlineStr":
                is_ = c.find(_q("is"))
                val = "".join(x.text or "" for x in is_.iter(_q("t"))) if is_ is not None else None
            elif v is None or v.text is None:
                val = None
            elif t == "s":
                if texts is None:  # only sheets that use them read them
                    texts = _shared_strings(strings)
                val = texts[int(v.text)]
            elif t == "b":
                val = "True" if v.text.strip() in ("1", "true") else "False"
            elif t in ("str", "e"):
                val = v.text
            elif int(c.get("s", "0")) in dates:
                val = _serial_to_text(float(v.text), base)
            else:
                val = v.text
            while len(cells) < idx:
                cells.append(None)
            cells.append(val)
        yield r, cells
        next_row = r + 1


SHEETS_SCHEMA = "path string, sheet string, sheet_pos int, part binary, strings binary, styles binary, date1904 boolean"


def _cut(batches):
    """One row a sheet, one batch a workbook."""
    for batch in batches:
        for path, content in zip(batch.column("path"), batch.column("content")):
            rows = [(path.as_py(), *sheet) for sheet in cut_workbook(content.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _SHEET_TYPES)], _SHEET_NAMES)


_SHEET_NAMES = ["path", "sheet", "sheet_pos", "part", "strings", "styles", "date1904"]
_SHEET_TYPES = [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.bool_()]


def _decode(batches):
    for batch in batches:
        for i in range(len(batch)):
            path, sheet, pos, *parts = (batch.column(c)[i].as_py() for c in _SHEET_NAMES)
            rows = sheet_rows(*parts)
            while chunk := list(itertools.islice(rows, CHUNK_ROWS)):
                n = len(chunk)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * n), pa.array([sheet] * n, pa.string()), pa.array([pos] * n, pa.int32()), pa.array([r for r, _ in chunk], pa.int64()),
                     pa.array([c for _, c in chunk], pa.list_(pa.string()))], ["path", "sheet", "sheet_pos", "row_pos", "cells"])


def read_sheets(spark: SparkSession, paths) -> DataFrame:
    """One row for each sheet of each workbook, still packed.  A filter on ``sheet`` or
    ``sheet_pos`` spares the others the inflating."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for p in paths:
        if p.lower().endswith(".xls"):
            raise TablePrepError("legacy .xls workbooks are not supported")
    files = spark.read.format("binaryFile").load(list_files(spark, paths).distinct()).select("path", "content")
    return files.mapInArrow(_cut, SHEETS_SCHEMA)


def read_cells(spark: SparkSession, paths, sheets=None) -> DataFrame:
    """Raw cells of every sheet (or of those named in ``sheets``) of every workbook.  Sheets are
    dealt out one by one; a number is given, so that small ones aren't put together again."""
    packed = read_sheets(spark, paths)
    if sheets is not None:
        packed = packed.where(F.col("sheet").isin(list(sheets)))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return packed.repartition(n, "path", "sheet_pos").mapInArrow(_decode, CELLS_SCHEMA)


def sheet_names(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """``[(name, position), ...]`` of all sheets of one workbook, the empty ones
    among them: what the sheet operations take as ``all_sheets``."""
    rows = read_sheets(spark, path).select("sheet", "sheet_pos").collect()  # MAX_SHEETS at most
    return sorted(((r[0], r[1]) for r in rows), key=lambda x: x[1])


def read_xlsx(spark: SparkSession, paths, *, sheets=None, infer: bool = True, na_values=NA_VALUES) -> DataFrame:
    """Workbooks (all sheets, or those named in ``sheets``) as one sheet-keyed DataFrame: ``source_file, sheet,
    sheet_pos, row_pos`` + data columns (unioned by name over sheets) + the
    order key ``_pos_file, _pos_block, _pos_row``."""
    from ..operators.merge import union_by_name

    paths = [paths] if isinstance(paths, str) else list(paths)
    cells = read_cells(spark, paths, sheets).withColumn("_tp_path", F.col("path"))
    cells = with_positions(spark, cells, list_files(spark, paths))
    # Decoding runs in Python; cut the lineage once (reliable checkpoint in the
    # session's shared checkpoint folder) so header, inference and data passes
    # read decoded cells instead of decoding every workbook again.
    checkpoint_dir(spark)
    cells = cells.checkpoint(eager=True)
    # one row per sheet: its header and its widest row (columns without a name
    # are kept)
    width = F.coalesce(F.array_max(F.transform("cells", lambda x, i: F.when(x.isNotNull(), i + 1))), F.lit(0))
    heads = cells.groupBy("_pos_file", "sheet_pos").agg(
        F.max(width).alias("width"), F.first(F.when(F.col("row_pos") == 0, F.col("cells")), ignorenulls=True).alias("cells"))
    padded = F.slice(F.concat(F.coalesce("cells", F.array().cast("array<string>")), F.array_repeat(F.lit(None).cast("string"), "width")),
                     F.lit(1), F.col("width"))
    heads = heads.where("width > 0").select(
        F.col("_pos_file").alias("_tp_f"), F.col("sheet_pos").alias("_tp_s"), F.transform(padded, lambda x: F.coalesce(x, F.lit(""))).alias("_tp_header"))
    # the driver sees each distinct header; which sheets have it stays in a table
    heads = heads.checkpoint(eager=True)
    headers = sorted(tuple(r[0]) for r in heads.select("_tp_header").distinct().limit(MAX_HEADERS + 1).collect())
    if not headers:
        raise TablePrepError("no sheet holds any data")
    if len(headers) > MAX_HEADERS:
        raise TablePrepError(f"the sheets have more than {MAX_HEADERS} different headers")
    body = cells.where(F.col("row_pos") > 0).join(heads, (F.col("_pos_file") == F.col("_tp_f")) & (F.col("sheet_pos") == F.col("_tp_s")))
    parts = []
    for header in headers:
        names = dedupe_header([n if n else f"Unnamed: {i}" for i, n in enumerate(header)])
        part = body.where(F.col("_tp_header") == F.array(*[F.lit(x) for x in header]))
        part = part.select(
            F.col("_tp_file").alias("source_file"),
            "sheet", "sheet_pos", (F.col("row_pos") - 1).alias("row_pos"),
            *[na_to_null(F.try_element_at("cells", F.lit(i + 1)), na_values).alias(n) for i, n in enumerate(names)],
            "_pos_file", F.col("sheet_pos").cast("long").alias("_pos_block"), (F.col("row_pos") - 1).alias("_pos_row"),
        )
        # a sheet row with no value at all below the header is kept as empty
        parts.append(part)
    df = union_by_name(parts)
    data = [c for c in df.columns if c not in ("source_file", "sheet", "sheet_pos", "row_pos",
                                               "_pos_file", "_pos_block", "_pos_row")]
    return infer_types(df, data) if infer else df
