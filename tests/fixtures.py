"""Micro-fixtures of FIXTURES.md, written into a fresh temp directory."""
from __future__ import annotations

import json
import os
import zipfile
from xml.sax.saxutils import escape

PEOPLE_CSV = (
    "name,age,city,date,price\n"
    " Ann ,30,Oslo,2024-01-05,10.5\n"
    "Bob,NA,\t Rome ,2024-02-10,7\n"
    "\n"
    ",,,,\n"
    "Ann ,31,Oslo,2024-03-01,3.25\n"
    "Cid,1e3,Paris,not a date,\n"
    "Dee,2.5,Oslo,2024-04-30,1\n"
    "Eve,x,Lima,2024-05-06,2\n"
)

FILES = {
    "people.csv": PEOPLE_CSV,
    "headers.csv": " First Name ,AGE,first  name\nA,1,B\n",
    "dup_header.csv": "a,a,b\n1,2,3\n4,5,6\n",
    "reordered.csv": "city,name,price,date,age\nBergen,Fay,4,2024-06-01,44\n",
    "extra_col.csv": "name,age,city,date,price,country\nGus,50,Oslo,2024-07-01,9,NO\n",
    "clash.csv": "name,age\nHal,forty\n",
    "quoted.csv": 'id,note\n1,"a, b"\n2,"say ""hi"""\n3,"two\nlines"\n',
    "one_column.csv": "a\n1\n2\n",
    "empty.csv": "",
    "blank.csv": "   \n\n",
    "header_only.csv": "a,b\n",
    "A.CSV": PEOPLE_CSV,
    "people.json": json.dumps([
        {"z": 1, "name": "Ann", "age": 30, "tags": ["x", "y"], "addr": {"city": "Oslo"}},
        {"name": "Bob", "age": None},
        {"z": 3, "name": "Cid", "age": 41, "tags": []},
    ]),
    "not_array.json": json.dumps({"a": 1}),
    "mixed_array.json": json.dumps([{"a": 1}, 2]),
    "broken.json": '[{"a": 1}, {"a": ',
    "people.xml": (
        "<records>"
        "<record id='1'><name> Ann </name><age>30</age><city>Oslo</city></record>"
        "<record><name>Bob</name><age></age><age>22</age><city>Rome</city></record>"
        "<record><name>Cid</name><age>41</age><city><b>Paris</b></city></record>"
        "</records>"
    ),
    "no_records.xml": "<records><row><a>1</a></row></records>",
}


def write_all(root: str) -> dict[str, str]:
    out = {}
    for name, text in FILES.items():
        p = os.path.join(root, name)
        with open(p, "w", encoding="utf-8") as f:
            f.write(text)
        out[name] = p
    out["book.xlsx"] = write_book(os.path.join(root, "book.xlsx"))
    return out


# ----------------------------------------------------------------- xlsx
def _cell_ref(col: int, row: int) -> str:
    letters = ""
    col += 1
    while col:
        col, rem = divmod(col - 1, 26)
        letters = chr(65 + rem) + letters
    return f"{letters}{row + 1}"


def _sheet_xml(rows, shared: list[str]) -> str:
    out = []
    for r, row in enumerate(rows):
        if row is None:
            continue  # a row missing from the part
        cells = []
        for c, v in enumerate(row):
            ref = _cell_ref(c, r)
            if v is None:
                continue  # missing cell
            if isinstance(v, tuple) and v[0] == "date":
                cells.append(f'<c r="{ref}" s="1"><v>{v[1]}</v></c>')
            elif isinstance(v, tuple) and v[0] == "inline":
                cells.append(f'<c r="{ref}" t="inlineStr"><is><t>{escape(v[1])}</t></is></c>')
            elif isinstance(v, bool):
                cells.append(f'<c r="{ref}" t="b"><v>{int(v)}</v></c>')
            elif isinstance(v, (int, float)):
                cells.append(f'<c r="{ref}"><v>{v}</v></c>')
            else:
                if v not in shared:
                    shared.append(v)
                cells.append(f'<c r="{ref}" t="s"><v>{shared.index(v)}</v></c>')
        out.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    return ('<?xml version="1.0" encoding="UTF-8"?><worksheet xmlns="http://schemas.openxmlformats.org/'
            f'spreadsheetml/2006/main"><sheetData>{"".join(out)}</sheetData></worksheet>')


BOOK = {
    "Data1": [["name", "age", "joined"], ["Ann", 30, ("date", 45296)], ["Bob", None, ("date", 45297.5)],
              None, [("inline", "Cid"), 41, None]],
    "Data2": [["name", "age", "joined"], ["Dee", 2.5, ("date", 45300)]],
    "Notes": [["note", "flag"], ["hello", True], ["NA", False]],
    "Empty": [],
}


def write_book(path: str, book=BOOK) -> str:
    shared: list[str] = []
    sheets = {name: _sheet_xml(rows, shared) for name, rows in book.items()}
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pkg = "http://schemas.openxmlformats.org/package/2006/relationships"
    wb = (f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets>'
          + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets))
          + "</sheets></workbook>")
    rels = (f'<Relationships xmlns="{pkg}">'
            + "".join(f'<Relationship Id="rId{i + 1}" Type="{rel}/worksheet" Target="worksheets/sheet{i + 1}.xml"/>'
                      for i in range(len(sheets)))
            + "</Relationships>")
    sst = (f'<sst xmlns="{main}" count="{len(shared)}" uniqueCount="{len(shared)}">'
           + "".join(f"<si><t>{escape(s)}</t></si>" for s in shared) + "</sst>")
    styles = (f'<styleSheet xmlns="{main}"><cellXfs count="2"><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs>'
              "</styleSheet>")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"/>')
        z.writestr("xl/workbook.xml", wb)
        z.writestr("xl/_rels/workbook.xml.rels", rels)
        z.writestr("xl/sharedStrings.xml", sst)
        z.writestr("xl/styles.xml", styles)
        for i, xml in enumerate(sheets.values()):
            z.writestr(f"xl/worksheets/sheet{i + 1}.xml", xml)
    return path
