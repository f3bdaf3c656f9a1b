"""Quoted line breaks, JSON arrays and XML documents read by many tasks: the rows of a one-task read."""
import csv
import io
import json
import random
import xml.etree.ElementTree as ET

import pytest

from tableprep.errors import TablePrepError
from tableprep.operators.order import ROW_ORDER
from tableprep.sources.files import first_lines, list_files, read_csv, read_json, read_xml
from tableprep.sources.records import CsvGrammar, JsonGrammar, XmlGrammar


@pytest.fixture(params=["64", "700", "1m"])
def small_splits(spark, request):
    """Splits down to a few dozen bytes, so that every kind of token crosses an edge."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in keep:
        spark.conf.set(k, request.param if k.endswith("maxPartitionBytes") else "0")
    yield request.param
    for k, v in keep.items():
        spark.conf.set(k, v)


def in_order(df, *cols):
    return [tuple(r) for r in df.orderBy(*ROW_ORDER).select(*cols).collect()]


def test_csv_with_quoted_line_breaks(spark, small_splits, tmp_path):
    rnd, rows = random.Random(1), []
    for i in range(150):
        note = "".join(rnd.choice(['"', "\n", ",", "a", "bc ", "\r\n", ' "x" ']) for _ in range(rnd.randrange(8)))
        rows.append([str(i), note, "z" * rnd.randrange(30)])
    rows.append(["150", "long " + "line\n" * 60, 'end "'])
    text = io.StringIO()
    csv.writer(text, lineterminator="\r\n").writerows([["id", "note", "z"], *rows])
    # a quote inside of an unquoted field opens nothing
    path = tmp_path / "q.csv"
    path.write_text("\r\n" + text.getvalue() + '151,5" pipe,6" pipe\r\n152,x,y', newline="")
    rows += [["151", '5" pipe', '6" pipe'], ["152", "x", "y"]]
    df = read_csv(spark, str(path), infer=False, na_values=["<none>"])
    got = in_order(df, "id", "note", "z")
    assert [tuple(x or "" for x in r) for r in got] == [tuple(r) for r in rows]
    if small_splits == "64":
        assert df.select("_pos_block").distinct().count() > 20


def test_csv_steps():
    g = CsvGrammar()
    for line, out, inside in [("a,b", 0, 1), ('a,"b', 1, 0), ('"a""', 1, 0), ('"a"" , "b"', 1, 0), ('a"b', 0, 0), ('a "b,c', 0, 1), ('""', 0, 1),
                              ('"",""', 0, 0), ('"x"y"z,"w', 1, 0), ('",', 1, 0), ("", 0, 1), ('a,""', 0, 1)]:
        got = (g.step(line, 0)[0], g.step(line, 1)[0])
        want = tuple(_csv_mode(line, m) for m in (0, 1))
        assert got == want, line


def _csv_mode(line, mode):
    """Letter by letter: field start, plain, quoted, behind a quote."""
    state = "quoted" if mode else "start"
    for ch in line:
        if state == "start":
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
        elif state == "plain":
            state = "start" if ch == "," else "plain"
        elif state == "quoted":
            state = "behind" if ch == '"' else "quoted"
        else:
            state = "quoted" if ch == '"' else "start" if ch == "," else "plain"
    return int(state == "quoted")


def test_csv_headers_differ_among_split_files(spark, small_splits, tmp_path):
    (tmp_path / "a.csv").write_text('id,"no\nte"\n1,"x\ny"\n2,plain\n')
    (tmp_path / "b.csv").write_text('w,id\n"1\n2",3\n')
    (tmp_path / "c.csv").write_text("id,w\n4,no break\n")
    df = read_csv(spark, [str(tmp_path / f) for f in ("b.csv", "a.csv", "c.csv")], infer=False)
    assert in_order(df, "source_file", "id", "no\nte", "w") == [
        ("b.csv", "3", None, "1\n2"), ("a.csv", "1", "x\ny", None), ("a.csv", "2", "plain", None), ("c.csv", "4", None, "no break")]
    (tmp_path / "long.csv").write_text('id,w\n1,"x\ny",more\n')
    with pytest.raises(Exception, match="more than 2 fields"):
        read_csv(spark, str(tmp_path / "long.csv"), infer=False).collect()


def _values(rnd, deep=0):
    kind = rnd.randrange(7 if deep < 3 else 5)
    if kind < 3:
        return "".join(rnd.choice(['}', '{', '"', "\\", "[", "]", "é", "\n", "abc", ","]) for _ in range(rnd.randrange(12)))
    if kind < 5:
        return rnd.choice([1, -2.5, True, None, 10**12])
    if kind == 5:
        return [_values(rnd, 3) for _ in range(rnd.randrange(4))]
    return {k: _values(rnd, deep + 1) for k in rnd.sample(["p", "q", "}"], rnd.randrange(3))}


@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays(spark, small_splits, tmp_path, indent):
    rnd = random.Random(3)
    data = [{"id": i, "text": _values(rnd, 3) if i % 2 else "x}", "deep": json.dumps(_values(rnd)), "tags": [{"k": "}"}] * (i % 3)} for i in range(90)]
    data = [{**d, "text": str(d["text"])} for d in data]
    one, two = tmp_path / "one.json", tmp_path / "two.json"
    one.write_text(json.dumps(data[:80], indent=indent, ensure_ascii=False))
    two.write_text("\n " + json.dumps(data[80:], indent=indent) + " \n")
    df = read_json(spark, [str(two), str(one)])
    got = [(r.id, r.text, r.deep, [t.k for t in r.tags]) for r in df.orderBy(*ROW_ORDER).collect()]
    assert got == [(d["id"], d["text"], d["deep"], [t["k"] for t in d["tags"]]) for d in data[80:] + data[:80]]
    if small_splits == "64":
        assert df.select("_pos_file", "_pos_block").distinct().count() > 20
    assert sorted(read_json(spark, str(one), schema=df.select("id").schema).columns) == sorted(["id", "source_file", *ROW_ORDER])


@pytest.mark.parametrize("text", ['[{"a": 1}, {"a": ', '[{"a": 1}', '{"a": 1}', '[{"a": 1}, 2]', "[1, 2]", '[{"a": 1},]', '[{"a": 1}] x', '[{"a": "1}]',
                                  '[{"a": 1} {"a": 2}]', '[{"a": tru}]'])
def test_what_is_no_array_of_objects_raises(spark, tmp_path, text):
    path = tmp_path / "bad.json"
    path.write_text(text)
    with pytest.raises(TablePrepError):
        read_json(spark, str(path)).collect()


def test_empty_array(spark, tmp_path):
    (tmp_path / "none.json").write_text(" [ ]\n")
    (tmp_path / "some.json").write_text('[{"a": 1}]')
    assert in_order(read_json(spark, [str(tmp_path / "none.json"), str(tmp_path / "some.json")]), "a", "_pos_file") == [(1, 1)]
    assert read_json(spark, str(tmp_path / "none.json")).count() == 0


def test_json_steps():
    g = JsonGrammar()
    assert g.step('{"a": "x', 0) == (1, 1) and g.step('y"', 1) == (0, -1) and g.step("{[", 1) == (1, 0)
    assert g.step('{"a": "\\\\"', 0) == (0, 0) and g.step('{"a": "\\"', 0) == (1, 1)


XML = """<?xml version="1.0"?><!DOCTYPE records [ <!ELEMENT a (b)> ]>
<!-- <record><name>no</name></record> --><records kind="a>b">
<group><record><name>too deep</name></record></group>
%s
<record/><record /><other>text</other><!-- </record> -->
</records><!-- end -->
"""


def test_xml_records(spark, small_splits, tmp_path):
    one = "<record id='%d'><name>n%d</name><city><![CDATA[a </record> b]]></city><record>inner %d</record><x a='/>'>1</x></record>\n"
    path = tmp_path / "r.xml"
    path.write_text(XML % "".join(one % (i, i, i) for i in range(40)))
    root = ET.parse(path).getroot()
    want = [tuple({c.tag: c.text for c in r}.get(k) for k in ("name", "city", "record", "x")) for r in root.findall("record")]
    df = read_xml(spark, str(path))
    assert in_order(df, "name", "city", "record", "x") == want and len(want) == 42
    assert set(df.columns) == {"name", "city", "record", "x", "source_file", *ROW_ORDER}
    if small_splits == "64":
        assert df.select("_pos_block").distinct().count() > 20
    assert read_xml(spark, str(path), columns=["x"]).count() == 42


@pytest.mark.parametrize("text", ["<records><group><record><a>1</a></record></group></records>", "<records><record/></records>",
                                  "<records><record><a>1</a></record>", "<records><record><a>1</a></record><record><a>", "<r><!-- <record><a/></record> --></r>"])
def test_xml_without_records_raises(spark, tmp_path, text):
    path = tmp_path / "bad.xml"
    path.write_text(text)
    with pytest.raises(TablePrepError):
        read_xml(spark, str(path)).collect()


def test_headers_of_many_files_in_one_job(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"f {i:02}.csv").write_text(f"\n\n{'id,x' if i % 2 else 'x,id'}\n{i},{i + 1}\n")
    listed = list_files(spark, str(tmp_path))
    assert set(first_lines(spark, listed, listed.names).values()) == {"id,x", "x,id"}
    df = read_csv(spark, str(tmp_path))
    assert in_order(df, "id", "x") == [(i, i + 1) if i % 2 else (i + 1, i) for i in range(40)]
