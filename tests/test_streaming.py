"""Stateless cleaning on a file stream; first-seen de-duplication."""
import os
import tempfile

import pytest
from pyspark.sql import types as T

from tableprep.errors import TablePrepError
from tableprep.functions.predicates import c, where
from tableprep.streaming.clean_stream import clean_stream, read_csv_stream

SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("name", "age", "city")])


def test_clean_stream_batches(spark):
    src = tempfile.mkdtemp(prefix="tableprep-stream-")
    with open(os.path.join(src, "a.csv"), "w") as f:
        f.write("name,age,city\n Ann ,30,Oslo\nBob,,Rome\n,,\n")
    stream = read_csv_stream(spark, src, SCHEMA)
    cleaned = clean_stream(stream, {
        "remove_empty_rows": True,
        "remove_duplicates": {"columns": ["city"]},
        "replace_nulls": {"value": "?"},
        "trim_whitespace": True,
        "change_data_types": {"age": "int"},
    })
    kept = where(cleaned, c("city") != "Lima")
    q = kept.writeStream.format("memory").queryName("tp_stream_out").outputMode("append").start()
    try:
        q.processAllAvailable()
        with open(os.path.join(src, "b.csv"), "w") as f:
            f.write("name,age,city\nCid,41,Oslo\nDee,7,Lima\nEve,5,Paris\n")
        q.processAllAvailable()
    finally:
        q.stop()
    rows = {r["name"]: (r["age"], r["city"]) for r in spark.sql("select * from tp_stream_out").collect()}
    # Oslo seen first in a.csv: Cid is a duplicate; Lima filtered; '' age -> null -> '?' -> int null
    assert rows == {"Ann": (30, "Oslo"), "Bob": (None, "Rome"), "Eve": (5, "Paris")}


def test_stream_refuses_whole_input_steps(spark):
    src = tempfile.mkdtemp(prefix="tableprep-stream-")
    stream = read_csv_stream(spark, src, SCHEMA)
    with pytest.raises(TablePrepError):
        clean_stream(stream, {"remove_empty_columns": True})
    with pytest.raises(TablePrepError):
        clean_stream(spark.range(3), {"trim_whitespace": True})


def test_keep_first_by_event_order(spark):
    src = tempfile.mkdtemp(prefix="tableprep-stream-")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("at", T.TimestampType()),
                           T.StructField("note", T.StringType())])

    def arrive(name, *lines):
        with open(os.path.join(src, name), "w") as f:
            f.write("k,seq,at,note\n" + "".join(x + "\n" for x in lines))
        q.processAllAvailable()

    stream = read_csv_stream(spark, src, schema).drop("source_file")
    tasks = {"remove_duplicates": {"columns": ["k"], "order_by": ["at", "seq"]}, "trim_whitespace": True}
    kept = clean_stream(stream, tasks, watermark=("at", "10 minutes"))
    q = kept.writeStream.format("memory").queryName("tp_stream_first").outputMode("append").start()
    try:
        arrive("a.csv", "x,5,2024-01-01 10:05:00.123456,later", "y,1,2024-01-01 10:06:00, only ", "x,6,2024-01-01 10:05:00.123456,tie")
        arrive("b.csv", "x,9,2024-01-01 10:01:00,first by time", "x,2,2024-01-01 10:05:00,")  # late, but before the watermark
        assert spark.sql("select * from tp_stream_first").count() == 0
        arrive("c.csv", "z,1,2024-01-01 11:00:00,", "x,1,2024-01-01 10:59:00,again")  # the watermark passes x and y
        arrive("d.csv", "x,0,2024-01-01 09:00:00,too late")
        arrive("e.csv", "z,2,2024-01-01 13:00:00,new")
        arrive("f.csv", "w,2,2024-01-01 13:00:00,new")
    finally:
        q.stop()
    got = {(r.k, r.seq, str(r["at"]), r.note) for r in spark.sql("select * from tp_stream_first").collect()}
    assert {("x", 9, "2024-01-01 10:01:00", "first by time"), ("y", 1, "2024-01-01 10:06:00", "only")} <= got
    assert not any(r[3] in ("too late", "later", "tie") for r in got)
    with pytest.raises(TablePrepError):
        clean_stream(stream, tasks)
