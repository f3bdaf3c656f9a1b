"""The kept row index: slices by the zone map alone."""
import os

import pytest
from pyspark.sql import functions as F

from tableprep.errors import TablePrepError
from tableprep.sources.indexed import IndexedTable


def shuffled(spark, lo, hi):
    return spark.range(lo, hi).select(F.xxhash64("id").alias("h"), (F.col("id") * 2).alias("v"), F.col("id").cast("string").alias("t")).orderBy("h")


def test_slices_open_only_their_zones(spark, tmp_path):
    path = str(tmp_path / "t")
    table = IndexedTable.build(shuffled(spark, 0, 1050), path, "v", rows_per_zone=100)
    assert table.count() == 1050 and table.zones().count() == 11
    assert table.between(5000, 6000).count() == 0
    for zone in table.zones().where("first_index not between 200 and 400").collect():
        with open(zone["file"].removeprefix("file:").replace("///", "/"), "wb") as f:
            f.write(b"no table: a job that counts or samples every zone would fail")
    got = [tuple(r) for r in table.slice(250, 420).orderBy("row_idx").select("row_idx", "v", "t").collect()]
    assert got == [(i, 2 * i, str(i)) for i in range(250, 421)]
    part = table.slice(250, 420)
    assert len(part.inputFiles()) == 3
    part.collect()
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hash" not in plan and "Window" not in plan and "Exchange range" not in plan
    keys = table.between(600, 650)
    assert sorted(r.row_idx for r in keys.collect()) == list(range(300, 326)) and len(keys.inputFiles()) == 1
    for start, end in ((0, 1050), (-1, 3), (5, 4)):
        with pytest.raises(TablePrepError):
            table.slice(start, end)


def test_append_extends_the_map(spark, tmp_path):
    path = str(tmp_path / "t")
    IndexedTable.build(shuffled(spark, 0, 130), path, ["v", "t"], rows_per_zone=50)
    table = IndexedTable(spark, path, ["v", "t"])
    table.append(shuffled(spark, 130, 200), rows_per_zone=30)
    assert [(r.first_index, r.rows) for r in table.zones().orderBy("first_index").collect()] == [
        (0, 50), (50, 50), (100, 30), (130, 30), (160, 30), (190, 10)]
    assert [r.v for r in table.slice(95, 199).orderBy("row_idx").collect()] == [2 * i for i in range(95, 200)]
    with pytest.raises(TablePrepError):
        table.append(shuffled(spark, 199, 210))
    with pytest.raises(TablePrepError):
        IndexedTable.build(shuffled(spark, 0, 3), path, "v")


def test_a_failed_append_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    table = IndexedTable.build(shuffled(spark, 0, 60), path, "v", rows_per_zone=25)
    broken = shuffled(spark, 60, 90).withColumn("t", F.when(F.col("v") < 170, F.col("t")).otherwise(F.raise_error(F.lit("lost"))))
    with pytest.raises(Exception, match="lost"):
        table.append(broken)
    os.makedirs(f"{path}/zones-dead/_tp_zone=1", exist_ok=True)  # what a dead run leaves
    assert table.count() == 60 and [r.v for r in table.slice(0, 59).orderBy("row_idx").collect()] == [2 * i for i in range(60)]
