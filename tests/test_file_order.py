"""Index, slices and parts in file order: numbered in the map tasks, equal to the sorted index."""
import os

import pytest
from pyspark.sql import functions as F

from tableprep.errors import TablePrepError
from tableprep.operators import order
from tableprep.operators.order import ROW_ORDER, slice_rows, split_index, with_row_index
from tableprep.operators.split import with_parts
from tableprep.sinks.writers import write_parts
from tableprep.sources.files import read_csv
from tableprep.sources.tables import read_ordered


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """Three CSV files in several splits each; v counts through them in request order."""
    root, v, paths = tmp_path_factory.mktemp("ordered"), 0, []
    for name, n in (("b", 900), ("a", 500), ("c", 1)):
        path = root / f"{name}.csv"
        path.write_text("v,w\n" + "".join(f"{v + i},{(v + i) * 7 % 11}\n" for i in range(n)))
        v += n
        paths.append(str(path))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    yield read_csv(spark, paths), paths
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in plan.splitlines() if "Exchange" in x and "BroadcastExchange" not in x]


def numbers(df, col="row_idx"):
    return [r[0] for r in df.orderBy("v").select(col).collect()]


def test_index_without_a_shuffle(lines):
    df, _ = lines
    assert df.select("_pos_file", "_pos_block").distinct().count() > 8
    out = with_row_index(df, ROW_ORDER)
    assert exchanges(out) == [] and numbers(out) == list(range(1401))
    parts = with_parts(df, 64, ROW_ORDER)
    assert exchanges(parts) == [] and numbers(parts, "part") == [i // 64 + 1 for i in range(1401)]


def test_filtered_rows_are_numbered_anew(lines):
    df, _ = lines
    some = df.where("w < 4").withColumn("x", F.col("v") + 1)
    out = with_row_index(some, ROW_ORDER)
    assert exchanges(out) == []
    kept = [v for v in range(1401) if v * 7 % 11 < 4]
    assert numbers(out) == list(range(len(kept)))
    cut = slice_rows(some, 10, 333, ROW_ORDER)
    assert exchanges(cut) == [] and numbers(cut, "v") == kept[10:334]
    assert numbers(slice_rows(some, 0, 0, ROW_ORDER), "v") == kept[:1]
    assert slice_rows(some, 9999, 10_000, ROW_ORDER, strict=False).count() == 0
    with pytest.raises(TablePrepError):
        slice_rows(some, 0, len(kept), ROW_ORDER)


def test_other_plans_take_the_sorted_index(spark, lines):
    df, paths = lines
    shuffled = df.where("w < 4").repartition(5, "w")
    assert split_index(shuffled) is None
    assert numbers(with_row_index(shuffled, ROW_ORDER)) == numbers(with_row_index(df.where("w < 4"), ROW_ORDER))
    assert numbers(with_row_index(df.repartition(5), ROW_ORDER)) == list(range(1401))  # no gaps: any plan will do
    twice = read_csv(spark, [paths[1], paths[1]])
    assert sorted(r[0] for r in with_row_index(twice, ROW_ORDER).select("row_idx").collect()) == list(range(1000))
    some = twice.where("w < 4")
    want = sorted((f, v) for f in (0, 1) for v in range(900, 1400) if v * 7 % 11 < 4)
    got = with_row_index(some, ROW_ORDER).orderBy("row_idx").select("_pos_file", "v", "row_idx").collect()
    assert [tuple(r) for r in got] == [(f, v, i) for i, (f, v) in enumerate(want)]


def test_too_many_splits_and_no_rows(lines, monkeypatch):
    df, _ = lines
    assert with_row_index(df.where("v < 0"), ROW_ORDER).count() == 0
    monkeypatch.setattr(order, "MAX_SPLITS", 3)
    assert split_index(df) is None
    assert numbers(with_row_index(df, ROW_ORDER)) == list(range(1401))


def test_other_splits_than_counted_raise(spark, lines):
    df, paths = lines
    index = split_index(df)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3k")
    try:
        with pytest.raises(Exception, match="other splits"):
            order._index_by_split(read_csv(spark, paths), index, "row_idx", None).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")


def test_parquet_rows_keep_their_place(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(5000).withColumnRenamed("id", "v").repartitionByRange(3, "v").sortWithinPartitions("v").write.parquet(path)
    df = read_ordered(spark, path)
    out = with_row_index(df, ROW_ORDER)
    assert exchanges(out) == [] and numbers(out) == list(range(5000))
    odd = slice_rows(df.where("v % 2 = 1"), 1000, 1999, ROW_ORDER)
    assert exchanges(odd) == [] and numbers(odd, "v") == list(range(2001, 4001, 2))


def test_parts_are_one_file_each(spark, lines, tmp_path):
    df, _ = lines
    path = str(tmp_path / "parts")
    write_parts(df, path, "csv", 300, None)
    seen = []
    for part in range(1, 6):
        files = [f for f in os.listdir(f"{path}/part={part}") if f.endswith(".csv")]
        assert len(files) == 1
        seen += [int(x.split(",")[0]) for x in open(f"{path}/part={part}/{files[0]}").read().splitlines()[1:]]
    assert seen == list(range(1401)) and len(os.listdir(path)) >= 5
