"""A table that keeps its row index: slices without counting, sampling or shuffling.

``IndexedTable.build`` orders the rows once (F1) and writes them as zones, one sorted file
of ``rows_per_zone`` rows each, and beside them a zone map: file, first row number, rows, first
and last key.  A slice then reads the few zone map rows of its range, opens their files and
numbers each row by its place in its file, which Parquet keeps itself.  A range of keys is found
the same way.

Rows whose keys all lie behind the last one are appended as further zones.  The zone map is
written after the files it names, so a build or append that fails leaves the table as it was;
what no zone map row names is never read.
"""
from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError
from ..operators.split import with_parts

ROWS_PER_ZONE = 1_000_000
MAX_ZONES = 100_000  # that one slice opens
ZONE = "_tp_zone"


class IndexedTable:
    """The table at ``path``, ordered by the columns ``order_by`` (no two rows equal in them)."""

    def __init__(self, spark: SparkSession, path: str, order_by):
        self.spark, self.path = spark, path.rstrip("/")
        self.order = [order_by] if isinstance(order_by, str) else list(order_by)
        self.map_path = f"{self.path}/zone_map"

    @classmethod
    def build(cls, df: DataFrame, path: str, order_by, rows_per_zone: int = ROWS_PER_ZONE) -> IndexedTable:
        """Write ``df`` as a new table; there must be none at ``path``."""
        table = cls(df.sparkSession, path, order_by)
        if table._exists():
            raise TablePrepError(f"there is a table at {path}; append to it")
        table._add(df, 0, rows_per_zone)
        return table

    def append(self, df: DataFrame, rows_per_zone: int = ROWS_PER_ZONE) -> None:
        """Add rows that come behind the last one."""
        last = self.zones().agg(F.max("last").alias("last"), F.max(F.col("first_index") + F.col("rows")).alias("n")).first()
        if last["n"] is not None:
            bound = F.struct(*[F.lit(v).cast(t.dataType).alias(t.name) for v, t in zip(last["last"], self.zones().schema["last"].dataType.fields)])
            if not df.where(self._key() <= bound).isEmpty():
                raise TablePrepError("appended rows must come behind the last key; build the table anew")
        self._add(df, last["n"] or 0, rows_per_zone)

    def _key(self) -> Column:
        return F.struct(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(self.order)])

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.map_path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _add(self, df: DataFrame, base: int, rows_per_zone: int) -> None:
        data = f"{self.path}/zones-{uuid.uuid4().hex}"
        parted = with_parts(df, rows_per_zone, self.order, part_col=ZONE)
        parted.repartition(ZONE).sortWithinPartitions(ZONE, *self.order).write.partitionBy(ZONE).parquet(data)
        files = self.spark.read.schema(T.StructType([*df.schema.fields, T.StructField(ZONE, T.LongType())])).parquet(data)
        key = self._key()
        zones = files.groupBy(ZONE, F.col("_metadata.file_path").alias("file")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))
        first = (F.col(ZONE) - 1) * rows_per_zone + base
        zones.select("file", first.alias("first_index"), "rows", "first", "last").coalesce(1).write.mode("append").parquet(self.map_path)

    def zones(self) -> DataFrame:
        return self.spark.read.parquet(self.map_path)

    def count(self) -> int:
        """Rows of the table, from the zone map."""
        return self.zones().agg(F.sum("rows")).first()[0] or 0

    def _read(self, zones: DataFrame, index_col: str) -> DataFrame | None:
        """The rows of ``zones`` with their numbers, or None without zones."""
        picked = zones.select("file", "first_index").limit(MAX_ZONES + 1).collect()
        if len(picked) > MAX_ZONES:
            raise TablePrepError(f"more than {MAX_ZONES} zones are asked for; read the table's files instead")
        if not picked:
            return None
        starts = self.spark.createDataFrame(picked, "_tp_file string, _tp_first bigint")
        rows = self.spark.read.parquet(*[r["file"] for r in picked])
        rows = rows.select("*", F.col("_metadata.file_path").alias("_tp_path"), F.col("_metadata.row_index").alias("_tp_row"))
        return (rows.join(F.broadcast(starts), F.col("_tp_path") == F.col("_tp_file"))
                .withColumn(index_col, F.col("_tp_first") + F.col("_tp_row")).drop("_tp_path", "_tp_row", "_tp_file", "_tp_first"))

    def _none(self, index_col: str) -> DataFrame:
        some = self.zones().limit(1).collect()
        schema = self.spark.read.parquet(some[0]["file"]).schema if some else T.StructType([])
        return self.spark.createDataFrame([], schema).withColumn(index_col, F.lit(0).cast("long"))

    def slice(self, start: int, end: int, *, index_col: str = "row_idx") -> DataFrame:
        """Rows ``start..end`` (0-based, end inclusive) with their numbers; a range that ends behind
        the last row raises."""
        if start < 0 or end < start or end >= self.count():
            raise TablePrepError(f"row range {start}..{end} is not within {self.count()} rows")
        zones = self.zones().where((F.col("first_index") <= end) & (F.col("first_index") + F.col("rows") > start))
        return self._read(zones, index_col).where(F.col(index_col).between(start, end))

    def between(self, low, high, *, index_col: str = "row_idx") -> DataFrame:
        """Rows whose first order column lies in ``low..high`` (both included), with their numbers."""
        zones = self.zones().where((F.col("first.k0") <= F.lit(high)) & (F.col("last.k0") >= F.lit(low)))
        rows = self._read(zones, index_col)
        return self._none(index_col) if rows is None else rows.where(F.col(f"`{self.order[0]}`").between(F.lit(low), F.lit(high)))
