"""Columnar tables (Parquet/ORC) as merge inputs, one DataFrame per path, and
Parquet tables with the order of their rows."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tables(spark: SparkSession, paths: list[str], fmt: str = "parquet") -> list[DataFrame]:
    """Each path as its own DataFrame tagged with ``source_file`` (the scan's
    ``_metadata.file_name``), ready for ``merge``; column pruning and filter
    pushdown still reach every scan."""
    out = []
    for p in paths:
        df = spark.read.format(fmt).load(p)
        out.append(df.withColumn("source_file", F.col("_metadata.file_name")))
    return out


def read_ordered(spark: SparkSession, paths) -> DataFrame:
    """Parquet files (one schema) as one DataFrame with ``source_file`` and the readers'
    order key: ``_pos_row`` is the row's place in its file, which Parquet keeps itself.
    Operators that follow file order number such rows without moving them."""
    from .files import list_files, with_positions

    listed = list_files(spark, paths)
    df = spark.read.parquet(*[p for i, p in enumerate(listed.names) if p not in listed.names[:i]])
    tagged = df.drop("source_file").select(
        "*", F.col("_metadata.file_path").alias("_tp_path"), F.col("_metadata.file_block_start").alias("_pos_block"),
        F.col("_metadata.row_index").alias("_pos_row"))
    return with_positions(spark, tagged, listed).withColumnRenamed("_tp_file", "source_file")
