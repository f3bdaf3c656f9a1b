"""Helpers shared by the corpus operators."""
from __future__ import annotations

import string
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z and nothing else (``lower`` would also fold other letters)."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that ``spark.checkpoint.dir`` names."""
    return f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def cut(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends in
    files every executor sees, so a lost executor costs a re-read, not a re-run."""
    path = scratch(df.sparkSession, tag)
    df.write.parquet(path)
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are done.  It does so
    when the driver's JVM collects them, which by itself happens every
    ``spark.cleaner.periodicGC.interval`` (30 minutes): late, when a job has
    written more than that in between."""
    spark._jvm.System.gc()


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Remove a scratch table once nothing reads it any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)
