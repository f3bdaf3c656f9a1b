"""Session helpers: settings the library reads, never hard-codes."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

from .errors import TablePrepError


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    directory).  Only when neither is set and the master is local (tests) is a
    private folder created; on a cluster that is an error, since a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir:
        if not sc.master.startswith("local"):
            raise TablePrepError("set spark.checkpoint.dir to a folder shared by the cluster")
        conf_dir = tempfile.mkdtemp(prefix="tableprep-ckpt-")  # local runs and tests only
    sc.setCheckpointDir(conf_dir)
    return sc._jsc.sc().getCheckpointDir().get()


def default_parallelism(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.sparkContext.defaultParallelism))
    except Exception:  # Spark Connect has no SparkContext
        return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def local_session(app: str = "tableprep", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and the bench: UI off, UTC, AQE on."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
