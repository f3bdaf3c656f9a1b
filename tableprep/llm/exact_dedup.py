"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by digest, one row per distinct
normalised text: ``digest`` (binary sha-256), ``keep_id``, ``group_size``.  New
data is first reduced to one row per digest (partial aggregation in each map
task, so a text that holds a third of all rows is one row per task in the
shuffle), then anti-joined with the index by a sort-merge join on the bucketed
and sorted files, and what is new is appended.

DataFrame functions only.  The text itself is read once and never shuffled.

Defined results: a null text counts as empty, and all empty texts are equal; a
null ``doc_id`` is smaller than any other, and a group of null ids keeps a null;
rows that repeat both text and id are one document and share one decision; an
empty table gives an empty table.  Only the named columns are read, so other
columns may have any name.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import TablePrepError
from .common import lower_ascii, scratch

BUCKETS = 64


def digest(text: Column) -> Column:
    """sha-256 (binary) of the text with A-Z lower-cased, null as empty."""
    return F.unhex(F.sha2(lower_ascii(F.coalesce(text, F.lit(""))).cast("binary"), 256))


def _qualified(spark: SparkSession, path: str) -> str:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(jvm_path).toString()


class DigestIndex:
    """A digest table ``name`` kept at ``path`` between runs.

    Opening an index that the catalog has under ``name`` continues it with the
    number of buckets it was made with, whatever ``buckets`` says; it must lie at
    ``path``.
    """

    def __init__(self, spark: SparkSession, path: str, name: str, buckets: int = BUCKETS):
        self.spark, self.path, self.name, self.buckets = spark, path, name, buckets
        if spark.catalog.tableExists(name):
            told = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE EXTENDED {name}").collect()}
            if _qualified(spark, told["Location"]) != _qualified(spark, path):
                raise TablePrepError(f"the index {name} lies at {told['Location']}, not at {path}")
            self.buckets = int(told["Num Buckets"])
        else:
            spark.sql(
                f"CREATE TABLE {name} (digest BINARY, keep_id BIGINT, group_size BIGINT) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'")

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, groups: DataFrame) -> None:
        """Add the digests of ``groups`` (digest, keep_id, group_size; one row
        per digest) that the index does not have.  A digest it has keeps its
        first decision."""
        new = groups.join(self.table().select("digest").hint("merge"), "digest", "left_anti")
        (new.repartition(self.buckets, "digest").write.format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest").mode("append").saveAsTable(self.name))

    def files(self) -> DataFrame:
        """The same rows as plain Parquet, without the bucketing: a join with
        them shuffles both sides, so Spark can split a hot digest's rows."""
        return self.spark.read.schema("digest binary, keep_id bigint, group_size bigint").parquet(self.path)


def groups(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per distinct normalised text: the largest id and the row count."""
    return (docs.select(digest(F.col(text_col)).alias("digest"), F.col(id_col).alias("id"))
            .groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))


def dedupe(docs: DataFrame, index: DigestIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decide every row of ``docs`` and append the new digests to ``index``.

    Returns ``id_col``, ``digest``, ``keep_id``, ``group_size`` and ``kept``; a
    text that the index held before this call keeps nothing of ``docs`` unless
    it is the very row that stayed then.
    """
    index.append(groups(docs, id_col=id_col, text_col=text_col))
    rows = docs.select(F.col(id_col).alias("id"), digest(F.col(text_col)).alias("digest"))
    return (rows.join(index.files().hint("merge"), "digest")
            .select(F.col("id").alias(id_col), "digest", "keep_id", "group_size",
                    F.col("id").eqNullSafe(F.col("keep_id")).alias("kept")))


def fresh_index(spark: SparkSession, tag: str = "digest_index", buckets: int = BUCKETS) -> DigestIndex:
    """An empty index in the shared scratch folder, for one-off runs."""
    path = scratch(spark, tag)
    return DigestIndex(spark, path, path.rpartition("/")[2].replace("-", "_"), buckets)
