"""Connected components of a link table, by large-star and small-star rounds
(Kiveris et al., 2014).

A round hangs every node's larger neighbours, then its smaller ones, under the
smallest node it sees.  The number of rounds grows with the logarithm of the
longest path.  Links stay in tables: each round is written to the shared folder,
and only a row count and a checksum reach the driver.  A hub with many links is
summed before the shuffle, and the joins can be split by Spark.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(links: DataFrame, large: bool) -> DataFrame:
    """One star step over links (a, b), a < b."""
    if large:
        seen = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        seen = links.select(F.col("b").alias("a"), F.col("a").alias("b"))
    least = seen.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
    hung = seen.join(least, "a")
    if large:
        out = hung.where("b > a").select(F.col("low").alias("a"), "b")
    else:
        out = hung.select(F.col("low").alias("a"), "b").unionAll(least.select(F.col("low").alias("a"), F.col("a").alias("b")))
    return out.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): for every node with a link, the smallest node that
    links reach.  ``links`` may repeat pairs, hold both directions and loops."""
    now = cut(links.select(F.least(a, b).cast("bigint").alias("a"), F.greatest(a, b).cast("bigint").alias("b"))
              .where("a != b").distinct(), "links")
    was = None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == was or mark[0] == 0:
            break
        was = mark
        now = cut(_star(_star(now, True), False), "links")
    roots = now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(roots)
