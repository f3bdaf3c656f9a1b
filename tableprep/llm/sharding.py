"""Sharding by jump consistent hashing (Lamping and Veach, 2014).

A shard is a function of the stable key and the number of shards alone: no ring
table, nothing to broadcast, nothing to keep.  Going from n to n + 1 shards moves
each key with probability 1 / (n + 1), and only into the new shard.

``slot`` numbers the rows of a shard from 0 without a gap.  A shard of a big
table is too much for one task, so each is cut into sub-shards by a second hash
of the key and the tie-break columns; rows are numbered inside a sub-shard and lifted by the rows of the
sub-shards before it (a table of shards x sub-shards counts).  Both steps use
the same partitioning: the rows are shuffled once.

Defined results: a null key goes where key 0 goes; rows with equal keys share
the shard, and with equal tie-break columns the sub-shard too; a sub-shard takes
slots in the order of key and tie-break columns; an empty table gives an empty
table.
"""
from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_SUBSHARD = 200_000
MIN_SUBSHARDS = 8

MULTIPLIER = 2862933555777941757  # fixed value of the published algorithm


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash of many keys at once; keys that have landed drop out."""
    key = np.asarray(keys).astype(np.int64).view(np.uint64).copy()
    out = np.zeros(len(key), dtype=np.int64)
    live, jump = np.arange(len(key)), np.zeros(len(key), dtype=np.int64)
    with np.errstate(over="ignore"):
        while len(live):
            out[live] = jump
            key[live] = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            step = (key[live] >> np.uint64(33)).astype(np.float64) + 1.0
            ahead = np.floor((jump + 1) * (2147483648.0 / step))
            stay = ahead < shards
            live, jump = live[stay], ahead[stay].astype(np.int64)
    return out


def shard_of(key: Column, shards: int) -> Column:
    """The shard of a key column (bigint), as an int column."""
    if shards < 1:
        raise ValueError("shards must be at least 1")

    @F.pandas_udf("int")
    def _jump(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), shards), dtype="int32")

    return _jump(F.coalesce(key.cast("bigint"), F.lit(0).cast("bigint")))


def sub_shard(key: str, ties: tuple[str, ...], subs: int) -> Column:
    """Rows of one key spread by their tie-break columns."""
    return F.pmod(F.xxhash64(key, *ties), F.lit(subs)).cast("int")


def assign(df: DataFrame, shards: int, *, key: str = "doc_id", ties: tuple[str, ...] = ()) -> DataFrame:
    """Add ``shard``, ``grown_shard`` (with one shard more) and ``slot`` to ``df``.

    ``ties`` are further columns that spread and order rows with equal keys.  ``df`` must
    not have columns of those names; pass the columns that matter.
    """
    subs = max(MIN_SUBSHARDS, math.ceil(df.count() / (shards * ROWS_PER_SUBSHARD)))
    placed = df.withColumns({
        "shard": shard_of(F.col(key), shards), "grown_shard": shard_of(F.col(key), shards + 1),
        "_sub": sub_shard(key, ties, subs)})
    counts = placed.groupBy("shard", "_sub").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_sub").rowsBetween(Window.unboundedPreceding, -1)
    lifts = counts.select("shard", "_sub", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_lift"))
    within = Window.partitionBy("shard", "_sub").orderBy(key, *ties)
    numbered = placed.withColumn("_in", F.row_number().over(within) - 1)
    return (numbered.join(lifts, ["shard", "_sub"])
            .withColumn("slot", (F.col("_lift") + F.col("_in")).cast("bigint")).drop("_sub", "_lift", "_in"))
