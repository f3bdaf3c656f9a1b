"""Explicit row order: a dense 0-based index without a one-partition sort.

Spark DataFrames have no row order, while slicing, chunking, keep-first
de-duplication and sheet positions all need one.  Every operator here takes an
``order_by`` list that must be unique (ties make results unstable).

``with_row_index`` works the same way at every size:

1. ``count()`` (metadata-only for Parquet) gives the number of buckets B, one
   for every ``rows_per_bucket`` rows.  With B = 1 there is nothing to split.
2. A bounded sample of the order key is sorted in one small task and B-1 bounds
   are taken from it, on the shortest key prefix that tells them apart: a hot
   leading value lengthens the prefix, so it is split across buckets by the
   remaining key columns.
3. ``bucket`` = number of bounds <= key, by a binary descent inside one
   ``aggregate`` over a constant array: one expression whose size does not
   depend on B, so filters pushed through it stay small.  It is a pure function
   of the row, hence identical in every job and on task retry.
4. One aggregate gives rows per bucket (<= B rows reach the driver); their
   running sum is each bucket's first index.  For a slice, buckets that cannot
   contain the requested range are dropped *before* the shuffle.
5. ``row_number()`` over ``partitionBy(bucket)`` plus the bucket offset.  This
   is the only shuffle of the data; each window partition is one bucket.

**File order needs no shuffle.**  The readers' key (``ROW_ORDER``: file, split, row in the
split) is dense inside each split, so ``split_index`` counts the rows of each split in
one aggregate, forms the running sum over the splits on the driver (one small row a split, as the
driver holds for its own file splits) and adds it in the map tasks.  After a filter the
rows of a split are numbered anew where they stand, as long as everything since the scan
is row by row; any other plan takes the way above.

With ``partition_by`` (an index per group) the buckets still follow the order
key and the groups become extra window keys; offsets are per (group, bucket).
"""
from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError

# Columns the file readers attach so that "file order" is an explicit key.
ROW_ORDER = ["_pos_file", "_pos_block", "_pos_row"]

ROWS_PER_BUCKET = 50_000
MAX_BUCKETS = 32_768
OVERSAMPLE = 32
SAMPLE_KEYS = 400_000
SEED = 7


def _names(cols) -> list[str]:
    if cols is None:
        return []
    if isinstance(cols, str):
        return [cols]
    return list(cols)


def _check_columns(df: DataFrame, cols: Sequence[str]) -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise TablePrepError(f"no such columns: {missing}")


def _bucket_count(n: int, rows_per_bucket: int, max_buckets: int) -> int:
    return int(min(max_buckets, max(1, math.ceil(n / rows_per_bucket))))


def _comparable(df: DataFrame, key: str) -> tuple[Column, T.DataType]:
    """The key as bounds carry it: timestamps as microseconds, since their text
    in local time is ambiguous at a clock change."""
    col, kind = F.col(f"`{key}`"), df.schema[key].dataType
    return (F.unix_micros(col), T.LongType()) if isinstance(kind, T.TimestampType) else (col, kind)


def _sample_bounds(df: DataFrame, keys: list[str], n: int, buckets: int, oversample: int, seed: int):
    """B-1 ascending bounds of the composite key, as tuples of strings.

    Values travel as Spark's own string form and are cast back to the column
    type, which is exact for numbers, strings and dates.
    """
    target = min(buckets * oversample, max(SAMPLE_KEYS, 8 * buckets))
    fraction = min(1.0, 1.5 * target / max(n, 1))
    sample = df.select(*[_comparable(df, k)[0].alias(k) for k in keys])
    if fraction < 1.0:
        sample = sample.sample(False, fraction, seed)
    rows = (
        sample.repartition(1)
        .sortWithinPartitions(*keys)
        .select(*[F.col(f"`{k}`").cast("string").alias(k) for k in keys])
        .collect()
    )
    if len(rows) < 2:
        return []
    step = len(rows) / buckets
    bounds = []
    for i in range(1, buckets):
        b = tuple(rows[min(len(rows) - 1, int(i * step))])
        if not bounds or bounds[-1] != b:
            bounds.append(b)
    return bounds


def _dedupe(bounds: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for b in bounds:
        if not out or out[-1] != b:
            out.append(b)
    return out


def _prefix_width(bounds: list[tuple], min_width: int = 0, keep: float = 0.9) -> int:
    """Shortest key prefix that still tells (almost) all bounds apart.

    Bucketing on a prefix is exact -- the prefix order agrees with the full
    order, so buckets stay contiguous -- and a one-column test is much cheaper
    than a lexicographic one.  A hot leading value makes many bounds share
    their first column and so lengthens the prefix automatically.
    """
    if not bounds:
        return max(1, min_width)
    full = len(_dedupe(bounds))
    for w in range(max(1, min_width), len(bounds[0]) + 1):
        if len(_dedupe([b[:w] for b in bounds])) >= keep * full:
            return w
    return len(bounds[0])


def _bucket_range(df: DataFrame, key: str, bounds: list[tuple], first: int, last: int) -> Column:
    """Buckets ``first..last`` of a one-column bucketing as a plain range on
    that column -- the same rows, but a predicate Parquet can use to skip row
    groups.  Null keys sort first and live in bucket 0."""
    t, col, cond = df.schema[key].dataType, F.col(f"`{key}`"), F.lit(True)

    def literal(text: str) -> Column:
        return F.timestamp_micros(F.lit(int(text))) if isinstance(t, T.TimestampType) else F.lit(text).cast(t)

    if first > 0 and bounds[first - 1][0] is not None:
        cond = cond & (col >= literal(bounds[first - 1][0]))
    if last < len(bounds) and bounds[last][0] is not None:
        upper = col < literal(bounds[last][0])
        cond = cond & (upper | col.isNull() if first == 0 else upper)
    return cond


def typed_array(values: list, dtype) -> Column:
    """One array constant from a driver list: a JSON text parsed and cast
    element-wise, which constant folding turns into a single literal (one
    call into the JVM instead of one per element)."""
    text = json.dumps([None if v is None else str(v) for v in values])
    return F.from_json(F.lit(text), "array<string>").cast(T.ArrayType(dtype))


def bucket_expr(df: DataFrame, keys: list[str], bounds: list[tuple]) -> Column:
    """Number of bounds <= key (ascending, nulls first).

    A descent by powers of two: ``aggregate`` carries how many bounds are known
    to be <= key and tries to add 2**k, ..., 2, 1.  Bounds are one constant
    array; composite keys and bounds are structs, which compare column by column.
    """
    if not bounds:
        return F.lit(0)
    pairs = [_comparable(df, k) for k in keys]
    if len(keys) == 1:
        key, arr = pairs[0][0], typed_array([b[0] for b in bounds], pairs[0][1])
    else:
        key = F.struct(*[c.alias(f"f{i}") for i, (c, _) in enumerate(pairs)])
        # one JSON literal of {f0.., f1..} records -> array<struct> of text,
        # then a positional struct cast to the key types: folds to a constant
        text = json.dumps([{f"f{i}": (None if v is None else str(v)) for i, v in enumerate(b)} for b in bounds])
        names = [f"f{i}" for i in range(len(keys))]
        raw = T.ArrayType(T.StructType([T.StructField(x, T.StringType()) for x in names]))
        typed = T.ArrayType(T.StructType([T.StructField(x, t) for x, (_, t) in zip(names, pairs)]))
        arr = F.from_json(F.lit(text), raw).cast(typed)
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])

    def add(known: Column, step: Column) -> Column:
        bound = F.get(arr, known + step - 1)  # null beyond the last: not passed
        passed = (bound <= key) | (bound.isNull() & (known + step <= len(bounds)))  # a null bound sorts first
        return F.when(F.coalesce(passed, F.lit(False)), known + step).otherwise(known)

    return F.aggregate(steps, F.lit(0), add)


MAX_SPLITS = 1 << 20  # splits whose running sum is broadcast; beyond it the bucketed index
ROW_BY_ROW = {"Project", "Filter", "SubqueryAlias", "Union", "LogicalRelation"}


def _row_by_row(plan) -> bool:
    """Whether rows reach the end of an optimized plan in the order and the tasks of their scan."""
    kind = plan.getClass().getSimpleName()
    if kind == "Join":  # against a broadcast table, row by row as well
        hint = plan.hint().rightHint()
        strategy = hint.get().strategy() if hint.isDefined() else None
        broadcast = strategy is not None and strategy.isDefined() and strategy.get().toString().lower() == "broadcast"
        return broadcast and plan.joinType().toString() == "LeftOuter" and _row_by_row(plan.left())
    children = plan.children()
    return kind in ROW_BY_ROW and all(_row_by_row(children.apply(i)) for i in range(children.size()))


class SplitIndex:
    """Rows of each split and the column that numbers them."""

    def __init__(self, number: Column, splits: list[tuple]):
        #: (file, block, first number in the split, rows), in file order
        self.number, self.splits = number, splits
        self.total = sum(s[3] for s in splits)


def split_index(df: DataFrame) -> SplitIndex | None:
    """The rows of each split of a frame with the readers' order key, or None where they
    can't be numbered in the map tasks.

    The key's own row number serves where it has no gaps in any split (the key is unique,
    so as many values as the range has places are all of them).  Else a number given at
    this point of the plan does, if the plan up to here is row by row and one task has
    each split whole."""
    here, row = F.monotonically_increasing_id(), F.col("_pos_row")
    aggs = [F.count(F.lit(1)), F.min("_pos_row"), F.max("_pos_row")]
    numbered = df.select("_pos_file", "_pos_block", "_pos_row")
    narrow = _row_by_row(df._jdf.queryExecution().optimizedPlan())
    if narrow:
        numbered = numbered.withColumn("_tp_here", here)
        aggs += [F.min("_tp_here"), F.max("_tp_here")]
    stats = numbered.groupBy("_pos_file", "_pos_block").agg(*aggs).limit(MAX_SPLITS + 1).collect()
    if len(stats) > MAX_SPLITS:
        return None
    for number, at in ((row, 3), *([(here, 5)] if narrow else [])):
        if all(s[at + 1] - s[at] + 1 == s[2] for s in stats):
            return SplitIndex(number, sorted((s[0], s[1], s[at], s[2]) for s in stats))
    return None


def _index_by_split(df: DataFrame, index: SplitIndex, index_col: str, index_range: tuple[int, int] | None,
                    by_file: bool = False) -> DataFrame:
    """Add the running sum over the splits (``by_file``: over those of its file) to each
    row's number in its split.

    A split that was not counted, or a number beyond those counted in it, raises: the
    input then changed or was cut into other splits between the two jobs (set
    ``spark.sql.files.minPartitionNum`` where executors come and go)."""
    rows, run, last = [], 0, None
    for file, block, first, n in index.splits:
        run, last = (0 if by_file and file != last else run), file
        if index_range is None or (run <= index_range[1] and run + n > index_range[0]):
            rows.append((file, block, first, n, run))
        run += n
    out = df
    if index_range is not None:  # only the splits in range go on
        if not rows:
            return df.withColumn(index_col, F.lit(0).cast("long")).where(F.lit(False))
        place = F.struct("_pos_file", F.col("_pos_block").cast("long"))
        ends = [F.struct(F.lit(r[0]).cast("int"), F.lit(r[1]).cast("long")) for r in (rows[0], rows[-1])]
    spark = df.sparkSession
    table = spark.createDataFrame(rows, "_tp_f int, _tp_b long, _tp_first long, _tp_n long, _tp_run long")
    out = out.withColumn("_tp_number", index.number.cast("long"))
    if index_range is not None:
        out = out.where((place >= ends[0]) & (place <= ends[1]))
    out = out.join(F.broadcast(table), (F.col("_pos_file") == F.col("_tp_f")) & (F.col("_pos_block") == F.col("_tp_b")), "left")
    within = F.col("_tp_number") - F.col("_tp_first")
    known = F.coalesce((within >= 0) & (within < F.col("_tp_n")), F.lit(False))
    value = F.when(known, F.col("_tp_run") + within).otherwise(
        F.raise_error(F.lit("rows are in other splits than when they were counted")).cast("long"))
    out = out.withColumn(index_col, value).drop("_tp_number", "_tp_f", "_tp_b", "_tp_first", "_tp_n", "_tp_run")
    return out if index_range is None else out.where(F.col(index_col).between(*index_range))


def with_row_index(
    df: DataFrame,
    order_by,
    *,
    partition_by=None,
    index_col: str = "row_idx",
    index_range: tuple[int, int] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    max_buckets: int = MAX_BUCKETS,
    oversample: int = OVERSAMPLE,
    seed: int = SEED,
    total_rows: int | None = None,
) -> DataFrame:
    """Add ``index_col`` (bigint, 0-based) following ``order_by`` ascending.

    With ``partition_by`` the index restarts in every group.  ``index_range``
    (inclusive) keeps only rows whose index lies in it and prunes whole buckets
    before the shuffle.
    """
    order = _names(order_by)
    parts = _names(partition_by)
    if not order:
        raise TablePrepError("order_by is required for an ordered operation")
    keys = parts + order
    _check_columns(df, keys)
    if order == ROW_ORDER and (not parts or parts == ROW_ORDER[:1] and index_range is None):
        index = split_index(df)
        if index is not None:
            return _index_by_split(df, index, index_col, index_range, by_file=bool(parts))
    n = df.count() if total_rows is None else total_rows

    bcol = "_tp_bucket"
    buckets = _bucket_count(n, rows_per_bucket, max_buckets)
    if buckets == 1:  # one bucket: the window is all there is
        w = Window.partitionBy(*(parts or [F.lit(0)])).orderBy(*order)
        out = df.withColumn(index_col, (F.row_number().over(w) - 1).cast("long"))
        return out if index_range is None else out.where(F.col(index_col).between(*index_range))

    # Buckets follow the order key alone (groups are window keys), so a hot
    # group is spread over all buckets.
    bounds = _sample_bounds(df, order, n, buckets, oversample, seed)
    width = _prefix_width(bounds)
    bounds = _dedupe([b[:width] for b in bounds])
    data = df.withColumn(bcol, bucket_expr(df, order[:width], bounds))

    counts = data.groupBy(bcol, *parts).count()
    w = Window.partitionBy(bcol, *parts).orderBy(*order)
    rn = F.row_number().over(w) - 1

    if not parts:
        per_bucket = dict((r[0], r[1]) for r in counts.collect())  # <= B rows
        offsets, run = [], 0
        for b in range(len(bounds) + 1):
            offsets.append(run)
            run += per_bucket.get(b, 0)
        if index_range is not None:
            lo, hi = index_range
            keep = [
                b for b in range(len(bounds) + 1)
                if per_bucket.get(b, 0) and offsets[b] <= hi and offsets[b] + per_bucket[b] - 1 >= lo
            ]
            # buckets in range are contiguous: a range test, not a long IN list
            data = data.where(F.col(bcol).between(keep[0], keep[-1]) if keep else F.lit(False))
            if width == 1 and keep:
                data = data.where(_bucket_range(df, order[0], bounds, keep[0], keep[-1]))
        off = F.element_at(typed_array(offsets, T.LongType()), F.col(bcol) + 1)
        out = data.withColumn(index_col, (off + rn).cast("long")).drop(bcol)
        if index_range is not None:
            out = out.where(F.col(index_col).between(index_range[0], index_range[1]))
        return out

    # Per-group index: offset(group, bucket) = rows of the group in earlier
    # buckets -- a window over the (bucket, group) count table, which has at
    # most groups x B rows; an ordinary join, broadcast or not as Spark sees fit.
    ocol = "_tp_offset"
    wo = Window.partitionBy(*parts).orderBy(bcol).rowsBetween(Window.unboundedPreceding, -1)
    offs = (counts.withColumn(ocol, F.coalesce(F.sum("count").over(wo), F.lit(0)).cast("long"))
            .where(F.col(ocol) > 0).select(F.col(bcol).alias("_tp_b"), *[F.col(f"`{p}`").alias(f"_tp_p{i}") for i, p in enumerate(parts)], ocol))
    numbered = data.withColumn("_tp_rn", rn)
    cond = [F.col(bcol) == F.col("_tp_b")] + [F.col(f"`{p}`").eqNullSafe(F.col(f"_tp_p{i}")) for i, p in enumerate(parts)]
    out = (numbered.join(offs, cond, "left")
           .withColumn(index_col, (F.coalesce(F.col(ocol), F.lit(0)) + F.col("_tp_rn")).cast("long"))
           .drop(bcol, ocol, "_tp_b", "_tp_rn", *[f"_tp_p{i}" for i in range(len(parts))]))
    if index_range is not None:
        out = out.where(F.col(index_col).between(index_range[0], index_range[1]))
    return out


def slice_rows(
    df: DataFrame,
    start: int,
    end: int,
    order_by,
    *,
    strict: bool = True,
    keep_index: bool = False,
    index_col: str = "row_idx",
) -> DataFrame:
    """Rows ``start..end`` (0-based, end inclusive) in ``order_by`` order.

    ``strict`` reproduces the bounds check: start >= 0, end >= start and
    end < row count.  The bucketed index prunes, so only buckets holding the
    range are shuffled.
    """
    if start is None or end is None or start < 0 or end < start:
        raise TablePrepError(f"row range {start}..{end} is not valid")
    order = _names(order_by)
    if not order:
        raise TablePrepError("order_by is required for an ordered operation")
    _check_columns(df, order)
    index = split_index(df) if order == ROW_ORDER else None
    n = df.count() if index is None else index.total
    if strict and end >= n:
        raise TablePrepError(f"row range {start}..{end} ends past the last of {n} rows")
    if index is not None:
        out = _index_by_split(df, index, index_col, (start, end))
        return out if keep_index else out.drop(index_col)
    out = with_row_index(df, order, index_col=index_col, index_range=(start, end), total_rows=n)
    return out if keep_index else out.drop(index_col)


def file_order_columns(df: DataFrame) -> list[str]:
    """The reader-attached order key, if present."""
    return [c for c in ROW_ORDER if c in df.columns]
