"""Cleaning and filtering on streaming DataFrames (files arriving in a folder).

The stateless steps -- empty rows, null fill with a given value, trimming,
column names, casts, formulas, dates and every filter -- are the same Column
expressions as in batch and run unchanged on ``readStream`` input.  Steps
that need the whole input (empty-column detection, row slices, chunking) are
refused.  Keep-first de-duplication becomes Spark's streaming de-duplication:
the first row seen per key wins and is kept in the state store; with a
watermark the state is bounded.  With ``order_by`` the first row by that order wins,
however late it comes within the watermark (``keep_first_by_order``).
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError
from ..plans.tasks import _opts, clean

STATEFUL_ONLY = ("remove_empty_columns",)


def read_csv_stream(spark: SparkSession, folder: str, schema: T.StructType, *, max_files: int = 100) -> DataFrame:
    """New CSV files in ``folder`` as a stream (explicit schema: no inference
    on a stream), with ``source_file`` provenance."""
    return (spark.readStream.schema(schema).option("header", True).option("multiLine", True)
            .option("quote", '"').option("escape", '"').option("maxFilesPerTrigger", max_files)
            .csv(folder).withColumn("source_file", F.col("_metadata.file_name")))


_STAMP = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def _sortable(df: DataFrame, name: str) -> Column:
    """An order column as a number or text that compares alike in Python."""
    kind, col = df.schema[name].dataType, F.col(f"`{name}`")
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(col)
    if isinstance(kind, T.DateType):
        return F.unix_date(col).cast("long")
    if isinstance(kind, T.IntegralType):
        return col.cast("long")
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return col.cast("double")
    if isinstance(kind, T.StringType):
        return col
    raise TablePrepError(f"rows can't be ordered by {name}, a {kind.simpleString()}, on a stream")


def keep_first_by_order(df: DataFrame, columns: list[str], order_by: list[str], event_time: str, delay: str) -> DataFrame:
    """Of the rows of a key the first by ``order_by`` (nulls first, then the smallest), once no
    earlier one can come.

    The state of a key is its best row so far and the least event time seen; a row that
    comes later and is smaller takes its place.  When the watermark (``delay`` behind the
    newest event) passes that event time, the row is emitted and the state is dropped,
    so the state is bounded by what arrives within the delay.  Rows of a key further apart than the
    delay are first rows each.  Rows without an event time are emitted by the first timer
    that fires for their key."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    fields = [f"o{i}" for i in range(len(order_by))]
    orders = [_sortable(df, c).alias(f) for c, f in zip(order_by, fields)]
    packed = df.withWatermark(event_time, delay).select(
        *[F.col(f"`{c}`") for c in columns], F.col(f"`{event_time}`").alias("_tp_time"),
        F.unix_millis(event_time).alias("_tp_ms"), *orders, F.to_json(F.struct("*"), {"ignoreNullFields": "false", **_STAMP}).alias("_tp_row"))

    def rank(values):
        return tuple((0, 0) if v is None or v != v else (1, v) for v in values)

    def first(key, frames, state):
        import pandas as pd

        if state.hasTimedOut:
            (*_, row, _) = state.get
            state.remove()
            yield pd.DataFrame({"_tp_row": [row]})
            return
        best = tuple(state.get) if state.exists else None
        due = best[-1] if best else None
        for frame in frames:
            for *place, row, ms in zip(*(frame[f].tolist() for f in fields), frame["_tp_row"].tolist(), frame["_tp_ms"].tolist()):
                place = tuple(None if v is None or v != v else v for v in place)
                if ms is not None and ms == ms:
                    due = int(ms) if due is None else min(due, int(ms))
                if best is None or rank(place) < rank(best[:len(fields)]):
                    best = (*place, row, None)
        due = due if due is not None else 0
        state.update((*best[:-1], due))
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs()) + 1)

    kinds = dict(packed.dtypes)
    state = ", ".join(f"{f} {kinds[f]}" for f in fields) + ", row string, due bigint"
    out = packed.groupBy(*columns).applyInPandasWithState(first, "_tp_row string", state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("_tp_row", df.schema, _STAMP).alias("r")).select("r.*")


def clean_stream(df: DataFrame, tasks: dict, *, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Apply a clean spec to a streaming DataFrame.

    ``remove_duplicates`` keeps the first row *seen* per key; ``watermark``
    ``(event_time_col, delay)`` bounds the state (duplicates further apart
    than the delay are not caught).  With ``order_by`` in its options (and a watermark) it
    keeps the first row by that order.  A text ``replace_nulls`` value fills
    text columns only (which numeric columns hold nulls is unknowable on an
    unbounded input).
    """
    if not df.isStreaming:
        raise TablePrepError("clean_stream needs a streaming DataFrame; use clean() for batch")
    bad = [k for k in STATEFUL_ONLY if _opts(tasks.get(k)) is not None]
    if bad:
        raise TablePrepError(f"not available on a stream: {bad}")
    tasks = dict(tasks)
    dd = _opts(tasks.pop("remove_duplicates", None))
    if _opts(tasks.get("remove_empty_rows")) is not None:
        df = clean(df, {"remove_empty_rows": True})
        tasks.pop("remove_empty_rows")
    if dd is not None:
        cols = dd.get("columns") or [c for c in df.columns if c != "source_file"]
        if dd.get("order_by"):
            if not watermark:
                raise TablePrepError("keeping the first row by an order needs a watermark: a smaller one could always come")
            order = [dd["order_by"]] if isinstance(dd["order_by"], str) else list(dd["order_by"])
            df = keep_first_by_order(df, list(cols), order, *watermark)
        elif watermark:
            df = df.withWatermark(*watermark).dropDuplicatesWithinWatermark(cols)
        else:
            df = df.dropDuplicates(cols)
    return clean(df, tasks, numeric_fill="skip")
