"""Union by name with type widening (U1) and provenance (U2-U6)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TablePrepError
from ..functions.text import standard_name
from ..functions.variant import is_variant, to_variant

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


MIXED = ("text", "variant")


def widen(types: list[T.DataType], mixed: str = "text") -> T.DataType:
    """One type for a column seen with several: equal -> same; integers ->
    bigint; integers and fractions -> double; anything else -> string, or with
    ``mixed="variant"`` a variant, in which every value keeps its type."""
    if mixed not in MIXED:
        raise TablePrepError(f"mixed columns can be {MIXED}, not {mixed!r}")
    types = [t for t in types if not isinstance(t, T.NullType)]
    if not types:
        return T.StringType()
    first = types[0]
    if all(t == first for t in types):
        return first
    if all(isinstance(t, _INTEGRAL) for t in types):
        return T.LongType()
    if all(isinstance(t, _INTEGRAL + _FRACTIONAL) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)) for t in types):
        return T.TimestampType()
    return T.VariantType() if mixed == "variant" else T.StringType()


def check_case(spark, names) -> None:
    """Refuse names that Spark would take for one (unless it is told to tell
    letter case apart)."""
    if spark.conf.get("spark.sql.caseSensitive", "false") != "true":
        seen: dict[str, str] = {}
        for n in names:
            if seen.setdefault(n.lower(), n) != n:
                raise TablePrepError(f"columns {seen[n.lower()]!r} and {n!r} differ only in case; rename one or lower-case the names")


def union_by_name(dfs: list[DataFrame], widen_types: bool = True, mixed: str = "text") -> DataFrame:
    """Outer union by column name: columns in first-seen order, absent ones
    null, clashing types widened before the union (decided from schemas).
    ``mixed``: what numbers beside text become, see ``widen``."""
    dfs = [d for d in dfs if d is not None]
    if not dfs:
        raise TablePrepError("nothing to merge")
    order: list[str] = []
    seen: dict[str, list[T.DataType]] = {}
    for d in dfs:
        for f in d.schema.fields:
            if f.name not in seen:
                order.append(f.name)
                seen[f.name] = []
            seen[f.name].append(f.dataType)
    check_case(dfs[0].sparkSession, order)
    target = {n: (widen(ts, mixed) if widen_types else ts[0]) for n, ts in seen.items()}

    def conform(d: DataFrame) -> DataFrame:
        have = dict((f.name, f.dataType) for f in d.schema.fields)
        cols = []
        for n in order:
            if n in have:
                col = F.col(f"`{n}`")
                if have[n] != target[n]:
                    col = (to_variant(col, have[n]) if is_variant(target[n]) else col.cast(target[n])).alias(n)
                cols.append(col)
            else:
                cols.append(F.lit(None).cast(target[n]).alias(n))
        return d.select(*cols)

    return reduce(lambda a, b: a.unionByName(b), [conform(d) for d in dfs])


def lower_names(df: DataFrame, keep=("source_file", "source_sheet")) -> DataFrame:
    """Strip and lower-case column names; a clash after renaming is an error."""
    new = [c if c in keep else standard_name(c, "lowercase") for c in df.columns]
    if len(set(new)) != len(new):
        dup = sorted({n for n in new if new.count(n) > 1})
        raise TablePrepError(f"Column names collide after lower-casing: {dup}")
    return df.toDF(*new)


def tag_source(df: DataFrame, source_file=None, source_sheet=None) -> DataFrame:
    """Add provenance: ``source_file`` from a literal or from the scan's
    ``_metadata.file_name``; ``source_sheet`` from a literal or a column."""
    if source_file is None:
        df = df.withColumn("source_file", F.col("_metadata.file_name"))
    elif isinstance(source_file, str):
        df = df.withColumn("source_file", F.lit(source_file))
    if source_sheet is not None:
        df = df.withColumn("source_sheet", F.lit(source_sheet) if isinstance(source_sheet, str) else source_sheet)
    return df


def merge(dfs: list[DataFrame], lower: bool = True, with_source: bool = True, mixed: str = "text") -> DataFrame:
    """U2/U4/U5: optionally lower-case names, tag, then union by name
    (``mixed`` as in ``widen``).

    Each input must already carry ``source_file`` when ``with_source``.
    """
    prepared = []
    for d in dfs:
        if lower:
            d = lower_names(d)
        if with_source and "source_file" not in d.columns:
            raise TablePrepError("input lacks source_file")
        prepared.append(d)
    return union_by_name(prepared, mixed=mixed)
