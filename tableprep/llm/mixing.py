"""Mixing sources to target weights by iterative proportional fitting.

Token weights are raked to target marginals over any number of dimensions
(source, language, topic, ...): the documents are first summed into cells (one
row per combination that occurs), then every cell's weight is scaled in turn so
that each dimension's totals meet their targets, until all totals are within
``TOLERANCE`` of them.  Targets that the cells can't meet (a source that has one
language) stop the sweeps when the largest gap no longer falls, and the gap is
reported as a ``TargetsMissed`` warning.  The
calibrated factor of a cell, divided by the largest, is the probability with
which each of its documents is drawn: expected token shares of the sample are
the raked ones.  The draw is a hash of id and seed, the same in every run.

DataFrame functions only.  Iterations touch the cell table, never documents: a
scaling is one window sum per dimension over rows that are already one per
combination, so a hot source or language has as many rows there as it has
combinations.  The cell table is written to the shared folder between sweeps,
which also cuts the lineage; documents are summed in each map task before the
shuffle.

Defined results: a null dimension value is a value of its own, written
``NULL_VALUE``; a null or empty text has no tokens, weight 0, and has the
probability of its cell like any other; a target for a value
that does not occur is left out and the others are scaled up to 1; a value that
occurs but has no listed share (null, another spelling, another language) keeps
its present share of the tokens, and the listed shares are scaled to the rest; a
listed share of 0 is 0; a null id is hashed as the empty text; repeated rows are
drawn or left together.
"""
from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

NULL_VALUE = "<null>"
SWEEPS = 12  # at least
MAX_SWEEPS = 200
SWEEPS_PER_CUT = 4
TOLERANCE = 1e-6  # of all tokens
STALLED = 0.99  # a gap that falls by less than this in SWEEPS_PER_CUT sweeps stays


class TargetsMissed(UserWarning):
    """The cells can't meet the targets."""


TOKENS = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """White-space separated words of the whole text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKENS)), F.lit(0)).cast("bigint")


def tempered(cells: DataFrame, dim: str, power: float) -> DataFrame:
    """Target shares in proportion to each value's tokens to ``power``."""
    sums = cells.groupBy(dim).agg(F.pow(F.sum("tokens").cast("double"), F.lit(power)).alias("want"))
    return sums.select(F.col(dim), F.col("want"))


def _targets(cells: DataFrame, dim: str, spec: float | Mapping[str, float]) -> DataFrame:
    """(dim, target): shares over the values that occur, summing to 1; those
    without a listed share keep the one they have."""
    if isinstance(spec, Mapping):
        pairs = F.create_map(*[F.lit(x) for k, v in spec.items() for x in (k, float(v))])
        sums = cells.groupBy(dim).agg(F.sum("tokens").cast("double").alias("held")).withColumn("share", pairs[F.col(dim)])
        held, others, listed = sums.agg(F.sum("held"), F.sum(F.when(F.col("share").isNull(), F.col("held"))), F.sum("share")).first()
        others = (others or 0.0) / (held or 1.0)
        want = sums.select(dim, F.coalesce(F.col("share") * F.lit((1 - others) / (listed or 1.0)),
                                           F.col("held") / F.lit(held or 1.0)).alias("want"))
    else:
        want = tempered(cells, dim, float(spec))
    total = want.agg(F.sum("want")).first()[0]
    return want.select(dim, (F.col("want") / F.lit(total or 1.0)).alias("target"))


def rake(cells: DataFrame, targets: Mapping[str, float | Mapping[str, float]], *, sweeps: int = SWEEPS) -> DataFrame:
    """Rake ``cells`` (one row per combination of the dimensions, ``tokens``)
    and return it with ``weight``: the raked share of all tokens of the cell.

    ``targets`` names the dimensions in the order of scaling; each has shares by
    value, or one number p for shares in proportion to tokens to the power p.
    After ``sweeps`` sweeps it goes on until the targets hold.
    """
    shares = {dim: cut(_targets(cells, dim, spec), f"mix-target-{dim}") for dim, spec in targets.items()}
    now, sweep, last = cells.withColumn("weight", F.col("tokens").cast("double")), 0, float("inf")
    while True:
        sweep += 1
        for dim, share in shares.items():
            total = F.sum("weight").over(Window.partitionBy(dim))
            factor = F.when(total > 0, F.col("target") / total).otherwise(0.0)
            now = now.join(share, dim).withColumn("weight", F.col("weight") * factor).drop("target")
        if sweep % SWEEPS_PER_CUT == 0 or sweep == sweeps:
            now = cut(now, "mix-rake")
        if sweep >= sweeps and (sweep - sweeps) % SWEEPS_PER_CUT == 0:
            gap, dim = max(((_gap(now, dim, share), dim) for dim, share in shares.items()), default=(0.0, ""))
            if gap <= TOLERANCE:
                return now
            if gap > STALLED * last or sweep >= MAX_SWEEPS:
                warnings.warn(f"targets of {dim!r} are missed by up to {gap:.3g} of all tokens after {sweep} sweeps", TargetsMissed, stacklevel=2)
                return now
            last = gap


def _gap(cells: DataFrame, dim: str, share: DataFrame) -> float:
    """The largest difference between a value's weight and its target."""
    sums = cells.groupBy(dim).agg(F.sum("weight").alias("weight")).join(share, dim)
    return sums.agg(F.max(F.abs(F.col("weight") - F.col("target")))).first()[0] or 0.0


def _decided(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Mapping, id_col: str, seed: int,
             sweeps: int) -> DataFrame:
    """(row, id, tokens, the dimensions, weight, probability, drawn): the whole
    row stays in one column, so that no name can clash."""
    named = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), tokens.alias("tokens"),
                        *[F.coalesce(c.cast("string"), F.lit(NULL_VALUE)).alias(d) for d, c in dims.items()])
    cells = cut(named.groupBy(*dims).agg(F.sum("tokens").alias("tokens")), "mix-cells")
    raked = cut(rake(cells, targets, sweeps=sweeps), "mix-raked")
    ratio = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(0.0)
    top = raked.agg(F.max(ratio)).first()[0]
    chance = raked.select(*dims, "weight", (ratio / F.lit(top or 1.0)).alias("probability"))
    return named.join(chance, list(dims)).withColumn("drawn", unit_hash(F.col("id"), seed) < F.col("probability"))


def mix(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Mapping[str, float | Mapping[str, float]], *,
        id_col: str = "doc_id", seed: int = 7, sweeps: int = SWEEPS) -> DataFrame:
    """The decision for every row: ``id_col``, ``tokens``, the dimensions (each
    an expression over ``docs``), ``weight`` (raked token share of the row's
    cell), ``probability`` and ``drawn``."""
    out = _decided(docs, dims, tokens, targets, id_col, seed, sweeps)
    return out.select(F.col("id").alias(id_col), "tokens", *dims, "weight", "probability", "drawn")


def draw(docs: DataFrame, dims: Mapping[str, Column], tokens: Column, targets: Mapping[str, float | Mapping[str, float]], *,
         id_col: str = "doc_id", seed: int = 7, sweeps: int = SWEEPS) -> DataFrame:
    """The drawn rows of ``docs``, with all their columns."""
    return _decided(docs, dims, tokens, targets, id_col, seed, sweeps).where("drawn").select("row.*")


def unit_hash(key: Column, seed: int) -> Column:
    """A number in [0, 1) from the md5 of key and seed (32 bits)."""
    text = F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def topic(text: Column, rules: Sequence[tuple[str, str]], other: str = "other") -> Column:
    """The first rule (name, regular expression) that the text meets."""
    out = F.lit(other)
    for name, pattern in reversed(rules):
        out = F.when(F.coalesce(text, F.lit("")).rlike(pattern), F.lit(name)).otherwise(out)
    return out
