"""Periodic runs of words, by a dictionary of basic factors.

A run is a stretch of words with smallest period q (words q apart are identical)
that no neighbouring word extends keeping that period.  Runs of at least
``min_length`` words and ``min_powers`` (3 or more) periods are found.

Level k of the dictionary names every factor of 2^k words: two positions have one
name if the words there are the same.  A name of level k + 1 is the pair of the
names of its halves.  In a window of twice a factor's length the occurrences of the
factor form one arithmetic progression, whose difference is the factor's period; so
at each level the successor of a position (the next one of its name) proposes the
distance to it as a period, if that is at most 2^k.  Inside a run of period q every
factor of q words or more has its successor exactly q on, so at the level with
2^(k-1) < q <= 2^k the positions whose successor is q on are one gapless stretch from
the run's first word (three periods hold a factor of under 2q words and its successor).
That stretch, extended by the last member of its progression
and the factor's length, is the run; a word before or after it would lengthen it.
Levels above propose the same runs again, which are dropped.

A name that stands once in its document can't be part of a longer one that stands
twice, so each level keeps only the positions whose name recurs.  Prose ends after a
few levels.

Documents are independent and are taken in batches inside each task; what a task
holds grows with its longest text.  Nothing is shuffled.

Defined results: words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, compared as
bytes, case and all.  A null or empty text has no words, no runs and collapses to the empty
text; rows that repeat keep one row each; an empty table gives an empty one; other
columns pass through unread, but an output takes the place of one of its name.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TablePrepError

BATCH_WORDS = 1 << 18
OUTPUTS = {"n_words": "bigint", "runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"}


def _rank(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of ``values`` in order (equal ones by position), and where a new value begins."""
    order = np.argsort(values, kind="stable")
    seen = values[order]
    first = np.ones(len(seen), bool)
    first[1:] = seen[1:] != seen[:-1]
    return order, first


def find_runs(names: np.ndarray, doc: np.ndarray, min_length: int, min_powers: int) -> np.ndarray:
    """Rows (start, length, period) of the runs in a batch of words: ``names`` are
    word numbers, ``doc`` the document of each word, ascending.  Starts count from
    the first word of the batch; the rows are sorted."""
    n = len(names)
    found, at, width = [], np.arange(n), 1
    size = np.bincount(doc) if n else np.zeros(0, np.int64)
    name = np.full(n, -1, np.int64)  # -1: stands once in its document, or reaches beyond its end
    value = names.astype(np.int64) * (int(doc[-1]) + 1) + doc if n else name
    while len(at):
        order, first = _rank(value)
        number = np.cumsum(first) - 1
        recurs = np.bincount(number)[number] > 1
        order, first, number = order[recurs], first[recurs], number[recurs]
        name[:] = -1
        here = at[order]
        name[here] = number
        # the successor of each position: the next one of its name
        gap = np.zeros(len(here), np.int64)
        gap[:-1] = np.where(first[1:], 0, here[1:] - here[:-1])
        near = (gap > 0) & (gap <= width)
        by_place = np.argsort(here[near])
        i, d = here[near][by_place], gap[near][by_place]
        if len(i):  # gapless stretches of one distance
            new = np.ones(len(i), bool)
            new[1:] = (i[1:] != i[:-1] + 1) | (d[1:] != d[:-1]) | (doc[i[1:]] != doc[i[:-1]])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(i)) - 1
            start, period = i[begin], d[begin]
            length = i[last] + period + width - start
            good = (length >= min_length) & (length >= min_powers * period)
            found.append(np.stack([start[good], length[good], period[good]], 1))
        # factors of twice the width, where both halves recur and the document goes on
        half = np.sort(here)
        half = half[half + width < n]
        half = half[(name[half + width] >= 0) & (doc[half + width] == doc[half])]
        if width * min_powers >= size.max():  # no run has a longer period than this level shows
            break
        value = name[half] * n + name[half + width]
        at, width = half, 2 * width
    runs = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return np.unique(runs, axis=0) if len(runs) else runs


def dropped(runs: np.ndarray, n: int) -> np.ndarray:
    """Words that some run holds after its first period."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edges, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edges[:-1]) > 0


def _groups(texts: list[bytes]) -> Iterator[list[list[bytes]]]:
    """Documents as words, in batches of about BATCH_WORDS."""
    group, held = [], 0
    for text in texts:
        words = text.split()  # bytes: the six ASCII spaces and nothing else
        group.append(words)
        held += len(words)
        if held >= BATCH_WORDS:
            yield group
            group, held = [], 0
    if group:
        yield group


def _decide(group: list[list[bytes]], min_length: int, min_powers: int) -> list[pa.Array]:
    """The output columns of a batch of documents."""
    sizes = np.fromiter(map(len, group), np.int64, len(group))
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = [w for words in group for w in words]
    doc = np.repeat(np.arange(len(group)), sizes)
    codes = pa.array(flat, pa.binary()).dictionary_encode().indices.to_numpy() if flat else np.zeros(0, np.int64)
    runs = find_runs(codes, doc, min_length, min_powers)
    kept = ~dropped(runs, len(flat))
    owner = doc[runs[:, 0]] if len(runs) else np.zeros(0, np.int64)
    ends = np.searchsorted(owner, np.arange(len(group) + 1)).astype(np.int32)
    struct = pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - first[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], ["start", "length", "period"])
    touched = set(owner.tolist())
    texts = []
    for i, words in enumerate(group):
        if i in touched:
            words = [words[j] for j in np.flatnonzero(kept[first[i]:first[i + 1]])]
        texts.append(b" ".join(words))
    return [pa.array(sizes), pa.ListArray.from_arrays(ends, struct), pa.array(texts, pa.binary()).cast(pa.string())]


def runs(docs: DataFrame, *, text_col: str = "text", min_length: int = 6, min_powers: int = 4) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` (start, length and period of each, by start and
    then period) and ``collapsed``: the words outside of runs and the first period of
    each run, joined by one space."""
    if min_powers < 3 or min_length < 2:
        raise TablePrepError(f"runs need 2 words and 3 periods at least, not {min_length} and {min_powers}")
    docs = docs.drop(*OUTPUTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, lo = batch.column(batch.schema.get_field_index(text_col)).cast(pa.binary()), 0
            for group in _groups((x.as_py() or b"") for x in texts):
                part = batch.slice(lo, len(group))
                lo += len(group)
                yield pa.RecordBatch.from_arrays([*part.columns, *_decide(group, min_length, min_powers)], [*part.schema.names, *OUTPUTS])

    schema = docs.select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in OUTPUTS.items()]).schema
    return docs.mapInArrow(run, schema)


def digests() -> list[Column]:
    """Columns that sum up what ``runs`` gives: their number, the run of the greatest
    exact length / period (ties: the smallest start, then period), and digests."""
    # a run is better than an earlier one if its length / period is greater: cross products are exact
    best = F.reduce("runs", F.get("runs", F.lit(0)),
                    lambda a, b: F.when(b["length"] * a["period"] > a["length"] * b["period"], b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    milli = F.call_function("div", F.lit(1000).cast("bigint") * best["length"], best["period"])
    return [F.size("runs").cast("bigint").alias("n_runs"), *[best[c].alias(c) for c in ("start", "length", "period")],
            milli.alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256")]
