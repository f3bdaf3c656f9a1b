"""Hard negatives by threshold joins over an inverted index, after L2AP.

An anchor's positives are its best rows of the same label; for each positive, its
negatives are the best rows of other labels whose score lies in a window that the
positive's score sets.  Scores are inner products of whole-number vectors, so they are
exact.

**Index.**  Rows are dealt to blocks by a hash; a task holds one block of rows and one
block of anchors (``ROW_BLOCK`` x ``ANCHOR_BLOCK``), so no task grows with the table.
Dimensions are ordered by their weight in the block and taken in groups of ``GROUP``.
The posting list of a group holds the block's rows by falling suffix norm (the norm of
what a row has from that group on).  Under a threshold t an anchor reads of each list
only the rows whose suffix norm times the anchor's own reaches t: the rest of the list,
the dimensions that the bound covers, is left out of its index.

**Threshold join.**  Group by group an anchor's partial scores are accumulated, and a
row is left alone as soon as partial score plus remaining norms is below t.  What
has been accumulated is kept: when t falls, the lists are read further and the rows go
on where they stopped.  Rows that reach the last group have their exact score.

**Lowering.**  t starts high and is lowered until the anchor's windows are full: for
positives when as many rows as asked for have scores of t or more, for negatives when
each window holds as many rows at or above t, or when t is below the window.  Every row
that could be among the best of its block has then been scored, so merging the blocks'
bests gives the bests of the table; the windows need the positives of all blocks, so
positives and negatives are two passes.

Norm bounds are computed in floating point and widened by ``SLACK``; they only decide
what is skipped.  Scores are summed in float64 where every partial sum is a whole number
below 2^53, in int64 otherwise.

Defined results: rows with a null id, label or vector, with a null component, or with a
component of 2^24 or more in magnitude (whose scores may not fit 64 bits) take no part; rows that
repeat id, label and vector count once; rows of one id but other content are rows of
their own, and never each other's positives or negatives.  Vectors of different lengths
have no score; empty vectors have the score 0 with each other.  An anchor without
positives gives no rows, a positive without negatives gives none; ties go to the smaller
id.  An empty table gives an empty one; other columns are not read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

ROW_BLOCK, ANCHOR_BLOCK = 4096, 1024
GROUP = 8  # dimensions that are accumulated between two tests
CHUNK = 64  # anchors that go through a block together
LIMIT = 1 << 24
SLACK = 1e-9
LOWER = 0.75  # what is left of a threshold when it is lowered


class Block:
    """The index of a block of rows of one vector length."""

    def __init__(self, vectors: np.ndarray):
        self.order = np.argsort(-np.square(vectors.astype(np.float64)).sum(0), kind="stable")
        vectors = vectors[:, self.order]
        self.dims = vectors.shape[1]
        self.edges = [*range(0, self.dims, GROUP), self.dims] if self.dims else [0]
        self.largest = int(np.abs(vectors).max(initial=0))
        self.vectors = vectors
        self.norms = self.suffix_norms(vectors)
        self.lists = [np.argsort(-n, kind="stable") for n in self.norms[:-1]]  # postings of each group
        self.listed = [n[p] for n, p in zip(self.norms, self.lists)]

    def suffix_norms(self, vectors: np.ndarray) -> np.ndarray:
        """Row g: the norms of what vectors have from group g on."""
        squares = np.square(vectors.astype(np.float64))
        parts = [squares[:, a:b].sum(1) for a, b in zip(self.edges[:-1], self.edges[1:])]
        total = np.zeros((len(parts) + 1, len(vectors)))
        for g in range(len(parts) - 1, -1, -1):
            total[g] = total[g + 1] + parts[g]
        return np.sqrt(total) * (1 + SLACK)


class Search:
    """Scores of some anchors with a block's rows, as far as thresholds need them."""

    def __init__(self, block: Block, anchors: np.ndarray):
        anchors = anchors[:, block.order]
        wide = int(np.abs(anchors).max(initial=0)) * block.largest * max(1, block.dims) >= 1 << 53
        kind = np.int64 if wide else np.float64
        self.block, self.anchors, self.rows = block, anchors.astype(kind), block.vectors.astype(kind)
        self.norms = block.suffix_norms(anchors)
        self.scores = np.zeros((len(anchors), len(block.vectors)), kind)
        self.done = np.zeros(self.scores.shape, np.int16)  # groups accumulated
        #: no score of an anchor exceeds this
        self.top = self.norms[0] * block.norms[0].max(initial=0)

    def _add(self, g: int, who: np.ndarray, rows: np.ndarray) -> None:
        a, b = self.block.edges[g:g + 2]
        for lo in range(0, len(who), 1 << 17):
            w, r = who[lo:lo + (1 << 17)], rows[lo:lo + (1 << 17)]
            self.scores[w, r] += np.einsum("ij,ij->i", self.anchors[w, a:b], self.rows[r, a:b])
            self.done[w, r] = g + 1

    def join(self, who: np.ndarray, t: np.ndarray) -> np.ndarray:
        """For the anchors ``who``, one threshold each: which rows score t or more."""
        low = t - SLACK * self.top[who]
        groups = len(self.block.lists)
        for g in range(groups):  # the index: lists as far as the bound lets them matter
            norm = self.norms[g][who]
            with np.errstate(divide="ignore", invalid="ignore"):
                least = np.where(low > 0, np.where(norm > 0, low / norm, np.inf), 0).min(initial=np.inf)
            rows = self.block.lists[g][:np.searchsorted(-self.block.listed[g], -least, "right")]
            rest = norm[:, None] * self.block.listed[g][:len(rows)]
            ask = (rest >= low[:, None]) & (self.done[who[:, None], rows] == g)
            ask &= self.scores[who[:, None], rows] + rest >= low[:, None]
            c, r = np.nonzero(ask)
            self._add(g, who[c], rows[r])
        # rows whose partial score leaves them a chance: what the index left out
        now = self.done[who]
        rest = np.take_along_axis(self.norms[:, who].T, now, 1) * np.take_along_axis(self.block.norms, now, 0)
        c, r = np.nonzero((now > 0) & (now < groups) & (self.scores[who] + rest >= low[:, None]))
        for g in range(1, groups):
            go = self.done[who[c], r] == g
            go[go] = self.scores[who[c[go]], r[go]] + self.norms[g][who[c[go]]] * self.block.norms[g][r[go]] >= low[c[go]]
            self._add(g, who[c[go]], r[go])
        return (self.done[who] == groups) & (self.scores[who] >= t[:, None])


def _best(scores: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:n]


def _positives(rows: dict, anchors: dict, k: int) -> Iterator[tuple]:
    """The block's best ``k`` other rows of each anchor's label: (anchor, row, score)."""
    for label in np.unique(anchors["label"]):
        of_label, mine = np.flatnonzero(rows["label"] == label), np.flatnonzero(anchors["label"] == label)
        if not len(of_label):
            continue
        block, ids = Block(rows["vectors"][of_label]), rows["id"][of_label]
        for lo in range(0, len(mine), CHUNK):
            chunk = mine[lo:lo + CHUNK]
            search = Search(block, anchors["vectors"][chunk])
            other = ids[None, :] != anchors["id"][chunk][:, None]
            who, t = np.arange(len(chunk)), search.top * LOWER
            while len(who):
                found = search.join(who, t) & other[who]
                full = (found.sum(1) >= k) | np.isneginf(t)
                for c in np.flatnonzero(full):
                    at = np.flatnonzero(found[c])
                    scores = search.scores[who[c], at].astype(np.int64)
                    for x in _best(scores, ids[at], k):
                        yield chunk[who[c]], ids[at[x]], scores[x]
                who, t = who[~full], t[~full]
                t = np.where(t > 0.1 * search.top[who], t * LOWER, -np.inf)


def _negatives(rows: dict, anchors: dict, k: int, window: tuple[int, int]) -> Iterator[tuple]:
    """The block's best ``k`` rows of other labels in each window:
    (anchor, which positive, row, score)."""
    block = Block(rows["vectors"])
    low_share, high_share = window
    for lo in range(0, len(anchors["id"]), CHUNK):
        chunk = np.arange(lo, min(lo + CHUNK, len(anchors["id"])))
        search = Search(block, anchors["vectors"][chunk])
        other = (rows["label"][None, :] != anchors["label"][chunk][:, None]) & (rows["id"][None, :] != anchors["id"][chunk][:, None])
        open_windows = [{i: p for i, p in enumerate(anchors["positives"][a]) if low_share * p <= high_share * p} for a in chunk]
        who = np.array([c for c in range(len(chunk)) if open_windows[c]], np.int64)
        t = np.array([min(search.top[c], max(open_windows[c].values()) * high_share / 100) for c in who])
        while len(who):
            found, below = search.join(who, t) & other[who], np.full(len(who), -np.inf)
            for c in range(len(who)):
                at = np.flatnonzero(found[c])
                scores, mine = search.scores[who[c], at].astype(np.int64), open_windows[who[c]]
                for i, p in list(mine.items()):
                    inside = np.flatnonzero((100 * scores >= low_share * p) & (100 * scores <= high_share * p))
                    if len(inside) >= k or 100 * t[c] <= low_share * p:
                        for x in inside[_best(scores[inside], rows["id"][at[inside]], k)]:
                            yield chunk[who[c]], i, rows["id"][at[x]], scores[x]
                        del mine[i]
                if mine:  # down to the lowest window that is not full
                    below[c] = max(t[c] * LOWER, min(mine.values()) * low_share / 100 - 0.5)
                    if t[c] <= 0.02 * search.top[who[c]]:
                        below[c] = min(mine.values()) * low_share / 100 - 0.5
            more = np.array([bool(open_windows[c]) for c in who])
            who, t = who[more], below[more]


def _numpy(table: pa.Table, labels: dict) -> Iterator[tuple[int, dict]]:
    """Columns of a block by vector length."""
    vectors = table.column("v").combine_chunks()
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy()
    starts = np.cumsum(lengths) - lengths
    ids = table.column("id").to_numpy()
    label = np.array([labels.setdefault(x, len(labels)) for x in table.column("label").to_pylist()], np.int64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        yield int(n), {"at": at, "id": ids[at], "label": label[at],
                       "vectors": flat[starts[at][:, None] + np.arange(n)[None, :]].astype(np.int64).reshape(len(at), n)}


def _cells(rows: DataFrame, anchors: DataFrame, row_blocks: int, anchor_blocks: int, fn, schema: str) -> DataFrame:
    """``fn`` on every pair of a block of rows and a block of anchors."""
    by = ["row_block", "anchor_block"]
    rows = rows.withColumn("anchor_block", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    anchors = anchors.withColumn("row_block", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    anchors = anchors.toDF(*anchors.columns)  # columns of its own: both sides come from one table
    return rows.groupBy(*by).cogroup(anchors.groupBy(*by)).applyInArrow(fn, schema)


def mine(vectors: DataFrame, is_anchor, *, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label",
         positives: int = 5, negatives: int = 10, window: tuple[int, int] = (30, 90)) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``,
    ``positive_score`` and ``negative_score`` for the rows that ``is_anchor`` (a condition) holds for.

    ``vector_col`` holds whole numbers.  ``window`` is in percent of the positive's
    score, both ends included."""
    v = F.col(f"`{vector_col}`")
    usable = (F.col(f"`{id_col}`").isNotNull() & F.col(f"`{label_col}`").isNotNull() & v.isNotNull()
              & F.coalesce(F.forall(v, lambda x: F.coalesce((x > -LIMIT) & (x < LIMIT), F.lit(False))), F.lit(False)))
    base = (vectors.where(usable)
            .select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{label_col}`").alias("label"),
                    v.cast("array<int>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
            .dropDuplicates(["id", "label", "v"]).withColumn("row_key", F.xxhash64("id", "label", "v")))
    base = cut(base, "negatives-base")
    n, n_anchors = base.agg(F.count(F.lit(1)), F.count_if("anchor")).first()
    row_blocks, anchor_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-n_anchors // ANCHOR_BLOCK))
    rows = base.select("id", "label", "v", F.pmod("row_key", F.lit(row_blocks)).cast("int").alias("row_block"))
    anchors = base.where("anchor").select(
        "row_key", "id", "label", "v", F.pmod(F.xxhash64("row_key"), F.lit(anchor_blocks)).cast("int").alias("anchor_block"))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        labels: dict = {}
        keys, ids, scores = [], [], []
        of_length = dict(_numpy(left, labels))
        anchor_keys = right.column("row_key").to_numpy()
        for n, a in _numpy(right, labels):
            if n in of_length:
                for who, row, score in _positives(of_length[n], a, positives):
                    keys.append(anchor_keys[a["at"][who]])
                    ids.append(row)
                    scores.append(score)
        return pa.table([pa.array(keys, pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())],
                        ["row_key", "positive_id", "positive_score"])

    found = _cells(rows, anchors, row_blocks, anchor_blocks, near, "row_key bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("row_key").orderBy(F.desc("positive_score"), "positive_id")
    found = cut(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "negatives-positives")
    listed = found.groupBy("row_key").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_score"))).alias("found"))
    with_windows = anchors.join(listed, "row_key").withColumn("positives", F.col("found.positive_score")).drop("found")

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        labels: dict = {}
        out: list[list] = [[], [], [], []]
        of_length = dict(_numpy(left, labels))
        anchor_keys, windows = right.column("row_key").to_numpy(), right.column("positives").to_pylist()
        for n, a in _numpy(right, labels):
            if n in of_length:
                a["positives"] = [windows[i] for i in a["at"]]
                for who, nth, row, score in _negatives(of_length[n], a, negatives, window):
                    for column, x in zip(out, (anchor_keys[a["at"][who]], nth + 1, row, score)):
                        column.append(x)
        return pa.table([pa.array(x, pa.int64()) for x in out], ["row_key", "nth", "negative_id", "negative_score"])

    hard = _cells(rows, with_windows, row_blocks, anchor_blocks, far, "row_key bigint, nth bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("row_key", "nth").orderBy(F.desc("negative_score"), "negative_id")
    hard = hard.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    ids = anchors.select("row_key", F.col("id").alias("anchor_id"))
    return (hard.join(found, ["row_key", "nth"]).join(ids, "row_key")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
