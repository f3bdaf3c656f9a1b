"""Embedding near-duplicates: exact cosine pairs by dual traversal of cover trees.

Unit vectors at a cosine of t or more are at most sqrt(2 - 2 t) apart, so the
pairs are those within a distance.  A cover tree has nested levels: the points of
a node are covered by its children's centres at half the radius.  Two nodes are
compared by their centres and their covering radii (the largest distance from a
centre to a point below it).  When the gap less the radii exceeds the distance asked
for, no pair below them is looked at; when the gap plus the radii stays within it,
all pairs below them are linked and only counted.  A node whose points no few
centres cover at half the radius is a leaf, whatever its size, less the groups of
near copies in it.  Large leaves are parted by their points' nearest of ``PIVOTS``
pivots; points of two parts meet only if each is within reach of the planes around the
other part.
Points are compared by short sketches first (the coordinates along ``AXES`` axes and
the norm of what remains, whose distance is never larger than the vectors'); what the
sketches let pass is decided by the cosine itself, in double precision.

Spread over tasks: vectors of one group (equal label and dimension) are first laid
into the cells of a tree's upper levels, built on a bounded sample (``SAMPLE``
vectors in all): balls that hold many near copies, and cover-tree cells.  Cells only
partition the work: the radii are measured over all vectors, so the sample decides
the cost and never the result.  A cell over ``BLOCK`` vectors is cut into blocks, and
blocks are pruned or counted whole by the same bounds.  Vectors travel packed, some
hundreds to a row.  A task compares two blocks, or one with itself, and gets of each
only the vectors that may be within reach of the other's ball and of the planes midway
to its cell.  Vectors that are all far apart are beyond such bounds in part only: a
vector then goes to a share of the blocks of its label, which is quadratic in a label.
Pairs of blocks are taken in rounds that move ``COPIES`` times the table at most, so
disk stays in proportion to the input.  A task gives each of its linked vectors a link
count and one hub to hang on, not pairs.

Equal vectors are one class throughout; copies only add to the counts.

Defined results: a vector that is null, empty, zero or holds a null or a
non-finite component, or whose label is null, links with nothing; so do vectors
of another dimension; a null id gets a null component and ``kept`` false; rows
that repeat an id and a vector count as two vectors of that id; an empty table
gives an empty table.  Only the three named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import cut, drop_scratch, release, scratch
from .components import components

THRESHOLD = 0.98
SAMPLE = 4096
SAMPLE_BYTES = 16 << 20
CELLS = 64  # of a group
BLOCK = 65536  # vectors, at most BLOCK_BYTES of them
BLOCK_BYTES = 16 << 20
CHUNK, CHUNK_BYTES = 1024, 512 << 10  # vectors that travel in one row
ROW_GROUP = 16 << 20  # bytes of packed rows that a Parquet reader takes at a time
COPIES = 2  # of the table that a round moves
ROUND = 1 << 18  # vectors that a round may move in any case
LEAF = 1024
KIDS = 16  # children of a node
LOOK = 512  # points of a node by which its sketch axes and balls are chosen
BALL = 8  # of those, near copies that make a ball
AXES = 15
TILE = (512, 2048)
PIVOTS = 64  # that part leaves with LARGE pairs or more
LARGE = 1 << 27
SLACK = 1e-6  # for rounding in distances; the cosine decides
SKETCH_SLACK = PIVOT_SLACK = 1e-4  # for rounding in single precision

PLACED = "g string, a int, n int, least bigint, weight bigint, far double, ids binary, copies binary, vectors binary"
SENT = "g string, a int, i int, b int, j int, side int, n int, ids binary, copies binary, vectors binary"
FOUND = "node bigint, links bigint, hub bigint"


def unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # no overflow in the squares
    rows /= np.sqrt(np.einsum("ij,ij->i", rows, rows))[:, None]
    return rows


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def outer(threshold: float) -> float:
    """No vectors further apart are linked."""
    return float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0))) + SLACK


def inner(threshold: float) -> float:
    """All vectors at most so far apart are linked."""
    return float(np.sqrt(max(2.0 - 2.0 * threshold, 0.0))) - SLACK


def cover(points: np.ndarray, first: int, radius: float, most: int | None = None) -> tuple[list[int], np.ndarray] | None:
    """Centres that cover ``points`` at ``radius``, ``first`` among them, and
    the centre (by position) of each point: the first that reaches it.  None if
    that takes more than ``most`` centres."""
    owner = np.full(len(points), -1)
    centres, at = [], first
    while True:
        if len(centres) == most:
            return None
        near = (owner < 0) & (distances(points, points[at:at + 1])[:, 0] <= radius)
        near[at] = True
        owner[near] = len(centres)
        centres.append(at)
        rest = np.flatnonzero(owner < 0)
        if not len(rest):
            return centres, owner
        at = int(rest[0])


def balls(points: np.ndarray, least: int, radius: float, most: int) -> np.ndarray:
    """Centres of up to ``most`` balls of ``radius`` that hold ``least`` of the points or more, fullest first."""
    out: list[np.ndarray] = []
    near = np.concatenate([distances(points[lo:lo + LOOK], points) <= 2 * radius for lo in range(0, len(points), LOOK)])
    alive = near.sum(axis=1) >= least
    while len(out) < most and alive.any():
        count = np.where(alive, near[:, alive].sum(axis=1), 0)
        k = int(count.argmax())
        if count[k] < least:
            break
        centre = points[alive & near[k]].mean(axis=0)
        norm = np.sqrt(centre @ centre)
        inside = alive & (distances(points, centre[None] / norm)[:, 0] <= radius) if norm > 0.5 else np.zeros(len(points), bool)
        if inside.sum() >= least:
            out.append(centre / norm)
            alive &= ~inside
        alive[k] = False
    return np.array(out).reshape(len(out), points.shape[1])


class Node:
    """A node: its ball, the points in it, and its children."""

    __slots__ = ("centre", "rows", "radius", "kids")

    def __init__(self, points: np.ndarray, rows: np.ndarray, first: int, level: float, whole: float, flat: bool = False):
        own = points if len(rows) == len(points) else points[rows]
        self.rows, self.kids = rows, None
        self.centre, self.radius = own[first], float(distances(own, own[first:first + 1]).max())
        mean = own.mean(axis=0)
        if (norm := np.sqrt(mean @ mean)) > SLACK:
            radius = float(distances(own, mean[None] / norm).max())
            if radius < self.radius:
                self.centre, self.radius = mean / norm, radius
        if flat or len(rows) <= LEAF or 2 * self.radius <= whole:
            return
        half = min(level, self.radius) / 2
        some = own[::-(-len(rows) // LOOK)]
        found = cover(some, 0, half, KIDS) and cover(own, first, half, KIDS)
        if found:
            centres, owner = found
            firsts = [int(np.count_nonzero(owner[:c] == k)) for k, c in enumerate(centres)]
        else:
            dense = balls(some, BALL, whole / 2, KIDS) if whole > 0 else ()
            if not len(dense):
                return
            gap = distances(own, dense)
            owner = np.where(gap.min(axis=1) <= whole / 2, gap.argmin(axis=1), len(dense))
            firsts = [0] * (len(dense) + 1)
        order = np.argsort(owner, kind="stable")
        ends = np.searchsorted(owner[order], np.arange(len(firsts) + 1))
        self.kids = [Node(points, rows[order[lo:hi]], f, half, whole, flat=not found)
                     for f, lo, hi in zip(firsts, ends[:-1], ends[1:]) if lo < hi]

    def parts(self) -> list[Node]:
        return self.kids or [self]


def sketches(x: np.ndarray, y: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Short unit vectors of x and of y (None: x) that are no further apart than the vectors."""
    some = np.concatenate([r[::-(-len(r) // LOOK)] for r in (x, y) if r is not None])
    mid = some.mean(axis=0)
    near = np.linalg.svd(some - mid, full_matrices=False)[2][:AXES - 1]
    axes = np.linalg.qr(np.concatenate([mid[None], near]).T)[0]

    def sketch(r):
        along = r @ axes
        rest = np.sqrt(np.maximum(1.0 - np.einsum("ij,ij->i", along, along), 0.0))
        return np.column_stack([along, rest]).astype(np.float32)

    of_x = sketch(x)
    return of_x, of_x if y is None else sketch(y)


def within(dots: np.ndarray, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of products of pivots (rows) with points: each point's own pivot, the nearest, and which pivots' parts
    may hold something within reach of it: it is at most so far behind the planes midway to its own."""
    own = dots.argmax(axis=0)
    return own, dots + margins[:, own] >= np.take_along_axis(dots, own[None], 0)


def margins(pivots: np.ndarray, reach: float) -> np.ndarray:
    return (reach * distances(pivots, pivots) + PIVOT_SLACK).astype(np.float32)


def _parts(x: np.ndarray, z: np.ndarray, p: np.ndarray, q: np.ndarray, sx: np.ndarray, sz: np.ndarray, reach: float,
           same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Parts of the rows p of x and q of z, by their nearest of some pivots, that may hold linked pairs, with
    their sketches: of two parts, only the rows that may be within reach of the other."""
    some = [r[rows[::-(-len(rows) // (PIVOTS // (1 if same else 2)))]] for r, rows in ((x, p), (z, q))[same:]]
    pivots = np.concatenate(some).astype(np.float32)
    gaps, step = margins(pivots, reach), TILE[1]

    def parted(r, rows, short):
        own, may = np.empty(len(rows), np.int64), np.empty((len(pivots), len(rows)), bool)
        for lo in range(0, len(rows), step):
            own[lo:lo + step], may[:, lo:lo + step] = within(pivots @ r[rows[lo:lo + step]].astype(np.float32).T, gaps)
        order = np.argsort(own, kind="stable")
        rows, may, ends = rows[order], may[:, order], np.searchsorted(own[order], np.arange(len(pivots) + 1))
        short = short[rows]
        return [(rows[lo:hi], short[lo:hi], may[:, lo:hi]) for lo, hi in zip(ends[:-1], ends[1:])]

    left = parted(x, p, sx)
    right = left if same else parted(z, q, sz)
    for k, (i, si, to) in enumerate(left):
        for n, (j, sj, back) in enumerate(right):
            if same and k == n:
                yield i, i, si, si, True
            elif not same or k < n:
                yield i[to[n]], j[back[k]], si[to[n]], sj[back[k]], False


def _tiles(x: np.ndarray, z: np.ndarray, p: np.ndarray, q: np.ndarray, sp: np.ndarray, sq: np.ndarray,
           threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of the rows p of x and q of z, whose sketches are sp and sq, tile by tile; of one
    set those with i < j."""
    low, (high, wide) = np.float32(threshold - SKETCH_SLACK), TILE
    for lo in range(0, len(p), high):
        for at in range(lo if same else 0, len(q), wide):
            hit = sp[lo:lo + high] @ sq[at:at + wide].T >= low
            some = np.flatnonzero(hit.any(axis=1))
            if not len(some):
                continue
            i, j = np.nonzero(hit[some])
            if len(i) > hit.size // 64:
                i, j = np.nonzero(x[p[lo:lo + high]] @ z[q[at:at + wide]].T >= threshold)
                i, j = p[lo + i], q[at + j]
            else:
                i, j = p[lo + some[i]], q[at + j]
                good = np.einsum("ij,ij->i", x[i], z[j]) >= threshold
                i, j = i[good], j[good]
            if same:
                i, j = i[i < j], j[i < j]
            yield i, j


def _leaves(x: np.ndarray, z: np.ndarray, p: np.ndarray, q: np.ndarray, sx: np.ndarray, sz: np.ndarray,
            threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs of two leaves, or of one with itself."""
    if len(p) * len(q) < LARGE:
        yield from _tiles(x, z, p, q, sx[p], sz[q], threshold, same)
    else:
        for i, j, si, sj, one in _parts(x, z, p, q, sx, sz, outer(threshold), same):
            yield from _tiles(x, z, i, j, si, sj, threshold, one)


def meets(x: np.ndarray, y: np.ndarray | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """All (i, j) with cosine >= threshold in parts: (i, j, False) are pairs, (i, j, True)
    stands for every i with every j; of one set (y None) each pair comes once."""
    z, reach, whole = x if y is None else y, outer(threshold), inner(threshold)
    a = Node(x, np.arange(len(x)), 0, 2.0, whole)
    b = a if y is None else Node(y, np.arange(len(y)), 0, 2.0, whole)
    sx, sz = sketches(x, y)
    todo = [(a, b, float(distances(a.centre[None], b.centre[None])[0, 0]))]
    while todo:
        p, q, gap = todo.pop()
        same = p is q
        if gap > p.radius + q.radius + reach and not same:
            continue
        if (0.0 if same else gap) + p.radius + q.radius <= whole:
            yield p.rows, q.rows, True
        elif p.kids is None and q.kids is None:
            for i, j in _leaves(x, z, p.rows, q.rows, sx, sz, threshold, same):
                yield i, j, False
        else:
            ps, qs = p.parts(), q.parts()
            gaps = distances(np.array([k.centre for k in ps]), np.array([k.centre for k in qs]))
            near = gaps <= np.array([k.radius for k in ps])[:, None] + np.array([k.radius for k in qs]) + reach
            if same:
                near = np.triu(near)  # a pair of different nodes once
                np.fill_diagonal(near, True)
            todo += [(ps[i], qs[j], float(gaps[i, j])) for i, j in np.argwhere(near)]


def linked(x: np.ndarray, y: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) with cosine >= threshold; of one set (y None) those with i < j."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j, every in meets(x, y, threshold):
        if every:
            same = y is None and i is j
            i, j = np.repeat(i, len(j)), np.tile(j, len(i))
            if same:
                i, j = i[i < j], j[i < j]
        left.append(i)
        right.append(j)
    i, j = np.concatenate(left), np.concatenate(right)
    return (np.minimum(i, j), np.maximum(i, j)) if y is None else (i, j)


def hubs(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest point that links reach, for n points."""
    low = np.arange(n)
    while True:
        was = low.copy()
        np.minimum.at(low, i, was[j])
        np.minimum.at(low, j, was[i])
        low = low[low]
        if (low == was).all():
            return low


def tally(x: np.ndarray, y: np.ndarray | None, copies: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For the points of x, then of y: the copies that each is linked with, and the smallest point that links reach."""
    links, ends = np.zeros(len(copies), np.int64), []
    for i, j, every in meets(x, y, threshold):
        same = y is None and i is j
        j = j if y is None else j + len(x)
        if every:
            links[i] += copies[j].sum()
            if same:
                links[i] -= copies[i]
            else:
                links[j] += copies[i].sum()
                ends.append((j, np.full(len(j), i[0])))
            ends.append((i, np.full(len(i), j[0])))
        elif len(i):
            np.add.at(links, i, copies[j])
            np.add.at(links, j, copies[i])
            at, k = np.unique(np.concatenate([i, j]), return_inverse=True)  # a tile's links as stars
            low = hubs(len(at), k[:len(i)], k[len(i):])
            ends.append((at, at[low]))
    if not ends:
        return links, np.arange(len(copies))
    return links, hubs(len(copies), *map(np.concatenate, zip(*ends)))


def _upper_cells(sample: pa.Table, share: float, threshold: float, width: int) -> dict[str, tuple[np.ndarray, int, np.ndarray]]:
    """For each group of a sample of ``share`` of the classes: centres of cells, how many of
    them (the first ones) are balls of near copies, and the others' ``margins``.  A group that
    one block holds is one cell.  Where few centres cover nothing, any points are the centres."""
    out, whole = {}, inner(threshold)
    of = np.array(sample.column("g").to_pylist(), object)
    vectors = sample.column("v").combine_chunks() if len(sample) else None
    for key in dict.fromkeys(of):
        part = vectors.take(pa.array(np.flatnonzero(of == key)))
        points = unit(part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(part), -1))
        block = block_rows(points.shape[1] * width)
        blocks = int(np.ceil(len(points) / share / block))
        dense = np.zeros((0, points.shape[1]))
        centres, radius = [0], 2.0
        if blocks > 1:
            if whole > 0:
                dense = balls(points, max(4, int(block / 4 * share)), whole / 2, min(CELLS, 4 * blocks))
            while radius > 0.05:
                finer = cover(points, 0, radius / 2, min(CELLS, 2 * blocks))
                if finer is None:
                    break
                centres, radius = finer[0], radius / 2
            most = min(CELLS, blocks)
            if len(centres) < most:  # no few centres cover the points
                rest = np.flatnonzero(~(distances(points, dense) <= whole / 2).any(axis=1))
                centres = rest[::-(-len(rest) // most)] if len(rest) else centres
        upper = points[centres]
        out[key] = np.concatenate([dense, upper]), len(dense), margins(upper, outer(threshold))
    return out


def block_rows(width: int) -> int:
    """Vectors of ``width`` packed bytes that a block holds."""
    return max(1, min(BLOCK, BLOCK_BYTES // max(1, width)))


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row a vector: ``id_col``, ``n_links``, ``component_id`` and ``kept``."""
    spark = vectors.sparkSession
    kind = vectors.select(F.col(vector_col)).schema[0].dataType
    single = isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType)
    code = np.dtype("<f4" if single else "<f8")
    v = F.col(vector_col).cast("array<float>" if single else "array<double>")
    whole = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"),
                          F.concat_ws(":", F.col(label_col).cast("string"), F.size(v).cast("string")).alias("g"),
                          (F.col(label_col).isNotNull() & F.col(vector_col).isNotNull()).alias("labelled"))
    good = F.col("labelled") & F.col("id").isNotNull() & whole & F.exists("v", lambda x: x != 0)
    rows = rows.withColumns({"ok": F.coalesce(good, F.lit(False)), "h1": F.xxhash64("g", "v"),
                             "h2": F.xxhash64("v", F.lit("second"), "g")})
    grouped = (rows.where("ok").groupBy("g", "h1", "h2")
               .agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("v").alias("v")))
    path = scratch(spark, "cover-classes")
    grouped.write.parquet(path)
    release(spark)
    whole_classes = spark.read.schema(grouped.schema).parquet(path)
    total, size = whole_classes.agg(F.count(F.lit(1)), F.avg(F.size("v"))).first()

    # cells of the upper levels, from a bounded sample
    share = min(1.0, min(SAMPLE, SAMPLE_BYTES / 8 / (size or 1)) / max(1, total))
    sample = whole_classes.where(F.shiftrightunsigned(F.xxhash64("h1", "h2"), 11) < int(share * (1 << 53))).select("g", "v").toArrow()
    cells = spark.sparkContext.broadcast(_upper_cells(sample, share, threshold, code.itemsize))
    placed = _place(whole_classes, cells, code, inner(threshold) / 2)
    classes = cut(whole_classes.select("g", "h1", "h2", "node", "copies"), "cover-keys")
    drop_scratch(spark, path)
    found = cut(_links(placed, cells, code, threshold, total), "cover-found")

    groups = components(found, "node", "hub")
    linked_to = found.groupBy("node").agg(F.sum("links").alias("links"))
    decided = (classes.join(linked_to, "node", "left").join(groups, "node", "left")
               .select("g", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                       F.coalesce("component", "node").alias("component_id")))
    joined = rows.where("ok").select("id", "g", "h1", "h2").join(decided, ["g", "h1", "h2"]).select("id", "n_links", "component_id")
    rest = rows.where("not ok").select("id", F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"))
    return joined.unionAll(rest).select(
        F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


_ARROW = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(c.split() for c in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[k]) for c, k in zip(zip(*rows), kinds)], list(names))


def _place(classes: DataFrame, cells, code: np.dtype, radius: float) -> DataFrame:
    """Classes packed by cell, up to ``CHUNK`` in a row, and dealt to blocks (column i)."""
    spark = classes.sparkSession
    chunk = max(1, min(CHUNK, BLOCK // 8))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            node, copies = (batch.column(c).to_numpy() for c in ("node", "copies"))
            lists, named = batch.column("v"), batch.column("g").dictionary_encode()
            of = named.indices.to_numpy()
            order = np.argsort(of, kind="stable")
            ends = np.searchsorted(of[order], np.arange(len(named.dictionary) + 1))
            for key, lo, hi in zip(named.dictionary.to_pylist(), ends[:-1], ends[1:]):
                rows = order[lo:hi]
                raw = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(code).reshape(len(rows), -1)
                cell, far = np.zeros(len(rows), np.int64), np.full(len(rows), np.nan)
                if key in cells.value:
                    centres, dense, _ = cells.value[key]
                    gap = distances(unit(raw.astype(np.float64)), centres)
                    cell = dense + gap[:, dense:].argmin(axis=1)
                    if dense:
                        cell = np.where(gap[:, :dense].min(axis=1) <= radius, gap[:, :dense].argmin(axis=1), cell)
                    far = gap[np.arange(len(rows)), cell]
                most = max(1, min(chunk, CHUNK_BYTES // (raw.shape[1] * code.itemsize)))
                for c in np.unique(cell):
                    mine = np.flatnonzero(cell == c)
                    for at in range(0, len(mine), most):
                        some = mine[at:at + most]
                        ids, n = node[rows[some]], copies[rows[some]]
                        out.append((key, int(c), len(some), int(ids.min()), int(n.sum()), float(far[some].max()),
                                    ids.astype("<i8").tobytes(), n.astype("<i8").tobytes(), raw[some].tobytes()))
            if out:
                yield _batch(out, PLACED)

    df = classes.select("g", "node", "copies", "v").mapInArrow(place, PLACED)
    path = scratch(spark, "cover-placed")
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    release(spark)
    placed = spark.read.schema(df.schema).parquet(path)
    width = F.max((F.octet_length("vectors") / F.col("n")).cast("bigint"))
    most = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / width)))
    blocks = placed.groupBy("g", "a").agg(F.ceil(F.sum("n") / most).alias("blocks"))
    return placed.join(blocks, ["g", "a"]).withColumn("i", F.pmod(F.xxhash64("least"), "blocks").cast("int")).drop("blocks")


def _compared(sent: DataFrame, code: np.dtype, threshold: float) -> DataFrame:
    """Links of the packed classes sent to each pair of blocks, or to a block by itself."""
    def compare(table: pa.Table) -> pa.Table:
        a, i, b, j = (table.column(c)[0].as_py() for c in "aibj")
        alone, side = (a, i) == (b, j), table.column("side").to_numpy()
        parts, nodes, copies = [], [], []
        for s in (0, 1):
            own = table.filter(pa.array(side == s))
            if len(own):
                nodes.append(np.frombuffer(b"".join(own.column("ids").to_pylist()), "<i8"))
                copies.append(np.frombuffer(b"".join(own.column("copies").to_pylist()), "<i8"))
                raw = np.frombuffer(b"".join(own.column("vectors").to_pylist()), code)
                parts.append(unit(raw.reshape(len(nodes[-1]), -1).astype(np.float64)))
        if len(parts) == 1 + (not alone):
            node, copies = np.concatenate(nodes), np.concatenate(copies)
            links, hub = tally(parts[0], None if alone else parts[1], copies, threshold)
            some = links > 0
            got = node[some], links[some], node[hub[some]]
        else:
            got = (np.zeros(0, np.int64),) * 3
        return pa.table(dict(zip(("node", "links", "hub"), got)))

    return cut(sent.groupBy("g", "a", "i", "b", "j").applyInArrow(compare, FOUND), "cover-compared")


def _links(placed: DataFrame, cells, code: np.dtype, threshold: float, total: int) -> DataFrame:
    """For each class with links in a task: ``node``, how many copies it is linked with
    there, and a ``hub`` of its component."""
    spark, reach, whole = placed.sparkSession, outer(threshold), inner(threshold)

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Whether blocks are too far apart (left out), all linked (sure), or to be compared."""
        for frame in frames:
            gap = np.full(len(frame), np.nan)
            for key, part in frame.groupby("g"):
                if key in cells.value:
                    centres = cells.value[key][0]
                    dots = np.einsum("ij,ij->i", centres[part["a"]], centres[part["b"]])
                    gap[frame.index.get_indexer(part.index)] = np.sqrt(np.maximum(2.0 - 2.0 * dots, 0.0))
            around = frame["ra"].to_numpy() + frame["rb"].to_numpy()
            frame["sure"] = gap + around <= whole
            yield frame.loc[~(gap > around + reach), ["g", "a", "i", "b", "j", "na", "nb", "wa", "wb", "la", "lb", "ra", "rb", "sure"]]

    blocks = cut(placed.groupBy("g", "a", "i").agg(F.sum("n").alias("n"), F.sum("weight").alias("w"), F.min("least").alias("l"),
                                                   F.max("far").alias("r")), "cover-blocks")
    one = blocks.select("g", "a", "i", *(F.col(c).alias(f"{c}a") for c in "nwlr"))
    two = blocks.select("g", F.col("a").alias("b"), F.col("i").alias("j"), *(F.col(c).alias(f"{c}b") for c in "nwlr"))
    pairs = cut(one.join(two, "g").where("a < b or (a = b and i < j)").mapInPandas(
        judge, "g string, a int, i int, b int, j int, na bigint, nb bigint, wa bigint, wb bigint, la bigint, lb bigint, "
               "ra double, rb double, sure boolean"), "cover-pairs")
    moved, sure = pairs.agg(F.sum(F.when(~F.col("sure"), F.col("na") + F.col("nb"))), F.count(F.when(F.col("sure"), 1))).first()

    # each block with itself
    alone = placed.select("g", "a", "i", F.col("a").alias("b"), F.col("i").alias("j"), F.lit(0).alias("side"), "n", "ids", "copies", "vectors")
    out = _compared(alone, code, threshold)

    # blocks that are linked as a whole
    if sure:
        ends = pairs.where("sure")
        ends = ends.select("g", "a", "i", "wb", "lb").unionAll(ends.select("g", "b", "j", "wa", "la"))
        ends = ends.groupBy("g", "a", "i").agg(F.sum("wb").alias("links"), F.min("lb").alias("hub"))

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, links, hub in zip(*(batch.column(c).to_pylist() for c in ("ids", "links", "hub"))):
                    node = np.frombuffer(ids, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (node, np.full(len(node), links), np.full(len(node), hub))],
                                                     ["node", "links", "hub"])

        out = out.unionAll(placed.select("g", "a", "i", "ids").join(F.broadcast(ends), ["g", "a", "i"])
                           .select("ids", "links", "hub").mapInArrow(spread, FOUND))
        out = out.unionAll(pairs.where("sure").select(F.col("la").alias("node"), F.lit(0).cast("bigint").alias("links"), F.col("lb").alias("hub")))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(len(batch)):
                g, ids, copies, raw, to = (batch.column(c)[row].as_py() for c in ("g", "ids", "copies", "vectors", "to"))
                n, keep = len(ids) // 8, None
                if g in cells.value:
                    points = unit(np.frombuffer(raw, code).reshape(n, -1).astype(np.float64))
                    centres, dense, gaps = cells.value[g]
                    other = np.array([t["b"] if t["side"] == 0 else t["a"] for t in to])
                    keep = ~(distances(points, centres[other]) > np.array([t["limit"] for t in to]))
                    may = within(centres[dense:] @ points.T, gaps)[1]
                    keep &= np.where(other >= dense, may.T[:, np.maximum(other - dense, 0)], True)
                out = []
                for k, t in enumerate(to):
                    at = (g, t["a"], t["i"], t["b"], t["j"], t["side"])
                    if keep is None or keep[:, k].all():
                        out.append((*at, n, ids, copies, raw))
                    elif keep[:, k].any():
                        some = keep[:, k]
                        out.append((*at, int(some.sum()), *(np.frombuffer(x, kind).reshape(n, -1)[some].tobytes()
                                                            for x, kind in ((ids, "<i8"), (copies, "<i8"), (raw, code)))))
                if out:
                    yield _batch(out, SENT)

    # the other pairs, in rounds
    rounds = -(-(moved or 0) // max(COPIES * total, ROUND))
    for turn in range(rounds):
        now = pairs.where(~F.col("sure") & (F.pmod(F.xxhash64("g", "a", "i", "b", "j"), F.lit(rounds)) == turn))
        ends = [now.select("g", F.col(at).alias("x"), F.col(n).alias("y"), F.struct(
            "a", "i", "b", "j", F.lit(side).alias("side"), (F.col(other) + reach).alias("limit")).alias("to"))
            for side, at, n, other in ((0, "a", "i", "rb"), (1, "b", "j", "ra"))]
        to = ends[0].unionAll(ends[1]).groupBy("g", "x", "y").agg(F.collect_list("to").alias("to"))
        to = to.select("g", F.col("x").alias("a"), F.col("y").alias("i"), "to")
        sent = placed.join(F.broadcast(to), ["g", "a", "i"]).select("g", "ids", "copies", "vectors", "to").mapInArrow(send, SENT)
        out = out.unionAll(_compared(sent, code, threshold))
    return out
