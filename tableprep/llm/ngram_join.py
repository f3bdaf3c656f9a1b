"""N-gram Jaccard join: all documents whose five-word shingle sets have a
Jaccard similarity of 0.75 or more, and the groups that these links make.

Multiple-global-order filtering.  Fix an order of all shingles: two sets with
similarity t share at least one of the first n - ceil(t n) + 1 shingles of each.
That holds under *every* order, so a pair must pass under several of them before
its sets are compared:

1. Equal sets become one class (a sum and a xor of mixed hashes, 128 bits, and
   the size); copies cost a row each and nothing more.
2. Whole prefixes under an order that puts frequent shingles last (a sketch of
   fixed size counts all shingles of all documents).  A class that shares no
   prefix shingle with another has no link and is done; only the texts of the
   others are looked at again.
3. First shingles in 32 ranges of a hash order (an empty range takes the next filled
   one's).  Of the classes that share one, the hub is the class whose first shingles
   most others share too -- in a group of near copies, the text they were made from.
   Each is paired with its hub when they agree in ``AGREE`` ranges; verified links make
   first components.  That takes large groups of near copies together without listing
   their pairs.
4. The same with prefix shingles: of the components that share one, the class that
   shares most is the hub, every class of another component is paired with it,
   components with a link become one, and a new hub is elected, until a round adds
   no link or ``ROUNDS`` are over.
5. Prefix shingles whose classes lie in one component can add nothing; of the others,
   all pairs across components are looked at: their sizes and places in the prefix must
   leave room for enough common shingles, their parities (of cells in proportion to the
   sets) must not differ in too many places, and they must share prefix shingles under two further orders; then they
   are verified.  A shingle of more than ``FEW`` classes is compared in tasks, a block of
   its classes against another, and only pairs that sizes, places and parities allow
   become rows.  Nothing is capped: every link between two components
   is found here, so the final components are exact.

Shingles are 64-bit hashes, made again from the text where they are needed:
sets take twice the room of the texts and don't compress.  The texts of pairs to
verify are joined by id; a hub's many pairs are a skewed join that Spark splits.

Defined results: null and empty texts, and texts without words, have no shingles
and link with nothing; a text of fewer than five words has one; rows with a null
id get a null component and link with nothing; rows that share an id are one
document; equal texts are linked; an empty table gives an empty table.  Only the
two named columns are read.
"""
from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut
from .components import components
from .words import mix, shingles, word_hashes, word_hashes_each

PERCENT = 75
SIZE = 5
ORDERS = 32
AGREE = 12
SKETCH_BITS = 22
CHUNK_BITS = 16
HUBS = 128  # sets that a verifying task keeps
ROUNDS = 3
FEW = 8  # classes under a shingle whose pairs a join lists
BLOCK = 128
CELLS = 512

SIGNED = "n bigint, s1 bigint, s2 bigint, mins array<bigint>, parity binary, chunk int, counts binary"


def order_key(tokens: np.ndarray, order: int) -> np.ndarray:
    """The place of tokens in a hash order."""
    with np.errstate(over="ignore"):
        return mix(tokens + np.uint64((order + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def prefix(tokens: np.ndarray, keys: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The first tokens by key (ties by token; ``tokens`` are sorted)."""
    return tokens[np.argsort(keys, kind="stable")[:prefix_length(len(tokens), percent)]]


def parities(tokens: np.ndarray) -> bytes:
    """For each cell of two to four a token, whether an odd number of tokens falls into it."""
    if not len(tokens):
        return b""
    size = max(CELLS, 1 << (2 * len(tokens) - 1).bit_length())
    cells = (tokens & np.uint64(size - 1)).astype(np.int64)
    return np.packbits(np.bincount(cells, minlength=size) & 1 == 1).tobytes()


def folded(cells: np.ndarray, size: int) -> np.ndarray:
    """Parities (bytes, in the last axis) as they were with ``size`` bytes of cells: a token's cell is its low bits."""
    return np.bitwise_xor.reduce(cells.reshape(*cells.shape[:-1], -1, size), axis=-2)


FIRST = np.arange(ORDERS, dtype=np.uint64)
SHIFT = np.uint64(64 - ORDERS.bit_length() + 1)


def minima(tokens: np.ndarray) -> list[int]:
    """The first token, as its key, of each of ``ORDERS`` ranges of one hash order; a range
    without tokens takes that of the next one, by steps of its own, that has some."""
    if not len(tokens):
        return []
    keys = np.sort(order_key(tokens, 3))
    at = np.searchsorted(keys, FIRST << SHIFT)
    out = keys[np.minimum(at, len(keys) - 1)]
    filled = (at < len(keys)) & (out >> SHIFT == FIRST)
    for k in np.flatnonzero(~filled):
        j = (k + 1 + 2 * k) % ORDERS
        while not filled[j]:
            j = (j + 1 + 2 * k) % ORDERS
        out[k] = out[j]
    return out.view(np.int64).tolist()


def room(na: str, pa: str, nb: str, pb: str, percent: int) -> str:
    """SQL: may sets of these sizes be similar enough whose first common token has these places?
    (A later common token may deny what the first one grants; the pair is found at the first.)"""
    return (f"least({na}, {nb}) * 100 >= greatest({na}, {nb}) * {percent} and "
            f"least({na} - {pa}, {nb} - {pb}) * {100 + percent} >= ({na} + {nb}) * {percent}")


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of tokens that only one of two sets has: a cell whose
    parity differs holds one.  The longer parities are folded."""
    p, q = sorted((np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)), key=len)
    return int(np.bitwise_count(p ^ folded(q, len(p))).sum())


def few_apart(xs: list[bytes], ys: list[bytes], i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the pairs (xs[i], ys[j]), those that ``apart`` puts at most ``most`` tokens apart: first
    by ``CELLS`` cells, then by as many as the smaller set has."""
    left, right = (np.array([len(v) for v in side], np.int64) for side in (xs, ys))
    sizes = np.minimum(left[i], right[j])
    keep = np.ones(len(i), bool)

    def matrix(side: list[bytes], lengths: np.ndarray, used: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        rows, at = np.unique(used, return_inverse=True)
        out = np.empty((len(rows), size), np.uint8)
        for length in np.unique(lengths[rows]).tolist():
            some = np.flatnonzero(lengths[rows] == length)
            out[some] = folded(np.frombuffer(b"".join([side[r] for r in rows[some]]), np.uint8).reshape(len(some), length), size)
        return out.view(np.uint64), at

    def drop(pairs: np.ndarray, size: int) -> None:
        if len(pairs):
            (x, a), (y, b) = matrix(xs, left, i[pairs], size), matrix(ys, right, j[pairs], size)
            step = max(1, (1 << 23) // size)
            for lo in range(0, len(pairs), step):
                some = slice(lo, lo + step)
                differ = np.bitwise_count(x[a[some]] ^ y[b[some]]).sum(axis=1, dtype=np.int64)
                keep[pairs[some]] = differ <= most[pairs[some]]

    drop(np.arange(len(i)), CELLS // 8)
    for size in np.unique(sizes[keep]).tolist():
        if size > CELLS // 8:
            drop(np.flatnonzero(keep & (sizes == size)), size)
    return keep


def near_enough(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and parities don't rule out: at the
    similarity asked for, at most (100 - t) / (100 + t) of all tokens differ."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("na").to_pylist(), batch.column("nb").to_pylist(), batch.column("xa"), batch.column("xb"))
            fine = [i for i, (n, m, x, y) in enumerate(rows)
                    if apart(x.as_buffer(), y.as_buffer()) * (100 + percent) <= (100 - percent) * (n + m)]
            yield batch.select(["a", "b"]).take(pa.array(fine, pa.int64()))

    of_a = classes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("parity").alias("xa"))
    of_b = classes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("xb"))
    sized = pairs.join(of_a, "a").join(of_b, "b").where(f"least(na, nb) * 100 >= greatest(na, nb) * {percent}")
    return sized.mapInArrow(keep, "a bigint, b bigint")


def signatures(docs: DataFrame, size: int) -> DataFrame:
    """(id, n, s1, s2, mins) for each row, and each task's shingle counts in
    chunks (chunk, counts); one pass over the texts."""
    bits, part = SKETCH_BITS, 1 << CHUNK_BITS

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch, held, n_held = np.zeros(1 << bits, np.int64), [], 0
        for frame in frames:
            rows = []
            for words in word_hashes_each(frame["text"]):
                toks = shingles(words, size)
                with np.errstate(over="ignore"):
                    s1, s2 = np.sum(order_key(toks, 100)), np.bitwise_xor.reduce(order_key(toks, 101))
                rows.append((len(toks), int(np.uint64(s1).view(np.int64)), int(np.uint64(s2).view(np.int64)), minima(toks),
                             parities(toks), None, None))
                held.append((toks >> np.uint64(64 - bits)).astype(np.int64))
                n_held += len(toks)
                if n_held > 1 << 20:
                    sketch += np.bincount(np.concatenate(held), minlength=1 << bits)
                    held, n_held = [], 0
            out = pd.DataFrame(rows, columns=["n", "s1", "s2", "mins", "parity", "chunk", "counts"])
            out.insert(0, "id", frame["id"].array)
            yield out
        if held:
            sketch += np.bincount(np.concatenate(held), minlength=1 << bits)
        if sketch.any():
            parts = [(None, None, None, None, None, None, i, zlib.compress(x.astype(np.uint32).tobytes(), 1))
                     for i, x in enumerate(sketch.reshape(-1, part))]
            yield pd.DataFrame(parts, columns=["id", "n", "s1", "s2", "mins", "parity", "chunk", "counts"]).astype(
                {"id": "Int64", "n": "Int64", "s1": "Int64", "s2": "Int64"})

    return docs.mapInPandas(run, f"id bigint, {SIGNED}")


def frequency_classes(signed: DataFrame) -> np.ndarray:
    """A class of frequency (0: like any other, then by powers of two) for each
    cell of the sketch: ``2 ** SKETCH_BITS`` bytes, whatever the input."""
    cells = 1 << CHUNK_BITS

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                got = np.frombuffer(zlib.decompress(data), np.uint32).astype(np.int64)
                sums[chunk] = sums.get(chunk, 0) + got
        if sums:
            yield pa.RecordBatch.from_pydict({"chunk": pa.array(sums, pa.int32()),
                                              "counts": pa.array([x.tobytes() for x in sums.values()], pa.binary())})

    chunks = 1 << SKETCH_BITS - CHUNK_BITS
    summed = cut(signed.where("chunk is not null").select("chunk", "counts").repartition(chunks, "chunk")
                 .mapInArrow(add, "chunk int, counts binary"), "ngram-sketch")  # one row a chunk

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(np.frombuffer(x.as_buffer(), np.int64).sum()) for x in batch.column("counts")]
            yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64())], ["total"])

    mean = (summed.mapInArrow(total, "total bigint").agg(F.sum("total")).first()[0] or 0) / (1 << SKETCH_BITS)
    usual = mean + 4 * np.sqrt(mean) + 8

    def classify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = []
            for x in batch.column("counts"):
                n = np.frombuffer(x.as_buffer(), np.int64)
                kinds.append(np.where(n > usual, np.log2(np.maximum(n / usual, 1)).astype(np.int64) + 1, 0).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(kinds, pa.binary())], ["chunk", "kinds"])

    out = np.zeros(1 << SKETCH_BITS, np.uint8)
    for chunk, kinds in summed.mapInArrow(classify, "chunk int, kinds binary").collect():
        out[chunk * cells:(chunk + 1) * cells] = np.frombuffer(bytes(kinds), np.uint8)
    return out


def rare_first(tokens: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The place of tokens in the order that puts frequent ones last."""
    kind = classes[(tokens >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64)
    return kind << np.uint64(56) | order_key(tokens, 0) >> np.uint64(8)


def prefix_postings(spark: SparkSession, docs: DataFrame, classes: np.ndarray, size: int, percent: int) -> DataFrame:
    """(token, s1, place): the prefix shingles of each class under the rare-first order."""
    table = spark.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()  # a task sends a class once
        for batch in batches:
            toks, sigs, held = [], [], 0

            def out():
                sizes = [len(x) for x in toks]
                return pa.RecordBatch.from_arrays([
                    pa.array(np.concatenate(toks).view(np.int64)), pa.array(np.repeat(np.array(sigs, np.int64), sizes)),
                    pa.array(np.concatenate([np.arange(n, dtype=np.int32) for n in sizes]))], ["token", "s1", "place"])

            for words in word_hashes_each(x.as_py() for x in batch.column("text")):
                found = shingles(words, size)
                if len(found):
                    with np.errstate(over="ignore"):
                        sig = int(np.sum(order_key(found, 100)).view(np.int64))
                    if sig in sent:
                        continue
                    sent.add(sig)
                    sigs.append(sig)
                    toks.append(prefix(found, rare_first(found, table.value), percent))
                    held += len(toks[-1])
                if held > 200_000:
                    yield out()
                    toks, sigs, held = [], [], 0
            if toks:
                yield out()

    return docs.where("id is not null").mapInArrow(run, "token bigint, s1 bigint, place int")


def packed(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, text) of the wanted ids, the texts compressed before they move."""

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                texts = [(t.as_py() or "").encode("utf-8", "replace") for t in part.column("text")]
                small = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(small, pa.binary())], ["id", "text"])

    return docs.where("id is not null").mapInArrow(squeeze, "id bigint, text binary").join(wanted, "id").select("id", "text")


def verify(texts: DataFrame, pairs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b) of ids whose sets share prefix shingles under two more
    orders and are similar enough; ``texts`` as ``packed`` gives them."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def orders(packed_text: bytes) -> list[np.ndarray]:
            text = pa.decompress(packed_text[8:], int.from_bytes(packed_text[:8], "little"), codec="zstd", asbytes=True)
            found = shingles(word_hashes(text.decode("utf-8")), size)
            return [found, *[np.sort(prefix(found, order_key(found, k), percent)) for k in (1, 2)]]

        hubs: dict[int, tuple[bytes, list[np.ndarray]]] = {}
        for batch in batches:
            keep = []
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("x"), batch.column("y"))):
                x = x.as_py()
                if a not in hubs or hubs[a][0] != x:
                    if len(hubs) >= HUBS:
                        hubs.clear()
                    hubs[a] = x, orders(x)
                p, q = hubs[a][1], orders(y.as_py())
                if all(np.intersect1d(p[k], q[k], assume_unique=True).size for k in (1, 2)):
                    both = np.intersect1d(p[0], q[0], assume_unique=True).size
                    if 100 * both >= percent * (len(p[0]) + len(q[0]) - both):
                        keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    one = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("x")), "a")
    both = one.join(texts.select(F.col("id").alias("b"), F.col("text").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(similar, "a bigint, b bigint")


def opened(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(token, node, n, place, component, times) of the prefix shingles that classes of
    different components share, and how many do."""
    placed = shared.join(groups, "node", "left").select("token", "node", "n", "place", F.coalesce("component", "node").alias("component"))
    split = (placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("times"))
             .where("lo != hi"))
    return placed.join(split.select("token", "times"), "token")


def against_hubs(members: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: each class and the hub of each of its shingles, where that is of another component."""
    weight = members.groupBy("node").agg(F.sum("times").alias("w"))
    # ``max`` pre-aggregates, so a frequent shingle is no burden
    hubs = members.join(weight, "node").groupBy("token").agg(
        F.max(F.struct("w", (-F.col("node")).alias("m"), F.col("n").alias("nh"), F.col("place").alias("ph"), F.col("component").alias("ch"))).alias("top"))
    both = members.join(hubs, "token").where("component != top.ch").where(room("n", "place", "top.nh", "top.ph", percent))
    return both.select(F.least("node", -F.col("top.m")).alias("a"), F.greatest("node", -F.col("top.m")).alias("b")).distinct()


def across_blocks(members: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(a, b), a < b: the pairs across components under frequent shingles that sizes, places and
    parities allow.  The classes of a shingle are dealt into blocks of about ``BLOCK``; a
    task compares two blocks at a time."""
    dealt = (members.join(classes.select("node", "parity"), "node")
             .withColumn("block", F.pmod(F.xxhash64("node", "token"), F.ceil(F.col("times") / BLOCK))))
    blocks = dealt.groupBy("token", "block").agg(F.collect_list(F.struct("node", "n", "place", "component", "parity")).alias("m"))
    left, right = (blocks.select("token", F.col("block").alias(f"{x}_block"), F.col("m").alias(x)) for x in "xy")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fields(cell) -> list:
            held = cell.values
            return [*[held.field(k).to_numpy().astype(np.int64) for k in range(4)], held.field(4).to_pylist()]

        for batch in batches:
            for x, y in zip(batch.column("x"), batch.column("y")):
                (a, na, pa_, ca, xa), (b, nb, pb, cb, xb) = fields(x), fields(y)
                na, pa_ = na[:, None], pa_[:, None]
                fine = (ca[:, None] != cb) & (np.minimum(na, nb) * 100 >= np.maximum(na, nb) * percent)
                fine &= np.minimum(na - pa_, nb - pb) * (100 + percent) >= (na + nb) * percent
                i, j = np.nonzero(fine)
                near = few_apart(xa, xb, i, j, (100 - percent) * (na[i, 0] + nb[j]) // (100 + percent))
                i, j = i[near], j[near]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a[i], b[j])), pa.array(np.maximum(a[i], b[j]))], ["a", "b"])

    return left.join(right, "token").where("x_block <= y_block").select("x", "y").mapInArrow(compare, "a bigint, b bigint").distinct()


def stars(groups: DataFrame) -> DataFrame:
    """Links (a, b) that make the same components as those that ``groups`` comes from, none longer than two steps."""
    return groups.where("node != component").select(F.col("component").alias("a"), F.col("node").alias("b"))


def join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
         percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, ``n_shingles`` and
    ``component_id`` (the smallest id that links reach)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = cut(signatures(docs, size), "ngram-signed")
    rows = signed.where("chunk is null")
    classes = cut(rows.where("id is not null and n > 0").groupBy("s1", "s2", "n")
                  .agg(F.min("id").alias("node"), F.first("mins").alias("mins"), F.first("parity").alias("parity")), "ngram-classes")

    # whole prefixes: a class that shares no prefix shingle has no link
    seen = Window.partitionBy("token")
    posted = prefix_postings(spark, docs, frequency_classes(signed), size, percent).repartition("token").distinct()
    shared = (posted.withColumns({"lo": F.min("s1").over(seen), "hi": F.max("s1").over(seen)})
              .where("lo != hi").select("token", "s1", "place").join(classes.select("s1", "node", "n"), "s1"))
    shared = cut(shared.drop("s1"), "ngram-shared")
    some = shared.select(F.col("node").alias("id")).distinct()
    texts = cut(packed(docs, some), "ngram-texts")

    # first shingles under several orders: each class against the hub of those that share one
    firsts = (classes.join(some.withColumnRenamed("id", "node"), "node", "left_semi")
              .select("node", F.posexplode("mins").alias("k", "m")))
    alike = firsts.groupBy("k", "m").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    firsts = cut(firsts.join(alike, ["k", "m"]), "ngram-firsts")
    weight = firsts.groupBy("node").agg(F.sum("c").alias("w"))
    hubs = (firsts.join(weight, "node").groupBy("k", "m")
            .agg(F.max(F.struct("w", (-F.col("node")).alias("a"))).alias("top")).select("k", "m", (-F.col("top.a")).alias("a")))
    near = firsts.join(hubs, ["k", "m"]).where("a != node").groupBy("a", F.col("node").alias("b")).count().drop("count")
    of_a = classes.select(F.col("node").alias("a"), F.col("mins").alias("ma"))
    of_b = classes.select(F.col("node").alias("b"), F.col("mins").alias("mb"))
    agree = F.aggregate(F.zip_with("ma", "mb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = near.join(of_a, "a").join(of_b, "b").where(agree >= AGREE).select("a", "b")
    near = cut(near_enough(near, classes, percent), "ngram-near")
    known = cut(verify(texts, near, size, percent), "ngram-links")
    groups = cut(components(known), "ngram-groups")

    # prefix shingles: components against the hub of those that share one, round by round
    tested = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for _ in range(ROUNDS):
        members = cut(opened(shared, groups), "ngram-open")
        near = cut(near_enough(against_hubs(members, percent).join(tested, ["a", "b"], "left_anti"), classes, percent), "ngram-near")
        new = cut(verify(texts, near, size, percent), "ngram-links")
        tested = tested.unionAll(near)
        if new.isEmpty():
            break
        groups = cut(components(stars(groups).unionAll(new)), "ngram-groups")

    # all pairs across the components found so far that share a prefix shingle
    members = cut(opened(shared, groups), "ngram-open")
    left, right = (members.where(f"times <= {FEW}").select("token", F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("place").alias(f"p{x}"),
                                                           F.col("component").alias(f"c{x}")) for x in "ab")
    few = left.join(right, "token").where("a < b and ca != cb").where(room("na", "pa", "nb", "pb", percent)).select("a", "b")
    far = few.unionAll(across_blocks(members.where(f"times > {FEW}"), classes, percent)).distinct()
    far = cut(near_enough(far.join(tested, ["a", "b"], "left_anti"), classes, percent), "ngram-far")
    links = stars(groups).unionAll(verify(texts, far, size, percent))
    groups = cut(components(links), "ngram-groups")

    final = (classes.join(groups, "node", "left")
             .select("s1", "s2", "n", F.coalesce("component", "node").alias("component_id")))
    with_id = rows.where("id is not null and n > 0").select("id", "s1", "s2", "n").join(final, ["s1", "s2", "n"])
    rest = rows.where("id is null or n = 0").select("id", "n", F.col("id").alias("component_id"))
    return (with_id.select("id", "n", "component_id").unionAll(rest)
            .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"))
