"""Repeated passages by a common-prefix-aware distributed merge sort of suffixes.

A byte goes when it lies in a string of ``LENGTH`` bytes that starts anywhere
else too.  Sorting the suffixes at every byte would multiply the corpus; a sparse
set is enough:

1. Anchors.  Of the ``GRAM``-byte strings inside each window of ``LENGTH`` bytes,
   the one with the smallest hash (the leftmost of equals) is the window's anchor.
   It depends on the window's bytes alone, so equal windows have their anchors at
   the same place, and an anchor stands for a range of window starts.
2. A window can only repeat if its anchor's gram does: grams are counted, and
   anchors whose gram occurs once are dropped.
3. Each task sorts the suffixes at its remaining anchors into runs, front-codes
   them (length of the prefix shared with the suffix before, and the rest) and
   sends them by ranges of a hash of the gram's hash.  A receiving task merges its runs with
   a loser tree that carries, for every run's head, the prefix it is known to share
   with the last output: longer shared prefix wins, and only on a tie are bytes
   compared, from there on.  Suffixes with one gram come out side by side.
4. Within such a group every window is compared, by its hash, with the others;
   an anchor's repeated windows all hold the anchor, so the first and the last
   of them give its removed run.  Runs are united for each text.

Equal texts (by a 64-bit hash and the size) go in once: each of them lies whole in
the others, and any one of them shows what other texts share with them.

A gram that occurs more than ``HOT`` times (a passage that very many documents hold)
would be one large group: an ordinary aggregation counts instead, which pre-aggregates
in the map tasks and can be spread at will.  An anchor's windows are dealt into
blocks of ``BLOCK``, by their distance from the gram, so equal windows of
texts that agree around them fall into equal blocks.  Of a block that occurs twice every
window is repeated; windows are listed and counted, by two 64-bit hashes, for one of
equal blocks only.  Both ways find the same windows.

Texts are read in pieces; what a task holds are its runs.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` have
no repeated string; rows with a null id are texts like any other; an empty table
gives an empty table.  Only the two named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, release, scratch
from .katz_lm import pack, unpack
from .words import Hasher, mix

LENGTH = 400
GRAM = 128
HOT = 4096
BLOCK = 32  # windows
SENT_BLOCKS = 200_000  # that a task remembers to have listed
GRAM_SEED = np.uint64(0x2545F4914F6CDD1D)
PIECE = 1 << 19
PLACES = np.uint64((1 << 20) - 1)  # positions inside a piece
RUN_BYTES = 8 << 20
PART_ANCHORS = 40_000
GROUP_WINDOWS = 250_000  # windows and bytes of whole groups that are compared at once
GROUP_BYTES = 1 << 19


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(gram hash, place, first window, last window) of the anchors of a text."""
    parts, wide = [], length - gram + 1
    for at in range(0, max(0, len(data) - length + 1), PIECE):
        piece = data[at:at + PIECE + length - 1]
        h = Hasher(piece)
        places = np.arange(len(piece) - gram + 1)
        keys = (h.ranges(places, places + gram) & ~PLACES) | places.astype(np.uint64)
        n = len(keys)
        blocks = np.full(-(-n // wide) * wide, np.uint64((1 << 64) - 1))
        blocks[:n] = keys
        blocks = blocks.reshape(-1, wide)
        ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        least = (np.minimum(behind[:n - wide + 1], ahead[wide - 1:n]) & PLACES).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.append(first[1:], len(least)) - 1
        place = least[first]
        parts.append((h.ranges(place, place + gram), place + at, first + at, last + at))
    if not parts:
        return (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    return tuple(np.concatenate(x) for x in zip(*parts))


def part_of(grams: np.ndarray, parts: int) -> np.ndarray:
    """Which of ``parts`` (a power of two) each gram goes to.  Anchors have the smallest hashes of their
    windows, which all lie low, so they are mixed once more."""
    return mix(grams ^ GRAM_SEED) >> np.uint64(65 - parts.bit_length()) if parts > 1 else np.zeros(len(grams), np.uint64)


# ------------------------------------------------------------------ runs and their merge
def shared(a: bytes, b: bytes, at: int = 0) -> int:
    """Length of the common prefix, known to be ``at`` at least."""
    n = min(len(a), len(b))
    while at < n and a[at:at + 64] == b[at:at + 64]:
        at += 64
    at = min(at, n)
    while at < n and a[at] == b[at]:
        at += 1
    return at


def front_code(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A sorted run as shared prefix lengths, lengths of the rests, and the rests."""
    keep = np.array([shared(a, b) for a, b in zip([b"", *strings], strings)], np.uint32)
    rests = [s[k:] for s, k in zip(strings, keep)]
    return keep, np.array([len(r) for r in rests], np.uint32), b"".join(rests)


class Run:
    """A front-coded run, read one string at a time."""

    def __init__(self, keep: np.ndarray, rest: np.ndarray, data: bytes):
        self.keep, self.rest, self.data = keep.tolist(), rest.tolist(), data
        self.at, self.byte, self.head = -1, 0, b""

    def next(self) -> int:
        """Step to the next string; the prefix it shares with the one before, or
        -1 at the end."""
        self.at += 1
        if self.at >= len(self.keep):
            return -1
        k, n = self.keep[self.at], self.rest[self.at]
        self.head = self.head[:k] + self.data[self.byte:self.byte + n]
        self.byte += n
        return k


def merge(runs: list[Run]) -> Iterator[tuple[int, int, bytes, int]]:
    """Merge sorted runs: (run, place in it, string, prefix shared with the string
    before).  ``known[r]`` is what the head of run r shares with the last string
    that beat it; a run at its end has -1 and loses to all."""
    n = len(runs)
    known = [r.next() and 0 or 0 if r.keep else -1 for r in runs]

    def beats(a: int, b: int) -> bool:
        """Whether head a comes before head b; updates what the loser shares."""
        if known[a] != known[b]:
            return known[a] > known[b]
        if known[a] < 0:
            return a < b
        x, y = runs[a].head, runs[b].head
        k = shared(x, y, known[a])
        first = k == len(x) or (k < len(y) and x[k] < y[k])
        known[b if first else a] = k
        return first

    losers = [0] * (2 * n)

    def build(node: int) -> int:
        if node >= n:
            return node - n
        a, b = build(2 * node), build(2 * node + 1)
        win, lose = (a, b) if beats(a, b) else (b, a)
        losers[node] = lose
        return win

    if not n:
        return
    win = build(1) if n > 1 else 0
    while known[win] >= 0:
        run = runs[win]
        yield win, run.at, run.head, known[win]
        known[win] = run.next()
        node = (win + n) // 2
        while node:
            other = losers[node]
            if known[other] > known[win] or known[other] == known[win] and beats(other, win):
                losers[node], win = win, other
            node //= 2


def repeated_windows(members: list[tuple[int, bytes, int]], length: int) -> np.ndarray:
    """For members (group, bytes from their first window on, number of windows):
    the first and last window whose bytes another window of the group has, or -1."""
    sizes = np.array([len(m[1]) for m in members])
    counts = np.array([m[2] for m in members])
    base = np.cumsum(sizes) - sizes
    offset = np.cumsum(counts) - counts
    which = np.repeat(np.arange(len(members)), counts)
    inner = np.arange(counts.sum()) - offset[which]
    starts = base[which] + inner
    h = Hasher(b"".join(m[1] for m in members))
    with np.errstate(over="ignore"):
        keys = mix(h.ranges(starts, starts + length) + np.array([m[0] for m in members], np.uint64)[which] * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(keys, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[back] > 1)
    out = np.full((len(members), 2), -1)
    owner = which[hit]
    out[owner[::-1], 0] = inner[hit][::-1]  # the first hit is written last
    out[owner, 1] = inner[hit]
    return out


# ------------------------------------------------------------------ the operator
SENT = "part int, nums binary, places binary, firsts binary, counts binary, keep binary, rest binary, data binary, left binary, lefts binary"
FOUND = "num bigint, start bigint, stop bigint"
TEXT = ["mark", "size"]


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, mark, size); equal texts have one mark and size."""
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return src.withColumns({"mark": F.xxhash64("text"), "size": F.octet_length("text")})


def plain(packed: bytes) -> bytes:
    return pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)


def repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
            hot: int = HOT) -> DataFrame:
    """(mark, size, found): the removed byte ranges of each different text that has any."""
    spark = docs.sparkSession
    own = scratch(spark, "suffix")
    src = marked(docs, id_col, text_col).where(F.col("size") >= length).select("mark", "size", "text")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{own}/{name}")
        release(spark)
        return spark.read.schema(df.schema).parquet(f"{own}/{name}")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()  # a task sends a text once
        for batch in batches:
            rows, n = [], 0

            def out():
                sizes = [len(r[2]) for r in rows]
                cols = [np.concatenate([r[k] for r in rows]) for k in range(2, 6)]
                return pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(np.array([r[0] for r in rows], np.int64), sizes)),
                     pa.array(np.repeat(np.array([r[1] for r in rows], np.int32), sizes)),
                     pa.array(cols[0].view(np.int64)), *[pa.array(c.astype(np.int32)) for c in cols[1:]]],
                    ["mark", "size", "gram", "place", "first", "last"])

            for mark, size, text in zip(batch.column("mark").to_pylist(), batch.column("size").to_pylist(), batch.column("text")):
                if (mark, size) in sent:
                    continue
                sent.add((mark, size))
                got = anchors(text.as_py().encode("utf-8", "replace"), length, gram)
                if len(got[0]):
                    rows.append((mark, size, *got))
                    n += len(got[0])
                if n > 100_000:
                    yield out()
                    rows, n = [], 0
            if rows:
                yield out()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                keys = list(zip(part.column("mark").to_pylist(), part.column("size").to_pylist()))
                fresh = [i for i, k in enumerate(keys) if k not in sent and not sent.add(k)]
                part = part.take(pa.array(fresh, pa.int64()))
                texts = [t.as_py().encode("utf-8", "replace") for t in part.column("text")]
                small = [len(t).to_bytes(8, "little") + pa.compress(t, codec="zstd", asbytes=True) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("mark"), part.column("size"), pa.array(small, pa.binary())], ["mark", "size", "text"])

    placed = stored(src.mapInArrow(find, "mark bigint, size int, gram bigint, place int, first int, last int"), "anchors")
    at = F.xxhash64("mark", "size", "place", "first")  # copies of a text that several tasks send count as one
    often = (placed.groupBy("gram").agg(F.count(F.lit(1)).alias("times"), F.min(at).alias("lo"), F.max(at).alias("hi"))
             .where("lo != hi").select("gram", (F.col("times") > hot).alias("hot")))
    kept = stored(placed.join(often, "gram").select("mark", "size", "gram", "place", "first", "last", "hot"), "repeated")
    drop_scratch(spark, f"{own}/anchors")
    number, some_hot = kept.agg(F.count(F.lit(1)), F.coalesce(F.max("hot"), F.lit(False))).first()
    parts = 1 << max(0, int(np.ceil(np.log2(max(1, number / PART_ANCHORS)))))
    lists = kept.groupBy(*TEXT).agg(F.collect_set(F.struct("place", "first", "last", "gram", "hot")).alias("anchors"))
    texts = (src.mapInArrow(squeeze, "mark bigint, size int, text binary").join(lists, TEXT).dropDuplicates(TEXT)
             .select("mark", "size", "text", "anchors", F.monotonically_increasing_id().alias("num")))
    texts = stored(texts, "texts")  # the numbers hold from here on
    drop_scratch(spark, f"{own}/repeated")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        names = [x.split()[0] for x in SENT.split(", ")]
        schema = pa.schema([(x, pa.int32() if x == "part" else pa.binary()) for x in names])

        def out():
            by_part: dict[int, list] = {}
            for part, item in zip(part_of(np.array([x[0] for x in held], np.uint64), parts).tolist(), held):
                by_part.setdefault(part, []).append(item)
            rows = []
            for part, items in by_part.items():
                items.sort(key=lambda x: x[1])
                keep, rest, data = front_code([x[1] for x in items])
                rows.append((part, *[pack(np.array([x[k] for x in items], np.int64)) for k in range(3, 7)], pack(keep), pack(rest),
                             len(data).to_bytes(4, "little") + pa.compress(data, codec="zstd", asbytes=True),
                             pa.compress(lefts := b"".join(x[2] for x in items), codec="zstd", asbytes=True),
                             len(lefts).to_bytes(4, "little")))
            return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)

        for batch in batches:
            for num, text, found in zip(batch.column("num").to_pylist(), batch.column("text"), batch.column("anchors")):
                data = plain(text.as_py())
                for a in found.as_py():
                    if not a["hot"]:
                        stop = a["last"] + length
                        held.append((np.uint64(a["gram"] & (1 << 64) - 1), data[a["place"]:stop], data[a["first"]:a["place"]],
                                     num, a["place"], a["first"], a["last"] - a["first"] + 1))
                        size += stop - a["first"] + 200
                if size > RUN_BYTES:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    def receive(sent: pa.Table) -> pa.Table:
        meta, lefts, runs = [], [], []
        for row in sent.to_pylist():
            nums, places, firsts, counts = (unpack(row[c], np.int64) for c in ("nums", "places", "firsts", "counts"))
            data = pa.decompress(row["data"][4:], int.from_bytes(row["data"][:4], "little"), codec="zstd", asbytes=True)
            left = pa.decompress(row["left"], int.from_bytes(row["lefts"], "little"), codec="zstd", asbytes=True)
            meta.append((nums, firsts, counts))
            ends = np.cumsum(places - firsts)
            lefts.append((left, np.concatenate([[0], ends])))
            runs.append(Run(unpack(row["keep"], np.uint32), unpack(row["rest"], np.uint32), data))
        out: list[list[int]] = [[], [], []]
        members: list[tuple[int, bytes, int]] = []
        where: list[tuple[int, int]] = []
        group = windows = size = 0

        def decide():
            nonlocal members, where, windows, size
            if len(members) > 1:
                hits = repeated_windows(members, length)
                for (r, i), (a, b) in zip(where, hits):
                    if a >= 0:
                        nums, firsts, _ = meta[r]
                        for column, value in zip(out, (nums[i], firsts[i] + a, firsts[i] + b + length)):
                            column.append(int(value))
            members, where, windows, size = [], [], 0, 0

        for r, i, text, lcp in merge(runs):
            if lcp < gram:
                group += 1
                if windows > GROUP_WINDOWS or size > GROUP_BYTES:
                    decide()
            data, ends = lefts[r]
            count = int(meta[r][2][i])
            members.append((group, data[ends[i]:ends[i + 1]] + text, count))
            where.append((r, i))
            windows += count
            size += len(members[-1][1])
        decide()
        return pa.table([pa.array(x, pa.int64()) for x in out], ["num", "start", "stop"])

    rows = texts.mapInArrow(send, SENT).groupBy("part").applyInArrow(receive, FOUND)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(gram, block, nums, starts, n, windows): a row for each block with its places so far, and the
        hashes of its windows if the task has not listed them yet."""
        listed: set[tuple[int, int]] = set()
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(pa.int64())]
        names = ["gram", "block", "nums", "starts", "n", "windows"]
        places: dict[tuple[int, int], tuple[list, list, int, list | None]] = {}
        size = 0

        def out():
            rows = [(*k, *v) for k, v in places.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for batch in batches:
            for num, text, found in zip(batch.column("num").to_pylist(), batch.column("text"), batch.column("anchors")):
                data = plain(text.as_py())
                for a in found.as_py():
                    if not a["hot"]:
                        continue
                    near, far, h = a["place"] - a["last"], a["place"] - a["first"], Hasher(data[a["first"]:a["last"] + length])
                    cuts = [near, *range(near // BLOCK * BLOCK + BLOCK, far + 1, BLOCK), far + 1]
                    # windows start ``far`` to ``near`` bytes before the gram
                    lo, hi = far + 1 - np.array(cuts[1:]), far + 1 - np.array(cuts[:-1])
                    whole = h.ranges(lo, hi - 1 + length).view(np.int64).tolist()
                    for x, y, block in zip(lo.tolist(), hi.tolist(), whole):
                        key = a["gram"], block
                        if key not in places:
                            windows = None
                            if key not in listed:
                                if len(listed) >= SENT_BLOCKS:
                                    listed.clear()
                                listed.add(key)
                                inner = np.arange(x, y)
                                windows = h.ranges(inner, inner + length).view(np.int64).tolist()
                                size += len(windows)
                            places[key] = [], [], y - x, windows
                        nums, starts, *_ = places[key]
                        nums.append(num)
                        starts.append(a["first"] + x)
                        size += 1
                    if size > SENT_BLOCKS:
                        yield out()
                        places.clear()
                        size = 0
        if size:
            yield out()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(num, start, stop) from (nums, starts, lo, hi), united as far as a batch shows."""
        for batch in batches:
            many = batch.column("nums").value_lengths().to_numpy()
            if not len(many):
                continue
            nums, starts = (batch.column(c).flatten().to_numpy() for c in ("nums", "starts"))
            start, stop = (starts + np.repeat(batch.column(c).to_numpy(), many) for c in ("lo", "hi"))
            order = np.lexsort((start, nums))
            nums, start, stop = nums[order], start[order], stop[order] + length
            # a run ends where the next start lies beyond all stops so far; texts lie apart on one line
            text = np.unique(nums, return_inverse=True)[1] * (int(stop.max()) + 1)
            reach = np.maximum.accumulate(stop + text)
            head = np.flatnonzero(np.concatenate([[True], (start + text)[1:] > reach[:-1]]))
            last = np.append(head[1:], len(nums)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(nums[head]), pa.array(start[head]), pa.array(reach[last] - text[last])], ["num", "start", "stop"])

    if some_hot:
        rows = stored(rows, "cold")
        dealt = stored(texts.where(F.exists("anchors", lambda a: a["hot"])).mapInArrow(
            blocks, "gram bigint, block bigint, nums array<bigint>, starts array<bigint>, n bigint, windows array<bigint>"), "blocks")
        held = dealt.select("gram", "block", "nums", "starts", "n")
        listed = (dealt.where("windows is not null").groupBy("gram", "block").agg(F.first("windows").alias("windows"))
                  .select("gram", "block", F.posexplode("windows").alias("start", "window")).withColumn("start", F.col("start").cast("bigint")))
        twice = listed.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
        some = listed.join(twice, ["gram", "window"]).groupBy("gram", "block").agg(F.min("start").alias("lo"), F.max("start").alias("hi"))
        whole = held.groupBy("gram", "block").agg(F.sum(F.size("nums")).alias("times"), F.max("n").alias("n")).where("times > 1")
        known = (some.unionAll(whole.select("gram", "block", F.lit(0).cast("bigint"), F.col("n") - 1))
                 .groupBy("gram", "block").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
        warm = held.join(known, ["gram", "block"]).select("nums", "starts", "lo", "hi").mapInArrow(spread, FOUND)
        rows = rows.unionAll(warm)
    found = (rows.distinct().groupBy("num").agg(F.array_sort(F.collect_list(F.struct("start", "stop"))).alias("found"))
             .join(texts.select("num", *TEXT), "num").select(*TEXT, "found"))
    copied = (src.groupBy(*TEXT).agg(F.count(F.lit(1)).alias("times")).where("times > 1")
              .select(*TEXT, F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("size").cast("bigint").alias("stop"))).alias("found")))
    found = stored(found.join(copied, TEXT, "left_anti").unionAll(copied), "found")
    for name in ("texts", *(("cold", "blocks") if some_hot else ())):
        drop_scratch(spark, f"{own}/{name}")
    return found


def remove(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
           hot: int = HOT) -> DataFrame:
    """For each row: ``id_col``, ``n_bytes``, ``spans`` (start, stop of the removed
    byte ranges, apart from each other) and ``kept`` (the bytes that stay)."""
    src = marked(docs, id_col, text_col)
    found = repeats(docs, id_col=id_col, text_col=text_col, length=length, gram=gram, hot=hot)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                sizes, spans, kept = [], [], []
                for text, ranges in zip(part.column("text"), part.column("found")):
                    data, united = text.as_py().encode("utf-8", "replace"), []
                    for r in ranges.as_py() or ():
                        if united and r["start"] <= united[-1][1]:
                            united[-1][1] = max(united[-1][1], r["stop"])
                        else:
                            united.append([r["start"], r["stop"]])
                    cuts = [0, *[x for u in united for x in u], len(data)]
                    sizes.append(len(data))
                    spans.append([{"start": a, "stop": b} for a, b in united])
                    kept.append(b"".join(data[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), pa.array(sizes, pa.int64()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
                    ["id", "n_bytes", "spans", "kept"])

    return (src.join(found, TEXT, "left").select("id", "text", "found")
            .mapInArrow(apply, "id bigint, n_bytes bigint, spans array<struct<start:bigint,stop:bigint>>, kept binary")
            .withColumnRenamed("id", id_col))
