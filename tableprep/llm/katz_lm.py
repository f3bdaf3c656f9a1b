"""Language-model scores by Katz backoff with Good-Turing discounts.

Model (n-grams over words up to ``order`` and one end token a text; one start
context, so a history never reaches before it):

    P(w)     = d1(c(w)) c(w) / N            of a word seen in training
    P(unk)   = the mass the discounts leave: one event for all unseen words
    P(w | h) = dk(c(h,w)) c(h,w) / c(h)     of an n-gram seen in training
             = a(h) P(w | h')               otherwise; h' is h without its first
                                            word, a(h) is 1 of an unseen h

``dk(r)`` are Katz's discounts of the n-grams of length k, from counts of counts
for r <= ``K``, 1 above.  Every n-gram is stored, also those that occur once.
a(h) is what makes the row of h sum to exactly 1: (1 - sum of its stored
probabilities) / (1 - sum of P(w | h') over its stored w).  A context whose
stored probabilities already sum to 1 counts itself once more.

The recursion, in logarithms, is P(w) for every token, plus a(h) for each of its
histories, plus a correction for each stored n-gram.  So a text needs one number
for each of its n-grams of any length (the correction, and log a of it as a
context), and all lookups become one join on 64-bit keys.

Tables (Parquet, partitioned by order, in the shared folder or where the caller
says) hold every counted word and n-gram with its numbers, sorted and compressed
by ranges of the key; they grow with the corpus and nothing is broadcast whole.  Only the ``HOT`` entries
with the largest counts are: they answer most tokens in place, and with them
gone no key is frequent enough to be a hot group.  Other keys travel sorted and
compressed, by ranges of the key, with the position of the document in its
batch; what comes back for a batch is three sums for each document with such keys.

Defined results: a null text counts as empty and has one token, its end; a null
id is held out; without training tokens N and V are 0, every token is unknown,
has probability 1 and scores 0; repeated rows score alike and train as often as
they occur; an empty table gives an empty table.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_scratch, release, scratch
from .words import mix, word_hashes_each

ORDER = 2
K = 5
HOT = 1 << 18
HOT_WORDS = 1 << 16
STEP_TOKENS = 1 << 19  # tokens that a scoring step holds; counting holds four times as many
PART_TOKENS = 3_000_000

END = np.uint64(0x5851F42D4C957F2D)  # the end token and the start context, as word hashes
START = np.uint64(0x14057B7EF767814F)


def held_out(key: Column, folds: int = 10) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == 0, F.lit(True))


def bigram_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Odd keys for n-grams, from the keys of their first and last n - 1 words;
    words have even ones."""
    with np.errstate(over="ignore"):
        return mix(v * np.uint64(0x9FB21C651E98DF25) + w * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def word_keys(w: np.ndarray) -> np.ndarray:
    return w & ~np.uint64(1)


def steps(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows of about STEP_TOKENS tokens: (rows, tokens, their contexts,
    the row of each)."""
    lo, held, n = 0, [], 0
    for at, found in enumerate(word_hashes_each(x.as_py() for x in batch.column("text"))):
        held.append(np.append(found, END))
        n += len(held[-1])
        if n >= STEP_TOKENS or at == len(batch) - 1:
            words = np.concatenate(held)
            before = np.concatenate([[START], words[:-1]])
            sizes = np.array([len(x) for x in held])
            before[np.cumsum(sizes) - sizes] = START
            yield batch.slice(lo, at + 1 - lo), words, before, np.repeat(np.arange(len(held)), sizes)
            lo, held, n = at + 1, [], 0


def grams(words: np.ndarray, before: np.ndarray, who: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length from 2 to ``order``: (first n - 1 words, last n - 1 words,
    row) of the n-grams, as keys."""
    v, w, at = before, words, who
    for length in range(2, order + 1):
        yield v, w, at
        if length < order:
            key, same = bigram_keys(v, w), at[1:] == at[:-1]
            v, w, at = key[:-1][same], key[1:][same], at[1:][same]


def pack(x: np.ndarray) -> bytes:
    """Byte planes, compressed: high bytes of sorted or small numbers cost little."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:4], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(pa.decompress(data[4:], n * size, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(kind).ravel()


def runs_of(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): an order that sorts the keys, and where each different key starts in it."""
    order = np.argsort(keys)
    ranked = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]])[:len(keys)])


# ------------------------------------------------------------------ counting
def word_counts(docs: DataFrame) -> DataFrame:
    """(w, c): training tokens, and the start context once a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            words, counts = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(counts)], ["w", "c"])

        for batch in batches:
            for part, words, _, _ in steps(batch):
                held += [words, np.full(len(part), START)]
                n += len(words)
                if n >= 4 * STEP_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    return docs.where("train").select("text").mapInArrow(run, "w bigint, c bigint").groupBy("w").agg(F.sum("c").alias("c"))


def gram_counts(docs: DataFrame, length: int, hot: tuple[np.ndarray, np.ndarray], parts: int) -> DataFrame:
    """(v, w, often, p, r, c) of the n-grams of a length: keys of the first and the last
    words, whether the first ones are frequent, the probability of the last ones if they are,
    null, count; and rows (null, null, null, null, r, n) for the number n of n-grams that occur
    r <= K + 1 times.

    Tasks send sorted counts by ranges of the key; frequent ones (``hot``: at most HOT_WORDS
    sorted keys and their probabilities) travel as small numbers."""
    table, shift = docs.sparkSession.sparkContext.broadcast(hot), np.uint64(64 - parts.bit_length() + 1)

    def coded(x: np.ndarray) -> np.ndarray:
        names, _ = table.value
        at = np.minimum(np.searchsorted(names, x), max(len(names) - 1, 0))
        return np.where(names[at] == x, at.astype(np.uint64), x) if len(names) else x

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out():
            v, w = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            keys = bigram_keys(v, w)
            order, starts = runs_of(keys)
            first, counts = order[starts], np.diff(np.append(starts, len(keys)))
            keys, v, w = keys[first], v[first], w[first]
            cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else [0, len(keys)]
            rows = []
            for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                if hi > lo:
                    a, b, c = coded(v[lo:hi]), coded(w[lo:hi]), counts[lo:hi].astype(np.uint32)
                    order = np.lexsort((b, a))
                    rows.append((p, pack(a[order]), pack(b[order]), pack(c[order])))
            return pa.RecordBatch.from_pylist([dict(zip(("part", "v", "w", "c"), r)) for r in rows], schema=pa.schema(
                [("part", pa.int32()), ("v", pa.binary()), ("w", pa.binary()), ("c", pa.binary())]))

        for batch in batches:
            for _, words, before, who in steps(batch):
                *_, (v, w, _) = grams(words, before, who, length)
                held.append((v, w))
                n += len(words)
                if n >= 4 * STEP_TOKENS:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    def add(sent: pa.Table) -> pa.Table:
        names, chances = table.value

        def named(column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes = np.concatenate([unpack(x, np.uint64) for x in sent.column(column).to_pylist()])
            few = codes < len(names)
            at = codes[few].astype(np.int64)
            codes[few] = names[at]
            return codes, few, at

        v, often, _ = named("v")
        w, few, at = named("w")
        p = np.zeros(len(w))
        p[few] = chances[at]
        c = np.concatenate([unpack(x, np.uint32) for x in sent.column("c").to_pylist()])
        order, starts = runs_of(bigram_keys(v, w))
        total, first = np.add.reduceat(c[order].astype(np.int64), starts), order[starts]
        times = np.bincount(np.minimum(total, K + 2), minlength=K + 3)[1:K + 2]
        v, w, p, few, often = v[first], w[first], p[first], few[first], often[first] | (v[first] == START)
        # readers want one kind of rows at a time; runs of a context cost little on disk
        order = np.argsort(v, kind="stable")
        order = order[np.argsort((2 * ~few + ~often).astype(np.uint8)[order], kind="stable")]
        none = K + 1
        return pa.table({
            "v": pa.concat_arrays([pa.array(v[order].view(np.int64)), pa.nulls(none, pa.int64())]),
            "w": pa.concat_arrays([pa.array(w[order].view(np.int64)), pa.nulls(none, pa.int64())]),
            "often": pa.concat_arrays([pa.array(often[order]), pa.nulls(none, pa.bool_())]),
            "p": pa.concat_arrays([pa.array(p[order], mask=~few[order]), pa.nulls(none, pa.float64())]),
            "r": pa.concat_arrays([pa.nulls(len(order), pa.int64()), pa.array(np.arange(1, K + 2))]),
            "c": pa.concat_arrays([pa.array(total[order]), pa.array(times)])})

    return (docs.where("train").select("text").mapInArrow(send, "part int, v binary, w binary, c binary")
            .groupBy("part").applyInArrow(add, "v bigint, w bigint, often boolean, p double, r bigint, c bigint"))


def discounts(often: dict[int, int]) -> list[float]:
    """Katz's d(1) ... d(K) from the numbers of types that occur r times; 1
    where the counts of counts give none between 0 and 1."""
    n = [0, *[often.get(r, 0) for r in range(1, K + 2)]]
    out = []
    spare = (K + 1) * n[K + 1] / n[1] if n[1] else 1.0
    for r in range(1, K + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - spare) / (1 - spare) if n[r] and spare < 1 else 1.0
        out.append(d if 0 < d < 1 else 1.0)
    return out


def step_of(c: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(c) * 8).astype(np.int32)


def least_step(counted: DataFrame, limit: int) -> int | None:
    """The lowest of the whole steps of the count (an eighth of a power of two), from (step, n), that
    hold at most ``limit`` rows with those above; None if the highest holds more."""
    total, least = 0, None
    for level, n in sorted(counted.groupBy("step").agg(F.sum("n")).collect(), reverse=True):  # some hundred rows
        total += n
        if total > limit:
            break
        least = level
    return least


def by_frequency(counted: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest ``c``, ``limit`` at most and whole steps; and the others."""
    step = F.floor(F.log2("c") * 8)
    least = least_step(counted.select(step.alias("step"), F.lit(1).alias("n")), limit)
    hot = F.lit(False) if least is None else step >= least
    return counted.where(hot), counted.where(~hot)


@contextmanager
def few_numbers(spark: SparkSession) -> Iterator[None]:
    """For jobs whose rows are some numbers: their number alone bounds the Arrow batches, as measuring
    the bytes after each row, which texts need, costs more than to move it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str((1 << 31) - 1))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


PACKED = "part int, key binary, x binary, c binary"


def chunks(keys: np.ndarray, x: np.ndarray, c: np.ndarray, parts: int) -> pa.RecordBatch:
    """Entries as one packed row for each range of the key."""
    order = np.argsort(keys)
    keys, x, c = keys[order], x[order], c[order]
    shift = np.uint64(65 - parts.bit_length())
    cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else [0, len(keys)]
    rows = [(p, pack(keys[lo:hi]), pack(x[lo:hi]), pack(c[lo:hi])) for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])) if hi > lo]
    return pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(
        zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["part", "key", "x", "c"])


def gathered(entries: Iterator[tuple[np.ndarray, ...]], parts: int) -> Iterator[pa.RecordBatch]:
    """``chunks`` of many small runs of (key, x, c) together."""
    held, n = [], 0
    for keys, x, c in entries:
        held.append((keys.view(np.uint64), x, c))
        n += len(keys)
        if n >= 2 * STEP_TOKENS:
            yield chunks(*[np.concatenate(y) for y in zip(*held)], parts)
            held, n = [], 0
    if n:
        yield chunks(*[np.concatenate(y) for y in zip(*held)], parts)


def packed(entries: DataFrame, parts: int) -> DataFrame:
    """PACKED from (key, x, c)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return gathered((tuple(np.array(column) for column in batch.columns) for batch in batches), parts)

    return entries.mapInArrow(run, PACKED)


def keyed(rows: DataFrame, d: list[float], parts: int, contexts=None) -> DataFrame:
    """(g, p, x, c) from (v, w, c, p, a, cv): the n-gram's key, its probability, what it adds as an
    n-gram, its count; ``a`` and ``cv`` come from ``contexts`` (a broadcast of their sorted v, a and
    cv) if the rows don't have them.  With ``parts`` the result is PACKED."""
    share = np.array([1.0, *d, 1.0])

    def numbers(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        v, w, c, p, *of = (column.to_numpy() for column in batch.columns)
        if contexts is not None:
            names, *of = contexts.value
            at = np.searchsorted(names, v)
            of = [x[at] for x in of]
        a, cv = of
        chance = c * share[np.minimum(c, K + 1)] / cv
        return bigram_keys(v.view(np.uint64), w.view(np.uint64)).view(np.int64), chance, np.log10(chance) - a - np.log10(p), c

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (numbers(batch) for batch in batches if len(batch))
        if parts:
            yield from gathered(((g, x, np.array(c)) for g, _, x, c in found), parts)
        else:
            for columns in found:
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in columns], ["g", "p", "x", "c"])

    return rows.mapInArrow(run, PACKED if parts else "g bigint, p double, x double, c bigint")


# ------------------------------------------------------------------ the model
@dataclass
class Model:
    """Where the tables are, and the numbers that hold for the whole corpus."""

    path: str
    tokens: int  # N
    words: int  # V
    unknown: float  # log10 P(unk)
    start: float  # log10 a(start)
    order: int = ORDER
    parts: int = 1  # ranges of the key

    def packed(self, spark: SparkSession) -> DataFrame:
        """PACKED and the order: the table, a row for each run of keys of a range."""
        return spark.read.schema(f"{PACKED}, order int").parquet(self.path)

    def table(self, spark: SparkSession, least: int | None = None) -> DataFrame:
        """(order, key, x, c): log10 numbers to add for each word and n-gram; of the entries whose
        count reaches step ``least``, if it is given."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for order, key, x, c in zip(*(column.to_pylist() for column in batch.columns)):
                    numbers = unpack(key, np.int64), unpack(x, np.float64), unpack(c, np.int64)
                    if least is not None:
                        some = step_of(numbers[2]) >= least
                        numbers = [y[some] for y in numbers]
                    n = len(numbers[0])
                    yield pa.RecordBatch.from_arrays([pa.array(y) for y in (np.full(n, order, np.int32), *numbers)], ["order", "key", "x", "c"])

        return self.packed(spark).select("order", "key", "x", "c").mapInArrow(run, "order int, key bigint, x double, c bigint")

    def frequent(self, spark: SparkSession, limit: int) -> DataFrame:
        """The rows of ``table`` with the largest ``c``, ``limit`` at most and whole steps."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = Counter()
                for c in batch.column("c").to_pylist():
                    found.update(dict(zip(*(x.tolist() for x in np.unique(step_of(unpack(c, np.int64)), return_counts=True)))))
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["step", "n"])

        least = least_step(self.packed(spark).select("c").mapInArrow(run, "step bigint, n bigint"), limit)
        return self.table(spark, least if least is not None else 1 << 30)


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", train_col: Column | None = None,
          path: str | None = None, order: int = ORDER) -> Model:
    """Count, discount, normalise and store n-grams of up to ``order`` words;
    learns from rows where ``train_col`` (by default: the id is not held out) is true."""
    if order < 1:
        raise ValueError("order must be at least 1")
    spark = docs.sparkSession
    own = scratch(spark, "katz")
    path = path or f"{own}/model"
    docs = docs.select(F.col(text_col).alias("text"), (~held_out(F.col(id_col)) if train_col is None else train_col).alias("train"))

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{own}/{name}")
        release(spark)
        return spark.read.schema(df.schema).parquet(f"{own}/{name}")

    def keep(entries: DataFrame, length: int) -> None:
        release(spark)
        with few_numbers(spark):
            entries.write.parquet(f"{path}/order={length}")

    start = int(START.view(np.int64))
    words = stored(word_counts(docs), "words")
    real = words.where(F.col("w") != start)
    n, v, *often = real.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1)),
                            *[F.count(F.when(F.col("c") == r, 1)) for r in range(1, K + 2)]).first()
    d1 = discounts(dict(enumerate(often, 1)))
    left = sum(o * r * (1 - d) for (r, o), d in zip(enumerate(often, 1), d1)) / n if n else 1.0
    if n and not left:  # no word occurs K times or less, or the counts of counts are no guide
        d1, left, total = [1.0] * K, 1 / (n + 1), n + 1
    else:
        total = max(n, 1)

    def discounted(c: Column, d: list[float]) -> Column:
        share = F.lit(1.0)
        for r, x in enumerate(d, 1):
            share = F.when(c == r, F.lit(x)).otherwise(share)
        return c * share

    parts, ranges = (1 << max(0, int(np.ceil(np.log2(max(1, x / PART_TOKENS))))) for x in (n, n * max(1, order - 1)))
    # of each length: g as the n-gram's key, p its probability, x what it adds as an n-gram
    p = discounted(F.col("c"), d1) / F.lit(float(total))
    shorter, first = real.select(F.col("w").alias("g"), p.alias("p"), F.log10(p).alias("x"), "c"), None
    done = "words"
    for length in range(2, order + 1):
        often, rare = by_frequency(shorter.select("g", "p", "c"), HOT_WORDS)
        often = often.select("g", "p").toArrow()
        keys = often.column("g").to_numpy().view(np.uint64)
        rank = np.argsort(keys)
        counted = stored(gram_counts(docs, length, (keys[rank], often.column("p").to_numpy()[rank]), parts), f"counts{length}")
        d = discounts(dict(counted.where("v is null").groupBy("r").agg(F.sum("c")).collect()))
        # n-grams whose last words are frequent know p already; only the others meet the table of the shorter ones
        columns = ["v", "w", "c", "p", "often"]
        pairs = stored(counted.where("v is not null and p is null").drop("p").join(rare.select(F.col("g").alias("w"), "p"), "w")
                       .select(columns), f"pairs{length}")
        pairs = counted.where("p is not null").select(columns).unionAll(pairs)
        # every occurrence of a context goes on with a stored n-gram
        sums = pairs.withColumn("dc", discounted(F.col("c"), d)).groupBy("v", "often").agg(F.sum("c").alias("c"), F.sum("dc").alias("dc"), F.sum("p").alias("p"))
        # a context without mass to spare counts itself once more
        base = F.when(F.col("c") - F.col("dc") > 1e-9 * F.col("c"), F.col("c").cast("double")).otherwise(F.col("c") + 1.0)
        rows = sums.select("v", "often", base.alias("cv"), F.log10((1 - F.col("dc") / base) / (1 - F.col("p"))).alias("a"))
        rows = stored(rows, f"contexts{length}")
        if length == 2:
            first = rows.where(F.col("v") == start).select("a").first()
        keep(packed(_entries(shorter.join(rows.select(F.col("v").alias("g"), "a"), "g", "left"), length - 1), ranges), length - 1)
        drop_scratch(spark, f"{own}/{done}")
        # frequent contexts meet their rows in place, so only rows of rarer ones are shuffled
        few = rows.where("often").select("v", "a", "cv").toArrow()
        few = [few.column(x).to_numpy() for x in ("v", "a", "cv")]
        rank = np.argsort(few[0])
        few = spark.sparkContext.broadcast([x[rank] for x in few])
        last = ranges if length == order else 0
        longer = keyed(pairs.where("often").select("v", "w", "c", "p"), d, last, few).unionAll(
            keyed(pairs.where("not often").drop("often").join(rows.where("not often").drop("often"), "v")
                  .select("v", "w", "c", "p", "a", "cv"), d, last))
        if last:
            keep(longer, length)
        else:
            with few_numbers(spark):
                shorter, done = stored(longer, f"grams{length}"), f"grams{length}"
        drop_scratch(spark, f"{own}/counts{length}")
        drop_scratch(spark, f"{own}/pairs{length}")
        drop_scratch(spark, f"{own}/contexts{length}")
    if order == 1:
        keep(packed(_entries(shorter.withColumn("a", F.lit(0.0)), 1), ranges), 1)
        drop_scratch(spark, f"{own}/words")
    release(spark)
    return Model(path, n, v, float(np.log10(left)), first[0] if first else 0.0, order, ranges)


def _entries(grams: DataFrame, length: int) -> DataFrame:
    """(key, x, c) of n-grams with ``a``, their log10 a as contexts."""
    key = F.col("g").bitwiseAND(-2) if length == 1 else F.col("g")
    return grams.select(key.alias("key"), (F.col("x") + F.coalesce("a", F.lit(0.0))).alias("x"), "c")


# ------------------------------------------------------------------ scoring
def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", passes: int = 1) -> DataFrame:
    """``id_col``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of
    every whole text.

    With ``passes`` the texts are read that often, for a range of the keys each time, and only
    that range's keys and stored n-grams are on disk at once.  ``docs`` must then give the same
    rows in the same order each time, as a table does; if not, that is an error."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    total, floor = model.tokens + 0.1 * (model.words + 1), model.unknown
    seen = model.frequent(spark, HOT).select("key", "x", "c").toArrow()
    names = seen.column("key").to_numpy().view(np.uint64)
    order = np.argsort(names)
    hot = sc.broadcast((names[order], *[seen.column(c).to_numpy()[order] for c in ("x", "c")]))
    parts = model.parts
    shift = np.uint64(64 - parts.bit_length() + 1)
    first, longest = model.start, model.order

    def values(keys, x, c, found):
        """What a key adds to (score, known, base score)."""
        word = (keys & np.uint64(1)) == 0
        known = word & found
        return (np.where(found, x, np.where(word, floor, 0.0)), known.astype(np.float64),
                np.where(word, np.log10((np.where(known, c, 0) + 0.1) / total), 0.0))

    def look(table, keys):
        names, x, c = table
        if not len(names):
            return x[:0], c[:0], np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(names, keys), len(names) - 1)
        return x[at], c[at], names[at] == keys

    def small(sums: np.ndarray) -> bytes:
        """Sums of the rows that have any: a part has few keys of a batch when there are many parts."""
        some = np.flatnonzero(sums.any(axis=0))
        at = pack(some.astype(np.uint32))
        return len(at).to_bytes(4, "little") + at + pack(np.ascontiguousarray(sums[:, some]).ravel())

    def add_up(keys, x, c, found, times, who, n):
        if not len(keys):
            return np.zeros((3, n))
        if not len(x):
            x, c = np.zeros(len(keys)), np.zeros(len(keys))
        return np.stack([np.bincount(who, np.repeat(val, times), n) for val in values(keys, x, c, found)])

    names = ["part", "batch", "n", "keys", "times", "who", "ids", "tokens"]
    schema = pa.schema([("part", pa.int32()), ("batch", pa.int64()), ("n", pa.int32()), ("keys", pa.binary()),
                        ("times", pa.binary()), ("who", pa.binary()), ("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int64()))])

    def ask(batches: Iterator[pa.RecordBatch], low: int, high: int) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part, words, before, who in steps(batch):
                n, rows = len(part), []
                more = list(grams(words, before, who, longest))
                keys = np.concatenate([word_keys(words), *[bigram_keys(v, w) for v, w, _ in more]])
                doc = np.concatenate([who, *[at for _, _, at in more]])
                if high - low < parts:
                    mine = np.flatnonzero((keys >> shift >= np.uint64(low)) & (keys >> shift < np.uint64(high)))
                    keys, doc = keys[mine], doc[mine]
                order, starts = runs_of(keys)
                keys, doc = keys[order], doc[order].astype(np.uint32)
                keys, times = keys[starts], np.diff(np.append(starts, len(keys)))
                x, c, found = look(hot.value, keys)
                each = np.repeat(found, times)
                here = add_up(keys[found], x[found], c[found], found[found], times[found], doc[each], n) if found.any() else np.zeros((3, n))
                keys, times, doc = keys[~found], times[~found].astype(np.uint32), doc[~each]
                ends = np.concatenate([[0], np.cumsum(times, dtype=np.int64)])
                cuts = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64)) if parts > 1 else [0, len(keys)]
                size = np.bincount(who, minlength=n)
                # a batch's name holds its rows: passes that read others don't come together
                mark = zlib.crc32(np.append(size, part.column("id").fill_null(0).to_numpy(zero_copy_only=False)).astype(np.int64).tobytes())
                name = int(mix(np.array([number ^ mark << 16], np.uint64)).view(np.int64)[0])
                for p, (lo, hi) in enumerate(zip(cuts[:-1], cuts[1:])):
                    if hi > lo:
                        rows.append((p, name, n, pack(keys[lo:hi]), pack(times[lo:hi]), pack(doc[ends[lo]:ends[hi]]), None, None))
                told = (part.column("id").to_pylist(), size.tolist()) if low == 0 else (None, None)
                rows.append((low + number % (high - low), name, n, None, None, small(here), *told))
                yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=schema)
                number += 1

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        def column(name: str, kind) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *[unpack(b, kind) for b in known.column(name).to_pylist()]])

        keys = column("key", np.uint64)
        order = np.argsort(keys)
        own = keys[order], column("x", np.float64)[order], column("c", np.int64)[order]
        sums = []
        for n, k, t, who in zip(*(asked.column(c) for c in ("n", "keys", "times", "who"))):
            if not k.is_valid:  # a batch's own row passes
                sums.append(who.as_py())
                continue
            want = unpack(k.as_py(), np.uint64)
            x, c, found = look(own, want)
            sums.append(small(add_up(want, x, c, found, unpack(t.as_py(), np.uint32), unpack(who.as_py(), np.uint32), n.as_py())))
        return pa.table({"batch": asked.column("batch"), "sums": pa.array(sums, pa.binary()),
                         "ids": asked.column("ids"), "tokens": asked.column("tokens")})

    def gather(rows: pa.Table) -> pa.Table:
        own = next((i for i, x in enumerate(rows.column("tokens")) if x.is_valid), None)
        if own is None:
            raise RuntimeError("the documents came in another order when they were read again: score them in one pass")
        both = np.zeros((3, len(rows.column("ids")[own])))
        for x in rows.column("sums").to_pylist():
            cut = 4 + int.from_bytes(x[:4], "little")
            at = unpack(x[4:cut], np.uint32)
            both[:, at] += unpack(x[cut:], np.float64).reshape(3, -1)
        return pa.table({"id": pa.array(rows.column("ids")[own].as_py(), pa.int64()),
                         "n_tokens": pa.array(rows.column("tokens")[own].as_py(), pa.int64()),
                         "n_known": np.rint(both[1]).astype(np.int64), "base_score": both[2], "score": both[0] + first})

    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    passes = max(1, min(passes, parts))
    own, told = scratch(spark, "katz-sums"), []
    for k in range(passes):
        low, high = k * parts // passes, (k + 1) * parts // passes
        asked = texts.mapInArrow(lambda batches, low=low, high=high: ask(batches, low, high),
                                 "part int, batch bigint, n int, keys binary, times binary, who binary, ids array<bigint>, tokens array<bigint>")
        known = model.packed(spark).drop("order").where(F.col("part").between(low, high - 1))
        told.append(asked.groupBy("part").cogroup(known.groupBy("part"))
                    .applyInArrow(answer, "batch bigint, sums binary, ids array<bigint>, tokens array<bigint>"))
        if passes > 1:
            told[k].write.parquet(f"{own}/{k}")
            release(spark)
            told[k] = spark.read.schema(told[k].schema).parquet(f"{own}/{k}")
    return (reduce(DataFrame.unionAll, told)
            .groupBy("batch").applyInArrow(gather, "id bigint, n_tokens bigint, n_known bigint, base_score double, score double")
            .withColumnRenamed("id", id_col))
