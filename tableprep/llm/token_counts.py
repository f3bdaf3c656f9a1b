"""Token counts of whole texts through a cache keyed by content and tokenizer.

The cache is a Parquet table in a shared folder, partitioned by ``version``: a
digest of everything that decides a count (the library, its version, the model
file's bytes and the rule that normalises content).  A row is a fact, ``digest``
(sha-256 of the normalised content) and ``n_tokens``; facts are never changed.

``count`` works in three steps:

1. ``append`` reduces the texts to one row a digest, in the map tasks first, so a
   text that a third of all rows hold is one row a task in the shuffle.
2. It anti-joins them with the facts of this version, and encodes and appends
   only what is missing.  Where the cache holds facts already, missing digests are
   found on digests alone, and only their texts are shuffled.
3. Every row's digest is joined to its count.  No text takes part in that join.

Normalised content is what the tokenizer itself can't tell apart: null counts as
empty, and for a SentencePiece model with the identity rule a space equals the
mark U+2581 that the library writes for it.

A SentencePiece model none of whose pieces goes on over a space is counted by its
space-separated words, each distinct word of a batch once: merges never cross from
a word into the space after it, and the library puts one space in front of what it
encodes, which stands for the one that was cut.  Any other model encodes whole texts.

Defined results: a null or empty text has 0 bytes and 0 tokens; a null id keeps its
row; rows that repeat keep one row each; an empty table gives an empty one and
appends nothing; columns beyond the two named ones are not read.  A text is held
whole in one task.  One writer at a time appends to a cache; an append that failed
half way leaves facts, and the next one adds the others.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import scratch

MODEL = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
FACTS = "digest binary, n_tokens bigint, version string"
BATCH_BYTES = 4 << 20
KNOWN_BYTES = 64 << 20  # of distinct words that a worker remembers
BROADCAST_MISSES = 100_000  # missing digests (32 bytes each) that may be broadcast


class Tokenizer:
    """A model file with the library that reads it; counts leave out begin, end
    and added special tokens, and special strings in a text are handled as the
    library does by default."""

    def __init__(self, path: str = MODEL):
        with open(path, "rb") as f:
            data = f.read()
        self.kind = "sentencepiece" if path.endswith(".model") else "tokenizers"
        self._load(data)
        library = __import__(self.kind)
        self.rule = "mark-is-space" if self.marks else "as-is"
        self.version = hashlib.sha256(b"\0".join([self.kind.encode(), library.__version__.encode(), self.rule.encode(), data])).hexdigest()
        self.data = data

    def _load(self, data: bytes) -> None:
        self.marks = self.by_word = False
        if self.kind == "sentencepiece":
            from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

            spec = sentencepiece_model_pb2.ModelProto()
            spec.ParseFromString(data)
            norm = spec.normalizer_spec
            self.marks = (norm.name == "identity" and not norm.precompiled_charsmap and norm.escape_whitespaces
                          and not norm.remove_extra_whitespaces)
            self.by_word = (self.marks and norm.add_dummy_prefix and spec.trainer_spec.model_type == 2
                            and not spec.trainer_spec.treat_whitespace_as_suffix
                            and not any(MARK in p.piece.lstrip(MARK) for p in spec.pieces))
            self.library = SentencePieceProcessor(model_proto=data)
        else:
            import tokenizers

            self.library = tokenizers.Tokenizer.from_str(data.decode())
            self.library.no_truncation()
            self.library.no_padding()
        self.known: dict[str, int] = {}
        self.known_bytes = 0

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("library", "known", "known_bytes")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._load(self.data)

    def normalise(self, text: Column) -> Column:
        """The content that decides a count."""
        text = F.coalesce(text, F.lit(""))
        return F.replace(text, F.lit(MARK), F.lit(" ")) if self.marks else text

    def lengths(self, texts: list[str]) -> list[int]:
        """The library's counts of whole texts."""
        if self.kind == "sentencepiece":
            return [len(ids) for ids in self.library.encode(texts, num_threads=1)]
        return [len(e.ids) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Counts of normalised texts (no nulls)."""
        if not self.by_word:
            return np.array(self.lengths(texts.to_pylist()), np.int64)
        words = pc.split_pattern(texts, " ")
        ends = words.offsets.to_numpy()
        flat = words.flatten().dictionary_encode()
        of_word = np.array(self._word_counts(flat.dictionary.to_pylist()), np.int64)
        codes = flat.indices.to_numpy()
        total = np.concatenate([[0], np.cumsum(of_word[codes])]) if len(codes) else np.zeros(1, np.int64)
        out = total[ends[1:] - ends[0]] - total[ends[:-1] - ends[0]]
        # spaces next to each other belong to one unit with the word after them
        wide = pc.match_substring_regex(texts, "^ |  | $").to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(wide):
            out[i] = sum(self._word_counts(self._units(texts[i].as_py())))
        out[pc.equal(texts, "").to_numpy(zero_copy_only=False)] = 0
        return out

    @staticmethod
    def _units(text: str) -> list[str]:
        """Each word behind all but one of the spaces before it; the spaces at the
        end by themselves."""
        out, spaces, parts = [], 0, text.split(" ")
        for word in parts:
            if word:
                out.append(" " * spaces + word)
                spaces = 0
            else:
                spaces += 1
        return out + [" " * (spaces - 1)] if spaces else out

    def _word_counts(self, words: list[str]) -> list[int]:
        """Counts of words that each stand behind one space; the empty word is that
        space alone."""
        known = self.known
        new = list({w for w in words if w not in known})
        if new:
            self.known_bytes += sum(map(len, new)) + 100 * len(new)
            if self.known_bytes > KNOWN_BYTES:
                known.clear()
                new = list(set(words))
                self.known_bytes = sum(map(len, new)) + 100 * len(new)
            known.update(zip(new, self.lengths(new)))
            if "" in known:
                known[""] = 1
        return [known[w] for w in words]


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows of about BATCH_BYTES."""
    if len(sizes):
        step = np.cumsum(sizes) // BATCH_BYTES
        edges = [0, *(np.flatnonzero(np.diff(step)) + 1), len(sizes)]
        yield from zip(edges[:-1], edges[1:])


class CountCache:
    """The facts of ``tokenizer`` in the table at ``path``, which may hold those of
    other tokenizers and versions as well."""

    def __init__(self, spark: SparkSession, path: str, tokenizer: Tokenizer):
        self.spark, self.path, self.tokenizer = spark, path, tokenizer

    def _exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/version={self.tokenizer.version}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def facts(self) -> DataFrame:
        """(digest, n_tokens) of this version."""
        if not self._exists():
            return self.spark.createDataFrame([], FACTS).drop("version")
        return (self.spark.read.schema(FACTS).parquet(self.path)
                .where(F.col("version") == self.tokenizer.version).drop("version"))

    def key(self, text: Column) -> Column:
        return F.unhex(F.sha2(self.tokenizer.normalise(text).cast("binary"), 256))

    def append(self, docs: DataFrame, text_col: str = "text") -> None:
        """Encode each distinct content that has no fact yet, and store its count."""
        text = F.col(f"`{text_col}`")
        texts = docs.select(self.key(text).alias("digest"), self.tokenizer.normalise(text).alias("text"))
        if self._exists():
            facts = self.facts().select("digest").hint("merge")
            missing = texts.select("digest").distinct().join(facts, "digest", "left_anti")
            few = missing.limit(BROADCAST_MISSES + 1).count()
            if few == 0:
                return
            if few <= BROADCAST_MISSES:
                texts = texts.join(F.broadcast(missing), "digest", "left_semi")
            distinct = texts.dropDuplicates(["digest"]).join(facts, "digest", "left_anti")
        else:
            distinct = texts.dropDuplicates(["digest"])
        tokenizer = self.spark.sparkContext.broadcast(self.tokenizer)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = tokenizer.value
            for batch in batches:
                texts = batch.column("text")
                for lo, hi in _slices(pc.binary_length(texts).to_numpy()):
                    n = model.counts(texts.slice(lo, hi - lo))
                    yield pa.RecordBatch.from_arrays([batch.column("digest").slice(lo, hi - lo), pa.array(n)], ["digest", "n_tokens"])

        counted = distinct.mapInArrow(run, "digest binary, n_tokens bigint")
        (counted.withColumn("version", F.lit(self.tokenizer.version))
         .write.partitionBy("version").mode("append").parquet(self.path))

    def lookup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``id_col``, ``n_bytes``, ``digest`` and ``n_tokens`` of every row; the last
        is null for content that has no fact."""
        text = F.col(f"`{text_col}`")
        rows = docs.select(F.col(f"`{id_col}`"), F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_bytes"),
                           self.key(text).alias("digest"))
        # both sides reach the join as they are shuffled, so Spark splits a hot digest
        return rows.join(self.facts().hint("merge"), "digest", "left").select(id_col, "n_bytes", "digest", "n_tokens")


def count(docs: DataFrame, cache: CountCache, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Append what the cache lacks, then give every row its count."""
    cache.append(docs, text_col)
    return cache.lookup(docs, id_col, text_col)


def fresh_cache(spark: SparkSession, tokenizer: Tokenizer | None = None) -> CountCache:
    """An empty cache in the shared scratch folder, for one-off runs."""
    return CountCache(spark, scratch(spark, "token-counts"), tokenizer or Tokenizer())
