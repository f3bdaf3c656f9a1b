"""Token counts, hard negatives and periodic runs against the library and brute force."""
import random
import tempfile

import brute
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from oracle_compare import compare, duck
from pyspark.sql import functions as F

from tableprep.llm import hard_negatives, periodic_runs, token_counts
from tableprep.llm.queries import ORACLE, QUERIES

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


# ------------------------------------------------------------------ 11
@pytest.fixture(scope="module")
def tokenizer():
    return token_counts.Tokenizer()


def test_counts_equal_the_library(spark, small_docs, tokenizer):
    want = dict(zip(small_docs, tokenizer.lengths([t or "" for t in small_docs.values()])))
    got = QUERIES["op11_digest_counts"](spark, SF001).collect()
    assert len(got) == len(small_docs)
    for r in got:
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((small_docs[r.doc_id] or "").encode()), want[r.doc_id], want[r.doc_id] > 4096)


def test_counts_of_odd_texts(tokenizer):
    rnd = random.Random(5)
    parts = ["a", "b ", " ", "  ", "\n", "\t", "é", "\0", "the", "<s>", "</s>", "<unk>", "<0x41>", "\u200c", "\U0001F642", "   "]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randrange(25))) for _ in range(4000)]
    texts += ["", " ", "  ", "a ", "a  ", " a", "   a  b   ", "x" * 50_000, " " * 3000]
    assert tokenizer.by_word and tokenizer.counts(pa.array(texts)).tolist() == tokenizer.lengths(texts)
    marked = [t.replace(" ", token_counts.MARK) for t in texts]
    assert tokenizer.lengths(marked) == tokenizer.lengths(texts)  # what the normalised content relies on


def test_known_words_are_bounded(tokenizer, monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN_BYTES", 2000)
    texts = [" ".join(f"w{i}x{j}" for j in range(9)) for i in range(60)]
    for t in texts:
        assert tokenizer.counts(pa.array([t])).tolist() == tokenizer.lengths([t])
        assert len(tokenizer.known) <= 30


def test_counts_of_edge_rows(spark, edge_dir, tokenizer):
    rows = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text").collect()
    got = QUERIES["op11_digest_counts"](spark, edge_dir).collect()
    want = [(r.doc_id, len((r.text or "").encode()), tokenizer.lengths([r.text or ""])[0]) for r in rows]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_bytes, r.n_tokens)) for r in got)


def test_cache_encodes_only_distinct_misses(spark, tokenizer, monkeypatch):
    cache = token_counts.fresh_cache(spark, tokenizer)
    first = spark.createDataFrame([(1, "one text"), (2, "one text"), (3, "one\u2581text"), (4, None), (5, "")], "doc_id bigint, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count(first, cache).collect()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0}
    assert cache.facts().count() == 2
    files = set(cache.facts().inputFiles())
    cache.append(first)
    assert set(cache.facts().inputFiles()) == files  # nothing was missing, nothing written
    second = first.unionAll(spark.createDataFrame([(6, "another text"), (7, "another text")], first.schema))
    for bound in (token_counts.BROADCAST_MISSES, 0):  # by broadcast, and beyond its bound
        monkeypatch.setattr(token_counts, "BROADCAST_MISSES", bound)
        before = cache.facts().count()
        cache.append(second.unionAll(spark.createDataFrame([(8, f"bound {bound}")], first.schema)))
        assert cache.facts().count() == before + (2 if before == 2 else 1)
    assert cache.facts().groupBy("digest").count().where("count > 1").count() == 0
    # a stored fact is used, not worked out again
    wrong = token_counts.fresh_cache(spark, tokenizer)
    first.limit(1).select(wrong.key(F.col("text")).alias("digest"), F.lit(99).cast("bigint").alias("n_tokens"),
                          F.lit(tokenizer.version).alias("version")).write.partitionBy("version").parquet(wrong.path)
    assert {r.doc_id: r.n_tokens for r in token_counts.count(first, wrong).collect()} == {1: 99, 2: 99, 3: 99, 4: 0, 5: 0}


def test_versions_share_a_cache_table(spark, tokenizer):
    path = token_counts.scratch(spark, "versions")
    docs = spark.createDataFrame([(1, "Some words, <|endoftext|> and MORE")], "doc_id bigint, text string")
    seen = {}
    for name in ("piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"):
        model = token_counts.Tokenizer(public_tokenizers.path(name))
        got = token_counts.count(docs, token_counts.CountCache(spark, path, model)).first().n_tokens
        assert got == model.lengths(["Some words, <|endoftext|> and MORE"])[0]
        seen[model.version] = got
    assert spark.read.parquet(path).count() == len(seen) == 3


# ------------------------------------------------------------------ 12
def _mined(spark, rows, **kw):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    root = tempfile.mkdtemp(prefix="llm-negatives-")
    df.withColumn("rank", F.lit("clash")).write.parquet(f"{root}/embeddings.parquet")
    return QUERIES["op12_hard_negatives"](spark, root)


def _random_rows(n, dims, seed, labels=3):
    rnd = np.random.default_rng(seed)
    centres = rnd.normal(size=(6, dims))
    return [(int(i), (centres[rnd.integers(6)] + rnd.normal(size=dims) * rnd.choice([0, 0.05, 1])).round(2).tolist(), int(rnd.integers(labels)))
            for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:  # many blocks, short chunks, one dimension at a time
        for name, value in (("ROW_BLOCK", 60), ("ANCHOR_BLOCK", 2), ("CHUNK", 1), ("GROUP", 3)):
            monkeypatch.setattr(hard_negatives, name, value)
    assert compare(spark, duck(SF001), "op12", QUERIES["op12_hard_negatives"], ORACLE["op12_hard_negatives"], SF001)["ok"]
    rows = _random_rows(700, 10, 4)
    assert sorted(map(tuple, _mined(spark, rows).collect())) == sorted(brute.hard_negatives(rows))


def test_hard_negatives_edge_rows(spark):
    one, inf, nan = [1.0, 0.0, 2.0], float("inf"), float("nan")
    rows = [(0, one, 1), (100, one, 1), (100, one, 1), (100, [1.0, 0.5, 2.0], 1), (1, one, 1), (2, [0.5, 0.0, 1.0], 2), (3, [0.6, 0.1, 1.1], 2),
            (4, [0.0, 0.0, 0.0], 2), (5, [-1.0, 0.0, -2.0], 3), (6, None, 1), (8, [1.0, None, 2.0], 2), (9, [1.0, nan, 2.0], 2),
            (10, [inf, 0.0, 1.0], 2), (11, [1e30, 0.0, 2e30], 2), (12, [1.0, 0.0], 2), (13, [], 1), (15, [], 2), (200, [], 1), (None, one, 2),
            (16, one, None), (300, one, None), (400, None, 1), (500, [0.0, 0.0, 0.0], 9), (14, [0.5, 0.1, 1.0], 1), (600, [-3.0, 1.0, 0.0], 7)]
    got = sorted(map(tuple, _mined(spark, rows).collect()))
    assert got == sorted(brute.hard_negatives(rows)) and got
    assert {r[0] for r in got} <= {0, 100, 200, 500, 600}


def test_hard_negatives_of_equal_vectors(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "ROW_BLOCK", 80)
    rows = [(i, [1.0, 0.5, 0.25], i % 2) for i in range(300)] + [(1000 + i, [0.7, 0.2, 0.1 * (i % 3)], i % 2) for i in range(100)]
    assert sorted(map(tuple, _mined(spark, rows).collect())) == sorted(brute.hard_negatives(rows))


def test_large_whole_numbers_are_summed_exactly(spark):
    rnd = random.Random(2)
    rows = [(i, [float(rnd.randrange(-60_000, 60_000)) for _ in range(12)], i % 2) for i in range(250)]
    assert sorted(map(tuple, _mined(spark, rows).collect())) == sorted(brute.hard_negatives(rows))


def test_index_leaves_out_what_the_bound_covers():
    rnd = np.random.default_rng(1)
    rows = (rnd.normal(size=(2000, 64)) * 30).round().astype(np.int64)
    search = hard_negatives.Search(hard_negatives.Block(rows), rows[:5])
    who, groups = np.arange(5), len(search.block.lists)
    exact = rows[:5] @ rows.T
    read = []
    for t in (0.9, 0.6, 0.4, -np.inf):
        found = search.join(who, search.top * t)
        assert (found == (exact >= (search.top * t)[:, None])).all()
        read.append(search.done.sum())
    assert read[0] < 0.35 * read[-1] and read == sorted(read) and read[-1] == 5 * 2000 * groups


# ------------------------------------------------------------------ 13
def test_periodic_runs(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF01}/documents.parquet").select("doc_id", "text").collect()}
    got = {r[0]: tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF01).collect()}
    assert len(got) == len(docs)
    for i, text in docs.items():
        if len(text or "") < 30_000:
            assert got[i] == (i, *brute.run_digest(i, text))
    assert sum(r[1] > 0 for r in got.values()) > 50


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_small_alphabets(seed, monkeypatch):
    rnd = random.Random(seed)
    monkeypatch.setattr(periodic_runs, "BATCH_WORDS", rnd.choice([1, 50, 1 << 18]))
    texts = []
    for _ in range(300):
        ws = [rnd.choice("ab" if seed % 2 else "abc") for _ in range(rnd.randrange(80))]
        if rnd.random() < 0.6:  # a planted run
            unit = [rnd.choice("abc") for _ in range(rnd.randrange(1, 12))]
            at = rnd.randrange(len(ws) + 1)
            ws[at:at] = (unit * 9)[:rnd.randrange(1, 9 * len(unit) + 1)]
        texts.append(" ".join(ws))
    for length, powers in ((6, 4), (4, 3), (2, 5)):
        i = 0
        for group in periodic_runs._groups(t.encode() for t in texts):
            sizes, runs, kept = periodic_runs._decide(group, length, powers)
            for k in range(len(group)):
                want = brute.word_runs(texts[i].split(), length, powers)
                assert [tuple(r.values()) for r in runs[k].as_py()] == want, texts[i]
                i += 1
        assert i == len(texts)


def test_runs_of_edge_rows(spark, edge_dir):
    got = QUERIES["op13_periodic_runs"](spark, edge_dir).collect()
    rows = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text").collect()
    short = [r for r in rows if len(r.text or "") < 1000 or r.text.startswith("x")]
    assert len(got) == len(rows)
    want = sorted(repr((r.doc_id, *brute.run_digest(r.doc_id, r.text))) for r in short)
    assert set(want) <= {repr(tuple(r)) for r in got}
    long = next(r for r in got if r.doc_id == 5)
    assert (long.n_runs, long.start, long.period, long.length) == (1, 0, 5, 20_000)


def test_run_columns(spark):
    docs = spark.createDataFrame([(1, "a b " * 5 + "c  c c c c\tc d", 7, "z")], "id int, text string, n_words int, row string")
    r = periodic_runs.runs(docs).first()
    assert (r.id, r.row, r.n_words, r.collapsed) == (1, "z", 17, "a b c d")
    assert [tuple(x) for x in r.runs] == [(0, 10, 2), (10, 6, 1)]
    with pytest.raises(Exception):
        periodic_runs.runs(docs, min_powers=2)
