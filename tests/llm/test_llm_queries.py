"""Every registered query against brute force or its oracle, on edge cases and on empty tables."""
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from oracle_compare import compare, duck
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

import __spark_entry__ as E
from tableprep.llm import (cover_tree, exact_dedup, katz_lm, license_scan, license_templates, mixing, ngram_join, quality_crf,
                           sentencepiece_codec, sharding, suffix_merge)
from tableprep.errors import TablePrepError
from tableprep.llm import words
from tableprep.llm.queries import ORACLE, QUERIES

SF001, SF01 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def rows(spark, name, sf_dir):
    return QUERIES[name](spark, sf_dir).collect()


@pytest.fixture(scope="session")
def edge(spark, edge_dir):
    """Rows of every query over the edge cases."""
    return {name: rows(spark, name, edge_dir) for name in QUERIES}


def test_registered():
    numbers = sorted(int(k[2:].split("_")[0]) for k in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    r = compare(spark, duck(SF001), name, QUERIES[name], ORACLE[name], SF001)
    assert r["ok"], r


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert rows(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", sorted(set(QUERIES) - {"op12_hard_negatives"}))
def test_one_row_a_row(edge, name):
    assert len(edge[name]) == (15 if name.startswith("op4") else 16)


# ------------------------------------------------------------------ 1
def test_sharding(spark, small_docs, edge):
    got = rows(spark, "op1_jump_sharding", SF001)
    for r in got:
        data = (small_docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert (r.shard, r.grown_shard) == (brute.jump(r.doc_id, 40), brute.jump(r.doc_id, 41))
        assert r.grown_shard in (r.shard, 40)
    for found in (got, edge["op1_jump_sharding"]):
        slots = {}
        for r in found:
            slots.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert {r.shard for r in edge["op1_jump_sharding"] if r.doc_id is None} == {brute.jump(0, 40)}


def test_jump_hash_moves_only_into_the_new_shard():
    keys = np.arange(-500, 20_000, dtype=np.int64)
    a, b = sharding.jump_hash(keys, 100), sharding.jump_hash(keys, 101)
    assert ((a == b) | (b == 100)).all() and (a != b).mean() < 0.02
    assert [brute.jump(int(k), 100) for k in keys[:300]] == a[:300].tolist()
    assert (sharding.jump_hash(keys, 1) == 0).all()


def test_rows_of_one_key_spread_over_sub_shards(spark):
    df = spark.range(4000).select(F.when(F.col("id") % 4 == 0, F.col("id")).alias("doc_id"), F.col("id").alias("t"))
    nulls = df.where("doc_id is null")
    sizes = nulls.groupBy(sharding.sub_shard("doc_id", ("t",), 8)).count().collect()
    assert len(sizes) == 8 and max(r["count"] for r in sizes) < 3000 / 4
    slots = {}
    got = sharding.assign(df, 5, ties=("t",)).collect()
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(got) == 4000 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    by_slot = [r.t for r in sorted((r for r in got if r.doc_id is None), key=lambda r: r.slot)]
    assert by_slot != sorted(by_slot)  # not one window


# ------------------------------------------------------------------ 2
def test_license_scan(spark, small_docs, edge):
    for r in rows(spark, "op2_license_scan", SF001):
        n, places = brute.license_places(small_docs[r.doc_id], license_scan.BASE_PHRASES)
        starts, base = [p[0] for p in places], sorted({p[1] for p in places})
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(places), ",".join(base))
        assert (r.first_word, r.last_word) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(base) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
        assert (r.score == 1) == bool(r.labels)
    row = next(r for r in edge["op2_license_scan"] if r.doc_id == 11)
    assert (row.n_base, row.first_word, row.base_labels, row.labels) == (2, 1, "mit", "mit")


def test_template_regions():
    scanner = license_scan.Scanner((), [("t", "begin here <<beginOptional>>now <<beginOptional>>or later<<endOptional>><<endOptional>> "
                                              "for <<var;max=2>> the end")])

    def hit(text):
        return [h[1:3] for h in scanner.scan(scanner.words(text))[0]]

    assert hit("Begin here for the end") == [(0, 5)]
    assert hit("x begin, here now for a b the end") == [(1, 9)]
    assert hit("begin here now or later for a the end") == [(0, 9)]
    assert hit("begin here or later for the end") == []
    assert hit("begin here for a b c the end") == []
    assert hit("begin here for the") == []
    assert scanner.scan(scanner.words("begin here for the"))[1] == 0.8
    assert hit("begin here for begin here for the end") == [(3, 8)]
    with pytest.raises(ValueError):
        license_scan.compile_template("bad", "<<var;max=1>> word", {})
    license_scan.PIECE, old = 7, license_scan.PIECE
    try:
        assert hit("x begin, here now for a b the end") == [(1, 9)]
    finally:
        license_scan.PIECE = old


def test_whole_wording_against_regular_expressions():
    """Every template on its own wording, whole, cut off, with words changed, optional parts left out and
    filled regions; an independent matcher says what is accepted."""
    rng, templates = np.random.default_rng(3), license_templates.TEMPLATES
    scanner = license_scan.Scanner((), templates)

    def pattern(text):
        text = re.sub(r"<<var;max=(\d+)>>", r" VAR\1 ", text.replace("<<beginOptional>>", " OPEN ").replace("<<endOptional>>", " CLOSE "))
        parts = {"OPEN": "(?:", "CLOSE": ")?"}
        return re.compile("(?<= )" + "".join(
            parts.get(w) or (f"(?:[^ ]+ ){{0,{w[3:]}}}" if w.startswith("VAR") else f"{w} ") for w in text.split()))

    def wording(text, optional):
        text = re.sub(r"<<beginOptional>>(.*?)<<endOptional>>", lambda m: f" {m[1]} " if optional else " ", text, flags=re.S)
        return re.sub(r"<<var;max=(\d+)>>", lambda m: " " + " ".join(["someone"] * int(rng.integers(0, int(m[1]) + 1))) + " ", text).split()

    patterns = [(label, pattern(text)) for label, text in templates]
    seen = set()
    for label, text in templates:
        for optional in (True, False):
            whole = wording(text, optional)
            tries = [whole, whole[:-1], whole[1:], whole[:len(whole) // 2], [*whole, *whole], ["x", *whole, "y"]]
            for _ in range(6):
                k = int(rng.integers(len(whole)))
                tries += [whole[:k] + ["other"] + whole[k + 1:], whole[:k] + whole[k + 1:]]
            for words in tries:
                got = {h[0] for h in scanner.scan(scanner.words(" ".join(words)))[0]}
                assert got == {k for k, p in patterns if p.search(" " + " ".join(words) + " ")}
                seen |= {(label, label in got)}
    assert seen == {(label, flag) for label, _ in templates for flag in (True, False)}
    bsd = dict(templates)["bsd-3-text"]
    cut = wording(bsd[:bsd.index("neither")], True)  # stops before clause 3 and the disclaimer
    hits, score = scanner.scan(scanner.words(" ".join(cut)))
    assert not hits and score < 0.6


# ------------------------------------------------------------------ 3
@pytest.mark.parametrize("small", [False, True])
def test_katz(spark, small_docs, monkeypatch, small):
    if small:  # many parts, few hot entries, short steps
        for name, value in (("PART_TOKENS", 4000), ("HOT", 300), ("HOT_WORDS", 40), ("STEP_TOKENS", 3000)):
            monkeypatch.setattr(katz_lm, name, value)
    held = {i: brute.fold(i, 10) == 0 for i in small_docs}
    want = brute.katz(small_docs, held, katz_lm.discounts)
    assert np.allclose(want["sums"], 1, atol=1e-12)  # exactly normalised
    got = rows(spark, "op3_katz_lm", SF001)
    assert len(got) == len(small_docs)
    for r in got:
        n, known, base, score = want["rows"][r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (n, known, want["n"], held[r.doc_id])
        assert np.allclose([r.base_score, r.score], [base, score], rtol=1e-9)
    out = [r for r in got if r.held_out]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)


def test_katz_edges(edge):
    by = {}
    for r in edge["op3_katz_lm"]:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].n_tokens == by[2][0].n_tokens == by[10][0].n_tokens == 1
    assert by[1][0].score == by[2][0].score and all(r.held_out for r in by[None])
    assert by[4][0] == by[4][1] and all(np.isfinite(r.score) and r.score <= 0 for r in edge["op3_katz_lm"])


def test_katz_in_passes(spark, small_docs, monkeypatch):
    """A range of the keys at a time gives the same sums; what comes back grows with the keys, not with the parts."""
    monkeypatch.setattr(katz_lm, "HOT", 300)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    docs = docs.unionAll(docs.limit(3)).unionAll(spark.createDataFrame([(None, "x"), (7, None)], docs.schema))
    model = katz_lm.train(docs)
    want = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in katz_lm.score(docs, model).collect())
    monkeypatch.setattr(katz_lm, "PART_TOKENS", 4000)
    got = sorted((r.doc_id or -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in katz_lm.score(docs, model, passes=3).collect())
    assert len(got) == len(want) and np.allclose(got, want, rtol=1e-9)


def test_katz_model_is_packed(spark, monkeypatch):
    """The table is a row for each run of keys, not for each n-gram; n-grams that end in a frequent word
    are written once; and ranges of keys give the same sums as all at once."""
    for name, value in (("PART_TOKENS", 4000), ("HOT", 300), ("HOT_WORDS", 40)):
        monkeypatch.setattr(katz_lm, name, value)
    rows_of = {}
    write = DataFrameWriter.parquet

    def counted(self, path, *args, **kw):
        write(self, path, *args, **kw)
        rows_of[path.rsplit("/", 1)[-1]] = spark.read.parquet(path).count()

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(limit, None)
    docs = spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text")
    model = katz_lm.train(docs)
    assert spark.conf.get(limit, None) == before
    table = model.table(spark)
    n = {r.order: r["count"] for r in table.groupBy("order").count().collect()}
    assert n[2] == rows_of["counts2"] - (katz_lm.K + 1) * model.parts and 0 < rows_of["pairs2"] < n[2]
    assert table.select("key").distinct().count() == n[1] + n[2] and n[1] == model.words
    assert model.parts > 2 and rows_of["order=1"] < n[1] / 10 and rows_of["order=2"] < n[2] / 10
    often = model.frequent(spark, 300).collect()
    least = min(r.c for r in often)
    assert 0 < len(often) <= 300 and len(often) == table.where(F.col("c") >= least).count()
    one, three = (sorted(tuple(r) for r in katz_lm.score(docs, model, passes=k).collect()) for k in (1, 3))
    assert len(one) == docs.count() and np.allclose(one, three, rtol=1e-9)


def whole_katz(texts, held, order):
    """{id: score} with every n-gram of up to ``order`` words stored, and the sums of some rows."""
    toks = {i: [("start",), *brute.words(t), ("end",)] for i, t in texts.items()}
    count = [Counter() for _ in range(order + 1)]
    for i, ws in toks.items():
        for j in range(1, len(ws)):
            if not held[i]:
                for m in range(1, min(order, j + 1) + 1):
                    count[m][tuple(ws[j - m + 1:j + 1])] += 1
    n, d = sum(count[1].values()), [None, *[katz_lm.discounts(Counter(c.values())) for c in count[1:]]]

    def cut(m, c):
        return c * (d[m][c - 1] if c <= katz_lm.K else 1.0)

    left = sum(c - cut(1, c) for c in count[1].values()) / n
    prob, back = {g: cut(1, c) / n for g, c in count[1].items()}, {}

    def p(g):
        if g in prob:
            return prob[g]
        return left if len(g) == 1 else back.get(g[:-1], 1.0) * p(g[1:])

    for m in range(2, order + 1):
        after = {}
        for g in count[m]:
            after.setdefault(g[:-1], []).append(g)
        for h, gs in after.items():
            c, mass = sum(count[m][g] for g in gs), sum(cut(m, count[m][g]) for g in gs)
            c += c - mass <= 1e-9 * c
            back[h] = (1 - mass / c) / (1 - sum(prob[g[1:]] for g in gs))
            prob.update({g: cut(m, count[m][g]) / c for g in gs})
    rows = {i: sum(np.log10(p(tuple(ws[max(0, j - order + 1):j + 1]))) for j in range(1, len(ws))) for i, ws in toks.items()}
    some = [h for h in back if len(h) == order - 1][:5]
    return rows, [sum(p((*h, *w)) for w in count[1]) + p((*h, "unseen")) for h in some]


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_katz_stores_every_ngram_of_any_order(spark, small_docs, monkeypatch, order):
    monkeypatch.setattr(katz_lm, "HOT", 300)
    monkeypatch.setattr(katz_lm, "PART_TOKENS", 20_000)
    held = {i: brute.fold(i, 10) == 0 for i in small_docs}
    want, sums = whole_katz(small_docs, held, order)
    assert np.allclose(sums, 1, atol=1e-9)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    model = katz_lm.train(docs, order=order)
    got = katz_lm.score(docs, model)
    if order == 2:
        got = QUERIES["op3_katz_lm"](spark, SF001)
    got = {r.doc_id: r.score for r in got.collect()}
    assert set(got) == set(want) and all(np.isclose(got[i], want[i], rtol=1e-9) for i in want)


# ------------------------------------------------------------------ 4
def test_cover_tree(spark, edge, edge_dir):
    for sf_dir, got in ((SF001, rows(spark, "op4_cover_tree", SF001)), (edge_dir, edge["op4_cover_tree"])):
        src = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
        want = brute.cosine_groups(src)
        assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_dual_traversal_finds_all_pairs():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 12))
    points = cover_tree.unit(np.repeat(base, 8, axis=0) + rng.normal(scale=0.12, size=(480, 12)))
    for t in (0.5, 0.9, 0.98, 0.999):
        want = set(zip(*np.nonzero(np.triu(points @ points.T >= t, 1))))
        assert set(zip(*cover_tree.linked(points, None, t))) == want
        a, b = points[:200], points[200:]
        assert set(zip(*cover_tree.linked(a, b, t))) == set(zip(*np.nonzero(a @ b.T >= t)))


def test_cover_tree_blocks(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "BLOCK", 16)
    monkeypatch.setattr(cover_tree, "SAMPLE", 30)
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 6))
    pts = np.repeat(base, 5, axis=0) + rng.normal(scale=0.08, size=(200, 6))
    src = [(i, [float(x) for x in p], int(i % 2)) for i, p in enumerate(pts)]
    src += [(500 + i, src[3][1], 1) for i in range(30)]
    got = cover_tree.near_duplicates(spark.createDataFrame(src, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.cosine_groups(src)


def near_copies(rng, n, d, groups, size, noise):
    """Unit vectors far apart, then groups of near copies."""
    centres = cover_tree.unit(rng.normal(size=(groups, d)))
    copies = np.repeat(centres, size, axis=0) + noise / np.sqrt(d) * rng.normal(size=(groups * size, d))
    return cover_tree.unit(np.concatenate([rng.normal(size=(n, d)), copies]))


@pytest.mark.parametrize("sizes", [{"LEAF": 20, "LARGE": 1, "PIVOTS": 16}, {"LEAF": 20, "KIDS": 64}, {"LEAF": 4000, "TILE": (64, 100)}])
def test_dual_traversal_of_far_and_near_vectors(monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(cover_tree, name, value)
    points = near_copies(np.random.default_rng(5), 500, 24, 15, 40, 0.12)
    points = points[np.random.default_rng(6).permutation(len(points))]
    copies = np.random.default_rng(7).integers(1, 4, len(points))
    a, b = points[:600], points[600:]
    for t in (0.5, 0.97, 0.98, 0.99):
        near = (points @ points.T >= t) & ~np.eye(len(points), dtype=bool)
        assert set(zip(*cover_tree.linked(points, None, t))) == set(zip(*np.nonzero(np.triu(near))))
        assert set(zip(*cover_tree.linked(a, b, t))) == set(zip(*np.nonzero(near[:600, 600:])))
        assert (cover_tree.tally(points, None, copies, t)[0] == near @ copies).all()
        near[:600, :600] = near[600:, 600:] = False
        links, hub = cover_tree.tally(a, b, copies, t)
        assert (links == near @ copies).all() and (hub == cover_tree.hubs(len(points), *np.nonzero(near))).all()


def test_near_copies_are_counted_whole():
    points = near_copies(np.random.default_rng(8), 3000, 64, 1, 3000, 0.07)
    every = [len(i) * len(j) for i, j, every in cover_tree.meets(points, None, 0.98) if every]
    pairs = sum(len(i) for i, _, every in cover_tree.meets(points, None, 0.98) if not every)
    assert max(every) > 2900 * 2900 and pairs < 3000 * 100


def test_cover_tree_moves_a_bounded_share_of_the_table(spark, monkeypatch):
    for name, value in (("BLOCK", 32), ("SAMPLE", 200), ("ROUND", 1), ("CHUNK", 8)):
        monkeypatch.setattr(cover_tree, name, value)
    moved, compared = [], cover_tree._compared

    def counted(sent, *args):
        moved.append(sent.agg(F.sum("n")).first()[0] or 0)
        return compared(sent, *args)

    monkeypatch.setattr(cover_tree, "_compared", counted)
    points = near_copies(np.random.default_rng(9), 150, 32, 3, 60, 0.08)
    src = [(i, [float(x) for x in p], 1) for i, p in enumerate(points)]
    src += [(1000 + i, src[200][1], 1) for i in range(9)] + [(2000, src[5][1], None)]
    got = cover_tree.near_duplicates(spark.createDataFrame(src, "vec_id bigint, embedding array<double>, label int")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute.cosine_groups(src)
    assert moved[0] == len(points) and len(moved) > 2  # each block with itself, then the rounds
    assert max(moved) < 2 * cover_tree.COPIES * len(points)
    assert sum(moved) < 0.75 * len(points) * len(points) / 32  # before: all of them to all blocks


# ------------------------------------------------------------------ 5
def test_suffix_merge(spark, small_docs, edge, edge_dir):
    ids = list(small_docs)
    want = brute.repeated_bytes([(small_docs[i] or "").encode() for i in ids])
    got = {r.doc_id: r for r in rows(spark, "op5_suffix_merge", SF001)}
    assert {i: (got[i].n_removed, got[i].n_spans, got[i].kept_sha256) for i in ids} == dict(zip(ids, want))
    src = spark.read.parquet(f"{edge_dir}/documents.parquet").select("doc_id", "text").collect()
    few = [r for r in src if len(r.text or "") < 200_000]
    have = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in edge["op5_suffix_merge"] if r.doc_id != 7)
    texts = [(r.text or "").encode() for r in few]
    assert have == Counter((r.doc_id, len(t), *w) for r, t, w in zip(few, texts, brute.repeated_bytes(texts)))
    seven = next(r for r in edge["op5_suffix_merge"] if r.doc_id == 7)
    assert (seven.n_removed, seven.n_spans) == (300_000, 1)


@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_suffix_merge_small(spark, hot, monkeypatch):
    monkeypatch.setattr(suffix_merge, "RUN_BYTES", 4000)
    monkeypatch.setattr(suffix_merge, "PART_ANCHORS", 20)
    monkeypatch.setattr(suffix_merge, "PIECE", 150)
    rng = np.random.default_rng(hot)
    pool = ["".join(rng.choice(list("abcé "), 90)) for _ in range(6)]
    texts = ["".join(rng.choice(pool, int(rng.integers(1, 6)))) + "".join(rng.choice(list("xyz"), 30)) for _ in range(40)]
    texts += ["a" * 200, "ab" * 120, "", texts[0], texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_merge.remove(df, length=60, gram=20, hot=hot).collect()}
    for i, (n, spans, sha) in enumerate(brute.repeated_bytes([t.encode() for t in texts], 60)):
        import hashlib
        assert (got[i].n_bytes - len(got[i].kept), len(got[i].spans)) == (n, spans)
        assert hashlib.sha256(bytes(got[i].kept)).hexdigest() == sha


@pytest.mark.parametrize("hot", [2, 1000])
def test_suffix_merge_copies_go_in_once(spark, hot, monkeypatch):
    """What is counted for frequent grams does not grow with copies, nor with the windows that texts share."""
    import hashlib
    rows_of = {}
    write = DataFrameWriter.parquet

    def counted(self, path, *args, **kw):
        write(self, path, *args, **kw)
        rows_of[path.rsplit("/", 1)[-1]] = spark.read.parquet(path).count()

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    rng = np.random.default_rng(5)
    passage, other = ("".join(rng.choice(list("abcdefé "), 700)) for _ in range(2))
    texts = [other] * 40 + [f"{i:08d}" * 30 + passage + f"{i + 500:08d}" * 30 for i in range(30)] + [None, "", "short"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r for r in suffix_merge.remove(df, hot=hot).collect()}
    for i, (n, spans, sha) in enumerate(brute.repeated_bytes([(t or "").encode() for t in texts])):
        assert (got[i].n_bytes - len(got[i].kept), len(got[i].spans)) == (n, spans)
        assert hashlib.sha256(bytes(got[i].kept)).hexdigest() == sha
    assert rows_of["texts"] == 30  # the copies share nothing with another text
    if hot == 2:  # the texts have some 25,000 windows
        assert 0 < rows_of["blocks"] < 9000


def test_suffix_merge_spreads_parts():
    """Anchors have the smallest hashes of their windows; they go to all parts alike."""
    text = np.random.default_rng(9).integers(97, 123, 60_000).astype(np.uint8).tobytes()
    grams = suffix_merge.anchors(text)[0]
    many = np.bincount(suffix_merge.part_of(grams, 8).astype(np.int64), minlength=8)
    assert len(grams) > 200 and len(many) == 8 and many.max() < len(grams) / 4
    assert not suffix_merge.part_of(grams, 1).any()


def test_suffix_merge_lists_blocks_not_windows(spark, monkeypatch):
    """Texts that share a passage in surroundings of their own cost a row a block, not one a window."""
    rows_of = {}
    write = DataFrameWriter.parquet

    def counted(self, path, *args, **kw):
        write(self, path, *args, **kw)
        rows_of[path.rsplit("/", 1)[-1]] = spark.read.parquet(path).count()

    monkeypatch.setattr(DataFrameWriter, "parquet", counted)
    rng = np.random.default_rng(6)
    passage = "".join(rng.choice(list("abcdefé "), 300))
    texts = ["".join(rng.choice(list("uvwxyz "), 350)) + passage + "".join(rng.choice(list("uvwxyz "), 350)) for _ in range(12)]
    texts += [texts[0][100:] + "tail", texts[1][:-90]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r for r in suffix_merge.remove(df, hot=2).collect()}
    for i, (n, spans, _) in enumerate(brute.repeated_bytes([t.encode() for t in texts])):
        assert (got[i].n_bytes - len(got[i].kept), len(got[i].spans)) == (n, spans)
    assert 0 < rows_of["blocks"] < 14 * 40  # each text has up to 273 windows at an anchor, in some ten blocks


def test_loser_tree_merges_runs():
    rng = np.random.default_rng(9)
    pool = ["".join(rng.choice(list("ab"), int(rng.integers(0, 9)))).encode() for _ in range(300)]
    for k in (0, 1, 2, 3, 7, 8):
        parts = [sorted(pool[i::k]) for i in range(k)]
        runs = [suffix_merge.Run(*suffix_merge.front_code(p)) for p in parts]
        out = list(suffix_merge.merge(runs))
        strings = [s for _, _, s, _ in out]
        assert strings == sorted(x for p in parts for x in p)
        assert all(parts[r][i] == s for r, i, s, _ in out)
        assert [lcp for *_, lcp in out] == [suffix_merge.shared(a, b) for a, b in zip([b"", *strings], strings)]


# ------------------------------------------------------------------ 6
def test_ngram_join(spark, small_docs, edge):
    want = brute.shingle_groups(small_docs)
    got = rows(spark, "op6_ngram_join", SF001)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    by = {r.doc_id: (r.n_shingles, r.component_id) for r in edge["op6_ngram_join"]}
    assert by[1] == (0, 1) and by[2] == (0, 2) and by[10] == (0, 10)
    assert by[4] == (1, 3) and by[13] == (4, 12) and by[None] == (1, None)
    assert by[6] == (by[6][0], 5)


def test_ngram_join_lists_few_pairs(spark, monkeypatch):
    """Groups of up to 64 texts that share shingles don't become pairs of rows."""
    made = []
    keep = ngram_join.near_enough
    monkeypatch.setattr(ngram_join, "near_enough", lambda pairs, *args: made.append(pairs) or keep(pairs, *args))
    texts = [" ".join(f"g{g}w{i}" for i in range(12)) + " " + " ".join(f"t{g}x{k}y{i}" for i in range(8))
             for g in range(4) for k in range(50)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
    assert got == brute.shingle_groups(dict(enumerate(texts)))
    plan = made[-1]._jdf.queryExecution().optimizedPlan().toString()
    assert f"<= {ngram_join.FEW}" in plan and ngram_join.FEW <= 8


def test_ngram_join_chains(spark, monkeypatch):
    """Links that only whole prefixes find, chains, and a large group of near copies."""
    rng = np.random.default_rng(1)
    docs, base = {}, [f"w{i}" for i in range(60)]
    for i in range(150):
        text = list(base)
        for _ in range(int(rng.integers(0, 4))):
            text[int(rng.integers(60))] = f"x{rng.integers(1000)}"
        docs[i] = " ".join(text)
    for i in range(150, 260):  # a sliding window: neighbours link, ends don't
        docs[i] = " ".join(f"c{k}" for k in range(i, i + 40))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    # 99: nothing passes the first step, all links come from the prefixes; no rounds: from the last pass, joined or in blocks
    for agree, rounds, few in ((ngram_join.AGREE, ngram_join.ROUNDS, 64), (99, 1, 64), (99, 0, 64), (99, 0, 0)):
        monkeypatch.setattr(ngram_join, "AGREE", agree)
        monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
        monkeypatch.setattr(ngram_join, "FEW", few)
        monkeypatch.setattr(ngram_join, "BLOCK", 16)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.join(df).collect()}
        assert got == brute.shingle_groups(docs)


# ------------------------------------------------------------------ 7
def test_raked_marginals(spark):
    out = QUERIES["op7_mixing_ipf"](spark, SF01)
    cells = out.groupBy("source", "lang", "topic").agg(F.max("weight").alias("w"))
    from tableprep.llm.queries import MIX_TARGETS
    share = {r.lang: r.s for r in cells.groupBy("lang").agg(F.sum("w").alias("s")).collect()}
    assert share == pytest.approx(MIX_TARGETS["lang"], abs=1e-4)
    drawn = {r.lang: r.n for r in out.where("drawn").groupBy("lang").agg(F.sum("n_tokens").alias("n")).collect()}
    total = sum(drawn.values())
    assert {k: v / total for k, v in drawn.items()} == pytest.approx(MIX_TARGETS["lang"], abs=0.06)


def test_mixing_edges(edge):
    assert all(0 <= r.probability <= 1 for r in edge["op7_mixing_ipf"])
    assert {(r.source, r.lang) for r in edge["op7_mixing_ipf"] if r.doc_id == 1} == {(mixing.NULL_VALUE, mixing.NULL_VALUE)}
    assert len({(r.probability, r.drawn) for r in edge["op7_mixing_ipf"] if r.doc_id == 4}) == 1


def test_values_without_a_listed_share(spark):
    """Null, other spellings and other languages keep their token share and can be drawn."""
    from tableprep.llm.queries import MIX_TARGETS, mix_arguments
    k = F.col("doc_id") % 11
    lang = F.when(k == 0, F.lit(None)).when(k == 1, "EN").when(k == 2, "pt").when(k == 3, "").otherwise(F.col("lang"))
    docs = spark.read.parquet(f"{SF01}/documents.parquet").withColumn("lang", lang)
    got = mixing.mix(docs, **mix_arguments()).collect()
    tokens, weight, drawn = Counter(), {}, Counter()
    for r in got:
        tokens[r.lang] += r.tokens
        weight[r.source, r.lang, r.topic] = r.weight
        drawn[r.lang] += r.drawn
    share, total = Counter(), sum(tokens.values())
    for (_, value, _), w in weight.items():
        share[value] += w
    other = {v: tokens[v] / total for v in (mixing.NULL_VALUE, "EN", "pt", "")}
    rest = 1 - sum(other.values())
    assert dict(share) == pytest.approx({**other, **{v: s * rest for v, s in MIX_TARGETS["lang"].items()}}, abs=1e-6)
    assert all(r.probability > 0 for r in got if r.lang in other and r.tokens) and all(drawn[v] for v in other)


def test_raking_goes_on_until_targets_hold_or_reports_the_gap(spark):
    targets = {"source": {"a": 0.5, "b": 0.5}, "lang": {"x": 0.7, "y": 0.3}}
    schema = "source string, lang string, tokens bigint"
    slow = spark.createDataFrame([("a", "x", 10**6), ("a", "y", 1), ("b", "x", 1), ("b", "y", 10**6)], schema)
    got = mixing.rake(slow, targets).collect()
    for dim, shares in targets.items():
        assert {v: sum(r.weight for r in got if r[dim] == v) for v in shares} == pytest.approx(shares, abs=mixing.TOLERANCE)
    apart = spark.createDataFrame([("a", "x", 10), ("b", "y", 10)], schema)
    with pytest.warns(mixing.TargetsMissed, match="'source' are missed by up to 0.2 "):
        mixing.rake(apart, targets)


# ------------------------------------------------------------------ 8
def test_quality_on_held_out(spark):
    got = {r.doc_id: r for r in rows(spark, "op8_quality_crf", SF01)}
    labels = spark.read.parquet(f"{SF01}/labels.parquet").collect()
    out = [(got[r.doc_id], r.quality) for r in labels if brute.fold(r.doc_id, 3) == 1]
    assert all(g.held_out for g, _ in out)
    assert np.mean([g.predicted == q for g, q in out]) > 0.95
    assert all((r.predicted == 1) == (r.score >= 0.5) and 0 <= r.score <= 1 for r in got.values())


def test_lines_far_down_a_text_are_learned_from(spark):
    """The first stretches of all texts are alike; only what follows tells the labels apart."""
    head = "\n".join(f"an ordinary line with the number {i}" for i in range(quality_crf.STRETCH))
    tails = {0: "$$$ @@@ ### 12345 67890\n" * 300, 1: "A calm sentence of plain words, and nothing else.\n" * 300}
    docs = spark.createDataFrame([(i, f"{head}\n{tails[i % 2]}") for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    model = quality_crf.train(docs, labels)
    bad, good = (x[-1] for x in quality_crf.score_documents(model, [tails[0], tails[1]]))
    assert bad < 0.2 and good > 0.8
    assert quality_crf.train(docs, labels, max_stretches=3) is not None


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    good, moves, n = rng.normal(size=(3, 4)), rng.normal(size=(2, 2)), np.array([4, 2, 1])
    chance, pairs = quality_crf.forward_backward(good, moves, n)
    expect = np.zeros((2, 2))
    for d in range(3):
        weight, marg, move = 0.0, np.zeros(n[d]), np.zeros((2, 2))
        for path in np.ndindex(*[2] * n[d]):
            s = np.exp(sum(good[d, t] for t in range(n[d]) if path[t]) + sum(moves[a, b] for a, b in zip(path, path[1:])))
            weight += s
            marg += s * np.array(path)
            for a, b in zip(path, path[1:]):
                move[a, b] += s
        assert np.allclose(chance[d, :n[d]], marg / weight) and (chance[d, n[d]:] == 0).all()
        expect += move / weight
    assert np.allclose(pairs, expect)


def test_quality_edges(spark, edge, empty_dir, edge_dir):
    by = {r.doc_id: r for r in edge["op8_quality_crf"]}
    assert by[1].score == by[2].score  # no line: the prior
    none = quality_crf.score(spark.read.parquet(f"{edge_dir}/documents.parquet"), None, out="q").select("q").distinct().collect()
    assert [r.q for r in none] == [0.5]
    a = quality_crf.measures("one line\n\nanother line here\n")
    quality_crf.PIECE, old = 12, quality_crf.PIECE
    try:
        b = quality_crf.measures("one line\n\nanother line here\n")
    finally:
        quality_crf.PIECE = old
    assert len(a[1]) == 2 and a[1].sum() == b[1].sum()


# ------------------------------------------------------------------ 9
def test_exact_dedup_edges(edge):
    by = {}
    for r in edge["op9_digest_index"]:
        by.setdefault(r.doc_id, []).append(r)
    assert by[1][0].keep_id == 2 and by[2][0].kept and not by[1][0].kept
    assert [(r.keep_id, r.group_size, r.kept) for r in by[4]] == [(4, 3, True)] * 2 and not by[3][0].kept
    assert [(r.keep_id, r.kept) for r in by[None]] == [(None, True)] * 2


def test_digest_index_persists(spark):
    index = exact_dedup.fresh_index(spark, buckets=4)
    first = spark.createDataFrame([(1, "a"), (2, "A"), (3, "b")], "doc_id bigint, text string")
    later = spark.createDataFrame([(9, "a"), (8, "c"), (7, "C"), (6, None)], "doc_id bigint, text string")
    assert {(r.doc_id, r.kept) for r in exact_dedup.dedupe(first, index).collect()} == {(1, False), (2, True), (3, True)}
    again = exact_dedup.DigestIndex(spark, index.path, index.name)
    got = exact_dedup.dedupe(later, again)
    assert {(r.doc_id, r.keep_id, r.kept) for r in got.collect()} == {(9, 2, False), (8, 8, True), (7, 8, False), (6, 6, True)}
    assert again.buckets == 4 and index.table().count() == 4
    with pytest.raises(TablePrepError):
        exact_dedup.DigestIndex(spark, index.path + "-elsewhere", index.name)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", 4)  # Spark deals an index of fewer buckets than this anew
    try:
        plan = index.table().join(exact_dedup.groups(later).hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert "Bucketed: true" in plan and "SortMergeJoin" in plan
    assert "PythonUDF" not in plan and "InPandas" not in plan


# ------------------------------------------------------------------ 10
def test_sentencepiece_equals_the_library(spark, small_docs, edge, edge_dir):
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for r in rows(spark, "op10_sentencepiece", SF001):
        assert r.token_ids == sp.encode(small_docs[r.doc_id] or "") and r.n_tokens == len(r.token_ids) and r.round_trip
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{edge_dir}/documents.parquet").collect()}
    for r in edge["op10_sentencepiece"]:
        assert r.token_ids == sp.encode(texts[r.doc_id] or "")
        assert r.round_trip == (r.doc_id != 11)  # U+2581 stands for a space


def test_sentencepiece_odd_texts():
    import sentencepiece
    codec = sentencepiece_codec.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    rng = np.random.default_rng(6)
    texts = ["", " ", "  a", "a ", "\n\n x\t", " " * 37 + "q", " " * 15 + "t" + " " * 16, "日本語 🙂 ñ", "a" * 70 + "b" * 33, "x▁y",
             "==========", "\u0000 \x7f", "Ünïcödé é", " " * 100]
    texts += ["".join(rng.choice(list("the aing  erno.,\nü"), int(rng.integers(1, 60)))) for _ in range(400)]
    with np.errstate(over="ignore"):
        got = codec.encode(texts)
    for text, ids in zip(texts, got):
        assert ids.tolist() == sp.encode(text), text
        assert codec.decode(ids) == text.replace("▁", " ")


def test_word_hashes():
    def letters(k):  # two words on which any polynomial modulo a power of two collides
        bits = [bin(i).count("1") % 2 for i in range(1 << k)]
        return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)

    texts = [w for k in (3, 6, 9, 10, 12) for w in letters(k)] + ["a", "b", "aa", "a\0", "\0", "ab" * 4, "ab" * 4 + "c", "ab" * 600, "é", "A" * 9]
    got = words.word_hashes(" ".join(texts))
    assert len(got) == len(set(got.tolist())) == len(texts)
    assert got.tolist() == [words.word_hashes(t)[0] for t in texts]
    assert (words.word_hashes("Some WORDS\tÄB") == words.word_hashes("some words\n Äb ")).all()


def test_word_hashes_of_many_texts():
    texts = ["Some WORDS", None, "", "  ", "x" * 300_000, "word " * 80_000, "a\x0bb", "ÄB é", "y" * 2000 + " z", "end"]
    got = list(words.word_hashes_each(iter(texts)))
    assert [x.tolist() for x in got] == [words.word_hashes(t).tolist() for t in texts]


def test_parities_tell_large_sets_apart():
    """Sets of thousands of shingles that share some are dropped before they become rows; none that is near is."""
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 1 << 63, 4000).astype(np.uint64))
    sets = [np.unique(np.concatenate([base[:n], rng.integers(0, 1 << 63, more).astype(np.uint64)]))
            for n in (0, 3, 500, 1000, 2000, 4000) for more in (2, 100, 1000, 3000)]
    cells = [ngram_join.parities(s) for s in sets]
    i, j = (x.ravel() for x in np.triu_indices(len(sets), 1))
    sizes = np.array([len(s) for s in sets])
    keep = ngram_join.few_apart(cells, cells, i, j, 25 * (sizes[i] + sizes[j]) // 175)
    both = np.array([np.intersect1d(sets[a], sets[b]).size for a, b in zip(i, j)])
    alike = both / (sizes[i] + sizes[j] - both)
    fit = np.minimum(sizes[i], sizes[j]) * 100 >= np.maximum(sizes[i], sizes[j]) * 75
    assert keep[alike >= 0.75].all() and (fit & (alike < 0.6)).sum() > 20 and not keep[fit & (alike < 0.6)].any()


def test_decode_without_a_leading_space():
    import sentencepiece
    codec = sentencepiece_codec.load()
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.MODEL)
    for pieces in (["h", "i"], ["▁", "h"], ["▁the", "h"], ["▁", "▁", "a"]):
        ids = [sp.piece_to_id(p) for p in pieces]
        assert codec.decode(np.array(ids)) == sp.decode(ids)


def test_mixing_oracle_with_null_and_unlisted_languages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    lang = F.when(F.col("doc_id") % 33 == 0, None).when(F.col("doc_id") % 47 == 0, "pt").otherwise(F.col("lang"))
    docs.withColumn("lang", lang).coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duck(SF001)
    con.execute(f"create or replace view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    name = "op7_mixing_ipf"
    r = compare(spark, con, name, QUERIES[name], ORACLE[name], str(tmp_path))
    assert r["ok"], r
    drawn = QUERIES[name](spark, str(tmp_path)).where("drawn").groupBy("lang").count().collect()
    assert {x.lang for x in drawn} >= {"<null>", "pt", "en"}
