"""The pipeline against a composition of brute-force results."""
import brute
import corpus_pipeline as P
from pyspark.sql import functions as F

from tableprep.llm import mixing
from tableprep.llm.queries import QUERIES, mix_arguments

SF001 = "/root/testdata/sf0.001"


def test_stages_are_named():
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "ngram_join", "mixing", "tokens"]


def test_pipeline_against_brute_force(spark, small_docs):
    got = {r.doc_id: r for r in P.run(spark, SF001).collect()}
    good = {r.doc_id for r in QUERIES["op8_quality_crf"](spark, SF001).collect() if r.score >= 0.5}
    last = {}
    for i in sorted(good):
        last[(small_docs[i] or "").translate(brute.LOWER)] = i
    left = {i: small_docs[i] for i in last.values()}
    left = {i: left[i] for i, (_, c) in brute.shingle_groups(left).items() if i == c}
    docs = spark.read.parquet(f"{SF001}/documents.parquet").where(F.col("doc_id").isin(list(left)))
    drawn = {r.doc_id for r in mixing.mix(docs, **mix_arguments()).where("drawn").collect()}
    assert set(got) == drawn and 0 < len(drawn) < len(left)
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    assert all(r.token_ids == sp.encode(small_docs[i] or "") for i, r in got.items())


def test_pipeline_edges(spark, edge_dir, tmp_path):
    docs = spark.read.parquet(f"{edge_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, edge_dir)
        assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "exact_dedup":
            ids = [r.doc_id for r in docs.collect()]
            assert len(ids) == len(set(ids))
    assert P.STAGES[-1][1](spark, docs, edge_dir).count() == docs.count()


def test_pipeline_empty(spark, empty_dir):
    assert P.run(spark, empty_dir).collect() == []
