"""A training corpus from raw documents, in five stages.

Each stage takes the rows its predecessor kept (written as Parquet and read
again) and returns those it keeps, with the columns of ``documents``; the last
one returns token ids.

1. ``quality``: documents that the line classifier scores under 0.5 go.
2. ``exact_dedup``: of equal texts (A-Z lower-cased) the row with the largest id stays.
3. ``ngram_join``: of documents linked by similar shingles the smallest id stays.
4. ``mixing``: documents are drawn so that token shares meet the target marginals.
5. ``tokens``: every whole text becomes piece ids.

Defined results: null and empty texts score the prior of the classifier and, if
that keeps them, are equal texts and mix by their cell; rows with a null id are
linked with nothing; rows that repeat both id and text become one in stage 2; an
empty table gives an empty one; columns beyond those of ``documents`` pass through
the first four stages, whatever their names.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprep.llm import exact_dedup, mixing, ngram_join, quality_crf, sentencepiece_codec
from tableprep.llm.common import scratch
from tableprep.llm.queries import mix_arguments, quality_model, table


def _free(docs: DataFrame, *names: str) -> list[str]:
    """Column names that ``docs`` does not have."""
    out, taken = [], {c.lower() for c in docs.columns}
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are likelier good than bad."""
    score, lines = _free(docs, "quality_score", "line_scores")
    scored = quality_crf.score(docs, quality_model(spark, sf_dir), out=score, lines_out=lines)
    return scored.where(F.col(score) >= 0.5).drop(score, lines)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row with the largest id of equal texts."""
    index = exact_dedup.fresh_index(spark)
    index.append(exact_dedup.groups(docs))
    (mark,) = _free(docs, "digest")
    marked = docs.withColumn(mark, exact_dedup.digest(F.col("text"))).dropDuplicates(["doc_id", mark])
    stays = index.files().select(F.col("digest").alias("_digest"), F.col("keep_id").alias("_keep_id"))
    same = (marked[mark] == stays["_digest"]) & marked["doc_id"].eqNullSafe(stays["_keep_id"])
    return marked.join(stays, same, "left_semi").drop(mark)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of documents that links join."""
    linked = ngram_join.join(docs).where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(linked, "doc_id", "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents by calibrated probabilities."""
    return mixing.draw(docs, **mix_arguments())


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text."""
    coded = sentencepiece_codec.encode(spark, docs.select("doc_id", "source", "lang", "text"))
    return coded.select("doc_id", "source", "lang", F.size("token_ids").cast("bigint").alias("n_tokens"), "token_ids")


STAGES = [("quality", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mixed), ("tokens", tokens)]

#: The classifier and the tokenizer have no SQL; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between them is written to the
    shared folder, so a lost executor never takes a stage back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
