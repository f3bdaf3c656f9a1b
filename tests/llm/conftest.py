import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF001 = "/root/testdata/sf0.001"

LONG = "lorem ipsum dolor sit amet " * 4000
PASSAGE = "".join(f"passage word{i} of a text that two documents share " for i in range(12))
DOCS = [
    # doc_id, text, lang, source, n_chars, then columns whose names clash with inner ones
    (1, None, None, None, None),
    (2, "", "en", "a", 0),
    (3, "Some short TEXT", "en", "a", 15),
    (4, "some short text", "en", "b", 15),
    (4, "some short text", "en", "b", 15),
    (5, LONG, "de", "a", len(LONG)),
    (6, LONG + "end", "de", "a", len(LONG) + 3),
    (7, "x" * 300_000, "fr", None, 300_000),
    (None, "a text without an id", "es", "b", 20),
    (None, "a text without an id", "es", "b", 20),
    (8, f"{PASSAGE} and something of its own, number eight", "en", "a", 1),
    (9, f"before it, number nine. {PASSAGE}", "en", "a", 1),
    (10, "  \t\n ", "en", "a", 6),
    (11, "Released under the MIT License. Ünïcödé ▁ \U0001F642 \x00 end\n\nunder the mit license", "en", "a", 60),
    (12, "one two three four five six seven eight", "en", "a", 1),
    (13, "one two three four five six seven eight", "en", "b", 1),
]


def _write(spark, root, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{root}/{name}.parquet")


DOC_SCHEMA = ("doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, kept string, id bigint, "
              "row string, drawn int, part int, quality_score double, token_ids string, s1 string, topic string, shard string")
VEC_SCHEMA = "vec_id bigint, embedding array<float>, label int, node string, g int"
LABEL_SCHEMA = "doc_id bigint, quality int, toxic int, label string"
EXTRA = ("d", "k", 1, "r", 2, 3, 0.5, "t", "s", "o", "h")


@pytest.fixture(scope="session")
def edge_dir(spark):
    """Nulls, empty and long texts, ties, repeated rows, clashing extra columns."""
    root = tempfile.mkdtemp(prefix="llm-edge-")
    _write(spark, root, "documents", [(*d, *EXTRA) for d in DOCS], DOC_SCHEMA)
    one = [1.0, 0.0, 2.0]
    vectors = [(1, one, 1), (2, one, 1), (3, [2.0, 0.0, 4.0], 1), (4, [1.0, 0.05, 2.0], 1), (5, [0.0, 1.0, 0.0], 1), (6, one, 2),
               (7, one, None), (8, None, 1), (9, [], 1), (10, [0.0, 0.0, 0.0], 1), (11, [1.0, float("nan"), 2.0], 1),
               (12, [1.0, None, 2.0], 1), (13, [1.0, 0.0], 1), (14, [float("inf"), 0.0, 1.0], 1), (15, [1e30, 0.0, 2e30], 1)]
    _write(spark, root, "embeddings", [(*v, "n", 1) for v in vectors], VEC_SCHEMA)
    _write(spark, root, "labels", [(3, 1, 0, "x"), (3, 0, 0, "x"), (4, 1, None, "x"), (5, 0, 0, "x"), (None, 1, 0, "x"), (8, None, 1, "x"),
                                   (99, 1, 0, "x"), (9, 1, 0, "x")], LABEL_SCHEMA)
    return root


@pytest.fixture(scope="session")
def empty_dir(spark):
    root = tempfile.mkdtemp(prefix="llm-empty-")
    _write(spark, root, "documents", [], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    _write(spark, root, "embeddings", [], "vec_id bigint, embedding array<float>, label int")
    _write(spark, root, "labels", [], "doc_id bigint, quality int, toxic int")
    return root


@pytest.fixture(scope="session")
def small_docs(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF001}/documents.parquet").select("doc_id", "text").collect()}
