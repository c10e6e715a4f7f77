import os

import pytest

SF = os.environ.get("FOLIOWORKS_TEST_SF", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def documents(spark, sf):
    """The rows of the documents table."""
    return [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


EDGES = [
    (-5, None, "en", "a"),
    (-4, "", "en", None),
    (-3, " \t\n", None, "a"),
    (-2, "word", "de", "b"),
    (-1, "Word word", None, None),
    (None, "a text without an id " * 20, "fr", "b"),
    (900001, "x" * 200_000, "es", "b"),
    (900002, "long " * 50_000, None, "c"),
    (900003, "0 1 2 3 ... !?", "en", "c"),
    (900003, "0 1 2 3 ... !?", "en", "c"),
]


@pytest.fixture(scope="session")
def edge_docs(spark, documents):
    """Documents with NULLs, empty and very long texts, repeated rows, and columns whose names operators use."""
    rows = EDGES + [(r["doc_id"], r["text"], r["lang"], r["source"]) for r in documents[:60]]
    rows += [(r["doc_id"] + 10_000, r["text"], r["lang"], r["source"]) for r in documents[:20]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    names = "key size part score found node shard taken digest number block contaminated lang_pred".split()
    return df.selectExpr("*", *[f"'{n}' AS {n}" for n in names]).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.where("false")
