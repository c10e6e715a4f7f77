"""Splitters called from SQL."""

import pytest

from folioworks.functions.table_functions import register_splitter_function


def test_splitter_is_a_table_function(spark):
    register_splitter_function(spark, "halves_of", lambda t: t.split("|"))
    rows = [(1, "a|b", "x"), (2, None, "y"), (3, "", None), (1, "a|b", "x")]
    docs = spark.createDataFrame(rows, "i int, body string, extra string").repartition(3)
    out = spark.sql("SELECT * FROM halves_of(TABLE({docs}), 'body')", docs=docs)
    assert out.columns == ["i", "body", "extra", "chunk_index", "chunk_text"]
    got = sorted((r["i"], r["extra"] or "", r["chunk_index"], r["chunk_text"]) for r in out.collect())
    assert got == [(1, "x", 0, "a"), (1, "x", 0, "a"), (1, "x", 1, "b"), (1, "x", 1, "b"), (3, "", 0, "")]
    plan = spark.sql("SELECT * FROM halves_of(TABLE(VALUES (1, 'a') AS t(i, body)), 'body')")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_arguments_are_checked(spark):
    register_splitter_function(spark, "halves_of", lambda t: t.split("|"))
    docs = spark.createDataFrame([("a", 1)], "body string, chunk_index int")
    with pytest.raises(Exception, match="missing column 'text'"):
        spark.sql("SELECT * FROM halves_of(TABLE({docs}), 'text')", docs=docs)
    with pytest.raises(Exception, match="already"):
        spark.sql("SELECT * FROM halves_of(TABLE({docs}), 'body')", docs=docs)
