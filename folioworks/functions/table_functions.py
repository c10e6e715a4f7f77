"""Registered splitters as table functions of SQL: ``SELECT * FROM name(TABLE(docs), 'text')``."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult


def register_splitter_function(spark: SparkSession, name: str, splitter: Callable[[str], Iterable[str]]) -> None:
    """Make a Python splitter callable from SQL as ``name(TABLE(any), 'column')``.

    The result has the columns of the table, then chunk_index (from 0) and chunk_text. Rows stay in their partitions
    and nothing is exchanged. A NULL text has no chunk. Splitters of columns (``register_splitter``) need no Python and
    are the faster slot; this one takes what only Python can cut.
    """

    class Split:
        def __init__(self):
            self.place = None

        @staticmethod
        def analyze(row: AnalyzeArgument, column: AnalyzeArgument) -> AnalyzeResult:
            if not row.isTable or not isinstance(row.dataType, T.StructType):
                raise ValueError("the first argument must be a table")
            names = row.dataType.fieldNames()
            if column.value not in names:
                raise ValueError(f"missing column {column.value!r}, found {names}")
            taken = {"chunk_index", "chunk_text"} & set(names)
            if taken:
                raise ValueError(f"the table has columns {sorted(taken)} already")
            chunks = [T.StructField("chunk_index", T.LongType()), T.StructField("chunk_text", T.StringType())]
            return AnalyzeResult(schema=T.StructType([*row.dataType.fields, *chunks]))

        def eval(self, row, column):
            text = row[column]
            for i, chunk in enumerate(splitter(text) if text is not None else ()):
                yield (*row, i, chunk)

    spark.udtf.register(name, F.udtf(Split))
