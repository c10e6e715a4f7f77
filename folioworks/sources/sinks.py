"""Sinks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators import metrics as mt

ROWS_PER_FILE = 500_000
#: Bytes of texts in a markdown file, unless a single document has more.
RUN_BYTES = 1 << 20


def write_extraction(df: DataFrame, path: str, mode: str = "append") -> None:
    """Extraction output (id, source_path, data JSON, error) as JSON lines, good and failed rows apart."""
    data = F.try_parse_json("data")
    line = F.to_json(F.struct(data.alias("data"), F.col("error"), F.struct("source_path", "id").alias("meta")))
    status = F.when(F.col("error").isNull() & data.isNotNull(), "ok").otherwise("error")
    df.select(line.alias("value"), status.alias("status")).write.mode(mode).partitionBy("status").text(path)


def write_buckets(df: DataFrame, path: str) -> None:
    """Bucket rows, one folder per bucket; only the buckets in ``df`` are replaced."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("index_type")
        .parquet(path)
    )


def _by_document(df: DataFrame, key: str, position: str):
    """A writer of bounded files in document order; the document is a column, not a folder of its own.

    Ranges are cut within documents, too, so a document with a third of all rows is written by a third of the tasks.
    """
    ordered = df.repartitionByRange(key, position).sortWithinPartitions(key, position)
    return ordered.write.mode("overwrite").option("maxRecordsPerFile", ROWS_PER_FILE)


def write_markdown(docs: DataFrame, path: str, run_bytes: int = RUN_BYTES) -> None:
    """Texts of every source in order of doc_id, a line end after each, as files source=.../run=....

    A file is a bounded run of neighbouring documents, so neither the task that writes a source nor the string that a
    file is read as grows with the source. Runs of a source are in the order of their numbers. NULL texts are left out.
    """

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, source, run = [], 0, None, 0

        def row() -> pa.RecordBatch:
            columns = [pa.array([source], pa.string()), pa.array([run], pa.int64())]
            return pa.RecordBatch.from_arrays(
                [*columns, pa.array(["\n".join(held)], pa.string())], ["source", "run", "value"]
            )

        for batch in batches:
            for part, here, text in zip(*batch.columns, strict=True):
                here, text = here.as_py(), text.as_py()
                bytes_here = len(text.encode()) + 1
                if held and (here != source or size + bytes_here > run_bytes):
                    yield row()
                    held, size, run = [], 0, run + 1
                if not held and run < part.as_py() << 32:
                    run = part.as_py() << 32
                held.append(text)
                source, size = here, size + bytes_here
        if held:
            yield row()

    ordered = docs.where(F.col("text").isNotNull()).repartitionByRange("source", "doc_id")
    ordered = ordered.sortWithinPartitions("source", "doc_id").select(
        F.spark_partition_id().cast("long").alias("part"), "source", "text"
    )
    cut = ordered.mapInArrow(runs, "source string, run long, value string")
    cut.write.partitionBy("source", "run").text(path)


def write_passages(passages: DataFrame, path: str, position: str = "passage_id") -> None:
    _by_document(passages, "doc", position).json(path)


def write_retrieval_docs(docs: DataFrame, path: str) -> None:
    _by_document(docs, "doc", "id").json(path)


def write_dataset(totals: DataFrame, entries: DataFrame, path: str) -> None:
    """Totals and section entries of every document, side by side."""
    totals.write.mode("overwrite").json(f"{path}/metadata")
    _by_document(entries, "doc", "section_id").json(f"{path}/sections")


def write_image_index(images: DataFrame, path: str, source: str = "source", ident: str = "id", file_path: str = "path") -> None:
    _by_document(mt.image_index(images, source, ident, file_path), source, "id").json(path)


def write_scores(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", "true").option("quote", '"').option("escape", '"').csv(path)


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)
