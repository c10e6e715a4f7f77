"""Incremental ingest with Structured Streaming.

Batches are appended to a store folder, one subfolder per batch, and written with overwrite: a
batch that runs again after a failure replaces its own files and nothing else. Readers take the
last row per key. ``files_per_trigger`` limits the files of a batch; a rate between items is ``operators.pacing``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from folioworks.operators import records, store
from folioworks.operators.bucket_table import BucketTable
from folioworks.session import settings


def jsonl_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Lines of JSONL files as they arrive, with the file and its time for last-one-wins."""
    raw = spark.readStream.format("text").option("maxFilesPerTrigger", files_per_trigger).load(path)
    return raw.select(
        "value",
        F.col("_metadata.file_modification_time").alias("file_time"),
        F.col("_metadata.file_path").alias("file_path"),
    )


def append_batches(stream: DataFrame, path: str, checkpoint: str, shape: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Write every micro-batch to ``path/batch=<n>`` and stop when the input is used up."""

    def write(batch: DataFrame, number: int) -> None:
        out = batch if shape is None else shape(batch)
        out.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def append_first(
    stream: DataFrame, path: str, checkpoint: str, keys: list[str], time: str, delay: str, where: str = "RocksDB"
) -> StreamingQuery:
    """Append the first row of each key; repeats within ``delay`` of event time go, and so do rows later than that.

    A key is remembered until the watermark (the latest ``time`` of the batches before, less ``delay``) passes its first
    row's time by ``delay``, so the state holds the keys of a stretch of time and not those of the whole stream. A row
    whose time the watermark has reached is dropped, whatever its key. A key that comes again after it was forgotten is
    appended again. A NULL time is taken as new for as long as the stream runs; NULL keys are equal.
    """
    provider = f"org.apache.spark.sql.execution.streaming.state.{where}StateStoreProvider"
    with settings(stream.sparkSession, {"spark.sql.streaming.stateStore.providerClass": provider}):
        return append_batches(stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys), path, checkpoint)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")


def read_latest(spark: SparkSession, path: str, keys: list[str], *seq: str) -> DataFrame:
    """Last row per key: by batch, then by ``seq``."""
    rows = read_batches(spark, path)
    newest = rows.withColumn("_seq", F.struct("batch", *seq))
    return store.latest(newest, "_seq", keys).drop("_seq", "batch")


def compact_batches(spark: SparkSession, path: str, table: BucketTable, *seq: str) -> int:
    """Upsert batch folders that ``table`` doesn't have yet into it, and return the number of the last one (-1: none).

    The table's ``seq`` column holds (batch, ``seq``), so folders that are compacted twice change nothing. The number of
    the last one is noted beside the folders when the table is written; if a run ends before that, the next does it
    again.
    """
    last = _compacted(spark, path)
    rows = read_batches(spark, path).where(F.col("batch") > last)
    newest = rows.agg(F.max("batch")).first()[0]
    if newest is None:
        return last
    rows = rows.where(F.col("batch") <= newest).withColumn(table.seq, F.struct("batch", *seq)).drop("batch")
    if spark.catalog.tableExists(table.name):
        table.upsert(rows)
    else:
        table.create(rows)
    note = spark.range(1).select(F.lit(newest).cast("int").alias("last"))
    note.write.mode("overwrite").parquet(f"{path}/_compacted/{newest:09d}")
    return newest


def _compacted(spark: SparkSession, path: str) -> int:
    try:
        return spark.read.parquet(f"{path}/_compacted/*").agg(F.max("last")).first()[0]
    except AnalysisException as e:  # nothing has been compacted yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1


def read_compacted(spark: SparkSession, path: str, table: BucketTable, *seq: str) -> DataFrame:
    """Last row of each key of the table and of the batch folders behind it."""
    last = _compacted(spark, path)
    later = read_batches(spark, path).where(F.col("batch") > last)
    later = later.withColumn(table.seq, F.struct("batch", *seq)).drop("batch")
    rows = table.read(spark).unionByName(later) if last >= 0 else later
    return store.latest(rows.withColumn("_seq", F.col(table.seq)), "_seq", list(table.keys)).drop("_seq", table.seq)


def ingest_records(
    spark: SparkSession,
    source: str,
    path: str,
    checkpoint: str,
    index_type: str,
    schema: str,
    files_per_trigger: int = 16,
    embed: Callable[[Column], Column] | None = None,
) -> StreamingQuery:
    """JSONL files to a bucket: parse, coerce, render, embed, append; an invalid record keeps its ``error``."""
    lines = jsonl_stream(spark, source, files_per_trigger)
    parsed = records.parse_records(lines).where(F.col("meta").isNotNull())
    typed = records.coerce_records(parsed, schema)
    rows = records.retrieval_records(typed, index_type, extra=("file_time", "file_path"))
    if embed is not None:
        rows = rows.withColumn("vec", embed(F.col("text")))
    return append_batches(rows, path, checkpoint)


def read_bucket_store(spark: SparkSession, path: str) -> DataFrame:
    """The bucket as of now: one row per (index_type, id)."""
    return read_latest(spark, path, store.KEYS, "file_time", "file_path", "text").drop("file_time", "file_path")


#: State in RocksDB; retries come with the next batch that has data, never in batches of their own.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}
_EXTRACTED = "chunk_text string, data string, error string"


class _Extraction(StatefulProcessor):
    """One id: extracted when it first comes, and again in every later batch until it has data."""

    def __init__(self, schema: str, extractor: Callable[[str, str], str] | None):
        self.schema, self.extractor = schema, extractor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.attempts = handle.getValueState("attempts", "n int, done boolean")
        self.waiting = handle.getValueState("waiting", "chunk_text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        texts = [t for frame in rows for t in frame["chunk_text"].dropna().tolist()]
        known = self.attempts.get()
        if known is None:
            yield self._try(key, min(texts, default=None), 0, timerValues)
        elif not known[1]:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            yield self._try(key, self.waiting.get()[0], known[0], timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self.attempts.get()
        if known is not None and not known[1]:
            yield self._try(key, self.waiting.get()[0], known[0], timerValues)

    def _try(self, key, text: str | None, attempts: int, times) -> pd.DataFrame:
        data = error = None
        if self.extractor is not None:
            try:
                data = self.extractor(text, self.schema)
            except Exception as e:  # a failed item is a row, not a failed job
                error = str(e)
        done = error is None
        self.attempts.update((attempts + 1, done))
        if done:
            self.waiting.clear()
        else:
            self.waiting.update((text,))
            self.handle.registerTimer(times.getCurrentProcessingTimeInMs() + 1)
        return pd.DataFrame({"id": [key[0]], "chunk_text": [text], "data": [data], "error": [error]})

    def close(self) -> None:
        pass


def extract_pending(
    chunks: DataFrame,
    path: str,
    checkpoint: str,
    schema: str,
    extractor: Callable[[str, str], str] | None = None,
) -> StreamingQuery:
    """Resumable extraction of a stream of chunks (id, chunk_text): every id until it has data, and then no more.

    An id is keyed state: the number of its attempts, whether it has data, and, while it hasn't, the text to try again.
    A timer brings a failed id back in the next batch, whether or not the input has it again. So a batch touches the
    ids it is given and those that wait, and reads nothing of what earlier batches wrote; what is kept for an id that
    is done is one small row in RocksDB. A batch that is run again finds the state as it was before. Of several texts
    of one id in its first batch the smallest is taken.
    """
    kind = dict(chunks.dtypes)["id"]
    with settings(chunks.sparkSession, _STATE):
        tried = (
            chunks.select("id", "chunk_text")
            .groupBy("id")
            .transformWithStateInPandas(
                _Extraction(schema, extractor), f"id {kind}, {_EXTRACTED}", "Append", "ProcessingTime"
            )
        )
        if extractor is None:  # the placeholder needs no Python and never fails
            return append_batches(tried, path, checkpoint, lambda batch: records.extract(batch, schema))
        return append_batches(tried.drop("chunk_text"), path, checkpoint)


class _Stop(Exception):
    """Raised in place of a batch, which so stays uncommitted."""


def save_until(
    results: DataFrame, path: str, checkpoint: str, failed: Column, most_failed: float, least_rows: int = 1
) -> bool:
    """Append batches of results to ``path``, and stop behind the first in which too many rows fail.

    The rows of a batch and those that ``failed`` holds for are observed while the batch is written. If more than the
    share ``most_failed`` of at least ``least_rows`` rows fail, the batch stays written and committed, and the stream
    stops before the next one, of which nothing is written. The next call goes on from there (from the checkpoint), so
    nothing is lost or done twice, whatever made the rows fail can be mended in between.

    Returns whether the input was used up.
    """
    tripped = False

    def write(batch: DataFrame, number: int) -> None:
        nonlocal tripped
        if tripped:
            raise _Stop(f"stopped before batch {number}")
        seen = Observation(f"batch {number}")
        counts = F.count(F.lit(1)).alias("rows"), F.count(F.when(failed, 1)).alias("failed")
        batch.observe(seen, *counts).write.mode("overwrite").parquet(f"{path}/batch={number}")
        found = seen.get
        tripped = found["rows"] >= max(1, least_rows) and found["failed"] > most_failed * found["rows"]

    query = (
        results.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if not tripped or "stopped before batch" not in str(e):
            raise
        return False
    return True


def save_results(results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append result rows as CSV as they come; what is written stays when the run stops early."""
    return (
        results.writeStream.format("csv")
        .option("header", "true")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
