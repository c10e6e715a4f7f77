"""Counts, batch status and pipeline metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.functions.text import file_name


def extraction_counts(records: DataFrame, key: str, ok: Column) -> DataFrame:
    return records.groupBy(key).agg(F.count_if(ok).alias("n_ok"), F.count(F.lit(1)).alias("n_total"))


def batch_status(runs: DataFrame, key: str, ok: Column, seconds: str) -> DataFrame:
    """Successes, failures, total and average duration per batch."""
    return runs.groupBy(key).agg(
        F.count_if(ok).alias("n_success"),
        F.count_if(~ok).alias("n_failed"),
        F.sum(seconds).alias("total_seconds"),
        F.avg(seconds).alias("avg_seconds"),
    )


def preview(df: DataFrame, text: Column, order: list, n: int) -> DataFrame:
    """One row: the first ``n`` texts by ``order``, joined by line breaks. Only ``n`` rows are gathered."""
    first = df.select(text.alias("t"), *order).orderBy(*order).limit(n)
    position = F.struct(*order)
    rows = F.sort_array(F.collect_list(F.struct(position.alias("p"), F.col("t"))))
    return first.agg(F.array_join(F.transform(rows, lambda r: r["t"]), "\n").alias("preview"))


def pipeline_totals(files: DataFrame, images: DataFrame, texts: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of totals. Inputs: files(size_bytes), images(size_bytes), texts(lines, samples, size_bytes), runs(ts).

    Each input is reduced to one row; the rows are then stacked and added up.
    """
    names = [
        "num_files", "total_size_bytes", "num_images", "image_size_bytes", "num_lines", "num_samples",
        "markdown_size_bytes",
    ]

    def part(df: DataFrame, **values: Column) -> DataFrame:
        return df.agg(*[values.get(n, F.lit(None)).cast("bigint").alias(n) for n in names])

    stacked = (
        part(files, num_files=F.count(F.lit(1)), total_size_bytes=F.sum("size_bytes"))
        .unionByName(part(images, num_images=F.count(F.lit(1)), image_size_bytes=F.sum("size_bytes")))
        .unionByName(
            part(
                texts,
                num_lines=F.sum("lines"),
                num_samples=F.sum("samples"),
                markdown_size_bytes=F.sum("size_bytes"),
            )
        )
    )
    ts = F.col("ts").cast("timestamp")
    span = runs.agg(F.min(ts).alias("start_time"), F.max(ts).alias("end_time"))
    times = span.select(
        *[F.lit(None).cast("bigint").alias(n) for n in names],
        ((F.unix_micros("end_time") - F.unix_micros("start_time")) / 1e6).alias("processing_time_seconds"),
        "start_time",
        "end_time",
    )
    both = stacked.unionByName(times, allowMissingColumns=True)
    out = both.agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
        F.max("processing_time_seconds").alias("processing_time_seconds"),
        F.max("start_time").alias("start_time"),
        F.max("end_time").alias("end_time"),
    )
    return out.withColumn("output_size_bytes", F.col("markdown_size_bytes") + F.col("image_size_bytes"))


def image_index(images: DataFrame, source: str, ident: str, path: str) -> DataFrame:
    """(source, id, filename, path, total_images): the images of every source with their count."""
    totals = images.groupBy(source).agg(F.count(F.lit(1)).alias("total_images"))
    named = images.select(source, F.col(ident).alias("id"), file_name(F.col(path)).alias("filename"), F.col(path).alias("path"))
    return named.join(totals, source)
