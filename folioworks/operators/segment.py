"""Table-valued text operators: one document row in, its chunks or lines out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import chunks as ch
from folioworks.functions import markdown as md
from folioworks.functions import splitters as sp
from folioworks.functions.text import record_id


def explode_texts(df: DataFrame, texts: Column, *keep: str) -> DataFrame:
    """Rows (keep..., chunk_index, chunk_text)."""
    return df.select(*keep, F.posexplode(texts).alias("chunk_index", "chunk_text"))


def split_texts(df: DataFrame, splitter: Callable[[Column], Column], *keep: str, text: str = "text") -> DataFrame:
    return explode_texts(df, splitter(F.col(text)), *keep)


def chunk_records(
    df: DataFrame, schema_name: str = "BaseModel", chunk_by: str = "book", path: str = "path", text: str = "text"
) -> DataFrame:
    """Chunk records (id, source_path, chunk_index, chunk_text, schema_name) of markdown files."""
    if chunk_by == "book":
        texts = sp.by_book(F.col(path), F.col(text), fv.KIND_OF_SCHEMA.get(schema_name))
    elif chunk_by == "section":
        texts = sp.by_section(F.col(text))
    else:
        texts = sp.by_paragraph(F.col(text))
    out = explode_texts(df, texts, path)
    return out.select(
        record_id(F.col(path), F.col("chunk_index")).alias("id"),
        F.col(path).alias("source_path"),
        "chunk_index",
        "chunk_text",
        F.lit(schema_name).alias("schema_name"),
    )


def overlapping_chunks(df: DataFrame, *keep: str, text: str = "text", **limits: int) -> DataFrame:
    """Rows (keep..., chunk_id, chunk_text, position)."""
    exploded = df.select(*keep, F.posexplode(ch.overlapping(F.col(text), **limits)).alias("chunk_id", "c"))
    return exploded.select(*keep, "chunk_id", F.col("c.text").alias("chunk_text"), "c.position")


def packed_chunks(df: DataFrame, max_chars: int, *keep: str, text: str = "text") -> DataFrame:
    return explode_texts(df, ch.packed_paragraphs(F.col(text), max_chars), *keep)


def markdown_blocks(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Rows (keep..., line_no, block_type, block_text) for every line."""
    rows = df.select(*keep, F.inline(md.blocks(F.col(text))))
    typed = rows.withColumn("block_type", md.block_type(F.col("line"), F.col("in_table")))
    return typed.select(
        *keep, "line_no", "block_type", md.block_text(F.col("line"), F.col("block_type")).alias("block_text")
    )


def markdown_tables(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Rows (keep..., table_no, row_no, col_no, cell)."""
    return df.select(*keep, F.inline(md.table_cells(F.col(text))))


def markdown_spans(df: DataFrame, *keep: str, text: str = "block_text") -> DataFrame:
    """Rows (keep..., span_no, span_type, span_text) of formatted lines."""
    rows = df.select(*keep, F.posexplode(md.inline_spans(F.col(text))).alias("span_no", "piece"))
    typed = rows.withColumn("span_type", md.span_type(F.col("piece")))
    return typed.select(
        *keep, "span_no", "span_type", md.span_text(F.col("piece"), F.col("span_type")).alias("span_text")
    )


def header_path_nodes(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Rows (keep..., node_no, header_path, node_text)."""
    rows = df.select(*keep, F.posexplode(md.header_nodes(F.col(text))).alias("node_no", "n"))
    return rows.select(*keep, "node_no", F.col("n.header_path"), F.col("n.text").alias("node_text"))


def image_refs(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Rows (keep..., line_no, image_id, source_filename)."""
    return df.select(*keep, F.inline(md.image_refs(F.col(text))))
