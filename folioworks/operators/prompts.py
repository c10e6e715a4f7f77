"""Prompt and context tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.schemas import SCHEMAS
from folioworks.functions.text import drop_repeated_lines, file_name, fixed_point, normalize_spaces, sanitize_chunk
from folioworks.operators.scan import ROWS_PER_BLOCK, join_texts


def messages_to_prompt(
    df: DataFrame, key: str, order: str, role: str, content: str, rows_per_block: int = ROWS_PER_BLOCK
) -> DataFrame:
    """One prompt per conversation: the messages in order, then the open assistant turn."""
    shown = df.select(
        key, order, F.concat(F.upper(F.col(role)), F.lit(": "), F.coalesce(F.col(content), F.lit(""))).alias("m")
    )
    joined = join_texts(shown, [key], order, "m", "\n\n", "prompt", rows_per_block)
    return joined.withColumn("prompt", F.concat("prompt", F.lit("\n\nASSISTANT:")))


def context_block(
    rank: Column,
    ident: Column,
    source: Column,
    chunk: Column,
    score: Column,
    text: Column,
    fields: dict[str, Column] | None = None,
) -> Column:
    """One retrieved chunk: a header line, extra metadata lines, the text."""
    head = F.concat_ws(
        " ",
        F.concat(F.lit("#"), rank.cast("string")),
        F.when(ident != "", F.concat(F.lit("id="), ident)),
        F.when(source != "", F.concat(F.lit("source="), source)),
        F.concat(F.lit("chunk="), chunk.cast("string")),
        F.concat(F.lit("score="), fixed_point(score, 4)),
    )
    extra = [F.when(value != "", F.concat(F.lit(f"{name}: "), value)) for name, value in (fields or {}).items()]
    return F.concat_ws("\n", head, *extra, F.coalesce(text, F.lit("")))


def join_contexts(df: DataFrame, key: str, rank: str, block: str) -> DataFrame:
    """(key, context): the blocks of a question in rank order. A question has at most k blocks."""
    joined = F.expr(f"listagg(`{block}`, '{fv.CONTEXT_RULE}') WITHIN GROUP (ORDER BY `{rank}`)")
    return df.groupBy(key).agg(joined.alias("context"))


def answer_prompt(question: Column, context: Column, system: str = fv.ANSWER_SYSTEM) -> Column:
    """The prompt for one question, or the fixed reply when nothing was retrieved."""
    prompt = F.concat(
        F.lit(system + "\n\n" + fv.ANSWER_CONTEXT_HEAD),
        context,
        F.lit("\n\n" + fv.ANSWER_QUESTION_HEAD),
        question,
        F.lit("\n\n" + fv.ANSWER_RULES),
    )
    return F.when(F.coalesce(context, F.lit("")) == "", F.lit(fv.NO_CONTEXT_ANSWER)).otherwise(prompt)


def extraction_prompt(text: Column, hint: Column, field_names: list[str], schema_json: str) -> Column:
    """The prompt that asks a model for one JSON object of the given schema."""
    rules = fv.EXTRACTION_RULES.replace("<fields>", ", ".join(field_names))
    return F.concat(
        F.lit(fv.EXTRACTION_HEAD),
        hint,
        F.lit("\n\nVăn bản OCR:\n"),
        text,
        F.lit("\n\n" + rules + "\nSchema JSON:\n" + schema_json + "\n"),
    )


def context_hint(source_path: Column, chunk_index: Column) -> Column:
    """Where a chunk comes from, for the extraction prompt."""
    return F.concat(F.lit("source="), file_name(source_path), F.lit(" chunk="), chunk_index.cast("string"))


def extraction_prompts(chunks: DataFrame, schema: str, schema_json: str) -> DataFrame:
    """(id, prompt) for chunk records (id, source_path, chunk_index, chunk_text) of one schema."""
    text = normalize_spaces(drop_repeated_lines(sanitize_chunk(F.col("chunk_text"))))
    fields = [name for name, *_ in SCHEMAS[schema]]
    hint = context_hint(F.col("source_path"), F.col("chunk_index"))
    return chunks.select("id", extraction_prompt(text, hint, fields, schema_json).alias("prompt"))
