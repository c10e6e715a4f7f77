"""Composed pipelines: the operators in the order a job runs them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import markdown as md
from folioworks.functions.text import clean_answer, drop_repeated_lines, normalize_spaces, sanitize_chunk
from folioworks.operators import evaluation as ev
from folioworks.operators import ocr, prompts, records, search, segment


def postprocess_markdown(
    df: DataFrame, text: str = "text", images: str | None = None, correct: bool = True, strict: bool = False
) -> DataFrame:
    """Repair the syntax, name the images, insert section breaks, correct the spelling."""
    out = df.withColumn(text, md.repair_syntax(F.col(text), strict))
    if images is not None:
        out = out.withColumn(text, md.inject_image_ids(F.col(text), F.col(images)))
    out = out.withColumn(text, md.insert_breaks(F.col(text)))
    return out.withColumn(text, md.correct_spelling(F.col(text))) if correct else out


def extract_documents(
    documents: DataFrame,
    schema: str,
    extractor: Callable[[str, str], str] | None = None,
    done: DataFrame | None = None,
    chunk_by: str = "book",
) -> DataFrame:
    """Documents (path, text) to extraction output (id, source_path, data, error).

    Chunks that already have a successful record in ``done`` are left out.
    """
    chunks = segment.chunk_records(documents, schema, chunk_by)
    todo = chunks if done is None else records.pending(chunks, done)
    clean = normalize_spaces(drop_repeated_lines(sanitize_chunk(F.col("chunk_text"))))
    out = records.extract(todo.withColumn("chunk_text", clean), schema, extractor)
    return out.withColumn("source_path", F.regexp_replace("id", ":#[0-9]+$", ""))


def _typed(extracted: DataFrame, schema: str) -> DataFrame:
    good = extracted.where(F.col("error").isNull() & F.col("data").isNotNull())
    parsed = good.select(
        "id",
        "source_path",
        F.try_parse_json("data").alias("data"),
        F.parse_json(F.to_json(F.struct("source_path", "id"))).alias("meta"),
    )
    return records.coerce_records(parsed, schema)


def bucket_rows(
    extracted: DataFrame, schema: str, index_type: str, embed: Callable[[Column], Column] | None = None
) -> DataFrame:
    """Extraction output to bucket rows (index_type, id, text, metadata, vec): coerce, clean, render, embed.

    What is not good enough for a bucket is in ``rejected_rows``.
    """
    typed = _typed(extracted, schema).where(F.col("error").isNull()).drop("data", "error", "source_path")
    rows = records.retrieval_records(records.clean_records(typed, "record"), index_type)
    return rows if embed is None else rows.withColumn("vec", embed(F.col("text")))


def rejected_rows(extracted: DataFrame, schema: str) -> DataFrame:
    """(id, source_path, error) of all extraction output that ``bucket_rows`` leaves out."""
    failed = extracted.where(F.col("error").isNotNull() | F.col("data").isNull())
    failed = failed.select("id", "source_path", F.coalesce("error", F.lit("no data")).alias("error"))
    invalid = _typed(extracted, schema).where(F.col("error").isNotNull())
    return failed.unionByName(invalid.select("id", "source_path", "error"))


def route_table(spark: SparkSession, embed: Callable[[Column], Column]) -> DataFrame:
    """(index_type, boosted, vec): a route for each bucket from its text."""
    rows = [(name, name == fv.BOOST_BUCKET, text) for name, text in fv.ROUTE_TEXT.items()]
    routes = spark.createDataFrame(rows, "index_type string, boosted boolean, text string")
    return routes.withColumn("vec", embed(F.col("text"))).drop("text")


def answer_prompts(
    questions: DataFrame,
    routes: DataFrame,
    bucket: DataFrame,
    k_by_bucket: dict[str, int] | None = None,
    boost_words: tuple[str, ...] = fv.BOOST_WORDS,
    boost: float = fv.BOOST,
) -> DataFrame:
    """Questions (question_id, question, vec) to (question_id, question, index_type, context, prompt).

    ``bucket`` has (index_type, id, text, metadata, vec). Only ids and scores take part in the search;
    texts and metadata join the few rows that are left.
    """
    routed = search.route_questions(questions, routes, boost_words, boost)
    vectors = bucket.select("id", F.col("index_type").alias("bucket"), "vec")
    found = search.routed_topk(routed, vectors, k_by_bucket or fv.BUCKET_TOP_K)
    texts = bucket.select("index_type", "id", "text", F.try_parse_json("metadata").alias("_m"))
    named = found.join(texts, ["index_type", "id"], "left")

    def meta(name: str) -> Column:
        listed = F.array_join(F.try_variant_get("_m", f"$.{name}", "array<string>"), ", ")
        return F.coalesce(listed, F.try_variant_get("_m", f"$.{name}", "string"), F.lit(""))

    source = F.coalesce(F.nullif(meta("source_path"), F.lit("")), meta("source"))
    block = prompts.context_block(
        F.col("rank"),
        F.col("id").cast("string"),
        source,
        F.try_variant_get("_m", "$.chunk_index", "string"),
        F.col("score"),
        F.col("text"),
        {name: meta(name) for name in fv.CONTEXT_FIELDS},
    )
    contexts = prompts.join_contexts(named.withColumn("block", block), "question_id", "rank", "block")
    out = routed.select("question_id", "question", "index_type").join(contexts, "question_id", "left")
    return out.withColumn("prompt", prompts.answer_prompt(F.col("question"), F.col("context")))


def dataset_exports(items: DataFrame, order: list[str]) -> dict[str, DataFrame]:
    """OCR items to the four exports: totals, section entries, passages, retrieval documents."""
    entries = ocr.section_entries(ocr.sections(items, order))
    return {
        "metadata": ocr.dataset_totals(entries),
        "sections": entries,
        "passages": ocr.qa_passages(entries),
        "documents": ocr.retrieval_docs(entries),
    }


def evaluation_records(
    answers: DataFrame, retrieved: DataFrame, max_contexts: int = fv.CONTEXT_MAX, max_chars: int = fv.CONTEXT_MAX_CHARS
) -> DataFrame:
    """One row per answered question for a judge: (question_id, question, answer, contexts, ground_truth).

    ``answers`` has (question_id, question, answer, ground_truth); ``retrieved`` has (question_id,
    content, score, pos).
    """
    best = ev.select_contexts(retrieved, "question_id", "content", "score", "pos", max_contexts, max_chars)
    ordered = F.sort_array(F.collect_list(F.struct("rank", "context")))
    lists = best.groupBy("question_id").agg(F.transform(ordered, lambda c: c["context"]).alias("contexts"))
    joined = answers.withColumn("answer", clean_answer(F.col("answer"))).join(lists, "question_id", "left")
    return joined.withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))


def compare_runs(proposed: DataFrame, baseline: DataFrame, metrics=fv.SCORE_METRICS) -> dict[str, DataFrame]:
    """Summary, per-question differences, win/loss counts, top movers and examples of two prepared runs."""
    diffs = ev.differences(ev.common_questions(proposed, baseline, metrics), metrics)
    return {
        "summary": ev.summary(proposed, baseline, metrics),
        "differences": diffs,
        "win_loss": ev.win_loss(diffs, metrics),
        "movers": ev.top_movers(diffs),
        "examples": ev.examples(diffs, "answer_correctness" if "answer_correctness" in metrics else metrics[0]),
    }
