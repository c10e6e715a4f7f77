"""Queries through files: the given tables are written to the shared folder and read back by the sources."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import text as tx
from folioworks.operators import prompts, store
from folioworks.operators.sampling import first_rows
from folioworks.plans.registry import query, table
from folioworks.session import shared_dir
from folioworks.sources import files, sinks
from folioworks.streaming import ingest


def folder(spark) -> str:
    return f"{shared_dir(spark)}/queries/{uuid.uuid4().hex}"


# --- records ------------------------------------------------------------------------------------

# Some records lack what the schema needs, some have keys that it lacks or NULLs, some lines are broken.
_DATA = (
    "'{' || CASE WHEN event_id % 4 = 0 THEN '' ELSE '\"recipe_name\": \"' || event_type || '\", ' END"
    " || '\"extra\": null, \"k\": ' || CAST(event_id AS STRING) || ', \"source_plant\": \"p' || CAST(user_id AS STRING) || '\", \"usage_instructions\": \"u\"}'"
)
_META = "'{\"id\": \"e' || CAST(event_id AS STRING) || '\", \"source_path\": \"' || event_type || '.md\"}'"
_LINE = (
    f"CASE event_id % 7 WHEN 5 THEN '{{bad' WHEN 6 THEN '{{\"data\": ' || {_DATA} || '}}'"
    f" ELSE '{{\"data\": ' || {_DATA} || ', \"meta\": ' || {_META} || '}}' END"
)


@query(
    "bucket_records",
    """SELECT 'e' || event_id AS id, event_id % 4 = 0 AS invalid,
  '{"id":"e' || event_id || '","source_path":"' || event_type || '.md","extra":null,"k":' || event_id
  || CASE WHEN event_id % 4 = 0 THEN '' ELSE ',"recipe_name":"' || event_type || '"' END
  || ',"source_plant":"p' || user_id || '","usage_instructions":"u","index_type":"remedies"}' AS metadata
FROM events WHERE event_id % 7 NOT IN (5, 6)""",
)
def bucket_records(spark, sf_dir):
    path = folder(spark)
    table(spark, sf_dir, "events").selectExpr(f"{_LINE} AS value").write.text(path)
    rows = files.read_records(spark, path, schema="RemedyRecipe", index_type="remedies")
    return rows.select("id", F.col("error").isNotNull().alias("invalid"), "metadata")


@query(
    "extraction_sink",
    """SELECT 'd' || doc_id || ':#0' AS id, doc_id % 3 = 0 AS failed, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE n_chars END AS n FROM documents""",
)
def extraction_sink(spark, sf_dir):
    path = folder(spark)
    out = table(spark, sf_dir, "documents").selectExpr(
        "'d' || doc_id || ':#0' AS id",
        "'d' || doc_id AS source_path",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE '{\"n\": ' || n_chars || '}' END AS data",
        "CASE WHEN doc_id % 3 = 0 THEN 'failed' END AS error",
    )
    sinks.write_extraction(out, path)
    good = files.read_jsonl(spark, f"{path}/status=ok").select(
        "id", F.lit(False).alias("failed"), F.try_variant_get("data", "$.n", "bigint").alias("n")
    )
    lines = spark.read.text(f"{path}/status=error").select(F.get_json_object("value", "$.meta.id").alias("id"))
    return good.unionByName(lines.withColumns({"failed": F.lit(True), "n": F.lit(None).cast("bigint")}))


@query(
    "extraction_retries",
    """SELECT DISTINCT 'u' || user_id AS id, 1 AS n_data, CASE WHEN user_id % 3 = 0 AND user_id IN (SELECT user_id FROM events WHERE event_id % 2 = 0) THEN 1 ELSE 0 END AS n_failed
FROM events""",
)
def extraction_retries(spark, sf_dir):
    """Two runs: in the first, a third of the chunks fails; the second gets new ones and tries those again."""
    path = folder(spark)
    chunks = table(spark, sf_dir, "events").selectExpr(
        "'u' || user_id AS id", "'u' || user_id AS chunk_text", "event_id % 2 AS half"
    )

    def first(text: str, schema: str) -> str:
        if int(text[1:]) % 3 == 0:
            raise ValueError("no answer")
        return "{}"

    for half, extractor in ((0, first), (1, lambda text, schema: "{}")):
        chunks.where(F.col("half") == half).drop("half").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("id string, chunk_text string").parquet(f"{path}/in")
        ingest.extract_pending(stream, f"{path}/out", f"{path}/ck", "RemedyRecipe", extractor).awaitTermination()
    out = ingest.read_batches(spark, f"{path}/out")
    return out.groupBy("id").agg(F.count("data").alias("n_data"), F.count("error").alias("n_failed"))


@query(
    "extraction_prompts",
    f"""SELECT 's/' || source || '.md:#' || doc_id AS id, contains(replace('{fv.EXTRACTION_HEAD.replace(chr(39), chr(39) * 2)}', 'x', 'x'), 'JSON') AS asks,
  'source=' || source || '.md chunk=' || doc_id AS hint FROM documents""",
)
def extraction_prompts(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").selectExpr(
        "'s/' || source || '.md:#' || doc_id AS id", "'s/' || source || '.md' AS source_path",
        "doc_id AS chunk_index", "text AS chunk_text",
    )
    shown = prompts.extraction_prompts(chunks, "RemedyRecipe", '{"type": "object"}')
    head = F.lit(fv.EXTRACTION_HEAD)
    rest = F.substr("prompt", F.length(head) + 1)
    return shown.select(
        "id", F.startswith("prompt", head).alias("asks"), F.substring_index(rest, "\n", 1).alias("hint")
    )


# --- texts, scores, images, buckets -------------------------------------------------------------


@query(
    "markdown_files",
    """SELECT source, md5(string_agg(text, chr(10) ORDER BY doc_id) || chr(10)) AS digest FROM documents GROUP BY source""",
)
def markdown_files(spark, sf_dir):
    path = folder(spark)
    sinks.write_markdown(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), path)
    found = files.read_markdown(spark, path, "*.txt")
    listed = files.list_files(spark, path, "*.txt").where("size_bytes > 0").select("path")
    runs = found.join(listed, "path").select(
        F.regexp_extract("path", "source=([^/]+)/", 1).alias("source"),
        F.regexp_extract("path", "run=([0-9]+)/", 1).cast("long").alias("run"),
        "text",
    )
    # The digest of a whole source is one chain over its files: they pass by one at a time, never as one string.
    ordered = runs.repartition("source").sortWithinPartitions("source", "run").select("source", "text")
    return ordered.mapInArrow(_digests, "source string, digest string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Source and MD5 of all its texts, one after the other."""
    source, digest = None, None
    for batch in batches:
        for here, text in zip(*batch.columns, strict=True):
            if digest is None or here.as_py() != source:
                if digest is not None:
                    yield pa.RecordBatch.from_pylist([{"source": source, "digest": digest.hexdigest()}])
                source, digest = here.as_py(), hashlib.md5()
            digest.update(text.as_buffer())
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"source": source, "digest": digest.hexdigest()}])


@query(
    "question_files",
    """SELECT row_number() OVER (ORDER BY doc_id) - 1 AS id, CASE WHEN doc_id % 5 = 0 THEN 'Unknown' ELSE lang END AS difficulty, md5(trim(text, chr(10) || chr(9) || ' ')) AS question, source AS ground_truth FROM documents""",
)
def question_files(spark, sf_dir):
    path = folder(spark)
    docs = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", f"if(doc_id % 5 = 0, null, lang) AS `{fv.DIFFICULTY_COLUMN}`", f"text AS `{fv.QUESTION_COLUMN}`",
        f"source AS `{fv.REFERENCE_COLUMN}`",
    )
    # Files as many as the rows need, without ids: rows are numbered by file and place.
    docs = docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").drop("doc_id")
    sinks.write_scores(docs, path)
    found = files.read_questions(spark, path)
    return found.select("id", "difficulty", F.md5("question").alias("question"), "ground_truth")


@query(
    "score_files",
    """SELECT event_type, count(*) AS n, round(avg(event_id % 97 / 97.0), 6) AS m0, round(avg(CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 89 / 89.0 END), 6) AS m1 FROM events GROUP BY event_type""",
)
def score_files(spark, sf_dir):
    path = folder(spark)
    first, second, *rest = fv.SCORE_METRICS
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_type || ' \"' || event_id || '\", x' AS user_input", "props AS response", f"event_id % 97 / 97.0 AS {first}",
        f"if(event_id % 5 = 0, 'none', string(event_id % 89 / 89.0)) AS {second}", *[f"1.0 AS {m}" for m in rest],
    )
    sinks.write_scores(rows, path)
    run = files.read_scores(spark, path)
    kind = F.substring_index("user_input", " ", 1).alias("event_type")
    out = run.groupBy(kind).agg(F.count_distinct("row_id").alias("n"), F.avg(first).alias("m0"), F.avg(second).alias("m1"))
    return out.select("event_type", "n", F.round("m0", 6).alias("m0"), F.round("m1", 6).alias("m1"))


@query("bucket_files", "SELECT vec_id AS id, len(embedding) AS dim FROM embeddings WHERE label = 3")
def bucket_files(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "embeddings").selectExpr("'b' || label AS index_type", "vec_id AS id", "embedding AS vec")
    sinks.write_buckets(rows, path)
    found = files.read_bucket(spark, path, "b3", dim=64)
    return found.select("id", F.size("vec").alias("dim"))


@query("saved_results", "SELECT event_id, value FROM events")
def saved_results(spark, sf_dir):
    path = folder(spark)
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    ingest.save_results(stream.select("event_id", "value"), f"{path}/out", f"{path}/ck").awaitTermination()
    return spark.read.option("header", "true").schema("event_id bigint, value double").csv(f"{path}/out")


@query("passage_files", "SELECT source AS doc, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY source")
def passage_files(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "documents").selectExpr("source AS doc", "doc_id", "text")
    sinks.write_passages(rows, path, "doc_id")
    back = spark.read.schema("doc string, doc_id bigint, text string").json(path)
    return back.groupBy("doc").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("content_hashes", "SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tx.content_hash(F.col("text").cast("binary")).alias("digest"))


@query("first_documents", "SELECT doc_id, source FROM documents ORDER BY source, doc_id LIMIT 25")
def first_documents(spark, sf_dir):
    return first_rows(table(spark, sf_dir, "documents"), 25, "source", "doc_id").select("doc_id", "source")


@query(
    "bucket_checks",
    "SELECT 'b' || label AS index_type, count(*) AS n FROM embeddings GROUP BY label",
)
def bucket_checks(spark, sf_dir):
    """Only the key is asked for; the check of the vectors' sizes runs all the same."""
    rows = table(spark, sf_dir, "embeddings").selectExpr("'b' || label AS index_type", "vec_id AS id", "embedding AS vec")
    good = store.checked(rows, store.index_stats(rows))
    return good.groupBy("index_type").agg(F.count("*").alias("n"))
