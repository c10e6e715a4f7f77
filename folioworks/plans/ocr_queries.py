"""OCR item and metrics queries. Line items stand for the items of scanned pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks.functions import text as tx
from folioworks.operators import metrics, ocr
from folioworks.plans.book_queries import WS
from folioworks.plans.document_queries import OVERLAP_SQL
from folioworks.plans.registry import query, table
from folioworks.sources import files

_ORDER = "page_num, item_no, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate"
ORDER = [c.strip() for c in _ORDER.split(",")]

_ITEMS = """SELECT l_suppkey AS doc, l_orderkey AS page_num, l_linenumber AS item_no, l_partkey, l_quantity, l_extendedprice, l_discount,
  l_tax, l_shipdate, l_discount = 0 AS skip,
  CASE WHEN l_linestatus = 'F' AND l_linenumber = 1 THEN 'heading' WHEN l_linenumber = 4 THEN 'image' ELSE 'paragraph' END AS element_type,
  CASE WHEN l_tax = 0.03 AND l_linenumber = 2 THEN '  '
       WHEN l_returnflag = 'R' AND l_linenumber = 6 THEN ' </break> '
       ELSE ' Mục ' || CAST(l_partkey AS STRING) || ' trang ' || CAST(l_orderkey AS STRING) || '. Dùng ' || CAST(l_suppkey AS STRING)
         || ' lần! ' || CASE WHEN l_returnflag = 'R' THEN '</break>' ELSE '' END END AS text,
  'img_' || CAST(l_partkey AS STRING) AS image_id, 'img/' || CAST(l_partkey AS STRING) || '.png' AS file_path
FROM {lineitem}"""


def items(spark, sf_dir):
    return spark.sql(_ITEMS, lineitem=table(spark, sf_dir, "lineitem"))


_SECTIONS = f"""items AS ({_ITEMS.format(lineitem='lineitem')}),
u AS (SELECT * REPLACE (trim(text, {WS}) AS text), element_type <> 'image' AND contains(text, '</break>') AS closes FROM items
  WHERE NOT skip AND trim(text, {WS}) <> ''),
g AS (SELECT *, sum(CAST(closes AS INT)) OVER (PARTITION BY doc ORDER BY {_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - CAST(closes AS INT) AS seg,
  row_number() OVER (PARTITION BY doc ORDER BY {_ORDER}) AS pos, trim(replace(text, '</break>', ''), {WS}) AS bare FROM u),
s1 AS (SELECT doc, seg, coalesce(arg_max(CASE WHEN closes THEN bare ELSE text END, pos) FILTER (WHERE element_type = 'heading'), '') AS heading,
  coalesce(string_agg(CASE WHEN closes THEN bare ELSE text END, ' ' ORDER BY pos) FILTER (WHERE element_type = 'paragraph'), '') AS full_text,
  count(*) FILTER (WHERE element_type = 'paragraph') AS n_content,
  coalesce(string_agg(image_id, ',' ORDER BY pos) FILTER (WHERE element_type = 'image'), '') AS image_ids,
  count(*) FILTER (WHERE element_type = 'image') AS image_count,
  coalesce(array_to_string(list_sort(list(DISTINCT page_num) FILTER (WHERE element_type <> 'image')), ','), '') AS page_range FROM g GROUP BY doc, seg),
secs AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY seg) AS section_id FROM s1 WHERE heading <> '' OR n_content > 0)"""

_ENTRIES = f"""{_SECTIONS},
texts AS (SELECT doc * 1000000 + section_id AS doc_id, full_text AS text FROM secs), {OVERLAP_SQL},
named AS (SELECT *, 'section_' || lpad(CAST(section_id AS VARCHAR), CAST(greatest(3, length(CAST(section_id AS VARCHAR))) AS INT), '0') AS id, doc * 1000000 + section_id AS doc_id FROM secs),
counts AS (SELECT doc_id, count(*) AS chunk_count FROM chunks GROUP BY doc_id)"""


def _pages(c="page_range"):
    return F.array_join(F.transform(c, lambda p: p.cast("string")), ",")


def entries(spark, sf_dir):
    return ocr.section_entries(ocr.sections(items(spark, sf_dir), ORDER))


_SECTIONS_SQL = f"WITH {_SECTIONS} SELECT doc, section_id, heading, full_text, image_ids, page_range FROM secs"


def _shown_sections(out):
    ids = F.array_join(F.transform("images", lambda i: i["image_id"]), ",")
    return out.select("doc", "section_id", "heading", "full_text", ids.alias("image_ids"), _pages().alias("page_range"))


@query("ocr_sections", _SECTIONS_SQL)
def ocr_sections(spark, sf_dir):
    return _shown_sections(ocr.sections(items(spark, sf_dir), ORDER))


@query("ocr_sections_blocked", _SECTIONS_SQL)
def ocr_sections_blocked(spark, sf_dir):
    """The same sections where documents are longer than a block, as for books of any length."""
    return _shown_sections(ocr.sections(items(spark, sf_dir), ORDER, rows_per_block=2000))


@query(
    "ordered_files",
    """SELECT row_number() OVER (ORDER BY path, page) - 1 AS position, path, page FROM (
  SELECT DISTINCT 'ocr/' || l_returnflag || l_linestatus || '/doc_' || l_suppkey || '.json' AS path, l_orderkey AS page FROM lineitem)""",
)
def ordered_files(spark, sf_dir):
    """Pages of the scanned files in order of path and page, numbered without gaps."""
    pages = table(spark, sf_dir, "lineitem").selectExpr(
        "'ocr/' || l_returnflag || l_linestatus || '/doc_' || l_suppkey || '.json' AS path", "l_orderkey AS page"
    )
    return files.ordered_files(pages.distinct(), "page").select("position", "path", "page")


@query(
    "section_entries",
    f"""WITH RECURSIVE {_ENTRIES} SELECT n.doc, n.id, n.heading, n.full_text, n.image_ids, n.page_range, n.image_count > 0 AS has_images, n.image_count,
  length(n.full_text) AS character_count, coalesce(c.chunk_count, 0) AS chunk_count FROM named n LEFT JOIN counts c ON c.doc_id = n.doc_id""",
)
def section_entries(spark, sf_dir):
    return entries(spark, sf_dir).select(
        "doc", "id", "heading", "full_text", F.array_join("image_ids", ",").alias("image_ids"), _pages().alias("page_range"),
        "has_images", "image_count", "character_count", "chunk_count",
    )


@query(
    "qa_passages",
    f"""WITH RECURSIVE {_ENTRIES} SELECT n.doc, n.id || '_chunk_' || c.chunk_id AS passage_id, n.heading AS section_heading, c.chunk_text AS text,
  n.id AS section_id, n.image_count > 0 AS has_images, n.page_range FROM named n JOIN chunks c ON c.doc_id = n.doc_id""",
)
def qa_passages(spark, sf_dir):
    p = ocr.qa_passages(entries(spark, sf_dir))
    return p.select(
        "doc", "passage_id", "section_heading", "text", "context.section_id", "context.has_images",
        _pages("context.page_range").alias("page_range"),
    )


@query(
    "retrieval_docs",
    f"""WITH RECURSIVE {_ENTRIES} SELECT n.doc, n.id, any_value(n.heading) AS title, any_value(n.full_text) AS content,
  coalesce(string_agg(c.chunk_text, '|' ORDER BY c.chunk_id), '') AS chunks, any_value(n.image_ids) AS image_ids
FROM named n LEFT JOIN chunks c ON c.doc_id = n.doc_id GROUP BY n.doc, n.id""",
)
def retrieval_docs(spark, sf_dir):
    d = ocr.retrieval_docs(entries(spark, sf_dir))
    return d.select(
        "doc", "id", "title", "content", F.array_join("chunks", "|").alias("chunks"),
        F.array_join("metadata.image_ids", ",").alias("image_ids"),
    )


@query(
    "section_stats",
    f"""WITH RECURSIVE {_ENTRIES} SELECT n.doc, count(*) AS sections, CAST(sum(length(n.full_text)) AS BIGINT) AS character_count, CAST(sum(coalesce(c.chunk_count, 0)) AS BIGINT) AS chunk_count,
  CAST(sum(n.image_count) AS BIGINT) AS image_count, count(*) FILTER (WHERE n.image_count > 0) AS with_images FROM named n LEFT JOIN counts c ON c.doc_id = n.doc_id GROUP BY n.doc""",
)
def section_stats(spark, sf_dir):
    return entries(spark, sf_dir).groupBy("doc").agg(
        F.count(F.lit(1)).alias("sections"),
        F.sum("character_count").alias("character_count"),
        F.sum("chunk_count").alias("chunk_count"),
        F.sum("image_count").alias("image_count"),
        F.count_if("has_images").alias("with_images"),
    )


@query(
    "dataset_totals",
    f"WITH {_SECTIONS} SELECT doc AS source_file, count(*) AS total_sections, count(*) AS total_entries, CAST(512 AS BIGINT) AS chunk_size, CAST(50 AS BIGINT) AS overlap FROM secs GROUP BY doc",
)
def dataset_totals(spark, sf_dir):
    return ocr.dataset_totals(entries(spark, sf_dir))


_TIE = "l_linenumber, l_partkey, l_suppkey, l_tax, l_discount, l_shipdate"


@query(
    "reading_order",
    f"""WITH o AS (SELECT *, row_number() OVER w AS reading_no, lag(l_quantity) OVER w AS py, lag(greatest(abs(l_tax * 100), 8)) OVER w AS ph FROM lineitem
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_quantity, l_extendedprice, {_TIE}))
SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, reading_no, round(CASE WHEN py IS NULL THEN 1.0 ELSE greatest(1.0, (l_quantity - py) / ph) END, 6) AS spacing FROM o""",
)
def reading_order(spark, sf_dir):
    boxes = table(spark, sf_dir, "lineitem").withColumn("height", F.col("l_tax") * 100)
    out = ocr.reading_order(
        boxes, ["l_orderkey"], "l_extendedprice", "l_quantity", "height", [c.strip() for c in _TIE.split(",")]
    )
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "reading_no", F.round("spacing", 6).alias("spacing"))


# --- metrics ------------------------------------------------------------------------------------


@query(
    "batch_status",
    """SELECT event_type, count(*) FILTER (WHERE value >= 5) AS n_success, count(*) FILTER (WHERE NOT value >= 5) AS n_failed,
  round(sum(value), 4) AS total_seconds, round(avg(value), 6) AS avg_seconds FROM events GROUP BY event_type""",
)
def batch_status(spark, sf_dir):
    out = metrics.batch_status(table(spark, sf_dir, "events"), "event_type", F.col("value") >= 5, "value")
    return out.withColumns(
        {"total_seconds": F.round("total_seconds", 4), "avg_seconds": F.round("avg_seconds", 6)}
    )


@query(
    "extraction_counts",
    """SELECT d.source, count(*) FILTER (WHERE l.quality = 1) AS n_ok, count(*) AS n_total FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY d.source""",
)
def extraction_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    joined = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return metrics.extraction_counts(joined, "source", F.col("quality") == 1)


@query(
    "pipeline_metrics",
    f"""WITH f AS (SELECT count(*) AS num_files, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS total_size_bytes FROM orders),
i AS (SELECT count(*) AS num_images, CAST(sum(CAST(floor(p_retailprice) AS BIGINT) * p_size) AS BIGINT) AS image_size_bytes FROM part),
t AS (SELECT CAST(sum(len(string_split(text, chr(10)))) AS BIGINT) AS num_lines,
  CAST(sum(len(regexp_extract_all(text, '(?m)^#+\\s')) + len(list_filter(string_split(text, chr(10)), lambda x: trim(x, {WS}) <> '')) + len(regexp_extract_all(text, '\\n\\|'))) AS BIGINT) AS num_samples,
  CAST(sum(strlen(text)) AS BIGINT) AS markdown_size_bytes FROM documents),
e AS (SELECT min(ts) AS a, max(ts) AS b FROM events)
SELECT num_files, total_size_bytes, num_images, image_size_bytes, num_lines, num_samples, markdown_size_bytes,
  markdown_size_bytes + image_size_bytes AS output_size_bytes, round((epoch_us(b) - epoch_us(a)) / 1000000.0, 6) AS processing_time_seconds FROM f, i, t, e""",
)
def pipeline_metrics(spark, sf_dir):
    files = table(spark, sf_dir, "orders").selectExpr("CAST(floor(o_totalprice) AS BIGINT) AS size_bytes")
    images = table(spark, sf_dir, "part").selectExpr("CAST(floor(p_retailprice) AS BIGINT) * p_size AS size_bytes")
    t = F.col("text")
    texts = table(spark, sf_dir, "documents").select(
        tx.line_count(t).alias("lines"),
        tx.sample_count(t, F.lit(0)).alias("samples"),
        F.octet_length(t).alias("size_bytes"),
    )
    out = metrics.pipeline_totals(files, images, texts, table(spark, sf_dir, "events").select("ts"))
    return out.drop("start_time", "end_time").withColumn(
        "processing_time_seconds", F.round("processing_time_seconds", 6)
    )


@query(
    "pipeline_previews",
    """WITH f AS (SELECT 'files' AS list, p_name || ' ' || p_partkey AS t, p_retailprice AS a, p_partkey AS b FROM part ORDER BY a DESC, b LIMIT 5),
e AS (SELECT 'errors' AS list, event_type || ' ' || event_id AS t, value AS a, event_id AS b FROM events WHERE event_type = 'error' ORDER BY b LIMIT 3)
SELECT list, string_agg(t, chr(10) ORDER BY a DESC, b) AS preview FROM f GROUP BY list UNION ALL SELECT list, string_agg(t, chr(10) ORDER BY b) FROM e GROUP BY list""",
)
def pipeline_previews(spark, sf_dir):
    part = table(spark, sf_dir, "part").selectExpr("*", "-p_retailprice AS a")
    files = metrics.preview(part, F.concat_ws(" ", "p_name", "p_partkey"), ["a", "p_partkey"], 5)
    errors = table(spark, sf_dir, "events").where("event_type = 'error'")
    shown = metrics.preview(errors, F.concat_ws(" ", "event_type", "event_id"), ["event_id"], 3)
    return files.select(F.lit("files").alias("list"), "preview").unionByName(
        shown.select(F.lit("errors").alias("list"), "preview")
    )
