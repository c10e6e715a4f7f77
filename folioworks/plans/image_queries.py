"""Image and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import text as tx
from folioworks.functions.core import to_lines
from folioworks.functions.markdown import image_refs
from folioworks.operators import images as im
from folioworks.operators import metrics, ocr
from folioworks.plans.books import LINES_CTE, books
from folioworks.plans.markdown_queries import refs_sql
from folioworks.plans.registry import query, table
from folioworks.session import shared_dir
from folioworks.streaming import ingest

# --- catalog ------------------------------------------------------------------------------------

_IMAGE = """SELECT sha2(p_name || p_brand, 256) AS id, 'img/' || p_type || '/' || CAST(p_partkey AS STRING) || '.png' AS stored_path, p_size * 10000 AS byte_size FROM {part}"""


def _images(spark, sf_dir):
    return spark.sql(_IMAGE, part=table(spark, sf_dir, "part"))


@query(
    "image_dedupe",
    f"""WITH i AS ({_IMAGE.format(part='part').replace('sha2(p_name || p_brand, 256)', 'sha256(p_name || p_brand)')}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stored_path) AS rn FROM i) SELECT id, stored_path, CAST(byte_size AS BIGINT) AS byte_size FROM r WHERE rn = 1""",
)
def image_dedupe(spark, sf_dir):
    return im.dedupe(_images(spark, sf_dir))


@query(
    "image_insert",
    f"""WITH i AS ({_IMAGE.format(part='part').replace('sha2(p_name || p_brand, 256)', 'sha256(p_name || p_brand)')}),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY stored_path) AS rn FROM i)
SELECT id, stored_path, CAST(byte_size AS BIGINT) AS byte_size FROM r WHERE rn = 1 AND id NOT IN (SELECT id FROM i WHERE byte_size = 250000)""",
)
def image_insert(spark, sf_dir):
    incoming = _images(spark, sf_dir)
    return im.insert_new(incoming.where("byte_size = 250000"), incoming)


@query(
    "image_index",
    """SELECT p_brand AS source, p_partkey AS id, p_partkey || '.png' AS filename, 'img/' || p_type || '/' || p_partkey || '.png' AS path,
  count(*) OVER (PARTITION BY p_brand) AS total_images FROM part""",
)
def image_index(spark, sf_dir):
    src = table(spark, sf_dir, "part").selectExpr(
        "p_brand AS source", "p_partkey", "'img/' || p_type || '/' || CAST(p_partkey AS STRING) || '.png' AS path"
    )
    return metrics.image_index(src, "source", "p_partkey", "path")


_PATHS = "CASE p_partkey % 7 WHEN 0 THEN 'a/x.PNG' WHEN 1 THEN 'b.jpg' WHEN 2 THEN 'c.jpeg' WHEN 3 THEN 'd.webp' WHEN 4 THEN 'e.txt' WHEN 5 THEN 'noext' ELSE 'f.gif' END"


@query(
    "mime_data_urls",
    f"""WITH m AS (SELECT p_partkey, p_name, lower(regexp_extract({_PATHS}, '\\.([^.]+)$', 1)) AS s FROM part)
SELECT p_partkey, 'data:' || CASE s WHEN 'png' THEN 'image/png' WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'webp' THEN 'image/webp'
  WHEN 'gif' THEN 'image/gif' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(p_name)) AS url FROM m""",
)
def mime_data_urls(spark, sf_dir):
    src = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_PATHS} AS path", "CAST(p_name AS BINARY) AS data")
    return src.select("p_partkey", tx.data_url(tx.mime_type(F.col("path")), F.col("data")).alias("url"))


@query(
    "chunk_images",
    """WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS at FROM lineitem GROUP BY l_orderkey, l_partkey),
j AS (SELECT f.l_orderkey, f.l_partkey, f.at, p.p_name, row_number() OVER (PARTITION BY f.l_orderkey ORDER BY f.at, f.l_partkey) AS rank
  FROM f JOIN part p ON p.p_partkey = f.l_partkey WHERE p.p_size * 10000 <= 250000)
SELECT l_orderkey, rank, l_partkey AS id, p_name FROM j WHERE rank <= 2""",
)
def chunk_images(spark, sf_dir):
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    stored = table(spark, sf_dir, "part").selectExpr("p_partkey AS id", "p_name", "p_size * 10000 AS byte_size")
    out = im.answer_images(found, stored, "l_orderkey", "l_linenumber", "l_partkey", max_images=2)
    return out.select("l_orderkey", "rank", "id", "p_name")


@query(
    "chunk_images_data",
    """WITH f AS (SELECT l_orderkey, l_partkey, min(l_linenumber) AS at FROM lineitem GROUP BY l_orderkey, l_partkey),
j AS (SELECT f.l_orderkey, f.l_partkey, f.at, p.p_name, row_number() OVER (PARTITION BY f.l_orderkey ORDER BY f.at, f.l_partkey) AS rank
  FROM f JOIN part p ON p.p_partkey = f.l_partkey WHERE p.p_size * 10000 <= 250000)
SELECT l_orderkey, rank, l_partkey AS id, md5(repeat(p_name, 50)) AS data_md5 FROM j WHERE rank <= 2""",
)
def chunk_images_data(spark, sf_dir):
    """The same with the images' bytes, which are fetched for the images that are left."""
    found = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    stored = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id", "p_size * 10000 AS byte_size", "encode(repeat(p_name, 50), 'UTF-8') AS data"
    )
    out = im.answer_images(found, stored, "l_orderkey", "l_linenumber", "l_partkey", max_images=2)
    return out.select("l_orderkey", "rank", "id", F.md5("data").alias("data_md5"))


# --- references ---------------------------------------------------------------------------------

_FILES_SQL = """files AS (SELECT DISTINCT regexp_replace(b.path, '/[^/]*$', '') || CASE WHEN r.i % 5 = 4 THEN '/khac/' WHEN r.i % 3 = 0 THEN '/' ELSE '/extracted_images/' END
  || r.source_filename AS file FROM r JOIN books b ON b.book_id = r.book_id)"""


def _refs(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", "path", F.inline(image_refs(F.col("text"))))


@query(
    "resolve_images",
    f"""{LINES_CTE}, {refs_sql('r')}, {_FILES_SQL},
c AS (SELECT r.book_id, r.i AS line_no, r.source_filename, regexp_replace(b.path, '/[^/]*$', '') AS dir FROM r JOIN books b ON b.book_id = r.book_id)
SELECT c.book_id, c.line_no, c.source_filename, coalesce(a.file, e.file) AS file_path FROM c
LEFT JOIN files a ON a.file = c.dir || '/' || c.source_filename LEFT JOIN files e ON e.file = c.dir || '/extracted_images/' || c.source_filename""",
)
def resolve_images(spark, sf_dir):
    refs = _refs(spark, sf_dir)
    folder = im.folder_of(F.col("path"))
    at = F.col("line_no")
    sub = F.when(at % 5 == 4, "/khac/").when(at % 3 == 0, "/").otherwise(f"/{fv.IMAGE_FOLDER}/")
    files = refs.select(F.concat(folder, sub, F.col("source_filename")).alias("path"))
    return im.resolve(refs, files).select("book_id", "line_no", "source_filename", "file_path")


_URLS_SQL = """u1 AS (SELECT book_id, i, regexp_extract_all(line, '!\\[[^\\]]*\\]\\(([^\\)]+)\\)', 1) || regexp_extract_all(line, '(?i)<img[^>]+src=["'']([^"'']+)["'']', 1) AS us FROM lines),
u2 AS (SELECT book_id, i, unnest(us) AS u, unnest(range(len(us))) AS k FROM u1),
u3 AS (SELECT book_id, i, k, replace(split_part(trim(u), ' ', 1), '\\', '/') AS url FROM u2 WHERE NOT regexp_matches(trim(u), '^(http://|https://|data:)')),
urls AS (SELECT * FROM u3 WHERE lower(regexp_extract(url, '\\.([^./]+)$', 1)) IN ('png', 'jpg', 'jpeg', 'webp', 'gif')),
cited AS (SELECT book_id, i + 1 AS line FROM lines WHERE regexp_matches(line, '^#{1,6}\\s+')),
n1 AS (SELECT c.book_id, c.line, u.url, min(u.i * 1000 + u.k) AS pos FROM cited c JOIN urls u ON u.book_id = c.book_id AND u.i >= c.line - 1 - 30 AND u.i < c.line - 1 + 30 GROUP BY c.book_id, c.line, u.url),
near AS (SELECT *, row_number() OVER (PARTITION BY book_id, line ORDER BY pos) AS rank FROM n1)"""


def _cited(spark, sf_dir):
    rows = books(spark, sf_dir).select("book_id", F.posexplode(to_lines(F.col("text"))).alias("i", "x"))
    return rows.where(F.col("x").rlike(r"^#{1,6}\s+")).select("book_id", (F.col("i") + 1).alias("line"))


def _near(spark, sf_dir):
    return im.images_near_line(
        _cited(spark, sf_dir), im.local_images(books(spark, sf_dir), "book_id"), "book_id", "line"
    )


@query("local_image_urls", f"{LINES_CTE}, {_URLS_SQL} SELECT book_id, i AS line_no, k, url FROM urls")
def local_image_urls(spark, sf_dir):
    return im.local_images(books(spark, sf_dir), "book_id")


@query("images_near_line", f"{LINES_CTE}, {_URLS_SQL} SELECT book_id, line, rank, url FROM near WHERE rank <= 3")
def images_near_line(spark, sf_dir):
    return _near(spark, sf_dir)


@query(
    "image_fallback",
    f"""{LINES_CTE}, {_URLS_SQL}, {refs_sql('r')},
own AS (SELECT book_id, line, CASE WHEN line % 4 = 0 THEN 'own_' || line || '.png' END AS img FROM cited),
nl AS (SELECT book_id, line, string_agg(url, '|' ORDER BY rank) AS t FROM near WHERE rank <= 3 GROUP BY book_id, line),
fo AS (SELECT book_id, min(source_filename) AS t FROM r GROUP BY book_id)
SELECT o.book_id, o.line, coalesce(o.img, nl.t, fo.t, '') AS shown, CASE WHEN o.img IS NOT NULL THEN 'record' WHEN nl.t IS NOT NULL THEN 'near'
  WHEN fo.t IS NOT NULL THEN 'folder' ELSE 'none' END AS origin
FROM own o LEFT JOIN nl ON nl.book_id = o.book_id AND nl.line = o.line LEFT JOIN fo ON fo.book_id = o.book_id""",
)
def image_fallback(spark, sf_dir):
    chunks = _cited(spark, sf_dir).withColumn(
        "images",
        F.when(F.col("line") % 4 == 0, F.array(F.concat(F.lit("own_"), F.col("line").cast("string"), F.lit(".png")))),
    )
    folder = _refs(spark, sf_dir).select("book_id", F.col("source_filename").alias("path"))
    out = im.image_fallback(chunks, _near(spark, sf_dir), folder, "book_id", "line")
    return out.select("book_id", "line", F.array_join("shown", "|").alias("shown"), "origin")


@query(
    "page_elements",
    """SELECT l_orderkey AS page_num, CASE WHEN l_linenumber = 3 THEN 'table' ELSE 'paragraph' END AS element_type, CAST(CASE WHEN l_linenumber = 3 THEN 2 ELSE 0 END AS BIGINT) AS part,
  CASE WHEN l_linenumber = 3 THEN l_linenumber || '.' || l_partkey || ' mục' ELSE l_linenumber || '.' || l_partkey || ' mục </break>' END AS text FROM lineitem
UNION ALL SELECT o_orderkey, 'image', 1, NULL FROM orders""",
)
def page_elements(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS page_num", "CASE WHEN l_linenumber = 3 THEN 'table' END AS element_type",
        "CAST(l_linenumber AS STRING) || '.' || CAST(l_partkey AS STRING) || ' mục' AS text",
    )
    pictures = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS page_num")
    return ocr.page_elements(items, pictures).select("page_num", "element_type", "part", "text")


# --- streaming ----------------------------------------------------------------------------------


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"


@query(
    "stream_upsert",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""",
)
def stream_upsert(spark, sf_dir):
    folder = _folder(spark)
    rows = _event_stream(spark, sf_dir).select("user_id", "event_type", "event_id", "value")
    ingest.append_batches(rows, f"{folder}/store", f"{folder}/checkpoint").awaitTermination()
    return ingest.read_latest(spark, f"{folder}/store", ["user_id", "event_type"], "event_id")


@query(
    "stream_resume",
    "SELECT DISTINCT 'u' || user_id || ':#' || event_type AS id, true AS has_data FROM events",
)
def stream_resume(spark, sf_dir):
    folder = _folder(spark)
    chunks = _event_stream(spark, sf_dir).selectExpr(
        "'u' || CAST(user_id AS STRING) || ':#' || event_type AS id", "props AS chunk_text"
    )
    ingest.extract_pending(chunks, f"{folder}/out", f"{folder}/checkpoint", "RemedyRecipe").awaitTermination()
    return ingest.read_batches(spark, f"{folder}/out").select("id", F.col("data").isNotNull().alias("has_data"))
