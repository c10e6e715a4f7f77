"""Markdown books made from the documents table.

Fifty consecutive documents form a book, so a book is bounded whatever the table's size and however
the sources are spread. Each document adds a heading in the style of one of the known books and
now and then an image, a table, a page marker, OCR noise and so on. The same SQL body runs in Spark
and in the checking engine; only the ordered join of the pieces is spelled per engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioworks.plans.registry import table

DOCS_PER_BOOK = 50

_BODY = """
numbered AS (SELECT doc_id, CAST(floor(doc_id / 50.0) AS BIGINT) AS book_id, text FROM {documents}),
d AS (
  SELECT doc_id, book_id, text, book_id % 5 AS kind, split_part(split_part(text, ' ', 1), chr(10), 1) AS w,
         row_number() OVER (PARTITION BY book_id ORDER BY doc_id) AS n
  FROM numbered
),
e AS (
  SELECT doc_id, book_id, kind, text, w, upper(replace(w, 'ß', 'ss')) AS cap, n, CAST(n AS STRING) AS ns,
         CAST(doc_id AS STRING) AS ds
  FROM d
),
pieces AS (
  SELECT book_id, kind, doc_id, concat_ws(chr(10),
    CASE WHEN kind = 0 AND n = 16 THEN '# Phần hai'
         WHEN kind = 0 AND n = 31 THEN '## II - KĨ THUẬT LÀM NƯỚC GIẢI KHÁT TỪ TRÁI CÂY'
         WHEN kind = 2 AND n = 1 THEN '# PHẦN THỨ NHẤT'
         WHEN kind = 2 AND n = 6 THEN '# PHẦN THỨ HAI'
         WHEN kind = 2 AND n = 36 THEN '# PHẦN THỨ BA'
         WHEN kind = 3 AND n = 1 THEN concat_ws(chr(10), '1.', 'RẮN CẮN', '2.', 'SAY NẮNG', '3.', 'SỐC', '4.', 'BỎNG') END,
    CASE WHEN kind = 0 AND n < 16 THEN '## ' || ns || '. CÂY ' || cap
         WHEN kind = 0 AND n < 31 THEN '### ' || ns || '. CÂY ' || cap
         WHEN kind = 0 THEN '### ' || ns || '. NƯỚC ' || cap
         WHEN kind = 1 AND n % 14 = 0 THEN '## MỤC LỤC ' || cap
         WHEN kind = 1 AND n % 7 = 0 THEN '## ĐẬU BẮP'
         WHEN kind = 1 AND n % 3 = 0 THEN '#### ' || ns || ') ' || cap
         WHEN kind = 1 AND n % 3 = 1 THEN '#### (' || ns || ') ' || cap
         WHEN kind = 1 THEN '### ' || ns || ' ' || cap
         WHEN kind = 2 AND n >= 36 AND n % 2 = 0 THEN '#### **' || ns || '. ' || cap || ' CÔN BỐ**'
         WHEN kind = 2 AND n >= 36 THEN '# ' || ns || ' ' || cap || ' BỐ'
         WHEN kind = 2 AND n % 6 = 5 THEN '# ' || ns || '. ' || w || ' thường:'
         WHEN kind = 2 THEN '# **' || ns || '. BỆNH ' || cap || '**'
         WHEN kind = 3 AND n % 3 = 0 THEN concat_ws(chr(10), ns || '.', '', 'ĐỘT QUỴ ' || cap)
         WHEN kind = 3 THEN ns || '. NGỘ ĐỘC ' || cap
         ELSE '## ' || ns || '. ' || cap END,
    CASE WHEN kind = 0 AND n >= 31 AND doc_id % 3 <> 2
         THEN concat_ws(chr(10), 'hai cách làm:', '', '#### a) ' || w, 'bước một: ' || text) END,
    CASE WHEN kind = 0 AND n >= 31 AND doc_id % 3 = 0 THEN '##### B) ' || w || ' mới:' END,
    CASE WHEN kind = 1 AND n % 4 = 0 THEN concat_ws(chr(10), '1. ' || w || ' chung', 'hình dưới',
           '![](![id: khia_' || ds || '](khia_' || ds || '.png))', '', cap || ' KHÍA', w || ' khía',
           cap || ' HƯƠNG', w || ' hương', text, '2. ' || w || ' thuốc') END,
    CASE WHEN kind = 2 AND n BETWEEN 6 AND 35 AND n % 2 = 0 THEN concat_ws(chr(10), '#### *1. Thể ' || w || ':*', text,
           '#### 2. Chứng ' || w || ':') END,
    CASE WHEN kind = 2 AND n BETWEEN 6 AND 35 AND n % 5 = 0 THEN '## Các bài thuốc kinh nghiệm' END,
    CASE WHEN doc_id % 4 = 0 THEN concat_ws(chr(10), '', '', '  ') END,
    CASE WHEN doc_id % 5 = 0 THEN '![](![id: img_' || ds || '](img_' || ds || '.png))' END,
    CASE WHEN doc_id % 6 = 0 THEN 'xem ![hình](figs/h_' || ds || '.jpg) và <img alt="x" src="anh_' || ds || '.webp">' END,
    CASE WHEN doc_id % 7 = 0 THEN concat_ws(chr(10), '| a | b |', '|---|---|', '| ' || w || ' | ' || ns || ' | thừa |') END,
    CASE WHEN doc_id % 9 = 0 THEN '*' || w || '* **' || w || '** ***vừa*** `x` [a](b) H<sub>2</sub>O x<sup>2</sup> $a+b$ __đậm__ _nghiêng_' END,
    CASE WHEN doc_id % 11 = 0 THEN concat_ws(chr(10), '<!-- page=' || ns || ' -->', '## Page ' || ns, 'hết </break> trang', '</break>') END,
    CASE WHEN doc_id % 13 = 0 THEN 'c ó t h ể l à thu ốc , 5 . 2 g ( x ) đ ược $l à$ <b>l à</b> l à' END,
    CASE WHEN doc_id % 17 = 0 THEN concat_ws(chr(10), '#' || w, '-' || w, '1.' || w, '>' || w, '**' || w || ' đậm',
           '*' || w, '[' || w, 'x | y', '  |--|--', '(' || w || ' hở') END,
    CASE WHEN doc_id % 19 = 0 THEN '[IMAGE_PLACEHOLDER_' || ds || ']' END,
    CASE WHEN doc_id % 23 = 0 THEN concat_ws(chr(10), '2.' || ns || ' ' || w, 'a) ' || w, 'iv) ' || w, '---', '> trích', '- mục', 'một<br>hai') END,
    text) AS piece
  FROM e
),
books AS (
  SELECT book_id, kind,
         CASE kind WHEN 0 THEN 'raw/cay-canh--cay-thuoc/' WHEN 1 THEN 'raw/cay-rau-lam-thuoc/'
                   WHEN 2 THEN 'raw/noi-tiet/' WHEN 3 THEN 'raw/cc_va_chong_doc/' ELSE 'raw/khac/' END
           || 'tap-' || CAST(book_id AS STRING) || '.md' AS path,
         {join} AS text
  FROM pieces GROUP BY book_id, kind
)
"""

# Prefix for checking SQL: everything up to and including the relation ``books``.
BOOKS_CTE = "WITH " + _BODY.format(
    documents="documents", join="string_agg(piece, chr(10) ORDER BY doc_id)"
)

# The same, cut into ``lines(book_id, kind, path, i, line)`` with ``i`` counting from 0.
LINES_CTE = (
    BOOKS_CTE
    + """,
lines AS (
  SELECT book_id, kind, path, unnest(string_split(text, chr(10))) AS line,
         unnest(range(len(string_split(text, chr(10))))) AS i
  FROM books
)
"""
)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DataFrame (book_id, kind, path, text)."""
    body = _BODY.replace("{join}", "listagg(piece, chr(10)) WITHIN GROUP (ORDER BY doc_id)")
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return spark.sql(f"WITH {body} SELECT * FROM books", documents=documents)
