"""Text clean-up, chunking, names and ids over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import splitters as sp
from folioworks.functions import text as tx
from folioworks.operators import segment as seg
from folioworks.plans.book_queries import WS, caps_sql
from folioworks.plans.registry import query, spread, table


def documents(spark, sf_dir, *exprs: str):
    """Documents with extra columns, given as SQL both engines read alike."""
    return spread(table(spark, sf_dir, "documents")).selectExpr("doc_id", *exprs)


def _lines_sql(expr: str) -> str:
    return f"""WITH src AS (SELECT doc_id, {expr} AS t FROM documents),
lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM src)"""


def spaces_sql(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), {WS})"


def collapse_sql(x: str) -> str:
    return f"regexp_replace(trim({x}, {WS}), '[\\s\\x{{a0}}]+', ' ', 'g')"


# --- whitespace ---------------------------------------------------------------------------------

_PADDED = "chr(10) || '  ' || chr(10) || '   ' || text || chr(10) || chr(10) || ' ' || chr(10)"


@query(
    "trim_blank_edges",
    _lines_sql(_PADDED)
    + f""", e AS (SELECT *, min(CASE WHEN trim(line, {WS}) <> '' THEN i END) OVER (PARTITION BY doc_id) AS lo,
  max(CASE WHEN trim(line, {WS}) <> '' THEN i END) OVER (PARTITION BY doc_id) AS hi FROM lines)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE i BETWEEN lo AND hi), '') AS text FROM e GROUP BY doc_id""",
)
def trim_blank_edges(spark, sf_dir):
    return documents(spark, sf_dir, f"{_PADDED} AS t").select("doc_id", tx.trim_blank_edges(F.col("t")).alias("text"))


_SPACED = "'  ' || replace(replace(text, ' ', '  '), '.', '.' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10)) || chr(10)"


@query("ws_normalize", f"SELECT doc_id, {spaces_sql(_SPACED)} AS text FROM documents")
def ws_normalize(spark, sf_dir):
    return documents(spark, sf_dir, f"{_SPACED} AS t").select("doc_id", tx.normalize_spaces(F.col("t")).alias("text"))


_NBSP = "' ' || replace(text, ' ', chr(160) || ' ') || chr(160)"


@query("key_normalize", f"SELECT doc_id, {collapse_sql(_NBSP)} AS key FROM documents")
def key_normalize(spark, sf_dir):
    return documents(spark, sf_dir, f"{_NBSP} AS t").select("doc_id", tx.join_key(F.col("t")).alias("key"))


# --- repeats ------------------------------------------------------------------------------------


def repeats_sql(src: str) -> str:
    """CTE ``deduped(doc_id, t)`` from ``lines``."""
    return f"""p AS (SELECT *, lag(trim(line, {WS})) OVER (PARTITION BY doc_id ORDER BY i) AS above FROM {src}),
deduped AS (SELECT doc_id, trim(string_agg(rtrim(line, {WS}), chr(10) ORDER BY i), {WS}) AS t FROM p
  WHERE above IS NULL OR above <> trim(line, {WS}) GROUP BY doc_id)"""


def first_of_each_sql(src: str, sep: str = "' '") -> str:
    """CTE ``firsts(doc_id, t)`` from ``src(doc_id, item, k)``."""
    return f"""n AS (SELECT doc_id, k, {spaces_sql('item')} AS item FROM {src}),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY k) AS rn FROM n WHERE item <> ''),
firsts AS (SELECT doc_id, string_agg(item, {sep} ORDER BY k) AS t FROM r WHERE rn = 1 GROUP BY doc_id)"""


def sentences_sql(src: str, column: str = "t") -> str:
    cut = f"string_split(regexp_replace({spaces_sql(column)}, '([.!?。؛;])\\s+', '\\1' || chr(1), 'g'), chr(1))"
    return f"sentences AS (SELECT doc_id, unnest({cut}) AS item, unnest(range(len({cut}))) AS k FROM {src})"


@query("dedupe_consecutive_lines", f"{_lines_sql('text')}, {repeats_sql('lines')} SELECT doc_id, t AS text FROM deduped")
def dedupe_consecutive_lines(spark, sf_dir):
    return documents(spark, sf_dir, "text AS t").select("doc_id", tx.drop_repeated_lines(F.col("t")).alias("text"))


@query(
    "dedupe_sentences",
    f"""WITH {sentences_sql('documents', 'text')}, {first_of_each_sql('sentences')}
SELECT d.doc_id, coalesce(f.t, '') AS text FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id""",
)
def dedupe_sentences(spark, sf_dir):
    return documents(spark, sf_dir, "text AS t").select("doc_id", tx.drop_repeated_sentences(F.col("t")).alias("text"))


@query(
    "dedupe_list",
    f"""WITH items AS (SELECT doc_id, unnest(string_split(text, ',')) AS item, unnest(range(len(string_split(text, ',')))) AS k FROM documents),
{first_of_each_sql('items', "'|'")} SELECT d.doc_id, coalesce(f.t, '') AS items FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id""",
)
def dedupe_list(spark, sf_dir):
    kept = tx.first_of_each(F.split(F.col("t"), ",", -1))
    return documents(spark, sf_dir, "text AS t").select("doc_id", F.array_join(kept, "|").alias("items"))


# --- answers ------------------------------------------------------------------------------------

_ANSWER = (
    "'Hình ảnh: ' || text || chr(10) || '  ' || chr(10) || chr(10) || '![a' || chr(10) || 'b](x' || chr(10) || 'y) images: '"
    " || 'data:image/png;base64,QUJD= hết' || chr(10) || chr(9) || chr(10) || 'Nguồn: ' || source"
)
_NO_IMAGE = f"regexp_replace({_ANSWER}, '(?s)!\\[.*?\\]\\(.*?\\)', '', 'g')"
_CLEANED = (
    f"trim(regexp_replace(regexp_replace(regexp_replace({_NO_IMAGE}, '(?i)(?:Hình ảnh:|Images:)\\s*', '', 'g'),"
    f" 'data:image/[a-zA-Z]+;base64,[^\\s\\)]+', '', 'g'), '\\n\\s*\\n', chr(10) || chr(10), 'g'), {WS})"
)


@query(
    "answer_clean",
    f"""WITH a AS (SELECT doc_id, {_CLEANED} AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 3000 THEN left(t, 3000) || chr(10) || '...(truncated for safety)' ELSE t END AS answer FROM a""",
)
def answer_clean(spark, sf_dir):
    return documents(spark, sf_dir, f"{_ANSWER} AS t").select("doc_id", tx.clean_answer(F.col("t")).alias("answer"))


@query("answer_clean_compact", f"SELECT doc_id, {collapse_sql(_NO_IMAGE)} AS answer FROM documents")
def answer_clean_compact(spark, sf_dir):
    return documents(spark, sf_dir, f"{_ANSWER} AS t").select("doc_id", tx.compact_answer(F.col("t")).alias("answer"))


_FAILABLE = (
    "CASE WHEN doc_id % 5 = 0 THEN 'Xin lỗi, Tôi KHÔNG biết. ' || text WHEN doc_id % 7 = 0 THEN '   '"
    " WHEN doc_id % 11 = 0 THEN text || ' không tìm thấy dữ liệu' ELSE text END"
)


@query(
    "failed_answers",
    f"""WITH a AS (SELECT doc_id, {_FAILABLE} AS t FROM documents)
SELECT doc_id, trim(t, {WS}) = '' OR contains(lower(t), 'không tìm thấy dữ liệu') OR contains(lower(t), 'tôi không biết') AS failed FROM a""",
)
def failed_answers(spark, sf_dir):
    return documents(spark, sf_dir, f"{_FAILABLE} AS t").select("doc_id", tx.is_failed_answer(F.col("t")).alias("failed"))


_SOURCED = "text || chr(10) || 'Nguồn: a' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN ' NGUỒN: ' || source || chr(10) || 'hết' ELSE 'hết' END"
_PLAIN = f"CASE WHEN doc_id % 4 = 1 THEN text ELSE {_SOURCED} END"
_BLOCK = "CASE WHEN doc_id % 10 = 9 THEN '' ELSE 'Hình ảnh:' || chr(10) || '![x](' || source || ')' END"


@query(
    "images_before_sources",
    f"""WITH src AS (SELECT doc_id, {_PLAIN} AS t, {_BLOCK} AS img FROM documents),
lines AS (SELECT doc_id, img, t, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM src),
m AS (SELECT *, max(CASE WHEN prefix(lower(trim(line, {WS})), 'nguồn:') THEN i END) OVER (PARTITION BY doc_id) AS mark FROM lines)
SELECT doc_id, CASE WHEN any_value(img) = '' THEN any_value(t) WHEN max(mark) IS NULL THEN trim(rtrim(any_value(t), {WS}) || chr(10) || any_value(img), {WS})
  ELSE trim(string_agg(CASE WHEN i = mark THEN img || chr(10) || line ELSE line END, chr(10) ORDER BY i), {WS}) END AS answer
FROM m GROUP BY doc_id""",
)
def images_before_sources(spark, sf_dir):
    src = documents(spark, sf_dir, f"{_PLAIN} AS t", f"{_BLOCK} AS img")
    return src.select("doc_id", tx.images_before_sources(F.col("t"), F.col("img")).alias("answer"))


# --- names and questions ------------------------------------------------------------------------

_FOLD = f"regexp_replace(strip_accents(lower(trim(text, {WS}))), '\\s+', ' ', 'g')"
_STOPS = ", ".join(f"'{w}'" for w in fv.NAME_STOPWORDS)


@query("accent_fold", f"SELECT doc_id, {_FOLD} AS folded FROM documents")
def accent_fold(spark, sf_dir):
    return documents(spark, sf_dir, "text").select("doc_id", tx.fold_accents(F.col("text")).alias("folded"))


@query(
    "tokens",
    f"""SELECT doc_id, array_to_string(list_filter(regexp_extract_all(replace({_FOLD}, 'đ', 'd'), '[a-z0-9]+'),
  lambda x: NOT list_contains([{_STOPS}], x)), ' ') AS tokens FROM documents""",
)
def tokens(spark, sf_dir):
    return documents(spark, sf_dir, "text").select("doc_id", F.array_join(tx.name_tokens(F.col("text")), " ").alias("tokens"))


_ASKED = "CASE WHEN doc_id % 3 = 0 THEN 'Cho tôi xem Cây ' || source || ' ' || lang || ' nhìn ra sao? ' || text WHEN doc_id % 3 = 1 THEN 'cây ' ELSE text END"


@query(
    "focus_tokens",
    f"""WITH q AS (SELECT doc_id, regexp_extract_all(replace({_FOLD.replace('text', _ASKED)}, 'đ', 'd'), '[a-z0-9]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM q),
c AS (SELECT doc_id, min(i) AS at FROM w WHERE w = 'cay' GROUP BY doc_id),
s AS (SELECT c.doc_id, c.at, min(w.i) AS stop FROM c LEFT JOIN w ON w.doc_id = c.doc_id AND w.i > c.at AND w.w IN ({_STOPS}) GROUP BY c.doc_id, c.at),
f AS (SELECT w.doc_id, string_agg(w.w, ' ' ORDER BY w.i) AS t FROM w JOIN s ON s.doc_id = w.doc_id WHERE w.i > s.at AND (s.stop IS NULL OR w.i < s.stop) GROUP BY w.doc_id),
a AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM w WHERE w NOT IN ({_STOPS}) GROUP BY doc_id)
SELECT q.doc_id, coalesce(f.t, a.t, '') AS focus FROM q LEFT JOIN f ON f.doc_id = q.doc_id LEFT JOIN a ON a.doc_id = q.doc_id""",
)
def focus_tokens(spark, sf_dir):
    asked = documents(spark, sf_dir, f"{_ASKED} AS t")
    return asked.select("doc_id", F.array_join(tx.focus_tokens(F.col("t")), " ").alias("focus"))


_PICTURE = "CASE doc_id % 6 WHEN 0 THEN 'Đặc  điểm thực vật của ' || source WHEN 1 THEN 'MÔ TẢ lá ' || text WHEN 2 THEN 'trông như thế nào' ELSE text END"


@query(
    "picture_questions",
    f"""SELECT doc_id, regexp_matches({_PICTURE}, '{fv.PICTURE_QUESTION.replace('(?iuU)', '(?i)')}') AS wants_picture FROM documents""",
)
def picture_questions(spark, sf_dir):
    asked = documents(spark, sf_dir, f"{_PICTURE} AS t")
    return asked.select("doc_id", tx.asks_for_picture(F.col("t")).alias("wants_picture"))


@query(
    "caps_titles",
    f"{_lines_sql('text || chr(10) || upper(lang) || chr(32) || upper(source)')} SELECT doc_id, i AS line_no, {caps_sql('line')} AS caps FROM lines",
)
def caps_titles(spark, sf_dir):
    src = documents(spark, sf_dir, "text || chr(10) || upper(lang) || chr(32) || upper(source) AS t")
    rows = src.select("doc_id", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", sp.caps_title(F.col("line")).alias("caps"))


# --- JSON, ids, sizes ---------------------------------------------------------------------------

_REPLY = (
    "CASE event_id % 5 WHEN 0 THEN '```json' || chr(10) || props || chr(10) || '```  ' WHEN 1 THEN 'Kết quả: ' || props || ' hết'"
    " WHEN 2 THEN 'không có' WHEN 3 THEN ' dở dang {\"k\": 1 ' ELSE props || ' và ' || props END"
)


@query(
    "json_from_text",
    f"""WITH r AS (SELECT event_id, trim({_REPLY}, {WS}) AS t FROM events),
f AS (SELECT event_id, CASE WHEN prefix(t, '```') THEN trim(regexp_replace(regexp_replace(t, '^```[a-zA-Z0-9_-]*\\n', ''), '\\n```\\s*$', ''), {WS}) ELSE t END AS t FROM r)
SELECT event_id, CASE WHEN regexp_matches(t, '(?s)\\{{.*\\}}') THEN regexp_extract(t, '(?s)\\{{.*\\}}') WHEN contains(t, '{{')
  THEN trim(substr(t, instr(t, '{{')), {WS}) ELSE t END AS json FROM f""",
)
def json_from_text(spark, sf_dir):
    replies = spread(table(spark, sf_dir, "events")).selectExpr("event_id", f"{_REPLY} AS t")
    return replies.select("event_id", tx.json_object_in(F.col("t")).alias("json"))


_STABLE_META = (
    r"""'{"source": "' || source || '", "lang": "' || lang || '", "n": ' || n_chars || ', "ok": ' || CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END"""
    r""" || ', "none": null, "r": ' || CASE WHEN doc_id % 2 = 0 THEN '0.5' ELSE '1.25' END || ', "q": "it' || char(39) || 's", "t": "a' || char(92) || 'tb", "list": ["' || lang || '", ' || n_chars || ', null]}'"""
)


@query(
    "stable_ids",
    """SELECT doc_id, sha1(text || chr(10) || '[(''lang'', ''' || lang || '''), (''list'', [''' || lang || ''', ' || n_chars || ', None]), (''n'', ' || n_chars
  || '), (''none'', None), (''ok'', ' || CASE WHEN doc_id % 2 = 0 THEN 'True' ELSE 'False' END || '), (''q'', "it''s"), (''r'', '
  || CASE WHEN doc_id % 2 = 0 THEN '0.5' ELSE '1.25' END || '), (''source'', ''' || source || '''), (''t'', ''a' || chr(92) || 'tb'')]') AS id FROM documents""",
)
def stable_ids(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "text", f"{_STABLE_META} AS meta")
    values = F.from_json("meta", "map<string,variant>")
    return docs.select("doc_id", tx.stable_id(F.col("text"), values).alias("id"))


@query(
    "line_hints",
    """WITH c AS (SELECT doc_id, source || '.md:#' || CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN '0' WHEN 2 THEN 'x7' ELSE CAST(doc_id AS STRING) || '  ' END AS id FROM documents)
SELECT doc_id, CASE WHEN try_cast(regexp_extract(id, ':#(\\d+)\\s*$', 1) AS BIGINT) > 0 THEN try_cast(regexp_extract(id, ':#(\\d+)\\s*$', 1) AS BIGINT) END AS line_no FROM c""",
)
def line_hints(spark, sf_dir):
    ids = documents(
        spark,
        sf_dir,
        "source || '.md:#' || CASE doc_id % 4 WHEN 0 THEN CAST(doc_id AS STRING) WHEN 1 THEN '0' WHEN 2 THEN 'x7' ELSE CAST(doc_id AS STRING) || '  ' END AS id",
    )
    return ids.select("doc_id", tx.line_hint(F.col("id")).alias("line_no"))


_SIZE = "CAST(floor(o_totalprice) AS BIGINT) * CASE o_orderkey % 5 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN 1000000 ELSE 100000000 END"


@query(
    "format_bytes",
    f"""WITH s AS (SELECT o_orderkey, CAST({_SIZE} AS DOUBLE) AS b FROM orders)
SELECT o_orderkey, CASE WHEN b < 1024 THEN printf('%.1f B', b) WHEN b / 1024 < 1024 THEN printf('%.1f KB', b / 1024)
  WHEN b / 1048576 < 1024 THEN printf('%.1f MB', b / 1048576) WHEN b / 1073741824 < 1024 THEN printf('%.1f GB', b / 1073741824)
  ELSE printf('%.1f TB', b / 1099511627776) END AS size FROM s""",
)
def format_bytes(spark, sf_dir):
    sized = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"{_SIZE} AS b")
    return sized.select("o_orderkey", tx.human_size(F.col("b")).alias("size"))


@query(
    "page_density_class",
    f"""SELECT doc_id, CASE WHEN length(trim(text, {WS})) >= 10 AND doc_id % 10 <> 0
  AND length(trim(text, {WS})) / (595.0 * 842.0) >= 0.001 THEN 'digital' ELSE 'scanned' END AS page_class FROM documents""",
)
def page_density_class(spark, sf_dir):
    pages = documents(spark, sf_dir, "text", "CAST(595 AS DOUBLE) AS width", "CAST(CASE WHEN doc_id % 10 = 0 THEN 0 ELSE 842 END AS DOUBLE) AS height")
    return pages.select("doc_id", tx.density_class(F.col("text"), F.col("width"), F.col("height")).alias("page_class"))


# --- chunkers -----------------------------------------------------------------------------------


def _last_sql(stop: str) -> str:
    w = "substr(text, lo + 1, 512)"
    back = stop[::-1]
    return (
        f"CASE WHEN contains({w}, '{stop}') AND length({w}) - instr(reverse({w}), '{back}') - {len(stop)} + 1 > 100"
        f" THEN lo + length({w}) - instr(reverse({w}), '{back}') - {len(stop)} + 1 + 1 END"
    )


_ENDS = ", ".join(_last_sql(s) for s in fv.CHUNK_STOPS)
OVERLAP_SQL = f"""steps AS (
  SELECT doc_id, text, length(text) AS n, CAST(0 AS BIGINT) AS lo, CAST(0 AS BIGINT) AS k FROM texts WHERE length(text) > 512
  UNION ALL
  SELECT doc_id, text, n, hi - 50, k + 1 FROM (
    SELECT *, CASE WHEN lo + 512 < n THEN coalesce({_ENDS}, lo + 512) ELSE n END AS hi FROM steps) WHERE hi - 50 < n - 100
),
ends AS (SELECT *, CASE WHEN lo + 512 < n THEN coalesce({_ENDS}, lo + 512) ELSE n END AS hi FROM steps),
cut AS (SELECT doc_id, k, lo, trim(substr(text, lo + 1, hi - lo), {WS}) AS chunk_text FROM ends),
chunks AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_id, chunk_text, lo AS position FROM cut WHERE length(chunk_text) >= 100
  UNION ALL SELECT doc_id, 0, text, 0 FROM texts WHERE length(text) <= 512)"""


@query(
    "chunk_overlap",
    f"WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents), {OVERLAP_SQL} SELECT doc_id, chunk_id, chunk_text, position FROM chunks",
)
def chunk_overlap(spark, sf_dir):
    return seg.overlapping_chunks(documents(spark, sf_dir, "text"), "doc_id")


_PARAS = "replace(text, chr(10), chr(10) || chr(10))"


@query(
    "pack_paragraphs",
    f"""WITH RECURSIVE p AS (SELECT doc_id, string_split({_PARAS}, chr(10) || chr(10)) AS ps, length({_PARAS}) AS n FROM documents),
q AS (SELECT doc_id, unnest(ps) AS para, unnest(range(len(ps))) AS i FROM p WHERE n > 800),
walk AS (SELECT doc_id, i, length(para) + 2 AS used, 0 AS chunk FROM q WHERE i = 0
  UNION ALL SELECT q.doc_id, q.i, CASE WHEN w.used + length(q.para) + 2 > 800 THEN length(q.para) + 2 ELSE w.used + length(q.para) + 2 END,
    CASE WHEN w.used + length(q.para) + 2 > 800 THEN w.chunk + 1 ELSE w.chunk END FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i + 1)
SELECT w.doc_id, CAST(w.chunk AS BIGINT) AS chunk_index, string_agg(q.para, chr(10) || chr(10) ORDER BY q.i) AS chunk_text
FROM walk w JOIN q ON q.doc_id = w.doc_id AND q.i = w.i GROUP BY w.doc_id, w.chunk
UNION ALL SELECT doc_id, 0, {_PARAS} FROM documents WHERE length({_PARAS}) <= 800""",
)
def pack_paragraphs(spark, sf_dir):
    return seg.packed_chunks(documents(spark, sf_dir, f"{_PARAS} AS text"), 800, "doc_id")


# --- samples, prompts ---------------------------------------------------------------------------


@query(
    "sample_chunks",
    f"""WITH RECURSIVE texts AS (SELECT doc_id, text FROM documents), {OVERLAP_SQL}
SELECT doc_id, chunk_id, chunk_text FROM chunks ORDER BY md5('7|' || doc_id || ':#' || chunk_id) LIMIT 25""",
)
def sample_chunks(spark, sf_dir):
    from folioworks.operators.sampling import sample_rows

    chunks = seg.overlapping_chunks(documents(spark, sf_dir, "text"), "doc_id")
    ident = tx.record_id(F.col("doc_id").cast("string"), F.col("chunk_id"))
    return sample_rows(chunks, 25, ident, seed=7).select("doc_id", "chunk_id", "chunk_text")


@query(
    "messages_to_prompt",
    """SELECT conv_id, string_agg(upper(role) || ': ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) || 'ASSISTANT:' AS prompt
FROM conversations GROUP BY conv_id""",
)
def messages_to_prompt(spark, sf_dir):
    from folioworks.operators.prompts import messages_to_prompt as op

    return op(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
