"""Markdown repair and structure queries over the books."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions import markdown as md
from folioworks.functions import splitters as sp
from folioworks.functions import text as tx
from folioworks.functions.core import to_lines
from folioworks.operators import segment as seg
from folioworks.plans.book_queries import WS, heading_sql, rx, upper_share_sql
from folioworks.plans.books import LINES_CTE, books
from folioworks.plans.registry import query


def _text_query(name, sql, fn):
    @query(name, sql)
    def run(spark, sf_dir):
        return books(spark, sf_dir).select("book_id", fn(F.col("text")).alias("text"))

    return run


# --- checking SQL, step by step -----------------------------------------------------------------
# Each step reads ``src(book_id, text)`` and adds CTEs ending in ``out(book_id, text)``.


def lines_of(src: str, out: str) -> str:
    return f"""{out} AS (SELECT book_id, unnest(string_split(text, chr(10))) AS line,
  unnest(range(len(string_split(text, chr(10))))) AS i FROM {src})"""


def rejoin(src: str, out: str, expr: str = "line") -> str:
    return f"{out} AS (SELECT book_id, string_agg({expr}, chr(10) ORDER BY i) AS text FROM {src} GROUP BY book_id)"


def line_repair_sql(src: str, out: str) -> str:
    x = "line"
    x = f"regexp_replace({x}, '^(#{{1,6}})([^\\s#])', '\\1 \\2')"
    x = f"regexp_replace({x}, '^(>+)([^\\s>])', '\\1 \\2')"
    x = f"regexp_replace({x}, '^(\\s*)([-*+])([^\\s])', '\\1\\2 \\3')"
    x = f"regexp_replace({x}, '^(\\s*)(\\d+)\\.([^\\s.])', '\\1\\2. \\3')"
    return f"{lines_of(src, out + '_l')}, {rejoin(out + '_l', out, x)}"


def emphasis_sql(src: str, out: str) -> str:
    return f"""{lines_of(src, out + '_l')},
{out}_c AS (SELECT *, len(regexp_extract_all(line, '\\*\\*')) AS b, len(regexp_extract_all(line, '[*_]')) AS m FROM {out}_l),
{out}_b AS (SELECT *, CASE WHEN b % 2 = 1 AND NOT suffix(rtrim(line, {WS}), '**') THEN rtrim(line, {WS}) || '**' ELSE line END AS x FROM {out}_c),
{out}_e AS (SELECT *, CASE WHEN abs(m - 2 * b) % 2 = 1 AND regexp_matches(x, '[*_][^*_\\s]')
   AND NOT regexp_matches(rtrim(x, {WS}), '[*_]$') AND contains(x, '*') THEN rtrim(x, {WS}) || '*' ELSE x END AS y FROM {out}_b),
{rejoin(out + '_e', out, 'y')}"""


def links_sql(src: str, out: str) -> str:
    x = "text"
    x = f"regexp_replace({x}, '(?m)\\[([^\\]]+)$', '[\\1]', 'g')"
    x = f"regexp_replace({x}, '(?m)!\\[([^\\]]+)$', '![\\1]', 'g')"
    x = f"regexp_replace({x}, '(?m)\\(([^\\)]+)$', '(\\1)', 'g')"
    return f"{out} AS (SELECT book_id, {x} AS text FROM {src})"


def tables_sql(src: str, out: str) -> str:
    return f"""{lines_of(src, out + '_l')},
{out}_w AS (SELECT *, trim(line, {WS}) AS bare, lag(line) OVER (PARTITION BY book_id ORDER BY i) AS above FROM {out}_l),
{out}_f AS (SELECT book_id, i, CASE
   WHEN NOT contains(line, '|') THEN line
   WHEN contains(coalesce(above, ''), '|') AND regexp_matches(bare, '^\\|[\\s\\-|:]+\\|?$') AND NOT suffix(bare, '|') THEN bare || '|'
   ELSE CASE WHEN prefix(bare, '|') THEN line ELSE '|' || line END
     || CASE WHEN suffix(trim(CASE WHEN prefix(bare, '|') THEN line ELSE '|' || line END, {WS}), '|') THEN '' ELSE '|' END END AS line FROM {out}_w),
{rejoin(out + '_f', out)}"""


LEVEL_SQL = f"""CASE WHEN regexp_matches(trim(line, {WS}), '^#{{1,6}}\\s+') THEN length(regexp_extract(trim(line, {WS}), '^(#{{1,6}})\\s+', 1))
  WHEN regexp_matches(trim(line, {WS}), '(?i)^\\d+\\.\\d+\\s+|^[a-z]\\)\\s+|^[ivx]+\\)\\s+') THEN 2 ELSE 0 END"""


def breaks_sql(src: str, out: str) -> str:
    return f"""{lines_of(src, out + '_l')},
{out}_v AS (SELECT *, {LEVEL_SQL} AS level FROM {out}_l),
{out}_p AS (SELECT *, last_value(nullif(level, 0) IGNORE NULLS) OVER
    (PARTITION BY book_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {out}_v),
{out}_e AS (SELECT book_id, arg_max(level, i) FILTER (WHERE level > 0) AS final FROM {out}_v GROUP BY book_id),
{out}_j AS (SELECT book_id, string_agg(CASE WHEN level IN (1, 2) AND prev = 2 THEN '</break>' || chr(10) || line ELSE line END,
    chr(10) ORDER BY i) AS text FROM {out}_p GROUP BY book_id),
{out} AS (SELECT j.book_id, j.text || CASE WHEN e.final = 2 THEN chr(10) || '</break>' ELSE '' END AS text
  FROM {out}_j j JOIN {out}_e e ON e.book_id = j.book_id)"""


_NOT_WORD = "[^\\pL\\pM\\p{Nd}\\p{Pc}]"


def rule_sql(x: str, pattern: str, replacement: str) -> str:
    """One spelling rule without look-around: the neighbours are captured and put back."""
    plain = replacement.replace("$1", "\\1").replace("$2", "\\2")
    if pattern == r"\b0\s+\b":
        pattern, plain = "(^|" + _NOT_WORD + ")0\\s+([\\pL\\pM\\p{Nd}\\p{Pc}])", "\\1" + replacement + "\\2"
    elif pattern == r"\.\s+\b1\s+9":
        pattern = r"\.\s+1\s+9"
    elif pattern.startswith("\\b"):
        pattern = "(^|" + _NOT_WORD + ")" + pattern[2:-2] + "($|" + _NOT_WORD + ")"
        plain = "\\1" + replacement + "\\2"
    for _ in range(2):
        x = f"regexp_replace({x}, '{pattern}', '{plain}', 'g')"
    return x


def spelling_sql(src: str, out: str) -> str:
    ctes, prev, carried = [], src, "book_id"
    for k, (_, pattern) in enumerate(fv.PROTECTED_SPANS[:5]):
        p = pattern.replace("(?U)", "")
        ctes.append(
            f"{out}_g{k} AS (SELECT {carried}, regexp_extract_all(text, '{p}') AS s{k},"
            f" regexp_replace(text, '{p}', '_{chr(0xE000 + k)}_', 'g') AS text FROM {prev})"
        )
        prev, carried = f"{out}_g{k}", carried + f", s{k}"
    ctes.append(lines_of(prev, out + "_l"))
    last = f"{out}_l"
    for at in range(0, len(fv.OCR_RULES), 9):
        x = "line"
        for pattern, replacement in fv.OCR_RULES[at : at + 9]:
            x = rule_sql(x, pattern, replacement)
        skip = f"trim(line, {WS}) = '' OR regexp_matches(trim(line, {WS}), '^#{{1,6}}\\s+.+$|^\\|.+\\|$')"
        keep = "raw" if at else f"({skip}) AS raw"
        ctes.append(f"{out}_r{at} AS (SELECT book_id, i, {keep}, CASE WHEN {'raw' if at else skip} THEN line ELSE {x} END AS line FROM {last})")
        last = f"{out}_r{at}"
    ctes.append(rejoin(last, out + "_j"))
    ctes.append(f"{out}_k AS (SELECT j.text, g.* EXCLUDE (text) FROM {out}_j j JOIN {prev} g ON g.book_id = j.book_id)")
    x = "text"
    prev = f"{out}_k"
    for k in reversed(range(5)):
        mark = f"_{chr(0xE000 + k)}_"
        ctes.append(
            f"{out}_u{k} AS (SELECT * REPLACE (array_to_string(list_transform(list_zip(string_split(text, '{mark}'), s{k}),"
            f" lambda z: z[1] || coalesce(z[2], '')), '') AS text) FROM {prev})"
        )
        prev = f"{out}_u{k}"
    ctes.append(f"{out} AS (SELECT book_id, text FROM {prev})")
    return ",\n".join(ctes)


_REF = "!\\[\\]\\(!\\[id:\\s*([^\\]]+?)\\]\\(([^)]+?)\\)\\)"


def refs_sql(out: str) -> str:
    return f"""{out} AS (SELECT book_id, i, nullif(trim(regexp_extract(line, '{_REF}', 1), {WS}), '') AS image_id,
  trim(regexp_extract(line, '{_REF}', 2), {WS}) AS source_filename FROM lines WHERE {rx('line', _REF)})"""


def inject_sql(src: str, out: str) -> str:
    return f"""{refs_sql(out + '_r')},
{out}_n AS (SELECT book_id, list(image_id ORDER BY i) AS ids FROM {out}_r GROUP BY book_id),
{out}_c AS (SELECT t.book_id, t.text, string_split_regex(t.text, '\\[IMAGE_PLACEHOLDER_\\d+\\]') AS gaps,
  regexp_extract_all(t.text, '\\[IMAGE_PLACEHOLDER_\\d+\\]') AS marks, n.ids FROM {src} t LEFT JOIN {out}_n n ON n.book_id = t.book_id),
{out}_g AS (SELECT book_id, text, ids, unnest(gaps) AS gap, unnest(range(len(gaps))) AS k, marks FROM {out}_c),
{out} AS (SELECT book_id, CASE WHEN any_value(ids) IS NULL THEN any_value(text) ELSE string_agg(gap || CASE
    WHEN k >= len(marks) THEN '' WHEN k < len(ids) * len(ids)
    THEN '![id: ' || ids[k % len(ids) + 1] || '](' || ids[k % len(ids) + 1] || '.png)' ELSE marks[k + 1] END, '' ORDER BY k) END AS text
  FROM {out}_g GROUP BY book_id)"""


def _final(cte: str, out: str) -> str:
    return f"{LINES_CTE}, {cte} SELECT book_id, text FROM {out}"


_text_query("md_line_repair", _final(line_repair_sql("books", "o"), "o"), md.repair_lines)
_text_query("md_emphasis_repair", _final(emphasis_sql("books", "o"), "o"), md.repair_emphasis)
_text_query("md_link_repair", _final(links_sql("books", "o"), "o"), md.repair_links)
_text_query("md_table_repair", _final(tables_sql("books", "o"), "o"), md.repair_tables)
_text_query("section_breaks", _final(breaks_sql("books", "o"), "o"), md.insert_breaks)
_text_query("ocr_corrections", _final(spelling_sql("books", "o"), "o"), md.correct_spelling)


def _ids(text):
    return F.transform(md.image_refs(text), lambda r: r["image_id"])


@query("inject_image_ids", _final(inject_sql("books", "o"), "o"))
def inject_image_ids(spark, sf_dir):
    t = F.col("text")
    return books(spark, sf_dir).select("book_id", md.inject_image_ids(t, _ids(t)).alias("text"))


@query(
    "md_postprocess",
    _final(
        ",\n".join(
            [
                line_repair_sql("books", "a"),
                emphasis_sql("a", "b"),
                links_sql("b", "c"),
                tables_sql("c", "t"),
                inject_sql("t", "f"),
                breaks_sql("f", "g"),
                spelling_sql("g", "o"),
            ]
        ),
        "o",
    ),
)
def md_postprocess(spark, sf_dir):
    from folioworks.plans.pipelines import postprocess_markdown

    src = books(spark, sf_dir).withColumn("image_ids", _ids(F.col("text")))
    return postprocess_markdown(src, images="image_ids").select("book_id", "text")


# --- lines --------------------------------------------------------------------------------------


def _lines(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", F.posexplode(to_lines(F.col("text"))).alias("line_no", "line"))


@query(
    "heading_levels",
    f"{LINES_CTE} SELECT book_id, i AS line_no, {LEVEL_SQL} AS level FROM lines WHERE {LEVEL_SQL} > 0",
)
def heading_levels(spark, sf_dir):
    out = _lines(spark, sf_dir).withColumn("level", md.heading_level(F.col("line")))
    return out.where("level > 0").select("book_id", "line_no", "level")


@query(
    "heading_text",
    f"{LINES_CTE} SELECT book_id, i AS line_no, {heading_sql('line')} AS title FROM lines WHERE prefix(trim(line, {WS}), '#')",
)
def heading_text(spark, sf_dir):
    heads = _lines(spark, sf_dir).where(F.ltrim(F.col("line")).startswith("#"))
    return heads.select("book_id", "line_no", tx.heading_text(F.col("line")).alias("title"))


@query(
    "uppercase_titles",
    f"""{LINES_CTE} SELECT book_id, i AS line_no, {upper_share_sql(heading_sql('line'), 0.75)} AS is_upper,
  {upper_share_sql(heading_sql('line'), 0.85)} AS is_strict FROM lines""",
)
def uppercase_titles(spark, sf_dir):
    line = F.col("line")
    return _lines(spark, sf_dir).select(
        "book_id", "line_no", sp.mostly_upper(line).alias("is_upper"), sp.mostly_upper(line, 0.85).alias("is_strict")
    )


@query(
    "inline_breaks",
    f"""{LINES_CTE} SELECT book_id, i AS line_no, rtrim(line, {WS}) || ' </break>' AS line FROM lines
  WHERE regexp_matches(trim(line, {WS}), '^\\d+\\.\\d+\\s')""",
)
def inline_breaks(spark, sf_dir):
    marked = _lines(spark, sf_dir).withColumn("marked", md.inline_break(F.col("line")))
    return marked.where("marked <> line").select("book_id", "line_no", F.col("marked").alias("line"))


@query("image_refs", f"{LINES_CTE}, {refs_sql('r')} SELECT book_id, i AS line_no, image_id, source_filename FROM r")
def image_refs(spark, sf_dir):
    return seg.image_refs(books(spark, sf_dir), "book_id")


@query(
    "sanitize_chunks",
    f"""{LINES_CTE},
z1 AS (SELECT book_id, i, line, regexp_replace(line, '<!--[^>]*?-->', ' ', 'g') AS x FROM lines),
z2 AS (SELECT book_id, i, line, regexp_matches(x, '(?i)^\\s*#{{1,6}}\\s*page\\s*\\d+\\s*$') AS page,
  regexp_replace(x, '(?i)</?break\\s*/?>', ' ', 'g') AS x FROM z1),
z3 AS (SELECT *, CASE WHEN prefix(ltrim(x, {WS}), '#')
  THEN regexp_replace(x, '^(\\s*#{{1,6}}\\s*)\\(?\\s*\\d+\\s*\\)?(?:\\s*[\\.)])?\\s+', '\\1')
  ELSE regexp_replace(x, '^\\s*\\d+\\s*[\\.)]\\s+', '') END AS y FROM z2),
z4 AS (SELECT *, regexp_replace(regexp_replace(y, '{_REF}', '[[IMAGE:\\1]]', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', '[[IMAGE]]', 'g') AS z FROM z3),
z5 AS (SELECT book_id, i, CASE WHEN line = '' THEN '' WHEN page THEN '' ELSE rtrim(regexp_replace(z, '\\s{{2,}}', ' ', 'g'), {WS}) END AS line FROM z4),
z6 AS (SELECT *, lag(line) OVER (PARTITION BY book_id ORDER BY i) AS above FROM z5)
SELECT book_id, trim(string_agg(line, chr(10) ORDER BY i), {WS}) AS text FROM z6
WHERE NOT (trim(line, {WS}) = '' AND above IS NOT NULL AND trim(above, {WS}) = '') GROUP BY book_id""",
)
def sanitize_chunks(spark, sf_dir):
    return books(spark, sf_dir).select("book_id", tx.sanitize_chunk(F.col("text")).alias("text"))


# --- blocks, tables, spans, nodes ---------------------------------------------------------------

_RUNS = """
t1 AS (SELECT *, prefix(trim(line, {ws}), '|') AS piped, lead(line) OVER (PARTITION BY book_id ORDER BY i) AS below FROM lines),
t2 AS (SELECT *, i - row_number() OVER (PARTITION BY book_id, piped ORDER BY i) AS run FROM t1),
t3 AS (SELECT *, piped AND bool_or(contains(coalesce(below, ''), '---')) OVER
  (PARTITION BY book_id, piped, run ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_table FROM t2)
""".replace("{ws}", WS)

_BLOCKS = f"""{LINES_CTE}, {_RUNS},
t4 AS (SELECT book_id, i, line, trim(line, {WS}) AS bare, CASE WHEN in_table THEN 'table'
  WHEN {rx('line', '\\[IMAGE_PLACEHOLDER_\\d+\\]')} OR {rx('line', '!\\[id:\\s*([^\\]]+)\\]\\([^\\)]+\\)')} THEN 'image'
  WHEN trim(line, {WS}) = '' THEN 'blank'
  WHEN {rx('line', '^#{1,6}($|[^#])')} THEN 'heading'
  WHEN {rx(f'trim(line, {WS})', '^[-*+] ')} THEN 'bullet'
  WHEN {rx('line', '^\\s*\\d+\\.\\s')} THEN 'numbered'
  WHEN {rx('line', '^\\s*(-{3,}|\\*{3,}|_{3,})\\s*$')} THEN 'rule'
  WHEN trim(line, {WS}) = '</break>' THEN 'break'
  WHEN prefix(trim(line, {WS}), '>') THEN 'quote'
  WHEN {rx('line', '<br>|<br/>|<br />')} THEN 'br_paragraph' ELSE 'paragraph' END AS block_type FROM t3),
t5 AS (SELECT book_id, i AS line_no, block_type, CASE block_type
  WHEN 'heading' THEN trim(regexp_replace(line, '^#{{1,6}}', ''), {WS}) WHEN 'bullet' THEN substr(bare, 3)
  WHEN 'numbered' THEN regexp_replace(line, '^\\s*\\d+\\.\\s', '') WHEN 'quote' THEN trim(substr(bare, 2), {WS})
  WHEN 'br_paragraph' THEN regexp_replace(line, '<br>|<br/>|<br />', chr(10), 'g') ELSE line END AS block_text FROM t4)
"""


@query("md_blocks", f"{_BLOCKS} SELECT * FROM t5")
def md_blocks(spark, sf_dir):
    return seg.markdown_blocks(books(spark, sf_dir), "book_id")


@query(
    "md_tables",
    f"""{LINES_CTE}, {_RUNS},
m1 AS (SELECT book_id, i, line, run, min(i) OVER (PARTITION BY book_id, run) AS lo FROM t3 WHERE in_table),
m2 AS (SELECT *, dense_rank() OVER (PARTITION BY book_id ORDER BY lo) - 1 AS table_no,
  row_number() OVER (PARTITION BY book_id, run ORDER BY i) - 1 AS row_no,
  string_split(trim(line, '|'), '|') AS cells FROM m1 WHERE i = lo OR NOT contains(line, '---')),
m3 AS (SELECT *, first_value(len(cells)) OVER (PARTITION BY book_id, table_no ORDER BY row_no) AS width FROM m2),
m4 AS (SELECT book_id, table_no, row_no, width, unnest(cells) AS cell, unnest(range(len(cells))) AS col_no FROM m3)
SELECT book_id, table_no, row_no, col_no, trim(cell, {WS}) AS cell FROM m4 WHERE col_no < width""",
)
def md_tables(spark, sf_dir):
    return seg.markdown_tables(books(spark, sf_dir), "book_id")


_SPAN = fv.INLINE_SPAN


@query(
    "md_inline_spans",
    f"""{_BLOCKS},
s1 AS (SELECT book_id, line_no, string_split_regex(block_text, '{_SPAN}') AS gaps, regexp_extract_all(block_text, '{_SPAN}') AS spans
  FROM t5 WHERE block_type NOT IN ('table', 'image', 'blank', 'rule', 'break')),
s2 AS (SELECT book_id, line_no, unnest(gaps) AS gap, unnest(range(len(gaps))) AS k, spans FROM s1),
s3 AS (SELECT book_id, line_no, 2 * k AS o, gap AS piece FROM s2 WHERE gap <> ''
  UNION ALL SELECT book_id, line_no, 2 * k + 1, spans[k + 1] FROM s2 WHERE k < len(spans)),
s4 AS (SELECT *, CASE WHEN prefix(piece, '$') AND suffix(piece, '$') AND length(piece) > 2 THEN 'math'
  WHEN prefix(piece, '<sub>') AND suffix(piece, '</sub>') THEN 'sub' WHEN prefix(piece, '<sup>') AND suffix(piece, '</sup>') THEN 'sup'
  WHEN prefix(piece, '***') AND suffix(piece, '***') AND length(piece) > 6 THEN 'bold_italic'
  WHEN prefix(piece, '**') AND suffix(piece, '**') AND length(piece) > 4 THEN 'bold'
  WHEN prefix(piece, '__') AND suffix(piece, '__') AND length(piece) > 4 THEN 'bold'
  WHEN prefix(piece, '*') AND suffix(piece, '*') AND length(piece) > 2 AND NOT prefix(piece, '**') THEN 'italic'
  WHEN prefix(piece, '_') AND suffix(piece, '_') AND length(piece) > 2 AND NOT prefix(piece, '__') THEN 'italic'
  WHEN prefix(piece, '`') AND suffix(piece, '`') AND length(piece) > 2 THEN 'code'
  WHEN regexp_matches(piece, '^\\[.*?\\]\\(.*?\\)') THEN 'link' ELSE 'text' END AS span_type FROM s3)
SELECT book_id, line_no, row_number() OVER (PARTITION BY book_id, line_no ORDER BY o) - 1 AS span_no, span_type,
  CASE span_type WHEN 'math' THEN substr(piece, 2, length(piece) - 2) WHEN 'sub' THEN substr(piece, 6, length(piece) - 11)
  WHEN 'sup' THEN substr(piece, 6, length(piece) - 11) WHEN 'bold_italic' THEN substr(piece, 4, length(piece) - 6)
  WHEN 'bold' THEN substr(piece, 3, length(piece) - 4) WHEN 'italic' THEN substr(piece, 2, length(piece) - 2)
  WHEN 'code' THEN substr(piece, 2, length(piece) - 2) WHEN 'link' THEN regexp_extract(piece, '^\\[(.*?)\\]\\(.*?\\)', 1) ELSE piece END AS span_text
FROM s4""",
)
def md_inline_spans(spark, sf_dir):
    blocks = seg.markdown_blocks(books(spark, sf_dir), "book_id")
    shown = blocks.where(~F.col("block_type").isin("table", "image", "blank", "rule", "break"))
    return seg.markdown_spans(shown, "book_id", "line_no")


@query(
    "header_path_nodes",
    f"""{LINES_CTE.replace('WITH', 'WITH RECURSIVE', 1)},
h1 AS (SELECT book_id, i, line, {rx('line', '^#+\\s')} AS head, sum(CAST({rx('line', '^#+\\s')} AS INT)) OVER (PARTITION BY book_id ORDER BY i) AS s FROM lines),
h2 AS (SELECT book_id, s, trim(string_agg(line, chr(10) ORDER BY i), {WS}) AS node_text,
  length(regexp_extract(arg_min(line, i), '^(#+)\\s', 1)) AS level, regexp_extract(arg_min(line, i), '^(#+)\\s(.*)', 2) AS title
  FROM h1 GROUP BY book_id, s),
h3 AS (SELECT a.book_id, a.s, a.title, (SELECT max(b.s) FROM h2 b WHERE b.book_id = a.book_id AND b.s > 0 AND b.s < a.s AND b.level < a.level) AS up
  FROM h2 a WHERE a.s > 0),
h4 AS (SELECT book_id, s, up, '/' AS path FROM h3
  UNION ALL SELECT h4.book_id, h4.s, p.up, '/' || p.title || h4.path FROM h4 JOIN h3 p ON p.book_id = h4.book_id AND p.s = h4.up)
SELECT n.book_id, row_number() OVER (PARTITION BY n.book_id ORDER BY n.s) - 1 AS node_no, coalesce(f.path, '/') AS header_path, n.node_text
FROM h2 n LEFT JOIN h4 f ON f.book_id = n.book_id AND f.s = n.s AND f.up IS NULL WHERE n.node_text <> ''""",
)
def header_path_nodes(spark, sf_dir):
    return seg.header_path_nodes(books(spark, sf_dir), "book_id")


@query(
    "doc_sample_counts",
    f"""{LINES_CTE}, c1 AS (SELECT book_id, count(*) AS line_count, count(*) FILTER (WHERE regexp_matches(line, '^#+\\s')) +
    count(*) FILTER (WHERE i > 0 AND regexp_matches(line, '^#+$') AND NOT last) AS heading_count,
  count(*) FILTER (WHERE trim(line, {WS}) <> '') AS filled_count, count(*) FILTER (WHERE i > 0 AND prefix(line, '|')) AS table_count,
  count(*) FILTER (WHERE {rx('line', _REF)}) AS image_count
  FROM (SELECT *, i = max(i) OVER (PARTITION BY book_id) AS last FROM lines) GROUP BY book_id)
SELECT *, heading_count + filled_count + table_count + image_count AS sample_count FROM c1""",
)
def doc_sample_counts(spark, sf_dir):
    t = F.col("text")
    images = F.size(md.image_refs(t))
    return books(spark, sf_dir).select(
        "book_id",
        tx.line_count(t).alias("line_count"),
        tx.heading_count(t).alias("heading_count"),
        tx.filled_line_count(t).alias("filled_count"),
        tx.table_mark_count(t).alias("table_count"),
        images.alias("image_count"),
        tx.sample_count(t, images).alias("sample_count"),
    )
