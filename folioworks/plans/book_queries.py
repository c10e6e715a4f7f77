"""Splitting queries over markdown books."""

from __future__ import annotations

from folioworks.functions import splitters as sp
from folioworks.operators import segment as seg
from folioworks.plans.books import BOOKS_CTE, LINES_CTE, books
from folioworks.plans.registry import query

# The characters of a Unicode strip, as the checking engine spells them.
WS = (
    "chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||chr(28)||chr(29)||chr(30)||chr(31)||' '||chr(133)||chr(160)"
    "||chr(5760)||chr(8192)||chr(8193)||chr(8194)||chr(8195)||chr(8196)||chr(8197)||chr(8198)||chr(8199)"
    "||chr(8200)||chr(8201)||chr(8202)||chr(8232)||chr(8233)||chr(8239)||chr(8287)||chr(12288)"
)


def pieces_sql(source: str, test: str, min_chars: int = 0, out: str = "chunks") -> str:
    """CTEs cutting ``source(book_id, i, line)`` at lines where ``test`` holds."""
    return f"""
{out}_m AS (SELECT book_id, i, line, coalesce({test}, false) AS is_start FROM {source}),
{out}_s AS (SELECT *, sum(CAST(is_start AS INT)) OVER (PARTITION BY book_id ORDER BY i) AS s FROM {out}_m),
{out}_t AS (SELECT book_id, s, trim(string_agg(line, chr(10) ORDER BY i), {WS}) AS chunk_text
  FROM {out}_s WHERE s > 0 GROUP BY book_id, s),
{out} AS (SELECT book_id, s, chunk_text, row_number() OVER (PARTITION BY book_id ORDER BY s) - 1 AS chunk_index
  FROM {out}_t WHERE chunk_text <> '' AND length(chunk_text) >= {min_chars})
"""


_PICK = "SELECT book_id, chunk_index, chunk_text FROM chunks"


@query(
    "split_by_heading",
    f"{LINES_CTE}, {pieces_sql('lines', r'''regexp_matches(trim(line), '^#{1,6}\s') AND regexp_matches(line, '^#{1,6}\s+')''')} {_PICK}",
)
def split_by_heading(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.by_heading, "book_id")



# Word end in the checking engine, whose \b knows ASCII only.
END = "($|[^\\pL\\pN_])"


def rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def caps_sql(x: str) -> str:
    compact = f"regexp_replace({x}, '\\s+', '', 'g')"
    letters = f"trim(regexp_replace(regexp_replace({x}, '[^A-ZÀ-Ỵ\\s]', '', 'g'), '\\s+', ' ', 'g'))"
    capitals = f"length(regexp_replace({compact}, '[^A-ZÀ-Ỵ]', '', 'g'))"
    return f"(length({letters}) >= 3 AND {capitals} / greatest(1, length({compact})) >= 0.65)"


def heading_sql(x: str) -> str:
    return (
        f"trim(regexp_replace(replace(replace(regexp_replace({x}, '^\\s*#{{1,6}}\\s*', ''), '*', ''), '_', ''),"
        f" '\\s+', ' ', 'g'))"
    )


def upper_share_sql(x: str, share: float) -> str:
    up, low = f"len(regexp_extract_all({x}, '\\p{{Lu}}'))", f"len(regexp_extract_all({x}, '\\p{{Ll}}'))"
    return f"({up} + {low} >= 3 AND {up} / greatest(1, {up} + {low}) >= {share})"


def entry_lines_sql(source: str, out: str) -> str:
    """CTE cutting the chunks of ``source(book_id, s, chunk_text)`` into lines again."""
    return f"""
{out} AS (SELECT book_id, s, chunk_text, len(string_split(chunk_text, chr(10))) AS nlines,
  unnest(string_split(chunk_text, chr(10))) AS line, unnest(range(len(string_split(chunk_text, chr(10))))) AS i
  FROM {source})
"""


def plants_sql(out: str) -> str:
    return f"""
p_cut AS (SELECT book_id, min(i) AS at FROM lines WHERE {rx('line', '(?i)^\\s*##\\s*ii\\s*[-–—]\\s*')} GROUP BY book_id),
p_two AS (SELECT l.book_id, min(l.i) AS at FROM lines l LEFT JOIN p_cut c ON c.book_id = l.book_id
  WHERE (c.at IS NULL OR l.i < c.at) AND {rx('l.line', '(?i)^\\s*#\\s*phần\\s+hai' + END)} GROUP BY l.book_id),
p_body AS (
  SELECT l.book_id, l.i, l.line,
         CASE WHEN p.at IS NULL OR l.i < p.at THEN {rx('l.line', '(?i)^\\s*##\\s*\\d+\\s*\\.\\s*(?:CÂY|CAY)' + END)}
              ELSE {rx('l.line', '(?i)^\\s*#{2,4}\\s*\\d+\\s*\\.\\s*(?:CÂY|CAY)' + END)} END AS strict,
         {rx('l.line', '(?i)^\\s*\\d+\\s*\\.\\s*(?:CÂY|CAY)' + END)} AS bare
  FROM lines l LEFT JOIN p_cut c ON c.book_id = l.book_id LEFT JOIN p_two p ON p.book_id = l.book_id
  WHERE c.at IS NULL OR l.i < c.at
),
p_rule AS (SELECT *, CASE WHEN bool_or(strict) OVER (PARTITION BY book_id) THEN strict ELSE bare END AS hit FROM p_body),
{pieces_sql('p_rule', 'hit', 200, out)}"""


@query("split_two_part_book", f"{LINES_CTE}, {plants_sql('chunks')} {_PICK}")
def split_two_part_book(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.plants, "book_id")


_OPT = "^\\s*#{3,6}\\s*([a-zA-Z])\\)\\s*(.+?)\\s*$"


def recipes_sql(out: str) -> str:
    return f"""
r_strict AS (SELECT book_id, min(i) AS at FROM lines WHERE {rx('line', '(?i)^\\s*##\\s*ii\\s*[-–—]\\s*k[ĩiỹy]\\s*thuật\\s+làm\\s+nước\\s+giải\\s+khát' + END)} GROUP BY book_id),
r_loose AS (SELECT book_id, min(i) AS at FROM lines WHERE {rx('line', '(?i)^\\s*##\\s*ii\\s*[-–—]\\s*')} GROUP BY book_id),
r_body AS (SELECT l.book_id, l.i, l.line FROM lines l LEFT JOIN r_strict a ON a.book_id = l.book_id
  LEFT JOIN r_loose b ON b.book_id = l.book_id WHERE l.i >= coalesce(a.at, b.at)),
{pieces_sql('r_body', rx('line', '(?i)^\\s*###\\s*\\d+\\s*\\.\\s*(?:NƯỚC|NUOC)' + END), 0, 'r_entry')},
{entry_lines_sql('r_entry', 'r_line')},
r_mark AS (SELECT *, {rx('line', _OPT)} AS is_opt,
  sum(CAST({rx('line', _OPT)} AS INT)) OVER (PARTITION BY book_id, s ORDER BY i) AS o FROM r_line),
r_count AS (SELECT book_id, s, chunk_text, max(o) AS n, max(CASE WHEN i = 0 THEN rtrim(line, {WS}) END) AS heading,
  string_agg(line, chr(10) ORDER BY i) FILTER (WHERE o = 0 AND i > 0) AS intro,
  coalesce(bool_or(trim(line, {WS}) <> '') FILTER (WHERE o = 0 AND i > 0), false) AS filled
  FROM r_mark GROUP BY book_id, s, chunk_text),
r_opt AS (SELECT book_id, s, o, string_agg(line, chr(10) ORDER BY i) AS body,
  max(CASE WHEN is_opt THEN rtrim(trim(regexp_extract(line, '{_OPT}', 2), {WS}), ':') END) AS title,
  max(CASE WHEN is_opt THEN lower(regexp_extract(line, '{_OPT}', 1)) || ')' END) AS label
  FROM r_mark WHERE o > 0 GROUP BY book_id, s, o),
r_all AS (
  SELECT book_id, s, 0 AS o, chunk_text FROM r_count WHERE n < 2
  UNION ALL
  SELECT c.book_id, c.s, t.o, trim(trim(c.heading || ' - ' || CASE WHEN t.title <> '' THEN t.title ELSE t.label END, {WS})
    || chr(10) || CASE WHEN c.filled THEN c.intro || chr(10) ELSE '' END || t.body, {WS})
  FROM r_count c JOIN r_opt t ON t.book_id = c.book_id AND t.s = c.s WHERE c.n >= 2
),
{out} AS (SELECT book_id, chunk_text, row_number() OVER (PARTITION BY book_id ORDER BY s, o) - 1 AS chunk_index
  FROM r_all WHERE length(chunk_text) >= 150)"""


@query("split_options", f"{LINES_CTE}, {recipes_sql('chunks')} {_PICK}")
def split_options(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.recipes, "book_id")


_VEG = (
    "(" + rx("line", "(?i)^\\s*#{2,4}\\s*(?:\\(?\\s*\\d+\\s*\\)?\\s*[,\\.)]?|\\d+\\))\\s+\\S+")
    + f" OR ({rx(f'trim(line, {WS})', '^\\s*#{2,4}\\s*[A-ZÀ-Ỵ][A-ZÀ-Ỵ\\s\\-]{2,}$')} AND length(trim(line, {WS})) <= 60"
    + f" AND NOT {rx(f'upper(trim(line, {WS}))', 'CÁC LOÀI|MỤC LỤC|GIỚI THIỆU')}))"
)


def vegetables_sql(out: str) -> str:
    return f"""
{pieces_sql('lines', _VEG, 0, 'v_entry')},
{entry_lines_sql('v_entry', 'v_line')},
v_head AS (SELECT book_id, s, coalesce(min(CASE WHEN i < 10 AND {rx('line', '^\\s*#{2,4}\\s+')} THEN i END), 0) AS at,
  min(CASE WHEN {rx('line', '^\\s*\\d{1,3}\\s*\\.\\s+')} THEN i END) AS first_n,
  min(CASE WHEN {rx('line', '^\\s*0*2\\s*\\.\\s+')} THEN i END) AS sec2
  FROM v_line GROUP BY book_id, s),
v_base AS (SELECT h.*, l.line AS heading, l.nlines,
  upper(split_part(trim(regexp_replace({heading_sql('l.line')}, '^\\(?\\s*\\d+\\s*\\)?\\s*[\\.)]?\\s*', '')), ' ', 1)) AS base
  FROM v_head h JOIN v_line l ON l.book_id = h.book_id AND l.s = h.s AND l.i = h.at),
v_ctx AS (SELECT l.book_id, l.s, l.i, l.line, trim(l.line, {WS}) AS bare, b.base, b.first_n, b.sec2, b.nlines, b.at, b.heading,
  max(CASE WHEN trim(l.line, {WS}) <> '' THEN l.i END) OVER
    (PARTITION BY l.book_id, l.s ORDER BY l.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM v_line l JOIN v_base b ON b.book_id = l.book_id AND b.s = l.s),
v_cand AS (SELECT * FROM v_ctx WHERE nlines >= 10 AND base <> '' AND i >= first_n AND ltrim(line, {WS}) NOT LIKE '#%'
  AND length(bare) BETWEEN 4 AND 40 AND {caps_sql('bare')}
  AND list_contains(string_split(regexp_replace(upper(bare), '\\s+', ' ', 'g'), ' '), base)),
v_name AS (SELECT book_id, s, bare AS title, min(i) AS i, any_value(sec2) AS sec2, any_value(nlines) AS nlines
  FROM v_cand GROUP BY book_id, s, bare),
v_block AS (SELECT n.book_id, n.s, n.title, n.sec2, n.nlines, n.i AS title_at, count(*) OVER (PARTITION BY n.book_id, n.s) AS names,
  coalesce((SELECT max(p.i) FROM v_line p WHERE p.book_id = n.book_id AND p.s = n.s AND p.i = c.above
     AND {rx('p.line', '^\\s*!\\[\\]\\(|^\\s*!\\[[^\\]]*\\]\\(')}), n.i) AS lo,
  least(lead(n.i, 1, n.nlines) OVER (PARTITION BY n.book_id, n.s ORDER BY n.i), coalesce(n.sec2, n.nlines)) AS hi
  FROM v_name n JOIN v_ctx c ON c.book_id = n.book_id AND c.s = n.s AND c.i = n.i),
v_keep AS (SELECT *, count(*) OVER (PARTITION BY book_id, s) AS kept, min(lo) OVER (PARTITION BY book_id, s) AS first_lo,
  max(hi) OVER (PARTITION BY book_id, s) AS last_hi
  FROM v_block WHERE names >= 2 AND (sec2 IS NULL OR lo < sec2)),
v_part AS (SELECT k.book_id, k.s, k.title_at, k.title, x.heading,
    CASE WHEN x.i < k.first_lo AND x.i <> x.at THEN 1 WHEN x.i >= k.last_hi AND x.i < k.sec2 THEN 3 WHEN x.i >= k.sec2 THEN 4 END AS shared,
    x.i >= k.lo AND x.i < k.hi AS own, x.i, x.line
  FROM v_keep k JOIN v_ctx x ON x.book_id = k.book_id AND x.s = k.s WHERE k.kept >= 2),
v_rows AS (
  SELECT book_id, s, title_at, title, heading, 2 AS part, i, line FROM v_part WHERE own
  UNION ALL
  SELECT book_id, s, title_at, title, heading, shared, i, line FROM
    (SELECT *, bool_or(trim(line, {WS}) <> '') OVER (PARTITION BY book_id, s, title_at, shared) AS filled FROM v_part WHERE shared IS NOT NULL)
    WHERE filled),
v_text AS (SELECT book_id, s, title_at, trim(any_value(trim(rtrim(heading, {WS}) || ' - ' || title, {WS})) || chr(10)
    || string_agg(line, chr(10) ORDER BY part, i), {WS}) AS chunk_text FROM v_rows GROUP BY book_id, s, title_at),
v_all AS (
  SELECT book_id, s, title_at, chunk_text FROM v_text
  UNION ALL
  SELECT book_id, s, 0, chunk_text FROM v_entry e WHERE NOT EXISTS (SELECT 1 FROM v_text t WHERE t.book_id = e.book_id AND t.s = e.s)),
{out} AS (SELECT book_id, chunk_text, row_number() OVER (PARTITION BY book_id ORDER BY s, title_at) - 1 AS chunk_index
  FROM v_all WHERE length(chunk_text) >= 250)"""


@query("split_variants", f"{LINES_CTE}, {vegetables_sql('chunks')} {_PICK}")
def split_variants(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.vegetables, "book_id")


_CHAPTER = "^\\s*#{1,3}\\s*(?:\\*{1,2}\\s*)?(\\d{1,3})\\s*[\\.)]\\s+(.+?)\\s*$"
_MONOGRAPH = "^\\s*#{1,4}\\s*(?:\\*{1,2}\\s*)?(\\d{1,3})\\s*(?:[\\.)]\\s+|\\s+)(.+?)\\s*$"


def _third_sql(name: str) -> str:
    return f"""{name}_3 AS (SELECT book_id, min(i) AS at FROM lines WHERE {rx('line', '(?i)^\\s*#\\s*PHẦN\\s+THỨ\\s+BA' + END)} GROUP BY book_id)"""


def chapters_sql(out: str) -> str:
    title = heading_sql(f"regexp_extract(line, '{_CHAPTER}', 2)")
    return f"""
{out}_2 AS (SELECT book_id, min(i) AS at FROM lines WHERE {rx('line', '(?i)^\\s*#\\s*PHẦN\\s+THỨ\\s+HAI' + END)} GROUP BY book_id),
{_third_sql(out)},
{out}_b AS (SELECT l.book_id, l.i, l.line, {title.replace('line', 'l.line')} AS title FROM lines l
  JOIN {out}_2 a ON a.book_id = l.book_id LEFT JOIN {out}_3 b ON b.book_id = l.book_id
  WHERE l.i >= a.at AND (b.at IS NULL OR l.i < b.at)),
{out}_h AS (SELECT book_id, i, line, {rx('line', _CHAPTER)} AND length(title) <= 110 AND {upper_share_sql('title', 0.8)}
  AND NOT (title LIKE '%:' AND length(title) < 35) AS hit FROM {out}_b),
{pieces_sql(out + '_h', 'hit', 350, out)}"""


def monographs_sql(out: str) -> str:
    title = heading_sql(f"regexp_extract(l.line, '{_MONOGRAPH}', 2)")
    return f"""
{_third_sql(out)},
{out}_b AS (SELECT l.book_id, l.i, l.line, {title} AS title FROM lines l JOIN {out}_3 a ON a.book_id = l.book_id WHERE l.i >= a.at),
{out}_h AS (SELECT book_id, i, line, {rx('line', _MONOGRAPH)} AND length(title) <= 60 AND {upper_share_sql('title', 0.85)}
  AND NOT {rx('upper(title)', '^(BÀI THUỐC|CÁC BÀI THUỐC)')} AS hit FROM {out}_b),
{pieces_sql(out + '_h', 'hit', 300, out)}"""


@query("split_chapters", f"{LINES_CTE}, {chapters_sql('chunks')} {_PICK}")
def split_chapters(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.chapters, "book_id")


@query("split_monographs", f"{LINES_CTE}, {monographs_sql('chunks')} {_PICK}")
def split_monographs(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.monographs, "book_id")


_PATTERN = "(?i)^\\s*#{2,6}\\s*(?:\\*{0,2}\\s*)?(?:\\(?\\s*\\d+\\s*\\)?\\s*[\\.)])\\s*(Thể|Chứng)" + END
_EXPERIENCE = "(?i)^\\s*#{1,6}\\s*.*bài\\s+thuốc\\s+kinh\\s+nghiệm"


@query(
    "split_nested",
    f"""{LINES_CTE}, {chapters_sql('ch')}, {entry_lines_sql('ch', 'n_line')},
n_mark AS (SELECT *, sum(CAST({rx('line', _PATTERN)} OR {rx('line', _EXPERIENCE)} AS INT))
  OVER (PARTITION BY book_id, s ORDER BY i) AS o FROM n_line),
n_head AS (SELECT book_id, s, chunk_text, max(o) AS n, trim(max(CASE WHEN i = 0 THEN line END), {WS}) AS title
  FROM n_mark GROUP BY book_id, s, chunk_text),
n_piece AS (SELECT book_id, s, o, trim(string_agg(line, chr(10) ORDER BY i), {WS}) AS t FROM n_mark WHERE o > 0 GROUP BY book_id, s, o),
n_all AS (SELECT book_id, s, 0 AS o, chunk_text FROM n_head WHERE n = 0
  UNION ALL SELECT h.book_id, h.s, p.o, h.title || chr(10) || chr(10) || p.t FROM n_head h
  JOIN n_piece p ON p.book_id = h.book_id AND p.s = h.s WHERE p.t <> '')
SELECT book_id, chunk_text, row_number() OVER (PARTITION BY book_id ORDER BY s, o) - 1 AS chunk_index
FROM n_all WHERE length(chunk_text) >= 220""",
)
def split_nested(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.patterns, "book_id")


_NUM_ONLY = "^\\s*\\d{1,3}\\s*\\.\\s*$"
_NUM_TITLE = "^\\s*\\d{1,3}\\s*\\.\\s+(.+?)\\s*$"


def protocols_sql(out: str) -> str:
    return f"""
e_line AS (SELECT book_id, i, line, trim(line, {WS}) AS bare, {rx('line', _NUM_ONLY)} AS num_only FROM lines),
e_flag AS (SELECT *, {caps_sql('bare')} AS caps, bare <> '' AND NOT num_only AND NOT {caps_sql('bare')}
  AND NOT contains(lower(bare), '</break>') AND {rx('bare', '[a-zà-ỹ]')} AS is_body FROM e_line),
e_win AS (SELECT *,
  coalesce(sum(CAST(is_body AS INT)) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 59 FOLLOWING), 0) >= 2 AS body60,
  coalesce(sum(CAST(is_body AS INT)) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND 29 FOLLOWING), 0) >= 2 AS body30,
  coalesce(sum(CAST(num_only AS INT)) OVER (PARTITION BY book_id ORDER BY i ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) >= 3 AS crowded
  FROM e_flag),
e_fill AS (SELECT *,
  lead(caps) OVER w AS next_caps, lead(body30) OVER w AS next_body30,
  lag(num_only AND NOT crowded) OVER w AS prev_number FROM e_win WHERE bare <> ''
  WINDOW w AS (PARTITION BY book_id ORDER BY i)),
e_start AS (SELECT book_id, i FROM e_fill WHERE
  ({rx('line', _NUM_TITLE)} AND {caps_sql(f"trim(regexp_extract(line, '{_NUM_TITLE}', 1), {WS})")} AND body60
    AND NOT coalesce(prev_number AND caps, false))
  OR (num_only AND NOT crowded AND coalesce(next_caps AND next_body30, false))),
e_all AS (SELECT l.book_id, l.i, l.line, s.i IS NOT NULL AS hit FROM lines l LEFT JOIN e_start s ON s.book_id = l.book_id AND s.i = l.i),
{pieces_sql('e_all', 'hit', 300, out)}"""


@query("split_numbered_protocols", f"{LINES_CTE}, {protocols_sql('chunks')} {_PICK}")
def split_numbered_protocols(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.protocols, "book_id")


@query(
    "split_dispatch",
    f"""{LINES_CTE}, {plants_sql('pl')}, {vegetables_sql('ve')}, {chapters_sql('ch')}, {monographs_sql('mo')}, {protocols_sql('pr')},
endo AS (SELECT book_id, 0 AS k, chunk_index, chunk_text FROM ch UNION ALL SELECT book_id, 1, chunk_index, chunk_text FROM mo),
picked AS (
  SELECT book_id, chunk_index, chunk_text FROM pl WHERE book_id % 5 = 0
  UNION ALL SELECT book_id, chunk_index, chunk_text FROM ve WHERE book_id % 5 = 1
  UNION ALL SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY k, chunk_index) - 1, chunk_text FROM endo WHERE book_id % 5 = 2
  UNION ALL SELECT book_id, chunk_index, chunk_text FROM pr WHERE book_id % 5 = 3
  UNION ALL SELECT book_id, 0, trim(text, {WS}) FROM books WHERE book_id % 5 = 4 AND trim(text, {WS}) <> '')
SELECT b.path || ':#' || CAST(p.chunk_index AS VARCHAR) AS id, b.path AS source_path, p.chunk_index, p.chunk_text,
  'BaseModel' AS schema_name FROM picked p JOIN books b ON b.book_id = p.book_id""",
)
def split_dispatch(spark, sf_dir):
    return seg.chunk_records(books(spark, sf_dir))


_STRIP_PIECE = f"trim(piece, {WS})"


def _cut_sql(mark: str) -> str:
    return f"""{BOOKS_CTE},
cut AS (SELECT book_id, unnest(string_split(text, {mark})) AS piece, unnest(range(len(string_split(text, {mark})))) AS k FROM books)
SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY k) - 1 AS chunk_index, {_STRIP_PIECE} AS chunk_text
FROM cut WHERE {_STRIP_PIECE} <> ''"""


@query("chunk_section", _cut_sql("chr(10) || '#'"))
def chunk_section(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.by_section, "book_id")


@query("chunk_paragraph", _cut_sql("chr(10) || chr(10)"))
def chunk_paragraph(spark, sf_dir):
    return seg.split_texts(books(spark, sf_dir), sp.by_paragraph, "book_id")
