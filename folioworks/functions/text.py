"""Text rules over one document, line, answer or name."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.core import (
    WHITESPACE,
    bind,
    is_blank,
    join_lines,
    lstrip,
    rstrip,
    span,
    strip,
    to_lines,
    unify_newlines,
)

# White space as patterns see it: without the four separators that a strip removes, too.
LINE_SPACE = "".join(c for c in WHITESPACE if not "\x1c" <= c <= "\x1f")

# --- whitespace and keys ------------------------------------------------------------------------


def trim_blank_edges(text: Column) -> Column:
    """Drop blank lines at both ends, keep the inner ones and the first line's indent."""
    no_top = F.regexp_replace(unify_newlines(text), r"(?U)\A(?:[^\S\n]*\n)+", "")

    def without_end(t: Column) -> Column:
        # To the last filled character, and on to the end of its line.
        filled = F.rtrim(t, F.lit(LINE_SPACE))
        rest = F.substring_index(F.substr(t, F.length(filled) + 1), "\n", 1)
        return F.when(filled == "", "").otherwise(F.concat(filled, rest))

    return bind(no_top, without_end)


def normalize_spaces(text: Column) -> Column:
    one_space = F.regexp_replace(unify_newlines(text), "[ \t]+", " ")
    return strip(F.regexp_replace(one_space, "\n{3,}", "\n\n"))


def collapse(text: Column) -> Column:
    """Every whitespace run becomes one space."""
    return F.regexp_replace(strip(text), r"(?U)\s+", " ")


def join_key(text: Column) -> Column:
    """Key under which two runs agree on a question; NULL counts as empty."""
    return collapse(F.translate(F.coalesce(text, F.lit("")), " ", " "))


def heading_text(line: Column) -> Column:
    bare = F.regexp_replace(line, r"(?U)^\s*#{1,6}\s*", "")
    return collapse(F.translate(bare, "*_", ""))


# --- repeats ------------------------------------------------------------------------------------


def drop_repeated_lines(text: Column) -> Column:
    """Drop a line equal to the one before it, and all but one of a run of blank lines."""

    def keep(ls: Column, bare: Column) -> Column:
        return F.filter(ls, lambda _, i: (i == 0) | (F.get(bare, i) != F.get(bare, i - 1)))

    kept = bind(
        to_lines(text),
        lambda ls: bind(F.transform(ls, strip), lambda bare: keep(F.transform(ls, rstrip), bare)),
    )
    return strip(join_lines(kept))


def _first_per_key(items: Column) -> Column:
    """First item per case-folded key, in the original order.

    Without repeats the items are returned at once. Else sort by (key, position), keep the head of
    every key and sort back: n log n for any length.
    """

    def heads(t: Column) -> Column:
        return F.filter(t, lambda x, j: (j == 0) | (x["k"] != F.get(t, j - 1)["k"]))

    def pick(found: Column, keys: Column) -> Column:
        tagged = F.sort_array(
            F.transform(found, lambda s, i: F.struct(F.get(keys, i).alias("k"), i.alias("i"), s.alias("s")))
        )
        back = F.sort_array(
            F.transform(bind(tagged, heads), lambda x: F.struct(x["i"].alias("i"), x["s"].alias("s")))
        )
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), found).otherwise(
            F.transform(back, lambda x: x["s"])
        )

    return bind(items, lambda found: bind(F.transform(found, F.lower), lambda keys: pick(found, keys)))


def first_of_each(items: Column) -> Column:
    """First of equal items, spaces normalised, blanks and NULLs dropped."""
    return _first_per_key(F.filter(F.transform(items, normalize_spaces), lambda s: s != ""))


def drop_repeated_sentences(text: Column) -> Column:
    """Keep the first of equal sentences. The pieces of a normalised text need no second clean-up."""
    sentences = F.filter(F.split(normalize_spaces(text), fv.SENTENCE_END, -1), lambda s: s != "")
    return F.array_join(_first_per_key(sentences), " ")


def clean_text(text: Column) -> Column:
    return drop_repeated_sentences(drop_repeated_lines(text))


# --- model input --------------------------------------------------------------------------------


def _short_images(line: Column) -> Column:
    named = F.regexp_replace(line, r"(?U)!\[\]\(!\[id:\s*([^\]]*?[^\]\s])\s*\]\([^)]+?\)\)", "[[IMAGE:$1]]")
    named = F.regexp_replace(named, fv.NESTED_IMAGE, "[[IMAGE]]")
    return F.when(F.contains(line, F.lit("![")), F.regexp_replace(named, fv.GENERIC_IMAGE, "[[IMAGE]]")).otherwise(line)


def _sanitize_line(line: Column) -> Column:
    def unnumbered(x: Column) -> Column:
        heading = F.startswith(lstrip(x), F.lit("#"))
        return F.when(heading, F.regexp_replace(x, fv.HEADING_NUMBER, "$1")).otherwise(
            F.regexp_replace(x, fv.PLAIN_NUMBER, "")
        )

    def tidy(bare: Column) -> Column:
        plain = bind(bind(F.regexp_replace(bare, fv.BREAK_TAG, " "), unnumbered), _short_images)
        return F.when(bare.rlike(fv.PAGE_MARKER), "").otherwise(
            rstrip(F.regexp_replace(plain, r"(?U)\s{2,}", " "))
        )

    return bind(F.regexp_replace(line, fv.HTML_COMMENT, " "), tidy)


def sanitize_chunk(text: Column) -> Column:
    """Compact OCR artefacts before a chunk goes to a model."""

    def collapse_blanks(ls: Column) -> Column:
        return F.filter(ls, lambda x, i: ~((i > 0) & is_blank(x) & is_blank(F.get(ls, i - 1))))

    cleaned = F.transform(to_lines(text), lambda x: F.when(x == "", x).otherwise(_sanitize_line(x)))
    return strip(join_lines(bind(cleaned, collapse_blanks)))


# --- answers ------------------------------------------------------------------------------------


def clean_answer(text: Column) -> Column:
    """Drop embedded images, labels and stray data URLs, then cap the length with a note."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), fv.ANSWER_IMAGE, "")
    t = F.regexp_replace(t, fv.ANSWER_LABEL, "")
    t = F.regexp_replace(t, fv.ANSWER_DATA_URL, "")
    t = strip(F.regexp_replace(t, fv.ANSWER_BLANK_RUN, "\n\n"))
    return F.when(
        F.length(t) > fv.ANSWER_MAX_CHARS, F.concat(F.left(t, F.lit(fv.ANSWER_MAX_CHARS)), F.lit(fv.ANSWER_CUT_NOTE))
    ).otherwise(t)


def compact_answer(text: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(text, F.lit("")), fv.ANSWER_IMAGE, ""))


def is_failed_answer(text: Column) -> Column:
    low = F.lower(text)
    failed = strip(text) == ""
    for phrase in fv.FAILED_ANSWER_PHRASES:
        failed = failed | F.contains(low, F.lit(phrase))
    return failed


def shorten(text: Column, max_chars: int) -> Column:
    return F.when(
        F.length(text) > max_chars, F.concat(F.left(text, F.lit(max_chars)), F.lit("..."))
    ).otherwise(text)


def images_before_sources(answer: Column, images: Column) -> Column:
    """Put the images block before the last sources line, or at the end."""

    def place(ls: Column) -> Column:
        marks = F.filter(
            F.transform(ls, lambda x, i: F.when(F.startswith(F.lower(strip(x)), F.lit(fv.SOURCES_LABEL)), i)),
            lambda i: i.isNotNull(),
        )
        at = F.get(marks, F.size(marks) - 1)
        placed = join_lines(F.concat(span(ls, 0, at), F.array(images), span(ls, at, F.size(ls))))
        appended = F.concat(rstrip(answer), F.lit("\n"), images)
        return strip(F.when(at.isNotNull(), placed).otherwise(appended))

    return F.when(F.coalesce(images, F.lit("")) == "", answer).otherwise(bind(to_lines(answer), place))


# --- names and questions ------------------------------------------------------------------------


def _accent_table() -> tuple[str, str]:
    """Precomposed Latin letters and their base letters, from Unicode decomposition."""
    marked, base = [], []
    for code in range(0x00C0, 0x1F00):
        parts = unicodedata.normalize("NFD", chr(code))
        bare = "".join(ch for ch in parts if unicodedata.category(ch) != "Mn")
        if len(parts) > 1 and len(bare) == 1 and bare.isascii():
            marked.append(chr(code))
            base.append(bare)
    return "".join(marked), "".join(base)


_MARKED, _BASE = _accent_table()


def fold_accents(text: Column) -> Column:
    """Trimmed, lower-case, without combining marks, single-spaced. The letter đ has no mark."""
    low = F.translate(F.lower(strip(F.coalesce(text, F.lit("")))), _MARKED, _BASE)
    return F.regexp_replace(F.regexp_replace(low, r"\p{Mn}+", ""), r"(?U)\s+", " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(fold_accents(text), "đ", "d"), F.lit("[a-z0-9]+"), F.lit(0))


def name_tokens(text: Column) -> Column:
    return F.filter(words(text), lambda w: ~w.isin(*fv.NAME_STOPWORDS))


def focus_tokens(question: Column) -> Column:
    """Words after the first focus word up to a stop word; all tokens when there are none."""

    def pick(ws: Column) -> Column:
        at = F.array_position(ws, fv.FOCUS_WORD).cast("int")
        tail = F.when(at > 0, span(ws, at, F.size(ws))).otherwise(F.array().cast("array<string>"))
        stop = F.array_position(F.transform(tail, lambda w: w.isin(*fv.NAME_STOPWORDS)), True).cast("int")
        named = F.when(stop > 0, span(tail, 0, stop - 1)).otherwise(tail)
        return F.when(F.size(named) > 0, named).otherwise(
            F.filter(ws, lambda w: ~w.isin(*fv.NAME_STOPWORDS))
        )

    return bind(words(question), pick)


def asks_for_picture(question: Column) -> Column:
    return F.coalesce(question, F.lit("")).rlike(fv.PICTURE_QUESTION)


def mentions_any(text: Column, wanted: tuple[str, ...]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.lit(False)
    for word in wanted:
        found = found | F.contains(low, F.lit(word))
    return found


# --- JSON, ids, files ---------------------------------------------------------------------------


def without_code_fence(text: Column) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    opened = F.regexp_replace(t, r"\A```[a-zA-Z0-9_\-]*\n", "")
    closed = F.regexp_replace(opened, r"(?U)\n```\s*\z", "")
    return strip(F.when(F.startswith(t, F.lit("```")), closed).otherwise(t))


def json_object_in(text: Column) -> Column:
    """First opening to last closing brace; the rest of the text when nothing closes it."""

    def cut(s: Column) -> Column:
        whole = F.regexp_extract(s, r"(?s)\{.*\}", 0)
        tail = F.regexp_extract(s, r"(?s)\{.*", 0)
        return F.when(whole != "", whole).when(tail != "", strip(tail)).otherwise(s)

    return bind(without_code_fence(text), cut)


def first_json_line(line: Column) -> Column:
    """From the first brace on; a JSON reader then takes the first object."""
    at = F.instr(line, "{")
    return F.when(at > 0, F.substr(line, at))


def record_id(path: Column, index: Column) -> Column:
    return F.concat(path, F.lit(":#"), index.cast("string"))


def line_hint(chunk_id: Column) -> Column:
    n = F.regexp_extract(chunk_id, r"(?U):#(\d+)\s*$", 1).try_cast("int")
    return F.when(n > 0, n)


def shown_string(s: Column) -> Column:
    """A string in quotes with escapes: single quotes, or double ones if it has single quotes only."""
    escaped = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    for char, mark in (("\n", "n"), ("\r", "r"), ("\t", "t")):
        escaped = F.replace(escaped, F.lit(char), F.lit("\\" + mark))
    # Characters that don't print: as codes.
    hidden = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}\p{Cn}\p{Co}]|[\p{Zs}&&[^ ]]"

    def code(c: Column) -> Column:
        at = F.when(F.length(c) == 1, F.conv(F.hex(F.encode(c, "UTF-32")), 16, 10).cast("int"))
        digits = F.lower(F.hex(at))
        return (
            F.when(at < 256, F.concat(F.lit("\\x"), F.lpad(digits, 2, "0")))
            .when(at < 65536, F.concat(F.lit("\\u"), F.lpad(digits, 4, "0")))
            .otherwise(F.concat(F.lit("\\U"), F.lpad(digits, 8, "0")))
        )

    def coded(t: Column) -> Column:
        chars = F.split(t, "")
        return F.array_join(F.transform(chars, lambda c: F.when(c.rlike(hidden), code(c)).otherwise(c)), "")

    escaped = bind(escaped, lambda t: F.when(t.rlike(hidden), coded(t)).otherwise(t))
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    single = F.concat(F.lit("'"), F.replace(escaped, F.lit("'"), F.lit("\\'")), F.lit("'"))
    return F.when(double, F.concat(F.lit('"'), escaped, F.lit('"'))).otherwise(single)


def _shown(v: Column, depth: int) -> Column:
    """A VARIANT value as a literal: strings quoted, True, False and None by name, lists and objects nested."""
    kind = F.schema_of_variant(v)
    text = F.try_variant_get(v, "$", "string")
    out = (
        F.when(v.isNull() | F.is_variant_null(v) | (kind == "VOID"), "None")
        .when(kind == "BOOLEAN", F.initcap(text))
        .when(kind == "STRING", shown_string(text))
    )
    number = F.when(kind.isin("DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL")), shown_number(text))
    out = out.when(number.isNotNull(), number)
    if depth:
        def inner(x: Column) -> Column:
            return bind(x, lambda y: _shown(y, depth - 1))

        listed = F.transform(F.try_variant_get(v, "$", "array<variant>"), inner)
        pairs = F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))
        named = F.transform(
            pairs, lambda e: F.concat(shown_string(e["key"]), F.lit(": "), inner(e["value"]))
        )
        out = out.when(
            F.startswith(kind, F.lit("ARRAY")), F.concat(F.lit("["), F.array_join(listed, ", "), F.lit("]"))
        ).when(F.startswith(kind, F.lit("OBJECT")), F.concat(F.lit("{"), F.array_join(named, ", "), F.lit("}")))
    return out.otherwise(text)


def shown_number(text: Column) -> Column:
    """A number with a fraction: always with a point, or with a two-digit exponent."""
    plain = F.when(F.contains(text, F.lit("E")), text).when(F.contains(text, F.lit(".")), text)
    return F.coalesce(plain, F.concat(text, F.lit(".0")))


def stable_id(text: Column, metadata: Column, depth: int = 2) -> Column:
    """Content hash of a text and its metadata, independent of the metadata's order.

    ``metadata`` is a map of strings or of VARIANT values (nested up to ``depth``); NULL values count.
    """

    def pairs(values: Column) -> Column:
        def pair(k: Column) -> Column:
            value = bind(F.element_at(values, k), lambda v: _shown(v, depth))
            return F.concat(F.lit("("), shown_string(k), F.lit(", "), value, F.lit(")"))

        return F.array_join(F.transform(F.sort_array(F.map_keys(metadata)), pair), ", ")

    listed = bind(metadata.cast("map<string,variant>"), pairs)
    return F.sha1(F.concat(text, F.lit("\n["), listed, F.lit("]")).cast("binary"))


def content_hash(data: Column) -> Column:
    return F.sha2(data, 256)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/\\]+$", 0)


def file_suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(file_name(path), r"\.([^.]+)$", 1))


def mime_type(path: Column) -> Column:
    suffix = file_suffix(path)
    out = F.lit(None).cast("string")
    for name, mime in reversed(fv.MIME_BY_SUFFIX):
        out = F.when(suffix == name, mime).otherwise(out)
    return out


def data_url(mime: Column, data: Column) -> Column:
    return F.concat(
        F.lit("data:"), F.coalesce(mime, F.lit("application/octet-stream")), F.lit(";base64,"), F.base64(data)
    )


def fixed_point(value: Column, digits: int) -> Column:
    """Decimal text with a fixed number of digits, ties to even, no grouping."""
    return F.translate(F.format_number(value, digits), ",", "")


def human_size(size: Column) -> Column:
    last = size.cast("double") / F.lit(1024.0 ** len(fv.SIZE_UNITS))
    out = F.concat(fixed_point(last, 1), F.lit(" " + fv.SIZE_LAST_UNIT))
    for power, unit in reversed(list(enumerate(fv.SIZE_UNITS))):
        scaled = size.cast("double") / F.lit(1024.0**power)
        out = F.when(scaled < 1024, F.concat(fixed_point(scaled, 1), F.lit(" " + unit))).otherwise(out)
    return out


def local_image_url(url: Column) -> Column:
    """The path of a local image reference without its title, or NULL when it is not one."""
    path = F.split_part(strip(url), F.lit(" "), F.lit(1))
    remote = path.rlike("^(http://|https://|data:)")
    suffix = F.concat(F.lit("."), file_suffix(F.translate(path, "\\", "/")))
    return F.when(~remote & (path != "") & suffix.isin(*fv.IMAGE_SUFFIXES), F.translate(path, "\\", "/"))


# --- document counts ----------------------------------------------------------------------------


def line_count(text: Column) -> Column:
    return F.size(F.split(text, "\n", -1))


def heading_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?mdU)^#+\s"))


def filled_line_count(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "\n", -1), lambda x: ~is_blank(x)))


def table_mark_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\n\|"))


def sample_count(text: Column, images: Column) -> Column:
    return heading_count(text) + filled_line_count(text) + table_mark_count(text) + images


def density_class(text: Column, width: Column, height: Column) -> Column:
    """'digital' for a page with enough characters per area, else 'scanned'."""
    n = F.length(strip(text))
    area = width * height
    dense = (n >= fv.DIGITAL_MIN_CHARS) & (area > 0) & (F.try_divide(n, area) >= fv.DIGITAL_MIN_DENSITY)
    return F.when(F.coalesce(dense, F.lit(False)), "digital").otherwise("scanned")
