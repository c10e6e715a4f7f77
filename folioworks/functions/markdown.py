"""Markdown repair, structure and inline spans."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.core import (
    bind,
    interleave,
    join_lines,
    lstrip,
    rstrip,
    scan,
    span,
    strip,
    to_lines,
    where_index,
)
from folioworks.functions.text import collapse

# --- line and link repair -----------------------------------------------------------------------


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def repair_line(line: Column, strict: bool = False) -> Column:
    """Put the missing space after heading, quote and list marks.

    The default rules also touch a leading ``**bold`` and ``1.5``; the strict ones leave those alone.
    """
    for pattern, replacement in fv.LINE_REPAIRS_STRICT if strict else fv.LINE_REPAIRS:
        line = F.regexp_replace(line, pattern, replacement)
    return line


def repair_lines(text: Column, strict: bool = False) -> Column:
    return join_lines(F.transform(_lines(text), lambda x: repair_line(x, strict)))


def _close_bold(line: Column) -> Column:
    bold = F.regexp_count(line, F.lit(r"(?<!\\)\*\*"))
    open_bold = (bold % 2 == 1) & ~F.endswith(rstrip(line), F.lit("**"))
    return F.when(open_bold, F.concat(rstrip(line), F.lit("**"))).otherwise(line)


def repair_emphasis_line(line: Column) -> Column:
    """Close an unpaired bold mark, then an unpaired single mark, at the end of the line."""
    bold = F.regexp_count(line, F.lit(r"(?<!\\)\*\*"))
    single = F.regexp_count(line, F.lit(r"(?<!\\)[*_]")) - bold * 2

    def close_single(closed: Column) -> Column:
        needs = (
            (single % 2 == 1)
            & closed.rlike(r"(?U)[*_][^*_\s]")
            & ~rstrip(closed).rlike(r"[*_]\z")
            & F.contains(closed, F.lit("*"))
        )
        return F.when(needs, F.concat(rstrip(closed), F.lit("*"))).otherwise(closed)

    marked = F.contains(line, F.lit("*")) | F.contains(line, F.lit("_"))
    return F.when(marked, bind(_close_bold(line), close_single)).otherwise(line)


def repair_emphasis(text: Column) -> Column:
    return join_lines(F.transform(_lines(text), repair_emphasis_line))


def repair_links(text: Column) -> Column:
    """Close brackets left open at a line end. An open bracket may have begun lines earlier."""
    for pattern, replacement in fv.LINK_REPAIRS:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def repair_tables(text: Column) -> Column:
    """Give every line with a pipe its outer pipes; separators under one are closed as well."""

    def fix(ls: Column) -> Column:
        def row(x: Column, i: Column) -> Column:
            bare = strip(x)
            under = (i > 0) & F.contains(F.get(ls, i - 1), F.lit("|"))
            open_separator = (
                F.coalesce(under, F.lit(False)) & bare.rlike(fv.TABLE_SEPARATOR) & ~F.endswith(bare, F.lit("|"))
            )
            left = F.when(F.startswith(bare, F.lit("|")), x).otherwise(F.concat(F.lit("|"), x))
            both = F.when(F.endswith(strip(left), F.lit("|")), left).otherwise(F.concat(left, F.lit("|")))
            fixed = F.when(open_separator, F.concat(bare, F.lit("|"))).otherwise(both)
            return F.when(F.contains(x, F.lit("|")), fixed).otherwise(x)

        return F.transform(ls, row)

    return join_lines(bind(_lines(text), fix))


def repair_syntax(text: Column, strict: bool = False) -> Column:
    def line(x: Column) -> Column:
        return repair_emphasis_line(repair_line(x, strict))

    return repair_tables(repair_links(join_lines(F.transform(_lines(text), line))))


# --- headings and section breaks ----------------------------------------------------------------


def heading_level(line: Column) -> Column:
    bare = strip(line)
    hashes = F.length(F.regexp_extract(bare, fv.HEADING_HASHES, 1))
    return F.when(hashes > 0, hashes).when(bare.rlike(fv.HEADING_LEVEL_TWO), 2).otherwise(0)


def insert_breaks(text: Column) -> Column:
    """A break before a level 1 or 2 heading that follows a level 2 heading, and at such an end."""

    def cut(ls: Column, heads: Column) -> Column:
        marks = F.filter(
            heads, lambda h, j: (j > 0) & h["level"].isin(1, 2) & (F.get(heads, j - 1)["level"] == 2)
        )
        bounds = F.concat(F.array(F.lit(0)), F.transform(marks, lambda h: h["at"]))
        parts = bind(
            bounds,
            lambda b: F.transform(
                b, lambda lo, j: join_lines(span(ls, lo, F.coalesce(F.get(b, j + 1), F.size(ls))))
            ),
        )
        open_end = F.get(heads, F.size(heads) - 1)["level"] == 2
        return F.concat(
            F.array_join(parts, f"\n{fv.BREAK_MARK}\n"),
            F.when(open_end, f"\n{fv.BREAK_MARK}").otherwise(""),
        )

    def headings(ls: Column) -> Column:
        tagged = F.transform(ls, lambda x, i: F.struct(heading_level(x).alias("level"), i.alias("at")))
        return F.filter(tagged, lambda h: h["level"] > 0)

    return bind(_lines(text), lambda ls: bind(headings(ls), lambda hs: cut(ls, hs)))


def inline_break(line: Column) -> Column:
    """Mark an ``N.N`` line, and only that depth, with a trailing break."""
    bare = strip(line)
    first = F.split_part(collapse(bare), F.lit(" "), F.lit(1))
    two_parts = bare.rlike(fv.INLINE_BREAK_LINE) & (F.regexp_count(first, F.lit(r"\.")) == 1)
    return F.when(two_parts, F.concat(rstrip(line), F.lit(f" {fv.BREAK_MARK}"))).otherwise(line)


def in_fence(lines: Column) -> Column:
    """For every line whether an odd number of fence lines is above it."""

    def flags(ls: Column, fences: Column) -> Column:
        bounds = F.concat(F.array(F.lit(-1)), fences, F.array(F.size(ls) - 1))

        def repeated(b: Column) -> Column:
            return F.flatten(
                F.transform(
                    F.sequence(F.lit(0), F.size(b) - 2),
                    lambda j: F.array_repeat(j % 2 == 1, F.get(b, j + 1) - F.get(b, j)),
                )
            )

        return bind(bounds, repeated)

    return bind(
        lines,
        lambda ls: bind(
            where_index(ls, lambda x, _: F.startswith(lstrip(x), F.lit("```"))), lambda fences: flags(ls, fences)
        ),
    )


def header_nodes(text: Column) -> Column:
    """Array of (text, header_path): one node per heading, with the titles of its ancestors.

    Lines inside a code fence are never headings. The path is a fold over the headings only.
    """
    pattern = r"(?U)^(#+)\s(.*)"

    def heads(ls: Column) -> Column:
        def fenced(inside: Column) -> Column:
            def head(x: Column, i: Column) -> Column:
                return F.when(
                    x.rlike(pattern) & ~F.get(inside, i),
                    F.struct(
                        F.length(F.regexp_extract(x, pattern, 1)).alias("level"),
                        F.regexp_extract(x, pattern, 2).alias("title"),
                        i.alias("at"),
                    ),
                )

            return F.filter(F.transform(ls, head), lambda h: h.isNotNull())

        return bind(in_fence(ls), fenced)

    def paths(hs: Column) -> Column:
        entry = "array<struct<level:int,title:string>>"

        def step(stack: Column, h: Column) -> tuple[Column, Column]:
            above = F.filter(stack, lambda s: s["level"] < h["level"])
            own = F.array(F.struct(h["level"].alias("level"), h["title"].alias("title")))
            titles = F.array_join(F.transform(above, lambda s: s["title"]), "/")
            path = F.when(F.size(above) == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), titles, F.lit("/")))
            return F.concat(above, own), path

        return scan(hs, F.array().cast(entry), step, "string")

    def nodes(ls: Column, hs: Column, ps: Column) -> Column:
        opening = F.struct(
            strip(join_lines(span(ls, 0, F.coalesce(F.get(hs, 0)["at"], F.size(ls))))).alias("text"),
            F.lit("/").alias("header_path"),
        )
        rest = F.transform(
            hs,
            lambda h, j: F.struct(
                strip(join_lines(span(ls, h["at"], F.coalesce(F.get(hs, j + 1)["at"], F.size(ls))))).alias("text"),
                F.get(ps, j).alias("header_path"),
            ),
        )
        return F.filter(F.concat(F.array(opening), rest), lambda n: n["text"] != "")

    return bind(
        to_lines(text), lambda ls: bind(heads(ls), lambda hs: bind(paths(hs), lambda ps: nodes(ls, hs, ps)))
    )


# --- spelling of OCR output ---------------------------------------------------------------------

_RARE_SPACES = r"\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Any whitespace but plain spaces and line ends: the predefined classes are much faster than a list.
_RARE_SPACE = r"[\h\v&&[^ \n]]"


def _has_odd_space(x: Column) -> Column:
    return F.contains(x, F.lit("  ")) | x.rlike(_RARE_SPACE)


def _in_line(pattern: str) -> str:
    """The rule with whitespace that stays within its line.

    Looking for the first letter before the word start makes a mismatch cheap.
    """
    first = re.match(r"\\b(\w)", pattern)
    ahead = f"(?={first.group(1)})" if first else ""
    return "(?U)" + ahead + pattern.replace(r"\s", f"[ {_RARE_SPACES}]")


def _needed(pattern: str) -> str | None:
    """The plain text a match must contain when every whitespace run is one space, if there is one."""
    bare = pattern.replace(r"\b", "").replace(r"\s+", " ").removeprefix(r"(\d+)").removesuffix(r"(\d+)")
    bare = bare.replace(r"\.", ".").replace(r"\(", "\x00").replace(r"\)", "\x01")
    if re.search(r"[\\\[\]{}()*+?|^$]", bare):
        return None
    return bare.replace("\x00", "(").replace("\x01", ")")


_RULES_PER_GROUP = 8


def apply_rules(text: Column, rules=fv.OCR_RULES, but: tuple[tuple[str, str], ...] = ()) -> Column:
    """Apply ordered (pattern, replacement) rules to every line of a text, but not to lines that match one of ``but``.

    In a line whose whitespace is all single spaces, a plain search tells whether any rule of a
    group can match; the first one to change the line has to match it as it is, so a group without
    such a find is skipped as a whole. Clean lines run no pattern.
    """

    # A replacement that may leave other whitespace behind makes the plain search unsafe.
    tidy = all(r.strip() == r != "" and not re.search(f"[{_RARE_SPACES}]|  ", r) for _, r in rules)

    def group(some, odd: Column):
        def step(x: Column) -> Column:
            possible, changed = odd, x
            for pattern, replacement in some:
                plain = _needed(pattern) if tidy else None
                possible = possible | (F.lit(True) if plain is None else F.contains(x, F.lit(plain)))
                changed = F.regexp_replace(changed, _in_line(pattern), replacement)
            return F.when(possible, changed).otherwise(x)

        return step

    def run(t: Column, odd: Column) -> Column:
        for at in range(0, len(rules), _RULES_PER_GROUP):
            t = bind(t, group(rules[at : at + _RULES_PER_GROUP], odd))
        return t

    first_words, others = set(), set()
    for pattern, _ in rules:
        word = re.match(r"\\b(\w+)(?=\\s\+| |\\b)", pattern)
        if word:
            first_words.add(word.group(1))
        else:
            others.add(_needed(pattern))

    def suspicious(x: Column) -> Column:
        """Whether the line has a word or a text that some rule begins with."""
        if not tidy or None in others:
            return F.lit(True)
        found = F.lit(False)
        for plain in sorted(others):
            found = found | F.contains(x, F.lit(plain))
        if first_words:
            listed = F.array(*[F.lit(w) for w in sorted(first_words)])
            found = found | F.arrays_overlap(F.split(x, r"(?U)\W+"), listed)
        return found

    def kept(x: Column) -> Column:
        found = F.lit(False)
        for sign, pattern in but:
            found = found | (F.contains(x, F.lit(sign)) & x.rlike(pattern))
        return found

    def line(x: Column) -> Column:
        return bind(
            _has_odd_space(x), lambda odd: F.when((odd | suspicious(x)) & ~kept(x), run(x, odd)).otherwise(x)
        )

    return join_lines(F.transform(_lines(text), line))


#: Protected spans that are whole lines come last: from this place on.
_LINE_SPANS = next(k for k, (_, p) in enumerate(fv.PROTECTED_SPANS) if p.startswith("(?mdU)^") and p.endswith("$"))
#: The same matches with one look for the end of a tag instead of up to three; ``<.../>`` is a ``<...>``, too.
_ONE_SCAN = {r"<[^>]+>.*?</[^>]+>|<[^>]+/>|<[^>]+>": r"<[^>]++>(?:.*?</[^>]++>)?"}


def correct_spelling(text: Column, rules=fv.OCR_RULES) -> Column:
    """Apply the rules outside formulas, tags, images, headings and table rows.

    Protected spans are swapped for word-like marks, kind by kind, and put back in reverse. Headings and table rows are
    whole lines, so they are not looked for in the text, but in the lines that a rule may change.
    """
    spans_of, lines_of = fv.PROTECTED_SPANS[:_LINE_SPANS], fv.PROTECTED_SPANS[_LINE_SPANS:]
    none = F.array().cast("array<string>")

    def guard(t: Column, k: int) -> Column:
        if k == len(spans_of):
            return apply_rules(t, rules, lines_of)
        sign, pattern = spans_of[k]
        pattern = _ONE_SCAN.get(pattern, pattern)
        mark = f"_{chr(0xE000 + k)}_"
        present = F.contains(t, F.lit(sign))
        spans = F.when(present, F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none)
        hidden = F.when(present, F.regexp_replace(t, pattern, mark)).otherwise(t)

        def restore(found: Column) -> Column:
            return bind(
                bind(hidden, lambda h: guard(h, k + 1)),
                lambda inner: F.when(F.size(found) == 0, inner).otherwise(
                    interleave(F.split(inner, mark, -1), found)
                ),
            )

        return bind(spans, restore)

    return bind(text, lambda t: guard(t, 0))


# --- images -------------------------------------------------------------------------------------


def inject_image_ids(text: Column, image_ids: Column) -> Column:
    """The n-th placeholder becomes a reference to the n-th image.

    With more placeholders than images the images are used again in the same order, once per image.
    """

    def place(ids: Column) -> Column:
        gaps = F.split(text, fv.IMAGE_PLACEHOLDER, -1)
        found = F.regexp_extract_all(text, F.lit(fv.IMAGE_PLACEHOLDER), F.lit(0))
        n = F.size(ids)
        shown = F.transform(
            found,
            lambda p, i: F.when(
                i < n * n,
                bind(
                    F.get(ids, i % F.greatest(n, F.lit(1))),
                    lambda k: F.concat(F.lit("![id: "), k, F.lit("]("), k, F.lit(".png)")),
                ),
            ).otherwise(p),
        )
        return F.when(n == 0, text).otherwise(interleave(gaps, shown))

    return bind(F.coalesce(image_ids, F.array().cast("array<string>")), place)


def image_refs(text: Column) -> Column:
    """Array of (line_no, image_id, source_filename): first nested image of every line."""

    def ref(x: Column, i: Column) -> Column:
        name = strip(F.regexp_extract(x, fv.NESTED_IMAGE, 1))
        return F.when(
            x.rlike(fv.NESTED_IMAGE),
            F.struct(
                i.alias("line_no"),
                F.nullif(name, F.lit("")).alias("image_id"),
                strip(F.regexp_extract(x, fv.NESTED_IMAGE, 2)).alias("source_filename"),
            ),
        )

    return F.filter(F.transform(to_lines(text), ref), lambda r: r.isNotNull())


def image_urls(line: Column) -> Column:
    """Markdown image targets of a line, then those of its HTML tags."""
    return F.concat(
        F.regexp_extract_all(line, F.lit(fv.IMAGE_URL_MARKDOWN), F.lit(1)),
        F.regexp_extract_all(line, F.lit(fv.IMAGE_URL_HTML), F.lit(1)),
    )


# --- blocks, tables, spans ----------------------------------------------------------------------


def table_spans(lines: Column) -> Column:
    """Array of (lo, hi): runs of pipe lines, from the first one with a dashed line below it."""

    def runs(ls: Column) -> Column:
        def piped(i: Column) -> Column:
            return F.coalesce(F.startswith(strip(F.get(ls, i)), F.lit("|")), F.lit(False))

        first = where_index(ls, lambda _, i: piped(i) & ~F.coalesce((i > 0) & piped(i - 1), F.lit(False)))
        last = where_index(ls, lambda _, i: piped(i) & ~piped(i + 1))

        def opened(lo: Column, hi: Column) -> Column:
            confirmed = where_index(
                span(ls, lo + 1, hi + 2), lambda x, _: F.contains(x, F.lit("---"))
            )
            at = F.get(confirmed, 0)
            return F.when(at.isNotNull(), F.struct((lo + at).alias("lo"), (hi + 1).alias("hi")))

        return F.filter(F.zip_with(first, last, opened), lambda t: t.isNotNull())

    return bind(lines, runs)


def blocks(text: Column) -> Column:
    """Array of (line_no, line, in_table) for every line of a document."""

    def inside(ls: Column, tables: Column) -> Column:
        """For every line whether it is in a table: runs of the lines between and in the tables."""
        before = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(tables, j - 1)["hi"])
        runs = F.transform(
            tables,
            lambda t, j: F.concat(
                F.array_repeat(F.lit(False), t["lo"] - before(j)), F.array_repeat(F.lit(True), t["hi"] - t["lo"])
            ),
        )
        last = F.coalesce(F.get(tables, F.size(tables) - 1)["hi"], F.lit(0))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(False), F.size(ls) - last))

    def tag(ls: Column, flags: Column) -> Column:
        return F.transform(
            ls, lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), F.get(flags, i).alias("in_table"))
        )

    return bind(
        _lines(text),
        lambda ls: bind(table_spans(ls), lambda ts: bind(inside(ls, ts), lambda flags: tag(ls, flags))),
    )


def block_type(line: Column, in_table: Column) -> Column:
    bare = strip(line)
    image = (
        F.contains(line, F.lit("[IMAGE_PLACEHOLDER_")) & line.rlike(fv.IMAGE_PLACEHOLDER)
    ) | line.rlike(r"(?U)!\[id:\s*([^\]]+)\]\([^\)]+\)")
    hashes = F.length(F.regexp_extract(line, "^(#+)", 1))
    return (
        F.when(in_table, "table")
        .when(image, "image")
        .when(bare == "", "blank")
        .when(hashes.between(1, 6), "heading")
        .when(bare.rlike(r"^[-*+] "), "bullet")
        .when(line.rlike(r"(?U)^\s*\d+\.\s"), "numbered")
        .when(line.rlike(r"(?U)^\s*(-{3,}|\*{3,}|_{3,})\s*$"), "rule")
        .when(bare == fv.BREAK_MARK, "break")
        .when(F.startswith(bare, F.lit(">")), "quote")
        .when(line.rlike(r"<br>|<br/>|<br />"), "br_paragraph")
        .otherwise("paragraph")
    )


def block_text(line: Column, kind: Column) -> Column:
    """The content of a block without its mark."""
    bare = strip(line)
    return (
        F.when(kind == "heading", strip(F.regexp_replace(line, "^#{1,6}", "")))
        .when(kind == "bullet", F.substr(bare, F.lit(3)))
        .when(kind == "numbered", F.regexp_replace(line, r"(?U)^\s*\d+\.\s", ""))
        .when(kind == "quote", strip(F.substr(bare, F.lit(2))))
        .when(kind == "br_paragraph", F.regexp_replace(line, r"<br>|<br/>|<br />", "\n"))
        .otherwise(line)
    )


def table_cells(text: Column) -> Column:
    """Array of (table_no, row_no, col_no, cell). Separators are skipped, extra cells are dropped."""

    def cells(ls: Column, tables: Column) -> Column:
        def one(t: Column, n: Column) -> Column:
            body = F.filter(
                span(ls, t["lo"], t["hi"]), lambda x, i: (i == 0) | ~F.contains(x, F.lit("---"))
            )
            rows = F.transform(body, lambda x: F.transform(F.split(F.btrim(x, F.lit("|")), "[|]", -1), strip))

            def kept(rs: Column) -> Column:
                width = F.size(F.get(rs, 0))
                return F.flatten(
                    F.transform(
                        rs,
                        lambda r, i: F.transform(
                            F.slice(r, F.lit(1), width),
                            lambda c, j: F.struct(
                                n.alias("table_no"), i.alias("row_no"), j.alias("col_no"), c.alias("cell")
                            ),
                        ),
                    )
                )

            return bind(rows, kept)

        return F.flatten(F.transform(tables, one))

    return bind(_lines(text), lambda ls: bind(table_spans(ls), lambda ts: cells(ls, ts)))


def inline_spans(text: Column) -> Column:
    """Array of raw pieces of a line: formatted spans and the plain text around them."""
    gaps = F.split(text, fv.INLINE_SPAN, -1)
    spans = F.regexp_extract_all(text, F.lit(fv.INLINE_SPAN), F.lit(0))
    pairs = F.zip_with(gaps, spans, lambda g, s: F.array(g, s))
    return F.filter(F.flatten(pairs), lambda p: p.isNotNull() & (p != ""))


def _wrapped(piece: Column, left: str, right: str, min_chars: int) -> Column:
    return F.startswith(piece, F.lit(left)) & F.endswith(piece, F.lit(right)) & (F.length(piece) > min_chars)


def span_type(piece: Column) -> Column:
    return (
        F.when(_wrapped(piece, "$", "$", 2), "math")
        .when(_wrapped(piece, "<sub>", "</sub>", 0), "sub")
        .when(_wrapped(piece, "<sup>", "</sup>", 0), "sup")
        .when(_wrapped(piece, "***", "***", 6), "bold_italic")
        .when(_wrapped(piece, "**", "**", 4) | _wrapped(piece, "__", "__", 4), "bold")
        .when(_wrapped(piece, "*", "*", 2) & ~F.startswith(piece, F.lit("**")), "italic")
        .when(_wrapped(piece, "_", "_", 2) & ~F.startswith(piece, F.lit("__")), "italic")
        .when(_wrapped(piece, "`", "`", 2), "code")
        .when(piece.rlike(r"^\[.*?\]\(.*?\)"), "link")
        .otherwise("text")
    )


def span_text(piece: Column, kind: Column) -> Column:
    def inner(cut: int, end: int | None = None) -> Column:
        end = cut if end is None else end
        return F.substr(piece, F.lit(cut + 1), F.length(piece) - (cut + end))

    return (
        F.when(kind == "math", inner(1))
        .when(kind.isin("sub", "sup"), inner(5, 6))
        .when(kind == "bold_italic", inner(3))
        .when(kind == "bold", inner(2))
        .when(kind.isin("italic", "code"), inner(1))
        .when(kind == "link", F.regexp_extract(piece, r"^\[(.*?)\]\(.*?\)", 1))
        .otherwise(piece)
    )
