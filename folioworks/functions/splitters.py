"""Book splitters: one text in, an array of chunk texts out.

All share the piece primitive of ``core``: a rule marks start lines, each piece runs to the next
start. The whole split is an expression over the document row, so it needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.core import (
    at_least,
    bind,
    bind_all,
    first_index,
    head,
    is_blank,
    join_lines,
    lstrip,
    pieces_at,
    pieces_where,
    rstrip,
    span,
    strip,
    to_lines,
    unify_newlines,
    where_index,
)
from folioworks.functions.text import collapse, heading_text



def _no_texts() -> Column:
    return F.array().cast("array<string>")


# --- title predicates ---------------------------------------------------------------------------


def mostly_upper(title: Column, threshold: float = 0.75) -> Column:
    """At least three cased letters, and enough of them upper-case."""

    def share(t: Column) -> Column:
        upper = F.length(F.regexp_replace(t, r"\P{Lu}+", ""))
        cased = upper + F.length(F.regexp_replace(t, r"\P{Ll}+", ""))
        return (cased >= 3) & (upper / F.greatest(cased, F.lit(1)) >= threshold)

    return bind(heading_text(title), share)


def caps_title(line: Column) -> Column:
    """Title-like line: three capital letters or more, and mostly capitals."""
    letters = collapse(F.regexp_replace(line, fv.NOT_CAPS_LETTER_OR_SPACE, ""))
    compact = F.regexp_replace(line, r"(?U)\s+", "")
    capitals = F.length(F.regexp_replace(compact, fv.NOT_CAPS_LETTER, ""))
    return (F.length(letters) >= 3) & (capitals / F.greatest(F.length(compact), F.lit(1)) >= 0.65)


def _any_blank_free(lines: Column) -> Column:
    return F.exists(lines, lambda x: ~is_blank(x))


# --- generic ------------------------------------------------------------------------------------


def by_heading(text: Column) -> Column:
    return pieces_where(to_lines(text), lambda x: x.rlike(fv.HEADING_HASHES))


def by_section(text: Column) -> Column:
    """Cut at line breaks followed by a hash; later chunks lose that hash."""
    return F.filter(F.transform(F.split(unify_newlines(text), "\n#", -1), strip), lambda c: c != "")


def by_paragraph(text: Column) -> Column:
    return F.filter(F.transform(F.split(unify_newlines(text), "\n\n", -1), strip), lambda c: c != "")


def whole(text: Column) -> Column:
    return F.filter(F.array(strip(unify_newlines(text))), lambda c: c != "")


# --- two-part book: plants, then drinks ---------------------------------------------------------


def plants(text: Column) -> Column:
    def starts(ls: Column, part2: Column) -> Column:
        def test(x: Column, i: Column) -> Column:
            return F.when(part2.isNull() | (i < part2), x.rlike(fv.PLANT_H2)).otherwise(
                x.rlike(fv.PLANT_H2_TO_H4)
            )

        return bind(
            where_index(ls, test),
            lambda st: F.when(F.size(st) > 0, st).otherwise(
                where_index(ls, lambda x, _: x.rlike(fv.PLANT_BARE))
            ),
        )

    def split(ls: Column) -> Column:
        return bind(first_index(ls, fv.PART_TWO), lambda part2: pieces_at(ls, starts(ls, part2)))

    def before_drinks(ls: Column) -> Column:
        return bind(first_index(ls, fv.SECTION_TWO), lambda at: F.when(at.isNull(), ls).otherwise(head(ls, at)))

    return at_least(bind(bind(to_lines(text), before_drinks), split), fv.MIN_CHARS["plants"])


def recipes(text: Column) -> Column:
    def from_drinks(ls: Column) -> Column:
        at = F.coalesce(first_index(ls, fv.SECTION_TWO_DRINKS), first_index(ls, fv.SECTION_TWO))
        return bind(at, lambda a: F.when(a.isNull(), _no_texts()).otherwise(span(ls, a, F.size(ls))))

    entries = pieces_where(bind(to_lines(text), from_drinks), lambda x: x.rlike(fv.DRINK_HEADING))
    return at_least(F.flatten(F.transform(entries, recipe_options)), fv.MIN_CHARS["recipes"])


def recipe_options(entry: Column) -> Column:
    """One chunk per option when an entry has two or more, each with the shared introduction."""

    def expand(ls: Column, opts: Column, at: Column) -> Column:
        heading = rstrip(F.get(ls, at))
        intro = span(ls, at + 1, F.get(opts, 0))

        def one(start: Column, j: Column) -> Column:
            line = F.get(ls, start)
            title = F.rtrim(strip(F.regexp_extract(line, fv.OPTION_HEADING, 2)), F.lit(":"))
            label = F.concat(F.lower(F.regexp_extract(line, fv.OPTION_HEADING, 1)), F.lit(")"))
            named = strip(F.concat(heading, F.lit(" - "), F.when(title != "", title).otherwise(label)))
            body = span(ls, start, F.coalesce(F.get(opts, j + 1), F.size(ls)))
            shared = F.when(_any_blank_free(intro), intro).otherwise(_no_texts())
            return strip(join_lines(F.concat(F.array(named), shared, body)))

        return F.transform(opts, one)

    def split(ls: Column) -> Column:
        opts = where_index(ls, lambda x, _: x.rlike(fv.OPTION_HEADING))
        at = F.coalesce(first_index(head(ls, 10), fv.DRINK_HEADING), F.lit(0))
        return bind_all(
            [opts, at],
            lambda o, a: F.when(F.size(o) < 2, F.array(entry)).otherwise(expand(ls, o, a)),
        )

    return bind(to_lines(entry), split)


# --- vegetables ---------------------------------------------------------------------------------


def _vegetable_start(line: Column) -> Column:
    bare = strip(line)
    upper = F.upper(bare)
    caps = bare.rlike(fv.ENTRY_CAPS) & (F.length(bare) <= fv.ENTRY_CAPS_MAX_CHARS)
    for phrase in fv.ENTRY_CAPS_BLOCKED:
        caps = caps & ~F.contains(upper, F.lit(phrase))
    return line.rlike(fv.ENTRY_NUMBERED) | caps


def vegetables(text: Column) -> Column:
    entries = pieces_where(to_lines(text), _vegetable_start)
    return at_least(F.flatten(F.transform(entries, variants)), fv.MIN_CHARS["vegetables"])


def variants(entry: Column) -> Column:
    """One chunk per named variant when an entry describes two or more of them.

    Every line of the entry plays one part: heading, shared opening, a variant's own block, what
    lies between the last block and section 2, and section 2 onward. A variant's chunk is its
    heading plus the shared parts around its block.
    """
    same = F.array(entry)

    def titles(ls: Column, base: Column, from_line: Column) -> Column:
        def title(x: Column, i: Column) -> Column:
            bare = strip(x)
            fits = (
                (i >= from_line)
                & ~F.startswith(lstrip(x), F.lit("#"))
                & F.length(bare).between(4, 40)
                & caps_title(bare)
                & F.array_contains(F.split(collapse(F.upper(bare)), " "), base)
            )
            return F.when(fits, F.struct(bare.alias("title"), i.alias("at")))

        found = F.filter(F.transform(ls, title), lambda t: t.isNotNull())
        return bind(
            found,
            lambda fs: bind(
                F.transform(fs, lambda t: t["title"]),
                lambda names: F.filter(fs, lambda t, j: F.array_position(names, t["title"]) == j + 1),
            ),
        )

    def block_start(ls: Column, at: Column) -> Column:
        above = where_index(span(ls, 0, at), lambda x, _: ~is_blank(x))
        return bind(
            above,
            lambda a: bind(
                F.get(a, F.size(a) - 1),
                lambda k: F.when(k.isNotNull() & F.get(ls, k).rlike(fv.IMAGE_LINE), k).otherwise(at),
            ),
        )

    def blocks(ls: Column, names: Column, section2: Column) -> Column:
        last = F.coalesce(section2, F.size(ls))

        def block(t: Column, j: Column) -> Column:
            end = F.coalesce(F.get(names, j + 1)["at"], F.size(ls))
            return F.struct(
                t["title"].alias("title"),
                block_start(ls, t["at"]).alias("lo"),
                F.least(end, last).alias("hi"),
            )

        return F.filter(F.transform(names, block), lambda b: section2.isNull() | (b["lo"] < section2))

    def assemble(ls: Column, at: Column, bs: Column, section2: Column) -> Column:
        lo = F.get(bs, 0)["lo"]
        opening = F.when(at < lo, F.concat(span(ls, 0, at), span(ls, at + 1, lo))).otherwise(span(ls, 0, lo))
        last = F.array_max(F.transform(bs, lambda b: b["hi"]))
        between = span(ls, last, F.coalesce(section2, last))
        rest = F.when(section2.isNull(), _no_texts()).otherwise(span(ls, section2, F.size(ls)))

        def filled(part: Column) -> Column:
            return F.when(_any_blank_free(part), part).otherwise(_no_texts())

        return bind_all(
            [filled(opening), F.concat(filled(between), filled(rest))],
            lambda before, after: F.transform(
                bs,
                lambda b: strip(
                    join_lines(
                        F.concat(
                            F.array(strip(F.concat(rstrip(F.get(ls, at)), F.lit(" - "), b["title"]))),
                            before,
                            span(ls, b["lo"], b["hi"]),
                            after,
                        )
                    )
                ),
            ),
        )

    def expand(ls: Column, at: Column, base: Column, numbered: Column) -> Column:
        two = F.get(F.filter(numbered, lambda n: n["n"] == 2), 0)["at"]

        def with_names(section2: Column, names: Column) -> Column:
            return F.when(F.size(names) < 2, same).otherwise(
                bind(
                    blocks(ls, names, section2),
                    lambda bs: F.when(F.size(bs) < 2, same).otherwise(assemble(ls, at, bs, section2)),
                )
            )

        usable = (base != "") & (F.size(numbered) > 0)
        return F.when(
            usable, bind_all([two, titles(ls, base, F.get(numbered, 0)["at"])], with_names)
        ).otherwise(same)

    def split(ls: Column) -> Column:
        at = F.coalesce(first_index(head(ls, 10), fv.ENTRY_ANY_HEADING), F.lit(0))
        numbered = F.filter(
            F.transform(
                ls,
                lambda x, i: F.when(
                    x.rlike(fv.NUMBERED_SECTION),
                    F.struct(
                        F.regexp_extract(x, fv.NUMBERED_SECTION, 1).cast("int").alias("n"), i.alias("at")
                    ),
                ),
            ),
            lambda n: n.isNotNull(),
        )

        def named(a: Column, nums: Column) -> Column:
            title = strip(F.regexp_replace(heading_text(F.get(ls, a)), fv.ENTRY_TITLE_NUMBER, ""))
            base = F.upper(F.split_part(collapse(title), F.lit(" "), F.lit(1)))
            return bind(base, lambda b: expand(ls, a, b, nums))

        return F.when(F.size(ls) < 10, same).otherwise(bind_all([at, numbered], named))

    return bind(to_lines(entry), split)


# --- endocrine book: disease chapters, patterns, monographs -------------------------------------


def _chapter_start(line: Column) -> Column:
    title = heading_text(F.regexp_extract(line, fv.CHAPTER_HEADING, 2))
    short_label = F.endswith(title, F.lit(":")) & (F.length(title) < 35)
    return line.rlike(fv.CHAPTER_HEADING) & bind(
        title, lambda t: (F.length(t) <= 110) & mostly_upper(t, 0.80) & ~short_label
    )


def chapters(text: Column) -> Column:
    def body(ls: Column) -> Column:
        return bind_all(
            [first_index(ls, fv.PART_SECOND), first_index(ls, fv.PART_THIRD)],
            lambda lo, hi: F.when(lo.isNull(), _no_texts()).otherwise(
                span(ls, lo, F.coalesce(hi, F.size(ls)))
            ),
        )

    return at_least(pieces_where(bind(to_lines(text), body), _chapter_start), fv.MIN_CHARS["chapters"])


def patterns(text: Column) -> Column:
    def inner(chapter: Column) -> Column:
        def split(ls: Column) -> Column:
            starts = where_index(
                ls, lambda x, _: x.rlike(fv.PATTERN_HEADING) | x.rlike(fv.EXPERIENCE_HEADING)
            )
            titled = F.get(F.filter(head(ls, 60), lambda x: x.rlike(fv.CHAPTER_HEADING)), 0)
            title = strip(F.coalesce(titled, F.get(F.filter(ls, lambda x: ~is_blank(x)), 0), F.lit("")))
            return bind_all(
                [starts, title],
                lambda st, t: F.when(F.size(st) == 0, F.array(chapter)).otherwise(
                    F.transform(
                        pieces_at(ls, st),
                        lambda p: F.when(t != "", F.concat(t, F.lit("\n\n"), p)).otherwise(p),
                    )
                ),
            )

        return bind(to_lines(chapter), split)

    return at_least(F.flatten(F.transform(chapters(text), inner)), fv.MIN_CHARS["patterns"])


def _monograph_start(line: Column) -> Column:
    def named(title: Column) -> Column:
        ok = (F.length(title) <= 60) & mostly_upper(title, 0.85)
        for phrase in fv.MONOGRAPH_REJECTED:
            ok = ok & ~F.startswith(F.upper(title), F.lit(phrase))
        return ok

    return line.rlike(fv.MONOGRAPH_HEADING) & bind(
        heading_text(F.regexp_extract(line, fv.MONOGRAPH_HEADING, 2)), named
    )


def monographs(text: Column) -> Column:
    def body(ls: Column) -> Column:
        return bind(
            first_index(ls, fv.PART_THIRD),
            lambda lo: F.when(lo.isNull(), _no_texts()).otherwise(span(ls, lo, F.size(ls))),
        )

    return at_least(pieces_where(bind(to_lines(text), body), _monograph_start), fv.MIN_CHARS["monographs"])


def endocrine(text: Column) -> Column:
    return F.concat(chapters(text), monographs(text))


# --- emergency protocols ------------------------------------------------------------------------


def protocols(text: Column) -> Column:
    """Start at ``N. TITLE``, or at a number line followed by a title line, where a body follows.

    Only filled lines can decide a start, so the rules look at neighbours in the list of filled
    lines, and at windows of the full list for the contents-page guards.
    """

    def is_body(x: Column) -> Column:
        bare = strip(x)
        return (
            (bare != "")
            & ~bare.rlike(fv.NUMBER_ONLY)
            & ~caps_title(bare)
            & ~F.contains(F.lower(bare), F.lit(fv.BREAK_MARK))
            & bare.rlike(fv.LOWER_LETTER)
        )

    def body_follows(ls: Column, at: Column, window: int) -> Column:
        return F.size(F.filter(span(ls, at + 1, F.least(at + window, F.size(ls))), is_body)) >= 2

    def crowded(ls: Column, at: Column) -> Column:
        before = span(ls, F.greatest(at - 20, F.lit(0)), at)
        return F.size(F.filter(before, lambda x: x.rlike(fv.NUMBER_ONLY))) >= 3

    def starts(ls: Column, filled: Column) -> Column:
        def lone_number(f: Column) -> Column:
            return f["x"].rlike(fv.NUMBER_ONLY) & ~crowded(ls, f["at"])

        def start(f: Column, j: Column) -> Column:
            after, before = F.get(filled, j + 1), F.get(filled, j - 1)
            title = strip(F.regexp_extract(f["x"], fv.NUMBER_AND_TITLE, 2))
            same_line = (
                f["x"].rlike(fv.NUMBER_AND_TITLE) & caps_title(title) & body_follows(ls, f["at"], 60)
            )
            used_as_title = F.coalesce((j > 0) & caps_title(strip(f["x"])) & lone_number(before), F.lit(False))
            two_lines = F.coalesce(
                lone_number(f) & caps_title(strip(after["x"])) & body_follows(ls, after["at"], 30), F.lit(False)
            )
            return F.when((same_line & ~used_as_title) | two_lines, f["at"])

        return F.filter(F.transform(filled, start), lambda i: i.isNotNull())

    def split(ls: Column) -> Column:
        filled = F.filter(
            F.transform(ls, lambda x, i: F.struct(x.alias("x"), i.alias("at"))), lambda f: ~is_blank(f["x"])
        )
        return pieces_at(ls, bind(filled, lambda fl: starts(ls, fl)))

    return at_least(bind(to_lines(text), split), fv.MIN_CHARS["protocols"])


# --- dispatch -----------------------------------------------------------------------------------

SPLITTERS = {
    "plants": plants,
    "recipes": recipes,
    "vegetables": vegetables,
    "chapters": chapters,
    "patterns": patterns,
    "monographs": monographs,
    "endocrine": endocrine,
    "protocols": protocols,
    "whole": whole,
}


def register_splitter(name: str, splitter, path_fragment: str | None = None) -> None:
    """Add a splitter under ``name``; with a fragment it also serves the paths containing it."""
    SPLITTERS[name] = splitter
    if path_fragment is not None:
        EXTRA_PATHS.append((path_fragment.lower(), {"default": name}))


EXTRA_PATHS: list[tuple[str, dict[str, str]]] = []


def by_book(path: Column, text: Column, kind: str | None = None) -> Column:
    """The splitter of the first path fragment that matches; otherwise the text is one chunk."""
    norm = F.lower(F.translate(path, "\\", "/"))
    out = whole(text)
    for fragment, kinds in reversed((*fv.BOOK_PATHS, *EXTRA_PATHS)):
        chosen = kinds.get((kind or "default").lower(), kinds["default"])
        out = F.when(F.contains(norm, F.lit(fragment)), SPLITTERS[chosen](text)).otherwise(out)
    return out
