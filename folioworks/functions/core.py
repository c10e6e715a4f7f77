"""Building blocks: binding, stripping, and arrays of lines.

A document is one row, so every per-document rule is written as an expression over that row's
text or its array of lines. No rule needs a shuffle, and no document shares a task-wide group
with another one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters removed by a Unicode strip.
WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
) + "\u2028\u2029\u202f\u205f\u3000"


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (expressions have no local variables)."""
    return F.transform(F.array(value), body).getItem(0)


def bind_large(value: Column, body: Callable[[Column], Column]) -> Column:
    """``bind`` without the copy that an array's element is made with: the end of a fold over nothing."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def bind_all(values: list[Column], body: Callable[..., Column]) -> Column:
    """``bind`` for several independent values."""

    def step(rest: list[Column], bound: tuple[Column, ...]) -> Column:
        if not rest:
            return body(*bound)
        return bind(rest[0], lambda v: step(rest[1:], (*bound, v)))

    return step(values, ())


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def rstrip(c: Column) -> Column:
    return F.rtrim(c, F.lit(WHITESPACE))


def lstrip(c: Column) -> Column:
    return F.ltrim(c, F.lit(WHITESPACE))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def unify_newlines(text: Column) -> Column:
    return F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)


def to_lines(text: Column) -> Column:
    return F.split(unify_newlines(text), "\n", -1)


def join_lines(lines: Column) -> Column:
    return F.array_join(lines, "\n")


def head(lines: Column, n: Column | int) -> Column:
    """First ``n`` elements; nothing when ``n`` is not positive."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.slice(lines, F.lit(1), F.greatest(n, F.lit(0)))


def span(lines: Column, start: Column | int, end: Column | int) -> Column:
    """Elements at 0-based positions ``start <= i < end``."""
    start = F.lit(start) if isinstance(start, int) else start
    end = F.lit(end) if isinstance(end, int) else end
    return F.slice(lines, start + 1, F.greatest(end - start, F.lit(0)))


def where_index(items: Column, test: Callable[[Column, Column], Column]) -> Column:
    """0-based positions whose item passes ``test(item, position)``."""
    marked = F.transform(items, lambda x, i: F.when(test(x, i), i))
    return F.filter(marked, lambda i: i.isNotNull())


def first_index(items: Column, pattern: str) -> Column:
    """0-based position of the first item matching ``pattern``, or NULL."""
    pos = F.array_position(F.transform(items, lambda x: x.rlike(pattern)), True)
    return F.when(pos > 0, pos.cast("int") - 1)


def pieces_at(lines: Column, starts: Column) -> Column:
    """Text of every piece running from one start to the next; blank pieces are dropped.

    Lines before the first start are not part of any piece.
    """

    def cut(ls: Column, st: Column) -> Column:
        texts = F.transform(
            st, lambda s, j: strip(join_lines(span(ls, s, F.coalesce(F.get(st, j + 1), F.size(ls)))))
        )
        return F.filter(texts, lambda t: t != "")

    return bind_all([lines, starts], cut)


def pieces_where(lines: Column, test: Callable[[Column], Column]) -> Column:
    return bind(lines, lambda ls: pieces_at(ls, where_index(ls, lambda x, _: test(x))))


def at_least(texts: Column, min_chars: int) -> Column:
    """Drop short texts; a limit of zero or less keeps all."""
    return texts if min_chars <= 0 else F.filter(texts, lambda t: F.length(t) >= min_chars)


def interleave(gaps: Column, spans: Column) -> Column:
    """Concatenate gap 0, span 0, gap 1, span 1, ... back into one string."""
    return F.array_join(
        F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(spans, i), F.lit("")))), ""
    )


# Outputs are gathered in blocks of this many, so that a long scan doesn't copy all of them at each step.
SCAN_BLOCK = 128


def scan(
    items: Column, begin: Column, step: Callable[[Column, Column], tuple[Column, Column]], out_type: str
) -> Column:
    """One output for each item of a left fold: ``step(state, item)`` gives the next state and the output."""
    none = F.array().cast(f"array<{out_type}>")

    def add(s: Column, x: Column) -> Column:
        state, out = step(s["state"], x)
        return bind_large(
            F.struct(state.alias("state"), out.alias("out")),
            lambda r: F.struct(r["state"].alias("state"), F.concat(s["outs"], F.array(r["out"])).alias("outs")),
        )

    def run(s: Column, part: Column) -> Column:
        return F.aggregate(
            part,
            F.struct(s["state"].alias("state"), none.alias("outs")),
            add,
            lambda r: F.struct(r["state"].alias("state"), F.concat(s["blocks"], F.array(r["outs"])).alias("blocks")),
        )

    def blocks(xs: Column) -> Column:
        last = F.greatest(F.floor((F.size(xs) - 1) / SCAN_BLOCK).cast("int"), F.lit(0))
        start = F.struct(begin.alias("state"), F.array().cast(f"array<array<{out_type}>>").alias("blocks"))
        whole = F.aggregate(
            F.sequence(F.lit(0), last),
            start,
            lambda s, k: run(s, F.slice(xs, k * SCAN_BLOCK + 1, F.lit(SCAN_BLOCK))),
            lambda s: s["blocks"],
        )
        return F.flatten(whole)

    return bind(items, blocks)
