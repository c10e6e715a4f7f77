"""Sequential chunkers, as folds inside the document row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.core import bind, scan, span, strip, where_index


def _last_at(backwards: Column, size: int, mark: str) -> Column:
    """0-based position of the last ``mark`` in a window given in reverse, or NULL."""
    found = F.instr(backwards, mark[::-1])
    return F.when(found > 0, F.lit(size + 1 - len(mark)) - found)


def overlapping(
    text: Column,
    size: int = fv.CHUNK_SIZE,
    overlap: int = fv.CHUNK_OVERLAP,
    min_chars: int = fv.CHUNK_MIN,
) -> Column:
    """Array of (text, position): windows of ``size`` ending at a sentence where one is near.

    The next window begins ``overlap`` before the end of the last, so the windows are a fold over
    their starts. Each step moves on by more than ``min_chars - overlap``.
    """
    if overlap >= min_chars:
        raise ValueError("overlap must be smaller than min_chars")

    def piece(slices: Column, start: Column, chars: Column) -> Column:
        """Characters of the text, from the two slices that hold them."""
        k = F.floor(start / size).cast("int")
        two = F.concat(F.get(slices, k), F.coalesce(F.get(slices, k + 1), F.lit("")))
        return F.substr(two, start - k * size + 1, chars)

    def window_end(slices: Column, start: Column, n: Column) -> Column:
        full = F.least(start + size, n)

        def cut(w: Column) -> Column:
            ends = [
                bind(_last_at(w, size, stop), lambda at: F.when(at > min_chars, start + at + 1))
                for stop in fv.CHUNK_STOPS
            ]
            return F.coalesce(*ends, full)

        # Only inner windows look for a stop, and those are exactly ``size`` long.
        return F.when(full < n, bind(F.reverse(piece(slices, start, F.lit(size))), cut)).otherwise(full)

    def spans(slices: Column, n: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(n / (min_chars - overlap)).cast("int"))
        end_of = F.struct(F.lit(0).alias("start"), F.lit(False).alias("done"))

        def advance(state: Column, _: Column) -> tuple[Column, Column]:
            end = window_end(slices, state["start"], n)
            nxt = F.struct((end - overlap).alias("start"), (end - overlap >= n - min_chars).alias("done"))
            return F.when(state["done"], state).otherwise(nxt), F.when(
                ~state["done"], F.struct(state["start"].alias("lo"), end.alias("hi"))
            )

        return F.filter(scan(steps, end_of, advance, "struct<lo:int,hi:int>"), lambda s: s.isNotNull())

    def cut_all(n: Column, slices: Column) -> Column:
        pieces = F.transform(
            spans(slices, n),
            lambda s: F.struct(
                strip(piece(slices, s["lo"], s["hi"] - s["lo"])).alias("text"), s["lo"].alias("position")
            ),
        )
        one = F.array(F.struct(text.alias("text"), F.lit(0).alias("position")))
        return F.when(n <= size, one).otherwise(F.filter(pieces, lambda p: F.length(p["text"]) >= min_chars))

    # Cutting the text at fixed places once keeps every window's cost the same: ``substr`` counts from the start.
    slices = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return bind(F.length(text), lambda n: bind(slices, lambda sl: cut_all(n, sl)))


def packed_paragraphs(text: Column, max_chars: int) -> Column:
    """Fill chunks with whole paragraphs; each paragraph counts two characters extra."""

    def opens(used: Column, para: Column) -> tuple[Column, Column]:
        size = F.length(para) + 2
        new = used + size > max_chars
        return F.when(new, size).otherwise(used + size), new

    def pack(paras: Column) -> Column:
        flags = scan(paras, F.lit(0), opens, "boolean")
        starts = where_index(flags, lambda new, i: new | (i == 0))

        def joined(st: Column) -> Column:
            return F.transform(
                st, lambda s, j: F.array_join(span(paras, s, F.coalesce(F.get(st, j + 1), F.size(paras))), "\n\n")
            )

        return bind(starts, joined)

    return F.when(F.length(text) <= max_chars, F.array(text)).otherwise(bind(F.split(text, "\n\n", -1), pack))
