"""Sections, passages and reading order of OCR items.

An item row has: doc, page_num, item_no, element_type, text, skip, image_id, file_path and, for the
reading order, the box (x, y, height).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.chunks import overlapping
from folioworks.functions.core import strip
from folioworks.functions.markdown import inline_break
from folioworks.operators.scan import ROWS_PER_BLOCK, group_sizes, ordered_scan


def items_of_results(df: DataFrame) -> DataFrame:
    """Explode nested OCR results (doc, pages) into item rows."""
    pages = df.select("doc", F.posexplode("pages").alias("page_no", "page"))
    items = pages.select(
        "doc",
        F.coalesce("page.page_num", F.lit(1)).alias("page_num"),
        "page_no",
        F.posexplode("page.results").alias("item_no", "item"),
    )
    return items.select("doc", "page_num", "page_no", "item_no", "item.*")


def usable_items(items: DataFrame) -> DataFrame:
    """Without headers, footers and items without text."""
    text = strip(F.coalesce(F.col("text"), F.lit("")))
    return items.where(~F.coalesce(F.col("skip"), F.lit(False))).withColumn("text", text).where(text != "")


def text_items(items: DataFrame) -> DataFrame:
    """The items a page's reading order is made of: neither images nor tables, headers or footers."""
    kind = F.coalesce(F.col("element_type"), F.lit("paragraph"))
    return items.where(~kind.isin("image", "table") & ~F.coalesce(F.col("skip"), F.lit(False)))


def sections(items: DataFrame, order: list[str], rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """(doc, section_id, heading, full_text, images, page_range).

    ``order`` begins with the column that orders the pages of a document.

    An item holding the break mark closes its section. Sections are numbered by an ordered scan, so a
    document of any length is spread over tasks. A section with neither heading nor content is
    dropped together with its images, and the rest are numbered without gaps.
    """
    kind = F.coalesce(F.col("element_type"), F.lit("paragraph"))
    usable = usable_items(items).withColumn("_kind", kind)
    closes = (F.col("_kind") != "image") & F.contains(F.col("text"), F.lit(fv.BREAK_MARK))
    if group_sizes(items, ["doc"])[0] <= rows_per_block:
        rows_per_block = None
    marked = usable.withColumn("_close", closes.cast("bigint"))
    numbered = ordered_scan(
        marked,
        ["doc"],
        order,
        sums={"_closed": F.col("_close"), "_pos": F.lit(1).cast("bigint")},
        rows_per_block=rows_per_block,
    )
    # The closing item belongs to the section it closes.
    parts = numbered.withColumn("_seg", F.col("_closed") - F.col("_close"))
    parts = parts.withColumn(
        "text",
        F.when(F.col("_close") == 1, strip(F.replace("text", F.lit(fv.BREAK_MARK), F.lit("")))).otherwise(F.col("text")),
    )
    row = F.struct(
        "_pos",
        F.col("_kind").alias("kind"),
        F.col("text").alias("text"),
        F.col("page_num").alias("page"),
        F.coalesce("image_id", F.lit("")).alias("image_id"),
        F.coalesce("file_path", F.lit("")).alias("file_path"),
    )
    # One list per section; heading, content, images and pages are read off it. In long documents a
    # section is put together from parts of bounded length.
    part = F.lit(0) if rows_per_block is None else F.floor(F.col("_pos") / rows_per_block)
    keys = ["doc", "_seg"] if rows_per_block is None else ["doc", "_seg", "_part"]
    grouped = parts.withColumn("_part", part).groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("_items"))
    built = grouped.select(*keys, *_section_parts())
    if rows_per_block is not None:
        built = _merged(built)
    built = built.withColumn("heading", F.coalesce("heading", F.lit("")))
    kept = built.where((F.col("heading") != "") | (F.col("_filled") > 0)).drop("_filled")
    renumbered = ordered_scan(
        kept, ["doc"], ["_seg"], sums={"section_id": F.lit(1).cast("bigint")}, rows_per_block=rows_per_block
    )
    return renumbered.drop("_seg")


def _section_parts() -> list[Column]:
    """What a section's sorted items say: last heading, joined content, images, pages, content count."""
    items = F.col("_items")
    headings = F.filter(items, lambda i: i["kind"] == "heading")
    content = F.filter(items, lambda i: ~i["kind"].isin("image", "heading"))
    images = F.filter(items, lambda i: i["kind"] == "image")
    image = F.transform(images, lambda i: F.struct(i["image_id"].alias("image_id"), i["file_path"].alias("file_path")))
    on_page = F.filter(items, lambda i: i["kind"] != "image")
    return [
        F.get(headings, F.size(headings) - 1)["text"].alias("heading"),
        F.array_join(F.transform(content, lambda i: i["text"]), " ").alias("full_text"),
        image.alias("images"),
        F.array_distinct(F.transform(on_page, lambda i: i["page"])).alias("page_range"),
        F.size(content).alias("_filled"),
    ]


def _merged(built: DataFrame) -> DataFrame:
    """Sections from their parts, in order."""
    row = F.struct("_part", "heading", "full_text", "images", "page_range", "_filled")
    ordered = built.groupBy("doc", "_seg").agg(F.sort_array(F.collect_list(row)).alias("_p"))
    headed = F.filter("_p", lambda p: p["heading"].isNotNull())
    filled = F.filter("_p", lambda p: p["_filled"] > 0)
    return ordered.select(
        "doc",
        "_seg",
        F.get(headed, F.size(headed) - 1)["heading"].alias("heading"),
        F.array_join(F.transform(filled, lambda p: p["full_text"]), " ").alias("full_text"),
        F.flatten(F.transform("_p", lambda p: p["images"])).alias("images"),
        F.array_distinct(F.flatten(F.transform("_p", lambda p: p["page_range"]))).alias("page_range"),
        F.aggregate("_p", F.lit(0), lambda n, p: n + p["_filled"]).alias("_filled"),
    )


def section_name(section_id: Column) -> Column:
    """``section_007``; longer numbers are not cut."""
    digits = section_id.cast("string")
    return F.concat(F.lit("section_"), F.lpad(digits, F.greatest(F.lit(3), F.length(digits)), F.lit("0")))


def section_entries(secs: DataFrame) -> DataFrame:
    """Sections with chunks and counts."""
    out = secs.withColumn("chunks", overlapping(F.col("full_text")))
    return out.select(
        "doc",
        "section_id",
        section_name(F.col("section_id")).alias("id"),
        "heading",
        "full_text",
        "chunks",
        "images",
        "page_range",
        (F.size("images") > 0).alias("has_images"),
        F.size("images").alias("image_count"),
        F.transform("images", lambda i: i["image_id"]).alias("image_ids"),
        F.length("full_text").alias("character_count"),
        F.size("chunks").alias("chunk_count"),
    )


def qa_passages(entries: DataFrame) -> DataFrame:
    """One row per chunk."""
    rows = entries.select("doc", "id", "heading", "has_images", "page_range", F.posexplode("chunks").alias("_i", "_c"))
    return rows.select(
        "doc",
        F.concat("id", F.lit("_chunk_"), F.col("_i").cast("string")).alias("passage_id"),
        F.col("heading").alias("section_heading"),
        F.col("_c.text").alias("text"),
        F.struct(F.col("id").alias("section_id"), "has_images", "page_range").alias("context"),
    )


def retrieval_docs(entries: DataFrame, default_title: str = "Untitled Section") -> DataFrame:
    """One row per section; the title falls back only when the section has no heading at all (NULL)."""
    return entries.select(
        "doc",
        "id",
        F.coalesce("heading", F.lit(default_title)).alias("title"),
        F.col("full_text").alias("content"),
        F.transform("chunks", lambda c: c["text"]).alias("chunks"),
        F.struct("page_range", "has_images", "image_ids").alias("metadata"),
    )


def dataset_totals(entries: DataFrame, chunk_size: int = fv.CHUNK_SIZE, overlap: int = fv.CHUNK_OVERLAP) -> DataFrame:
    return entries.groupBy(F.col("doc").alias("source_file")).agg(
        F.count(F.lit(1)).alias("total_sections"),
        F.count(F.lit(1)).alias("total_entries"),
        F.lit(chunk_size).alias("chunk_size"),
        F.lit(overlap).alias("overlap"),
    )


def reading_order(
    items: DataFrame,
    page: list[str],
    x: str,
    y: str,
    height: str,
    tie: list[str],
    base: float = 1.0,
    floor: float = fv.FIRST_LINE_HEIGHT_FLOOR,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Number the text items of a page top to bottom and give each its line spacing.

    Spacing is the gap to the item above over that item's height, at least ``base``; the first item
    has ``base``. A crowded page is scanned in bands.
    """
    ordered = ordered_scan(
        items.withColumn("_h", F.greatest(F.abs(F.col(height)), F.lit(floor))),
        page,
        [y, x, *tie],
        sums={"reading_no": F.lit(1).cast("bigint")},
        previous={"_y": y, "_above": "_h"},
        rows_per_block=rows_per_block,
    )
    gap = (F.col(y) - F.col("_y")) / F.col("_above")
    spacing = F.when(F.col("_y").isNull(), F.lit(base)).otherwise(F.greatest(F.lit(base), gap))
    return ordered.withColumn("spacing", spacing).drop("_y", "_above", "_h")


def page_layout(items: DataFrame, base: float = 1.0) -> DataFrame:
    """The text items of every page in reading order with their spacing; needs doc, page_num, item_no, x, y, height."""
    return reading_order(text_items(items), ["doc", "page_num"], "x", "y", "height", ["item_no"], base)


def page_elements(items: DataFrame, images: DataFrame, page: str = "page_num") -> DataFrame:
    """Text, image and table elements of a page in one list, with separately listed images added."""
    own = items.withColumn("element_type", F.coalesce("element_type", F.lit("paragraph")))
    extra = images.withColumn("element_type", F.lit("image"))
    rank = F.when(F.col("element_type") == "image", 1).when(F.col("element_type") == "table", 2).otherwise(0)
    text = F.when(rank == 0, inline_break(F.col("text"))).otherwise(F.col("text"))
    return own.unionByName(extra, allowMissingColumns=True).withColumn("part", rank).withColumn("text", text)
