"""Image catalog, resolution of references, and images for answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType
from pyspark.sql.window import Window

from folioworks import fixed_values as fv
from folioworks.functions.core import to_lines
from folioworks.functions.markdown import image_urls
from folioworks.functions.text import content_hash, data_url, file_name, local_image_url, mime_type
from folioworks.session import cut_lineage

#: Rows of (question, image id, rank) that travel to the stored bytes, instead of the other way round.
MAX_BROADCAST_SURVIVORS = 200_000


def catalog(files: DataFrame) -> DataFrame:
    """Image rows of binary files (path, length, content): id is the content hash."""
    return files.select(
        content_hash(F.col("content")).alias("id"),
        mime_type(F.col("path")).alias("mime_type"),
        F.col("length").cast("int").alias("byte_size"),
        file_name(F.col("path")).alias("source_filename"),
        F.col("path").alias("stored_path"),
        F.col("content").alias("data"),
    )


def dedupe(images: DataFrame, key: str = "id", order: str = "stored_path") -> DataFrame:
    """First image per key; tasks merge copies before the exchange."""
    rest = [c for c in images.columns if c != key]
    first = images.groupBy(key).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(key, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_new(existing: DataFrame, incoming: DataFrame, key: str = "id", order: str = "stored_path") -> DataFrame:
    """Incoming images that are not stored yet; stored ones are never replaced."""
    return dedupe(incoming, key, order).join(existing.select(key), key, "left_anti")


def folder_of(path: Column) -> Column:
    return F.regexp_replace(F.translate(path, "\\", "/"), "/?[^/]*$", "")


def resolve(
    refs: DataFrame,
    files: DataFrame,
    doc_path: str = "path",
    name: str = "source_filename",
    bare_name_in_folder: bool = False,
) -> DataFrame:
    """Adds ``file_path``: the reference seen from the document, else in its image folder, else NULL.

    With ``bare_name_in_folder`` the image folder is asked for the file's name without its own path.
    """
    base = folder_of(F.col(doc_path))
    beside = F.when(F.startswith(name, F.lit("/")), F.col(name)).otherwise(
        F.concat_ws("/", F.nullif(base, F.lit("")), F.col(name))
    )
    last = file_name(F.col(name)) if bare_name_in_folder else F.col(name)
    inside = F.concat_ws("/", F.nullif(base, F.lit("")), F.lit(fv.IMAGE_FOLDER), last)
    known = files.select(F.col("path").alias("_file")).distinct()
    first = refs.join(known, beside == F.col("_file"), "left").withColumnRenamed("_file", "_beside")
    second = first.join(known, (inside == F.col("_file")) & F.col("_beside").isNull(), "left")
    return second.withColumn("file_path", F.coalesce("_beside", "_file")).drop("_beside", "_file")


def attach_images(records: DataFrame, refs: DataFrame, files: DataFrame, ident: str = "id", doc_path: str = "path") -> DataFrame:
    """Adds ``images`` to records from the references of their chunk; records without any pass through."""
    found = resolve(refs, files, doc_path).where(F.col("file_path").isNotNull())
    named = found.groupBy(ident).agg(F.sort_array(F.collect_list(F.struct("line_no", "file_path"))).alias("_i"))
    joined = records.join(named, ident, "left")
    images = F.transform(F.coalesce("_i", F.array().cast("array<struct<line_no:int,file_path:string>>")), lambda i: i["file_path"])
    return joined.withColumn("images", images).drop("_i")


def answer_images(
    found: DataFrame,
    images: DataFrame,
    question: str,
    position: str,
    image: str,
    max_images: int = 1,
    max_bytes: int = fv.IMAGE_MAX_BYTES,
) -> DataFrame:
    """First distinct stored images of a question's chunks that are small enough.

    ``found`` has one row per image reference. Repeats are merged before the join, and the rank keeps
    ``max_images`` per question in every task before the exchange. Where ``images`` has binary columns, only ids and
    sizes are joined and ranked, and the bytes of what is left are fetched afterwards: the survivors, ids and ranks,
    are counted and broadcast below a bound, so the stored bytes stay where they are; beyond it they are joined by id.
    """
    first_seen = found.groupBy(question, F.col(image).alias("id")).agg(F.min(position).alias("_at"))
    fitting = images.where(F.coalesce(F.col("byte_size"), F.lit(0)) <= max_bytes)
    late = [f.name for f in images.schema.fields if isinstance(f.dataType, BinaryType)]
    w = Window.partitionBy(question).orderBy("_at", "id")
    joined = first_seen.join(fitting.select("id") if late else fitting, "id")
    ranked = joined.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_images).drop("_at")
    if not late:
        return ranked
    survivors = cut_lineage(ranked)
    few = survivors.count() <= MAX_BROADCAST_SURVIVORS
    out = fitting.join(F.broadcast(survivors) if few else survivors, "id")
    return out.select("id", question, *[c for c in images.columns if c != "id"], "rank")


def images_block(ranked: DataFrame, question: str, alt: str = "source_filename") -> DataFrame:
    """(question, images): the markdown block with embedded images in rank order."""
    shown = F.concat(F.lit("!["), F.col(alt), F.lit("]("), data_url(F.col("mime_type"), F.col("data")), F.lit(")"))
    rows = ranked.select(question, "rank", shown.alias("m"))
    joined = F.expr("listagg(m, '\n') WITHIN GROUP (ORDER BY rank)")
    return rows.groupBy(question).agg(F.concat(F.lit(fv.IMAGES_LABEL + "\n"), joined).alias("images"))


def local_images(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """(keep..., line_no, k, url): local images of every line, in reading order."""
    lines = docs.select(*keep, F.posexplode(to_lines(F.col(text))).alias("line_no", "_line"))
    urls = lines.select(*keep, "line_no", F.posexplode(image_urls(F.col("_line"))).alias("k", "_u"))
    return urls.select(*keep, "line_no", "k", local_image_url(F.col("_u")).alias("url")).where(F.col("url").isNotNull())


def existing_images(images: DataFrame, files: DataFrame, doc_path: str = "path") -> DataFrame:
    """Local images whose file exists, with ``url`` replaced by the file's path."""
    found = resolve(images, files, doc_path, "url", bare_name_in_folder=True)
    return found.where(F.col("file_path").isNotNull()).withColumn("url", F.col("file_path")).drop("file_path")


def images_near_line(
    citations: DataFrame,
    images: DataFrame,
    doc: str,
    line: str,
    reach: int = fv.NEAR_LINES,
    max_images: int = fv.NEAR_IMAGES,
) -> DataFrame:
    """(doc, line, rank, url): first distinct images from ``reach`` lines before to ``reach`` after.

    A citation looks into the bands of lines it touches, so the join is on (document, band) and a
    long document is spread over its bands. ``line`` counts from 1, ``images.line_no`` from 0.
    """
    at = F.col(line) - 1
    asked = citations.select(doc, line).distinct()
    probes = asked.withColumn(
        "_band", F.explode(F.sequence(F.floor((at - reach) / reach), F.floor((at + reach - 1) / reach)))
    )
    banded = images.select(doc, "line_no", "k", "url", F.floor(F.col("line_no") / reach).alias("_band"))
    near = probes.join(banded, [doc, "_band"]).where(
        (F.col("line_no") >= at - reach) & (F.col("line_no") < at + reach)
    )
    first = near.groupBy(doc, line, "url").agg(F.min(F.struct("line_no", "k")).alias("_at"))
    w = Window.partitionBy(doc, line).orderBy("_at")
    ranked = first.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= max_images)
    return ranked.select(doc, line, "rank", "url")


def image_fallback(chunks: DataFrame, near: DataFrame, folder: DataFrame, doc: str, line: str) -> DataFrame:
    """Adds ``shown`` and ``origin``: a record's own images, else those near its line, else the folder's first.

    ``chunks`` has (doc, line, images); ``near`` is the result of ``images_near_line``; ``folder`` has
    (doc, path) of image files.
    """
    near_list = near.groupBy(doc, line).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("rank", "url"))), lambda s: s["url"]).alias("_near")
    )
    shown = folder.where(F.concat(F.lit("."), F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1))).isin(*fv.IMAGE_SUFFIXES))
    first = shown.groupBy(doc).agg(F.min("path").alias("_first"))
    joined = chunks.join(near_list, [doc, line], "left").join(first, doc, "left")
    own = F.size(F.coalesce("images", F.array().cast("array<string>"))) > 0
    picked = (
        F.when(own, F.col("images"))
        .when(F.col("_near").isNotNull(), F.col("_near"))
        .when(F.col("_first").isNotNull(), F.array("_first"))
        .otherwise(F.array().cast("array<string>"))
    )
    origin = (
        F.when(own, "record").when(F.col("_near").isNotNull(), "near").when(F.col("_first").isNotNull(), "folder").otherwise("none")
    )
    return joined.withColumn("shown", picked).withColumn("origin", origin).drop("_near", "_first")
