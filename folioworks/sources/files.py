"""Scans of documents, records, scores, buckets and images."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioworks import fixed_values as fv
from folioworks.functions.core import strip
from folioworks.functions.text import file_name
from folioworks.operators import evaluation as ev
from folioworks.operators import records
from folioworks.operators.sampling import first_rows
from folioworks.operators.scan import with_positions
from folioworks.sources.csv_records import read_csv


def _path(column: str = "_metadata.file_path"):
    """The file's path without the scheme of local files."""
    return F.regexp_replace(F.url_decode(F.replace(F.col(column), F.lit("+"), F.lit("%2B"))), "^file:/+", "/")


def read_markdown(spark: SparkSession, path: str, pattern: str = "*.md") -> DataFrame:
    """(path, text) of one file, or of all matching files below a folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter=pattern)
    return raw.select(_path().alias("path"), F.col("value").alias("text"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, name, size_bytes) of matching files; the contents are not read."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    named = raw.select(_path("path").alias("path"), F.col("length").alias("size_bytes"))
    return named.select("path", file_name(F.col("path")).alias("name"), "size_bytes")


def ordered_files(files: DataFrame, *order: str) -> DataFrame:
    """Adds ``position``: files numbered from 0 by path, or pages of files by path and page, without gaps."""
    return with_positions(files, ["path", *order])


def read_jsonl(spark: SparkSession, *paths: str) -> DataFrame:
    """Records (data, meta, id) of one or many JSONL files or globs."""
    return records.parse_records(spark.read.text(list(paths)).select("value"))


def read_records(spark: SparkSession, *paths: str, schema: str, index_type: str) -> DataFrame:
    """Bucket rows (index_type, id, text, metadata, error) of every record with ``data`` and ``meta``.

    A record that the schema finds wanting stays, with its ``error``.
    """
    typed = records.coerce_records(read_jsonl(spark, *paths).where(F.col("meta").isNotNull()), schema)
    return records.retrieval_records(typed, index_type)


OCR_ITEM = T.StructType(
    [
        T.StructField("element_type", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("skip", T.BooleanType()),
        T.StructField("box", T.ArrayType(T.ArrayType(T.DoubleType()))),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("image_id", T.StringType()),
        T.StructField("file_path", T.StringType()),
    ]
)
OCR_PAGE = T.StructType([T.StructField("page_num", T.IntegerType()), T.StructField("results", T.ArrayType(OCR_ITEM))])
OCR_RESULTS = T.StructType([T.StructField("pages", T.ArrayType(OCR_PAGE)), T.StructField("images", T.ArrayType(OCR_ITEM))])


def read_ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """(doc, pages, images) of OCR result files; ``doc`` is the file's name without suffix."""
    raw = spark.read.schema(OCR_RESULTS).option("multiLine", "true").json(path)
    doc = F.regexp_replace(file_name(F.col("_metadata.file_path")), r"\.[^.]*$", "")
    return raw.select(doc.alias("doc"), "pages", "images")


def item_box(items: DataFrame) -> DataFrame:
    """Adds x (left), y (mean of the corners) and height of the item's box."""
    ys = F.transform("box", lambda p: F.get(p, 1))
    mean = F.try_divide(F.aggregate(ys, F.lit(0.0), lambda s, y: s + y), F.size("box").cast("double"))
    return items.withColumns(
        {
            "x": F.coalesce(F.get(F.get("box", 0), 0), F.lit(0.0)),
            "y": F.coalesce(mean, F.lit(0.0)),
            "height": F.coalesce(F.abs(F.get(F.get("box", 2), 1) - F.get(F.get("box", 0), 1)), F.lit(0.0)),
        }
    )


def _numbered(df: DataFrame, counts: DataFrame, name: str) -> DataFrame:
    """Number rows from 0 by (file, record), whatever the split of the input."""
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))  # a row per file
    files = counts.select("_file", F.coalesce(before, F.lit(0)).alias("_before"))
    return df.join(files, "_file").withColumn(name, F.col("_before") + F.col("_record")).drop("_before")


def _require(df: DataFrame, columns) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns {missing}, found {df.columns}")


def read_questions(spark: SparkSession, path: str, limit: int | None = None, keep_blank: bool = False) -> DataFrame:
    """(id, difficulty, question, ground_truth) of an evaluation set.

    Rows without question or answer are dropped unless ``keep_blank``; without ids the rows are
    numbered by file order.
    """
    df, counts = read_csv(spark, path)
    _require(df, [fv.QUESTION_COLUMN, fv.REFERENCE_COLUMN])
    if "id" not in df.columns:
        df = _numbered(df, counts, "id")
    ident = F.col("id").cast("bigint")
    level = F.col(fv.DIFFICULTY_COLUMN) if fv.DIFFICULTY_COLUMN in df.columns else F.lit(None).cast("string")
    out = df.select(
        ident.alias("id"),
        F.coalesce(level, F.lit(fv.UNKNOWN_DIFFICULTY)).alias("difficulty"),
        strip(F.coalesce(F.col(fv.QUESTION_COLUMN), F.lit(""))).alias("question"),
        strip(F.coalesce(F.col(fv.REFERENCE_COLUMN), F.lit(""))).alias("ground_truth"),
    )
    if not keep_blank:
        out = out.where("question <> '' AND ground_truth <> ''")
    return first_rows(out, limit, "id")


def read_scores(spark: SparkSession, path: str, metrics=fv.SCORE_METRICS) -> DataFrame:
    """A prepared run of a score file; values that are no numbers become NULL."""
    df, counts = read_csv(spark, path)
    _require(df, ["user_input", *metrics])
    return ev.prepare_run(_numbered(df, counts, "row_id").drop("_file", "_record"), metrics)


def read_bucket(spark: SparkSession, path: str, index_type: str | None = None, dim: int | None = None) -> DataFrame:
    """Rows of a bucket table: only the bucket's folder is read, vectors of another size are left out."""
    df = spark.read.parquet(path)
    if index_type is not None:
        df = df.where(F.col("index_type") == index_type)
    return df if dim is None else df.where(F.size("vec") == dim)


def read_images(spark: SparkSession, path: str, pattern: str = "*.{png,jpg,jpeg,webp,gif}") -> DataFrame:
    """Image catalog rows of the files below a folder."""
    from folioworks.operators.images import catalog

    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return catalog(raw.withColumn("path", _path("path")))


def find_image(images: DataFrame, image_id: str) -> DataFrame:
    return images.where(F.col("id") == image_id)
