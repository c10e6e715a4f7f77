"""Extraction records: reading, coercion, cleaning, retrieval text, bookkeeping."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioworks.functions import schemas as sc
from folioworks.functions import templates as tp
from folioworks.functions.core import bind
from folioworks.functions.text import clean_text, first_json_line, first_of_each, record_id


def parse_records(lines: DataFrame, line: str = "value") -> DataFrame:
    """First JSON object of each line that has ``data``: (data VARIANT, meta VARIANT, id).

    Blank lines, junk before the object, objects glued together and broken lines are tolerated.
    """

    def found(v: Column) -> Column:
        record = F.struct(sc.field(v, "data").alias("data"), sc.field(v, "meta").alias("meta"))
        return F.filter(F.array(record), lambda r: r["data"].isNotNull())

    # A generator, not a filter: the line is parsed once however its parts are used.
    parsed = F.inline(bind(F.try_parse_json(first_json_line(F.col(line))), found))
    out = lines.select(*[c for c in lines.columns if c != line], parsed)
    return out.withColumn("id", meta_id(F.col("meta")))


def meta_id(meta: Column) -> Column:
    """The record's own id, else its path and chunk number."""
    own = F.nullif(F.try_variant_get(meta, "$.id", "string"), F.lit(""))
    path = F.coalesce(F.try_variant_get(meta, "$.source_path", "string"), F.lit(""))
    index = F.coalesce(F.try_variant_get(meta, "$.chunk_index", "string"), F.lit(""))
    return F.coalesce(own, record_id(path, index))


def coerce_records(df: DataFrame, schema: str, data: str = "data") -> DataFrame:
    """Adds ``record`` (the schema's struct) and ``error`` (NULL for a valid record)."""
    v = F.col(data)
    bad = sc.problems(v, schema)
    out = df.withColumn("record", sc.coerce(v, schema))
    return out.withColumn("error", F.when(F.size(bad) > 0, F.concat(F.lit("missing: "), F.array_join(bad, ", "))))


def explode_wrapper(df: DataFrame, wrapper: str, data: str = "data") -> DataFrame:
    """One row per entry of a wrapper document's lists: the row's other columns, ``schema`` and the entry."""
    none = F.array().cast("array<struct<schema:string,entry:variant>>")

    def entries(name: str, schema: str) -> Column:
        found = F.try_variant_get(F.col(data), f"$.{name}", "array<variant>")
        return F.coalesce(F.transform(found, lambda e: F.struct(F.lit(schema).alias("schema"), e.alias("entry"))), none)

    lists = [entries(name, schema) for name, schema in sc.WRAPPERS[wrapper].items()]
    rest = [c for c in df.columns if c != data]
    return df.select(*rest, F.inline(F.concat(*lists))).withColumnRenamed("entry", data)


def clean_column(c: Column, dtype: T.DataType) -> Column:
    """Remove repeated lines and sentences from every string and repeats from every string list."""
    if isinstance(dtype, T.StringType):
        return clean_text(c)
    if isinstance(dtype, T.ArrayType):
        if isinstance(dtype.elementType, T.StringType):
            return F.when(c.isNotNull(), first_of_each(c))
        return F.transform(c, lambda x: clean_column(x, dtype.elementType))
    if isinstance(dtype, T.StructType):
        inner = F.struct(*[clean_column(c[f.name], f.dataType).alias(f.name) for f in dtype.fields])
        return F.when(c.isNotNull(), inner)
    return c


def clean_records(df: DataFrame, *columns: str) -> DataFrame:
    types = {f.name: f.dataType for f in df.schema.fields}
    return df.withColumns({c: clean_column(F.col(c), types[c]) for c in columns})


def retrieval_records(
    df: DataFrame, index_type: str, record: str = "record", ident: str = "id", extra: tuple[str, ...] = ()
) -> DataFrame:
    """Rows for a bucket: (index_type, id, text, metadata); metadata merges meta, data and bucket.

    With a ``data`` column (VARIANT) the metadata has the record as it was read: keys that the schema lacks, and
    NULLs. Otherwise it has ``record``. An ``error`` of the record is kept as a column; no row is left out.
    """
    schema = df.schema[record].dataType
    text = tp.retrieval_text(F.col(record), schema, index_type)
    meta = F.coalesce(F.to_json(F.col("meta")), F.lit("{}"))
    data = F.to_json(F.col("data" if "data" in df.columns else record))
    bucket = F.to_json(F.struct(F.lit(index_type).alias("index_type")))
    error = [c for c in ("error",) if c in df.columns and c not in extra]
    return df.select(
        F.lit(index_type).alias("index_type"),
        F.col(ident).alias("id"),
        text.alias("text"),
        merge_json(meta, F.coalesce(data, F.lit("{}")), bucket).alias("metadata"),
        *error,
        *extra,
    )


def merge_json(*objects: Column) -> Column:
    """One JSON object from several; a later value of a key replaces an earlier one and keeps its place."""

    def entries(o: Column) -> Column:
        keys = F.coalesce(F.json_object_keys(o), F.array().cast("array<string>"))
        values = F.from_json(o, T.MapType(T.StringType(), T.VariantType()))
        return bind(
            values,
            lambda vs: F.transform(
                keys,
                lambda k: F.struct(
                    k.alias("k"), F.coalesce(F.to_json(F.element_at(vs, k)), F.lit("null")).alias("v")
                ),
            ),
        )

    def last_wins(all_: Column) -> Column:
        names = F.transform(all_, lambda e: e["k"])
        first = F.array_distinct(names)
        back = F.reverse(all_)
        at = lambda k: F.array_position(F.transform(back, lambda e: e["k"]), k).cast("int") - 1
        return F.transform(first, lambda k: F.get(back, at(k)))

    def quoted(k: Column) -> Column:
        listed = F.to_json(F.array(k))
        return F.substr(listed, F.lit(2), F.length(listed) - 2)

    merged = bind(F.concat(*[entries(o) for o in objects]), last_wins)
    shown = F.transform(merged, lambda e: F.concat(quoted(e["k"]), F.lit(":"), e["v"]))
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))


def extract(
    chunks: DataFrame,
    schema: str,
    extractor: Callable[[str, str], str] | None = None,
    text: str = "chunk_text",
) -> DataFrame:
    """Extraction output of chunks: (id, data JSON, error).

    ``extractor(text, schema)`` returns a JSON text; what it raises becomes the row's error. Without
    one the placeholder record is used, which needs no Python.
    """
    if extractor is None:
        return chunks.select(
            "id", F.to_json(sc.placeholder(F.col(text), schema)).alias("data"), F.lit(None).cast("string").alias("error")
        )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, error = [], []
            for t in batch[text]:
                try:
                    data.append(extractor(t, schema))
                    error.append(None)
                except Exception as e:  # a failed item is a row, not a failed job
                    data.append(None)
                    error.append(str(e))
            yield pd.DataFrame({"id": batch["id"], "data": data, "error": error})

    return chunks.select("id", text).mapInPandas(run, "id string, data string, error string")


def embed(df: DataFrame, model: Callable[[pd.Series], pd.Series], text: str = "text", out: str = "vec") -> DataFrame:
    """Add unit vectors from ``model``, which maps a batch of texts to a batch of vectors."""
    from folioworks.functions.vectors import l2_normalize

    call = F.pandas_udf(model, T.ArrayType(T.DoubleType()))
    return df.withColumn(out, call(F.col(text))).withColumn(out, l2_normalize(F.col(out)))


def pending(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks without a successful record; failed ones are tried again.

    ``done`` has (id, data, ...); ids are made distinct before the join, so repeated records of one
    chunk cost nothing.
    """
    ok = done.where(F.col("data").isNotNull()).select("id").distinct()
    return chunks.join(ok, "id", "left_anti")
