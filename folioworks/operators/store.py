"""The vector bucket table: upserts, unions, statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks import fixed_values as fv
from folioworks.functions.text import stable_id

KEYS = ["index_type", "id"]
MAX_LITERAL_BUCKETS = 256


def bucket_name(name: Column) -> Column:
    """Legacy bucket names to the buckets in use."""
    out = name
    for old, new in fv.LEGACY_BUCKETS.items():
        out = F.when(name == old, new).otherwise(out)
    return out


def with_ids(df: DataFrame, text: str = "text", metadata: str = "metadata") -> DataFrame:
    """Rows without an id get one from their content; ``metadata`` is a map of strings."""
    return df.withColumn("id", F.coalesce("id", stable_id(F.col(text), F.col(metadata))))


def latest(df: DataFrame, seq: str, keys: list[str] = KEYS) -> DataFrame:
    """Last row per key by ``seq``; every task keeps one row per key before the exchange."""
    rest = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(seq)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def checked(incoming: DataFrame, stats: DataFrame, vec: str = "vec", model: str | None = None) -> DataFrame:
    """Fail on a vector whose size, or on a model whose name, differs from the bucket's.

    ``stats`` has one row per bucket: (index_type, dim, model). A handful of buckets becomes a constant
    map, so the incoming rows are not exchanged for the check; a long list is joined.
    """
    known = stats.select("index_type", F.col("dim").cast("int").alias("dim"), F.col("model").cast("string").alias("model"))
    rows = known.limit(MAX_LITERAL_BUCKETS + 1).collect()
    if len(rows) <= MAX_LITERAL_BUCKETS:
        dims = F.create_map(*[F.lit(x) for r in rows if r["dim"] is not None for x in (r["index_type"], r["dim"])])
        models = F.create_map(*[F.lit(x) for r in rows if r["model"] is not None for x in (r["index_type"], r["model"])])
        dim = F.try_element_at(dims.cast("map<string,int>"), F.col("index_type"))
        built_with = F.try_element_at(models.cast("map<string,string>"), F.col("index_type"))
        joined = incoming.withColumns({"_dim": dim, "_model": built_with})
    else:
        side = known.select(F.col("index_type").alias("_b"), F.col("dim").alias("_dim"), F.col("model").alias("_model"))
        joined = incoming.join(side, incoming["index_type"] == F.col("_b"), "left")
    wrong_dim = F.col("_dim").isNotNull() & (F.size(vec) != F.col("_dim"))
    wrong_model = F.col("_model").isNotNull() & F.lit(model).isNotNull() & (F.col("_model") != F.lit(model))
    # A filter, so that no choice of columns can leave the check out.
    fits = (
        F.when(wrong_dim, F.raise_error(F.concat(F.lit("vector size differs from bucket "), F.col("index_type"))).cast("boolean"))
        .when(wrong_model, F.raise_error(F.concat(F.lit("model differs from bucket "), F.col("index_type"))).cast("boolean"))
        .otherwise(F.lit(True))
    )
    return joined.where(fits).select(*incoming.columns)


def upsert(existing: DataFrame, incoming: DataFrame, seq: str = "seq") -> DataFrame:
    """``existing`` with the last incoming row per (index_type, id) put in its place."""
    fresh = latest(incoming, seq).drop(seq)
    kept = existing.join(fresh.select(*KEYS), KEYS, "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def index_stats(df: DataFrame, vec: str = "vec", model: str | None = None) -> DataFrame:
    """Rows, vector size and model per bucket. Sizes that differ show as ``min_dim`` < ``dim``."""
    out = df.groupBy("index_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(F.size(vec)).alias("min_dim"), F.max(F.size(vec)).alias("dim")
    )
    return out.withColumn("model", F.lit(model).cast("string"))


def union_outputs(outputs: dict[str, list[DataFrame]]) -> DataFrame:
    """Extraction outputs by bucket as one table; an output may feed several buckets."""
    named = [
        df.withColumn("index_type", F.lit(bucket)) for bucket, frames in outputs.items() for df in frames
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def fan_out(df: DataFrame, kind: str, buckets: dict[str, list[str]]) -> DataFrame:
    """One row per bucket that the row's kind feeds, from a single scan; other kinds are dropped."""
    targets = F.lit(None).cast("array<string>")
    for name, names in buckets.items():
        targets = F.when(F.col(kind) == name, F.array(*[F.lit(b) for b in names])).otherwise(targets)
    return df.withColumn("index_type", F.explode(targets))
