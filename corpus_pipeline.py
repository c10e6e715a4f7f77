"""From raw documents to shards for training: five stages, each one operator of ``folioworks.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.llm import decontamination, language_id, mixing, ngram_join, sharding
from folioworks.llm.shared import stage

SHARDS = 8
#: A text further than this from every language's profile is in none of them.
LEAST_LANGUAGE_SCORE = 0.1


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that no language's profile is near to.

    Profiles learn from all labelled documents: nothing is tested here, so none is held out as in op2.
    """
    profiles = language_id.train(docs)
    found = language_id.identify(docs, profiles)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SCORE)
    return found.where(known).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents with similar word n-grams, keep one: that with the smallest doc_id.

    Pairs of five-word shingles with a similarity of 0.8 or more link. A document is a row, known by a hash of id and
    text, so ids that occur with different texts are judged text by text. A NULL id is behind all others, the smaller
    hash decides between equal ids, and of rows that are equal in id and text one stays.
    """
    row = F.xxhash64("doc_id", "text")
    ids = docs.groupBy(row.alias("_row")).agg(F.min("doc_id").alias("_id"), F.count("*").alias("_times"))
    groups = ngram_join.similar_groups(docs.select(row.alias("doc_id"), "text"), width=5, percent=80)
    groups = groups.groupBy(F.col("doc_id").alias("_row")).agg(F.min("component_id").alias("_component"))
    members = stage(groups.join(ids, "_row"))
    first = F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id"), F.col("_row"))).alias("_first")
    first = members.groupBy("_component").agg(first).select(F.col("_first._row").alias("_row"))
    dropped = members.join(first, "_row", "left_anti").select("_row")
    kept = docs.withColumn("_row", row).join(dropped.hint("shuffle_hash"), "_row", "left_anti")
    again = members.where("_times > 1").select("_row")
    if again.isEmpty():
        return kept.select(docs.columns)
    single = kept.join(again, "_row", "left_anti").select(docs.columns)
    repeated = kept.join(again, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)
    return single.unionByName(repeated)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item or a paraphrase of one."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    flagged = decontamination.flag(docs, decontamination.fit(docs, benchmark))
    return flagged.where(~F.col("contaminated")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix takes them: sources with room give less, others repeat."""
    return mixing.draw(docs, mixing.mix(docs, shards=SHARDS))


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every document of the mix, with near equal bytes in each shard."""
    return sharding.shard(docs, SHARDS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]

#: Language profiles, the join and the latent search have no SQL form; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, step) in enumerate(STAGES, 1):
        docs = step(spark, docs, sf_dir)
        docs = stage(docs) if number < len(STAGES) else docs
    return docs
