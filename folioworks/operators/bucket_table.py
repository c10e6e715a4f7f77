"""A vector bucket as a table that is bucketed by key, so that an upsert moves only what comes in.

The table has one file for each hash bucket of the keys, in a partition folder of its own. An upsert exchanges the
incoming rows, joins them to the stored files of the buckets they fall into (which Spark reads as hash partitions, without
an exchange), and overwrites just those partitions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioworks.operators.store import KEYS, latest
from folioworks.session import cut_lineage, settings

BUCKET = "_bucket"


@dataclass(frozen=True)
class BucketTable:
    """``name`` in the session's catalog, files below ``path`` (a shared folder), ``buckets`` hash buckets of ``keys``.

    ``seq`` is a column that grows with time: a stored row is replaced by one whose ``seq`` is not smaller, so an upsert
    that runs twice, or again after a crash in the middle of it, changes nothing.
    """

    name: str
    path: str
    buckets: int
    seq: str
    keys: tuple[str, ...] = tuple(KEYS)

    def bucket_of(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _order(self) -> Column:
        """``seq`` behind whether there is one, for an aggregate would pass over rows without."""
        return F.struct(F.col(self.seq).isNotNull(), F.col(self.seq))

    def create(self, rows: DataFrame) -> BucketTable:
        """Write the table with the last row of each key; ``rows`` has keys, ``seq`` and whatever else is to be kept."""
        first = latest(rows.withColumn("_seq", self._order()).repartition(self.buckets, *self.keys), "_seq", list(self.keys))
        first.select(*rows.columns, self.bucket_of().alias(BUCKET)).write.format("parquet").option(
            "path", self.path
        ).partitionBy(BUCKET).bucketBy(self.buckets, *self.keys).sortBy(*self.keys).saveAsTable(self.name)
        return self

    def open(self, spark: SparkSession, schema: str) -> BucketTable:
        """Put files that another session has written into this one's catalog; ``schema`` is that of the rows."""
        keys = ", ".join(f"`{k}`" for k in self.keys)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({schema}, {BUCKET} int) USING parquet PARTITIONED BY ({BUCKET}) "
            f"CLUSTERED BY ({keys}) SORTED BY ({keys}) INTO {self.buckets} BUCKETS LOCATION '{self.path}'"
        )
        spark.sql(f"MSCK REPAIR TABLE {self.name}")
        return self

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.table(self.name).drop(BUCKET)

    def touched(self, incoming: DataFrame) -> list[int]:
        """Buckets that rows fall into; at most as many numbers as there are buckets."""
        return sorted(r[0] for r in incoming.select(self.bucket_of()).distinct().collect())

    def merged(self, incoming: DataFrame, buckets: list[int]) -> DataFrame:
        """The rows of some buckets with the incoming ones in their places: one task, one file a bucket.

        Columns that the table doesn't have are left out, those that ``incoming`` lacks become NULL in new rows and stay
        as they are in others.
        """
        stored = incoming.sparkSession.table(self.name).where(F.col(BUCKET).isin(buckets))
        incoming = incoming.select(*[c for c in stored.columns if c in incoming.columns])
        given = incoming.repartition(self.buckets, *self.keys).withColumn("_seq", self._order())
        fresh = latest(given, "_seq", list(self.keys)).drop("_seq")
        there = [F.col(f"s.{k}") == F.col(f"f.{k}") for k in self.keys]
        both = stored.withColumn("_stored", F.lit(True)).alias("s").join(
            fresh.withColumn("_given", F.lit(True)).alias("f"), there, "full_outer"
        )
        newer = F.col("_given") & (
            F.col("_stored").isNull() | F.col(f"s.{self.seq}").isNull() | (F.col(f"f.{self.seq}") >= F.col(f"s.{self.seq}"))
        )
        newer = F.coalesce(newer, F.lit(False))

        def column(c: str) -> Column:
            if c in self.keys:
                return F.coalesce(f"s.{c}", f"f.{c}").alias(c)
            if c == BUCKET:
                return self.bucket_of_joined().alias(c)
            if c not in incoming.columns:
                return F.col(f"s.{c}").alias(c)
            return F.when(newer, F.col(f"f.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

        return both.select(*[column(c) for c in stored.columns])

    def bucket_of_joined(self) -> Column:
        keys = [F.coalesce(f"s.{k}", f"f.{k}") for k in self.keys]
        return F.pmod(F.hash(*keys), F.lit(self.buckets))

    def upsert(self, incoming: DataFrame) -> list[int]:
        """Put the last incoming row of each key in its place, and return the buckets that were rewritten.

        Rows with a NULL key are refused, for no later row could replace them. The incoming rows are written to the
        shared folder first, since they are read twice.
        """
        spark = incoming.sparkSession
        missing = F.greatest(*[F.col(k).isNull().cast("int") for k in self.keys], F.lit(0)) == 1
        checked = F.when(missing, F.raise_error(F.lit("a row without a key")).cast("boolean")).otherwise(F.lit(True))
        incoming = cut_lineage(incoming.where(checked))
        buckets = self.touched(incoming)
        if buckets:
            rows = self.merged(incoming, buckets)
            # Only in this mode may a table be read while its partitions are replaced.
            with settings(spark, {"spark.sql.sources.partitionOverwriteMode": "dynamic"}):
                rows.write.insertInto(self.name, overwrite=True)
            spark.catalog.refreshTable(self.name)
        return buckets
