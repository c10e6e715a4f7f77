"""Queries on rates, early stops and stores that are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioworks.operators import pacing
from folioworks.operators.bucket_table import BucketTable
from folioworks.plans.registry import query, table
from folioworks.session import shared_dir
from folioworks.streaming import ingest


def folder(spark) -> str:
    return f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"


# Requests an hour by type; errors have no limit.
_PER_HOUR = "CASE event_type WHEN 'view' THEN 2 WHEN 'click' THEN 3 WHEN 'purchase' THEN 4 WHEN 'signup' THEN 2.5 END"

_RATE_SQL = f"""
WITH RECURSIVE o AS MATERIALIZED (
  SELECT event_id, event_type, epoch_us(ts) AS t, coalesce(round(60000000 / (({_PER_HOUR}) / 60.0)), 0)::BIGINT AS gap,
         row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events),
a AS (
  SELECT event_type, i, event_id, t, t AS admitted FROM o WHERE i = 1
  UNION ALL
  SELECT o.event_type, o.i, o.event_id, o.t, greatest(o.t, a.admitted + o.gap)
  FROM a JOIN o ON o.event_type = a.event_type AND o.i = a.i + 1)
SELECT event_id, event_type, strftime(make_timestamp(admitted), '%Y-%m-%d %H:%M:%S.%f') AS admitted, (admitted - t) / 1000000 AS waited FROM a"""


def _rate_schedule(spark, sf_dir, **how):
    rate = F.expr(_PER_HOUR).cast("double") / 60.0
    events = table(spark, sf_dir, "events")
    done = pacing.rate_schedule(events, ["event_type"], "ts", ["ts", "event_id"], rate, **how)
    shown = F.date_format("admitted", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("admitted")
    return done.select("event_id", "event_type", shown, "waited")


@query("rate_schedule", _RATE_SQL)
def rate_schedule(spark, sf_dir):
    """When every event may go on if those of a type keep a gap."""
    return _rate_schedule(spark, sf_dir)


@query("rate_schedule_blocked", _RATE_SQL)
def rate_schedule_blocked(spark, sf_dir):
    """The same where types have more events than a block."""
    return _rate_schedule(spark, sf_dir, rows_per_block=500)


def _in_order(events, parts):
    """The events in ranges of event_id."""
    end = (events.agg(F.max("event_id")).first()[0] or 0) + 1
    for n in range(parts):
        yield events.where((F.col("event_id") >= -(-n * end // parts)) & (F.col("event_id") < -(-(n + 1) * end // parts)))


@query(
    "stream_compacted",
    """SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id, event_type""",
)
def stream_compacted(spark, sf_dir):
    """Batches of a stream that are put into a bucketed table from time to time; the last ones are still folders."""
    path, keys = folder(spark), ("user_id", "event_type")
    events = table(spark, sf_dir, "events").select(*keys, "event_id", "value")
    kept = BucketTable(f"events_{uuid.uuid4().hex}", f"{path}/table", 8, "seq", keys)
    for n, part in enumerate(_in_order(events, 4)):
        part.write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{path}/in")
        ingest.append_batches(stream, f"{path}/store", f"{path}/checkpoint").awaitTermination()
        if n % 2 == 0:
            ingest.compact_batches(spark, f"{path}/store", kept, "event_id")
    return ingest.read_compacted(spark, f"{path}/store", kept, "event_id")


FILES = 8

_STOP_SQL = f"""
WITH f AS (SELECT event_id, event_type = 'error' AS failed, event_id * {FILES} // (max(event_id) OVER () + 1) AS file FROM events),
s AS (SELECT file, avg(failed::INT) AS share FROM f GROUP BY file),
stop AS (SELECT coalesce(min(file), {FILES}) AS last FROM s WHERE share > (SELECT avg(failed::INT) FROM f))
SELECT event_id, failed, file AS batch FROM f, stop WHERE file <= last"""


@query("early_stop", _STOP_SQL)
def early_stop(spark, sf_dir):
    """Results come file by file and are saved up to the first batch in which more fail than on the whole."""
    path = folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", (F.col("event_type") == "error").alias("failed"))
    share = events.agg(F.avg(F.col("failed").cast("int"))).first()[0]
    for part in _in_order(events, FILES):  # one after the other, so that they are read in this order
        part.coalesce(1).write.mode("append").parquet(f"{path}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    ingest.save_until(stream, f"{path}/out", f"{path}/checkpoint", F.col("failed"), share)
    return ingest.read_batches(spark, f"{path}/out").select("event_id", "failed", "batch")


# An event is sent again after half the delay under its own time, or after three delays under a new one.
_RESENT_SQL = """
WITH r AS (SELECT min(epoch_us(ts)) AS t0, max(epoch_us(ts)) AS t1 FROM events),
d AS (SELECT t0, t1, (t1 - t0) // 5000 AS ms FROM r),
s AS (
  SELECT event_id, epoch_us(ts) AS t, epoch_us(ts) AS arrival, epoch_us(ts) AS first, FALSE AS again FROM events
  UNION ALL
  SELECT event_id, epoch_us(ts) + CASE WHEN event_id % 3 = 1 THEN 3000 * ms ELSE 0 END,
         epoch_us(ts) + CASE WHEN event_id % 3 = 1 THEN 3000 ELSE 500 END * ms, epoch_us(ts), TRUE
  FROM events, d WHERE event_id % 3 < 2),
b AS (SELECT s.*, ms, (arrival - t0) * 4 // (t1 - t0 + 1) AS batch, (first - t0) * 4 // (t1 - t0 + 1) AS first_batch FROM s, d WHERE arrival <= t1),
w AS (SELECT batch, max(max(t)) OVER (ORDER BY batch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) // 1000 - any_value(ms) AS mark FROM b GROUP BY batch)
SELECT event_id, strftime(make_timestamp(t), '%Y-%m-%d %H:%M:%S.%f') AS at FROM b JOIN w USING (batch)
WHERE NOT again OR (batch > first_batch AND t > mark * 1000 AND first + ms * 1000 <= mark * 1000)"""


@query("late_duplicates", _RESENT_SQL)
def late_duplicates(spark, sf_dir):
    """Events that are sent again within the delay and beyond it, in four loads of a stream."""
    path = folder(spark)
    events = table(spark, sf_dir, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    t0, t1 = events.agg(F.min("t"), F.max("t")).first()
    if t0 is None:
        return events.select("event_id", F.col("t").cast("string").alias("at"))
    ms = (t1 - t0) // 5000
    sent = events.withColumn("arrival", F.col("t"))
    again = events.where("event_id % 3 < 2").withColumn(
        "arrival", F.col("t") + F.when(F.col("event_id") % 3 == 1, 3000 * ms).otherwise(500 * ms)
    )
    again = again.withColumn("t", F.when(F.col("event_id") % 3 == 1, F.col("arrival")).otherwise(F.col("t")))
    load = F.floor((F.col("arrival") - t0) * 4 / (t1 - t0 + 1))
    sent = sent.unionByName(again).where(F.col("arrival") <= t1).withColumn("load", load)
    sent = sent.select("event_id", F.timestamp_micros("t").alias("ts"), "load")
    for n in range(4):
        sent.where(F.col("load") == n).drop("load").write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema("event_id bigint, ts timestamp").parquet(f"{path}/in")
        ingest.append_first(
            stream, f"{path}/store", f"{path}/checkpoint", ["event_id"], "ts", f"{ms} milliseconds"
        ).awaitTermination()
    kept = ingest.read_batches(spark, f"{path}/store")
    return kept.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at"))
