"""Admission of requests at a limited rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioworks.operators.scan import ROWS_PER_BLOCK, ordered_scan


def gap_of(per_minute: Column) -> Column:
    """Microseconds between requests at a rate a minute; a rate that is NULL or not above 0 is no limit."""
    return F.when(per_minute > 0, F.round(60_000_000 / per_minute).cast("long")).otherwise(F.lit(0).cast("long"))


def rate_schedule(
    requests: DataFrame,
    keys: list[str],
    arrival: str,
    order: list[str],
    per_minute: Column,
    rows_per_block: int | None = ROWS_PER_BLOCK,
) -> DataFrame:
    """When every request is admitted if those of a key keep a gap: max(arrival, previous admission + gap).

    ``per_minute`` is the rate of a key, the same in all its rows; ``order`` (the arrival, then what decides ties) is
    the order of admission. In closed form an admission is the running maximum of ``arrival - i * gap`` plus
    ``i * gap``, so a key with many requests is scanned in blocks (``scan.ordered_scan``) instead of row after row.

    Adds ``admitted`` and ``waited`` (seconds). Requests without an arrival are never admitted: both are NULL.
    Arrivals without a time zone are taken in the session's.
    """
    rows = requests.withColumns({"_arrival": F.unix_micros(F.col(arrival).cast("timestamp")), "_gap": gap_of(per_minute)})
    timed = rows.where(F.col("_arrival").isNotNull())
    climbs = {"_admitted": (F.col("_arrival"), F.col("_gap"))}
    done = ordered_scan(timed, keys, order, rows_per_block=rows_per_block, climbs=climbs)
    done = done.select(
        *requests.columns,
        F.timestamp_micros("_admitted").cast(requests.schema[arrival].dataType).alias("admitted"),
        ((F.col("_admitted") - F.col("_arrival")) / 1_000_000).alias("waited"),
    )
    never = rows.where(F.col("_arrival").isNull()).select(
        *requests.columns,
        F.lit(None).cast(requests.schema[arrival].dataType).alias("admitted"),
        F.lit(None).cast("double").alias("waited"),
    )
    return done.unionByName(never)
