"""Event analytics over an event table (event, ts, session, props and so on); ``now`` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.records import property_or


def long(c: Column) -> Column:
    return c.cast("long")


def since(now: str, days: int) -> Column:
    return F.expr(f"timestamp_ntz '{now}' - make_dt_interval({days})")


def until(now: str) -> Column:
    return F.expr(f"timestamp_ntz '{now}'")


def summary(events: DataFrame, now: str, days: int) -> DataFrame:
    """Events in the window, distinct sessions in it, and events of today (whatever the window)."""
    inside = F.col("ts").between(since(now, days), until(now))
    return events.agg(
        long(F.count_if(inside)).alias("total_events"),
        long(F.countDistinct(F.when(inside, F.col("session")))).alias("unique_sessions"),
        long(F.count_if((F.col("ts") >= F.date_trunc("day", until(now))) & (F.col("ts") <= until(now)))).alias("events_today"),
    )


def by_store(events: DataFrame, kinds: dict[str, str], top: int = 50) -> DataFrame:
    """Counts of each kind of event by store, the busiest first; ties go by store."""
    store = property_or(F.col("props"), "k", "unknown")
    counts = [long(F.count_if(F.col("event") == kind)).alias(name) for name, kind in kinds.items()]
    first = next(iter(kinds))
    return events.where(F.col("event").isin(*kinds.values())).groupBy(store.alias("store")).agg(F.min_by("name", F.struct("ts", "event_id")).alias("store_name"), *counts).orderBy(F.desc(first), "store").limit(top)


def by_key(events: DataFrame, key: Column, counts: dict[str, Column], top: int = 50) -> DataFrame:
    """Conditional counts by a key, rows without one left out; the largest sum first."""
    out = events.withColumn("key", key).where("key IS NOT NULL AND key <> ''").groupBy("key").agg(*[long(F.count_if(c)).alias(n) for n, c in counts.items()])
    total = sum((F.col(n) for n in counts), F.lit(0))
    return out.orderBy(total.desc(), "key").limit(top)


def actions(events: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """One row of filtered counts."""
    return events.agg(*[long(F.count_if(c)).alias(n) for n, c in counts.items()])


def daily(events: DataFrame, now: str, days: int) -> DataFrame:
    """Events by UTC day from the window's first day to now, days without events as zero."""
    spark = events.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(F.to_date(since(now, days)), F.to_date(until(now)))).alias("day"))
    counted = events.where((F.col("ts") >= since(now, days)) & (F.col("ts") <= until(now))).groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return calendar.join(counted, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), long(F.coalesce("n", F.lit(0))).alias("n_events")).orderBy("day")
