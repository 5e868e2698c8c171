"""Landed requests that bring events, singly or up to a hundred at once: checked whole, stored once however often they come.

A body is a JSON object, either an event or one with a list of them under ``events``. It is taken or refused as a whole.
Bodies are read as VARIANT in the engine. Taken events go to a bucketed table by request, refused bodies with their
reason to a folder by batch, so a repeated batch and a request that is sent again change nothing.

Defined results: a null body, one that isn't JSON, and one without a list (if it has the key ``events`` or no ``event``) is
refused as without events; properties that are null, false, zero or an empty text are null, and so are session and device
if empty; other keys are ignored. Positions within a body start at 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import buckets
from .events import each_batch

MOST = 100
#: The answers to refused bodies.
NONE, TOO_MANY, UNNAMED = "Missing or empty events array", "Maximum 100 events per batch", 'Each event must have an "event" string field'
STORED = "request_id string, position int, event string, properties string, session_id string, device_type string"


def _text(v: Column, key: str) -> Column:
    """A value that isn't empty, as text."""
    return F.nullif(F.try_variant_get(v, f"$.{key}", "string"), F.lit(""))


def _named(v: Column) -> Column:
    name = F.try_variant_get(v, "$.event", "variant")
    return (F.schema_of_variant(name) == "STRING") & _text(v, "event").isNotNull()


def _listed(v: Column) -> Column:
    """The body's events; null if it has none."""
    single = F.try_variant_get(v, "$.events", "variant").isNull() & F.try_variant_get(v, "$.event", "variant").isNotNull()
    return F.when(single, F.array(v)).otherwise(F.try_variant_get(v, "$.events", "array<variant>"))


def judged(requests: DataFrame) -> DataFrame:
    """(request_id, body) with the body's events (``found``) and the ``reason`` to refuse it, null if it is taken."""
    out = requests.select("request_id", "body", _listed(F.try_parse_json("body")).alias("found"))
    n = F.coalesce(F.size("found"), F.lit(0))
    unnamed = F.exists("found", lambda e: ~F.coalesce(_named(e), F.lit(False)))
    return out.withColumn("reason", F.when(n <= 0, NONE).when(n > MOST, TOO_MANY).when(unnamed, UNNAMED))


def taken(rows: DataFrame) -> DataFrame:
    """The events of judged bodies that are taken, one row for each."""
    e = F.col("e")
    properties = F.try_variant_get(e, "$.properties", "variant")
    shown = F.to_json(properties)
    kept = F.when(properties.isNotNull() & ~shown.isin("null", "false", "0", "0.0", '""'), shown)
    each = rows.where("reason IS NULL").select("request_id", F.posexplode("found").alias("position", "e"))
    return each.select("request_id", "position", _text(e, "event").alias("event"), kept.alias("properties"), _text(e, "sessionId").alias("session_id"), _text(e, "deviceType").alias("device_type"))


def refused(rows: DataFrame) -> DataFrame:
    return rows.where("reason IS NOT NULL").select("request_id", "reason")


def _first_time(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows of requests that aren't stored yet, beside those that are."""
    return stored.unionByName(batch.join(stored.select("request_id").distinct(), "request_id", "left_anti"))


def ingest(requests: DataFrame, root: str, checkpoint: str, writer: str = "ingest") -> StreamingQuery:
    """Store a stream of requests: events in the bucketed table ``root``/events, which must have been made with the columns
    of STORED and the key ``request_id``, refused ones in ``root``/refused/batch=<n>. A request that comes more than once counts once: within a batch the one with
    the greatest body, later ones not at all."""

    def apply(batch: DataFrame, n: int) -> None:
        once = judged(batch.groupBy("request_id").agg(F.max("body").alias("body")))
        buckets.apply(batch.sparkSession, f"{root}/events", taken(once), _first_time, writer, n)
        refused(once).write.mode("overwrite").parquet(f"{root}/refused/batch={n}")

    return each_batch(requests, "append", checkpoint, apply)
