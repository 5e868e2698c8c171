"""Bucketed tables: bytes follow the batch, failed and repeated batches change nothing; ingest of landed requests."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.operators.upsert import upserted
from tessera.sources import buckets
from tessera.streaming import events as S
from tessera.streaming import ingest

KIND = "handle string, name string, brands string, phone string, is_premium boolean"


def made(spark, tmp_path, n=2000, n_buckets=50):
    root = f"{tmp_path}/t"
    rows = spark.range(n).selectExpr("concat('h', id) AS handle", "concat('n', id) AS name", "'X' AS brands", "'+1' AS phone", "false AS is_premium")
    buckets.create(rows, root, "handle", n_buckets)
    return root, rows


def size(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*.parquet"))


def content(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_batches_touch_their_buckets(spark, tmp_path):
    root, rows = made(spark, tmp_path)
    assert content(buckets.read(spark, root)) == content(rows)
    before = size(root)
    batch = spark.createDataFrame([("h7", "B", "Y", "+2", None), ("new", "C", None, "+3", None)], KIND)
    new = buckets.apply(spark, root, batch, upserted)
    assert new.version == 1 and size(root) - before < before / 10
    assert content(buckets.read(spark, root)) == content(upserted(rows, batch)) and content(buckets.read(spark, root, 0)) == content(rows)
    assert buckets.apply(spark, root, batch.limit(0), upserted).version == 1
    assert buckets.vacuum(spark, root) > 0 and content(buckets.read(spark, root)) == content(upserted(rows, batch)) and buckets.versions(spark, root) == [1]


def test_failed_and_repeated_batches(spark, tmp_path):
    root, rows = made(spark, tmp_path, 200, 8)
    batch = spark.createDataFrame([("h7", "B", "Y", "+2", None)], KIND)
    broken = lambda old, new: old.withColumn("name", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        buckets.apply(spark, root, batch, broken, "w", 0)
    with pytest.raises(ValueError, match="own buckets"):
        buckets.apply(spark, root, batch, lambda old, new: rows, "w", 0)
    assert buckets.versions(spark, root) == [0] and content(buckets.read(spark, root)) == content(rows)
    appended = lambda old, new: old.unionByName(new)
    for _ in range(2):  # the second is a repetition
        buckets.apply(spark, root, batch, appended, "w", 0)
    assert buckets.read(spark, root).count() == 201
    buckets.apply(spark, root, batch, appended, "other", 0)
    assert buckets.read(spark, root).count() == 202


def test_second_writer_of_a_version_fails(spark, tmp_path):
    root, rows = made(spark, tmp_path, 50, 4)
    batch = spark.createDataFrame([("h7", "B", "Y", "+2", None)], KIND)

    def overtaken(old, new):
        buckets.apply(spark, root, batch, upserted)
        return upserted(old, new)

    with pytest.raises(Exception, match="AlreadyExists|exist"):
        buckets.apply(spark, root, batch.withColumn("name", F.lit("late")), overtaken)
    assert buckets.versions(spark, root) == [0, 1] and buckets.read(spark, root).where("name = 'B'").count() == 1


def test_empty_table_and_null_keys(spark, tmp_path):
    root = f"{tmp_path}/t"
    buckets.create(spark.createDataFrame([], "k string, x int"), root, "k", 4)
    assert buckets.read(spark, root).count() == 0 and buckets.read(spark, root).columns == ["k", "x"]
    buckets.apply(spark, root, spark.createDataFrame([(None, 1), ("a", 2), (None, 1)], "k string, x int"), lambda old, new: old.unionByName(new))
    assert content(buckets.read(spark, root)) == [("a", 2), (None, 1), (None, 1)]
    buckets.apply(spark, root, spark.createDataFrame([("a", 0)], "k string, x int"), lambda old, new: old.join(new.select("k"), "k", "left_anti"))
    assert content(buckets.read(spark, root)) == [(None, 1), (None, 1)]
    with pytest.raises(ValueError):
        buckets.create(spark.createDataFrame([], "v string"), f"{tmp_path}/u", "v", 4)


def test_stream_in_any_order_of_files(spark, tmp_path):
    schema = "event_id long, ts timestamp, event string, props string, name string"
    rows = [(n, n * 60, "click" if n % 3 else "view", json.dumps({"k": n % 4}) if n % 5 else None, f"name {n}") for n in range(40)]
    df = spark.createDataFrame(rows, "event_id long, at long, event string, props string, name string").select("event_id", F.timestamp_seconds("at").alias("ts"), "event", "props", "name")
    kinds = {"taps": "click", "views": "view"}
    wanted = content(S.store_stats(df, kinds))
    for turn, order in enumerate((F.col("event_id"), -F.col("event_id"))):
        folder = f"{tmp_path}/{turn}"
        for part in df.sort(order).select("event_id").collect()[::8]:
            low = part.event_id if turn == 0 else part.event_id - 7
            df.where(F.col("event_id").between(low, low + 7)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        assert content(S.latest(spark, S.store_stats(S.stream(spark, f"{folder}/in", schema, 1), kinds), "store", folder)) == wanted


def test_requests_are_judged_whole(spark):
    event = {"event": "tap", "sessionId": "s", "properties": {"a": 1}, "deviceType": ""}
    bodies = {
        "single": event, "two": {"events": [event, {"event": "x", "properties": 0}]}, "none": {"events": []}, "no list": {"events": "x"}, "nothing": {},
        "full": {"events": [event] * 100}, "many": {"events": [event] * 101}, "number": {"events": [event, {"event": 5}]}, "blank": {"events": [{"event": ""}]}, "text": {"events": ["tap"]},
    }
    rows = spark.createDataFrame([*((k, json.dumps(b)) for k, b in bodies.items()), ("broken", "{"), ("null", None)], "request_id string, body string")
    judged = ingest.judged(rows)
    reasons = {r.request_id: r.reason for r in judged.collect()}
    none, unnamed = dict.fromkeys(("none", "no list", "nothing", "broken", "null"), ingest.NONE), dict.fromkeys(("number", "blank", "text"), ingest.UNNAMED)
    assert reasons == {"single": None, "two": None, "full": None, "many": ingest.TOO_MANY} | none | unnamed
    got = content(ingest.taken(judged).where("request_id <> 'full'"))
    assert got == [("single", 0, "tap", '{"a":1}', "s", None), ("two", 0, "tap", '{"a":1}', "s", None), ("two", 1, "x", None, None, None)]
