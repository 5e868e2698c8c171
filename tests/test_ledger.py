"""The verification ledger, the order of survivors, and folders of CSV files with different headers."""

from datetime import date

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import dedupe, ranking, upsert, verification
from tessera.sources import files

PLACE = "handle string, name string, line1 string, city string, country string, lat double, lon double, is_premium boolean, brands string, updated_at date"


def place(handle, line="1 Main Street", lat=45.0, **more):
    row = {"handle": handle, "name": "A", "line1": line, "city": "Lyon", "country": "France", "lat": lat, "lon": 4.0, "is_premium": False, "brands": "X", "updated_at": date(2024, 1, 1)} | more
    return tuple(row.values())


def test_verified_once(spark, tmp_path):
    asked, path = [], f"file://{tmp_path}/ledger"

    def geocode(requests):
        rows = requests.collect()
        asked.extend(r.stamp for r in rows)
        if any("broken" in r.stamp for r in rows):
            raise OSError("gone")
        return spark.createDataFrame([(r.stamp, 45.1 if "far" in r.stamp else 45.0001, 4.0) for r in rows if "unknown" not in r.stamp], "stamp string, new_lat double, new_lon double")

    df = spark.createDataFrame([place(f"h{k}") for k in range(20)] + [place("f", "2 Far Road"), place("u", "3 Unknown Road"), place("n", None)], PLACE)
    assert verification.verify(df, geocode, path) == 1
    assert len(set(asked)) == 4 and len(asked) <= 4 * 4  # an address once a part
    out = {r.handle: (r.decision, r.run, r.lat) for r in verification.applied(df, verification.read_ledger(df, path)).collect()}
    assert out["h3"] == ("keep", 1, 45.0) and out["f"] == ("replace", 1, 45.1) and out["u"] == ("no_geocode", None, 45.0) and len(out) == 23
    asked.clear()
    verification.verify(df, geocode, path)
    assert set(asked) == {"3 unknown road|lyon|france"}
    changed = df.withColumn("line1", F.when(F.col("handle") == "h3", "9 New Street").otherwise(F.col("line1")))
    asked.clear()
    verification.verify(changed.where("handle <> 'u'"), geocode, path)
    assert asked == ["9 new street|lyon|france"]
    more = spark.createDataFrame([place(f"m{k}") for k in range(30)] + [place("b", "4 Broken Road")], PLACE)
    with pytest.raises(OSError):
        verification.verify(more, geocode, path, parts=5)
    done = verification.read_ledger(df, path).where("handle LIKE 'm%'").count()
    asked.clear()
    verification.verify(more.where("handle <> 'b'"), geocode, path, parts=5)
    assert verification.read_ledger(df, path).where("handle LIKE 'm%'").count() == 30 and (done == 0 or len(asked) < 5)


def test_verify_and_merge_leaves_other_places(spark, tmp_path):
    rows = [place("a"), place("b", lat=45.02), place("c", brands="Other"), place("d", brands=None)]
    df = spark.createDataFrame(rows, PLACE)
    near = lambda asked: asked.select("stamp", F.lit(45.0).alias("new_lat"), F.lit(4.0).alias("new_lon"))
    table, tally = verification.verify_and_merge(df, F.col("brands") == "X", near, f"file://{tmp_path}/ledger")
    assert tuple(tally.first()) == (1, 1, 0, 1, 1)
    assert sorted((r.handle, r.lat) for r in table.collect()) == [("a", 45.0), ("c", 45.0), ("d", 45.0)]


def test_first_rows_follow_the_order(spark):
    """Survivors by one value are those of the window's order, nulls included; keep-first and inserts with a hot key."""
    rows = [place(f"h{k:02}", name=["A", None, "Longer", " B "][k % 4], is_premium=[True, False, None][k % 3], brands=["a,b", None, "", "a"][k % 4 // 1], updated_at=[date(2024, 1, 1 + k % 5), None][k % 7 == 0], city=f"c{k % 6}") for k in range(60)]
    df = spark.createDataFrame(rows, PLACE)
    w = Window.partitionBy("city").orderBy(*dedupe.rank_key())
    want = {r.handle for r in df.withColumn("n", F.row_number().over(w)).where("n = 1").collect()}
    assert {r.handle for r in dedupe.survivors(df, "city").collect()} == want
    hot = spark.range(50_000).select(F.col("id").cast("string").alias("handle"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("key"))
    assert dedupe.keep_first(hot, [F.col("key")], [F.col("handle")]).count() == 50_000 - 16_667 + 1
    twice = hot.select(F.lit("x").alias("handle"), F.col("handle").alias("key"))
    assert upsert.inserted(hot.limit(0), twice, F.col("key")).collect()[0].key == "0"


def test_headers_of_their_own(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿Handle, Name ,City\nh1,\"A, \"\"x\"\"\nb\",Lyon\n\nh2,B,\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text("Name,Handle,Extra\nN3,h3,e\n")
    (tmp_path / "c.csv").write_text("City,Handle,City\nold,h4,new\n")
    (tmp_path / "d.csv").write_text("Handle,Name,City\n")
    rows = {r.Handle: (r.Name, r.City, r.Extra, r.file) for r in files.csv_directory(spark, str(tmp_path)).collect()}
    assert rows == {"h1": ('A, "x"\nb', "Lyon", None, "a.csv"), "h2": ("B", None, None, "a.csv"), "h3": ("N3", None, "e", "b.csv"), "h4": (None, "new", None, "c.csv")}
    faults = {(r.file, r.issue) for r in files.header_faults(spark, str(tmp_path), ("Extra",)).collect()}
    assert {("c.csv", "duplicate:City"), ("c.csv", "missing:Name"), ("b.csv", "missing:City")} <= faults and not any("unknown" in i for _, i in faults)
    (tmp_path / "none").mkdir()
    assert files.csv_directory(spark, str(tmp_path / "none")).count() == 0


def test_catalog_needs_both_urls(spark):
    row = lambda text: spark.range(1).select(ranking.strategy(F.lit(text), F.lit("single"), F.lit(False), F.lit(False)).alias("s")).first().s
    assert row('{"stores_by_api_countries":{"stores_url_template":"https://x/{country_id}"}}') == "single_call"
    assert row('{"stores_by_api_countries":{"countries_url":"u","stores_url_template":"https://x/{country_id}"}}') == "stores_by_api_countries"
