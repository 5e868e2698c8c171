"""Entries by hand, listed uploads, sources of a job's rows, brands that a run leaves out."""

import json

from pyspark.sql import functions as F

from tessera.operators import runs
from tessera.sources import manual

GOOD = {"name": " A ", "city": "X", "country": "FR", "latitude": "48.5 N", "longitude": 2, "addressLine2": "Rue 1"}


def test_entries_by_hand(spark):
    without = lambda *keys: {k: v for k, v in GOOD.items() if k not in keys}
    bodies = {
        "good": GOOD, "name": GOOD | {"name": " \n"}, "typed": GOOD | {"name": 5}, "city": without("city"), "country": GOOD | {"country": None}, "lat": GOOD | {"latitude": True}, "lon": without("longitude"),
        "line": without("addressLine2"), "list": [GOOD], "several": {}, "full": GOOD | {"handle": "h", "phone": 41, "brands": [" a ", "", 7], "status": 0, "tags": "t"}, "off": GOOD | {"status": "false", "brands": "x, y"}, "on": GOOD | {"status": None},
    }
    rows = spark.createDataFrame([*((k, json.dumps(b)) for k, b in bodies.items()), ("broken", "{"), ("null", None)], "request_id string, body string")
    got = {r.request_id: r for r in manual.judged(rows).collect()}
    assert {k: r.problem for k, r in got.items()} == {
        "good": None, "full": None, "off": None, "on": None, "name": "name is required", "typed": "name is required", "city": "city is required", "country": "country is required", "several": "name is required",
        "lat": manual.NO_NUMBERS, "lon": manual.NO_NUMBERS, "line": manual.NO_LINE, "list": manual.NO_OBJECT, "broken": manual.NO_OBJECT, "null": manual.NO_OBJECT,
    }
    good, full = got["good"], got["full"]
    assert (good.Name, good["Address Line 2"], good.Latitude, good.Longitude, good.Status, good.Phone, good.Brands) == ("A", "Rue 1", "48.5", "2.0", "true", "", "")
    assert good.Handle.startswith(manual.PENDING) and len(good.Handle) == len(manual.PENDING) + 16 and good.Handle == manual.judged(rows).where("request_id = 'good'").first().Handle
    assert (full.Handle, full.Phone, full.Brands, full.Status, full.Tags) == ("h", "41", "a, 7", "false", "t")
    assert (got["off"].Status, got["off"].Brands, got["on"].Status) == ("false", "x, y", "true")
    assert manual.canonical(rows).count() == 4 and manual.canonical(rows.limit(0)).count() == 0


def test_listed_uploads(spark):
    rows = spark.createDataFrame([("a", "Master_Stores.CSV"), ("b", "x.csv"), ("c", None), ("d", "master_stores.csv.old")], "upload_id string, filename string")
    assert sorted(r.upload_id for r in runs.listed(rows).collect()) == ["b", "d"]
    places = spark.createDataFrame([("2", "B", "u"), ("1", "B", "u"), ("3", "A", "u"), ("4", "A", "v"), ("5", "A", None)], "handle string, name string, upload_id string")
    assert [r.handle for r in runs.of_upload(places, "u").collect()] == ["3", "1", "2"]


def test_job_sources_and_rows(spark):
    jobs = spark.createDataFrame([("own", "completed", "u1"), ("stored", "completed", "u2"), ("file", "completed", "u3"), ("lost", "completed", "u4"), ("runs", "running", "u1"), ("alone", "completed", None), ("gone", "completed", "u9"), ("odd", None, "u1")], "job_id string, status string, upload_id string")
    uploads = spark.createDataFrame([("u1", "f1", "scraper"), ("u2", "f2", "admin"), ("u3", "f3", None), ("u4", "f4", "scraper")], "upload_id string, filename string, uploaded_by string")
    stored = spark.createDataFrame([("u1", "s1", 1), ("u2", "s2", 2), ("u2", "s3", 3), (None, "s4", 4)], "upload_id string, name string, extra int")
    landed = spark.createDataFrame([("f1", "l1"), ("f2", "l2"), ("f3", "l3")], "filename string, name string")
    sources = runs.job_sources(jobs, uploads, stored, spark.createDataFrame([("f1",), ("f2",), ("f3",), ("f1",)], "filename string"))
    assert {r.job_id: (r.source, r.problem) for r in sources.collect()} == {
        "own": ("csv", None), "stored": ("db", None), "file": ("csv", None), "lost": (None, runs.LOST), "runs": (None, runs.UNFINISHED), "odd": (None, runs.UNFINISHED), "alone": (None, runs.UNLINKED), "gone": (None, runs.UNLINKED),
    }
    assert sorted(map(tuple, runs.job_rows(sources, stored, landed).collect())) == [("file", "csv", "l3"), ("own", "csv", "l1"), ("stored", "db", "s2"), ("stored", "db", "s3")]


def test_skipped_brands(spark):
    plain = {"url": "https://x", "type": "json"}
    cases = {
        "_meta": (plain, "meta", "meta"), "off": (plain | {"enabled": False}, "enabled false", "enabled false"), "template": (plain | {"url": "https://yourstore.de"}, "template url", "template url"), "html": ({"url": "x"}, "non-json (use --include-heavy)", None),
        "pages": (plain | {"pagination_fetch_urls": ["a"], "geohash_prefix_expansion": 0}, "expansion pagination_fetch_urls", None), "empty": (plain | {"force_radius_multi_point": {}, "stores_by_api_countries": None}, None, None),
        "view": (plain | {"url": "x?southWestLat=1"}, "viewport url", None), "plain": (plain, None, None),
    }
    rows = spark.createDataFrame([(k, json.dumps(c[0])) for k, c in cases.items()], "brand string, config string")
    b, c = F.col("brand"), F.col("config")
    got = {r.brand: (r.light, r.heavy) for r in rows.select("brand", runs.skip_reason(b, c).alias("light"), runs.skip_reason(b, c, True).alias("heavy")).collect()}
    assert got == {k: case[1:] for k, case in cases.items()}
