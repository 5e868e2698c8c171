"""Merging, upserts, validation, page extraction, sources, sinks and streams on small tables."""

import json
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import html
from tessera.functions.generate import grid, prefixes, viewport_url
from tessera.operators import audits, dedupe, joins, upsert, validation
from tessera.operators.components import components
from tessera.sources import fanout, files, sinks
from tessera.streaming import events as S

PLACE = "handle string, name string, line1 string, city string, country string, lat double, lon double, is_premium boolean, brands string, updated_at date"


def place(handle, name="Shop", line1="10 Main St", lat=10.0, lon=20.0, city="Paris", premium=False, brands="A"):
    from datetime import date

    return (handle, name, line1, city, "France", lat, lon, premium, brands, date(2024, 1, 1))


def table(spark, rows):
    return spark.createDataFrame(rows, PLACE)


def plans(spark, *rows):
    out = {}
    for r in dedupe.merge_plans(table(spark, rows)).collect():
        out.setdefault(r.plan, set()).add(r.handle)
    return sorted(map(sorted, out.values()))


def test_merge_plans(spark):
    assert plans(spark, place("a"), place("b", line1="10 Main Street")) == [["a", "b"]]
    assert plans(spark, place("a"), place("b", city="Lyon")) == []
    assert plans(spark, place("a", name="Maison du Temps", line1="10 Main St"), place("b", name="Maison du Temps", line1="10 Main Plaza Mall", lat=10.0005)) == [["a", "b"]]
    assert plans(spark, place("a", name="Alpha", line1="10 Main St"), place("b", name="Beta", line1="10 Main Plaza", lat=10.0003)) == []
    assert plans(spark, place("a"), place("b", lat=14.0)) == []
    assert plans(spark, place("a"), place("b", lat=0.0, lon=0.0)) == [["a", "b"]]
    three = plans(spark, place("a", name="Maison du Temps"), place("b", name="Maison du Temps"), place("c", name="Maison du Temps", line1="10 Main Plaza Mall", lat=10.0002))
    assert len([h for g in three for h in g]) == len({h for g in three for h in g})


def test_merged_table(spark):
    rows = [place("a", brands="X"), place("b", name="Shop Paris", premium=True, brands="Y, x"), place("c", city="Rome", brands="Z")]
    df = table(spark, rows)
    out = {r.handle: r for r in dedupe.merged(df, dedupe.merge_plans(df)).collect()}
    assert set(out) == {"b", "c"} and out["b"].brands == "Y, X" and out["b"].name == "Shop Paris" and out["b"].is_premium and out["c"].brands == "Z"


def test_clusters(spark):
    rows = [place("a"), place("b", lat=10.00001), place("c", name="Other", line1="99 Far Rd", lat=50.0), place("d", line1="10 Main Street", lat=10.001)]
    got = {r.handle: r.cluster for r in dedupe.clusters(table(spark, rows)).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "a"}


def test_near_pairs_equal_brute_force(spark):
    import math
    import random

    r = random.Random(3)
    points = [(f"h{k:03d}", 60 * r.random() * r.choice([-1, 1]), r.choice([179.9995, -179.9995, 5.0]) + r.random() * 0.002) for k in range(60)]
    points += [(h + "x", la + 0.0005 * r.random(), (lo + 0.001 * r.random() + 540) % 360 - 180) for h, la, lo in points]
    rows = [place(h, lat=la, lon=(lo + 540) % 360 - 180) for h, la, lo in points]

    def meters(p, q):
        a = math.sin(math.radians(q[5] - p[5]) / 2) ** 2 + math.cos(math.radians(p[5])) * math.cos(math.radians(q[5])) * math.sin(math.radians(q[6] - p[6]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(1 - a))

    want = {(p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and meters(p, q) <= 150}
    got = joins.near_pairs(table(spark, rows), 150).collect()
    assert Counter((r.u, r.v) for r in got) == Counter(want) and len(want) > 10


def test_probe_tiers(spark):
    places = table(spark, [place("p1"), place("p2", name="Maison du Temps", line1="55 Long Avenue Name", lat=30.0), place("p3", name="Zeta", line1="1 X", lat=40.0)])
    asked = table(spark, [place("q1", name="?"), place("q2", name="Maison du Temps", line1="55 Long Avenue Name Mall", lat=30.0005), place("q3", name="Other", line1="2 Y", lat=40.0005), place("q4", lat=70.0, line1="7 Nowhere", name="None")])
    got = {r.handle: (r.match, r.tier) for r in joins.probes(asked, places).collect()}
    assert got == {"q1": ("p1", 1), "q2": ("p2", 3), "q3": ("p3", 6)}


def test_keep_first_and_handles(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "", "x"), (4, None, "x"), (5, "", "x")], "n int, k string, v string")
    assert sorted(r.n for r in dedupe.keep_first(df, [F.col("k"), F.col("v")], [F.col("n")]).collect()) == [1, 3, 4, 5]
    assert [(r.k0, r.n, r.rows) for r in dedupe.duplicates(df, [F.col("k")], F.col("n")).collect()] == [("a", 2, [1, 2])]
    slugs = spark.createDataFrame([(1, "s"), (2, "s"), (3, "s-1")], "n int, h string")
    got = [r.h for r in dedupe.unique_handles(slugs, "h", F.col("n")).collect()]
    assert len(set(got)) == 3


def test_components(spark):
    edges = [(f"n{k:02d}", f"n{k + 1:02d}") for k in range(20)] + [("z1", "z2")]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u string, v string")).collect()}
    assert got == {f"n{k:02d}": "n00" for k in range(21)} | {"z1": "z1", "z2": "z1"}


def test_upsert(spark):
    schema = "handle string, name string, line1 string, phone string, brands string, is_premium boolean"
    old = spark.createDataFrame([("a", "A", "1 St", "+1", "X", True), ("b", "B", "2 St", None, "Y", False)], schema)
    new = spark.createDataFrame([("a", "A", "1 st", "+2", "x, Z"), ("b", "B", "2 Street", "+3", "Y"), ("c", "C", "3", "+4", None)], "handle string, name string, line1 string, phone string, brands string")
    assert {r.handle: r.change for r in upsert.classified(old, new).collect()} == {"a": "updated", "b": "updated", "c": "created"}
    got = {r.handle: r for r in upsert.upserted(old, new).collect()}
    assert got["a"].phone == "+1" and got["a"].is_premium and got["a"].brands == "X, Z" and got["c"].phone == "+4" and not got["c"].is_premium
    assert {r.handle: r.phone for r in upsert.upserted(old, new, manual=True).collect()} == {"a": "+2", "b": "+3", "c": "+4"}
    patched = upsert.patched(old, spark.createDataFrame([("a", "AA", "no")], "handle string, name string, secret string"), ("name",))
    assert sorted((r.handle, r.name) for r in patched.collect()) == [("a", "AA"), ("b", "B")] and patched.columns == old.columns
    done, log = upsert.backfilled(old, "name", F.lower("name"))
    assert log.count() == 2 and sorted(r.name for r in done.collect()) == ["a", "b"]
    assert [r.handle for r in upsert.deleted(old, new.where("handle = 'a'")).collect()] == ["b"]
    geocodes = spark.createDataFrame([("a", 11.0, 20.0)], "handle string, new_lat double, new_lon double")
    assert {r.handle: (r.decision, r.lat) for r in upsert.verified(table(spark, [place("a"), place("b")]), geocodes).collect()} == {"a": ("replace", 11.0), "b": ("no_geocode", 10.0)}
    assert [r.handle for r in upsert.cleaned(table(spark, [place("a"), place("b", premium=True), place("c", name="")])).collect()] == ["b"]


CANON = "Handle string, Name string, Status string, `Address Line 1` string, City string, Country string, Latitude string, Longitude string, Website string"


def test_validation(spark):
    rows = [("h1", "Ok", "active", "1 St", "Paris", "France", "48.1", "2.1", "https://x.com"), ("h2", "", "active", "1 St", "", "USA", "", "200", "x.com"), ("h3", "12345", "active", "a\\b\\", "Paris", "France", "x", "2.123456789", "bad url")]
    df = spark.createDataFrame(rows, CANON)
    got = Counter((r.row, r.severity[0], r.field, r.issue) for r in validation.exploded(df, "Handle").collect())
    assert not [k for k in got if k[0] == "h1"]
    assert got[("h2", "e", "Latitude", "empty")] == 2 and got[("h2", "e", "Name", "empty")] == 1 and got[("h2", "w", "Country", "country_not_canonical")] == 1 and got[("h2", "e", "Longitude", "out_of_range")] == 1 and got[("h2", "w", "Website", "normalized_url")] == 1
    assert {("h3", "w", "Name", "numeric_name"), ("h3", "w", "Address Line 1", "trailing_backslash"), ("h3", "e", "Latitude", "not_a_number"), ("h3", "w", "Longitude", "precision"), ("h3", "e", "Website", "invalid_url")} <= set(got)
    parity = validation.exploded(df.withColumn("Address Line 1", F.lit("")), "Handle", validation.Policy(import_parity=True))
    assert parity.where("issue = 'need_address_line_1_or_2'").count() == 3
    assert tuple(validation.passes(df).first()) == (3, 2, False)
    assert validation.header_issues(["Handle", "Handle", "Odd"], ("Phone",))[:2] == [("error", "duplicate:Handle"), ("error", "missing:Name")]
    fixed = {r.Handle: r for r in validation.fixed(df).collect()}
    assert fixed["h2"].Country == "United States" and fixed["h2"].Website == "https://x.com" and fixed["h3"]["Address Line 1"] == "a, b"
    kept, dropped = validation.split_by_coordinates(df)
    assert kept.count() == 1 and sorted(r.reason for r in dropped.collect()) == ["empty", "not_a_number"]
    assert "not_a_number" in sinks.validation_report(df).first().report
    issues = validation.exploded(df, "Handle").select(F.col("row"), "field", "issue")
    assert audits.grouped_issues(issues, 1).where("issue = 'empty'").first().more == 3


PAGES = {
    "json": '<script type="application/ld+json">{"stores": [{"name": "A", "address": "1 St", "geo": {}, "latitude": 1.5, "longitude": 2.5}, {"name": "B", "city": "X"}]}</script>',
    "attribute": '<div data-locations=\'[{"handle": 1, "name": "Old", "city": "X"}, {"handle": 1, "name": "New", "city": "Y"}]\'></div>',
    "elements": '<h3>A</h3><p>5 Main St</p><li data-lat="1.0" data-lng="2.0" data-name="A"></li>',
    "cards": "<h2>A</h2><p>5 Main St</p><p>75001 Paris</p><h2>B</h2><p>6 Side St</p><a href='https://maps.x/@1.25,2.5'>m</a>",
    "inline": 'x = {"name":"A","latitude":1.5,"longitude":2.5,"city":"Q"}',
    "none": "<p>nothing</p>",
}


def test_page_records(spark):
    got = {k: html.extracted(p) for k, p in PAGES.items()}
    assert [r["name"] for r in got["json"][1]] == ["A", "B"] and got["json"][1][0]["lat"] == "1.5"
    assert [r["name"] for r in got["attribute"][1]] == ["New"]
    assert got["elements"][1][0]["address"] == "5 Main St" and got["inline"][1][0]["city"] == "Q"
    assert [(r["name"], r["lat"]) for r in got["cards"][1]] == [("A", None), ("B", "1.25")] and got["none"] == (None, [])
    df = spark.createDataFrame(list(PAGES.items()), "page_id string, html string")
    assert Counter(r.page_id for r in html.page_records(df).collect()) == Counter({"json": 2, "attribute": 1, "elements": 1, "cards": 2, "inline": 1})
    page = '{"phone": "+1 2", "streetAddress": "5 Main"} <a href="mailto:a@b.co?x">'
    assert tuple(spark.createDataFrame([(page,)], "h string").select(*html.contacts(F.col("h"))).first()) == ("+1 2", "a@b.co", "5 Main")


def test_csv_round_trip(spark, tmp_path):
    rows = [("1", 'say "hi", you', "line\nbreak"), ("2", None, "x")]
    df = spark.createDataFrame(rows, "Handle string, Name string, ` Tags` string")
    sinks.write_csv(df, f"{tmp_path}/a", order="Handle", single=True)
    back = files.csv_rows(spark, f"{tmp_path}/a")
    assert back.columns == ["Handle", "Name", "Tags"]
    assert sorted((r.Handle, r.Name or None, r.Tags) for r in back.collect()) == [("1", 'say "hi", you', "line\nbreak"), ("2", None, "x")]
    (tmp_path / "b.csv").write_text("﻿Handle,Name\n1,a\n2,b\n")
    bom = files.csv_rows(spark, f"{tmp_path}/b.csv")
    assert bom.columns == ["Handle", "Name"] and files.line_count(spark, f"{tmp_path}/b.csv").first().n_rows == 2
    assert [r.row for r in files.numbered_rows(bom).orderBy("row").collect()] == [2, 3]
    assert not sinks.write_excluded(bom.limit(0), f"{tmp_path}/x")
    one = sinks.write_snapshot(bom, f"{tmp_path}/snap", 0)
    assert spark.read.parquet(one).count() == 2


def test_row_numbers_hold_however_partitions_are_joined(spark):
    """Counted without its wide column, a sorted table is cut into fewer partitions than when it is read whole."""
    own = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false"}
    before = {key: spark.conf.get(key, None) for key in own}
    try:
        for key, value in own.items():
            spark.conf.set(key, value)
        rows = spark.range(2000, numPartitions=4).select((1999 - F.col("id")).alias("at"), F.repeat(F.sha2(F.col("id").cast("string").cast("binary"), 512), F.lit(8)).alias("wide")).orderBy("at")
        found = files.numbered_rows(rows).select("row", "at", F.length("wide").alias("size")).collect()
        assert sorted((r.row, r.at, r.size) for r in found) == [(k + 2, k, 1024) for k in range(2000)]
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_answers(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"data": {"stores": [{"id": 1, "name": "x"}, {"id": 1, "name": "y"}, {"name": "z"}]}}')
    (tmp_path / "b.json").write_text('cb({"groups": [{"retailers": [{"id": 7}]}, {"retailers": [{"id": 8}, {"id": 9}]}]});')
    found = files.answer_records(files.answers(spark, str(tmp_path / "a.json")))
    assert found.count() == 3 and files.distinct_records(found).count() == 2
    assert files.answer_records(files.answers(spark, str(tmp_path / "b.json")), "groups", "retailers").count() == 3


def test_fan_out(spark):
    def fetch(url):
        key, page = url.split("?")[0], int(url.split("page=")[1])
        data = {"a": [[1, 2], [3, 4], [5]], "b": [[1, 2], [1, 2], [3, 4]], "c": []}[key]
        return json.dumps({"items": data[page - 1] if page <= len(data) else []})

    asked = spark.createDataFrame([("a?page={page}", "X"), ("b?page={page}", "Y"), ("c?page={page}", "Z")], "url string, country string")
    got = fanout.fetched(asked, fetch, fanout.Paging(size=2, items_key="items")).collect()
    assert Counter(r.country for r in got) == {"X": 3, "Y": 1}
    assert all(r.cut for r in fanout.fetched(asked.limit(1), fetch, fanout.Paging(size=2, max_pages=1)).collect())


def test_generated_tables(spark):
    assert grid(spark).count() == 9 * 18 and grid(spark, step=50).agg(F.max("north"), F.max("east")).first() == (90.0, 180.0)
    assert {r.prefix for r in prefixes(spark, 2, "abc").collect()} == {x + y for x in "abc" for y in "abc"}
    assert grid(spark, 0, 10, 0, 10, 10).select(viewport_url("http://x").alias("u")).first().u.startswith("http://x?south=0.0&north=10.0")


def test_streams(spark, sf_dir, tmp_path):
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    source = S.stream(spark, f"{sf_dir}/events.parquet*", schema).withColumn("ts", F.col("ts").cast("timestamp"))
    S.each_batch(S.distinct_sessions(source, "60 days"), "append", f"{tmp_path}/c", lambda df, n: df.write.mode("append").parquet(f"{tmp_path}/sessions")).awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/sessions").count() == spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct().count()
    kind = "handle string, name string, brands string, phone string, is_premium boolean"
    spark.createDataFrame([("a", "A", "X", "+1", True)], kind).write.parquet(f"{tmp_path}/t/v=00000000")
    spark.createDataFrame([("a", "B", "Y", "+2", None), ("b", "C", None, "+3", None)], kind).write.parquet(f"{tmp_path}/in")
    S.upsert_stream(S.stream(spark, f"{tmp_path}/in", kind), f"{tmp_path}/t", f"{tmp_path}/c2").awaitTermination()
    got = {r.handle: (r.name, r.brands, r.phone, r.is_premium) for r in spark.read.parquet(f"{tmp_path}/t/v=00000001").collect()}
    assert got == {"a": ("B", "X, Y", "+1", True), "b": ("C", None, "+3", False)}


def test_inference(spark):
    from tessera.operators import inference

    docs = [json.dumps({"store": {"name": f"n{k}", "geo": {"lat": 10.0 + k, "lng": 120.0 + k}}, "tel": "+41 22 123 45 67", "mail": "a@b.co", "city": "X" if k else None}) for k in range(4)] + ["broken"]
    found = inference.paths(spark.createDataFrame([(d,) for d in docs], "record string").limit(4))
    assert {r.path: r.share for r in found.collect()}["city"] == 0.75
    chosen = {r.field: r.path for r in inference.mapping(found).collect()}
    assert chosen == {"Name": "store.name", "Latitude": "store.geo.lat", "Longitude": "store.geo.lng", "City": "city", "Phone": "tel", "Email": "mail"}
    assert inference.confidence(inference.mapping(found)).first().level == "medium"


def test_small_reads(spark):
    from tessera.functions import text as X
    from tessera.operators import reads

    df = table(spark, [place("a"), place("b", line1="")]).withColumn("phone", F.lit("1"))
    assert tuple(reads.missing_data(df).first()) == (2, 1) and reads.autocomplete(df, "MAIN").count() == 1
    assert [r.name for r in reads.by_locale(spark.createDataFrame([("b",), ("A",), ("é",), ("E",)], "name string"), "name").collect()] == ["A", "b", "E", "é"]
    logs = spark.createDataFrame([("u", "e", None, 1), ("u", "w", 5, 2), ("u", "e", 2, 3), ("v", "e", 1, 1)], "upload_id string, log_type string, row_number int, created_at int")
    assert [r.row_number for r in reads.logs(logs, "u").collect()] == [2, 5, None] and reads.logs(logs, "u", "w").count() == 1
    assert tuple(reads.run_stats(logs, "log_type", ("e", "w"), "created_at").first()) == (4, 3, 1, 7)
    filled = joins.filled(spark.createDataFrame([("a", " "), ("b", "x")], "handle string, phone string"), spark.createDataFrame([("a", "1"), ("b", "2")], "handle string, phone string"), ("phone",))
    assert {r.handle: r.phone for r in filled.collect()} == {"a": "1", "b": "x"}
    t = spark.createDataFrame([("caf\\u00e9 \\x /u0041",), ("plain \\ text",)], "t string")
    assert [r[0] for r in t.select(X.decode_escapes(F.col("t"))).collect()] == ["café \\x A", "plain \\ text"]
    cells = spark.createDataFrame([('["a", "", "b", "c", "d"]',), ('{"value": "v"}',), (" x ",), (None,)], "t string")
    assert [r[0] for r in cells.select(X.cell_text(F.col("t"))).collect()] == ["a, b, c", "v", "x", ""]
    assert spark.createDataFrame([("Bahnhofstrasse Zürich",), ("?",)], "t string").select(X.by_rules(F.col("t"), {"strasse": "Germany", "z.rich": "Switzerland"})).first()[0] == "Germany"


def test_unique_handles_with_literal_suffixes(spark):
    """No handle is given twice: numbers that rows have as their own are passed over."""
    rows = [(1, "x"), (2, "x"), (3, "x"), (4, "x-1"), (5, "x-1-x"), (6, "x-1"), (7, "x-3"), (8, "x"), (9, None), (10, "y-007"), (11, "y-007")]
    out = dedupe.unique_handles(spark.createDataFrame(rows, "n int, h string"), "h", F.col("n"))
    got = {r.n: r.h for r in out.collect()}
    assert got == {1: "x", 2: "x-2", 3: "x-4", 4: "x-1", 5: "x-1-x", 6: "x-1-1", 7: "x-3", 8: "x-5", 9: None, 10: "y-007", 11: "y-007-1"}


def test_rows_without_a_country_agree(spark):
    rows = [list(place("a")), list(place("b", line1="10 Main Street")), list(place("c"))]
    rows[0][4] = rows[1][4] = None
    df = table(spark, [tuple(r) for r in rows])
    assert {r.handle: r.cluster for r in dedupe.clusters(df).collect()} == {"a": "a", "b": "a", "c": "c"}
    assert {r.handle for r in dedupe.merge_plans(df).collect()} == {"a", "b"}


def test_wider_than_equals_brute_force(spark):
    import math
    import random

    r = random.Random(4)
    rows = []
    for g in range(60):
        size = r.choice([1, 2, 5, 30])
        reach = r.choice([150, 240, 255, 270, 600]) / 111_320
        for k in range(size):
            turn, away = 2 * math.pi * r.random(), reach * r.choice([1, 1, r.random()])
            rows.append((f"g{g}", f"h{g}-{k}", 45 + away * math.sin(turn), 7 + away * math.cos(turn) / math.cos(math.radians(45))))

    def meters(p, q):
        a = math.sin(math.radians(q[2] - p[2]) / 2) ** 2 + math.cos(math.radians(p[2])) * math.cos(math.radians(q[2])) * math.sin(math.radians(q[3] - p[3]) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(a), math.sqrt(1 - a))

    want = {p[0] for p in rows for q in rows if p[0] == q[0] and meters(p, q) > 500}
    got = dedupe.wider_than(spark.createDataFrame(rows, "g string, handle string, lat double, lon double"), "g", 500.0).collect()
    assert sorted(x.g for x in got) == sorted(want) and 5 < len(want) < 60


def test_rows_nobody_sent_stay(spark):
    schema = "handle string, name string, brands string, is_premium boolean"
    old = spark.createDataFrame([("a", "A", "x y", True), ("b", "B", "z_stores", None)], schema)
    new = spark.createDataFrame([("b", "B", "q")], "handle string, name string, brands string")
    assert {r.handle: r.brands for r in upsert.upserted(old, new).collect()} == {"a": "x y", "b": "Z, Q"}


def test_batches_and_scoped_plans(spark):
    from tessera.operators import reads

    df = table(spark, [place(f"h{k:02d}", lat=k * 1.0) for k in range(25)])
    assert [sorted(r.handle for r in b.collect()) for b in reads.batches(df, 10)] == [[f"h{k:02d}" for k in range(a, min(25, a + 10))] for a in (0, 10, 20)]
    rows = [place("a"), place("b", line1="10 Main Street"), place("c", line1="1 Far Road", lat=10.001), place("d", city="Rome"), place("e", line1="1 Far Road", lat=60.0)]
    df = table(spark, rows)
    assert {r.handle for r in dedupe.expanded(df, df.where("handle = 'a'")).collect()} == {"a", "b", "c", "e"}
    assert {r.handle for r in dedupe.scoped_merge_plans(df, df.where("handle = 'a'")).collect()} == {r.handle for r in dedupe.scoped_merge_plans(df, df.where("handle = 'a'")).collect()} == {"a", "b"}


def test_work_tables_need_a_shared_folder(spark, tmp_path):
    from types import SimpleNamespace

    import pytest

    from tessera.plans import work

    class Conf:
        def get(self, name, default):
            return default

    with pytest.raises(ValueError):
        work.shared_dir(SimpleNamespace(conf=Conf(), sparkContext=SimpleNamespace(master="spark://x", applicationId="a")))
    tables = work.WorkTables(spark)
    df = tables.written(spark.range(3), "t")
    path = tables.paths[0].removeprefix("file://")
    assert df.count() == 3
    tables.drop()
    import os

    assert not os.path.exists(path)


def test_posted_requests(spark):
    requests = spark.createDataFrame([("u", '{"country":"FR","page":{page}}')], "url string, post string")

    def fetch(url, body):
        return json.dumps([{"id": 1}] if json.loads(body)["page"] == 1 else [])

    got = fanout.fetched(requests, fetch, body_col="post").collect()
    assert [(r.page, json.loads(r.body)) for r in got] == [(0, [{"id": 1}])]
