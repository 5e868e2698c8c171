"""Blocks of the matching rules give as few edges as rows."""

from datetime import date

from tessera.operators import dedupe

PLACE = "handle string, name string, line1 string, city string, country string, lat double, lon double, is_premium boolean, brands string, updated_at date, source_key string"


def test_default_geocode(spark):
    """400 places at one default geocode, 300 of one address and 200 of one source: n - 1 edges each, and one cluster each."""
    rows = [(f"g{n:03}", f"Name {n}", f"{n} Street {n}", f"C{n}", "France", 45.0, 4.0, False, "", date(2024, 1, 1), None) for n in range(400)]
    rows += [(f"a{n:03}", f"Name {n}", "12 Long Avenue", "Lyon", "France", None, None, False, "", date(2024, 1, 1), "") for n in range(300)]
    rows += [(f"s{n:03}", f"Name {n}", None, f"D{n}", "France", None, None, False, "", date(2024, 1, 1), "source") for n in range(200)]
    rows += [("x", "N", None, None, None, None, None, False, "", date(2024, 1, 1), None), ("y", "N", None, None, None, None, None, False, "", date(2024, 1, 1), "source")]
    places = spark.createDataFrame(rows, PLACE)
    counts = {r.rule: r["count"] for r in dedupe.match_edges(places).where("rule <> 'near'").groupBy("rule").count().collect()}
    assert counts == {"coordinates": 399, "address": 299, "source": 199}
    assert {r.handle: r.cluster for r in dedupe.clusters(places).collect()} == {r[0]: r[0] if r[0] in "xy" else f"{r[0][0]}000" for r in rows}
