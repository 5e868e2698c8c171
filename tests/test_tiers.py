"""The first match tier sees every place at the same rounded coordinates."""

from datetime import date

from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import joins

PLACE = "handle string, name string, line1 string, city string, country string, lat double, lon double, is_premium boolean, brands string, updated_at date"


def place(handle, lat, country="France"):
    return (handle, "A", "1 Main Street", "Lyon", country, lat, 4.0, False, "", date(2024, 1, 1))


def test_nearest_of_many(spark):
    """60 places about 0.4 m away come first by handle; the nearest one's handle is the last."""
    places = [place(f"p{n:02}", 45.000004) for n in range(60)] + [place("p99", 45.0)]
    asked = [place("q1", 45.0), place("q2", 45.000004), place("q3", 45.0, "Spain")]
    got = {r.handle: (r.match, r.tier, r.meters < 0.01) for r in joins.probes(spark.createDataFrame(asked, PLACE), spark.createDataFrame(places, PLACE)).collect()}
    assert got == {"q1": ("p99", 1, True), "q2": ("p00", 1, True)}


def test_addresses_found_many_times(spark):
    """One address key 3000 times over the world: each row meets the ones around it, not all of its town's; a latitude
    beyond the pole counts as distances take it."""
    far = [(f"f{n:04}", f"Name {n}", "12 Long Avenue", "Lyon", "France", -70 + n * 0.04, (n * 7 % 350) - 175.0, False, "", date(2024, 1, 1)) for n in range(3000)]
    moved = lambda rows, line, by: [("q" + r[0], r[1], line, *r[3:5], r[5] + by, *r[6:]) for r in rows]
    asked = moved(far[::2], "12 Long Ave", 0.0018) + moved(far[1::2], "12 Long Avenue Annex", 0.0009)
    edge = [("e1", "A", "9 Pole Road", "Pole", "France", 89.9999, -170.0, False, "", date(2024, 1, 1)), ("e2", "A", "8 Line Road", "Line", "France", 10.0, 179.9999, False, "", date(2024, 1, 1))]
    asked += [("qe1", "B", "9 Pole Road", "Pole", "France", 90.0005, 10.0, False, "", date(2024, 1, 1)), ("qe2", "B", "8 Line Road", "Line", "France", 10.001, -179.9999, False, "", date(2024, 1, 1))]
    out = joins.probes(spark.createDataFrame(asked, PLACE), spark.createDataFrame(far + edge, PLACE))
    got = {r.handle: (r.match, r.tier) for r in out.collect()}
    assert got == {"q" + r[0]: (r[0], 3 if n % 2 else 2) for n, r in enumerate(far)} | {"qe1": ("e1", 2), "qe2": ("e2", 2)}


def test_address_pairs_meet_in_tiles(spark):
    """Rows of one town's address key that lie far apart don't share a tile, so a join by tile doesn't compare them."""
    rows = spark.createDataFrame([(f"h{n:03}", 10 + n * 0.2, 20.0) for n in range(300)], "handle string, lat double, lon double")
    met = joins._tiles_around(rows, 300).alias("a").join(joins._own_tile(rows).alias("b"), ["_row", "_col"])
    assert met.count() == 300 and met.where("a.handle = b.handle").count() == 300


def test_stems_are_made_once(spark):
    """The pattern of organisation suffixes stands once for a name's keys and twice for a pair, not once for each use."""
    df = spark.createDataFrame([("Omega Ltd", "Omega")], "a string, b string")
    times = lambda column: df.select(column.alias("k"))._jdf.queryExecution().analyzed().toString().count(X.ORG_SUFFIX)
    assert times(X.name_keys(F.col("a"), True)) == 1 and times(X.names_similar(F.col("a"), F.col("b"))) == 2
