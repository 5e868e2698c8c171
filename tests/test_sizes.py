"""Queries on customers whose keys only larger tables have, held against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_oracle import shown

from tessera.catalog import ORACLE_SQL, QUERIES


@pytest.fixture
def agree(spark, sf_dir, tmp_path):
    """Does a query on customers of these keys give its SQL's rows? They are returned."""

    def agree(name, keys):
        rows = spark.createDataFrame([(k, f"Customer {k}", k % 25, float(k % 100) * 100, "X") for k in keys], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
        rows.write.mode("overwrite").parquet(f"{tmp_path}/customer.parquet")
        spark.read.parquet(f"{sf_dir}/nation.parquet").write.mode("overwrite").parquet(f"{tmp_path}/nation.parquet")
        con = duckdb.connect()
        for t in ("customer", "nation"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
        df, want = QUERIES[name](spark, str(tmp_path)), con.sql(ORACLE_SQL[name])
        got = sorted(tuple(shown(r[c]) for c in sorted(df.columns)) for r in df.collect())
        assert got == sorted(tuple(shown(r[want.columns.index(c)]) for c in sorted(want.columns)) for r in want.fetchall())
        return got

    return agree


def test_phone_numbers_that_are_too_long(agree):
    """Case 0 takes every sixth key; its number has more than fifteen digits from six digits of the key on."""
    assert ("600000", "+41 22 600000000000 ext. 5") in agree("phone_international", [6, 99996, 100002, 600000, 4, 100000, 600004, 600000000 + 4])

def test_places_moved_by_verification(agree):
    """Addresses come again after 12 600 places: the later ones are far from the geocode and moved to it."""
    (got,) = agree("verify_and_merge", [*range(3, 60), *range(3 * 12601, 3 * 12606)])
    assert int(got[4]) > 0


def test_rows_are_spread_over_tasks(spark, tmp_path):
    """A file that a reader would give to one task is spread by its rows; small ones stay as they are."""
    from tessera.plans import places as P

    for n, tasks in ((10, 1), (2 * P.TASK_ROWS + 1, 3)):
        spark.range(n).coalesce(1).selectExpr("id AS c_custkey").write.parquet(f"{tmp_path}/{n}/customer.parquet")
        found = P.customers(spark, f"{tmp_path}/{n}")
        assert found.rdd.getNumPartitions() == tasks and found.distinct().count() == n


def test_records_are_made_once(spark):
    """Paths are counted with their records in one pass; the total of a second one would be broadcast."""
    from tessera.operators import inference

    rows = spark.createDataFrame([('{"a": 1, "b": {"c": "x"}}',), ('{"a": 2}',), ("broken",), (None,)], "record string")
    found = inference.paths(rows)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert {(r.path, r.n, r.share) for r in found.collect()} == {("a", 2, 0.5), ("b.c", 1, 0.25)}


def test_updates_at_a_crowded_point(spark):
    """20 000 updates beside 20 000 places of one point: compared row by row they'd be 400 million pairs."""
    from tessera.operators import upsert

    made = lambda mark, lat: spark.range(20000).select(F.concat(F.lit(mark), "id").alias("handle"), F.lit(lat).alias("lat"), F.lit(20.0).alias("lon"))
    places = made("p", 10.0).unionByName(made("q", 10.0001).limit(1))
    found = upsert.matched(made("u", 10.0003), places).agg(F.count(F.lit(1)), F.min("match"), F.max("match")).first()
    assert tuple(found) == (20000, "q0", "q0")


def test_work_tables_are_not_broadcast(spark):
    """Files of few MB may hold hundreds of MB of rows: what is joined with them is sorted, not sent through the driver."""
    from tessera.operators import components, joins, similarity
    from tessera.plans.work import written

    rows = written(spark.range(40).selectExpr("'x' AS g", "concat('street number ', id) AS k", "cast(id AS string) AS handle"), "rows")
    plans = [similarity.contained(rows, rows, ["g"], "k", 8), joins.block_stars(rows, ["g"]), components.components(rows.selectExpr("handle AS u", "'0' AS v"))]
    for df in plans:
        assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_touched_cells_hold_all_in_reach(spark):
    """Points within reach stand in a cell that the circle touches, at poles and the date line too."""
    import math
    import random

    from tessera.functions import geo

    r, rows = random.Random(5), []
    for n in range(4000):
        lat, lon = r.choice([(90 - r.random() * 0.05, r.uniform(-180, 180)), (-90 + r.random() * 0.2, r.uniform(-180, 180)), (r.uniform(-89, 89), r.choice([-180.0, 180.0, 179.9999, -179.9999])), (r.uniform(-89.9, 89.9), r.uniform(-180, 180))])
        east = 300 / 111195 / max(1e-6, math.cos(math.radians(lat)))
        y, x = lat + r.uniform(-1, 1) * 300 / 111195, lon + r.uniform(-1, 1) * min(east, 180)
        y, x = (180 - y, x + 180) if y > 90 else (-180 - y, x + 180) if y < -90 else (y, x)
        rows.append((n, lat, lon, y, (x + 180) % 360 - 180))
    df = spark.createDataFrame(rows, "n int, lat double, lon double, y double, x double").where(geo.haversine(F.col("lat"), F.col("lon"), F.col("y"), F.col("x")) <= 300)
    assert df.count() > 1500
    for width in (1500, 5000):
        row, col = geo.cells(F.col("y"), F.col("x"), width)
        touched = geo.touched_cells(F.col("lat"), F.col("lon"), 300, width)
        own = F.struct(row.cast("long").alias("row"), col.alias("col"))
        assert df.where(~F.array_contains(touched, own)).count() == 0
        assert df.agg(F.avg(F.size(touched))).first()[0] < 100


def test_near_pairs_of_a_crowded_point(agree):
    """A point's places hang on the least of them: n - 1 pairs, and one for each pair of points."""
    crowd = [3 * g + v for g in range(7, 25 * 40, 25) for v in range(3)]
    got = agree("near_pairs", [*crowd, 3, 4, 5])
    assert len(got) == len(crowd) - 1 + 3


def test_near_pairs_of_all_rows(agree):
    """Each two places of a point are a pair, not only its least place with the others."""
    crowd = [3 * g + v for g in range(7, 25 * 10, 25) for v in range(3)]
    got = agree("near_pairs", [*crowd, 3, 4, 5])
    assert len(got) == len(crowd) * (len(crowd) - 1) // 2 + 3


def test_rows_of_crowded_points_meet_in_blocks(spark, monkeypatch):
    """However few rows a block has and pairs a task gives, the pairs are those of the plain join, with its metres."""
    from tessera.operators import joins

    points = [(10.0, 20.0, 23), (10.0003, 20.0, 11), (10.0009, 20.0, 5), (-0.0, 0.5, 2), (0.0, 0.5, 2), (50.0, 179.9999, 3), (50.0, -179.9999, 1), (0.0, 0.0, 4)]
    rows = [(f"h{7 * n % 53:02d}", lat, lon) for n, (lat, lon) in enumerate((lat, lon) for lat, lon, many in points for _ in range(many))] + [("h00", 10.0003, 20.0), (None, 10.0, 20.0)]
    df = spark.createDataFrame(rows, "handle string, lat double, lon double").repartition(3)
    want = sorted(map(tuple, joins.near_pairs(df, 150).select("u", "v", F.round("meters", 2)).collect()))
    for block, pairs, tasks in ((1 << 8, 1 << 25, 1), (4, 500, None), (1, 100, None)):
        monkeypatch.setattr(joins, "BLOCK_ROWS", block)
        monkeypatch.setattr(joins, "TASK_PAIRS", pairs)
        got = joins.near_rows(df, 150, 2)
        assert sorted(map(tuple, got.collect())) == want and len(want) > 600
        assert (got.rdd.getNumPartitions() == 1) == (tasks == 1)


def test_record_keys_take_few_columns(spark, sf_dir):
    """Only what the key and the order need is grouped and sorted."""
    plan = QUERIES["record_keys"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "website" not in plan and "brands" not in plan


def test_a_brand_is_shown_once(spark):
    """The rule of a name is in a plan once, not for every place that uses its result, also where lists are merged."""
    from tessera.functions import brands as B

    rows = spark.createDataFrame([("a_stores,<b>u_boat</b> ,uboat, 88 Wayne Watches", "uboat_retailers,12 Rue du Lac,, C"), (None, " "), ("--", "A ET B")], "a string, b string")
    df = rows.select(B.normalized_brands(F.col("a")).alias("one"), B.merged_lists(B.normalized_brands(F.col("a")), B.normalized_brands(F.col("b"))).alias("both"))
    assert [tuple(r) for r in df.collect()] == [("A, U BOAT, U-BOAT, 88 WAYNE WATCHES", "A, U BOAT, U-BOAT, 88 WAYNE WATCHES, C"), (None, None), (None, "A ET B")]
    assert df._jdf.queryExecution().analyzed().toString().count("_stores|") <= 3


def test_buckets_and_files_follow_the_rows(spark, sf_dir, monkeypatch):
    """Of a larger table, a bucket and a file of changes hold no more rows; there are three batches all the same."""
    from tessera.plans import queries
    from tessera.sources import buckets

    def ran(rows):
        monkeypatch.setattr(queries, "BUCKET_ROWS", rows, raising=False)
        df = QUERIES["bucketed_upserts"](spark, sf_dir)
        root = df.inputFiles()[0].split("/data/")[0]
        files = spark.read.parquet(root.rsplit("/", 1)[0] + "/changes").inputFiles()
        return df, buckets.versions(spark, root), buckets.manifest(spark, root).n_buckets, len(files)

    n = spark.read.parquet(f"{sf_dir}/customer.parquet").count()
    (small, *of_small), (large, *of_large) = ran(n), ran(n // 50)
    assert of_small == [[0, 1, 2, 3], 16, 3] and of_large == [[0, 1, 2, 3], 50, 51]
    assert sorted(map(tuple, small.collect()), key=str) == sorted(map(tuple, large.collect()), key=str)
