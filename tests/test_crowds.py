"""Cells that split, rings, inverted indexes and the cascade: equal to brute force, and no square of a crowd."""

import itertools
import random
import time
from datetime import date

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.functions.country import country_key
from tessera.operators import crowds, dedupe, joins, similarity
from tessera.operators.components import components

PLACE = "handle string, name string, line1 string, city string, country string, lat double, lon double, is_premium boolean, brands string, updated_at date"


def messy(n, seed):
    """Places in a few crowded streets: names and lines that are equal, similar, or hold one another."""
    r = random.Random(seed)
    names = ["Rolex Boutique Geneva", "Rolex Boutique Geneva Inc", "Rolex Bou", "Rolex Boutique Paris", "12345678 Watches", "12345678 Watch Shop", "Omega", "Omega Ltd", "", "Inc", None, "Tudor Store Lyon Centre", "Tudor Store Lille", "東京"]
    lines = ["12 Main Street", "12 Main St", "12 Main Street Annex", "12 Main Street, Suite 4", "114 Rue", "114 Rue Longue", "114 Rue Longue Prolongee", "9", "", None, "12-14 Main Street", "112 Main Street", "大通 12"]
    out = []
    for k in range(n):
        lat, lon = 45.0 + r.choice([0, 0, 0.001, 0.0012, 0.0025, 0.004]) + r.choice([0, r.random() * 0.002]), r.choice([4.0, 179.9999, -179.9999]) + r.choice([0, 0.0003])
        if r.random() < 0.05:
            lat, lon = r.choice([(None, 1.0), (0.0, 0.0), (89.9995, 10.0 + k), (91.0, 1.0)])
        out.append((f"h{k:04}", r.choice(names), r.choice(lines), r.choice(["Lyon", "LYON", "Paris", None]), r.choice(["France", "fr", None]), lat, lon, False, "", date(2024, 1, 1)))
    return out


def parts(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def pairs(df):
    return [(r.u, r.v) for r in df.select("u", "v").collect()]


@pytest.mark.parametrize("color,limit", [(None, 1), (None, 1 << 14), ("tint", 1), ("tint", 40)])
def test_near_links_have_the_components_of_all_pairs(spark, color, limit):
    r = random.Random(limit)
    rows = []
    for k in range(400):
        lat, lon = r.choice([10.0, 0.0005, 89.999, -45.0]) + r.choice([0, 1e-6, r.random() * 0.004]), r.choice([20.0, 180.0, -180.0]) + (r.random() * 0.004 if k % 3 else 0)
        rows.append((f"n{k:03}", min(lat, 90.0), max(-180.0, min(lon, 180.0)), f"g{k % 4}", f"t{r.choice([0, 0, 0, 1])}"))
    df = spark.createDataFrame(rows, "handle string, lat double, lon double, g string, tint string")
    test = F.col("a.tint") != F.col("b.tint") if color else None
    want = parts(pairs(joins.near_pairs(df, 150, test, ("g",))), [x[0] for x in rows])
    assert parts(pairs(crowds.near_links(df, ["g"], 150, color, limit)), [x[0] for x in rows]) == want


def test_edges_equal_brute_force(spark):
    rows = messy(260, 2)
    df = spark.createDataFrame(rows, PLACE)
    keyed = dedupe.with_keys(df)
    a, b = lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")
    alike = (a("k_name") == b("k_name")) | X.names_similar(a("k_name"), b("k_name"))
    aligned = X.keys_align(a("line1"), b("line1"), a("k_line"), b("k_line"), a("k_addr"), b("k_addr"))
    plain = joins.near_pairs(keyed, 300, aligned & ((a("k_city") == b("k_city")) | alike), ("k_country",))
    edges = dedupe.match_edges(df)
    others = edges.where("rule <> 'near'").cache()
    nodes = [x[0] for x in rows]
    assert parts(pairs(edges), nodes) == parts(pairs(others) + pairs(plain), nodes)
    assert {(r.handle, r.cluster) for r in dedupe.clusters(df).collect()} == set(parts(pairs(edges), nodes).items())


def test_variant_links_equal_brute_force(spark):
    rows = messy(260, 3)
    df = dedupe.with_keys(spark.createDataFrame(rows, PLACE))
    a, b = lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")
    test = (a("k_addr") != b("k_addr")) & X.names_similar(a("name"), b("name")) & X.share_number(a("line1"), b("line1"))
    want = pairs(joins.near_pairs(df, 150, test, ("k_country",)))
    nodes = [x[0] for x in rows]
    assert want and parts(pairs(dedupe._variant_links(df, 150)), nodes) == parts(want, nodes)


def plain_probes(asked, known):
    """All tiers for all pairs; the least wins."""
    keyed = lambda df: df.withColumns({"k_addr": X.address_key(F.col("line1")), "k_city": X.alnum(F.col("city")), "k_country": country_key(F.col("country")), "k_name": X.alnum(F.col("name")), "lat5": F.round("lat", 5), "lon5": F.round("lon", 5)})
    a, b = lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")
    from tessera.functions import geo

    meters = joins.meters_between()
    usable = ~geo.unusable(a("lat"), a("lon")) & ~geo.unusable(b("lat"), b("lon"))
    same = (a("k_addr") == b("k_addr")) & (a("k_city") == b("k_city")) & (F.length("a.k_addr") >= 6) & (meters <= 300)
    extends = (a("k_city") == b("k_city")) & X.key_contains(a("k_addr"), b("k_addr")) & X.names_similar(a("name"), b("name")) & (meters <= 150)
    tier = F.when((a("lat5") == b("lat5")) & (a("lon5") == b("lon5")), 1).when(same, 2).when(extends, 3).when(usable & (a("k_name") == b("k_name")) & (meters <= 300), 4).when(usable & X.names_similar(a("name"), b("name")) & (meters <= 150), 5).when(usable & (meters <= 75), 6)
    met = keyed(asked).alias("a").join(keyed(known).alias("b"), a("k_country") == b("k_country")).select(a("handle").alias("handle"), b("handle").alias("match"), tier.alias("tier"), meters.alias("meters")).where("tier IS NOT NULL")
    return met.groupBy("handle").agg(F.min(F.struct("tier", "meters", "match")).alias("m")).select("handle", "m.match", "m.tier", "m.meters")


def test_cascade_equals_brute_force(spark):
    asked, known = (spark.createDataFrame(messy(150, seed), PLACE) for seed in (5, 6))
    found = lambda df: {r.handle: (r.match, r.tier, round(r.meters, 6)) for r in df.collect()}
    got, want = found(joins.probes(asked, known)), found(plain_probes(asked, known))
    assert got == want and {t for _, t, _ in want.values()} >= {1, 2, 4, 6}


def test_similar_names_share_a_key(spark):
    r = random.Random(8)
    names = [n + s for n in ("abcdefgh", "abcdefghi", "abcdefghij", "12345678", "123456789", "abc", "abcdefghijklmnopqrst") for s in ("", "x", "xyz", "inc", "yyyyyyyyyyyyyy")] + ["".join(r.choice("ab") for _ in range(r.randint(7, 12))) for _ in range(60)]
    df = spark.createDataFrame([(n,) for n in sorted(set(names))], "n string")
    met = df.select(F.col("n").alias("x")).crossJoin(df.select(F.col("n").alias("y"))).where(X.names_similar(F.col("x"), F.col("y")))
    shared = F.arrays_overlap(X.name_keys(F.col("x"), True), X.name_keys(F.col("y"), False))
    assert met.count() > len(names) and met.where(~shared).count() == 0


def test_contained_and_alike_equal_brute_force(spark):
    r = random.Random(9)
    keys = ["".join(r.choice("abc") for _ in range(r.randint(0, 14))) for _ in range(160)] + ["abcabcabcabc", "bcabcabc", "", "a"]
    rows = [(f"h{k:03}", f"c{k % 2}", key) for k, key in enumerate(keys)]
    df = spark.createDataFrame(rows, "handle string, city string, key string")
    want = [(len(x[2]) + len(y[2]), x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] == y[1] and x[2] != y[2] and (x[2] in y[2] or y[2] in x[2])]
    for top in (7, 10_000):
        assert pairs(similarity.contained_top(df, ["city"], "key", top)) == [w[1:] for w in sorted(want, key=lambda w: (-w[0], w[1:]))[:top]]

    names = [" ".join(r.choice(["rolex", "rolexx", "omega", "omegas", "tudor", "bern", "berne"]) for _ in range(r.randint(1, 3))) for _ in range(120)] + [None, ""]
    rows = [(f"h{k:03}", f"c{k % 3}", name) for k, name in enumerate(names)]
    df = spark.createDataFrame(rows, "handle string, city string, name string")
    grams = {r.handle: frozenset(r.t) for r in df.select("handle", X.trigrams(F.col("name")).alias("t")).collect()}
    jaccard = lambda x, y: len(x & y) / len(x | y)
    want = [(jaccard(grams[x[0]], grams[y[0]]), x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] == y[1] and grams[x[0]] and grams[y[0]]]
    for top, least in ((5, 0.45), (100_000, 0.45), (100_000, 0.3)):
        got = [(r.u, r.v, round(r.similarity, 9)) for r in similarity.similar_top(df, F.col("name"), ["city"], least, top).collect()]
        assert got == [(u, v, round(s, 9)) for s, u, v in sorted((w for w in want if w[0] > least), key=lambda w: (-w[0], w[1:]))[:top]]


def test_a_crowd_costs_no_square(spark):
    """20 000 places at one point, and as many within a street, with a few names and lines: linked and matched at once."""
    r = random.Random(1)
    spots = [(f"p{k:05}", f"Maison Nr{k % 500} Watches", f"{10 + k % 50} Main Street", "Lyon", "France", 45.0, 4.0, False, "", date(2024, 1, 1)) for k in range(20_000)]
    street = [(f"s{k:05}", "Rolex Boutique", f"77 Road Number {k % 300}", "Lyon", "France", 48.0 + r.random() * 0.002, 2.0 + r.random() * 0.002, False, "", date(2024, 1, 1)) for k in range(20_000)]
    df = spark.createDataFrame(spots + street, PLACE).repartition(8).cache()
    df.count()
    began = time.time()
    links = crowds.near_links(dedupe.with_keys(df), ["k_country", "k_name"], 150)
    assert links.count() < 3 * df.count()
    assert components(links).where("node LIKE 's%'").select("component").distinct().count() == 1
    asked = df.withColumn("handle", F.concat(F.lit("q"), "handle")).withColumn("lat", F.col("lat") + 2e-5)
    assert joins.probes(asked, df).count() == 40_000
    assert time.time() - began < 120
