"""Registry, overlay and snapshot joins, blocked pair joins, and probes of places against a table of places."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions import text as X
from ..functions.country import country_key
from ..plans.work import WorkTables, by_key, written
from .crowds import nearest_within
from .similarity import contained


def with_registry(places: DataFrame, registry: DataFrame, key: str, flag: str) -> DataFrame:
    """Every place with a flag: is its key in the registry? (Spark chooses how to join.)"""
    known = registry.select(key).distinct().withColumn(flag, F.lit(True))
    return places.join(known, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def reconciled(places: DataFrame, registry: DataFrame, key: str, flag: str) -> DataFrame:
    """Rows whose flag differs from the registry, with the flag set right."""
    return with_registry(places.withColumnRenamed(flag, "_old"), registry, key, flag).where(F.col("_old") != F.col(flag)).drop("_old")


def missing_from(places: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return places.join(registry.select(key), key, "left_anti")


def present_in(places: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    return places.join(registry.select(key), key, "left_semi")


def overlay(base: DataFrame, excluded: DataFrame, top: DataFrame, key: str, value: str) -> DataFrame:
    """The base without excluded keys, overlaid with the top's values."""
    left, right = base.join(excluded.select(key), key, "left_anti"), top.select(key, F.col(value).alias("_top"))
    return left.join(right, key, "full").select(key, F.coalesce("_top", value).alias(value))


def snapshot_diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, change): added, removed or changed rows."""
    b = before.select(key, F.struct(*columns).alias("_b"))
    a = after.select(key, F.struct(*columns).alias("_a"))
    change = F.when(F.col("_b").isNull(), "added").when(F.col("_a").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return b.join(a, key, "full").select(key, change.alias("change")).where("change IS NOT NULL")


def with_children(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, columns: list[str]) -> DataFrame:
    """Every parent with the number of its children and their rows, sorted.

    The rows of a parent are one value, so this is for parents with few; where one may have very many, count them and read
    the children by key.
    """
    rows = children.groupBy(F.col(child_key).alias(parent_key)).agg(F.count(F.lit(1)).cast("long").alias("n_children"), F.sort_array(F.collect_list(F.struct(*columns))).alias("children"))
    return parents.join(rows, parent_key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))


def block_pairs(df: DataFrame, by: list[str | Column], test: Column, distance: Column | None = None) -> DataFrame:
    """Pairs a.handle < b.handle of rows that agree on the block's keys and pass ``test`` (columns of a and b)."""
    keyed = df.select("*", *[(F.col(c) if isinstance(c, str) else c).alias(f"_k{n}") for n, c in enumerate(by)])
    keys = [f"_k{n}" for n in range(len(by))]
    a, b = keyed.alias("a"), keyed.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.handle") < F.col("b.handle")]
    out = a.join(b, on).where(test)
    extra = [distance.alias("meters")] if distance is not None else []
    return out.select(F.col("a.handle").alias("u"), F.col("b.handle").alias("v"), *extra)


def block_stars(df: DataFrame, by: list[str]) -> DataFrame:
    """Edges (u, v) from each block's least handle u to its other rows: as few as rows, with the components of all its pairs."""
    keyed = df.select("handle", *by).dropna(subset=by)
    least = keyed.groupBy(*by).agg(F.min("handle").alias("u"))
    return keyed.join(by_key(least), by).where("u < handle").select("u", F.col("handle").alias("v"))


def first_of(df: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each key in order. Each task keeps its own first ones before they meet, so that a key which
    many rows have isn't gathered in one place."""
    local = Window.partitionBy(*keys, "_part").orderBy(*order)
    some = df.withColumn("_part", F.spark_partition_id()).withColumn("_r", F.row_number().over(local)).where(F.col("_r") <= k).drop("_part")
    return some.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= k).drop("_r")


def meters_between(a: str = "a", b: str = "b") -> Column:
    return geo.haversine(F.col(f"{a}.lat"), F.col(f"{a}.lon"), F.col(f"{b}.lat"), F.col(f"{b}.lon"))


def near_pairs(df: DataFrame, meters: float, test: Column | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs within ``meters``: one side stands in its grid cell, the other in all cells its circle can touch."""
    usable = df.where(~geo.unusable(F.col("lat"), F.col("lon")))
    row, col = geo.cells(F.col("lat"), F.col("lon"), meters)
    own = usable.withColumns({"_row": row.cast("long"), "_col": col}).alias("a")
    around = usable.withColumn("_cell", F.explode(geo.near_cells(F.col("lat"), F.col("lon"), meters))).withColumns({"_row": F.col("_cell.row"), "_col": F.col("_cell.col")}).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("_row", "_col", *by)] + [F.col("a.handle") < F.col("b.handle")]
    out = own.join(by_key(around), on).where(meters_between() <= meters)
    return (out.where(test) if test is not None else out).select(F.col("a.handle").alias("u"), F.col("b.handle").alias("v"), meters_between().alias("meters"))


#: Rows of one point that are paired with other rows as one block, and pairs that a task gives.
BLOCK_ROWS, TASK_PAIRS = 1 << 8, 1 << 25


def near_rows(df: DataFrame, meters: float, digits: int) -> DataFrame:
    """(u, v, meters), u < v: the pairs of :func:`near_pairs` without a test, however many rows stand at one point.

    Points are compared, and metres rounded to ``digits``, once for all their rows. A point's rows stand in blocks, and every
    two blocks that meet, of points near one another or of one point, give the pairs of their rows. So a crowded point's
    pairs, which are many more than its rows, are spread over as many tasks as they need, and a task holds few blocks at a time.
    """
    usable = df.where(~geo.unusable(F.col("lat"), F.col("lon"))).select("handle", "lat", "lon")
    points = usable.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).withColumns({"point": F.concat_ws("|", "lat", "lon"), "blocks": F.ceil(F.col("n") / BLOCK_ROWS)})
    block = lambda point, number: F.concat_ws("|", point, number)
    rows = written(usable.join(by_key(points), ["lat", "lon"]).select("handle", block("point", F.pmod(F.xxhash64("handle"), F.col("blocks"))).alias("block")), "rows")

    point = F.struct("point", "n", "blocks")
    apart = near_pairs(points.select(point.alias("handle"), "lat", "lon"), meters).withColumn("one", F.lit(False))
    together = points.where("n > 1").select(point.alias("u"), point.alias("v"), F.lit(0.0).alias("meters"), F.lit(True).alias("one"))
    numbers = lambda first, side: F.explode(F.sequence(first, F.col(f"{side}.blocks") - 1))
    met = apart.unionByName(together).withColumn("i", numbers(F.lit(0).cast("long"), "u")).withColumn("j", numbers(F.when(F.col("one"), F.col("i")).otherwise(0), "v"))
    size = lambda side: F.col(f"{side}.n") / F.col(f"{side}.blocks")
    met = written(met.select(block("u.point", "i").alias("a"), block("v.point", "j").alias("block"), F.round("meters", digits).alias("meters"), (size("u") * size("v")).alias("pairs")), "met")

    pairs = met.agg(F.coalesce(F.sum(F.col("pairs") + BLOCK_ROWS), F.lit(0.0))).first()[0]
    tasks = int(pairs + BLOCK_ROWS * rows.count()) // TASK_PAIRS + 1
    held = rows.groupBy(F.col("block").alias("a")).agg(F.collect_list("handle").alias("p"))
    asked = met.join(by_key(held), "a").repartition(tasks, "block").select("block", (F.col("a") == F.col("block")).alias("own"), "meters", F.explode("p").alias("p"))
    out = asked.join(rows.hint("shuffle_hash"), "block").withColumnRenamed("handle", "q")
    return out.where(F.when(F.col("own"), F.col("p") < F.col("q")).otherwise(F.col("p") != F.col("q"))).select(F.least("p", "q").alias("u"), F.greatest("p", "q").alias("v"), "meters")


def _probe_keys(df: DataFrame) -> DataFrame:
    keys = {"k_addr": X.address_key(F.col("line1")), "k_city": X.alnum(F.col("city")), "k_country": country_key(F.col("country")), "k_name": X.alnum(F.col("name")), "lat5": F.round("lat", 5), "lon5": F.round("lon", 5)}
    return df.select("handle", "lat", "lon", *[c.alias(n) for n, c in keys.items()])


#: Metres that a tile is wide in which equal address keys, or those that hold others, are looked for.
TILE = 5000


def _own_tile(df: DataFrame) -> DataFrame:
    """The rows with their tile; latitudes beyond a pole count as distances take them, on the other side of it."""
    lat, lon = _on_globe()
    row, col = geo.cells(lat, lon, TILE)
    return df.withColumns({"_row": row.cast("long"), "_col": col})


def _tiles_around(df: DataFrame, meters: float) -> DataFrame:
    """The rows, each in all tiles (mostly one) that its circle touches."""
    return df.withColumn("_tile", F.explode(geo.touched_cells(*_on_globe(), meters, TILE))).select("*", F.col("_tile.row").alias("_row"), F.col("_tile.col").alias("_col")).drop("_tile")


def _on_globe() -> tuple[Column, Column]:
    lat, lon = F.col("lat"), F.col("lon")
    inside = lat.between(-90, 90)
    return F.when(inside, lat).otherwise(F.degrees(F.asin(F.sin(F.radians(lat))))), F.when(inside | (F.cos(F.radians(lat)) >= 0), lon).otherwise(lon + 180)


def probes(incoming: DataFrame, places: DataFrame) -> DataFrame:
    """(handle, match, tier, meters): the place that each incoming row is taken to be, by the first tier that finds one.

    Tiers: 1 the same rounded coordinates and country; 2 the same address key and city (300 m); 3 one address key extends
    the other, similar name and the same city (150 m); 4 the same name within 300 m, 5 a similar name within 150 m, 6
    anything within 75 m. Within a tier the nearest wins, then the smaller handle. Rows without a country agree with one
    another.

    Each step sees only the rows that none before has found, and distinct points (each with its least handle) instead of
    places, so many places at one point cost as much as one. Every step is an equality join: of rounded points (tier 1), of
    address keys (2) and of an address key's rarest gram (3) within tiles of a few kilometres, since a town's addresses may
    be found many times over, of cells with what similar names share (5), and of cells
    in growing rings, with the name (4) or alone (6), so that where points crowd the nearest ring ends the search.
    """
    work = WorkTables(incoming.sparkSession)
    asked, known = work.written(_probe_keys(incoming), "asked"), work.written(_probe_keys(places), "known")
    a, b = (lambda n: F.col(f"a.{n}")), (lambda n: F.col(f"b.{n}"))
    meters, similar = meters_between(), X.names_similar(a("k_name"), b("k_name"))
    points = lambda *keys: known.groupBy(*keys, "lat", "lon").agg(F.min("handle").alias("handle"))

    def out(joined: DataFrame, tier: int | Column) -> DataFrame:
        return joined.select(a("handle").alias("handle"), b("handle").alias("match"), (F.lit(tier) if isinstance(tier, int) else tier).alias("tier"), meters.alias("meters"))

    def equal(rest: DataFrame, known: DataFrame, keys: list[str], tier: int, *test: Column) -> DataFrame:
        return out(rest.alias("a").join(by_key(known).alias("b"), [a(k) == b(k) for k in keys] + [*test]), tier)

    def same(rest: DataFrame) -> DataFrame:
        point, address = ["lat5", "lon5", "k_country"], ["k_addr", "k_city", "k_country"]
        addressed = _tiles_around(rest.where(F.length("k_addr") >= 6), 300)
        return equal(rest, points(*point), point, 1).unionByName(equal(addressed, _own_tile(points(*address)), [*address, "_row", "_col"], 2, meters <= 300))

    def extends(rest: DataFrame) -> DataFrame:
        keys = ["k_country", "k_city", "k_addr", "k_name", "lat", "lon"]
        rows = rest.select("handle", *keys, F.lit(0).alias("side")).unionByName(points(*keys[:4]).select("handle", *keys, F.lit(1).alias("side")))
        test = (meters <= 150) & X.key_contains(a("k_addr"), b("k_addr")) & similar
        short = _tiles_around(rows.withColumn("side", 1 - F.col("side")), 150)
        found = contained(short, _own_tile(rows), ["side", "k_country", "k_city", "_row", "_col"], "k_addr", X.MIN_CONTAINED, test)
        first = a("side") == 1  # the shorter key is the incoming row's
        return found.select(F.when(first, a("handle")).otherwise(b("handle")).alias("handle"), F.when(first, b("handle")).otherwise(a("handle")).alias("match"), F.lit(3).alias("tier"), meters.alias("meters"))

    def similarly_named(rest: DataFrame) -> DataFrame:
        row, cell = geo.cells(F.col("lat"), F.col("lon"), 150)
        own = points("k_country", "k_name").where(~geo.unusable(F.col("lat"), F.col("lon"))).withColumns({"_row": row.cast("long"), "_col": cell, "_key": F.explode(X.name_keys(F.col("k_name"), False))}).alias("b")
        around = rest.where(~geo.unusable(F.col("lat"), F.col("lon"))).withColumn("_key", F.explode(X.name_keys(F.col("k_name"), True)))
        around = around.withColumn("_cell", F.explode(geo.near_cells(F.col("lat"), F.col("lon"), 150))).withColumns({"_row": F.col("_cell.row"), "_col": F.col("_cell.col")}).alias("a")
        return out(around.join(by_key(own), [a(k) == b(k) for k in ("_row", "_col", "k_country", "_key")] + [meters <= 150, similar]), 5)

    in_rings = lambda tier, keys, reach: [lambda rest, ring=ring: ring(rest).withColumn("tier", F.lit(tier)) for ring in nearest_within(known, keys, reach)]
    found: list[DataFrame] = []
    for step in (same, extends, *in_rings(4, ["k_country", "k_name"], 300), similarly_named, *in_rings(6, ["k_country"], 75)):
        rest = asked.join(by_key(reduce(DataFrame.unionByName, found).select("handle")), "handle", "left_anti") if found else asked
        best = step(rest).groupBy("handle").agg(F.min(F.struct("tier", "meters", "match")).alias("m"))
        found.append(work.written(best.select("handle", F.col("m.match").alias("match"), F.col("m.tier").alias("tier"), F.col("m.meters").alias("meters")), "tier"))
    result = written(reduce(DataFrame.unionByName, found), "matches")
    work.drop()
    return result


def filled(df: DataFrame, details: DataFrame, columns: tuple[str, ...], key: str = "handle") -> DataFrame:
    """Blank columns filled from detail rows (one for each key)."""
    d = details.select(key, *[F.col(c).alias(f"_d_{c}") for c in columns])
    out = df.join(d, key, "left")
    return out.withColumns({c: F.coalesce(X.present(F.col(c)), F.col(f"_d_{c}")) for c in columns}).select(*df.columns)
