"""Keep-first and survivor selection, merge plans, intra-table clustering."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import brands as B
from ..functions import geo
from ..functions import text as X
from ..functions.country import country_key, normalized_country
from ..plans.work import WorkTables, by_key, written
from .components import components
from .crowds import near_links
from .joins import block_stars, meters_between
from .similarity import contained

#: Metres that a tile is wide in which address keys that hold others are looked for.
TILE = 5000
#: How many times wider than the reach cells are in which rows with a key in common meet.
WIDER = 5


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in order (ascending); rows with a blank part of the key all stay.

    Each task keeps its own first row of a key before they meet, so a key that many rows have isn't gathered in one place.
    """
    cols = {f"_k{n}": F.trim(k.cast("string")) for n, k in enumerate(keys)}
    keyed = df.withColumns(cols)
    whole = reduce(lambda a, b: a & b, [~X.blank(F.col(c)) for c in cols], F.lit(True))
    row = F.struct(*[F.col(f"`{c}`") for c in keyed.columns])
    first = keyed.where(whole).groupBy(*[F.col(c).alias(f"_g{c}") for c in cols]).agg(F.min_by(row, F.struct(*[o.alias(f"o{n}") for n, o in enumerate(order)])).alias("_row")).select("_row.*")
    return first.unionByName(keyed.where(~whole)).drop(*cols)


def duplicates(df: DataFrame, keys: list[Column], order: Column) -> DataFrame:
    """Keys held by more than one row, with the rows in order."""
    cols = {f"k{n}": F.trim(k.cast("string")) for n, k in enumerate(keys)}
    keyed = df.select(order.alias("_o"), *[c.alias(n) for n, c in cols.items()]).where(reduce(lambda a, b: a & b, [~X.blank(F.col(c)) for c in cols], F.lit(True)))
    return keyed.groupBy(*cols).agg(F.count(F.lit(1)).cast("long").alias("n"), F.sort_array(F.collect_list("_o")).alias("rows")).where("n > 1")


def record_key(lat: Column, lon: Column, country: Column, line1: Column, city: Column, handle: Column) -> Column:
    """Place, else address, else handle; null if there is none of these."""
    land = F.lower(normalized_country(country))
    place = F.when(~geo.unusable(lat, lon), F.concat_ws("|", F.lit("geo"), F.format_string("%.5f", lat), F.format_string("%.5f", lon), F.coalesce(land, F.lit(""))))
    address = F.when(X.address_key(line1) != "", F.concat_ws("|", F.lit("addr"), X.address_key(line1), F.lower(F.trim(city)), F.coalesce(land, F.lit(""))))
    return F.coalesce(place, address, F.when(~X.blank(handle), F.concat(F.lit("handle|"), F.trim(handle))))


def unique_handles(df: DataFrame, handle: str, order: Column) -> DataFrame:
    """Handles made distinct: the first row of each keeps it, later ones get -1, -2, ... in order.

    A number is passed over where another row has that handle as its own, so no handle is given twice. The n-th number
    that is free is n and as many more as there are taken numbers t(1) < t(2) < ... with t(i) - i < n.
    """
    number = F.regexp_extract(handle, r"^.*-([1-9]\d{0,8})$", 1)
    own = df.select(F.regexp_extract(handle, r"^(.*)-[1-9]\d{0,8}$", 1).alias("_stem"), number.try_cast("long").alias("_t")).where("_t IS NOT NULL").distinct()
    before = own.select("_stem", (F.col("_t") - F.row_number().over(Window.partitionBy("_stem").orderBy("_t"))).alias("_at"))
    ranked = df.withColumn("_n", F.row_number().over(Window.partitionBy(handle).orderBy(order)) - 1)
    later = ranked.where("_n > 0")
    passed = later.select(F.col(handle).alias("_stem"), "_n").join(before, "_stem").where("_at < _n").groupBy("_stem", "_n").agg(F.count(F.lit(1)).alias("_more"))
    placed = later.join(passed.withColumnsRenamed({"_stem": handle}), [handle, "_n"], "left")
    given = F.concat(F.col(handle), F.lit("-"), (F.col("_n") + F.coalesce("_more", F.lit(0))).cast("string"))
    return ranked.where("_n = 0").select(*df.columns).unionByName(placed.withColumn(handle, given).select(*df.columns))


def rank_key() -> list[Column]:
    """Survivor order: premium, number of brands, length of the name, date, handle."""
    return [F.desc("is_premium"), F.size(B.tokens(F.col("brands"))).desc(), F.length(F.trim("name")).desc(), F.desc("updated_at"), F.asc("handle")]


def rank_struct() -> Column:
    """The order of :func:`rank_key` as one value, the best one being the least."""
    down = lambda v: (v.isNull(), -v)
    parts = [*down(F.col("is_premium").cast("int")), *down(F.size(B.tokens(F.col("brands")))), *down(F.length(F.trim("name"))), *down(F.unix_micros(F.col("updated_at").cast("timestamp"))), F.col("handle")]
    return F.struct(*[p.alias(f"r{n}") for n, p in enumerate(parts)])


def survivors(df: DataFrame, group: str) -> DataFrame:
    """The best row of each group, by partial aggregates."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    return df.groupBy(F.col(group).alias("_g")).agg(F.min_by(row, rank_struct()).alias("_row")).select("_row.*")


def with_keys(df: DataFrame) -> DataFrame:
    """Names, addresses, cities and countries as keys, computed once before rows are paired."""
    line = F.col("line1")
    keys = {"k_country": country_key(F.col("country")), "k_city": X.alnum(F.col("city")), "k_addr": X.address_key(line), "k_line": X.alnum(line), "k_name": X.alnum(F.col("name")), "lat5": F.round("lat", 5), "lon5": F.round("lon", 5)}
    return df.withColumns(keys)


def _aligned_links(keyed: DataFrame, meters: float) -> DataFrame:
    """(u, v) with the components of all pairs within ``meters`` of aligned addresses and the same city or similar names.

    Addresses align if their lines or keys are equal or one key holds the other. Equal lines or keys with an equal city or
    name need no further test and are linked by cells (:func:`.crowds.near_links`); equal keys with names that are only
    similar meet by what such names share; and keys that hold others by their rarest gram, within tiles of a few kilometres.
    """
    usable = keyed.where(~geo.unusable(F.col("lat"), F.col("lon")))
    line = F.lower(F.trim("line1"))
    keys = {"t": F.when(line != "", line), "l": F.when(F.col("k_line") != "", F.col("k_line")), "a": F.when(F.length("k_addr") >= 6, F.col("k_addr"))}
    each = usable.withColumn("_key", F.explode(F.filter(F.array(*[F.concat(F.lit(n), k) for n, k in keys.items()]), lambda k: k.isNotNull())))
    with_city = each.where(~F.col("_key").startswith("a"))  # equal address keys in a city are linked wherever they are
    marked = [with_city.select("handle", "lat", "lon", "k_country", "_key", F.concat(F.lit("city "), "k_city").alias("_by")), each.select("handle", "lat", "lon", "k_country", "_key", F.concat(F.lit("name "), "k_name").alias("_by"))]
    links = near_links(marked[0].unionByName(marked[1]), ["k_country", "_key", "_by"], meters)

    a, b = lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")
    row, col = geo.cells(F.col("lat"), F.col("lon"), WIDER * meters)
    named = each.groupBy("k_country", "_key", "k_name", "lat", "lon").agg(F.min("handle").alias("handle"))
    own = named.withColumns({"_row": row.cast("long"), "_col": col, "_name": F.explode(X.name_keys(F.col("k_name"), False))}).alias("b")
    around = named.withColumn("_cell", F.explode(geo.touched_cells(F.col("lat"), F.col("lon"), meters, WIDER * meters))).withColumn("_name", F.explode(X.name_keys(F.col("k_name"), True))).withColumns({"_row": F.col("_cell.row"), "_col": F.col("_cell.col")}).alias("a")
    met = around.join(by_key(own), [a(k) == b(k) for k in ("_row", "_col", "k_country", "_key", "_name")] + [a("k_name") != b("k_name"), meters_between() <= meters, X.names_similar(a("k_name"), b("k_name"))])

    held = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), F.col(n).alias("key")) for n in ("k_addr", "k_line")]))
    rows = usable.select("handle", "lat", "lon", "k_country", "k_city", "k_name", held.alias("_h")).select("*", "_h.*").drop("_h").where(F.length("key") >= X.MIN_CONTAINED)
    rows = rows.groupBy("k_country", "k_city", "k_name", "kind", "key", "lat", "lon").agg(F.min("handle").alias("handle"))
    south, north, west, east = geo.bounding_box(F.col("lat"), F.col("lon"), meters)
    tile = lambda lat, lon: F.struct(*[c.cast("long").alias(n) for n, c in zip(("row", "col"), geo.cells(lat, lon, TILE))])
    corners = F.array_distinct(F.array(*[tile(y, x) for y in (south, north) for x in (west, east)]))
    test = (meters_between() <= meters) & X.key_contains(a("key"), b("key")) & ((a("k_city") == b("k_city")) | (a("k_name") == b("k_name")) | X.names_similar(a("k_name"), b("k_name")))
    extended = contained(rows.withColumn("_tile", F.explode(corners)), rows.withColumn("_tile", tile(F.col("lat"), F.col("lon"))), ["_tile", "kind", "k_country"], "key", X.MIN_CONTAINED, test)
    pairs = met.select(a("handle").alias("u"), b("handle").alias("v")).unionByName(extended.select(a("handle").alias("u"), b("handle").alias("v")))
    return links.unionByName(pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")))


def match_edges(df: DataFrame) -> DataFrame:
    """(u, v, rule): edges whose components are taken for the same place, by any of five rules, each an equality join; u < v.

    Rules: the same rounded coordinates; the same address key and city; the same source key; and within 300 m an aligned
    address with the same city or an equal or similar name. All ask for the same country. Rows that are linked without a
    further test hang on their block's least handle, not each on each, so edges are as few as rows; see
    :func:`_aligned_links` for the last rule.
    """
    work = WorkTables(df.sparkSession)
    columns = ["handle", "lat", "lon", "line1", *(["source_key"] if "source_key" in df.columns else [])]
    keyed = work.written(with_keys(df).select(*columns, "k_country", "k_city", "k_addr", "k_line", "k_name", "lat5", "lon5"), "keyed")
    rules = {
        "coordinates": block_stars(keyed.where(~geo.unusable(F.col("lat"), F.col("lon"))), ["k_country", "lat5", "lon5"]),
        "address": block_stars(keyed.where(F.length("k_addr") >= 6), ["k_country", "k_city", "k_addr"]),
        "near": _aligned_links(keyed, 300),
    }
    if "source_key" in df.columns:
        rules["source"] = block_stars(keyed.where(~X.blank(F.col("source_key"))), ["k_country", "source_key"])
    edges = written(reduce(DataFrame.unionByName, [e.withColumn("rule", F.lit(name)) for name, e in rules.items()]), "edges")
    work.drop()
    return edges


def clusters(df: DataFrame) -> DataFrame:
    """(handle, cluster): components of :func:`match_edges`; a row without edges is its own."""
    found = components(match_edges(df).select("u", "v").distinct())
    return df.select("handle").join(by_key(found.withColumnRenamed("node", "handle")), "handle", "left").select("handle", F.coalesce("component", "handle").alias("cluster"))


def wider_than(df: DataFrame, group: str, meters: float) -> DataFrame:
    """Groups (column ``group``) with two usable members more than ``meters`` apart.

    Two bounds come first, by partial aggregates: the distance of each member from one of them is at most the spread, and
    twice the largest is at least the spread. Only groups between the bounds are looked at in detail: of members in the
    same cell of a fine grid (a hundredth of the limit) pairs are no use, so each group has at most as many points as the
    limit's circle has cells, and these are compared.
    """
    usable = df.where(~geo.unusable(F.col("lat"), F.col("lon"))).select(group, "handle", "lat", "lon")
    one = usable.groupBy(group).agg(F.min(F.struct("handle", "lat", "lon")).alias("_o"))
    away = geo.haversine(F.col("lat"), F.col("lon"), F.col("_o.lat"), F.col("_o.lon"))
    reach = usable.join(by_key(one), group).groupBy(group).agg(F.max(away).alias("_far"))
    doubtful = usable.join(by_key(reach.where((F.col("_far") <= meters) & (2 * F.col("_far") > meters)).select(group)), group)
    row, col = geo.cells(F.col("lat"), F.col("lon"), meters / 100)
    corner = lambda f, c: f(F.struct(F.col(c).alias("_by"), "handle", "lat", "lon"))
    cells = doubtful.groupBy(group, row.alias("_row"), col.alias("_col")).agg(*[corner(f, c).alias(n) for n, f, c in (("_s", F.min, "lat"), ("_n", F.max, "lat"), ("_w", F.min, "lon"), ("_e", F.max, "lon"))])
    points = cells.select(group, F.explode(F.array_distinct(F.array(*[F.struct(f"{c}.handle", f"{c}.lat", f"{c}.lon") for c in ("_s", "_n", "_w", "_e")]))).alias("_p")).select(group, "_p.*")
    pairs = points.alias("a").join(points.alias("b"), [F.col(f"a.{group}") == F.col(f"b.{group}"), F.col("a.handle") < F.col("b.handle")])
    found = pairs.where(meters_between() > meters).select(F.col(f"a.{group}").alias(group)).distinct()
    return reach.where(F.col("_far") > meters).select(group).unionByName(found)


def _variant_links(rest: DataFrame, meters: float) -> DataFrame:
    """(u, v) with the components of all pairs within ``meters`` of different addresses, similar names and a number in common.

    Rows of one name that share a number hang together by cells, with the address as a colour; names that are only similar
    meet by what such names share, as classes of equal rows, of which those that are linked take their rows along.
    """
    keys = ["k_country", "k_name", "k_addr", "number", "lat", "lon"]
    usable = rest.where(~geo.unusable(F.col("lat"), F.col("lon")) & (F.col("k_name") != ""))
    rows = usable.select("handle", "k_country", "k_name", "k_addr", "lat", "lon", F.explode(X.street_numbers(F.col("line1"))).alias("number"))
    links = near_links(rows, ["k_country", "k_name", "number"], meters, color="k_addr")
    a, b = lambda n: F.col(f"a.{n}"), lambda n: F.col(f"b.{n}")
    row, col = geo.cells(F.col("lat"), F.col("lon"), WIDER * meters)
    classes = rows.groupBy(*keys).agg(F.min("handle").alias("handle"))
    own = classes.withColumns({"_row": row.cast("long"), "_col": col, "_name": F.explode(X.name_keys(F.col("k_name"), False))}).alias("b")
    around = classes.withColumn("_cell", F.explode(geo.touched_cells(F.col("lat"), F.col("lon"), meters, WIDER * meters))).withColumn("_name", F.explode(X.name_keys(F.col("k_name"), True))).withColumns({"_row": F.col("_cell.row"), "_col": F.col("_cell.col")}).alias("a")
    test = (a("k_name") != b("k_name")) & (a("k_addr") != b("k_addr")) & (meters_between() <= meters) & X.names_similar(a("k_name"), b("k_name"))
    pairs = written(around.join(by_key(own), [a(k) == b(k) for k in ("_row", "_col", "k_country", "number", "_name")] + [test]).select(a("handle").alias("u"), b("handle").alias("v"), a("number").alias("number")).distinct(), "pairs")
    linked = pairs.select(F.explode(F.array("u", "v")).alias("u"), "number").distinct()
    members = by_key(rows).join(classes.withColumnRenamed("handle", "u").join(by_key(linked), ["u", "number"]), keys).where("u <> handle").select("u", F.col("handle").alias("v"))
    return links.unionByName(pairs.select("u", "v")).unionByName(members)


def merge_plans(df: DataFrame, max_spread: float = 500.0) -> DataFrame:
    """(handle, plan, pass): rows to be merged. First groups of one address key, then near pairs of similar names.

    First pass: the same address key (6 characters or more), city and country. Second pass, on what is left: within
    150 m, different keys, similar names, a street number in common, as components. Groups wider than ``max_spread``
    are left alone.
    """
    work = WorkTables(df.sparkSession)
    keys = {"k_addr": X.address_key(F.col("line1")), "k_name": X.alnum(F.col("name")), "k_country": country_key(F.col("country"))}
    keyed = df.select("handle", "lat", "lon", "line1", F.coalesce(F.lower(F.trim("city")), F.lit("")).alias("city"), *[c.alias(n) for n, c in keys.items()])
    keyed = work.written(keyed.withColumn("plan", F.concat_ws("|", "k_addr", "city", "k_country")), "keyed")
    sized = keyed.where(F.length("k_addr") >= 6)
    large = sized.groupBy("plan").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("plan")
    first = sized.join(by_key(large), "plan", "left_semi")
    wide = wider_than(first, "plan", max_spread)
    one = written(first.join(by_key(wide), "plan", "left_anti").select("handle", "plan", F.lit(1).alias("pass")), "plans")
    rest = work.written(keyed.join(by_key(one.select("handle")), "handle", "left_anti").drop("plan"), "rest")
    found = components(_variant_links(rest, 150))
    second = by_key(rest.select("handle", "lat", "lon")).join(found.select(F.col("node").alias("handle"), F.concat(F.lit("near|"), "component").alias("plan")), "handle")
    wide2 = wider_than(second, "plan", max_spread)
    two = written(second.join(by_key(wide2), "plan", "left_anti").select("handle", "plan", F.lit(2).alias("pass")), "plans")
    work.drop()
    return one.unionByName(two)


def expanded(df: DataFrame, seeds: DataFrame, radius: float = 500.0) -> DataFrame:
    """(handle): every row that may share a merge group with a seed (handle).

    Rows in the seeds' city and country within ``radius`` of one (by bounding box), and rows of the same address key, city
    and country as any of these. Equal keys are transitive and distances count from seeds alone, so one step of each
    reaches the fixpoint.
    """
    line, city = X.address_key(F.col("line1")), F.lower(F.trim("city"))
    keyed = df.select("handle", "lat", "lon", city.alias("city"), country_key(F.col("country")).alias("land"), line.alias("k_addr"))
    asked = keyed.join(seeds.select("handle").distinct(), "handle")
    own = keyed.where(~geo.unusable(F.col("lat"), F.col("lon"))).withColumn("_cell", F.struct(*[c.cast("long").alias(n) for n, c in zip(("row", "col"), geo.cells(F.col("lat"), F.col("lon"), radius * 1.5))]))
    around = asked.where(~geo.unusable(F.col("lat"), F.col("lon"))).withColumn("_cell", F.explode(geo.near_cells(F.col("lat"), F.col("lon"), radius * 1.5)))
    a, b = around.alias("a"), own.alias("b")
    south, north, west, east = geo.bounding_box(F.col("a.lat"), F.col("a.lon"), radius)
    boxed = F.col("b.lat").between(south, north) & F.col("b.lon").between(west, east)
    near = a.join(b, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("_cell", "city", "land")]).where(boxed).select("b.handle", "b.city", "b.land", "b.k_addr")
    found = asked.select("handle", "city", "land", "k_addr").unionByName(near).distinct()
    keys = ["k_addr", "city", "land"]
    peers = keyed.join(found.where(F.length("k_addr") >= 6).select(*keys).distinct(), keys, "left_semi")
    return found.select("handle").unionByName(peers.select("handle")).distinct()


def scoped_merge_plans(df: DataFrame, seeds: DataFrame) -> DataFrame:
    """Merge plans among the rows that may share a group with a seed, however many these are."""
    return merge_plans(df.join(written(expanded(df, seeds), "scope"), "handle", "left_semi"))


def merged(df: DataFrame, plans: DataFrame) -> DataFrame:
    """The table after the plans: losers go, a survivor gets the union of brands and the longest name of its group."""
    held = df.join(by_key(plans.select("handle", "plan")), "handle")
    kept = survivors(held, "plan").select("plan", F.col("handle").alias("keep"))
    w = Window.partitionBy("plan").orderBy(*rank_key())
    ranked = held.withColumn("_r", F.row_number().over(w))
    grouped = ranked.groupBy("plan").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_r", "brands"))), lambda x: x["brands"]).alias("lists"),
        F.max_by(F.trim("name"), F.struct(F.length(F.trim("name")), -F.col("_r"))).alias("long_name"),
        F.max("is_premium").alias("any_premium"),
    )
    union = B.normalized_brands(F.array_join(F.col("lists"), ","))
    gains = grouped.join(kept, "plan").select(F.col("keep").alias("handle"), union.alias("_brands"), "long_name", "any_premium")
    losers = held.select("handle").join(kept.select(F.col("keep").alias("handle")), "handle", "left_anti")
    out = df.join(losers, "handle", "left_anti").join(gains, "handle", "left")
    return out.withColumns({"brands": F.coalesce("_brands", "brands"), "name": F.coalesce("long_name", "name"), "is_premium": F.coalesce("any_premium", "is_premium")}).drop("_brands", "long_name", "any_premium")


def plan_summary(plans: DataFrame, total: int) -> DataFrame:
    """Groups, rows that go and rows that stay, by pass."""
    g = plans.groupBy("pass", "plan").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy("pass").agg(F.count(F.lit(1)).cast("long").alias("n_groups"), F.sum(F.col("n") - 1).cast("long").alias("n_removed")).withColumn("n_total", F.lit(total).cast("long"))


def candidate_report(df: DataFrame) -> DataFrame:
    """Pairs that might be one place, with what speaks for it; the first signal of a pair counts.

    Of rows that share a plan, a point or an address each stands beside the least handle of them, not beside all others:
    a report of n - 1 pairs for n rows.
    """
    work = WorkTables(df.sparkSession)
    keyed = work.written(with_keys(df).select("handle", "name", "line1", "lat", "lon", "k_addr", "k_line", "k_name", "k_city", "k_country", "lat5", "lon5"), "keyed")
    same_place = block_stars(keyed, ["lat5", "lon5"]).withColumn("signal", F.lit("2 coordinates"))
    same_address = block_stars(keyed.where(F.length("k_addr") >= 6), ["k_addr", "k_city", "k_country"]).withColumn("signal", F.lit("3 address"))
    in_plan = block_stars(merge_plans(df), ["plan"]).withColumn("signal", F.lit("1 plan"))
    pairs = in_plan.unionByName(same_place).unionByName(same_address).groupBy("u", "v").agg(F.min("signal").alias("signal"))
    a, b = keyed.alias("a"), keyed.alias("b")
    joined = pairs.join(by_key(a), F.col("u") == F.col("a.handle")).join(by_key(b), F.col("v") == F.col("b.handle"))
    out = joined.select(
        "u", "v", F.substring("signal", 3, 20).alias("signal"), F.round(meters_between(), 1).alias("meters"),
        (F.col("a.k_name") == F.col("b.k_name")).alias("same_name"), X.names_similar(F.col("a.k_name"), F.col("b.k_name")).alias("similar_name"),
        X.keys_align(F.col("a.line1"), F.col("b.line1"), F.col("a.k_line"), F.col("b.k_line"), F.col("a.k_addr"), F.col("b.k_addr")).alias("aligned"), X.share_number(F.col("a.line1"), F.col("b.line1")).alias("same_number"),
        (F.col("a.k_city") == F.col("b.k_city")).alias("same_city"), (F.col("a.k_country") == F.col("b.k_country")).alias("same_country"),
    )
    out = written(out, "report")
    work.drop()
    return out
