"""Places near one another where places crowd: cells that split while they are full, and nearest places by growing rings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..plans.work import WorkTables, by_key, written
from .components import components

#: Pairs of rows of two cells that are compared one by one; two cells with more are split.
PAIRS = 1 << 12
#: Comparisons a row from which on cells that hang together are left out first.
CROWDED = 64


def _reach(a: str, b: str) -> tuple[Column, Column]:
    """The least and the largest distance in metres that points of the boxes of two cells (columns s, n, w, e) can have."""
    x = lambda side, c: F.col(f"{side}.{c}")
    dlat = (F.greatest(F.lit(0.0), x(a, "s") - x(b, "n"), x(b, "s") - x(a, "n")), F.greatest(x(a, "n") - x(b, "s"), x(b, "n") - x(a, "s")))
    lo = F.greatest(F.lit(0.0), x(a, "w") - x(b, "e"), x(b, "w") - x(a, "e"))
    hi = F.greatest(x(a, "e") - x(b, "w"), x(b, "e") - x(a, "w"))
    dlon = (F.when(hi <= 180, lo).when(lo >= 180, 360 - hi).otherwise(F.least(lo, 360 - hi)), F.when(hi <= 180, hi).when(lo >= 180, 360 - lo).otherwise(F.lit(180.0)))
    cosines = lambda side: [F.greatest(F.lit(0.0), F.cos(F.radians(x(side, c)))) for c in ("s", "n")]
    widest = lambda side: F.when((x(side, "s") <= 0) & (x(side, "n") >= 0), F.lit(1.0)).otherwise(F.greatest(*cosines(side)))
    out = []
    for k, both in ((0, F.least(*cosines(a)) * F.least(*cosines(b))), (1, widest(a) * widest(b))):
        h = F.least(F.lit(1.0), F.pow(F.sin(F.radians(dlat[k]) / 2), 2) + both * F.pow(F.sin(F.radians(F.least(dlon[k], F.lit(180.0))) / 2), 2))
        out.append(2 * geo.EARTH_METERS * F.asin(F.sqrt(h)))
    return out[0] * (1 - 1e-9), out[1] * (1 + 1e-9)


def _boxes(points: DataFrame) -> DataFrame:
    ends = [f(c).alias(n) for n, f, c in (("s", F.min, "lat"), ("n", F.max, "lat"), ("w", F.min, "lon"), ("e", F.max, "lon"))]
    return points.groupBy("grp", "cell").agg(*ends, F.count(F.lit(1)).alias("size"), F.min("handle").alias("least"), F.min("color").alias("c0"), F.max("color").alias("c1"), F.max("label").alias("label"))


def _split(points: DataFrame, boxes: DataFrame) -> DataFrame:
    """The points of these cells, each in the quarter of its cell's box that it lies in."""
    held = points.join(by_key(boxes.select("grp", "cell", "s", "n", "w", "e")), ["grp", "cell"])
    upper = lambda c, lo, hi: (F.col(hi) > F.col(lo)) & ((F.col(c) > (F.col(lo) + F.col(hi)) / 2) | (F.col(c) == F.col(hi)))  # noqa: E731  (halves a box of any extent)
    quarter = F.when(upper("lat", "s", "n"), 2).otherwise(0) + F.when(upper("lon", "w", "e"), 1).otherwise(0)
    return held.select("grp", F.concat("cell", quarter.cast("string")).alias("cell"), F.col("cell").alias("parent"), "handle", "lat", "lon", "color", "label")


def _labelled(judged: DataFrame, work: WorkTables) -> DataFrame:
    """(grp, cell, label) of cells whose rows all hang together; cells that hang together have one label."""
    node = lambda side: F.coalesce(F.col(f"l{side}"), F.concat_ws("\x00", "grp", F.col(f"n{side}")))
    links = judged.where("verdict = 'link' AND colors").select("grp", F.col("u").alias("nx"), F.col("v").alias("ny"), "a", "b", "lx", "ly")
    edges = links.select(node("x").alias("u"), node("y").alias("v")).where("u <> v").distinct()
    ends = links.select("grp", F.explode(F.array(F.struct(F.col("a").alias("cell"), node("x").alias("node")), F.struct(F.col("b").alias("cell"), node("y").alias("node")))).alias("e")).select("grp", "e.cell", "e.node")
    before = judged.select("grp", F.explode(F.array(F.struct(F.col("a").alias("cell"), F.col("lx").alias("node")), F.struct(F.col("b").alias("cell"), F.col("ly").alias("node")))).alias("e")).select("grp", "e.cell", "e.node").where("node IS NOT NULL")
    found = components(edges)
    return work.written(ends.unionByName(before).distinct().join(by_key(found), "node", "left").groupBy("grp", "cell").agg(F.min(F.coalesce("component", "node")).alias("label")), "labels")


def near_links(df: DataFrame, keys: list[str], meters: float, color: str | None = None, pairs: int = PAIRS) -> DataFrame:
    """Edges (u, v) with the components of all pairs within ``meters`` that agree on ``keys`` (and differ in ``color``).

    Rows at one point with the same keys and colour are one. Cells of a grid are compared by the boxes of their points: if
    all distances are within reach, both cells hang together by their least handles (a star; with colours, if there are two
    or more, and each cell has one or no greater width than the reach); if none is, there is no edge; of the others, pairs
    of few rows are compared row by row, and the rest is split in quarters and compared again. Where comparisons would be
    many times the rows, cells that hang together already aren't compared further. So a crowd costs no square of its rows.
    """
    work = WorkTables(df.sparkSession)
    usable = df.where(~geo.unusable(F.col("lat"), F.col("lon"))).dropna(subset=keys)
    tint = F.col(color) if color else F.lit(None).cast("string")
    grp = F.concat_ws("\x00", *[F.col(k).cast("string") for k in keys])
    rows = work.written(usable.select("handle", "lat", "lon", grp.alias("grp"), tint.alias("color")), "crowd")
    row, col = geo.cells(F.col("lat"), F.col("lon"), meters)
    name = lambda r, c: F.concat_ws(":", r.cast("long").cast("string"), c.cast("string"), F.lit(""))
    once = rows.groupBy("grp", "lat", "lon", "color").agg(F.min("handle").alias("handle"))
    several = once.groupBy("grp").agg(F.count(F.lit(1)).alias("_k")).where("_k > 1").select("grp")  # a group of one point has no edge
    points = work.written(once.join(by_key(several), "grp", "left_semi").withColumns({"cell": name(row, col), "label": F.lit(None).cast("string")}), "points")
    n_points = points.count()
    around = points.select("grp", F.col("cell").alias("a"), F.explode(geo.near_cells(F.col("lat"), F.col("lon"), meters)).alias("b"))
    asked = around.select("grp", "a", name(F.col("b.row"), F.col("b.col")).alias("b")).where("a <= b").distinct()
    edges, active = [], []
    foreign = F.lit(True) if color is None else ~F.col("x.color").eqNullSafe(F.col("y.color"))
    several_colors = F.lit(True) if color is None else F.least("x.c0", "y.c0") != F.greatest("x.c1", "y.c1")
    while True:
        boxes = work.written(_boxes(points), "boxes")
        lower, upper = _reach("x", "y")
        exact = geo.haversine(F.col("x.s"), F.col("x.w"), F.col("y.s"), F.col("y.w"))
        mono = (F.col("x.c0") == F.col("x.c1")) & (F.col("y.c0") == F.col("y.c1"))
        whole = F.lit(True) if color is None else mono | ((_reach("x", "x")[1] <= meters) & (_reach("y", "y")[1] <= meters))
        single = (F.col("x.s") == F.col("x.n")) & (F.col("x.w") == F.col("x.e")) & (F.col("y.s") == F.col("y.n")) & (F.col("y.w") == F.col("y.e"))
        verdict = F.when(F.col("x.label") == F.col("y.label"), "none").when(single, F.when(exact <= meters, "link").otherwise("none")).when((upper <= meters) & whole, "link").when(lower > meters, "none").when(F.col("x.size") * F.col("y.size") <= pairs, "rows").otherwise("split")
        met = asked.join(by_key(boxes).alias("x"), [F.col("x.grp") == asked["grp"], F.col("x.cell") == asked["a"]]).join(by_key(boxes).alias("y"), [F.col("y.grp") == asked["grp"], F.col("y.cell") == asked["b"]])
        judged = work.written(met.select(asked["grp"], "a", "b", verdict.alias("verdict"), F.coalesce(several_colors, F.lit(False)).alias("colors"), F.col("x.least").alias("u"), F.col("y.least").alias("v"), F.col("x.label").alias("lx"), F.col("y.label").alias("ly"), (F.col("x.size") * F.col("y.size")).alias("product")), "cells")
        left = judged.where("verdict IN ('rows', 'split')")
        labels = None
        if (left.agg(F.sum("product")).first()[0] or 0) > CROWDED * n_points:
            labels = _labelled(judged, work)
            own = lambda side, name: labels.select("grp", F.col("cell").alias(side), F.col("label").alias(name))
            left = left.join(by_key(own("a", "la")), ["grp", "a"], "left").join(by_key(own("b", "lb")), ["grp", "b"], "left").where("NOT coalesce(la = lb, false)")
        links = judged.where("verdict = 'link' AND colors")
        edges.append(links.where("a <> b").select("grp", "u", "v"))
        active.append(by_key(points).join(links.select("grp", F.explode(F.array(F.struct(F.col("a").alias("cell"), F.col("u").alias("least")), F.struct(F.col("b").alias("cell"), F.col("v").alias("least")))).alias("c")).select("grp", "c.cell", "c.least").distinct(), ["grp", "cell"]).select("grp", F.col("least").alias("u"), F.col("handle").alias("v")))
        some = left.where("verdict = 'rows'").select("grp", "a", "b")
        x, y = points.alias("x"), points.alias("y")
        compared = some.join(by_key(x), [some["grp"] == F.col("x.grp"), some["a"] == F.col("x.cell")]).join(by_key(y), [some["grp"] == F.col("y.grp"), some["b"] == F.col("y.cell")])
        near = (geo.haversine(F.col("x.lat"), F.col("x.lon"), F.col("y.lat"), F.col("y.lon")) <= meters) & ((F.col("a") != F.col("b")) | (F.col("x.handle") < F.col("y.handle")))
        edges.append(compared.where(near & foreign).select(some["grp"], F.col("x.handle").alias("u"), F.col("y.handle").alias("v")))
        wide = left.where("verdict = 'split'").select("grp", "a", "b")
        if wide.isEmpty():
            break
        cells = wide.select("grp", F.explode(F.array("a", "b")).alias("cell")).distinct()
        if labels is not None:
            points = points.drop("label").join(by_key(labels), ["grp", "cell"], "left")
        halved = work.written(_split(points, boxes.join(by_key(cells), ["grp", "cell"], "left_semi")), "points")
        parts = halved.select("grp", "parent", "cell").distinct()
        p, q = parts.select("grp", F.col("parent").alias("a"), F.col("cell").alias("a2")), parts.select("grp", F.col("parent").alias("b"), F.col("cell").alias("b2"))
        asked = work.written(wide.join(by_key(p), ["grp", "a"]).join(by_key(q), ["grp", "b"]).where("a <> b OR a2 <= b2").select("grp", F.col("a2").alias("a"), F.col("b2").alias("b")), "asked")
        points = halved.drop("parent")
    found = reduce(DataFrame.unionByName, [*edges, *active]).where("u <> v").select("grp", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    found = work.written(found, "links")
    first = once.select(*[F.col(c).alias(f"_{c}") for c in ("grp", "lat", "lon", "color", "handle")])
    same = rows.join(by_key(first), (F.col("grp") == F.col("_grp")) & (F.col("lat") == F.col("_lat")) & (F.col("lon") == F.col("_lon")) & F.col("color").eqNullSafe(F.col("_color")))
    same = same.where("handle <> _handle").select("grp", F.col("_handle").alias("u"), F.col("handle").alias("v"))
    if color is not None:  # rows of one colour at one point hang together only through another
        same = same.join(by_key(found.select("grp", F.explode(F.array("u", "v")).alias("u")).distinct()), ["grp", "u"], "left_semi")
    out = written(found.select("u", "v").unionByName(same.select("u", "v")).distinct(), "near-links")
    work.drop()
    return out


def nearest_within(known: DataFrame, keys: list[str], meters: float, rings: int = 2) -> list[Callable[[DataFrame], DataFrame]]:
    """Steps that give (handle, match, meters): the place of ``known`` nearest to each given row that agrees on ``keys``.

    ``known`` counts as points, each with its least handle, however many rows share one. Each step takes what the ones
    before haven't found and looks four times as far, so that where places crowd the first ring, of ``meters / 4 ** (rings - 1)``, is enough.
    """
    points = known.where(~geo.unusable(F.col("lat"), F.col("lon"))).groupBy(*keys, "lat", "lon").agg(F.min("handle").alias("handle"))

    def ring(radius: float) -> Callable[[DataFrame], DataFrame]:
        row, col = geo.cells(F.col("lat"), F.col("lon"), radius)
        own = points.withColumns({"_row": row.cast("long"), "_col": col}).alias("b")

        def step(rest: DataFrame) -> DataFrame:
            usable = rest.where(~geo.unusable(F.col("lat"), F.col("lon"))).select("handle", *keys, "lat", "lon")
            around = usable.withColumn("_cell", F.explode(geo.near_cells(F.col("lat"), F.col("lon"), radius))).withColumns({"_row": F.col("_cell.row"), "_col": F.col("_cell.col")}).alias("a")
            gap = geo.haversine(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
            met = around.join(by_key(own), [F.col(f"a.{k}") == F.col(f"b.{k}") for k in ("_row", "_col", *keys)]).where(gap <= radius)
            return met.select(F.col("a.handle").alias("handle"), F.col("b.handle").alias("match"), gap.alias("meters"))

        return step

    return [ring(meters / 4**k) for k in reversed(range(rings))]
