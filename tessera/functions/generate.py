"""Generated tables: grids of boxes, prefixes, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GEOHASH = "0123456789bcdefghjkmnpqrstuvwxyz"


def grid(spark: SparkSession, south: float = -90, north: float = 90, west: float = -180, east: float = 180, step: float = 20) -> DataFrame:
    """Boxes of ``step`` degrees from the south-west, cut at the edges."""
    rows = spark.range(int(-(-(north - south) // step))).select((F.lit(south) + F.col("id") * step).cast("double").alias("south"))
    cols = spark.range(int(-(-(east - west) // step))).select((F.lit(west) + F.col("id") * step).cast("double").alias("west"))
    return rows.join(cols).select("south", F.least(F.col("south") + step, F.lit(float(north))).alias("north"), "west", F.least(F.col("west") + step, F.lit(float(east))).alias("east"))


def prefixes(spark: SparkSession, n: int, alphabet: str = GEOHASH) -> DataFrame:
    """All texts of n characters of the alphabet, from their numbers."""
    k = len(alphabet)
    digits = [F.substring(F.lit(alphabet), (F.floor(F.col("id") / k**p) % k + 1).cast("int"), F.lit(1)) for p in range(n - 1, -1, -1)]
    return spark.range(k**n).select(F.concat(*digits).alias("prefix"))


def viewport_url(base: str, south: str = "south", north: str = "north", west: str = "west", east: str = "east") -> Column:
    """A URL that asks for the box of the columns of :func:`grid`."""
    return F.concat(F.lit(base + "?"), F.concat_ws("&", *[F.concat(F.lit(f"{n}="), F.url_encode(F.col(c).cast("string"))) for n, c in (("south", south), ("north", north), ("west", west), ("east", east))]))


#: Named boxes: south, north, west, east.
REGIONS = {"world": (-90, 90, -180, 180), "europe": (35, 71, -25, 45), "north_america": (15, 72, -170, -50), "south_america": (-56, 13, -82, -34), "asia": (-10, 55, 60, 150), "middle_east": (12, 42, 34, 63), "africa": (-35, 37, -18, 52), "oceania": (-47, -10, 110, 180), "usa": (24, 50, -125, -66)}


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, *map(float, b)) for n, b in REGIONS.items()], "name string, south double, north double, west double, east double")


def focused_grid(spark: SparkSession, lat: float, lon: float, radius: float, step: float) -> DataFrame:
    """Boxes around a centre, held within the world."""
    return grid(spark, max(-90.0, lat - radius), min(90.0, lat + radius), max(-180.0, lon - radius), min(180.0, lon + radius), step)
