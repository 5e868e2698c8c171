"""Coordinates and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_METERS, EARTH_MILES, METERS_PER_DEGREE = 6_371_000.0, 3959.0, 111_320.0
#: Leading part of a text that JavaScript's number parser would take.
NUMBER_PREFIX = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
INTEGER_PREFIX = r"^\s*([+-]?\d+)"


def parse_number(text: Column) -> Column:
    """The number that a text begins with; null if it begins with none."""
    return F.regexp_extract(text, NUMBER_PREFIX, 1).try_cast("double")


def parse_integer(text: Column) -> Column:
    return F.regexp_extract(text, INTEGER_PREFIX, 1).try_cast("int")


def strict_coordinate(text: Column, limit: float) -> Column:
    """A finite number within +-limit, else null."""
    value = F.trim(text).try_cast("double")
    return F.when(~F.isnan(value) & value.between(-limit, limit), value)


def format_coordinate(value: Column) -> Column:
    return F.when(value.isNotNull(), F.format_string("%.7f", value))


def coordinate_error(text: Column, limit: float) -> Column:
    """Null if fine, else empty, not_a_number, invalid_number or out_of_range."""
    value = F.trim(text).try_cast("double")
    return (
        F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit("empty"))
        .when(value.isNull(), F.lit("not_a_number"))
        .when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit("invalid_number"))
        .when(~value.between(-limit, limit), F.lit("out_of_range"))
    )


def decimals(text: Column) -> Column:
    """Digits after the point, without closing zeros."""
    return F.length(F.regexp_extract(F.trim(text), r"\.(\d*?)0*$", 1))


def unusable(lat: Column, lon: Column) -> Column:
    """Missing, not finite, out of range, or a placeholder at (0, 0)."""
    inside = lat.between(-90, 90) & lon.between(-180, 180) & ~F.isnan(lat) & ~F.isnan(lon)
    return ~F.coalesce(inside & ~((F.abs(lat) < 1e-6) & (F.abs(lon) < 1e-6)), F.lit(False))


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column, radius: float = EARTH_METERS) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(F.greatest(F.lit(0.0), 1 - a)))


def miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Miles, rounded to a tenth (half up)."""
    return F.floor(haversine(lat1, lon1, lat2, lon2, EARTH_MILES) * 10 + 0.5) / 10


def great_circle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres by the law of cosines, with the cosine held within [-1, 1]."""
    c = F.sin(F.radians(lat1)) * F.sin(F.radians(lat2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(F.radians(lon2 - lon1))
    return EARTH_METERS * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))


def bounding_box(lat: Column, lon: Column, meters: float) -> tuple[Column, Column, Column, Column]:
    """South, north, west, east of a circle."""
    dlat = F.lit(meters / METERS_PER_DEGREE)
    dlon = meters / (METERS_PER_DEGREE * F.greatest(F.lit(0.01), F.cos(F.radians(lat))))
    return lat - dlat, lat + dlat, lon - dlon, lon + dlon


def correction(lat: Column, lon: Column, new_lat: Column, new_lon: Column, drift: float = 225.0) -> Column:
    """no_geocode, keep (geocode within the drift) or replace."""
    far = F.coalesce(haversine(lat, lon, new_lat, new_lon) > drift, F.lit(True))
    return F.when(unusable(new_lat, new_lon), "no_geocode").when(unusable(lat, lon) | far, "replace").otherwise("keep")


def cells(lat: Column, lon: Column, meters: float) -> tuple[Column, Column]:
    """Row and column of a grid whose cells are at least ``meters`` wide everywhere up to the latitude's band.

    The number of columns of a band follows from the band's narrowest circle, so a circle of that radius never reaches
    beyond the neighbouring columns of its own band.
    """
    size = meters / METERS_PER_DEGREE * 1.01
    row = F.floor(lat / size)
    edge = F.greatest(F.abs(row * size), F.abs((row + 1) * size))
    return row, column_in(row, lon, edge, size)


def column_in(row: Column, lon: Column, edge: Column, size: float) -> Column:
    n = F.greatest(F.lit(1), F.floor(360 * F.greatest(F.lit(0.0), F.cos(F.radians(F.least(edge, F.lit(90.0))))) / size))
    return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n.cast("long"))


def touched_cells(lat: Column, lon: Column, meters: float, width: float) -> Column:
    """Array of (row, column) of the grid of ``width`` that a circle of ``meters``, a fraction of that, can touch.

    Most circles touch one or two cells, so rows that are compared by further keys are repeated less than by
    :func:`near_cells`. Bands of few columns count with all of them, as there.
    """
    size, dlat = width / METERS_PER_DEGREE * 1.01, meters / METERS_PER_DEGREE * 1.01
    dlon = dlat / F.greatest(F.lit(1e-6), F.cos(F.radians(F.least(F.lit(90.0), F.abs(lat) + dlat))))

    def band(row: Column) -> Column:
        edge = F.least(F.lit(90.0), F.greatest(F.abs(row * size), F.abs((row + 1) * size)))
        return F.struct(row.alias("row"), F.greatest(F.lit(1), F.floor(360 * F.greatest(F.lit(0.0), F.cos(F.radians(edge))) / size)).cast("long").alias("n"))

    row = lambda y: F.floor(y / size).cast("long")
    column = lambda x, n: F.floor((x + 180) / 360 * n).cast("long")
    bands = F.transform(F.sequence(row(lat - dlat), row(lat + dlat)), band)
    columns = lambda b: F.when(b["n"] <= 24, F.sequence(F.lit(0).cast("long"), b["n"] - 1)).otherwise(F.sequence(column(lon - dlon, b["n"]), column(lon + dlon, b["n"])))
    return F.array_distinct(F.flatten(F.transform(bands, lambda b: F.transform(columns(b), lambda c: F.struct(b["row"].alias("row"), F.pmod(c, b["n"]).alias("col"))))))


def near_cells(lat: Column, lon: Column, meters: float) -> Column:
    """Array of (row, column) that a circle around the point can touch; the date line wraps around.

    A band of few columns lies so near a pole that a circle may reach beyond it, and counts with all of them.
    """
    size = meters / METERS_PER_DEGREE * 1.01
    steps = F.array(*[F.lit(d).cast("long") for d in (-1, 0, 1)])

    def band(row: Column) -> Column:
        """The row with its number of columns."""
        edge = F.least(F.lit(90.0), F.greatest(F.abs(row * size), F.abs((row + 1) * size)))
        return F.struct(row.alias("row"), F.greatest(F.lit(1), F.floor(360 * F.greatest(F.lit(0.0), F.cos(F.radians(edge))) / size)).cast("long").alias("n"))

    bands = F.transform(F.transform(steps, lambda d: F.floor(lat / size).cast("long") + d), band)
    columns = lambda b: F.when(b["n"] <= 24, F.sequence(F.lit(0).cast("long"), b["n"] - 1)).otherwise(F.transform(steps, lambda d: F.floor((lon + 180) / 360 * b["n"]).cast("long") + d))
    cell = lambda b, c: F.struct(b["row"].alias("row"), F.pmod(c, b["n"]).alias("col"))
    return F.array_distinct(F.flatten(F.transform(bands, lambda b: F.transform(columns(b), lambda c: cell(b, c)))))
